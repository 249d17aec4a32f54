import json
import re

import pytest
from pyspark.sql import functions as F

import store
from evlake.operators.integrity import accepted_captures, evidence_violations
from evlake.operators.observe import candidate_lookup
from evlake.operators.ranges import read_ranges
from evlake.operators.resolve import resolve_references, source_evidence
from evlake.sources import files, records
from evlake.sources.lake import CommittedBatch, Lake, publish

# Leaves that may hold any value of their type, so that an empty text or a false is no fault.
FREE = re.compile(
    r"/build/(cargo_arguments|features)/\d+$|/analysis/artifact/(manifest_path|executable|target/(edition|doc|doctest|test|crate_types/\d+)"
    r"|profile/(debuginfo|debug_assertions|overflow_checks|test))$|/instances/0/display_name$|/instances/0/(definition/crate_name)$"
)


def leaves(value, path=""):
    """(pointer, value) of everything in a record, inner nodes first."""
    if isinstance(value, dict | list):
        yield path, value
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            yield from leaves(v, f"{path}/{k}")
    else:
        yield path, value


def spoiled(record):
    """One defect per field, chosen by its type: an empty text, a number below zero."""
    for path, value in leaves(record):
        if isinstance(value, str):
            yield path, ""
        elif isinstance(value, int) and not isinstance(value, bool):
            yield path, -3


# What a record says about another part of the evidence: pointer, value, the rule that it breaks.
SOURCE, MODULE = "/instances/0/source/available", "/llvm/collected/0"
RELATIONS = [
    ("/artifacts/1/id", 5, "duplicate_artifact"),
    (f"{SOURCE}/artifact", 404, "unknown_artifact"),
    (f"{SOURCE}/artifact", 9, "wrong_artifact_kind"),
    (f"{MODULE}/artifact", 5, "wrong_artifact_kind"),
    (f"{SOURCE}/range/length", 22, "range_past_end"),
    (f"{MODULE}/definitions/1/range/start", 22, "range_past_end"),
    (f"{SOURCE}/range/start", 2**64 - 5, "range_overflow:source.range"),
    (f"{SOURCE}/range/start", 2**63 + 8, "not_storable:source.range.start"),
    (f"{SOURCE}/starting_line", 0, "zero_line"),
    (f"{MODULE}/definitions/1/raw_symbol", "weave_impl", "duplicate_symbol"),
    (f"{MODULE}/definitions/1/kind", {"direct_alias": {"target": ""}}, "empty:definition.target"),
    ("/instances/0/placements/0/codegen_unit", "loom-unit.8", "missing_module"),
    ("/instances/0/placements", [], "no_placements"),
    ("/capture_id", store.capture_id(777), "id_differs_from_directory"),
    ("/artifacts/0/byte_len", 28, "file_length"),
    (f"{MODULE}/stage", "local_thin_lto_post_pass_manager", "stage_disagrees_with_lto"),
    ("/llvm", {"not_captured": "incremental"}, "orphan_artifact"),
]
# Values outside the domain of an enumeration or of the supported collection.
DOMAINS = [
    (f"{MODULE}/definitions/0/kind", "macro", "domain:definition.kind"),
    (f"{MODULE}/stage", "first", "domain:module.stage"),
    ("/llvm", {"not_captured": "holiday"}, "domain:not_captured_reason"),
    ("/instances/0/source", {"unavailable": "holiday"}, "domain:source_reason"),
    ("/artifacts/0/kind", "video", "domain:artifact.kind"),
    ("/llvm_provenance/optimization", "11", "domain:provenance.optimization"),
    ("/llvm_provenance/backend", "gcc", "unsupported_collection"),
    ("/llvm_provenance/lto", "fat", "unsupported_collection"),
    ("/llvm_provenance/incremental", True, "unsupported_collection"),
    ("/llvm_provenance/linker_plugin_lto", True, "unsupported_collection"),
    ("/llvm_provenance/codegen_units", 0, "zero:provenance.codegen_units"),
    ("/llvm_provenance/recipe_revision", 0, "zero:provenance.recipe_revision"),
    ("/format_version", 77, "unsupported_version"),
    *[(f"{at}/surprise", 1, f"unknown_field:{level}") for at, level in (
        ("", "manifest"), ("/instances/0", "instance"), ("/instances/0/definition", "definition"), ("/artifacts/1", "artifact"))],
]
HEADER_CHANGES = [
    *[(f"{at}/surprise", 1, f"unknown_field:{level}") for at, level in (
        ("", "header"), ("/build", "build"), ("/build/target", "build.target"))],
    ("/format_version", 77, "unsupported_version"),
    ("/id", "loom", "capture_id_format"),
    ("/build/target/kind", "sofa", "domain:target.kind"),
    ("/build/invocation_directory", "w/loom", "relative_directory"),
    ("/build/cargo_arguments", [], "empty:build.cargo_arguments"),
    ("/compiler", None, "missing:compiler"),
    ("/compiler/rustc", "bin/rustc", "path:compiler.rustc"),
    ("/compiler/sysroot", "/opt/./rust", "path:compiler.sysroot"),
    ("/analysis", None, "missing:analysis"),
    ("/analysis/request_key", "5e" * 31, "request_key_format"),
    ("/analysis/token", "5" * 32, "token_format"),
    ("/analysis/artifact/target/kind", [], "empty:artifact.target.kinds"),
    ("/analysis/artifact/features", ["", "simd"], "empty:artifact.list_entry"),
    ("/analysis/artifact/target/src_path", "/home//w", "path:artifact.src_path"),
    ("/analysis/artifact/filenames", ["libloom.rlib"], "path:artifact.output"),
]


@pytest.fixture(scope="module")
def mutated(spark, tmp_path_factory):
    """One store that holds an accepted capture and one capture per change."""
    root = tmp_path_factory.mktemp("store")
    expected, n = {}, 0

    def add(head, body, rule, **kwargs):
        nonlocal n
        cid = store.capture_id(n)
        n += 1
        store.write(root, cid, head(cid), body(cid), **kwargs)
        expected[cid] = rule

    good_head, good_body = store.header, store.manifest
    add(good_head, good_body, None)
    for path, value, rule in [*RELATIONS, *DOMAINS]:
        add(good_head, lambda c, p=path, v=value: store.changed(store.manifest(c), p, v), rule)
    for path, value in spoiled(store.manifest("")):
        add(good_head, lambda c, p=path, v=value: store.changed(store.manifest(c), p, v), (path,))
    for path, value in spoiled(store.header("")):
        add(lambda c, p=path, v=value: store.changed(store.header(c), p, v), good_body, (path,))
    for path, value, rule in HEADER_CHANGES:
        add(lambda c, p=path, v=value: store.changed(store.header(c), p, v), good_body, rule)
    add(lambda c: "{not json", good_body, "malformed_json")
    add(good_head, lambda c: "[]", "malformed_json")
    add(good_head, lambda c: None, "missing_manifest")
    add(lambda c: None, good_body, "missing_header")
    add(lambda c: json.dumps(store.header(c)) + " " * (1 << 20), good_body, "record_too_large")
    add(good_head, good_body, "missing_file", files={5: store.FILES[5]})

    def twice(cid, change):
        body = store.manifest(cid)
        return change(body) or body

    def two_units(body):
        unit = dict(body["instances"][0]["placements"][0])
        body["instances"][0]["placements"].append(unit)

    def two_instances(body):
        body["instances"].append(body["instances"][0])

    def two_modules(body):
        body["llvm"]["collected"].append(dict(body["llvm"]["collected"][0], definitions=[]))

    add(good_head, lambda c: twice(c, two_units), "duplicate_codegen_unit")
    add(good_head, lambda c: twice(c, two_instances), "duplicate_instance")
    add(good_head, lambda c: twice(c, two_modules), "duplicate_module")
    add(good_head, lambda c: twice(c, two_modules), "duplicate_module_artifact")
    (root / "staging" / store.capture_id(4000)).mkdir(parents=True)
    ev = records.scan_evidence(spark, str(root))
    found: dict[str, set[str]] = {}
    rows = evidence_violations(ev).collect()
    for r in rows:
        found.setdefault(r.capture_id, set()).add(r.rule)
    return root, expected, found


def test_every_change_breaks_its_rule(mutated):
    _, expected, found = mutated
    wrong = {
        cid: (rule, found.get(cid))
        for cid, rule in expected.items()
        if isinstance(rule, str) and rule not in found.get(cid, ())
    }
    assert not wrong


def test_every_spoiled_field_is_a_fault(mutated):
    """Of any field, unless it is one that may hold anything."""
    _, expected, found = mutated
    spoiled_ = {cid: rule[0] for cid, rule in expected.items() if isinstance(rule, tuple)}
    assert len(spoiled_) > 50
    assert {path for cid, path in spoiled_.items() if cid not in found and not FREE.search(path)} == set()


def test_the_unchanged_capture_is_accepted(spark, mutated):
    root, expected, found = mutated
    good = store.capture_id(0)
    assert good not in found
    ev = records.scan_evidence(spark, str(root))
    captures = records.captures_of(ev.headers, ev.manifests)
    accepted = accepted_captures(captures, evidence_violations(ev)).collect()
    assert good in {r.capture_id for r in accepted}
    assert not {r.capture_id for r in accepted} & set(found)
    assert accepted[0].analysis.artifact.target.required_features == ["threads"]


def test_another_version_reports_only_the_version(mutated):
    _, expected, found = mutated
    bad = [cid for cid, rule in expected.items() if rule == "unsupported_version"]
    bad += [cid for cid, rule in expected.items() if rule == ("/format_version",)]
    assert len(bad) == 4
    assert all(found[cid] == {"unsupported_version"} for cid in bad)


def test_absent_store_is_empty(spark, tmp_path):
    ev = records.scan_evidence(spark, str(tmp_path / "nothing"))
    assert records.scan_captures(spark, str(tmp_path / "nothing")).count() == 0
    assert evidence_violations(ev).count() == 0
    assert records.scan_candidates(spark, str(tmp_path / "nothing")).count() == 0


def test_candidates(spark, tmp_path):
    good, other = store.capture_id(1), store.capture_id(2)
    keys = {name: f"{i:064x}" for i, name in enumerate(("hit", "gone", "key", "token", "version", "text", "none", "extra"))}
    for cid, key in ((good, keys["hit"]), (other, keys["token"])):
        head = store.changed(store.header(cid), "/analysis/request_key", key)
        store.write(tmp_path, cid, head, store.manifest(cid))
    put = store.write_pointer
    put(tmp_path, keys["hit"], store.pointer(good, keys["hit"]))
    put(tmp_path, keys["gone"], store.pointer(store.capture_id(7), keys["gone"]))
    put(tmp_path, keys["key"], store.pointer(good, keys["hit"]))
    put(tmp_path, keys["token"], store.pointer(other, keys["token"], "f" * 12 + "4" + "f" * 3 + "8" + "f" * 15))
    put(tmp_path, keys["version"], store.pointer(good, keys["version"], version=2))
    put(tmp_path, keys["text"], "{")
    put(tmp_path, keys["extra"], store.pointer(good, keys["extra"]) | {"more": 1})
    requests = spark.createDataFrame(list(keys.items()), "name string, request_key string")
    found = candidate_lookup(
        requests,
        records.scan_candidates(spark, str(tmp_path)),
        records.scan_captures(spark, str(tmp_path)),
    )
    got = {r.name: (r.lookup, r.candidate and r.candidate.capture_id) for r in found.collect()}
    assert got == {
        "hit": ("hit", good),
        "gone": ("dangling_miss", None),
        "key": ("invalid", None),
        "token": ("invalid", None),
        "version": ("invalid", None),
        "text": ("invalid", None),
        "extra": ("invalid", None),
        "none": ("miss", None),
    }


def test_damaged_evidence_is_no_miss(spark, tmp_path):
    names = ("sound", "header", "manifest", "length", "lost")
    ids = {name: store.capture_id(20 + i) for i, name in enumerate(names)}
    keys = {name: f"{50 + i:064x}" for i, name in enumerate(names)}
    for name, cid in ids.items():
        head = store.changed(store.header(cid), "/analysis/request_key", keys[name])
        files = {k: v + b"!" if name == "length" else v for k, v in store.FILES.items() if name != "lost"}
        store.write(tmp_path, cid, head, store.manifest(cid), files)
        store.write_pointer(tmp_path, keys[name], store.pointer(cid, keys[name]))
    for name, file in (("header", "capture.json"), ("manifest", "instances.json")):
        (tmp_path / "captures" / ids[name] / file).write_text("{not json")
    requests = spark.createDataFrame(list(keys.items()), "name string, request_key string")
    evidence = records.scan_evidence(spark, str(tmp_path))
    found = candidate_lookup(
        requests,
        records.scan_candidates(spark, str(tmp_path)),
        records.captures_of(evidence.headers, evidence.manifests),
        violations=evidence_violations(evidence),
    )
    assert {r.name: r.lookup for r in found.collect()} == {n: "hit" if n == "sound" else "invalid" for n in names}


def test_pointer_fields(spark, tmp_path):
    key, cid = f"{9:064x}", store.capture_id(9)
    sound = store.pointer(cid, key)
    cases = {"": None, "format:token": {"token": "NOT A TOKEN"}, "format:capture_id": {"capture_id": "nonsense"},
             "format:request_key": {"request_key": key.upper() + "A"}, "missing_field:token": {"token": None},
             "missing_field:capture_id": {"capture_id": 7}, "missing_field:request_key": {"request_key": ["x"]}}
    docs = [(f"x/candidates/{key}.json", json.dumps(sound | (c or {})), False) for c in cases.values()]
    docs.append((f"x/candidates/{key}.json", json.dumps({k: v for k, v in sound.items() if k not in ("token", "capture_id")}), False))
    frame = spark.createDataFrame(docs, "path string, raw string, too_large boolean")
    got = sorted(r.rule or "" for r in records.parse_candidates(frame).collect())
    assert got == sorted([*cases, "missing_field:token"])


def test_a_final_newline_is_part_of_no_identifier(spark, tmp_path):
    cid = store.capture_id(3)
    for place, rule in (("/analysis/request_key", "request_key_format"), ("/analysis/token", "token_format"), ("/id", "capture_id_format")):
        root = tmp_path / rule
        head = store.header(cid)
        value = {"/analysis/request_key": store.KEY, "/analysis/token": store.TOKEN, "/id": cid}[place]
        store.write(root, cid, store.changed(head, place, value + "\n"), store.manifest(cid))
        found = {r.rule for r in evidence_violations(records.scan_evidence(spark, str(root))).collect()}
        assert rule in found, place
    key = f"{9:064x}"
    for name in ("token", "capture_id"):
        pointer = store.pointer(cid, key)
        raw = json.dumps(pointer | {name: pointer[name] + "\n"})
        frame = spark.createDataFrame([(f"x/candidates/{key}.json", raw, False)], "path string, raw string, too_large boolean")
        assert [r.rule for r in records.parse_candidates(frame).collect()] == [f"format:{name}"]


def test_an_artifact_over_four_gib(spark, tmp_path):
    """A sparse file longer than any cell is published, and read across 4 GiB and at its end."""
    cid, size = store.capture_id(4), (1 << 32) + 17
    body = store.changed(store.manifest(cid), "/artifacts/0/byte_len", size)
    store.write(tmp_path / "store", cid, store.header(cid), body)
    with open(tmp_path / "store" / "captures" / cid / f"artifact-{5:016x}", "r+b") as file:
        file.truncate(size)
        file.seek((1 << 32) - 2)
        file.write(b"abcdefghijklmnopqrs")
    lake = Lake(spark, str(tmp_path / "lake"))
    assert publish(spark, str(tmp_path / "store"), lake, 1).count() == 0
    chunks, artifacts = lake.table("artifact_chunks"), lake.table("artifacts")
    sizes = chunks.groupBy("artifact_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("bytes")).alias("size"))
    assert {r.artifact_id: (r.n, r.size) for r in sizes.collect()} == {5: (4097, size), 9: (1, 33)}
    asked = [(1, cid, 5, (1 << 32) - 2, 5), (2, cid, 5, size - 4, 4), (3, cid, 5, size - 3, 4), (4, cid, 5, 0, 3)]
    requests = spark.createDataFrame(asked, "range_id long, capture_id string, artifact_id long, start long, length long")
    found = read_ranges(requests, "range_id", artifacts, chunks, ["capture_id", "artifact_id"])
    assert {r.range_id: (r.status, r.content and bytes(r.content)) for r in found.collect()} == {
        1: ("ok", b"abcde"), 2: ("ok", b"pqrs"), 3: ("past_end", None), 4: ("ok", b"fn ")}


def test_chunks_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "RUN", 3)
    monkeypatch.setattr(files, "TASK_BYTES", 100)
    sizes = [0, 1, 6, 7, 8, 300]
    content = {i: bytes((i + j) % 251 for j in range(n)) for i, n in enumerate(sizes)}
    for i, data in content.items():
        (tmp_path / f"a file {i}").write_bytes(data)
    rows = [(i, f"{'file:' * (i % 2)}{tmp_path}/a file {i}", len(d), "clash") for i, d in content.items()]
    frame = spark.createDataFrame(rows, "id int, path string, length long, chunk_no string")
    got = files.read_file_chunks(frame.drop("chunk_no"), ["id"], 7).orderBy("id", "chunk_no").collect()
    for i, data in content.items():
        mine = [r for r in got if r.id == i]
        assert [r.chunk_no for r in mine] == list(range(-(-len(data) // 7)))
        assert b"".join(bytes(r.bytes) for r in mine) == data
    assert files.read_file_chunks(frame.drop("chunk_no").limit(0), ["id"], 7).count() == 0
    with pytest.raises(Exception, match="has changed"):
        files.read_file_chunks(frame.withColumn("length", F.col("length") + 1).drop("chunk_no"), ["id"], 7).count()


def test_committed_batches_never_change(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    rows = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "capture_id string, completed_at_unix_ms long")
    lake.write({"captures": rows("a", "b")}, 4)
    with pytest.raises(CommittedBatch):
        lake.write({"captures": rows("c")}, 4)
    # An attempt that failed before its commit stays unseen, and the number stays free.
    rows("d").write.parquet(str(tmp_path / "lake/captures/publish_seq=5/attempt=broken"))
    assert sorted(r.capture_id for r in lake.table("captures").collect()) == ["a", "b"]
    lake.write({"captures": rows("e")}, 5)
    assert sorted(r.capture_id for r in lake.table("captures").collect()) == ["a", "b", "e"]
    assert lake.table("captures").columns == ["publish_seq", "capture_id", "completed_at_unix_ms"]


def test_publish_show_and_replay(spark, tmp_path):
    first, second, broken = (store.capture_id(i) for i in (1, 2, 3))
    source = tmp_path / "store"
    store.write(source, first, store.header(first), store.manifest(first), {**store.FILES, 77: b"undeclared"})
    store.write(source, broken, store.changed(store.header(broken), "/build/package", ""), store.manifest(broken))
    lake = Lake(spark, str(tmp_path / "lake"))
    assert lake.table("captures") is None
    rules = {(r.capture_id, r.rule) for r in publish(spark, str(source), lake, 1, chunk=8).collect()}
    assert rules == {(broken, "empty:build.package")}
    assert [r.capture_id for r in lake.table("captures").collect()] == [first]
    # Only declared files are stored, in chunks.
    chunks = lake.table("artifact_chunks")
    assert {r.artifact_id for r in chunks.collect()} == {5, 9}

    # The same store again, with one more capture: the known id is refused, the new one published.
    store.write(source, second, store.header(second, completed_at_unix_ms=5), store.manifest(second))
    rules = {(r.capture_id, r.rule) for r in publish(spark, str(source), lake, 2, chunk=8).collect()}
    assert (first, "already_published") in rules
    assert (second, "already_published") not in rules
    before = lake.table("captures").count()
    publish(spark, str(source), lake, 2, chunk=8)
    assert lake.table("captures").count() == before == 2
    # The last published pointer wins, although its completion time is older.
    assert [r.capture_id for r in lake.candidates().collect()] == [second]

    # A batch without its commit row is invisible.
    lake.table("captures").drop("publish_seq").write.parquet(str(tmp_path / "lake/captures/publish_seq=9/attempt=broken"))
    assert lake.table("captures").count() == 2

    # Reference -> stored range -> bytes.
    asked = spark.createDataFrame([(f"{first}:0",), (f"{first}:1",), ("nonsense",)], "reference string")
    resolved = resolve_references(asked, "reference", lake.table("instances"))
    status = {r.reference: (r.status, r.instance_count) for r in resolved.collect()}
    assert status == {
        f"{first}:0": ("found", 1),
        f"{first}:1": ("invalid_ordinal", 1),
        "nonsense": ("malformed", None),
    }
    spans = source_evidence(resolved)
    read = read_ranges(
        spans, "reference", lake.table("artifacts"), chunks, ["capture_id", "artifact_id"], 8
    ).collect()
    assert [(bytes(r.content), r.starting_line) for r in read] == [(store.FILES[5][6:17], 4)]


def test_point_lookups(spark, tmp_path):
    good, bad = store.capture_id(1), store.capture_id(2)
    store.write(tmp_path, good, store.header(good), store.manifest(good))
    store.write(tmp_path, bad, "{", store.manifest(bad))
    ev = records.scan_evidence(spark, str(tmp_path))
    asked = spark.createDataFrame([(c,) for c in (good, bad, store.capture_id(3))], "capture_id string")
    captures = records.captures_of(ev.headers, ev.manifests)
    read = records.read_captures(asked, captures, evidence_violations(ev))
    assert {r.capture_id: r.status for r in read.collect()} == {
        good: "found",
        bad: "corrupt",
        store.capture_id(3): "missing",
    }


def test_build_messages(spark, tmp_path):
    lines = [
        json.dumps({"reason": "compiler-artifact", "package_id": "p", "target": {"name": "t", "kind": ["lib"]}, "fresh": False}),
        json.dumps({"reason": "compiler-message", "message": {"level": "warning", "message": "unused", "rendered": "warning: unused\n"}}),
        "plain text",
        "",
        json.dumps({"reason": "build-finished", "success": True}),
    ]
    (tmp_path / "one.json").write_text("\n".join(lines) + "\n")
    got = records.scan_build_messages(spark, str(tmp_path / "*.json"))
    rows = {(r.build_id, r.reason, r.level, r.rendered) for r in got.collect()}
    assert rows == {
        ("one", "compiler-artifact", None, None),
        ("one", "compiler-message", "warning", "warning: unused\n"),
        ("one", "text", None, "plain text"),
        ("one", "build-finished", None, None),
    }
    assert got.filter(F.col("reason") == "build-finished").first().success is True
