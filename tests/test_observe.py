import itertools

from pyspark.sql import functions as F

from evlake.operators import assemble, observe

MESSAGES = "build_id string, seq long, reason string, package_id string, target struct<kind:array<string>,name:string>, fresh boolean, success boolean, level string, rendered string"


def message(build, seq, reason, **kw):
    target = (kw.get("kind", ["lib"]), kw.get("name", "t")) if reason == "compiler-artifact" else None
    return (build, seq, reason, kw.get("package", "p"), target, kw.get("fresh", False), kw.get("success"), kw.get("level"), kw.get("rendered"))


def test_completion_truth_table(spark):
    table = {  # build: (artifacts, finished, errors, outcome)
        "one": (1, [True], False, "completed"),
        "none": (0, [True], False, "not_one_artifact"),
        "two": (2, [True], False, "not_one_artifact"),
        "open": (1, [], False, "not_finished_once"),
        "failed": (1, [False], False, "not_finished_once"),
        "twice": (1, [True, True], False, "not_finished_once"),
        "errors": (1, [True], True, "has_errors"),
    }
    rows = []
    for build, (artifacts, finished, errors, _) in table.items():
        rows += [message(build, i, "compiler-artifact") for i in range(artifacts)]
        rows += [message(build, 10, "build-finished", success=s) for s in finished]
        rows += [message(build, 20, "compiler-message", level=x) for x in ("warning", "note")]
        rows += [message(build, 30, "compiler-message", level="error")] * errors
        # Other packages, names and kinds are not selected.
        rows += [message(build, 40, "compiler-artifact", package="q"), message(build, 41, "compiler-artifact", name="u"), message(build, 42, "compiler-artifact", kind=["bin"])]
    rows += [message("stale", 0, "compiler-artifact", fresh=True), message("stale", 1, "build-finished", success=True)]
    df = spark.createDataFrame(rows, MESSAGES)
    # Each build has its own expectation; one build has no message, one is not asked about.
    wanted = [(b, "p", "t", ["lib"], False) for b in table if b != "twice"]
    wanted += [("stale", "p", "t", ["lib"], True), ("silent", "p", "t", ["lib"], False)]
    expected = spark.createDataFrame(wanted, "build_id string, package_id string, target_name string, kinds array<string>, fresh boolean")
    got = {r.build_id: r.outcome for r in observe.message_completion(df, expected).collect()}
    assert got == {b: v[3] for b, v in table.items() if b != "twice"} | {"stale": "completed", "silent": "not_finished_once"}
    mismatch = expected.filter("build_id = 'stale'").withColumn("fresh", F.lit(False))
    assert [r.outcome for r in observe.message_completion(df, mismatch).collect()] == ["unexpected_artifact"]


def test_probe_table(spark):
    flags = list(itertools.product([False, True], [False, True], [0, 1], [False, True], [False, True], [False, True]))
    df = spark.createDataFrame(flags, "receipt boolean, ok boolean, selected int, completed boolean, same boolean, manifest boolean")
    c = F.col
    out = df.withColumn("o", observe.probe_outcome(c("receipt"), c("ok"), c("selected"), c("completed"), c("same"), c("manifest")))
    for r in out.collect():
        if not r.manifest and not r.ok and r.receipt and r.selected == 0:
            assert r.o == "stale"
        elif not r.manifest and r.ok and not r.receipt and r.completed and r.same:
            assert r.o == "fresh"
        else:
            assert r.o == "error"


def test_reuse_decision(spark):
    rows = [(True, "hit", "fresh", "collect"), (False, "miss", None, "collect"), (False, "dangling_miss", None, "collect"),
            (False, "invalid", "fresh", "error"), (False, "hit", "fresh", "reuse"), (False, "hit", "stale", "collect"), (False, "hit", "error", "error")]
    df = spark.createDataFrame(rows, "policy boolean, lookup string, probe string, want string")
    got = df.withColumn("got", observe.reuse_decision(F.col("policy"), F.col("lookup"), F.col("probe")))
    assert got.filter("got <> want or got is null").count() == 0


def test_diagnostics(spark):
    rows = [message(b, i, r, level=lv, rendered=t) for b in ("stale", "completed") for i, (r, lv, t) in enumerate(
        [("compiler-message", "note", "n"), ("compiler-message", "warning", "w1"), ("text", None, "t"), ("compiler-message", "warning", "w2"), ("build-finished", None, None)])]
    outcomes = spark.createDataFrame([("stale", "stale"), ("completed", "completed")], "build_id string, outcome string")
    shown = observe.diagnostic_split(spark.createDataFrame(rows, MESSAGES), outcomes).collect()
    assert [(r.build_id, r.rendered) for r in shown] == [
        ("completed", "w1"), ("completed", "w2"), ("completed", "n"), ("completed", "t"), ("stale", "w1"), ("stale", "w2"),
    ]


def test_groups_and_conflicts(spark):
    rows = [("a", 0, "s1"), ("a", 1, "s1"), ("b", 2, "s1"), ("b", 3, "s2"), ("c", 4, None), ("c", 5, None), ("d", 6, None), ("d", 7, "s1")]
    df = spark.createDataFrame(rows, "k string, seq long, source string")
    got = assemble.assemble_groups(df, ["k"], F.col("source")).collect()
    assert {r.k: (r.placements, r.conflict) for r in got} == {"a": (2, False), "b": (2, True), "c": (2, False), "d": (2, True)}
    numbered = assemble.number_placements(df.withColumn("seq", -F.col("seq")), ["k"], ["seq"]).collect()
    assert {(r.k, r.seq): r.placement_no for r in numbered}[("b", -3)] == 0


def test_artifact_ids_overflow(spark):
    modules = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "capture_id string, position long")
    artifacts = spark.createDataFrame([("a", 2**63 - 2)], "capture_id string, artifact_id long")
    got = assemble.next_artifact_ids(modules, ["capture_id"], "position", artifacts).collect()
    assert {(r.capture_id, r.position): (r.artifact_id, r.overflow) for r in got} == {
        ("a", 0): (2**63 - 1, False), ("a", 1): (None, True), ("b", 0): (0, False),
    }


def test_selectors(spark):
    catalog = spark.createDataFrame(
        [("p", 0, "p", ["custom-build"]), ("p", 1, "tool", ["bin"]), ("p", 2, "p", ["rlib", "cdylib"]), ("p", 3, "demo", ["example"]), ("p", 4, "speed", ["bench"]), ("p", 5, "again", ["lib"])],
        "package string, position long, name string, kinds array<string>",
    )
    asked = {1: ("p", "lib", None), 2: ("p", "bin", "tool"), 3: ("p", "bin", "demo"), 4: ("p", "example", "demo"), 5: ("q", "lib", None), 6: ("p", "bench", "speed")}
    selectors = spark.createDataFrame([(k, *v) for k, v in asked.items()], "id long, package string, kind string, name string")
    got = {r.id: (r.status, r.position) for r in assemble.resolve_selector(selectors, "id", catalog).collect()}
    assert got == {1: ("found", 2), 2: ("found", 1), 3: ("target_not_found", None), 4: ("found", 3), 5: ("package_not_found", None), 6: ("found", 4)}
