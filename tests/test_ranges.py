import pytest
from pyspark.sql import functions as F

from evlake.operators import ranges

TEXT = "é first\nsecond 😀\n\nlast line without end"
DATA = TEXT.encode()


@pytest.fixture(scope="module")
def artifacts(spark):
    return spark.createDataFrame(
        [("c", 1, len(DATA)), ("c", 2, 0), ("c", 3, 2**33)],
        "capture_id string, artifact_id long, byte_len long",
    )


@pytest.mark.parametrize("chunk", [1, 3, 7, 4096])
def test_ranges_do_not_depend_on_the_chunk_size(spark, artifacts, chunk):
    content = spark.createDataFrame([("c", 1, bytearray(DATA)), ("c", 2, bytearray(b""))], "capture_id string, artifact_id long, content binary")
    chunks = ranges.chunk_bytes(content, ["capture_id", "artifact_id"], F.col("content"), chunk)
    asked = [(a, s, n) for a in (1, 2) for s in (0, 1, 5, len(DATA) - 1, len(DATA)) for n in (0, 1, 9, len(DATA))] + [(9, 0, 0)]
    requests = spark.createDataFrame(
        [(i, "c", *r) for i, r in enumerate(asked)],
        "id long, capture_id string, artifact_id long, start long, length long",
    )
    got = ranges.read_ranges(requests, "id", artifacts, chunks, ["capture_id", "artifact_id"], chunk)
    for r in got.collect():
        held = {1: DATA, 2: b""}.get(r.artifact_id)
        if held is None:
            assert r.status == "unknown_artifact" and r.content is None
        elif r.start + r.length > len(held):
            assert r.status == "past_end" and r.content is None
        else:
            assert r.status == "ok" and bytes(r.content) == held[r.start : r.start + r.length]
    offsets = requests.filter("artifact_id = 1 and start <= %d" % len(DATA))
    for r in ranges.starting_lines(offsets, chunks, ["capture_id", "artifact_id"], chunk).collect():
        assert r.starting_line == DATA[: r.start].count(b"\n") + 1
    pieces = ranges.artifact_lines(chunks, ["capture_id", "artifact_id"], block=4).orderBy("byte_start").collect()
    lines: dict[int, list] = {}
    for r in pieces:
        assert r.byte_start // chunk == (r.byte_start + len(r.line) - 1) // chunk
        lines.setdefault(r.line_no, []).append(r)
    assert [b"".join(r.line for r in ps) for ps in lines.values()] == DATA.splitlines(keepends=True)
    assert [ps[0].byte_start for ps in lines.values()] == [0, 9, 21, 22]
    assert all(r.cut for ps in lines.values() if len(ps) > 1 for r in ps)


def test_offsets_above_four_gib(spark, artifacts):
    chunk = 1 << 20
    number = 2**32 // chunk
    chunks = spark.createDataFrame(
        [("c", 3, number, bytearray(b"x" * 17 + b"needle" + b"y" * (chunk - 23)))],
        "capture_id string, artifact_id long, chunk_no long, bytes binary",
    )
    asked = spark.createDataFrame(
        [(1, "c", 3, 2**32 + 17, 6), (2, "c", 3, 2**33, 1), (3, "c", 3, 2**63 - 1, 2**63 - 1)],
        "id long, capture_id string, artifact_id long, start long, length long",
    )
    got = ranges.read_ranges(asked, "id", artifacts, chunks, ["capture_id", "artifact_id"], chunk)
    assert {r.id: (r.status, r.content and bytes(r.content)) for r in got.collect()} == {
        1: ("ok", b"needle"),
        2: ("past_end", None),
        3: ("past_end", None),
    }


def test_text_lines(spark):
    df = spark.createDataFrame([(1, TEXT), (2, ""), (3, "\n")], "id long, text string")
    got = ranges.text_lines(df, ["id"], F.col("text")).orderBy("id", "line_no").collect()
    assert [(r.id, r.line_no, r.byte_start, r.byte_len) for r in got] == [
        (1, 1, 0, 8), (1, 2, 9, 11), (1, 3, 21, 0), (1, 4, 22, 21), (2, 1, 0, 0), (3, 1, 0, 0), (3, 2, 1, 0),
    ]


def test_passages(spark):
    texts = spark.createDataFrame([(1, TEXT), (2, "nothing"), (3, "x first\nsecond 😀 x first"), (4, "ü abab\nabab")], "id long, text string")
    passages = spark.createDataFrame([(1, "first\nsecond 😀"), (2, "th"), (3, "absent words here"), (4, "ab"), (5, "b\nab"), (6, "ba")], "pid long, p string")
    got = ranges.passage_spans(texts, "id", "text", passages, "pid", "p").collect()
    assert sorted((r.id, r.pid, r.byte_start, r.byte_length, r.starting_line) for r in got) == [
        (1, 1, 3, 17, 1), (1, 2, 34, 2, 4), (2, 2, 2, 2, 1), (3, 1, 2, 17, 1),
        (4, 4, 3, 2, 1), (4, 4, 5, 2, 1), (4, 4, 8, 2, 2), (4, 4, 10, 2, 2), (4, 5, 6, 4, 1), (4, 6, 4, 2, 1), (4, 6, 9, 2, 2),
    ]
    assert [r.excerpt for r in got if (r.id, r.pid) == (4, 5)] == ["ü abab\nabab"]


def test_overlapping_passages(spark):
    texts = spark.createDataFrame([(1, "x" * 30)], "id long, text string")
    passages = spark.createDataFrame([(1, "xxx")], "pid long, p string")
    got = ranges.passage_spans(texts, "id", "text", passages, "pid", "p", 2).orderBy("byte_start").collect()
    assert [r.byte_start for r in got] == list(range(28))
    assert {len(r.excerpt) for r in got} == {5, 6, 7}


@pytest.mark.parametrize("chunk", [1, 4, 4096])
def test_spans_at_piece_borders(spark, chunk):
    texts = spark.createDataFrame([(1, TEXT), (2, "")], "id long, text string")
    asked = [(1, s, e) for s in range(-1, 26) for e in (s, s + 3)] + [(2, 0, 0), (2, 0, 1), (3, 0, 1)]
    requests = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "n long, id long, start long, end long")
    got = ranges.source_spans(requests, texts, "id", "text", F.lit(True), F.lit(False), F.lit(True), chunk=chunk)
    for r in got.collect():
        data = {1: DATA, 2: b""}.get(r.id)
        whole = data is not None and 0 <= r.start <= r.end <= len(data) and all(
            o == len(data) or data[o] & 0xC0 != 0x80 for o in (r.start, r.end))
        if whole:
            assert (r.reason, r.byte_start, r.byte_length) == (None, r.start, r.end - r.start)
            assert r.starting_line == data[: r.start].count(b"\n") + 1
        else:
            assert r.reason == ("unloaded" if data is None else "unsupported_span")
            assert r.byte_start is None and r.starting_line is None


def test_long_lines_are_read_once(spark):
    """Pieces are counted in the pass that measures their lines."""
    from evlake.plans import QUERIES

    plan = QUERIES["long_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1
