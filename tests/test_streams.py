import datetime

from pyspark.sql import functions as F

from evlake.operators import observe
from evlake.sources.lake import SEQ, Lake
from evlake.streaming.completion import completion_stream, latest_rows, run_to_log
from evlake.streaming.publish import publish_stream
from evlake.streaming.timed import PROVIDER_KEY, timed_completion, timed_state

CAPTURE = "capture_id string, completed_at_unix_ms long, analysis struct<request_key:string,token:string>"


def test_repeated_ids_have_one_effect(spark, tmp_path):
    source, lake = str(tmp_path / "in"), Lake(spark, str(tmp_path / "lake"))

    def add(rows):
        spark.createDataFrame(rows, CAPTURE).coalesce(1).write.mode("append").parquet(source)

    def run():
        publish_stream(spark.readStream.schema(CAPTURE).parquet(source), lake, str(tmp_path / "ck"))

    add([("a", 9, ("k", "t1")), ("a", 9, ("k", "t1")), ("b", 1, ("l", "t2"))])
    run()
    add([("a", 5, ("k", "t9")), ("c", 1, ("k", "t3"))])
    run()
    run()
    got = lake.table("captures").select("capture_id", "analysis.token").collect()
    assert sorted(map(tuple, got)) == [("a", "t1"), ("b", "t2"), ("c", "t3")]
    assert {r.request_key: r.capture_id for r in lake.candidates().collect()} == {"k": "c", "l": "b"}


def test_only_batches_that_may_hold_an_id_are_opened(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    frame = lambda ids: spark.createDataFrame([(i, 1, ("k", "t")) for i in ids], CAPTURE)
    for seq in range(6):
        lake.write({"captures": frame(f"{seq}-{i}" for i in range(300 * (seq % 3) + 1))}, seq)
    opened = lambda ids: {r[0] for r in lake.batches_with(frame(ids)).select(SEQ).distinct().collect()}
    for seq in range(6):
        assert seq in opened([f"{seq}-0"]) and len(opened([f"{seq}-0"])) <= 2
    plan = lake.batches_with(frame(["3-0"]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "publish_seq" in plan.split("PartitionFilters")[1][:200]
    strangers = [f"x{i}" for i in range(40)]
    assert sum(len(opened([s])) for s in strangers[:8]) <= 4
    assert {0, 5} <= opened(["0-0", "5-600", *strangers])
    held = lake.batches_with(frame(["2-599", "4-300", "x"])).select("capture_id").collect()
    assert {"2-599", "4-300"} <= {r.capture_id for r in held}


def test_completion_keeps_the_newest_row(spark, tmp_path):
    schema = "build_id string, kind string, ok boolean"
    source, log, ck = (str(tmp_path / n) for n in ("in", "log", "ck"))

    def outcome(df):
        return observe.build_completion(df, ["build_id"], F.col("kind") == "artifact", F.col("kind") == "finished", F.col("ok"), F.col("kind") == "error", F.lit(True))

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        run_to_log(outcome(spark.readStream.schema(schema).parquet(source)), log, ck)
        return {r.build_id: r.outcome for r in latest_rows(spark, log, ["build_id"]).collect()}

    assert feed([("x", "artifact", None), ("y", "artifact", None), ("y", "finished", True)]) == {"x": "not_finished_once", "y": "completed"}
    assert feed([("x", "finished", True), ("z", "error", None)]) == {"x": "completed", "y": "completed", "z": "not_finished_once"}
    assert feed([("y", "finished", True)])["y"] == "not_finished_once"


def test_completion_without_input(spark, tmp_path):
    empty = tmp_path / "in"
    empty.mkdir()
    stream = spark.readStream.schema("build_id string, n int").parquet(str(empty))
    got = completion_stream(stream, ["build_id"], lambda df: df.groupBy("build_id").agg(F.sum("n").alias("n")))
    assert got.columns == ["build_id", "n"] and got.count() == 0


def test_state_of_builds_ends(spark, tmp_path):
    """Spans close behind their finished message or a silence; state falls, late messages stand alone."""
    schema = "b string, at timestamp, kind string, ok boolean"
    source, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    start = datetime.datetime(2024, 1, 1)
    before = spark.conf.get(PROVIDER_KEY, None)

    def feed(*rows):
        moved = [(b, start + datetime.timedelta(minutes=m), kind, ok) for b, m, kind, ok in rows]
        spark.createDataFrame(moved, schema).coalesce(1).write.mode("append").parquet(source)
        kind = F.col("kind")
        spans = timed_completion(
            spark.readStream.schema(schema).parquet(source), F.col("b"), F.col("at"), kind == "artifact",
            kind == "finished", F.col("ok"), kind == "error", F.lit(True), grace="10 minutes", idle="1 hour", late="1 minute",
        )
        found = []

        def keep(rows, batch):
            found.extend((r.build, (r.opened - start).total_seconds() // 60, r.messages, r.outcome, r.closed) for r in rows.collect())

        query = (spans.writeStream.outputMode("update").option("checkpointLocation", ck).foreachBatch(keep)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        return sorted(found), query.lastProgress["stateOperators"][0]["numRowsTotal"]

    timed_state(spark)
    try:
        rows, _ = feed(("x", 0, "artifact", None), ("x", 1, "finished", True), ("y", 2, "artifact", None), (None, 2, "error", None))
        assert rows == [("x", 0, 2, "completed", False), ("y", 2, 1, "not_finished_once", False)]
        # Within the grace an error still counts; a second finished message does not renew the time.
        rows, _ = feed(("x", 5, "finished", True), ("y", 8, "finished", True))
        assert rows == [("x", 0, 3, "not_finished_once", False), ("y", 2, 2, "completed", False)]
        rows, held = feed(("z", 40, "artifact", None))
        assert ("x", 0, 3, "not_finished_once", True) in rows and ("y", 2, 2, "completed", True) in rows and held == 1
        # A message after its span has closed opens another.
        rows, held = feed(("x", 41, "error", None))
        assert rows == [("x", 41, 1, "not_finished_once", False)] and held == 2
        # Two spans in one batch: the silence between them is too long.
        rows, held = feed(("w", 200, "artifact", None), ("w", 300, "finished", True))
        assert [r for r in rows if r[0] == "w"] == [("w", 200, 1, "not_finished_once", True), ("w", 300, 1, "not_one_artifact", False)]
        assert {r[:2] for r in rows if r[4]} == {("x", 41), ("z", 40), ("w", 200)} and held == 1
    finally:
        spark.conf.unset(PROVIDER_KEY) if before is None else spark.conf.set(PROVIDER_KEY, before)


def test_spans_of_many_messages():
    """Whole spans at a time give the spans of a walk from message to message, batch by batch."""
    import random

    import pandas as pd

    from evlake.streaming.timed import COUNTS, Builds

    class State:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held
        deleteTimer = registerTimer = lambda self, at: None

        def update(self, value):
            self.held = value

    def walk(span, messages, grace, idle):
        rows = []
        for at, counts in messages:
            if span and at > span[2]:
                rows.append((*span, True))
                span = None
            span = span or [at, at, at + idle, *[0] * len(COUNTS)]
            done = span[5] > 0
            span[1] = max(span[1], at)
            span[3:] = [a + b for a, b in zip(span[3:], counts)]
            if not done:
                span[2] = at + grace if counts[2] else max(span[2], at + idle)
        return span, [*rows, (*span, False)]

    rng = random.Random(5)
    for grace, idle in ((3, 9), (30, 9), (0, 0), (200, 40)):
        builds = Builds(grace, idle)
        builds.state = builds.handle = State()
        span, start = None, 0
        for size in (1, 40, 3, 200, 1, 90):
            at = sorted(start + rng.choice([0, 1, 2, 5, 12, 45]) * rng.randint(0, size) for _ in range(size))
            # Some come behind those of the next batch.
            start = max(0, at[-1] - rng.choice([0, 20]))
            messages = [(t, [1, *[int(rng.random() < 0.2) for _ in COUNTS[1:]]]) for t in at]
            span, want = walk(span, messages, grace, idle)
            table = pd.DataFrame([(t, *c) for t, c in messages], columns=["at", *COUNTS])
            got = next(builds.handleInputRows(("b",), iter([table[: size // 2], table[size // 2 :]]), None))
            assert [tuple(r[1:]) for r in got.itertuples(index=False)] == want
            assert builds.state.held == tuple(span)
