"""The evidence lake: Parquet tables, published in batches that become visible in one step."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evlake.operators.assemble import current_candidates
from evlake.operators.integrity import accepted_captures, evidence_violations, published_rules
from evlake.operators.ranges import CHUNK_BYTES
from evlake.session import cut_lineage
from evlake.sources.records import Evidence, captures_of, read_artifact_chunks, scan_evidence

TABLES = (
    "instances",
    "placements",
    "artifacts",
    "artifact_chunks",
    "modules",
    "definitions",
    "provenance",
    "candidates",
    "captures",
)
COMMITS = "commits"
_ORDER = ("capture_id", "compiler_module", "ordinal", "placement_no", "artifact_id", "chunk_no")
SEQ = "publish_seq"
# A batch's rows stand in a folder per attempt to write it; the commit names the one that counts.
ATTEMPT = "attempt"

# Filters over the ids of each batch, and the bits of one bucket (fixed by Spark's bitmaps).
FILTERS = "id_filters"
FILTER_BITS = 1 << 15
# Rows of a row group of chunks. A dictionary or compression could put very many of them into one,
# and readers take a row group up whole.
HEAVY_ROWS = {"parquet.enable.dictionary": "false", "parquet.block.row.count.limit": "32"}


class CommittedBatch(ValueError):
    """The batch number already holds committed rows, which never change."""


@dataclass(frozen=True)
class Lake:
    spark: SparkSession
    root: str

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _read(self, table: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self._path(table))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return None
            raise

    def table(self, name: str) -> DataFrame | None:
        """Rows of committed batches only; None when nothing was ever published."""
        rows, commits = self._read(name), self._read(COMMITS)
        if rows is None or commits is None:
            return None
        # The commit list has about one row per batch; Spark broadcasts it while it is small and
        # prunes the partitions of `rows` with it. Should two writers race, the first commit counts.
        first = commits.groupBy(SEQ).agg(F.min_by("written", F.struct("committed_at", "written")).alias(ATTEMPT))
        return rows.join(first, [SEQ, ATTEMPT], "left_semi").drop(ATTEMPT)

    def capture(self, name: str, capture_id: str) -> DataFrame | None:
        """One capture's rows: no query sees another capture.

        Files hold ranges of ids, so file and row-group statistics skip the rest of a batch.
        """
        rows = self.table(name)
        return None if rows is None else rows.filter(F.col("capture_id") == capture_id)

    def candidates(self) -> DataFrame | None:
        """Current pointer per request key: the last published, not the newest completion."""
        pointers = self.table("candidates")
        if pointers is None:
            return None
        order = F.struct(F.col(SEQ), F.col("completed_at_unix_ms"), F.col("capture_id"))
        return current_candidates(pointers, ["request_key"], order, ["token", "capture_id"])

    def write(self, tables: dict[str, DataFrame], seq: int) -> None:
        """Write one batch, the commit row last; refuse the number of a committed batch.

        Every attempt writes to folders of its own, so one that fails leaves rows that no reader
        sees, and nothing committed is ever touched.
        """
        if self.is_committed(seq):
            raise CommittedBatch(f"batch {seq} is committed")
        attempt = uuid.uuid4().hex
        if tables.get("captures") is not None:
            tables = tables | {FILTERS: id_filter(tables["captures"])}
        for name in (*TABLES, FILTERS):
            rows = tables.get(name)
            if rows is None:
                continue
            keys = [c for c in _ORDER if c in rows.columns]
            path = f"{self._path(name)}/{SEQ}={seq}/{ATTEMPT}={attempt}"
            if name == FILTERS:
                rows.coalesce(1).write.parquet(path)
            elif name == "artifact_chunks":
                # Chunks come in order and are too heavy to move.
                rows.write.options(**HEAVY_ROWS).parquet(path)
            else:
                # Ranges of ids per file let statistics skip files; a large capture spans many.
                rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)
        (
            self.spark.range(1)
            .select(F.lit(attempt).alias("written"), F.current_timestamp().alias("committed_at"))
            .coalesce(1)
            .write.mode("append")
            .parquet(f"{self._path(COMMITS)}/{SEQ}={seq}")
        )

    def batches_with(self, ids: DataFrame) -> DataFrame | None:
        """Rows of ``captures`` of those committed batches that may hold one of the ``capture_id``s.

        Each batch has a filter over its ids, in buckets of 4 KiB; an id meets one bucket per batch.
        A batch whose filter has none of the ids is not opened: batch numbers are partitions.
        """
        rows, filters = self.table("captures"), self.table(FILTERS)
        if rows is None or filters is None:
            return rows
        # Powers of two, so there are few.
        sizes = [r[0] for r in filters.select("buckets").distinct().collect()]
        probes = ids.select(F.explode(F.array(*[F.lit(n) for n in sizes] or [F.lit(1)])).alias("buckets"), "capture_id")
        probes = probes.select("buckets", *filter_places(F.col("capture_id"), F.col("buckets")))
        hits = filters.join(probes, ["buckets", "bucket"])
        for bit in ("bit1", "bit2"):
            byte = F.conv(F.hex(F.substring("bits", (F.col(bit) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            hits = hits.filter(F.call_function("getbit", byte, (F.col(bit) % 8).cast("int")) == 1)
        opened = [r[0] for r in hits.select(SEQ).distinct().collect()]
        # Batches written without a filter are always opened.
        plain = self._read(COMMITS).select(SEQ).distinct().join(filters.select(SEQ).distinct(), SEQ, "left_anti")
        opened += [r[0] for r in plain.collect()]
        return rows.filter(F.col(SEQ).isin(opened))

    def is_committed(self, seq: int) -> bool:
        commits = self._read(COMMITS)
        return commits is not None and not commits.filter(F.col(SEQ) == seq).isEmpty()


def filter_places(capture_id: Column, buckets: Column) -> list[Column]:
    """The bucket of an id and its two bits there."""
    first, second = F.xxhash64(capture_id), F.xxhash64(F.lit("second"), capture_id)
    return [
        F.pmod(F.shiftright(first, 15), buckets).alias("bucket"),
        F.pmod(first, F.lit(FILTER_BITS)).alias("bit1"),
        F.pmod(second, F.lit(FILTER_BITS)).alias("bit2"),
    ]


def id_filter(captures: DataFrame) -> DataFrame:
    """``buckets, bucket, bits``: a filter over the ids, with about 16 to 32 bits for each."""
    wanted = captures.count() * 16 // FILTER_BITS
    places = captures.select(*filter_places(F.col("capture_id"), F.lit(1 << wanted.bit_length())))
    bits = places.select("bucket", F.explode(F.array("bit1", "bit2")).alias("bit"))
    return bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).select(
        F.lit(1 << wanted.bit_length()).cast("bigint").alias("buckets"), "bucket", "bits"
    )


def _bigint(name: str):
    return F.col(name).try_cast("bigint").alias(name)


def lake_tables(ev: Evidence, captures: DataFrame, chunks: DataFrame | None) -> dict[str, DataFrame]:
    """Table form of the accepted captures."""
    ids = captures.select("capture_id")

    def of(df: DataFrame) -> DataFrame:
        return df.join(ids, "capture_id", "left_semi")

    source = F.col("source")
    tables = {
        "instances": of(ev.instances).select(
            "capture_id",
            "ordinal",
            "crate_name",
            "definition_path",
            "display_name",
            "raw_symbol",
            F.when(
                source.isNotNull(),
                F.struct(
                    source["artifact_id"].try_cast("bigint").alias("artifact_id"),
                    source["start"].try_cast("bigint").alias("start"),
                    source["length"].try_cast("bigint").alias("length"),
                    source["display_path"].alias("display_path"),
                    source["starting_line"].try_cast("bigint").alias("starting_line"),
                ),
            ).alias("source"),
            "source_reason",
        ),
        "placements": of(ev.placements).select(
            "capture_id",
            "ordinal",
            "placement_no",
            "codegen_unit",
            "linkage",
            "visibility",
            "local_copy",
            _bigint("size_estimate"),
        ),
        "artifacts": of(ev.artifacts).select(
            "capture_id", _bigint("artifact_id"), "kind", _bigint("byte_len")
        ),
        "modules": of(ev.modules).select(
            "capture_id", _bigint("artifact_id"), "compiler_module", "stage"
        ),
        "definitions": of(ev.definitions).select(
            "capture_id",
            "compiler_module",
            "raw_symbol",
            _bigint("start"),
            _bigint("length"),
            "kind",
            "target",
        ),
        "provenance": of(ev.provenance).select(
            "capture_id",
            "backend",
            "llvm_version",
            "target",
            "optimization",
            "lto",
            "incremental",
            "linker_plugin_lto",
            _bigint("codegen_units"),
            _bigint("recipe_revision"),
        ),
        "candidates": captures.select(
            F.col("analysis.request_key").alias("request_key"),
            F.col("analysis.token").alias("token"),
            "capture_id",
            "completed_at_unix_ms",
        ),
        "captures": captures,
    }
    if chunks is not None:
        tables["artifact_chunks"] = of(chunks)
    return tables


def publish(
    spark: SparkSession,
    store: str,
    lake: Lake,
    seq: int,
    with_files: bool = True,
    chunk: int = CHUNK_BYTES,
) -> DataFrame:
    """Publish every accepted capture of a record store as one batch; returns the violations.

    Ids the lake already holds are refused, so publishing the same store again adds nothing.
    """
    ev = scan_evidence(spark, store, with_files)
    incoming = captures_of(ev.headers, ev.manifests)
    violations = evidence_violations(ev)
    known = lake.batches_with(incoming)
    if known is not None:
        others = known.filter(F.col(SEQ) != seq)
        violations = violations.unionByName(published_rules(incoming, others))
    violations = cut_lineage(violations)
    if lake.is_committed(seq):
        return violations
    accepted = cut_lineage(accepted_captures(incoming, violations))
    chunks = None
    if with_files:
        declared = ev.artifacts.join(accepted.select("capture_id"), "capture_id", "left_semi")
        if not declared.isEmpty():
            chunks = read_artifact_chunks(spark, store, declared, chunk)
            chunks = chunks.withColumn("artifact_id", F.col("artifact_id").cast("bigint"))
    lake.write(lake_tables(ev, accepted, chunks), seq)
    return violations
