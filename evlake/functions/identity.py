"""Content keys, encoded identifiers and instance references as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stored identifier formats.
# (`\z` is the very end; `$` would also match before a final newline.)
CAPTURE_ID = r"^[k-z]{32}\z"
REQUEST_KEY = r"^[0-9a-f]{64}\z"
TOKEN = r"^[0-9a-f]{12}4[0-9a-f]{3}[89ab][0-9a-f]{15}\z"
HEX_DIGITS = "0123456789ABCDEF"
REVERSE_DIGITS = "zyxwvutsrqponmlk"
U64_MAX = 18446744073709551615
I64_MAX = 9223372036854775807


def _le64(n: Column) -> Column:
    padded = F.lpad(F.hex(n), 16, "0")
    bytes_high_first = [F.substring(padded, i, 2) for i in range(1, 17, 2)]
    return F.unhex(F.concat(*reversed(bytes_high_first)))


def request_key(*fields: Column) -> Column:
    """SHA-256 over the fields, each behind its byte length as a little-endian 64-bit number."""
    parts: list[Column] = []
    for field in fields:
        data = field.cast("binary")
        parts += [_le64(F.octet_length(data).cast("bigint")), data]
    return F.sha2(F.concat(*parts), 256)


def reverse_hex(data: Column) -> Column:
    return F.translate(F.hex(data), HEX_DIGITS, REVERSE_DIGITS)


def artifact_file_name(artifact_id: Column) -> Column:
    return F.format_string("artifact-%016x", artifact_id)


def instance_ref(capture_id: Column, ordinal: Column) -> Column:
    return F.concat_ws(":", capture_id, ordinal.cast("string"))


def parse_instance_ref(reference: Column, id_pattern: str = "[k-z]{32}") -> Column:
    """``struct(capture_id, ordinal)`` of a well-formed reference, else NULL.

    The ordinal keeps the full unsigned 64-bit range.
    """
    pattern = rf"^({id_pattern}):(0|[1-9][0-9]*)\z"
    well_formed = reference.rlike(pattern)
    ordinal = F.regexp_extract(reference, pattern, 2)
    # 21 digits cannot fit; shorter ones cast without overflow.
    number = F.when(F.length(ordinal) <= 20, ordinal).try_cast("decimal(20,0)")
    return F.when(
        well_formed & (number <= F.lit(str(U64_MAX)).cast("decimal(20,0)")),
        F.struct(F.regexp_extract(reference, pattern, 1).alias("capture_id"), number.alias("ordinal")),
    )


def range_end(start: Column, length: Column) -> Column:
    return start + length
