"""SRC6: audit of framed, CRC-protected state files (JOBC v2, MMUL v1, WCNT v1).

Works on a binary column (``binaryFile`` source or a table column).  The
first failing check wins, in this order: short, crc, magic, version,
recent_cap, recent_size, trailing, ok.  Little-endian fields are decoded by
reversing byte hex and converting base 16; u64 fields are decimal(20,0).
All built-in expressions: no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.functions.scalar import le_uint

# ---------------------------------------------------------------------------
# FIXED VALUES: file signatures, versions and size limits per kind.
# ---------------------------------------------------------------------------
JOBC_MAGIC = 0x4A4F4243
JOBC_VERSION = 2
JOBC_MIN_LEN = 41
JOBC_RECENT_CAP = 32
MMUL_MAGIC = 0x4D4D554C
MMUL_VERSION = 1
MMUL_MIN_LEN = 44
WCNT_MAGIC = 0x57434E54
WCNT_VERSION = 1
WCNT_MIN_LEN = 40
WCNT_DICT_SIZE = 64
# ---------------------------------------------------------------------------


def le_hex(value: Column, width: int) -> Column:
    """Little-endian hex text of an unsigned integer (for building frames)."""
    h = F.lpad(F.hex(value), 2 * width, "0")
    return F.concat(*[F.substring(h, 2 * (width - 1 - i) + 1, 2) for i in range(width)])


def _crc_ok(b: Column, n: Column) -> Column:
    body = F.substring(b, F.lit(1), n - 4)
    return F.crc32(body).cast("decimal(20,0)") == _le_at(b, n - 4, 4)


def _le_at(b: Column, offset: Column, width: int) -> Column:
    """le_uint with a column offset (0-based)."""
    parts = [F.hex(F.substring(b, offset + (width - i), F.lit(1))) for i in range(width)]
    return F.conv(F.concat(*parts), 16, 10).cast("decimal(20,0)")


def audit(blobs: DataFrame, content: str = "content", kind: str = "jobc") -> DataFrame:
    """Verdict per blob plus decoded header fields for ``ok`` blobs."""
    b = F.col(content)
    n = F.octet_length(b)
    if kind == "jobc":
        count = le_uint(b, 33, 4)
        body_end = F.lit(37) + count * 8
        checks = (
            F.when(n < JOBC_MIN_LEN, "short")
            .when(~_crc_ok(b, n), "crc")
            .when(le_uint(b, 0, 4) != JOBC_MAGIC, "magic")
            .when(le_uint(b, 4, 4) != JOBC_VERSION, "version")
            .when(count > JOBC_RECENT_CAP, "recent_cap")
            .when(body_end > n - 4, "recent_size")
            .when(body_end < n - 4, "trailing")
            .otherwise("ok")
        )
        fields = {
            "limit": le_uint(b, 8, 8),
            "next": le_uint(b, 16, 8),
            "found": le_uint(b, 24, 8),
            "seeded": F.substring(b, 33, 1) != F.unhex(F.lit("00")),
            "recent_count": count.cast("int"),
        }
    elif kind == "mmul":
        checks = (
            F.when(n < MMUL_MIN_LEN, "short")
            .when(~_crc_ok(b, n), "crc")
            .when(le_uint(b, 0, 4) != MMUL_MAGIC, "magic")
            .when(le_uint(b, 4, 4) != MMUL_VERSION, "version")
            .otherwise("ok")
        )
        fields = {
            "n": le_uint(b, 8, 8),
            "seed": le_uint(b, 16, 8),
            "next_cell": le_uint(b, 24, 8),
            "fingerprint": le_uint(b, 32, 8),
        }
    elif kind == "wcnt":
        count = le_uint(b, 32, 4)
        checks = (
            F.when(n < WCNT_MIN_LEN, "short")
            .when(~_crc_ok(b, n), "crc")
            .when(le_uint(b, 0, 4) != WCNT_MAGIC, "magic")
            .when(le_uint(b, 4, 4) != WCNT_VERSION, "version")
            .when(count > WCNT_DICT_SIZE, "recent_cap")
            .when(F.lit(36) + count * 12 != n - 4, "recent_size")
            .otherwise("ok")
        )
        fields = {
            "seed": le_uint(b, 8, 8),
            "words_total": le_uint(b, 16, 8),
            "next_word": le_uint(b, 24, 8),
            "count_size": count.cast("int"),
        }
    else:
        raise ValueError(kind)
    out = blobs.withColumn("verdict", checks).withColumn("n_bytes", n)
    ok = F.col("verdict") == "ok"
    for name, expr in fields.items():
        out = out.withColumn(name, F.when(ok, expr))
    return out.drop(content)


def verdict_counts(audited: DataFrame) -> DataFrame:
    return audited.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def read_blob_files(spark: SparkSession, path: str) -> DataFrame:
    """State files as rows (path, length, content) via the binaryFile source."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")
