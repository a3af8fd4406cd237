"""SRC1 / ST1: tolerant NDJSON worker output -> typed events.

Lines are trimmed of all white space; blank lines, lines not starting with
``{``, malformed JSON (single quotes and text after the object included) and
unknown types are skipped, and so is a checkpoint line with a field of the
wrong type or an integer outside its range.  ``started`` and ``completed`` lines count whatever their other
fields hold (a field that does not fit is null).  Of a repeated member the last one counts.
``found``, ``next`` and ``limit`` are unsigned 64-bit, read as decimal(20,0)
so no value is lost; other integers are signed 64-bit.  With ``strict_int64=True`` they are
signed too, and a checkpoint line whose values do not fit is dropped, as a reader with signed
fields would (D5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.schemas import LOG_LINE_SCHEMA

KNOWN_TYPES = ("checkpoint", "completed", "started")
INT64_MIN, INT64_MAX, UINT64_MAX = -(1 << 63), (1 << 63) - 1, (1 << 64) - 1
_STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


_SPACE = r"[\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
_INTEGER = r"^(BIGINT|VOID|DECIMAL\((19|[23][0-9]),0\))$"
_KINDS = {
    "string": r"^(STRING|VOID)$",
    "bigint": _INTEGER,
    "decimal(20,0)": _INTEGER,
    "double": r"^(BIGINT|DOUBLE|VOID|DECIMAL\([0-9,]+\))$",
}


def read_log(lines: DataFrame, order: str | None = "seq", strict_int64: bool = False, value: str = "value") -> DataFrame:
    """Parse a DataFrame of text lines (``value``) into typed events.

    ``order`` names the arrival-order column of ``lines``; when None the
    order is the line's own ``seq`` member.  Works on batch and streaming
    DataFrames alike.
    """
    keep = [order] if order else []
    fields = [f for f in LOG_LINE_SCHEMA.fields if not (order and f.name == "seq")]
    line = F.regexp_replace(F.col(value), f"^{_SPACE}+|{_SPACE}+$", "")
    # Parsed as the only element of an array, so that text after the object is malformed too.  Members keep
    # their JSON types (variant), and the parser lets the last of a repeated member win.
    members = "array<struct<" + ", ".join(f"`{f.name}` variant" for f in fields) + ">>"
    whole = F.from_json(F.concat(F.lit("["), F.when(line.startswith("{"), line), F.lit("]")), members, _STRICT_JSON)
    # one object a line; as a generator's output it is parsed once, whatever reads it
    single = F.transform(F.array(whole), lambda v: F.when(F.size(v) == 1, v[0]))
    parsed = lines.select(*keep, F.explode(F.filter(single, lambda v: v.isNotNull())).alias("_v"))
    values, good = [], F.lit(True)
    for f in fields:
        kind = f.dataType.simpleString()
        member = F.col("_v")[f.name]
        got = F.try_variant_get(member, "$", kind)
        fits = F.schema_of_variant(member).rlike(_KINDS[kind])
        if kind == "decimal(20,0)":
            low, high = (INT64_MIN, INT64_MAX) if strict_int64 else (0, UINT64_MAX)
            inside = got.between(F.lit(str(low)).cast(kind), F.lit(str(high)).cast(kind))
        else:
            inside = got.isNotNull()
        fits = member.isNull() | F.is_variant_null(member) | (fits & F.coalesce(inside, F.lit(False)))
        kept = fits
        if kind == "decimal(20,0)" and strict_int64:  # a completed line keeps its unsigned value
            kept = fits | F.coalesce(got > F.lit(str(INT64_MAX)).cast(kind), F.lit(False)) & F.schema_of_variant(member).rlike(_INTEGER)
        values.append(F.when(kept, got).alias(f.name))
        good = good & fits
    typed = parsed.select(*keep, *values, good.alias("_good"))
    return typed.filter(F.col("type").isin(*KNOWN_TYPES) & (F.col("_good") | (F.col("type") != "checkpoint"))).drop("_good")
