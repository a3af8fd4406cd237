"""Scalar column functions F1-F10.

All are compositions of built-in expressions so they stay inside whole-stage
codegen; none calls back into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger.schemas import STATES, TERMINAL_STATES, TRANSITION_KEYS

U64 = 18446744073709551616  # 2^64


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_valid_transition(frm, to) -> Column:
    """self moves are always legal (even for unknown states), else table lookup."""
    frm, to = _c(frm), _c(to)
    keys = F.array(*[F.lit(k) for k in TRANSITION_KEYS])
    return F.coalesce((frm == to) | F.array_contains(keys, F.concat(frm, F.lit(">"), to)), F.lit(False))


def is_terminal(state) -> Column:
    """completed / failed / cancelled / interrupted_unresumable."""
    return F.coalesce(_c(state).isin(*TERMINAL_STATES), F.lit(False))


def state_index(state) -> Column:
    """0-based position in STATES, -1 for unknown or null."""
    arr = F.array(*[F.lit(s) for s in STATES])
    return (F.coalesce(F.array_position(arr, _c(state)), F.lit(0)) - 1).cast("int")


_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(ts) -> Column:
    """Microseconds since the epoch of a timestamp_ntz read as UTC.

    Zone-free: no dependence on the session time zone, so it is monotone in
    the wall-clock value (no DST gaps) and equal to DuckDB's epoch_us.
    A timestamp (with zone) input is an instant already: unix_micros.
    """
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), _c(ts))


def ntz_from_micros(us) -> Column:
    """timestamp_ntz of epoch microseconds (UTC wall clock), zone-free."""
    return F.expr(_EPOCH_NTZ) + F.make_dt_interval(secs=(_c(us) / F.lit(1_000_000)).cast("decimal(18,6)"))


def utc_instant(ts) -> Column:
    """timestamp (instant) of a timestamp_ntz read as UTC; for watermarks."""
    return F.timestamp_micros(epoch_micros(ts))


def seconds_between(a, b) -> Column:
    """b - a in seconds (double) for timestamp_ntz columns, zone-free."""
    return (epoch_micros(b) - epoch_micros(a)) / 1e6


def nanos_to_ts(ns) -> Column:
    """unix nanoseconds -> timestamp_ntz in UTC (microsecond precision)."""
    return ntz_from_micros(F.floor(_c(ns) / 1000).cast("bigint"))


def le_uint(b, offset: int, width: int) -> Column:
    """little-endian unsigned integer of `width` bytes at 0-based `offset`.

    Bytes are reversed into a big-endian hex string and converted in base 16;
    the result is decimal(20,0) so full u64 values survive.
    """
    b = _c(b)
    parts = [F.hex(F.substring(b, offset + width - i, 1)) for i in range(width)]
    return F.conv(F.concat(*parts), 16, 10).cast("decimal(20,0)")


def u64_fingerprint(key: Column) -> Column:
    """stable row hash, the first 60 bits of md5(key) as decimal; sums of it are order-free."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("decimal(38,0)")


def json_type(line) -> Column:
    """the `type` member of a trimmed line; null unless the whole line is one JSON object and the member a string.

    Parsed as the only element of an array, so that text after the object is malformed too.  Of a repeated
    member the last one counts.
    """
    c = _c(line)
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    whole = F.from_json(F.concat(F.lit("["), F.when(c.startswith("{"), c), F.lit("]")), "array<struct<type variant>>", strict)
    member = whole[0]["type"]
    return F.when((F.size(whole) == 1) & (F.schema_of_variant(member) == "STRING"), F.try_variant_get(member, "$", "string"))


def encode_args(arr) -> Column:
    """F8: list -> JSON text."""
    return F.to_json(_c(arr))


def decode_args(text) -> Column:
    """F8: JSON text -> array<string>."""
    return F.from_json(_c(text), "array<string>")


def try_int(x) -> Column:
    """64-bit integer parse, failure -> 0; blanks around the digits are a failure."""
    return F.coalesce(F.when(_c(x).rlike("^[+-]?[0-9]+$"), _c(x).try_cast("bigint")), F.lit(0).cast("bigint"))


def label_map(text) -> Column:
    """'k=v,k2=v2' -> map<string,string>."""
    return F.str_to_map(_c(text), F.lit(","), F.lit("="))


def arg_flag(args, key, default) -> Column:
    """Value after the first `key` that has a following token, else default.

    A flag that is the last token has no value.  The first occurrence is the
    one the reference reads; if it is at the end there is no earlier one, so
    one position lookup is enough.
    """
    args = _c(args)
    key = key if isinstance(key, Column) else F.lit(key)
    default = default if isinstance(default, Column) else F.lit(default)
    pos = F.array_position(args, key)
    val = F.when(pos > 0, F.try_element_at(args, (pos + 1).cast("int")))
    return F.coalesce(val, default)
