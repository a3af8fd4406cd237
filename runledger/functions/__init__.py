"""Column functions (JVM-side expressions only, no Python UDFs)."""

from runledger.functions.scalar import (  # noqa: F401
    arg_flag,
    decode_args,
    encode_args,
    is_terminal,
    is_valid_transition,
    json_type,
    label_map,
    le_uint,
    nanos_to_ts,
    state_index,
    try_int,
    u64_fingerprint,
)
