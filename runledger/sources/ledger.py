"""SRC2 / SRC3: decode ledger rows and event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions.scalar import decode_args, nanos_to_ts
from runledger.schemas import PAYLOAD_SCHEMAS

_NANO_COLS = ["created_at", "started_at", "finished_at", "last_checkpoint_at"]


def ledger_scan(rows: DataFrame) -> DataFrame:
    """SRC2: stored ledger rows -> typed jobs (times as timestamps, args as array)."""
    out = rows
    for c in _NANO_COLS:
        out = out.withColumn(c + "_ns", F.col(c)).withColumn(c, nanos_to_ts(F.col(c)))
    return out.withColumn("args", decode_args("args_json")).drop("args_json")


def event_scan(events: DataFrame) -> DataFrame:
    """SRC3: event rows with the payload decoded per event type."""
    p = F.col("payload")
    created = F.from_json(p, PAYLOAD_SCHEMAS["created"])
    trans = F.from_json(p, PAYLOAD_SCHEMAS["transition"])
    ckpt = F.from_json(p, PAYLOAD_SCHEMAS["checkpoint"])
    et = F.col("event_type")
    return events.select(
        *[c for c in events.columns if c not in ("payload",)],
        F.when(et == "created", created["state"]).alias("created_state"),
        F.when(et == "transition", trans["from"]).alias("from_state"),
        F.when(et == "transition", trans["to"]).alias("to_state"),
        F.when(et == "transition", trans["updates"]).alias("updates"),
        F.when(et == "checkpoint", ckpt["epoch"]).alias("epoch"),
        F.when(et == "checkpoint", ckpt["found"]).alias("found"),
        F.when(et == "checkpoint", ckpt["path"]).alias("path"),
    )
