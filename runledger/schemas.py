"""Schemas and the fixed values of the job state machine.

The values under "FIXED VALUES" must equal the ledger's rules for results to
match; they are written out in natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (state domain, terminal set, legal transitions, whitelists)
# ---------------------------------------------------------------------------
STATES = [
    "pending",
    "running",
    "checkpointing",
    "completed",
    "failed",
    "cancelled",
    "interrupted_resumable",
    "interrupted_unresumable",
]

TERMINAL_STATES = ["completed", "failed", "cancelled", "interrupted_unresumable"]

# Non-terminal states picked up by the start-up recovery scan.
RECOVERY_STATES = ["running", "checkpointing", "pending", "interrupted_resumable"]

# Legal moves other than the always-legal self move (from == to).
LEGAL_TRANSITIONS = [
    ("pending", "running"),
    ("pending", "cancelled"),
    ("pending", "failed"),
    ("pending", "interrupted_unresumable"),
    ("running", "running"),
    ("running", "checkpointing"),
    ("running", "completed"),
    ("running", "failed"),
    ("running", "cancelled"),
    ("running", "interrupted_resumable"),
    ("running", "interrupted_unresumable"),
    ("checkpointing", "running"),
    ("checkpointing", "checkpointing"),
    ("checkpointing", "completed"),
    ("checkpointing", "failed"),
    ("checkpointing", "cancelled"),
    ("checkpointing", "interrupted_resumable"),
    ("checkpointing", "interrupted_unresumable"),
    ("interrupted_resumable", "running"),
    ("interrupted_resumable", "interrupted_unresumable"),
    ("interrupted_resumable", "cancelled"),
    ("completed", "completed"),
    ("failed", "failed"),
    ("cancelled", "cancelled"),
    ("interrupted_unresumable", "interrupted_unresumable"),
]

# Keys of a transition's update map that may appear in the audit payload.
UPDATE_WHITELIST = [
    "state",
    "exit_code",
    "container_id",
    "last_checkpoint_epoch",
    "last_checkpoint_found",
    "started_at",
    "finished_at",
    "assigned_controller_id",
]

# Public projection of a job row (the API view).
JOB_VIEW_COLUMNS = [
    "id",
    "image",
    "state",
    "created_at",
    "started_at",
    "finished_at",
    "exit_code",
    "last_checkpoint_at",
    "last_checkpoint_epoch",
    "last_checkpoint_found",
    "container_id",
    "state_volume_path",
]

DEFAULT_PAGE_LIMIT = 50
DEFAULT_EVENT_LIMIT = 25
MAX_LIMIT = 200
RECENT_RING_CAP = 32
DEFAULT_WORKER = "primes"
DEFAULT_LIMIT = "100000"
DEFAULT_CHECKPOINT_EVERY = "5000"
DEFAULT_IMAGE = "runledger/worker:latest"
DEFAULT_COMMAND = "/usr/local/bin/worker"
LABEL_JOB_ID = "io.runledger.job_id"
LABEL_CONTROLLER_PID = "io.runledger.controller_pid"
LABEL_CREATED_AT = "io.runledger.created_at"
# ---------------------------------------------------------------------------

TRANSITION_KEYS = [f"{a}>{b}" for a, b in LEGAL_TRANSITIONS]


def transition_matrix() -> list[list[bool]]:
    """8x8 legality matrix in STATES order, self moves included."""
    legal = set(LEGAL_TRANSITIONS)
    return [[a == b or (a, b) in legal for b in STATES] for a in STATES]


# One NDJSON line of worker output; `found` is unsigned 64-bit.  `seq` (the
# arrival order) is optional: batch readers may supply it as a column.
LOG_LINE_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("worker", T.StringType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("progress", T.DoubleType()),
        T.StructField("found", T.DecimalType(20, 0)),
        T.StructField("next", T.DecimalType(20, 0)),
        T.StructField("state_path", T.StringType()),
        T.StructField("limit", T.DecimalType(20, 0)),
        T.StructField("resume_from_epoch", T.LongType()),
    ]
)

PAYLOAD_SCHEMAS = {
    "created": "struct<state:string>",
    "transition": "struct<from:string,to:string,updates:map<string,string>>",
    "checkpoint": "struct<epoch:bigint,found:bigint,path:string>",
}

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("worker_name", T.StringType(), True),
        T.StructField("image", T.StringType(), True),
        T.StructField("command", T.StringType(), True),
        T.StructField("checkpoint_interval", T.IntegerType(), True),
        T.StructField("schema_version", T.IntegerType(), True),
    ]
)
