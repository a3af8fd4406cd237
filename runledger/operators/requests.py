"""Job requests against the worker registry: J3 P7 P8 P9.

The registry is a dimension; it is broadcast only after its row count is
checked (``sized_broadcast``), otherwise the join is left to the planner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions.scalar import arg_flag, encode_args
from runledger.schemas import DEFAULT_CHECKPOINT_EVERY, DEFAULT_COMMAND, DEFAULT_IMAGE, DEFAULT_LIMIT, DEFAULT_WORKER
from runledger.sources.dims import sized_broadcast

REGISTRY_BROADCAST_ROWS = 100_000


def _resolved_name() -> F.Column:
    return F.when(F.coalesce(F.col("worker_name"), F.lit("")) == "", F.lit(DEFAULT_WORKER)).otherwise(F.col("worker_name"))


def _reg(registry: DataFrame) -> DataFrame:
    r = registry.select(
        F.col("worker_name").alias("reg_name"),
        F.col("image").alias("reg_image"),
        F.col("command").alias("reg_command"),
        F.col("checkpoint_interval").alias("reg_interval"),
    )
    return sized_broadcast(r, REGISTRY_BROADCAST_ROWS)


def validate_requests(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests whose worker (``''`` -> primes) is in the registry, with its entry."""
    r = requests.withColumn("resolved_worker", _resolved_name())
    return r.join(_reg(registry), r["resolved_worker"] == F.col("reg_name"), "inner").drop("reg_name")


def rejected_requests(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests naming an unknown worker."""
    r = requests.withColumn("resolved_worker", _resolved_name())
    return r.join(_reg(registry), r["resolved_worker"] == F.col("reg_name"), "left_anti")


def resolve_defaults(valid: DataFrame, image_override: str | None = None) -> DataFrame:
    """Image request -> override -> registry -> default; command request ->
    registry -> constant; interval 0 -> registry."""
    def nz(c):
        return F.when(F.coalesce(c, F.lit("")) != "", c)

    image = F.coalesce(
        nz(F.col("image")),
        F.lit(image_override) if image_override else F.lit(None).cast("string"),
        nz(F.col("reg_image")),
        F.lit(DEFAULT_IMAGE),
    )
    command = F.coalesce(nz(F.col("command")), nz(F.col("reg_command")), F.lit(DEFAULT_COMMAND))
    every = F.when(F.col("checkpoint_every") == 0, F.col("reg_interval")).otherwise(F.col("checkpoint_every"))
    return valid.withColumn("image", image).withColumn("command", command).withColumn("checkpoint_every", every)


def build_args(resolved: DataFrame) -> DataFrame:
    """--worker name, the request's own args, then each numeric flag only when > 0."""
    def flag(name, col):
        v = F.col(col)
        return F.when(v > 0, F.array(F.lit(name), v.cast("string"))).otherwise(F.array().cast("array<string>"))

    args = F.concat(
        F.array(F.lit("--worker"), F.col("resolved_worker")),
        F.coalesce(F.col("args"), F.array().cast("array<string>")),
        flag("--limit", "limit"),
        flag("--checkpoint-every", "checkpoint_every"),
        flag("--seed", "seed"),
        *([flag("--sleep-per-checkpoint-ms", "sleep_per_checkpoint_ms")] if "sleep_per_checkpoint_ms" in resolved.columns else []),
    )
    return resolved.withColumn("argv", args)


def container_args(jobs: DataFrame, job_id: str, state_file: str, args: str = "argv") -> DataFrame:
    """P9, the worker's command line: flags looked up in the job's own args, with defaults
    where they always appear; the state file to resume from only for a resumable job with a checkpoint."""
    given = F.col(args)
    none = F.array().cast("array<string>")

    def always(name, default):
        return F.array(F.lit(name), arg_flag(given, name, default))

    def if_given(name):
        return F.when(arg_flag(given, name, "") != "", F.array(F.lit(name), arg_flag(given, name, ""))).otherwise(none)

    resume = (F.col("state") == "interrupted_resumable") & F.col("last_checkpoint_path").isNotNull()
    argv = F.concat(
        always("--worker", DEFAULT_WORKER),
        F.array(F.lit("--job-id"), F.col(job_id).cast("string")),
        always("--limit", DEFAULT_LIMIT),
        always("--checkpoint-every", DEFAULT_CHECKPOINT_EVERY),
        F.array(F.lit("--output-state"), F.lit(state_file)),
        if_given("--seed"),
        if_given("--sleep-per-checkpoint-ms"),
        F.when(F.coalesce(resume, F.lit(False)), F.array(F.lit("--resume-from"), F.lit(state_file))).otherwise(none),
    )
    return jobs.withColumn("container_argv", argv)


def arg_flags(df: DataFrame, flags: dict[str, str], args: str = "argv") -> DataFrame:
    """P7 over several flags: value after the first flag with a value, else default."""
    out = df
    for flag, default in flags.items():
        out = out.withColumn(flag.strip("-").replace("-", "_"), arg_flag(F.col(args), flag, default))
    return out


__all__ = ["validate_requests", "rejected_requests", "resolve_defaults", "build_args", "container_args", "arg_flags", "encode_args"]
