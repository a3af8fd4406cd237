"""Log, audit, diff and sink queries: SRC1 SRC4 SRC6 J9 U2 U3 SNK1-3."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.functions.scalar import json_type, label_map
from runledger.operators import aggregate as A
from runledger.operators import audit as AU
from runledger.operators import reconcile as R
from runledger.plans import fixtures as fx
from runledger.plans.catalog import register, with_ctes
from runledger.plans.q_reconcile import ORPHANS_SQL
from runledger.schemas import LABEL_CONTROLLER_PID, LABEL_CREATED_AT, LABEL_JOB_ID
from runledger.session import scratch_path
from runledger.sources import blobs as B
from runledger.sources import sinks as S
from runledger.sources.ndjson import read_log
from runledger.sources.tables import table

_EVENTS_SQL = (
    "select seq, type, job_id, null::varchar as worker, epoch, null::double as progress, "
    "cast(case when seq % 13 = 0 then 18446744073709551615 - found else found end as decimal(20,0)) as found, null::decimal(20,0) as next, '/state/' || job_id || '.bin' as state_path, "
    "null::decimal(20,0) as \"limit\", null::bigint as resume_from_epoch "
    "from worker_log where seq % 10 <> 0 and type in ('checkpoint', 'completed', 'started')"
)


@register("ndjson_events", with_ctes(_EVENTS_SQL, "worker_log"))
def ndjson_events(spark, sf_dir):
    return read_log(fx.worker_lines(spark, sf_dir))


@register(
    "ndjson_events_strict",
    with_ctes(f"select * from ({_EVENTS_SQL}) where type <> 'checkpoint' or found <= 9223372036854775807", "worker_log"),
)
def ndjson_events_strict(spark, sf_dir):
    return read_log(fx.worker_lines(spark, sf_dir), strict_int64=True)


@register(
    "line_types_all",
    with_ctes(
        "select seq, case when seq % 10 <> 0 then type when seq // 10 % 9 in (3, 6, 7, 8) then 'checkpoint' end as type from worker_log",
        "worker_log",
    ),
)
def line_types_all(spark, sf_dir):
    """the type of every line, known to a reader or not; null where the line is not one JSON object."""
    lines = fx.worker_lines(spark, sf_dir)
    return lines.select("seq", json_type(F.trim(F.col("value"), F.lit(" \t"))).alias("type"))


@register(
    "label_maps",
    with_ctes(
        "select container_id, cast(job_id as varchar) as job, pid_label as pid from containers",
        "containers",
    ),
)
def label_maps(spark, sf_dir):
    """the labels written as k=v text and read back."""
    labels = F.map_entries("labels")
    text = F.array_join(F.transform(labels, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    back = fx.containers(spark, sf_dir).select("container_id", label_map(text).alias("m"))
    return back.select("container_id", F.col("m")[LABEL_JOB_ID].alias("job"), F.col("m")[LABEL_CONTROLLER_PID].alias("pid"))


@register(
    "labelled_containers",
    with_ctes("select container_id, job_id, state from containers where l_linenumber % 2 = 1", "containers"),
)
def labelled_containers(spark, sf_dir):
    return AU.labelled(fx.containers(spark, sf_dir), LABEL_CREATED_AT).select("container_id", "job_id", "state")


@register(
    "labelled_containers_kv",
    with_ctes("select container_id, job_id, state from containers where pid_label = '2'", "containers"),
)
def labelled_containers_kv(spark, sf_dir):
    return AU.labelled(fx.containers(spark, sf_dir), LABEL_CONTROLLER_PID, "2").select("container_id", "job_id", "state")


_VERDICT = (
    "case doc_id % 8 when 0 then 'ok' when 1 then 'short' when 2 then 'crc' when 3 then 'magic' "
    "when 4 then 'version' when 5 then 'recent_cap' when 6 then 'recent_size' else 'trailing' end"
)
_BLOB_SQL = (
    f"select doc_id, {_VERDICT} as verdict, "
    "cast(case doc_id % 8 when 1 then 10 when 7 then 74 else 73 end as integer) as n_bytes, "
    "case when doc_id % 8 = 0 then cast(n_chars as decimal(20,0)) end as \"limit\", "
    "case when doc_id % 8 = 0 then cast(doc_id as decimal(20,0)) end as next, "
    "case when doc_id % 8 = 0 then cast(doc_id * 7 as decimal(20,0)) end as found, "
    "case when doc_id % 8 = 0 then true end as seeded, "
    "case when doc_id % 8 = 0 then 4 end as recent_count from documents"
)


@register("blob_audit", _BLOB_SQL)
def blob_audit(spark, sf_dir):
    return B.audit(fx.jobc_frames(spark, sf_dir))


@register("blob_verdicts", f"select verdict, count(*) as n from ({_BLOB_SQL}) group by verdict")
def blob_verdicts(spark, sf_dir):
    return B.verdict_counts(B.audit(fx.jobc_frames(spark, sf_dir)))


def _verdict_sql(names: list[str], sizes: str, fields: str) -> str:
    cases = " ".join(f"when {i} then '{n}'" for i, n in enumerate(names))
    return f"select doc_id, case doc_id % {len(names)} {cases} end as verdict, cast({sizes} as integer) as n_bytes, {fields} from documents"


@register(
    "blob_audit_mmul",
    _verdict_sql(
        ["ok", "short", "crc", "magic", "version"],
        "case when doc_id % 5 = 1 then 10 else 44 end",
        "case when doc_id % 5 = 0 then cast(n_chars as decimal(20,0)) end as n, "
        "case when doc_id % 5 = 0 then cast(doc_id + 3 as decimal(20,0)) end as seed, "
        "case when doc_id % 5 = 0 then cast(doc_id * 11 as decimal(20,0)) end as next_cell, "
        "case when doc_id % 5 = 0 then cast(18446744073709551600 as decimal(20,0)) end as fingerprint",
    ),
)
def blob_audit_mmul(spark, sf_dir):
    return B.audit(fx.mmul_frames(spark, sf_dir), kind="mmul")


@register(
    "blob_audit_wcnt",
    _verdict_sql(
        ["ok", "short", "crc", "magic", "version", "recent_cap", "recent_size"],
        "case when doc_id % 7 = 1 then 10 else 64 end",
        "case when doc_id % 7 = 0 then cast(doc_id + 3 as decimal(20,0)) end as seed, "
        "case when doc_id % 7 = 0 then cast(n_chars as decimal(20,0)) end as words_total, "
        "case when doc_id % 7 = 0 then cast(doc_id * 11 as decimal(20,0)) end as next_word, "
        "case when doc_id % 7 = 0 then 2 end as count_size",
    ),
)
def blob_audit_wcnt(spark, sf_dir):
    return B.audit(fx.wcnt_frames(spark, sf_dir), kind="wcnt")


_WC_ALL = "select word, count(*) as n from tokens group by word"
_WC_CUT = "select word, count(*) as n from tokens where doc_id % 97 <> 0 group by word"


def _wc_pair(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    full = A.word_count(A.tokenize(docs))
    cut = A.word_count(A.tokenize(docs.filter(F.col("doc_id") % 97 != 0)))
    return full, cut


@register(
    "run_diff",
    with_ctes(
        "select coalesce(a.word, b.word) as word, a.n as n_left, b.n as n_right, "
        "case when b.word is null then 'only_left' when a.word is null then 'only_right' else 'value_differs' end as diff "
        "from a full outer join b on a.word = b.word where a.word is null or b.word is null or a.n <> b.n",
        "tokens",
        extra={"t": "select * from tokens where word <> ''", "a": _WC_ALL.replace("tokens", "t"), "b": _WC_CUT.replace("tokens", "t")},
    ),
)
def run_diff(spark, sf_dir):
    full, cut = _wc_pair(spark, sf_dir)
    return AU.run_diff(full, cut, ["word"], ["n"])


# Text of one task of the per-document count: what it holds are the distinct (document, word) pairs of that text.
_TASK_TEXT = 8 << 20


def _by_document(docs, task_text: int = _TASK_TEXT):
    """The documents dealt by doc_id, seven parts or more: as many as the text needs."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.repartition(max(7, -(-size // task_text)), "doc_id")


@register(
    "run_identity",
    with_ctes(
        "select (select count(*) from (select * from a except all select * from b)) as only_a, "
        "(select count(*) from (select * from b except all select * from a)) as only_b, "
        "not exists (select * from a except all select * from b) and not exists (select * from b except all select * from a) as identical",
        "tokens",
        extra={
            "t": "select * from tokens where word <> ''",
            "a": _WC_ALL.replace("tokens", "t"),
            "d": "select doc_id, word, count(*) as k from t group by all",
            "b": "select word, cast(sum(k) as bigint) as n from d group by word",
        },
    ),
)
def run_identity(spark, sf_dir):
    """A run against one that counted per document first and was partitioned otherwise."""
    docs = table(spark, sf_dir, "documents")
    a = A.word_count(A.tokenize(docs))
    per_doc = A.tokenize(_by_document(docs)).groupBy("doc_id", "word").count()
    return AU.run_identity(a, per_doc.groupBy("word").agg(F.sum("count").alias("n")))


@register(
    "run_identity_diff",
    with_ctes(
        "select word, n, 'only_a' as side, count(*) as surplus from (select * from a except all select * from b) group by all union all "
        "select word, n, 'only_b' as side, count(*) as surplus from (select * from b except all select * from a) group by all",
        "tokens",
        extra={"t": "select * from tokens where word <> ''", "a": _WC_ALL.replace("tokens", "t"), "b": _WC_CUT.replace("tokens", "t")},
    ),
)
def run_identity_diff(spark, sf_dir):
    full, cut = _wc_pair(spark, sf_dir)
    return AU.run_identity_diff(full, cut)


@register(
    "merged_log",
    with_ctes(
        f"select *, 'worker' as source from ({_EVENTS_SQL}) union all by name "
        "select *, 'ledger' as source from job_log",
        "worker_log",
        "job_log",
    ),
)
def merged_log(spark, sf_dir):
    ev = read_log(fx.worker_lines(spark, sf_dir))
    return AU.merged_log([ev, fx.job_log(spark, sf_dir)], ["worker", "ledger"])


@register("snapshot_publish", with_ctes("select word, count(*) as n from tokens where word <> '' group by word", "tokens"))
def snapshot_publish(spark, sf_dir):
    path = scratch_path(spark, "snapshots")
    docs = table(spark, sf_dir, "documents")
    # An older, partial snapshot and then the full one; `latest` must be the full one.
    S.publish_snapshot(A.word_count(A.tokenize(docs.filter(F.col("doc_id") % 2 == 0))), path, "20240101T000000Z")
    S.publish_snapshot(A.word_count(A.tokenize(docs)), path, "20240102T000000Z")
    return S.latest_snapshot(spark, path)


@register(
    "event_append",
    with_ctes(
        "select seq as id, job_id, type as event_type, ts as recorded_at, epoch, found, "
        "case when type = 'checkpoint' then '/state/' || job_id || '.bin' end as path from worker_log",
        "worker_log",
    ),
)
def event_append(spark, sf_dir):
    """Every change of the log is appended, in two commits, and read back."""
    path = scratch_path(spark, "events")
    ev = fx.worker_log(spark, sf_dir).select(
        F.col("seq").alias("id"), "job_id", F.col("type").alias("event_type"), F.col("ts").alias("recorded_at"), "epoch", "found",
        F.when(F.col("type") == "checkpoint", F.concat(F.lit("/state/"), F.col("job_id"), F.lit(".bin"))).alias("path"),
    )
    half = F.col("id") % 2 == 0
    S.append_events(ev.filter(half), path, ["epoch", "found", "path"])
    S.append_events(ev.filter(~half), path, ["epoch", "found", "path"])
    back = spark.read.parquet(path)
    p = F.from_json("payload", "epoch bigint, found bigint, path string")
    return back.select("id", "job_id", "event_type", "recorded_at", p["epoch"].alias("epoch"), p["found"].alias("found"), p["path"].alias("path"))


@register(
    "orphan_report",
    with_ctes(
        f"select * from ({ORPHANS_SQL})",
        "containers",
    ),
)
def orphan_report(spark, sf_dir):
    path = scratch_path(spark, "orphans")
    S.write_orphan_report(R.orphans(fx.containers(spark, sf_dir), fx.alive_pids(spark)), path)
    return spark.read.schema(S.ORPHAN_REPORT_SCHEMA).json(path)
