"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.sources.tables import table


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runledger.llm.line_frequency import line_verdicts

    return line_verdicts(table(spark, sf_dir, "documents"))


def op2_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runledger.llm.minhash_bayes import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runledger.llm.secret_crf import digest, scan

    return digest(scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def url_captures(pages: DataFrame) -> DataFrame:
    """Every page as a capture; its fetch day follows from its id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 360).cast("int"))
    return pages.select(F.col("page_id").alias("capture_id"), "url", day.alias("fetched"))


def url_list_log(pages: DataFrame) -> DataFrame:
    """A dated list log over the pages' own hosts and first path segments: adds, removals, second adds."""
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1))
    segment = F.regexp_extract("url", "^[a-z]+://[^/?#]+/([^/?#]+)", 1)
    parent = F.regexp_extract("url", r"^[a-z]+://(?:[^/:?#]*\.)?([^/:?#.]+\.[^/:?#.]+\.[^/:?#.]+)(?:[/:?#]|$)", 1)
    patterns = F.explode(F.array(host, parent, F.concat(host, F.lit("/"), segment)))
    h = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("int")
    first = F.date_add(F.lit("2023-12-01").cast("date"), h % 300)
    change = F.explode(
        F.array(
            F.struct(F.lit("add").alias("action"), first.alias("day")),
            F.struct(F.lit("remove").alias("action"), F.date_add(first, 10 + h % 100).alias("day")),
            F.struct(F.when(h % 2 == 0, "add").alias("action"), F.date_add(first, 150 + h % 50).alias("day")),
        )
    )
    names = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), 1 + h % 3)
    return (
        pages.select(patterns.alias("pattern"))
        .filter("pattern <> '' and pattern not like '%/'")
        .distinct()
        .filter(h % 5 < 2)
        .select(names.alias("list_name"), "pattern", change.alias("c"))
        .select("list_name", "pattern", "c.action", "c.day")
    )


def op4_url_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runledger.llm.url_intervals import judge

    pages = table(spark, sf_dir, "pages")
    return judge(url_captures(pages), url_list_log(pages))


def op5_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runledger.llm.forced_bpe import digest, encode_decode

    return digest(encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runledger.llm.longest_match import count_tokens

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_tokens")


def op7_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runledger.llm.id_shards import digest, read_shards, write_shards
    from runledger.session import scratch_path

    target = scratch_path(spark, "llm-shards")
    write_shards(table(spark, sf_dir, "documents"), target)
    return digest(read_shards(spark, target))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runledger.llm.suffix_dedup import digest, remove_repeated

    return digest(remove_repeated(table(spark, sf_dir, "documents")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runledger.llm.decontaminate import contamination, digest

    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runledger.llm.mil_quality import digest, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(score(docs, train(docs, table(spark, sf_dir, "labels"))))


def op11_chunk_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runledger.llm.chunk_audit import audit

    return audit(table(spark, sf_dir, "documents"))


def op12_merge_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runledger.llm.merge_transducer import digest

    return digest(table(spark, sf_dir, "documents"))


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runledger.llm.period_runs import digest, periodic_runs, planted_text

    docs = table(spark, sf_dir, "documents")
    judged = docs.select("doc_id", planted_text(F.col("doc_id"), F.col("text")).alias("text"))
    return digest(periodic_runs(judged))


QUERIES = {
    "op1_line_frequency": op1_line_frequency,
    "op2_minhash_bayes": op2_minhash_bayes,
    "op3_secret_crf": op3_secret_crf,
    "op4_url_intervals": op4_url_intervals,
    "op5_forced_bpe": op5_forced_bpe,
    "op6_longest_match": op6_longest_match,
    "op7_id_shards": op7_id_shards,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_mil_quality": op10_mil_quality,
    "op11_chunk_audit": op11_chunk_audit,
    "op12_merge_transducer": op12_merge_transducer,
    "op13_period_runs": op13_period_runs,
}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_line_frequency"] = rf"""
with d as (
  select doc_id, coalesce(text, '') as t, coalesce(source, chr(0)) as host,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
grams as (
  select doc_id, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1),
         lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) as g
  from d where len(w) >= 3),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from grams) where n > 1),
reps as (
  select doc_id, count(distinct p) as n_repeat_words
  from (select doc_id, unnest([i, i + 1, i + 2]) as p from rep) group by doc_id),
raw as (
  select doc_id, count(*) - count(distinct l) as n_dup_lines
  from (select doc_id, unnest(string_split(t, chr(10))) as l from d) where regexp_matches(l, '[^\x20\x09-\x0D]')
  group by doc_id),
lines as (
  select doc_id, host, md5(t) as copy, l from (
    select doc_id, host, t, trim(unnest(string_split(regexp_replace(
      regexp_replace(lower(t), '[1-9]', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10))), ' ') as l
    from d) where l <> ''),
sizes as (select host, count(distinct t) as host_docs from d group by host),
freq as (
  select host, l from (select host, l, count(distinct copy) as n from lines group by host, l) join sizes using (host)
  where n > 20 and n * n > host_docs),
gone as (
  select doc_id, sum(len(string_split(l, ' '))) as n_removed_words from lines join freq using (host, l) group by doc_id),
base as (
  select doc_id, cast(len(w) as bigint) as n_words,
         cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
         cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines,
         cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
         cast(coalesce(n_removed_words, 0) as bigint) as n_removed_words
  from d left join raw using (doc_id) left join reps using (doc_id) left join gone using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed, n_removed_words,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
         and n_words - n_removed_words >= 0.3 * n_words as kept
from base
"""

ORACLE_SQL["op9_decontaminate"] = rf"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (
  select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as k from (
    select item_id, w, least(len(w), 13) as size, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i
    from b where len(w) > 0)),
sizes as (select distinct size from win),
dw as (
  select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as k from (
    select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, sizes where len(w) >= size)),
hit as (select doc_id, dw.size, i, item_id from dw join win on dw.k = win.k and dw.size = win.size),
words as (select doc_id, count(distinct p) as n_hit
          from (select doc_id, unnest(range(i, i + size)) as p from hit) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items,
                 array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as s
          from hit group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(s, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

ORACLE_SQL["op2_minhash_bayes"] = rf"""
with recursive d as (
  select doc_id, array_to_string(regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'),
         '[^\x20\x09-\x0D]+'), ' ') as t,
         regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') as w
  from documents),
copies as (select t, min(doc_id) as node, any_value(w) as w, count(*) as n_copies from d group by t),
sh as (
  select distinct node, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') as s from (
    select node, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from copies where len(w) > 0)),
size as (select node, count(*) as n from sh group by node),
common as (select x.node as a, y.node as b, count(*) as c from sh x join sh y on x.s = y.s and x.node < y.node group by all),
link as (
  select a, b from common join size p on p.node = a join size q on q.node = b where 100 * c >= 75 * (p.n + q.n - c)),
both_ways as (select a, b from link union all select b, a from link),
reach as (
  select a as node, a as other from both_ways
  union
  select reach.node, both_ways.b from reach join both_ways on reach.other = both_ways.a),
label as (select node, least(node, min(other)) as component from reach group by node)
select doc_id, cast(coalesce(size.n, 0) as bigint) as n_shingles,
       case when size.n is null then doc_id else coalesce(component, copies.node) end as component_id,
       doc_id = case when size.n is null then doc_id else coalesce(component, copies.node) end as kept,
       cast(case when size.n is null then 1 else n_copies end as bigint) as n_copies
from d join copies using (t) left join size on size.node = copies.node left join label on label.node = copies.node
"""

ORACLE_SQL["op4_url_intervals"] = r"""
with captures as (
  select page_id, cast(date '2024-01-01' + cast(page_id * 37 % 360 as integer) as date) as day,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?(/[^?#]*)?', 1)) as host,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?(/[^?#]*)?', 2)) as path
  from pages),
raw as (
  select distinct unnest([lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)),
      regexp_extract(url, '^[a-z]+://(?:[^/:?#]*\.)?([^/:?#.]+\.[^/:?#.]+\.[^/:?#.]+)(?:[/:?#]|$)', 1),
      lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) || '/' || regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]+)', 1)
    ]) as pattern from pages),
hashed as (
  select pattern, cast('0x' || substr(md5(pattern), 1, 6) as integer) as h from raw
  where pattern <> '' and pattern not like '%/'),
log as (
  select ['adult', 'malware', 'spam'][1 + h % 3] as list_name, lower(pattern) as pattern, c.action, c.day from (
    select *, unnest([
      {'action': 'add', 'day': date '2023-12-01' + h % 300},
      {'action': 'remove', 'day': date '2023-12-01' + h % 300 + 10 + h % 100},
      {'action': case when h % 2 = 0 then 'add' end, 'day': date '2023-12-01' + h % 300 + 150 + h % 50}]) as c
    from hashed where h % 5 < 2) where c.action is not null),
per_day as (
  select list_name, pattern, cast(day as date) as day, min(case when action = 'add' then 1 else 0 end) as on_
  from log group by all),
changes as (
  select * from (select *, lag(on_, 1, 0) over (partition by list_name, pattern order by day) as was from per_day)
  where on_ <> was),
spans as (
  select * from (select *, lead(day) over (partition by list_name, pattern order by day) as until from changes)
  where on_ = 1),
labels as (select page_id, day, host, string_split(host, '.') as l,
                  list_filter(string_split(path, '/'), lambda x: x <> '') as p from captures where host <> ''),
cands as (
  select distinct page_id, day, unnest(list_concat(
    list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:], '.')),
    list_transform(range(1, len(p) + 1), lambda i: host || '/' || array_to_string(p[1:i], '/')))) as pattern
  from labels),
found as (
  select page_id, list_name || ':' || pattern as entry from cands join spans using (pattern)
  where cands.day >= spans.day and (until is null or cands.day < until)),
per_page as (select page_id, count(*) as n, array_to_string(list_sort(list(entry)), ',') as active from found group by page_id)
select captures.page_id as capture_id, cast(coalesce(n, 0) as bigint) as n_active, coalesce(active, '') as active,
       coalesce(n, 0) > 0 as blocked
from captures left join per_page using (page_id)
"""

ORACLE_SQL["op11_chunk_audit"] = rf"""
with d as (
  select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), '{_UP}', '{_LOW}') as t from documents),
occ as (select rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (
  select lang, term from (select distinct rid, lang, term from occ) group by lang, term having count(*) >= 30),
counts as (select lang, source, term, count(*) as n from occ join kept using (lang, term) group by lang, source, term),
vocabulary as (select lang, count(*) as v from kept group by lang),
groups as (
  select g.lang, g.source, coalesce(s.total, 0) as total, coalesce(v, 0) as v
  from (select distinct lang, source from d) g
  left join (select lang, source, sum(n) as total from counts group by lang, source) s using (lang, source)
  left join vocabulary using (lang)),
dense as (
  select lang, source, term, coalesce(n, 0) as n,
         1 + (1000000000::hugeint * (coalesce(n, 0) + 5)) // (total + 5 * v)::hugeint as p
  from groups join kept using (lang) left join counts using (lang, source, term)),
usual as (
  select lang, term, 1 + (1000000000::hugeint * (sum(n) + 5)) // (any_value(t) + 5 * any_value(v))::hugeint as q
  from dense join (select lang, sum(total) as t, max(v) as v from groups group by lang) using (lang)
  group by lang, term),
apart as (
  select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value
  from dense x join dense y using (lang, term) where x.source <> y.source group by all),
pairs as (
  select x.lang, x.source, 'pair' as part, y.source as item, coalesce(value, 0) as value
  from groups x join groups y on x.lang = y.lang and x.source <> y.source
  left join apart a on a.lang = x.lang and a.source = x.source and a.item = y.source),
over as (
  select lang, source, 'term' as part, term as item, p - q as value
  from dense join usual using (lang, term) where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank
  from (select * from pairs union all select * from over))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
from ranked where part = 'pair' or rank <= 50
"""
