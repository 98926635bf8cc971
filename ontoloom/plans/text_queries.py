"""Queries on raw texts: ingest, incremental scans, cleaning, sentences, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions import word_lists as wl
from ontoloom.functions.text import BLANKS
from ontoloom.operators import tables as tb
from ontoloom.operators import textprep as tp
from ontoloom.sources.tables import table


def ingest_dedup(spark: SparkSession, d: str) -> DataFrame:
    return tp.ingest(table(spark, d, "documents")).select("doc_key", "doc_id", "content_hash", F.length("text").alias("n_chars"))


def id_collision_report(spark: SparkSession, d: str) -> DataFrame:
    return tp.id_collisions(table(spark, d, "documents"))


def incremental_pending(spark: SparkSession, d: str) -> DataFrame:
    return tb.pending(table(spark, d, "documents"), table(spark, d, "sentence_segmented"), ["doc_id"]).select("doc_id", "version")


def resume_scan(spark: SparkSession, d: str) -> DataFrame:
    return tb.resume(table(spark, d, "documents"), table(spark, d, "llm_is_a_edges_final"), ["doc_id"], "doc_id", after=1200, limit=100).select("doc_id", "manual_id")


def version_scan(spark: SparkSession, d: str) -> DataFrame:
    s = tb.version_scan(table(spark, d, "sentence_segmented"), 2, ["doc_id", "sent_idx"])
    return s.select("doc_id", "sent_idx", F.length("sentence").alias("n")).distinct()


def first_wins(spark: SparkSession, d: str) -> DataFrame:
    return tb.first_wins(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def last_wins(spark: SparkSession, d: str) -> DataFrame:
    return tb.last_wins(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return tb.insert_or_ignore(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def accumulate_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", F.lit(1).alias("freq_total"), F.floor("value").cast("long").alias("freq_docs"))
    return tb.accumulate(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "freq_total", "freq_docs", ["ts", "event_id"])


def line_classify(spark: SparkSession, d: str) -> DataFrame:
    return tp.classify_lines(table(spark, d, "documents")).select("doc_id", "pos", "action")


def line_classify_strict(spark: SparkSession, d: str) -> DataFrame:
    return tp.classify_lines(table(spark, d, "documents"), strict=True).select("doc_id", "pos", "action")


def repeated_headers(spark: SparkSession, d: str) -> DataFrame:
    t = tp.classify_lines(table(spark, d, "documents"), strict=True).where("action = 'repeated'")
    return t.groupBy("doc_id", "key").agg(F.count("*").alias("n"))


def clean_documents(spark: SparkSession, d: str) -> DataFrame:
    return tp.clean_documents(table(spark, d, "documents"))


def clean_documents_strict(spark: SparkSession, d: str) -> DataFrame:
    return tp.clean_documents(table(spark, d, "documents"), strict=True)


def sentence_problems(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sentence_segmented")
    return s.select(F.coalesce(tp.sentence_problem(F.col("sentence")), F.lit("none")).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    s = tp.emit_sentences(table(spark, d, "sentence_segmented"))
    return s.withColumn("start_char", F.coalesce("start_char", F.lit(-1)))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    c = tp.chunk(tp.emit_sentences(table(spark, d, "sentence_segmented")), max_tokens=100)
    return c.withColumn("start_char", F.coalesce("start_char", F.lit(-1)))


def case_transfer(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "term_candidates").select(F.explode(F.regexp_extract_all("term_text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", tp.transfer_case(F.col("word"), F.lower("word")).alias("cased"), tp.transfer_case(F.col("word"), F.reverse(F.lower("word"))).alias("mirrored"))


QUERIES = {
    f.__name__: f
    for f in (
        ingest_dedup, id_collision_report, incremental_pending, resume_scan, version_scan, first_wins, last_wins, insert_ignore, accumulate_upsert, line_classify, line_classify_strict,
        repeated_headers, clean_documents, clean_documents_strict, sentence_problems, sentences, chunks, case_transfer,
    )
}

_NORMAL = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?|[\x{85}\x{2028}\x{2029}\x{b}\x{c}\x{1c}-\x{1e}]', chr(10), 'g'), "
    r"'[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', ' ', 'g'), '[ \t]+', ' ', 'g'), ' +\n', chr(10), 'g'), '[ \n]+$', '')"
)
_KEY = f"trim(regexp_replace(replace(line, chr(65279), ''), '{BLANKS}', ' ', 'g'))"


def _cascade(strict: bool) -> str:
    m = lambda c, p: f"regexp_matches({c}, '{p}')"
    caps = m("key", wl.PRESERVE_CAPITALS if strict else wl.PRESERVE_WORDS)
    in_ = lambda words: ", ".join(f"'{w}'" for w in words)
    return f"""
with l0 as (select doc_id, generate_subscripts(a, 1) - 1 pos, unnest(a) line, len(a) n_all from (select doc_id, string_split(ltrim(text, chr(65279)), chr(10)) a from documents where text is not null)),
l1 as (select *, {_KEY} as key from l0),
l2 as (select *, case when key = '' then 0 else len(string_split(key, ' ')) end nw from l1),
l3 as (select *, coalesce(min(case when nw > 5 then pos end) over (partition by doc_id), 0) lead_ from l2),
l4 as (select *, n_all - lead_ n_lines, case when key <> '' then count(*) over (partition by doc_id, key) else 0 end cnt,
  ({m("lower(key)", "|".join(wl.PRESERVE))} or {caps}) pres, (key in ({in_(wl.STRUCTURAL_HEADERS)}) or {m("key", f"^{wl.either(wl.STRUCTURAL_HEADERS)}:")}) struct_ from l3 where pos >= lead_),
l5 as (select *, key <> '' and (pres or (not {m("key", wl.NAVIGATION_IN_LINE)} and {m("key", wl.CODE_SYMBOLS)})) tech,
  key = '' or {m("lower(key)", "|".join(wl.BOILERPLATE))} or (nw < 4 and (length(regexp_replace(key, '[^\\p{{L}}]', '', 'g')) / greatest(length(key), 1) < 0.6 or key in ({in_(wl.NAVIGATION_LINE)}))) boil from l4),
c as (select *, case when cnt >= case when n_lines < 50 then 2 when n_lines < 200 then 3 else 4 end and nw <= 15 and not struct_ and not pres then 'repeated'
  when {m("lower(key)", f"{wl.PRINT_COPYRIGHT}|{wl.PRINT_PAGE}")} then 'print' when tech then 'technical' when struct_ then 'structural' when boil then 'boilerplate' else 'keep' end as action from l5)
"""


def _clean(strict: bool) -> str:
    foot = f"regexp_matches(lower(key), '{wl.FOOTER}|{wl.PRINT_COPYRIGHT}|{wl.PRINT_PAGE}')"
    return (
        _cascade(strict)
        + f""", k0 as (select *, action in ('technical', 'structural', 'keep') stays from c),
k1 as (select *, max(case when stays and not {foot} then pos end) over (partition by doc_id) last_ from k0),
k2 as (select *, stays and pos <= coalesce(last_, -1) kept, replace(line, chr(65279), '') plain from k1),
g as (select doc_id, any_value(n_all) lines_total, any_value(lead_) lines_removed_leading, count(*) filter (action = 'repeated') lines_removed_repeated,
 count(*) filter (action in ('print', 'boilerplate') or (stays and not kept)) lines_removed_boilerplate, count(*) filter (action = 'technical') lines_technical_preserved,
 count(*) filter (action = 'structural') lines_structural_preserved, count(*) filter (stays) k, count(*) filter (kept and key <> '') full_, count(*) filter (key <> '') had, any_value(n_lines) n_lines,
 string_agg(case when action = 'structural' and not ends_with(key, ':') then regexp_replace(plain, '{BLANKS}$', '') || ':' else plain end, chr(10) order by pos) filter (kept) kept_text,
 string_agg(line, chr(10) order by pos) all_text from k2 group by 1)
select doc_id, regexp_replace(regexp_replace(case when full_ = 0 and had > 0 then all_text else coalesce(kept_text, '') end, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{BLANKS}|{BLANKS}$', '', 'g') cleaned_text,
 lines_total, lines_removed_leading, lines_removed_repeated, lines_removed_boilerplate, lines_technical_preserved, lines_structural_preserved,
 case when full_ = 0 and had > 0 then n_lines else k end lines_kept from g"""
    )


_S = f"trim(regexp_replace(sentence, '{BLANKS}', ' ', 'g'))"
_PROBLEM = f"""case when s = '' then 'empty' when length(s) > 800 or (length(s) < 10 and not (regexp_matches(s, '^\\p{{Lu}}') and regexp_matches(s, '[.!?]$'))) then 'length'
 when regexp_matches(lower(s), '{"|".join(wl.FRAGMENTS)}') then 'fragment' when not regexp_matches(s, '\\p{{L}}') then 'no_letter'
 when ends_with(s, ':') and len(string_split(s, ' ')) < 10 then 'colon' end"""
SENTENCES_SQL = f"""
sv as (select *, {_PROBLEM} problem from (select distinct doc_id, sent_idx old, sentence, start_char, end_char, {_S} s from sentence_segmented)),
sn as (select doc_id, row_number() over (partition by doc_id order by old, sentence, start_char nulls first)::int sent_idx, sentence, start_char, end_char, s from sv where problem is null),
sents as (select format('{{:d}}_sent_{{:05d}}', doc_id, sent_idx) sentence_id, * from sn)"""

ORACLE = {
    "ingest_dedup": f"""with t as (select doc_id, {_NORMAL} t from documents), h as (select *, sha256(t) h from t where trim(t) <> ''),
 r as (select *, 'doc_' || substr(h, 1, 16) k, row_number() over (partition by substr(h, 1, 16) order by doc_id) n from h) select k doc_key, doc_id, h content_hash, length(t) n_chars from r where n = 1""",
    "id_collision_report": f"""with h as (select distinct sha256({_NORMAL}) h from documents where text is not null), n as (select unnest([4, 8, 16]) id_hex)
 select id_hex, count(*) n_texts, count(distinct substr(h, 1, id_hex)) n_keys, count(*) - count(distinct substr(h, 1, id_hex)) n_lost from h, n group by 1""",
    "incremental_pending": "select doc_id, version from documents d where not exists (select 1 from sentence_segmented s where s.doc_id = d.doc_id)",
    "resume_scan": "select doc_id, manual_id from documents where doc_id > 1200 and doc_id not in (select doc_id from llm_is_a_edges_final where doc_id is not null) order by doc_id limit 100",
    "version_scan": "select distinct doc_id, sent_idx, length(sentence) n from sentence_segmented where cleaned_version = 2",
    "first_wins": "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) r from events) where r = 1",
    "last_wins": "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) r from events) where r = 1",
    "insert_ignore": """select user_id, event_type, event_id from events where event_id % 2 = 0 union all
 select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) r from events e where event_id % 2 = 1
  and not exists (select 1 from events o where o.event_id % 2 = 0 and o.user_id = e.user_id and o.event_type = e.event_type)) where r = 1""",
    "accumulate_upsert": """select user_id, event_type, count(*) freq_total, max(floor(value))::bigint freq_docs, arg_min(event_id, (event_id % 2, ts, event_id)) event_id, arg_min(ts, (event_id % 2, ts, event_id)) ts
 from events group by 1, 2""",
    "line_classify": _cascade(False) + "select doc_id, pos, action from c",
    "line_classify_strict": _cascade(True) + "select doc_id, pos, action from c",
    "repeated_headers": _cascade(True) + "select doc_id, key, count(*) n from c where action = 'repeated' group by 1, 2",
    "clean_documents": _clean(False),
    "clean_documents_strict": _clean(True),
    "sentence_problems": f"select coalesce({_PROBLEM}, 'none') problem, count(*) n from (select {_S} s from sentence_segmented) group by 1",
    "sentences": f"with {SENTENCES_SQL} select sentence_id, doc_id, sent_idx, sentence, coalesce(start_char, -1) start_char, end_char from sents",
    "chunks": f"""with recursive {SENTENCES_SQL},
 w as (select *, floor(len(list_filter(string_split(s, ' '), lambda x: x <> '')) * 1.3)::int t from sents),
 cu as (select *, sum(t) over (partition by doc_id order by sent_idx)::int cum from w),
 e as (select a.doc_id, a.sent_idx i, max(b.sent_idx) + 1 fin from cu a join cu b on a.doc_id = b.doc_id and b.sent_idx between a.sent_idx and a.sent_idx + 11
   and (b.sent_idx = a.sent_idx or b.cum - a.cum + a.t <= 100) group by 1, 2),
 p as (select doc_id, i, fin, 1 as num from e where i = 1 union all select e.doc_id, e.i, e.fin, p.num + 1 from p join e on e.doc_id = p.doc_id and e.i = greatest(p.fin - 1, p.i + 1))
 select format('{{:d}}_chunk_{{:04d}}', p.doc_id, num) chunk_id, p.doc_id, string_agg(sentence, ' ' order by sent_idx) "text", string_agg(sentence_id, ',' order by sent_idx) sentence_ids, count(*)::int num_sentences,
  coalesce(arg_min_null(start_char, sent_idx), -1) start_char, arg_max_null(end_char, sent_idx) end_char, sum(t)::int estimated_tokens
 from p join cu on cu.doc_id = p.doc_id and cu.sent_idx >= p.i and cu.sent_idx < p.fin group by p.doc_id, num""",
    "case_transfer": """with w as (select distinct unnest(regexp_extract_all(term_text, '[\\p{L}\\p{N}]+')) word from term_candidates where term_text is not null), x as (select word, lower(word) a, reverse(lower(word)) b from w)
 select word, """
    + ", ".join(
        f"""case when word = upper(word) and word <> lower(word) and regexp_matches(word, '\\p{{L}}') then upper({c}) when word[1] <> lower(word[1]) then upper({c}[1]) || lower({c}[2:])
 when word <> lower(word) and length(word) = length({c}) then array_to_string(list_transform(list_zip(string_split(word, ''), string_split({c}, '')), lambda p: case when p[1] <> lower(p[1]) then upper(p[2]) else p[2] end), '')
 else {c} end {n}"""
        for c, n in (("a", "cased"), ("b", "mirrored"))
    )
    + " from x",
}
