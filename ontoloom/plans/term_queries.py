"""Queries of term extraction and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions import word_lists as wl
from ontoloom.functions.text import BLANKS
from ontoloom.operators import terms as t
from ontoloom.session import materialise
from ontoloom.sources.tables import table


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return t.tokens(table(spark, d, "sentence_segmented"))


def pos_tags(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).groupBy("tag", "lemma").agg(F.count("*").alias("n"))


def np_runs(spark: SparkSession, d: str) -> DataFrame:
    return t.noun_runs(_tokens(spark, d))


def np_candidates(spark: SparkSession, d: str) -> DataFrame:
    return t.candidates(_tokens(spark, d))


def term_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return t.aggregate(t.candidates(_tokens(spark, d)), min_docs=2)


def term_tfidf(spark: SparkSession, d: str) -> DataFrame:
    c = materialise(t.candidates(_tokens(spark, d)), "candidates")  # read twice
    return t.tf_idf(t.aggregate(c), c).select("lemma", "n_tokens", "term_text", "freq_total", "freq_docs", F.round("idf", 6).alias("idf"), F.round("tf_idf", 6).alias("tf_idf"))


def top_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_tfidf(spark, d).orderBy(F.desc("tf_idf"), "lemma", "n_tokens").limit(20)


def tfidf_stats(spark: SparkSession, d: str) -> DataFrame:
    s = t.score_stats(table(spark, d, "term_candidates"), "tf_idf")
    return s.select("n", *(F.round(c, 6).alias(c) for c in s.columns if c != "n"))


def term_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "term_candidates").where("term_text is not null").select("term_text", F.lower("term_text").alias("l"), F.size(F.split("term_text", " ")).alias("n")).distinct()
    return x.select("term_text", F.coalesce(t.reject_reason(F.col("term_text"), F.col("l"), F.col("n")), F.lit("none")).alias("reason"))


def cli_flags(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "term_candidates").where("term_text is not null").select("term_id", "term_text").distinct()
    return x.select("term_id", "term_text", F.col("term_text").rlike(t.FLAG).alias("is_flag"), t.trim_digits(F.lower("term_text"), F.col("term_text").rlike(t.FLAG)).alias("trimmed"))


def pipe_split(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "taxonomy_is_a").where("child is not null and parent is not null").select(F.concat_ws(" | ", "child", "parent").alias("text")).distinct()
    return t.split_pipes(x.withColumn("lemma", F.lower("text"))).select("text", "lemma")


def artifact_class(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "llm_terms_final").where("term is not null").select("term").distinct()
    forms = F.array(*(F.concat(F.lit(a), F.replace("term", F.lit(" "), F.lit(b)), F.lit(c)) for a, b, c in (("", " ", ""), ("https://x/", "_", ""), ("/opt/", "/", ""), ("lib", "", ".so"), ("v0.0.43_openapi_", "_", "_resp"), ("key=", "", ""), ("a_", "_", "_b"))))
    return made.select(F.explode(forms).alias("term")).distinct().select("term", F.coalesce(t.artifact_class(F.col("term")), F.lit("none")).alias("artifact"), t.numeric_heavy(F.col("term")).alias("numeric"))


def llm_term_clean(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "llm_terms_final").select("term_id", "term").distinct()
    return x.select("term_id", F.coalesce(t.listed_term_problem(F.col("term")), F.lit("none")).alias("problem"))


def term_accumulate(spark: SparkSession, d: str) -> DataFrame:
    return t.accumulate_terms(table(spark, d, "llm_terms_final"))


QUERIES = {
    f.__name__: f
    for f in (pos_tags, np_runs, np_candidates, term_aggregate, term_tfidf, top_terms, tfidf_stats, term_reject_reasons, cli_flags, pipe_split, artifact_class, llm_term_clean, term_accumulate)
}


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


TOKENS_SQL = f"""
ts as (select doc_id, sent_idx, min(sentence) s from sentence_segmented group by 1, 2),
ta as (select doc_id, sent_idx, regexp_extract_all(s, {_q(t.TOKEN)}) a from ts where s is not null),
tt as (select doc_id, sent_idx, (generate_subscripts(a, 1) - 1)::int pos, unnest(a) tok from ta),
tg as (select *, lower(tok) low, case when regexp_matches(tok, {_q(t.FLAG)}) then 'X' when not regexp_matches(tok, '[\\p{{L}}\\p{{N}}]') then 'PUNCT' when regexp_matches(tok, '^[0-9][0-9.,]*$') then 'NUM'
 when lower(tok) in {_in(wl.DETERMINERS)} then 'DET' when lower(tok) in {_in(wl.ADPOSITIONS)} then 'ADP' when lower(tok) in {_in(wl.CONJUNCTIONS)} then 'CCONJ' when lower(tok) in {_in(wl.PRONOUNS)} then 'PRON'
 when lower(tok) in {_in(wl.AUXILIARIES)} then 'AUX' when lower(tok) in {_in(wl.VERBS)} then 'VERB' when lower(tok) in {_in(wl.ADVERBS)} or regexp_matches(lower(tok), '[a-z]{{2}}ly$') then 'ADV'
 when lower(tok) in {_in(wl.ADJECTIVES)} or regexp_matches(lower(tok), '[a-z]{{2}}(able|ible|al|ful|ic|ive|less|ous|ary)$') then 'ADJ' when regexp_matches(lower(tok), '[a-z]{{3}}(ize|ise|ify|ized|ised|ified)$') then 'VERB'
 when pos > 0 and regexp_matches(tok, '^\\p{{Lu}}') then 'PROPN' else 'NOUN' end tag from tt),
tk as (select doc_id, sent_idx, pos, tok, tag, case when tag in ('NOUN', 'PROPN') and length(low) > 3 and ends_with(low, 's') and not ends_with(low, 'ss') then low[:-2] else low end lemma from tg)"""
RUNS_SQL = (
    TOKENS_SQL
    + f""",
ri as (select *, tag not in ('ADJ', 'NOUN', 'PROPN') flag from tk where tag in ('ADJ', 'NOUN', 'PROPN') or regexp_matches(tok, {_q(t.FLAG)})),
rj as (select *, case when flag then pos else pos - row_number() over (partition by doc_id, sent_idx, flag order by pos) end island from ri),
runs as (select doc_id, sent_idx, min(pos)::int token_start, max(pos)::int token_end, string_agg(tok, ' ' order by pos) tx, string_agg(lemma, ' ' order by pos) lemma, arg_max(tag, pos) lt, bool_or(flag) fl
 from rj group by doc_id, sent_idx, flag, island having bool_or(flag) or arg_max(tag, pos) in ('NOUN', 'PROPN'))"""
)


def _split_sql(source: str) -> str:
    part = lambda c: f"list_filter(list_transform(string_split({c}, '|'), lambda x: trim(x, ' ')), lambda x: x <> '')"
    return f"""(select * exclude (tp, lp, tx, lemma, i), case when i = 0 then tx else tp[i] end tx, case when i = 0 then lemma else lp[i] end lemma from
 (select *, unnest(case when len(tp) = len(lp) and len(tp) > 1 then range(1, len(tp) + 1) else [0] end) i from (select *, {part("tx")} tp, {part("lemma")} lp from {source})))"""


def _edge_sql(c: str) -> str:
    return f"""case when regexp_matches({c}, {_q(t.FLAG)}) then [{c}] else list_filter(list_transform(string_split({c}, ' '), lambda x, i: case when i = 1 or i = len(string_split({c}, ' '))
 then regexp_replace(x, {_q(t.EDGE)}, '', 'g') else x end), lambda x: x <> '') end"""


def _reason(tx: str, lem: str, n: str) -> str:
    flag = f"regexp_matches({tx}, {_q(t.FLAG)})"
    comp = f"replace({tx}, ' ', '')"
    letters = f"length(regexp_replace({comp}, '[^\\p{{L}}]', '', 'g'))"
    return f"""case when regexp_matches({comp}, '^[|/\\\\_=+*~-]*$') then 'symbols' when {letters} = 0 then 'no_letter' when {letters} / length({comp}) < 0.4 then 'few_letters'
 when regexp_matches({tx}, '[<>(){{}}\\[\\]]') then 'brackets' when {n} > 3 then 'tokens' when length({lem}) > 60 then 'chars' when regexp_matches({lem}, 'http|www\\.|copyright') then 'noise'
 when {n} = 1 and {lem} in {_in(wl.STOP_WORDS)} then 'stop_word' when {n} = 1 and length({lem}) < 3 and not {flag} then 'short' when regexp_matches({lem}, '^[!-/:-@\\[-`{{-~ ]*[0-9]+[!-/:-@\\[-`{{-~ ]*$') then 'digits'
 when regexp_matches({lem}, '[0-9]{{3}}') then 'digit_run' when contains({lem}, '=') and not {flag} then 'assignment' when starts_with({lem}, '-') and not {flag} then 'dash' when ends_with({lem}, '?') then 'question' end"""


def _cut(tx: str, lem: str) -> str:
    base = f"trim(regexp_replace({lem}, '[0-9]+$', ''), ' ')"
    return f"case when not regexp_matches({tx}, {_q(t.FLAG)}) and regexp_matches({lem}, '[0-9]$') and length({base}) >= 3 and not regexp_matches(replace({base}, ' ', ''), '^[0-9]+$') then {base} else {lem} end"


CANDIDATES_SQL = (
    RUNS_SQL
    + f""",
c1 as (select doc_id, sent_idx, token_start, token_end, {_edge_sql("tx")} ta0, {_edge_sql("lemma")} la0 from {_split_sql("runs")}),
c2 as (select *, ta0[:least(len(ta0), len(la0))] ta1, la0[:least(len(ta0), len(la0))] la1 from c1),
c3 as (select *, list_filter(range(1, len(la1) + 1), lambda i: la1[i] not in {_in(wl.STOP_WORDS)}) keep from c2),
c4 as (select *, case when len(keep) > 0 then keep[1] else greatest(1, len(la1)) end lo, case when len(keep) > 0 then keep[-1] else greatest(1, len(la1)) end hi from c3),
c5 as (select doc_id, sent_idx, token_start, token_end, array_to_string(ta1[lo:hi], ' ') tx, array_to_string(la1[lo:hi], ' ') lemma, len(ta1[lo:hi]) n from c4),
c6 as (select *, {_cut("tx", "lemma")} cut from c5 where lemma <> '' and {_reason("tx", "lemma", "n")} is null),
c7 as (select doc_id, sent_idx, token_start, token_end, case when cut <> lemma then trim(regexp_replace(tx, '[0-9]+$', '')) else tx end tx, cut lemma from c6),
c8 as (select *, len(string_split(tx, ' '))::int n_tokens, row_number() over (partition by doc_id, sent_idx, lemma order by token_start, token_end, tx, len(string_split(tx, ' '))) r from c7),
cands as (select doc_id, sent_idx, token_start, token_end, tx, lemma, n_tokens from c8 where r = 1),
agg as (select lemma, n_tokens, arg_min(tx, (doc_id, sent_idx, token_start, tx)) term_text, count(*) freq_total, count(distinct doc_id) freq_docs from cands group by 1, 2),
nd as (select count(distinct doc_id) n from cands),
scored as (select agg.*, round(ln((n + 1) / (freq_docs + 1)) + 1, 6) idf, round(case when n_tokens > 3 then 0 else freq_total * (ln((n + 1) / (freq_docs + 1)) + 1) end, 6) tf_idf from agg, nd)"""
)

_ARTIFACT = f"""case when trim(term) = '' then 'empty' when trim(term) in {_in(wl.ACCELERATORS)} or regexp_matches(trim(term), '^[AHVP][0-9]{{3}}$') then null
 when regexp_matches(lower(trim(term)), '^(https?://|ftp://)') then 'url'
 when regexp_matches(trim(term), '^(/|\\./|\\.\\./|~|\\\\\\\\|[A-Za-z]:\\\\)') or (regexp_matches(trim(term), '[/\\\\]') and (len(list_filter(regexp_split_to_array(trim(term), '[/\\\\]+'), lambda x: x <> '')) >= 3
  or regexp_matches(lower(regexp_split_to_array(trim(term), '[/\\\\]')[-1]), '\\.({"|".join(wl.ARTIFACT_ENDINGS)})$'))) then 'path'
 when regexp_matches(lower(regexp_split_to_array(trim(term), '[/\\\\]')[-1]), '\\.({"|".join(wl.ARTIFACT_ENDINGS)})$') then 'binary'
 when regexp_matches(lower(trim(term)), '^v[0-9]+(\\.[0-9]+){{1,4}}[_/].*(openapi|swagger)') or (regexp_matches(lower(trim(term)), '(^|[^a-z0-9_])openapi($|[^a-z0-9_])') and
  (regexp_matches(lower(trim(term)), '_(resp|request|response|msg|desc|body|params?)($|[^a-z0-9_])') or regexp_matches(trim(term), '^[vV][0-9]+(\\.[0-9]+){{1,4}}'))) then 'openapi'
 when regexp_matches(trim(term), '^[A-Za-z]+V[0-9]{{3,}}[A-Za-z].') then 'method' when regexp_matches(trim(term), '^[A-Za-z_][A-Za-z0-9_]*\\s*=\\s*.') then 'assignment'
 when regexp_matches(trim(term), '^[A-Za-z0-9]+([_/.-][A-Za-z0-9]+){{2,}}$') then 'symbol' end"""
_NUMERIC = f"""(trim(term) = '' or (regexp_matches(term, '[0-9]') and (length(regexp_replace(term, '[^0-9]', '', 'g')) > length(regexp_replace(term, '[^\\p{{L}}]', '', 'g')) or regexp_matches(trim(term), '^[0-9]')
 or regexp_matches(lower(trim(term)), '(^|[^\\p{{L}}\\p{{N}}_])[0-9]+(\\.[0-9]+)?\\s*({"|".join(wl.UNITS)})($|[^\\p{{L}}\\p{{N}}_])'))))"""
_WORDS_OF = f"list_filter(string_split(lower(trim(regexp_replace(term, '{BLANKS}', ' ', 'g'))), ' '), lambda x: x <> '')"
_LISTED = f"""case when term is null or ({_ARTIFACT}) is not null then 'artifact' when length(regexp_replace(term, '[^\\p{{L}}]', '', 'g')) < 3 then 'letters' when {_NUMERIC} then 'numeric'
 when length(regexp_replace(trim(term), '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) / greatest(length(trim(term)), 1) >= 0.5 then 'punctuation'
 when len({_WORDS_OF}) = 0 or lower(trim(term)) in {_in(wl.STOP_WORDS)} or (len({_WORDS_OF}) >= 2 and len(list_filter({_WORDS_OF}, lambda x: x not in {_in(wl.STOP_WORDS)})) = 0) then 'generic' end"""

ORACLE = {
    "pos_tags": f"with {TOKENS_SQL} select tag, lemma, count(*) n from tk group by 1, 2",
    "np_runs": f'with {RUNS_SQL} select doc_id, sent_idx, token_start, token_end, tx "text", lemma from runs',
    "np_candidates": f'with {CANDIDATES_SQL} select doc_id, sent_idx, token_start, token_end, tx "text", lemma, n_tokens from cands',
    "term_aggregate": f"with {CANDIDATES_SQL} select * from agg where freq_docs >= 2",
    "term_tfidf": f"with {CANDIDATES_SQL} select * from scored",
    "top_terms": f"with {CANDIDATES_SQL} select * from scored order by tf_idf desc, lemma, n_tokens limit 20",
    "tfidf_stats": """select count(tf_idf) n, round(min(tf_idf), 6) least, round(quantile_cont(tf_idf, 0.5), 6) median, round(avg(tf_idf), 6) mean, round(quantile_cont(tf_idf, 0.9), 6) p90,
 round(quantile_cont(tf_idf, 0.95), 6) p95, round(max(tf_idf), 6) most from term_candidates""",
    "term_reject_reasons": f"""select distinct term_text, coalesce({_reason("term_text", "lower(term_text)", "len(string_split(term_text, ' '))")}, 'none') reason from term_candidates where term_text is not null""",
    "cli_flags": f"select distinct term_id, term_text, regexp_matches(term_text, {_q(t.FLAG)}) is_flag, {_cut('term_text', 'lower(term_text)')} trimmed from term_candidates where term_text is not null",
    "pipe_split": f"""with r as (select distinct child || ' | ' || parent tx, lower(child || ' | ' || parent) lemma from taxonomy_is_a where child is not null and parent is not null) select tx "text", lemma from {_split_sql("r")}""",
    "artifact_class": f"""with m as (select distinct term from llm_terms_final where term is not null), f as (select distinct unnest([term, 'https://x/' || replace(term, ' ', '_'), '/opt/' || replace(term, ' ', '/'),
 'lib' || replace(term, ' ', '') || '.so', 'v0.0.43_openapi_' || replace(term, ' ', '_') || '_resp', 'key=' || replace(term, ' ', ''), 'a_' || replace(term, ' ', '_') || '_b']) term from m)
 select term, coalesce({_ARTIFACT}, 'none') artifact, {_NUMERIC} as "numeric" from f""",
    "llm_term_clean": f"select distinct term_id, coalesce({_LISTED}, 'none') problem from (select distinct term_id, term from llm_terms_final)",
    "term_accumulate": f"""with x as (select distinct trim(term) t, doc_id, chunk_id from llm_terms_final where ({_LISTED}) is null)
 select t term, arg_min(doc_id, (doc_id, chunk_id)) doc_id, arg_min(chunk_id, (doc_id, chunk_id)) chunk_id, count(*) freq_total from x group by 1""",
}
