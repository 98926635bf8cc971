"""Queries of the llm subpackage, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions.text import label_key_sql
from ontoloom.llm import format_duplicates, frequencies, languages, mixing, neighbours, packing, sentences
from ontoloom.sources.tables import table


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    return frequencies.term_frequencies(table(spark, d, "term_occurrences"), table(spark, d, "term_candidates"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d).where("too_rare or too_common").select("term_lemma")


def p1_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    scores = frequencies.distinctiveness(table(spark, d, "term_occurrences"), table(spark, d, "term_candidates"), top=3)
    return scores.select("doc_id", "term_lemma")


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = frequencies.distinctiveness(table(spark, d, "term_occurrences"), table(spark, d, "term_candidates"))
    return scores.select("doc_id", "term_lemma", "n", "freq_docs", F.round("idf", 6).alias("idf"), F.round("score", 6).alias("score"))


def p2_elite(spark: SparkSession, d: str) -> DataFrame:
    scores = frequencies.distinctiveness(table(spark, d, "term_occurrences"), table(spark, d, "term_candidates"))
    return scores.select("doc_id", "term_lemma", "n", "freq_docs", "score", "elite_p", "rank")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, text in (("term_candidates", "term_text"), ("llm_terms_final", "term")):
        c = format_duplicates.collapse(table(spark, d, name), "term_id", [text])
        parts.append(c.where("id <> keep_id").select(F.lit(name).alias("tbl"), "keep_id", F.col("id").alias("copy_id")))
    return parts[0].unionByName(parts[1])


def p4_unique(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        format_duplicates.unique(table(spark, d, name), "term_id", [text]).withColumn("tbl", F.lit(name))
        for name, text in (("term_candidates", "term_text"), ("llm_terms_final", "term"))
    ]
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.segment(table(spark, d, "documents")).select("doc_id", "start_char", "end_char")


def p6_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.segment(table(spark, d, "documents"))


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "term_vectors"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.pairs(_nearest(spark, d)).select(F.col("a").alias("term_id"), F.col("b").alias("neighbor_term_id"))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.exact_nearest(table(spark, d, "term_vectors"))
    return near.select(F.col("id").alias("term_id"), F.col("neighbour").alias("neighbor_term_id"), "similarity", "rank")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.pack(table(spark, d, "documents")))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, d, "documents"), targets), targets)


def _stretches(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return languages.language_stretches(docs, languages.fit(docs))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _stretches(spark, d).select("doc_id", "start_char", "lang")


def p10_stretches(spark: SparkSession, d: str) -> DataFrame:
    return _stretches(spark, d)


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    return languages.document_languages(_stretches(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_frequencies, p2_found, p2_scores, p2_elite, p4_found, p4_unique, p5_found, p5_neighbours, p6_found, p6_sentences,
        p8_pack, p8_fill, p9_mix, p9_shares, p10_found, p10_stretches, p10_documents,
    )
}

_OCCURRENCES = f"""
with c as (select distinct term_id, {label_key_sql("term_lemma")} lemma from term_candidates),
o as (select distinct lemma, doc_id, sent_idx, token_start, token_end from term_occurrences join c using (term_id) where lemma is not null and doc_id is not null),
f as (select lemma, count(*) freq_total, count(distinct doc_id) freq_docs from o group by 1),
n as (select count(distinct doc_id) n from o),
l as (select lemma term_lemma, count(distinct term_id) n_term_ids from c where lemma is not null group by 1),
q as (select term_lemma, n_term_ids, coalesce(freq_total, 0) freq_total, coalesce(freq_docs, 0) freq_docs,
  coalesce(freq_docs, 0) < 3 too_rare, coalesce(freq_docs, 0) > 0.08 * n too_common from l left join f on lemma = term_lemma, n),
s as (select doc_id, o.lemma term_lemma, count(*) n, any_value(freq_docs) freq_docs, any_value(ln((n.n + 1) / (freq_docs + 1)) + 1) idf
  from o join f using (lemma), n group by 1, 2),
r as (select *, row_number() over (partition by doc_id order by n * idf desc, term_lemma) as rk from s)
"""


def _same_words(name: str, text: str) -> str:
    words = f"list_sort(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{M}}]*'))"
    return f"select distinct '{name}' tbl, term_id, {words} w from {name} where {text} is not null and term_id is not null and len({words}) > 0"


_WORDS = f"with t as ({_same_words('term_candidates', 'term_text')} union all {_same_words('llm_terms_final', 'term')}), g as (select tbl, w, min(term_id) keep_id, count(distinct term_id) n_copies from t group by 1, 2) "

_NEAREST = """
with v as (select term_id id, min(vec)::double[100] vec from term_vectors
  where term_id is not null and len(vec) = 100 and len(list_filter(vec, lambda x: x is null or isnan(x))) = 0 and len(list_filter(vec, lambda x: x <> 0)) > 0 group by 1),
p as (select x.id a, y.id b, round(array_cosine_similarity(x.vec, y.vec), 6) s from v x join v y on x.id <> y.id),
r as (select a, b, s, row_number() over (partition by a order by s desc, b) rk from p)
"""

ORACLE = {
    "p1_found": _OCCURRENCES + "select term_lemma from q where too_rare or too_common",
    "p1_frequencies": _OCCURRENCES + "select * from q",
    "p2_found": _OCCURRENCES + "select doc_id, term_lemma from r where rk <= 3",
    "p2_scores": _OCCURRENCES + "select doc_id, term_lemma, n, freq_docs, round(idf, 6) idf, round(n * idf, 6) score from r",
    "p4_found": _WORDS + "select tbl, keep_id, term_id copy_id from t join g using (tbl, w) where term_id <> keep_id",
    "p4_unique": _WORDS + "select tbl, keep_id, n_copies from g",
    "p5_found": _NEAREST + "select distinct least(a, b) term_id, greatest(a, b) neighbor_term_id from r where rk <= 10 and s >= 0.8",
    "p5_neighbours": _NEAREST + "select a term_id, b neighbor_term_id, round(s, 6) similarity, rk as rank from r where rk <= 10",
}
