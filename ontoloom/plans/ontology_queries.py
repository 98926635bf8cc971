"""Queries of enrichment, neighbours and is-a links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions import word_lists as wl
from ontoloom.functions.text import BLANKS, label_key, label_key_sql, last
from ontoloom.operators import enrich as e
from ontoloom.operators import knn as v
from ontoloom.operators import tables as tb
from ontoloom.operators import taxonomy as x
from ontoloom.operators import terms as t
from ontoloom.plans.term_queries import _in
from ontoloom.sources.tables import table


def technical_tokens(spark: SparkSession, d: str) -> DataFrame:
    plain = table(spark, d, "term_candidates").where("term_text is not null")
    a = plain.select(F.explode(F.array("term_text", F.upper(F.replace("term_text", F.lit(" "), F.lit("_"))), F.concat("term_text", F.lit(".cfg")))).alias("term"))
    a = a.union(table(spark, d, "nation").select("n_name")).union(spark.createDataFrame([("sbatch",), ("SRUN",), ("slurm node",), (" ",)], "term string")).distinct()
    return a.select("term", F.coalesce(e.term_type(F.col("term")), F.lit("none")).alias("term_type"), e.is_technical(F.col("term")).alias("technical"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return e.canonical_groups(table(spark, d, "term_candidates").where("term_text is not null"), min_tf_idf=1.0)


def canonical_groups(spark: SparkSession, d: str) -> DataFrame:
    g = _groups(spark, d)
    return g.select(
        "canonical_id", "canonical_term", F.coalesce("term_type", F.lit("none")).alias("term_type"), F.array_join(F.transform("member_term_ids", lambda i: i.cast("string")), ",").alias("members"),
        F.array_join("synonyms", ";").alias("synonyms"), F.array_join("abbreviations", ";").alias("abbreviations"), "representative", "freq_total", "freq_docs", F.round("tf_idf", 4).alias("tf_idf"),
    )


def generic_score(spark: SparkSession, d: str) -> DataFrame:
    return e.generic_score(_groups(spark, d)).select("canonical_id", "generic_score", "is_generic", F.array_join("reasons", ",").alias("reasons"))


def specific_terms(spark: SparkSession, d: str) -> DataFrame:
    return e.select_specific(table(spark, d, "term_enrichment").select("canonical_id", "canonical_term", "generic_score", "is_generic").distinct()).select("canonical_id", "canonical_term")


def suffix_canonical(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select(F.explode(F.split(F.regexp_replace("text", "[^A-Za-z0-9_.|/-]+", " "), " ")).alias("term")).where("term <> ''").distinct()
    return a.select("term", e.suffix_canonical(F.col("term")).alias("canonical"))


def evidence_sentences(spark: SparkSession, d: str) -> DataFrame:
    return e.evidence(table(spark, d, "term_occurrences"), table(spark, d, "sentence_segmented")).select("term_id", "doc_id", "sent_idx", "rank", F.length("sentence").alias("n"))


def _definitions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.col("p_name").alias("term"), F.concat(F.lit("The slurm "), F.lower("p_type"), F.lit(" "), F.col("p_name"), F.lit(" of queue used for jobs. It runs.")).alias("definition"), (F.col("p_size") / 50).alias("confidence"))


def definition_heads(spark: SparkSession, d: str) -> DataFrame:
    p = _definitions(spark, d)
    own = F.concat(F.lit("A "), F.lower("term"), F.lit(" for"))
    return p.select("p_partkey", F.coalesce(e.definition_head(F.col("definition")), F.lit("none")).alias("head"), F.coalesce(e.definition_head(own, 240, x.BAD_PARENTS, False), F.lit("none")).alias("strict_head"))


def parent_scores(spark: SparkSession, d: str) -> DataFrame:
    s = e.parent_scores(_definitions(spark, d))
    return s.select("parent_term", F.round("score", 3).alias("score"), "class_support", "def_support", "parent_type")


def pending_enrich(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "term_enrichment").select(F.col("canonical_id").alias("term_id"))
    return tb.delete_below(tb.pending(table(spark, d, "term_candidates"), done, ["term_id"]), "freq_total", 2).select("term_id", "term_lemma").distinct()


def context_lookup(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "llm_terms_final").select("term_id", "doc_id", "chunk_id").distinct()
    b = table(spark, d, "llm_is_a_edges_final").select("edge_id", "doc_id", "chunk_id").distinct()
    return a.join(b, ["doc_id", "chunk_id"]).groupBy("term_id").agg(F.count("*").alias("n_edges"))


def label_validate(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    good = F.to_json(F.struct(F.when(F.col("event_id") % 5 == 0, "CLASS ").otherwise(F.col("event_type")).alias("ontology_role"), F.round(F.col("value") / 10, 3).alias("confidence"), F.when(F.col("event_id") % 2 == 0, "Yes").otherwise("false").alias("is_hpc_domain_term")))
    raw = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("Answer: "), good)).otherwise(good)
    r = e.validate_labels(ev.select("event_id", raw.alias("raw")))
    return r.select("event_id", "valid", "ontology_role", "is_domain", F.round("confidence", 6).alias("confidence"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    a = _vectors(spark, d)
    return v.exact_top_k(a, a, k=5).select("id", "neighbour", F.round("similarity", 4).alias("similarity"), "rank")


def similarity_curve(spark: SparkSession, d: str) -> DataFrame:
    s = v.similarity_curve(table(spark, d, "skipgram_neighbors"), (1, 2, 3, 5))
    return s.select("rank", "n", *(F.round(c, 6).alias(c) for c in ("mean", "least", "most")))


def knee_proxy(spark: SparkSession, d: str) -> DataFrame:
    return v.knee(table(spark, d, "skipgram_neighbors"), 2, 5).select("n", F.round("fall", 6).alias("fall"))


def eligible_rate(spark: SparkSession, d: str) -> DataFrame:
    el = table(spark, d, "term_enrichment").where("is_generic = 0").select(F.col("canonical_id").alias("term_id"))
    return v.eligible_rate(table(spark, d, "skipgram_neighbors"), el).select("k", "n", F.round("rate", 6).alias("rate"))


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "term_candidates").select("term_id", label_key(F.col("term_lemma")).alias("k")).distinct()
    # most labels of the taxonomy are no candidates; the last word of a lemma stands in for a parent
    return c.where("k is not null").select("term_id", last(F.split("k", " ")).alias("parent"))


def sibling_rate(spark: SparkSession, d: str) -> DataFrame:
    return v.sibling_rate(table(spark, d, "skipgram_neighbors"), _seeds(spark, d)).select("k", "n", F.round("rate", 6).alias("rate"))


def embedding_coverage(spark: SparkSession, d: str) -> DataFrame:
    return v.coverage(table(spark, d, "term_candidates"), table(spark, d, "skipgram_neighbors")).select("n_terms", "n_covered", F.round("percent", 6).alias("percent"))


def phrase_vectors(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("term_id"), F.concat("p_name", F.lit(" unknownword")).alias("term"))
    w = table(spark, d, "embeddings").groupBy("label").agg(F.min("vec_id").alias("vec_id")).join(table(spark, d, "embeddings").drop("label"), "vec_id")
    names = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    words = names.join(w, F.length("word") == w["label"], "left").select("word", "embedding").withColumnRenamed("embedding", "vec").where("vec is not null")
    r = v.phrase_vectors(p, words)
    return r.select("term_id", F.coalesce("reason", F.lit("ok")).alias("reason"), "n_known", F.round(F.coalesce(F.get("vec", F.lit(0)), F.lit(0.0)), 5).alias("v0"))


def skipgram_train(spark: SparkSession, d: str) -> DataFrame:
    c = v.corpus(t.tokens(table(spark, d, "sentence_segmented")))
    return v.train_skipgram(c, dim=32).getVectors().select("word", F.lit(32).alias("dim"))


def head_match(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_name").alias("term"))
    kids = p.union(table(spark, d, "term_candidates").select("term_lemma"))
    heads = kids.where("term is not null").select(last(x.words(F.col("term"))).alias("term")).where("term is not null")
    return x.head_match(kids.where("term is not null"), heads)


def _made_sentences(spark: SparkSession, d: str) -> DataFrame:
    ed = table(spark, d, "llm_is_a_edges_final").where("child_term is not null and parent_term is not null").select("edge_id", "doc_id", "child_term", "parent_term").distinct()
    c, p, n = F.col("child_term"), F.col("parent_term"), F.col("edge_id") % 3
    s = F.when(n == 0, F.concat(F.lit("Here, "), c, F.lit(" is a "), p, F.lit(" now."))).when(n == 1, F.concat(F.lit("We like "), c, F.lit(" and other "), p, F.lit("."))).otherwise(F.concat(p, F.lit(" such as "), c))
    return ed.select("doc_id", F.col("edge_id").alias("sent_idx"), s.alias("sentence"))


def hearst_isa(spark: SparkSession, d: str) -> DataFrame:
    return x.hearst(_made_sentences(spark, d), table(spark, d, "llm_terms_final").select("term"))


def embed_expand(spark: SparkSession, d: str) -> DataFrame:
    el = table(spark, d, "term_enrichment").where("is_generic = 0").select(F.col("canonical_id").alias("term_id"))
    return x.expand_by_neighbours(_seeds(spark, d), table(spark, d, "skipgram_neighbors"), el).select("child_id", "parent", F.round("similarity", 6).alias("similarity"))


def edge_union(spark: SparkSession, d: str) -> DataFrame:
    ed = table(spark, d, "taxonomy_is_a").select(label_key(F.col("child")).alias("child"), label_key(F.col("parent")).alias("parent"), "method", F.coalesce("evidence", F.lit("")).alias("evidence"))
    ed = ed.where("child is not null and parent is not null and child <> parent")
    return tb.last_wins(ed, ["child", "parent", "method"], ["evidence"])


def edge_evidence(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "documents").where("title is not null").select(F.trim(F.regexp_replace(F.lower("title"), "^[0-9.]+ ", "")).alias("child")).distinct()
    ed = titles.select("child", F.concat(F.lit("the "), last(F.split("child", " "))).alias("parent"))
    return x.edge_evidence(ed, table(spark, d, "sentence_segmented"))


def top_parents(spark: SparkSession, d: str) -> DataFrame:
    return x.top_parents(table(spark, d, "taxonomy_is_a").where("trim(parent) <> ''"))


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return x.candidate_lists(table(spark, d, "taxonomy_is_a").where("child is not null and trim(parent) <> ''"))


def candidate_list(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("child", "parent", F.array_join("candidates", "|").alias("candidates"))


def verdict_rules(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("child")
    r = _lists(spark, d).select(
        "child", "parent", "candidates", F.when(n % 4 == 0, "nowhere").when(n % 4 == 1, "none").otherwise(F.col("parent")).alias("best_parent"), (n % 5 != 0).alias("accept"), (n / 60).alias("confidence"),
        (n % 7 != 0).alias("child_is_class"), F.lit(True).alias("parent_is_class"), (n % 3 != 0).alias("is_a_valid"),
    )
    return x.apply_verdicts(r).select("child", "parent", "accept", F.round("confidence", 6).alias("confidence"))


def _chunk_candidates(spark: SparkSession, d: str, strict: bool = False) -> DataFrame:
    lab = table(spark, d, "term_enrichment").groupBy("canonical_id").agg(F.min("is_generic").alias("g"), F.min(F.coalesce("term_type", F.lit("class"))).alias("c"))
    # the labels stand for listed terms by their distance from the first candidate id
    lab = lab.select((F.col("canonical_id") - 5000).alias("term_id"), F.col("canonical_id").alias("label_id"), (F.col("g") == 0).alias("is_domain"), F.when(F.col("c") == "file", "drop").otherwise("class").alias("role"), F.col("c").alias("category"))
    return x.chunk_candidates(table(spark, d, "llm_terms_final").where("term is not null"), lab, ["class", "config"], strict=strict)


def chunk_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _chunk_candidates(spark, d)


def relation_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _chunk_candidates(spark, d, strict=True)


def indexed_edges(spark: SparkSession, d: str) -> DataFrame:
    c = _chunk_candidates(spark, d)
    raw = F.when(F.col("doc_id") % 9 == 0, "no json").otherwise('{"is_a_edges": [{"child_idx": 0, "parent_idx": 1}, {"child_idx": 0, "parent_idx": 1}, {"child_idx": 1, "parent_idx": 1}, {"child_idx": 2, "parent_idx": 99}]}')
    return x.indexed_edges(c.select("doc_id", "chunk_id").distinct().withColumn("raw", raw), c)


QUERIES = {
    f.__name__: f
    for f in (
        technical_tokens, canonical_groups, generic_score, specific_terms, suffix_canonical, evidence_sentences, definition_heads, parent_scores, pending_enrich, context_lookup, label_validate, knn_topk,
        similarity_curve, knee_proxy, eligible_rate, sibling_rate, embedding_coverage, phrase_vectors, skipgram_train, head_match, hearst_isa, embed_expand, edge_union, edge_evidence, top_parents,
        candidate_list, verdict_rules, chunk_candidates, relation_candidates, indexed_edges,
    )
}


def _type(c: str) -> str:
    return f"case when regexp_matches(trim({c}, ' '), '{e.CAPITALS}') and contains({c}, '_') then 'config' when regexp_matches(lower(trim({c}, ' ')), '\\.(conf|cfg|ini)$') then 'file' when lower(trim({c}, ' ')) in {_in(wl.SCHEDULER_COMMANDS)} then 'command' end"


def _technical(c: str) -> str:
    return f"(trim({c}, ' ') <> '' and (({_type(c)}) is not null or contains(lower({c}), 'slurm') or contains(lower({c}), 'lsf')))"


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{BLANKS}', ' ', 'g'), ' ')"


_GROUPS = f"""
with g0 as (select distinct term_id, term_text, term_lemma, freq_total, freq_docs, tf_idf from term_candidates where term_text is not null),
g1 as (select *, {_squeeze("term_text")} xt, lower({_squeeze("case when coalesce(" + _squeeze("term_lemma") + ", '') <> '' then term_lemma else term_text end")}) low from g0 where tf_idf >= 1.0 or {_technical("term_text")}),
g2 as (select *, trim(regexp_replace(case when regexp_matches(string_split(xt, ' ')[1], '{e.CAPITALS}') then low else {_squeeze("regexp_replace(low, '[-/.]+', ' ', 'g')")} end, '^({wl.either(wl.LIGHT_PREFIXES)}( |$))+', ''), ' ') as key from g1),
g3 as (select *, case when regexp_matches(key, '{e.CAPITALS}') then upper(key) else key end canonical_term from g2 where key <> ''),
g as (select canonical_term, min(term_id) canonical_id, list_sort(list(distinct term_id)) ids, list_sort(list(distinct xt)) xs, sum(freq_total)::bigint freq_total, max(freq_docs) freq_docs, sum(tf_idf) tf_idf from g3 group by 1),
h as (select *, {_type("canonical_term")} term_type, string_split(lower(trim(canonical_term, ' ')), ' ')[-1] head from g)"""
_ANCHOR = lambda c: f"(regexp_matches(lower({c}), '{'|'.join(wl.ANCHORS)}') or {_technical(c)})"
_SIGNALS = [
    ("head", 2.0, f"head in {_in(wl.GENERIC_HEADS)}"), ("short", 1.0, f"not contains(trim(canonical_term, ' '), ' ') and length(trim(canonical_term, ' ')) <= 6 and head in {_in(wl.GENERIC_HEADS)}"),
    ("no_anchor", 2.0, f"not (len(list_filter(xs, lambda q: {_ANCHOR('q')})) > 0 or {_ANCHOR('canonical_term')})"), ("spread", 1.5, "freq_docs >= 20 and tf_idf < 5"),
    ("abstract", 2.5, "head in ('information', 'data', 'datum')"), ("technical", -1.5, "term_type is not null"),
]
_SCORE = " + ".join(f"case when {c} then {s}::double else 0 end" for _, s, c in _SIGNALS)
_SUFFIX = """case when length(z) <= 3 or regexp_matches(z, '^-|[0-9/\\\\.]') then z when length(z) > 5 and ends_with(z, 'ing') then z[:-4] when length(z) > 4 and ends_with(z, 'ed') then z[:-3]
 when length(z) > 4 and ends_with(z, 'es') then z[:-3] when length(z) > 4 and ends_with(z, 's') then z[:-2] else z end"""


def _head(defn: str, limit: int, bad: list[str], use_map: bool) -> str:
    """A select of key and head from a frame (k, defn)."""
    mapped = "case phrase " + " ".join(f"when '{a}' then '{b}'" for a, b in wl.PARENT_MAP.items()) + " else phrase end"
    return f"""select k, coalesce({mapped if use_map else "case when length(phrase) >= 3 then phrase end"}, 'none') h from (select k, case when len(w2) > 0 and array_to_string(w2[greatest(1, len(w2) - 2):], ' ') not in {_in(bad)} then array_to_string(w2[greatest(1, len(w2) - 2):], ' ') end phrase
 from (select k, case when w[-1] in {_in(wl.TAIL_PREPOSITIONS)} then w[:-2] else w end w2 from (select k, list_filter(string_split({_squeeze("regexp_replace(h0, '[^a-z0-9_ -]', ' ', 'g')")}, ' '),
 lambda q: q <> '' and q not in {_in([*wl.DETERMINERS[:8], *wl.SCHEDULERS])}) w from (select k, regexp_replace(regexp_extract(lower({_squeeze("defn")}), '^(?:a|an|the) ([^.]{{1,{limit}}})', 1), '(^|[^a-z0-9_]){wl.either(wl.CLAUSE_WORDS)}($|[^a-z0-9_]).*$', '') h0 from ({defn})))))"""


_DEFS = "select p_partkey k, 'The slurm ' || lower(p_type) || ' ' || p_name || ' of queue used for jobs. It runs.' defn from part"
_OWN = "select p_partkey k, 'A ' || lower(p_name) || ' for' defn from part"
_RANKED = """with nb as (select term_id, neighbor_term_id, max(similarity) similarity from skipgram_neighbors group by 1, 2),
rk as (select *, row_number() over (partition by term_id order by similarity desc, neighbor_term_id) r from nb)"""
_ELIGIBLE = "el as (select distinct canonical_id term_id from term_enrichment where is_generic = 0)"
_SEEDS = f"sd as (select distinct term_id, string_split({label_key_sql('term_lemma')}, ' ')[-1] parent from term_candidates where {label_key_sql('term_lemma')} is not null)"
_LW = lambda c: f"list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9_-]+', ' ', 'g'), ' '), lambda q: q <> '')"
_BAD_CHILD = lambda c: f"(regexp_matches(lower({c}), '(^|[^a-z0-9_])or\\s+more($|[^a-z0-9_])') or list_has_any({_LW(c)}, [{', '.join(repr(w) for w in [*x.ROLE_WORDS, *x.FILE_WORDS])}]) or contains(lower({c}), '/etc/') or contains(lower({c}), '/var/') or contains({c}, '\\'))"
_LISTS = """with ed as (select distinct child, parent from taxonomy_is_a where child is not null and trim(parent, ' ') <> ''),
tp as (select parent, count(distinct child) n from ed group by 1 order by n desc, parent limit 8), tl as (select list(parent order by n desc, parent) tops from tp),
ls as (select child, parent, ([parent] || list_filter(tops, lambda q: lower(q) <> lower(parent)))[:8] || ['none'] c from ed, tl)"""


def _chunks(join: str) -> str:
    return f"""with lb as (select canonical_id - 5000 term_id, canonical_id label_id, min(is_generic) = 0 is_domain, min(coalesce(term_type, 'class')) category from term_enrichment group by canonical_id),
l0 as (select distinct doc_id, chunk_id, term_id, term, freq_total from llm_terms_final where term is not null and freq_total >= 1),
l1 as (select l0.* from l0 {join} join lb using (term_id) where label_id is null or (is_domain and category <> 'file' and category in ('class', 'config'))),
l2 as (select *, row_number() over (partition by doc_id, chunk_id, lower(trim(term, ' ')) order by freq_total desc, term_id, term) r from l1),
cc as (select doc_id, chunk_id, (row_number() over (partition by doc_id, chunk_id order by freq_total desc, term_id) - 1)::int idx, term_id, term from l2 where r = 1)"""


_PATTERNS = f"""unnest([['is_a', '({x.NP}) is (?:a|an) ({x.NP})', '1'], ['other', '({x.NP}) (?:and|or) other ({x.NP})', '1'], ['such_as', '({x.NP}) such as ({x.NP})', '0']])"""

ORACLE = {
    "technical_tokens": f"""with a as (select unnest([term_text, upper(replace(replace(term_text, ' ', '_'), 'ß', 'ss')), term_text || '.cfg']) term from term_candidates where term_text is not null union all select n_name from nation
 union all select unnest(['sbatch', 'SRUN', 'slurm node', ' '])) select distinct term, coalesce({_type("term")}, 'none') term_type, {_technical("term")} technical from a""",
    "canonical_groups": _GROUPS
    + f""" select canonical_id, canonical_term, coalesce(term_type, 'none') term_type, array_to_string(ids, ',') members, array_to_string(list_filter(xs, lambda q: lower(q) <> lower(canonical_term)), ';') synonyms,
 array_to_string(list_filter(xs, lambda q: regexp_matches(q, '{e.CAPITALS}') and length(q) > 1), ';') abbreviations,
 list_sort(list_transform(xs, lambda q: {{'n': case when lower(q) = lower(canonical_term) then 0 else length(q) end, 'l': lower(q), 'x': q}}))[1].x representative, freq_total, freq_docs, round(tf_idf, 4) tf_idf from h""",
    "generic_score": _GROUPS
    + f" select canonical_id, {_SCORE} generic_score, ({_SCORE}) >= 2.5 is_generic, array_to_string(list_filter([{', '.join(f'case when {c} then {n!r} end' for n, _, c in _SIGNALS)}], lambda q: q is not null), ',') reasons from h",
    "specific_terms": "select distinct canonical_id, canonical_term from term_enrichment where generic_score < 3 and is_generic = 0",
    "suffix_canonical": f"""with a as (select distinct unnest(string_split(regexp_replace(text, '[^A-Za-z0-9_.|/-]+', ' ', 'g'), ' ')) term from documents where text is not null)
 select term, array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(lower(trim(term, ' ')), '[_\\-|,:;]+', ' ', 'g'), '\\s+', ' ', 'g'), ' '), ' '), lambda z: {_SUFFIX}), ' ') canonical from a where term <> ''""",
    "evidence_sentences": """with o as (select distinct term_id, doc_id, sent_idx, token_start, token_end from term_occurrences), p as (select *, row_number() over (partition by term_id order by doc_id, sent_idx, token_start, token_end) r from o),
 s as (select doc_id, sent_idx, min(sentence) s from sentence_segmented group by 1, 2), h as (select distinct term_id, doc_id, sent_idx, s from p join s using (doc_id, sent_idx) where r <= 9 and trim(s, ' ') <> ''),
 k as (select *, row_number() over (partition by term_id order by doc_id, sent_idx) rk from h) select term_id, doc_id, sent_idx, rk as rank, length(s) n from k where rk <= 3""",
    "definition_heads": f"with a as ({_head(_DEFS, 200, wl.BAD_HEADS, True)}), b as ({_head(_OWN, 240, x.BAD_PARENTS, False)}) select a.k p_partkey, a.h head, b.h strict_head from a join b using (k)",
    "parent_scores": f"""with hd as (select h parent_term, count(*) d from ({_head(_DEFS, 200, wl.BAD_HEADS, True)}) where h <> 'none' group by 1), cl as (select lower(p_name) parent_term, count(*) c, avg(p_size / 50) f from part group by 1),
 j as (select coalesce(hd.parent_term, cl.parent_term) parent_term, coalesce(c, 0) + coalesce(f, 0) / 100 + 2 * coalesce(d, 0) score, coalesce(c, 0) class_support, coalesce(d, 0) def_support from hd full join cl on hd.parent_term = cl.parent_term)
 select parent_term, round(score, 3) score, class_support, def_support, case when class_support = 0 then 'definition' when def_support = 0 then 'class' else 'both' end parent_type from j where parent_term not in {_in(wl.BAD_HEADS)} order by j.score desc, parent_term limit 50""",
    "pending_enrich": "select distinct term_id, term_lemma from term_candidates c where freq_total >= 2 and not exists (select 1 from term_enrichment t where t.canonical_id = c.term_id)",
    "context_lookup": "select term_id, count(*) n_edges from (select distinct term_id, doc_id, chunk_id from llm_terms_final) join (select distinct edge_id, doc_id, chunk_id from llm_is_a_edges_final) using (doc_id, chunk_id) group by 1",
    "label_validate": """with r as (select event_id, event_id % 7 <> 0 as valid, case when event_id % 5 = 0 then 'class' else lower(event_type) end ro, round(value / 10, 3) c, event_id % 2 = 0 y from events)
 select event_id, valid, case when valid and ro in ('class', 'instance', 'property', 'relation', 'drop') then ro else 'drop' end ontology_role, valid and y is_domain,
 round(case when valid then least(1.0, greatest(0.0, case when c > 1 then c / 10 else c end)) else 0.0 end, 6) confidence from r""",
    "knn_topk": """with a as (select vec_id id, embedding::double[64] vec from embeddings), p as (select x.id, y.id neighbour, round(array_cosine_similarity(x.vec, y.vec), 9) s from a x join a y on x.id <> y.id),
 r as (select *, row_number() over (partition by id order by s desc, neighbour) rk from p) select id, neighbour, round(s, 4) similarity, rk as rank from r where rk <= 5""",
    "similarity_curve": _RANKED + " select r as rank, count(*) n, round(avg(similarity), 6) mean, round(min(similarity), 6) least, round(max(similarity), 6) most from rk where r in (1, 2, 3, 5) group by 1",
    "knee_proxy": _RANKED + ", p as (select term_id, max(case when r = 2 then similarity end) a, max(case when r = 5 then similarity end) b from rk group by 1) select count(*) n, round(avg(a - b), 6) fall from p where a is not null and b is not null",
    "eligible_rate": _RANKED + f", {_ELIGIBLE}, q as (select k, term_id, avg(case when neighbor_term_id in (from el) then 1 else 0 end) v from rk, (select unnest([1, 3, 5]) k) where r <= k and term_id in (from el) group by 1, 2) select k, count(*) n, round(avg(v), 6) rate from q group by 1",
    "sibling_rate": _RANKED
    + f""", {_SEEDS}, q as (select k, rk.term_id, avg(case when exists (select 1 from sd a join sd b on a.parent = b.parent where a.term_id = rk.term_id and b.term_id = rk.neighbor_term_id) then 1 else 0 end) v
 from rk, (select unnest([1, 3, 5]) k) where r <= k and rk.term_id in (select term_id from sd) group by 1, 2) select k, count(*) n, round(avg(v), 6) rate from q group by 1""",
    "embedding_coverage": "with a as (select distinct term_id from term_candidates), b as (select distinct term_id, 1 h from skipgram_neighbors) select count(*) n_terms, count(h) n_covered, round(100.0 * count(h) / count(*), 6) percent from a left join b using (term_id)",
    "phrase_vectors": """with w as (select label, arg_min(embedding, vec_id) vec from embeddings group by 1), nm as (select distinct unnest(string_split(lower(p_name), ' ')) word from part), wv as (select word, vec from nm join w on length(word) = label),
 t as (select p_partkey term_id, unnest(string_split(lower(p_name || ' unknownword'), ' ')) word from part)
 select term_id, case when count(vec) = 0 then 'no_vector' else 'ok' end reason, count(vec) n_known, round(coalesce(avg(vec[1]::double), 0), 5) v0 from t left join wv using (word) group by 1""",
    "head_match": f"""with k as (select p_name term from part union all select term_lemma from term_candidates where term_lemma is not null), c as (select distinct {_squeeze("term")} child from k where {_squeeze("term")} <> ''), cw as (select child, {_LW("child")} w from c where not {_BAD_CHILD("child")}),
 pe as (select distinct {_LW("term")}[-1] parent from k), p as (select parent, array_to_string({_LW("parent")}, ' ') fin from pe where parent is not null and parent not in {_in(x.BAD_PARENTS)}),
 e as (select child, unnest([array_to_string(w[-1:], ' '), case when len(w) >= 2 then array_to_string(w[-2:], ' ') end, case when len(w) >= 3 then array_to_string(w[-3:], ' ') end]) fin from cw where len(w) > 0),
 j as (select distinct child, parent from e join p using (fin) where lower(child) <> parent and fin <> ''), n as (select parent, count(*) n_children from j group by 1 having count(*) >= 2) select child, parent, n_children from j join n using (parent)""",
    "hearst_isa": f"""with ed as (select distinct edge_id, doc_id, child_term c, parent_term p from llm_is_a_edges_final where child_term is not null and parent_term is not null),
 s0 as (select doc_id, edge_id sent_idx, case edge_id % 3 when 0 then 'Here, ' || c || ' is a ' || p || ' now.' when 1 then 'We like ' || c || ' and other ' || p || '.' else p || ' such as ' || c end sentence from ed),
 s as (select doc_id, sent_idx, regexp_replace(lower(sentence), '\\s+', ' ', 'g') s from s0), k as (select distinct lower({_squeeze("term")}) term from llm_terms_final where {_squeeze("term")} <> ''),
 m as (select doc_id, sent_idx, q[1] pattern, q[3] = '1' lc, unnest(regexp_extract_all(s, q[2], 1)) l, unnest(regexp_extract_all(s, q[2], 2)) r from s, (select {_PATTERNS} q)),
 l as (select *, string_split(l, ' ') lw, string_split(r, ' ') rw from m),
 lt as (select doc_id, sent_idx, pattern, l, r, arg_min(term, n) lt from (select *, unnest(range(1, len(lw) + 1)) n from l) y join k on term = array_to_string(y.lw[y.n:], ' ') group by 1, 2, 3, 4, 5),
 rt as (select doc_id, sent_idx, pattern, l, r, arg_min(term, n) rt from (select *, unnest(range(1, len(rw) + 1)) n from l) y join k on term = array_to_string(y.rw[:len(y.rw) - y.n + 1], ' ') group by 1, 2, 3, 4, 5),
 j as (select distinct doc_id, sent_idx, pattern, case when pattern <> 'such_as' then lt else rt end child, case when pattern <> 'such_as' then rt else lt end parent from lt join rt using (doc_id, sent_idx, pattern, l, r))
 select child, parent, pattern, count(distinct (doc_id, sent_idx)) n_sentences from j where child <> parent and parent not in {_in(x.BAD_PARENTS)} and not {_BAD_CHILD("child")} group by 1, 2, 3""",
    "embed_expand": f"""with n0 as (select term_id, neighbor_term_id, max(similarity) similarity from skipgram_neighbors group by 1, 2 having max(similarity) >= 0.75), n1 as (select *, row_number() over (partition by term_id order by similarity desc, neighbor_term_id) r from n0),
 {_SEEDS}, {_ELIGIBLE}
 select neighbor_term_id child_id, parent, round(max(similarity), 6) similarity from sd join n1 using (term_id) where r <= 5 and neighbor_term_id in (from el) and not exists (select 1 from sd z where z.term_id = neighbor_term_id and z.parent = sd.parent) group by 1, 2""",
    "edge_union": f"select {label_key_sql('child')} child, {label_key_sql('parent')} parent, method, max(coalesce(evidence, '')) evidence from taxonomy_is_a where {label_key_sql('child')} <> {label_key_sql('parent')} group by 1, 2, 3",
    "edge_evidence": """with t as (select distinct trim(regexp_replace(lower(title), '^[0-9.]+ ', ''), ' ') child from documents where title is not null), ed as (select child, 'the ' || string_split(child, ' ')[-1] parent from t where regexp_matches(child, '[\\p{L}\\p{N}]')),
 s as (select doc_id, sent_idx, min(lower(sentence)) s from sentence_segmented group by 1, 2),
 sw as (select *, regexp_extract_all(s, '[\\p{L}\\p{N}]+') w from s), h as (select child, parent, doc_id, sent_idx, contains(s, parent) b from ed join sw on contains(s, child)
  and list_has_any(w, regexp_extract_all(child, '[\\p{L}\\p{N}]+'))), m as (select *, bool_or(b) over (partition by child, parent) a from h),
 r as (select *, row_number() over (partition by child, parent order by doc_id, sent_idx) rk from m where b or not a) select child, parent, rk as rank, doc_id, sent_idx, b as "both" from r where rk <= 2""",
    "top_parents": "select parent, count(distinct child) n_children from taxonomy_is_a where trim(parent, ' ') <> '' group by 1 order by 2 desc, 1 limit 10",
    "candidate_list": _LISTS + " select child, parent, array_to_string(c, '|') candidates from ls",
    "verdict_rules": _LISTS
    + """, v as (select *, length(child) n, case length(child) % 4 when 0 then 'nowhere' when 1 then 'none' else parent end b from ls)
 select child, parent, list_contains(c, b) and n % 5 <> 0 and n % 7 <> 0 and n % 3 <> 0 accept, round(case when list_contains(c, b) then n / 60 else least(n / 60, 0.3) end, 6) confidence from v""",
    "chunk_candidates": _chunks("left") + " select doc_id, chunk_id, idx, term_id, term from cc where idx < 16",
    "relation_candidates": _chunks("inner") + " select doc_id, chunk_id, idx, term_id, term from cc where idx < 16",
    "indexed_edges": _chunks("left")
    + " select a.doc_id, a.chunk_id, a.term_id left_id, b.term_id right_id, a.term left_term, b.term right_term from cc a join cc b on a.doc_id = b.doc_id and a.chunk_id = b.chunk_id and a.idx = 0 and b.idx = 1 where a.doc_id % 9 <> 0 and a.term_id <> b.term_id",
}
