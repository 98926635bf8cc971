"""Queries of class terms, proposals of models, loads and evaluation exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions.text import BLANKS, label_key, label_key_sql, last
from ontoloom.operators import axioms as ax
from ontoloom.operators import enrich as e
from ontoloom.operators import graph as g
from ontoloom.operators import knn as v
from ontoloom.operators import rdf
from ontoloom.operators import relations as r
from ontoloom.operators import tables as tb
from ontoloom.operators import taxonomy as x
from ontoloom.operators import turtle_text as tt
from ontoloom.plans.graph_queries import _LIT, _event_triples
from ontoloom.plans.ontology_queries import _chunk_candidates, _chunks, _seeds
from ontoloom.plans.term_queries import _in
from ontoloom.sources import files
from ontoloom.sources.tables import table

# --- class terms and links -----------------------------------------------------------------------------------------------------


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """Enriched terms as labels of a model: the confidence falls with the generic score; the definition names the last word."""
    t = table(spark, d, "term_enrichment")
    key = label_key(F.col("canonical_term"))
    return t.select(
        key.alias("term"), F.when(F.col("term_type").isNull(), "Class").otherwise(F.col("term_type")).alias("role"), (F.col("is_generic") == 0).alias("is_domain"),
        (1 - F.col("generic_score") / 10).alias("confidence"), F.concat(F.lit("A "), last(F.split(key, " ")), F.lit(" for jobs.")).alias("definition"),
    ).distinct()


def class_terms(spark: SparkSession, d: str) -> DataFrame:
    return x.class_terms(_labels(spark, d))


def weighted_parents(spark: SparkSession, d: str) -> DataFrame:
    head = e.definition_head(F.col("definition"), 240, x.BAD_PARENTS, False)
    return x.weighted_parents(_labels(spark, d), head)


def _model_links(spark: SparkSession, d: str) -> DataFrame:
    """The stored links of each chunk as output of a model."""
    t = table(spark, d, "llm_is_a_edges_final").select("doc_id", "chunk_id", F.struct(F.col("child_term").alias("child"), F.col("parent_term").alias("parent"), "justification").alias("x"))
    return t.groupBy("doc_id", "chunk_id").agg(F.concat(F.lit("Links: "), F.to_json(F.struct(F.collect_list("x").alias("is_a_edges"))), F.lit(" done")).alias("raw"))


def free_links(spark: SparkSession, d: str) -> DataFrame:
    return x.free_links(_model_links(spark, d), ["doc_id", "chunk_id"])


def context_terms(spark: SparkSession, d: str) -> DataFrame:
    names = r.surface_map(table(spark, d, "term_enrichment").select("canonical_id", "canonical_term", F.col("synonyms_json").alias("synonyms")).distinct())
    t = table(spark, d, "llm_terms_final").where("term is not null").select("doc_id", "chunk_id", "term")
    return x.with_canonical(t, names).withColumn("canonical_id", F.coalesce("canonical_id", F.lit(-1)))


def lemma_ids(spark: SparkSession, d: str) -> DataFrame:
    return x.lemma_ids(table(spark, d, "term_candidates"))


_RELATIONS = (
    '{"relations": [{"subject_idx": 0, "predicate": "runs_on", "object_idx": 1, "relation_type": "usage"}, {"subject_idx": 0, "predicate": "runs_on", "object_idx": 1, "relation_type": "provision"},'
    ' {"subject_idx": 1, "predicate": "is_a", "object_idx": 0, "relation_type": "other"}, {"subject_idx": 0, "predicate": "Runs On", "object_idx": 1}, {"subject_idx": 2, "predicate": "stored_in", "object_idx": 0},'
    ' {"subject_idx": 0, "predicate": "writes_to", "object_idx": 2, "relation_type": "odd"}, {"subject_idx": 1, "predicate": "writes_to", "object_idx": 1, "relation_type": "logging"},'
    ' {"subject_idx": 0, "predicate": "sees", "object_idx": 1, "relation_type": "usage"}, {"subject_idx": 0, "predicate": "runs_on", "object_idx": 99, "relation_type": "usage"}]}'
)


def indexed_relations(spark: SparkSession, d: str) -> DataFrame:
    c = _chunk_candidates(spark, d)
    raw = F.when(F.col("doc_id") % 9 == 0, "no json").otherwise(_RELATIONS)
    return r.indexed_relations(c.select("doc_id", "chunk_id").distinct().withColumn("raw", raw), c, ["runs_on", "stored_in", "writes_to", "is_a"])


# --- loads -----------------------------------------------------------------------------------------------------------------------


def term_types(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "term_enrichment").select(F.col("canonical_term").alias("term"), F.col("term_type").alias("role"), F.lit(" ").alias("bucket"), F.col("is_generic").cast("string").alias("category"), "created_at")
    none = lambda c: F.coalesce(c, F.lit("none")).alias(c)
    return ax.term_types(t, "created_at").select("term", none("role"), none("bucket"), none("category"))


def load_triples(spark: SparkSession, d: str) -> DataFrame:
    t = _event_triples(spark, d)
    odd = t.select(F.concat(F.lit(" "), "s").alias("s"), F.concat(F.initcap(F.replace("rel", F.lit("_"), F.lit(" - "))), F.lit("  ")).alias("rel"), F.when(F.length("o") % 5 == 0, " ").otherwise(F.col("o")).alias("o"))
    return ax.load_triples(odd).groupBy("s", "rel", "o").agg(F.count("*").alias("n"))


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    """Labels of many words stand for those without the first word."""
    t = table(spark, d, "taxonomy_is_a").select(F.explode(F.array(label_key(F.col("child")), label_key(F.col("parent")))).alias("surface")).where("surface is not null").distinct()
    return t.where(F.length("surface") % 3 == 0).select("surface", F.regexp_replace("surface", "^[^ ]+ (.)", "$1").alias("canonical"))


def resolved_parents(spark: SparkSession, d: str) -> DataFrame:
    p = ax.resolved_parents(table(spark, d, "taxonomy_is_a"), _canonical(spark, d), "method")
    return p.select("child", F.array_join("parents", "|").alias("parents"))


def known_assertions(spark: SparkSession, d: str) -> DataFrame:
    t = _event_triples(spark, d)
    return ax.known_assertions(t, t.where("rel not like '%size'").select(F.upper("rel").alias("rel"))).groupBy("s", "rel", "o").agg(F.count("*").alias("n"))


def finish_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Proposals for the event relations: domain users, range a term or none, sub- and inverse properties partly unknown."""
    t = _event_triples(spark, d)
    kinds = ax.property_kinds(t)
    n = F.length("rel")
    props = kinds.select(
        F.upper("rel").alias("predicate"), F.when(n % 2 == 0, F.col("rel")).otherwise("Not A Name").alias("name"), F.when(n % 3 == 0, "nowhere").otherwise("u1").alias("domain"), F.when(n % 3 == 1, "u2").alias("range"),
        F.array(F.lit("purchase"), F.lit("unheard_of")).alias("sub_of"), F.array(F.lit("CLICK_by"), F.lit("click_by")).alias("inverse_of"),
    )
    links = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("child"), F.concat(F.lit("group"), F.col("user_id") % 5).alias("parent")).distinct()
    clamped = g.clamp(links.select(F.col("child").alias("term")), links.select(F.col("parent").alias("term")).where("term <> 'group3'"), links)
    f = ax.finish_proposals(props, kinds, ax.sample_evidence(t, 5), clamped)
    return f.select("predicate", "name", "kind", F.coalesce("datatype", F.lit("none")).alias("datatype"), "domain", "range", F.array_join("sub_of", ",").alias("sub_of"), F.array_join("inverse_of", ",").alias("inverse_of"))


def pending_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of 50 terms to enrich."""
    done = table(spark, d, "term_enrichment").select(F.col("canonical_id").alias("term_id"))
    t = tb.delete_below(tb.pending(table(spark, d, "term_candidates"), done, ["term_id"]), "freq_total", 2).select("term_id").distinct()
    return tb.page(t, ["term_id"], 50, 50)


def chunk_lookup(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "llm_is_a_edges_final").select("edge_id", "doc_id", "chunk_id").distinct()
    terms = table(spark, d, "llm_terms_final").where("term is not null").select("doc_id", "chunk_id", "term")
    return tb.lookup(links, terms, ["doc_id", "chunk_id"]).withColumn("term", F.coalesce("term", F.lit("none")))


# --- evaluation ------------------------------------------------------------------------------------------------------------------

_BASE = "http://example.org/onto#"


def _graph(spark: SparkSession, d: str) -> DataFrame:
    """Links and relations over numbered resources, with repeats in other letter case, blank nodes, schema statements and literals."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    iri = lambda p, k: F.concat(F.lit(_BASE + p), F.col(k).cast("string"))
    parts = [
        c.select(*rdf.triple(iri("c", "c_custkey"), rdf.SUBCLASS, iri("n", "c_nationkey"))), c.where("c_custkey % 3 = 0").select(*rdf.triple(F.upper(iri("c", "c_custkey")), rdf.SUBCLASS, iri("n", "c_nationkey"))),
        n.select(*rdf.triple(iri("n", "n_nationkey"), rdf.SUBCLASS, F.lit(rdf.OWL + "Thing"))), n.select(*rdf.triple(iri("n", "n_nationkey"), rdf.TYPE, F.lit(rdf.OWL + "Class"))),
        c.select(*rdf.triple(iri("c", "c_custkey"), F.lit(_BASE + "livesIn"), iri("n", "c_nationkey"))), c.select(*rdf.triple(iri("c", "c_custkey"), F.lit(_BASE + "pays"), F.col("c_mktsegment"), "literal", rdf.XSD + "string")),
        c.where("c_custkey % 5 = 0").select(*rdf.triple(F.concat(F.lit("_:x"), F.col("c_custkey")), F.lit(_BASE + "livesIn"), iri("n", "c_nationkey"))), n.select(*rdf.triple(iri("n", "n_nationkey"), F.lit(rdf.LABEL), F.col("n_name"), "literal", rdf.XSD + "string")),
    ]
    t = parts[0]
    for p in parts[1:]:
        t = t.unionByName(p)
    return t


def rdf_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return rdf.taxonomy_rows(_graph(spark, d))


def rdf_relations(spark: SparkSession, d: str) -> DataFrame:
    return rdf.relation_rows(_graph(spark, d))


def node_roles(spark: SparkSession, d: str) -> DataFrame:
    return rdf.node_roles(_graph(spark, d))


def turtle_export(spark: SparkSession, d: str) -> DataFrame:
    return rdf.turtle(_graph(spark, d).distinct(), {"owl": rdf.OWL, "rdfs": rdf.RDFS, "xsd": rdf.XSD, "o": _BASE})


def report_markdown(spark: SparkSession, d: str) -> DataFrame:
    return rdf.markdown(rdf.structure(_graph(spark, d)))


def term_selection(spark: SparkSession, d: str) -> DataFrame:
    return v.select_terms(table(spark, d, "term_candidates"), 10.0).select("term_id", "term_text").distinct()


def k_evaluation(spark: SparkSession, d: str) -> DataFrame:
    el = table(spark, d, "term_enrichment").where("is_generic = 0").select(F.col("canonical_id").alias("term_id"))
    t = v.evaluate_k(table(spark, d, "skipgram_neighbors"), _seeds(spark, d), el, (1, 3, 5), (1, 2, 3, 5))
    return t.select("measure", "k", "n", F.round("value", 6).alias("value"))


def stopword_li(spark: SparkSession, d: str) -> DataFrame:
    """Titles as list items of a page."""
    t = table(spark, d, "documents").where("title is not null")
    item = F.concat(F.lit("<ul><LI class='x'> • <b>"), F.substring_index("title", " ", -1), F.lit("</b></LI><li>"), "title", F.lit("</li></ul>"))
    return files.list_words(t.select(item.alias("html")))


def turtle_line_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select(F.explode(F.array(
        F.concat(F.lit("hpc:P"), "p_partkey", F.lit(" a owl:Class .")), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("rdfs:domain(hpc:p) hpc:C"), "p_partkey", F.lit(" ."))).otherwise("rdfs:range(hpc:p) hpc:R ."),
        F.concat(F.col("p_size").cast("string"), F.lit(" "), F.lit("times")), F.col("p_name"), F.lit("hpc:alone ;"),
    )).alias("line"))
    return tt.line_counts(t)


def table_columns(spark: SparkSession, d: str) -> DataFrame:
    return tb.columns_of(table(spark, d, "nation")).select("position", "column")


QUERIES = {
    f.__name__: f
    for f in (
        class_terms, weighted_parents, free_links, context_terms, lemma_ids, indexed_relations, term_types, load_triples, resolved_parents, known_assertions, finish_proposals, pending_page, chunk_lookup,
        rdf_taxonomy, rdf_relations, node_roles, turtle_export, report_markdown, term_selection, k_evaluation, stopword_li, turtle_line_counts, table_columns,
    )
}

# --- SQL twins -------------------------------------------------------------------------------------------------------------------

_KEY = label_key_sql
_SWAP = lambda c: f"case when len(string_split({c}, ' ')) = 2 and string_split({c}, ' ')[2] in {_in(x.wl.SCHEDULERS)} and string_split({c}, ' ')[1] in {_in(x.SCHEDULER_HEADS)} then string_split({c}, ' ')[2] || ' ' || string_split({c}, ' ')[1] else {c} end"
_LABELS = f"""lb as (select distinct {_KEY("canonical_term")} term, coalesce(term_type, 'class') as "role", is_generic = 0 dom, 1 - generic_score / 10 conf, string_split({_KEY("canonical_term")}, ' ')[-1] w from term_enrichment),
 ok as (select {_SWAP("term")} term, w from lb where "role" = 'class' and dom and conf >= 0.7 and term is not null)"""
# the definition 'A w for jobs.' has the head w without signs, if that is long enough, no scheduler, determiner or bad parent
_HEAD = """array_to_string(list_filter(string_split(regexp_replace(w, '[^a-z0-9_-]', ' ', 'g'), ' '), lambda q: q <> '')[-3:], ' ')"""
_J = " or ".join(f"contains(lower(coalesce(justification, '')), '{p}')" for p in x.OTHER_RELATIONS)
_NAMES = """sm0 as (select distinct canonical_id, canonical_term, synonyms_json from term_enrichment)"""
_LOW = lambda c: f"lower(trim(regexp_replace({c}, '{BLANKS}', ' ', 'g'), ' '))"
_EVENTS = """ev as (select *, event_type || case event_id % 3 when 0 then '_size' when 1 then '_by' else '' end rel,
 case event_id % 3 when 0 then floor(value)::bigint::varchar when 1 then 'u' || (user_id % 7) else case when user_id % 2 = 0 then 'yes' else 'v' || user_id end end o, 'u' || user_id s from events)"""
_GRAPH = f"""gr as (select '{_BASE}c' || c_custkey s, '{rdf.SUBCLASS}' p, '{_BASE}n' || c_nationkey o, 'iri' k from customer union all select upper('{_BASE}c' || c_custkey), '{rdf.SUBCLASS}', '{_BASE}n' || c_nationkey, 'iri' from customer where c_custkey % 3 = 0
 union all select '{_BASE}n' || n_nationkey, '{rdf.SUBCLASS}', '{rdf.OWL}Thing', 'iri' from nation union all select '{_BASE}n' || n_nationkey, '{rdf.TYPE}', '{rdf.OWL}Class', 'iri' from nation
 union all select '{_BASE}c' || c_custkey, '{_BASE}livesIn', '{_BASE}n' || c_nationkey, 'iri' from customer union all select '{_BASE}c' || c_custkey, '{_BASE}pays', c_mktsegment, 'literal' from customer
 union all select '_:x' || c_custkey, '{_BASE}livesIn', '{_BASE}n' || c_nationkey, 'iri' from customer where c_custkey % 5 = 0 union all select '{_BASE}n' || n_nationkey, '{rdf.LABEL}', n_name, 'literal' from nation)"""
_STRUCTURE = f"""{_GRAPH}, st as (select 'declared' as section, 'class' as metric, count(distinct s) as v from gr where p = '{rdf.TYPE}' union all select 'statements', 'statements', count(*) from gr
 union all select 'statements', 'repeated', count(*) - count(distinct (s, p, o, k)) from gr union all select 'statements', 'links', count(*) from gr where p = '{rdf.SUBCLASS}'
 union all select 'statements', 'relations', count(*) from gr where starts_with(p, '{_BASE}') union all select 'statements', 'literals', count(*) from gr where k = 'literal')"""
_RANKED = "rk as (select *, row_number() over (partition by term_id order by similarity desc, neighbor_term_id) k from (select term_id, neighbor_term_id, max(similarity) similarity from skipgram_neighbors group by 1, 2))"
_SD = f"sd as (select distinct term_id, string_split({_KEY('term_lemma')}, ' ')[-1] parent from term_candidates where {_KEY('term_lemma')} is not null)"

ORACLE = {
    "class_terms": f"with {_LABELS} select term, min('A ' || w || ' for jobs.') definition from ok group by 1",
    "weighted_parents": f"""with {_LABELS}, o2 as (select term, {_HEAD} h from ok where term not in {_in(x.BAD_PARENTS)}),
 p as (select term parent, 1 c, 0 d from o2 union all select {_SWAP("h")}, 0, 1 from o2 where length(h) >= 3 and h not in {_in([*x.BAD_PARENTS, *x.wl.DETERMINERS[:8], *x.wl.SCHEDULERS, *x.wl.TAIL_PREPOSITIONS, *x.wl.CLAUSE_WORDS])})
 select parent, sum(c)::bigint class_support, sum(d)::bigint def_support, greatest(sum(c), 2 * sum(d))::bigint score from p where parent not in {_in(x.BAD_PARENTS)} group by 1""",
    "free_links": f"""with t as (select doc_id, chunk_id, trim(child_term, ' ') c, trim(parent_term, ' ') p from llm_is_a_edges_final where not ({_J})),
 k as (select * from t where c <> '' and p <> '' and lower(c) <> lower(p) and contains(lower(c), lower(p)))
 select doc_id, chunk_id, (min((c, p)))[1] child, (min((c, p)))[2] parent from k group by doc_id, chunk_id, lower(c), lower(p)""",
    "context_terms": f"""with {_NAMES}, sm1 as (select {_LOW("canonical_term")} surface, 1 own, canonical_id from sm0 union all select {_LOW("unnest(from_json(synonyms_json, '[" + chr(34) + "VARCHAR" + chr(34) + "]'))")}, 0, canonical_id from sm0 where synonyms_json is not null),
 sm as (select surface, max((own, canonical_id))[2] canonical_id from sm1 where surface <> '' group by 1), t as (select distinct doc_id, chunk_id, term from llm_terms_final where term is not null)
 select doc_id, chunk_id, term, coalesce(canonical_id, -1) canonical_id from t left join sm on surface = {_LOW("term")}""",
    "lemma_ids": f"select {_LOW('term_lemma')} lemma, max(term_id) term_id from term_candidates where {_LOW('term_lemma')} <> '' group by 1",
    "indexed_relations": _chunks("left")
    + """ select a.doc_id, a.chunk_id, a.term_id subj_id, a.term subj, p predicate, t relation_type, b.term_id obj_id, b.term obj from cc a join cc b on a.doc_id = b.doc_id and a.chunk_id = b.chunk_id,
 (values (0, 1, 'runs_on', 'provision'), (2, 0, 'stored_in', 'other')) m(i, j, p, t) where a.idx = i and b.idx = j and a.idx < 16 and b.idx < 16 and a.doc_id % 9 <> 0 and lower(a.term) <> lower(b.term)""",
    "term_types": """with t as (select trim(canonical_term, ' ') term, (created_at, nullif(trim(term_type, ' '), ''), is_generic::varchar) x, created_at n, nullif(trim(term_type, ' '), '') ro, is_generic::varchar ca from term_enrichment where trim(canonical_term, ' ') <> ''),
 r as (select *, row_number() over (partition by term order by n desc nulls last, ro desc nulls last, ca desc nulls last) k from t) select term, coalesce(ro, 'none') as "role", 'none' as bucket, coalesce(ca, 'none') category from r where k = 1""",
    "load_triples": f"with {_EVENTS} select s, lower(rel) rel, o, count(*) n from ev where length(o) % 5 <> 0 group by 1, 2, 3",
    "resolved_parents": f"""with e as (select {_KEY("child")} c, {_KEY("parent")} p, method from taxonomy_is_a), s as (select c x from e union select p from e),
 m as (select x, regexp_replace(x, '^[^ ]+ (.)', '\\1') y from s where length(x) % 3 = 0), f as (select coalesce(a.y, e.c) c, coalesce(b.y, e.p) p, method from e left join m a on a.x = e.c left join m b on b.x = e.p),
 q as (select c, p, min(method) n from f where c <> '' and p <> '' and c <> p group by 1, 2) select c child, string_agg(p, '|' order by n nulls first, p) parents from q group by 1""",
    "known_assertions": f"with {_EVENTS} select s, lower(rel) rel, o, count(*) n from ev where rel not like '%size' group by 1, 2, 3",
    "finish_proposals": f"""with {_EVENTS}, pk0 as (select rel, {_LIT("o")} end t, count(*) c from ev group by 1, 2), pk1 as (select rel, sum(c)::bigint n, max(case when t is not null then (c, t) end) b from pk0 group by 1),
 hint as (select *, regexp_matches(lower(rel), '{"|".join(ax.LITERAL_HINTS)}') h from pk1), typed as (select *, b is not null and (b[1] / n >= 0.55 or h) ty from hint),
 pk as (select rel, case when ty or (h and n >= 2) then 'datatype' else 'object' end kind, case when ty then b[2] when h and n >= 2 then 'string' else 'none' end dt from typed),
 us as (select distinct 'u' || user_id t, 'group' || (user_id % 5) cl from events where user_id % 5 <> 3), pr as (select distinct rel, s, o from ev),
 se as (select *, row_number() over (partition by rel order by md5('13|' || rel || '|' || s || '|' || o)) rk from pr), e5 as (select rel, rk, a.cl sc, b.cl oc from se left join us a on a.t = s left join us b on b.t = o where rk <= 5),
 fi as (select rel, arg_min(sc, rk) filter (sc is not null) sd, arg_min(oc, rk) filter (oc is not null) od from e5 group by 1), d1 as (select cl from us where t = 'u1'), d2 as (select cl from us where t = 'u2')
 select lower(pk.rel) predicate, lower(pk.rel) as "name", kind, dt datatype, coalesce(case when length(pk.rel) % 3 <> 0 then (from d1) end, sd, 'owl:Thing') as "domain",
 case when kind = 'object' then coalesce(case when length(pk.rel) % 3 = 1 then (from d2) end, od, 'owl:Thing') else 'owl:Thing' end as "range",
 case when exists (from pk where rel = 'purchase') then 'purchase' else '' end sub_of, case when exists (from pk where rel = 'click_by') then 'click_by' else '' end inverse_of from pk left join fi using (rel)""",
    "pending_page": "select distinct term_id from term_candidates c where freq_total >= 2 and not exists (select 1 from term_enrichment e where e.canonical_id = c.term_id) order by term_id limit 50 offset 50",
    "chunk_lookup": """with t as (select doc_id, chunk_id, min(term) term from llm_terms_final where term is not null group by 1, 2), e as (select distinct edge_id, doc_id, chunk_id from llm_is_a_edges_final)
 select edge_id, doc_id, chunk_id, coalesce(term, 'none') term from e left join t using (doc_id, chunk_id)""",
    "rdf_taxonomy": f"""with {_GRAPH}, t as (select distinct s, o from gr where p = '{rdf.SUBCLASS}' and not starts_with(o, '{rdf.OWL}')), g as (select min((s, o)) m from t group by lower(s), lower(o))
 select regexp_extract(m[1], '([^#/:]*)$', 1) child, regexp_extract(m[2], '([^#/:]*)$', 1) parent from g""",
    "rdf_relations": f"with {_GRAPH} select distinct replace(s, '{_BASE}', '') subject, 'livesIn' relation, replace(o, '{_BASE}', '') as object from gr where p = '{_BASE}livesIn' and not starts_with(s, '_:')",
    "node_roles": f"""with {_GRAPH}, k as (select s i, p = '{rdf.TYPE}' or p = '{rdf.SUBCLASS}' c from gr union all select o, true from gr where p = '{rdf.SUBCLASS}')
 select i iri, bool_or(c) class_like, false property_like from k where not starts_with(i, '_:') group by 1""",
    "turtle_export": f"""with {_GRAPH}, g as (select distinct * from gr), n as (select *, case when starts_with(s, '_:') then s when starts_with(s, '{_BASE}') then 'o:' || replace(s, '{_BASE}', '') else '<' || s || '>' end sn from g)
 select sn || ' ' || case p when '{rdf.TYPE}' then 'a' when '{rdf.SUBCLASS}' then 'rdfs:subClassOf' when '{rdf.LABEL}' then 'rdfs:label' else 'o:' || replace(p, '{_BASE}', '') end || ' '
 || case when k = 'literal' then '"' || o || '"' when starts_with(o, '{rdf.OWL}') then 'owl:' || replace(o, '{rdf.OWL}', '') else 'o:' || replace(o, '{_BASE}', '') end || ' .' as line from n""",
    "report_markdown": f"""with {_STRUCTURE}, l as (select '' s, 0 k, '' m, '# Ontology quality' as line union all select distinct section, 0, '', '## ' || section from st union all select section, 1, metric, '- ' || metric || ': **' || v || '**' from st)
 select row_number() over (order by s, k, m) line_no, line from l""",
    "term_selection": "select distinct term_id, term_text from term_candidates where tf_idf >= 10 and term_text is not null",
    "k_evaluation": f"""with {_RANKED}, {_SD}, el as (select distinct canonical_id term_id from term_enrichment where is_generic = 0), ks as (select unnest([1, 3, 5]) kk),
 c as (select k, count(*) n, avg(similarity) me, min(similarity) le, max(similarity) mo from rk where k in (1, 2, 3, 5) group by 1),
 a as (select kk, term_id, avg(case when neighbor_term_id in (from el) then 1 else 0 end) r from rk, ks where k <= kk and term_id in (from el) group by 1, 2),
 hit as (select distinct rk.term_id, neighbor_term_id from rk join sd x on x.term_id = rk.term_id join sd y on y.term_id = neighbor_term_id and y.parent = x.parent),
 b as (select kk, term_id, avg(case when (term_id, neighbor_term_id) in (select (term_id, neighbor_term_id) from hit) then 1 else 0 end) r from rk, ks where k <= kk and term_id in (select term_id from sd) group by 1, 2)
 select 'similarity_mean' measure, k, n, round(me, 6) as "value" from c union all select 'similarity_least', k, n, round(le, 6) from c union all select 'similarity_most', k, n, round(mo, 6) from c
 union all select 'eligible_rate', kk, count(*), round(avg(r), 6) from a group by kk union all select 'sibling_rate', kk, count(*), round(avg(r), 6) from b group by kk""",
    "stopword_li": """with t as (select title, regexp_replace(title, '^.* ', '') w from documents where title is not null), i as (select w x from t union all select trim(regexp_replace(regexp_replace(title, '<[^>]*>', '', 'g'), '^[\\s•*·-]+', ''), ' ') from t)
 select distinct lower(x) word from i where regexp_matches(x, '^[A-Za-z'']+$')""",
    "turtle_line_counts": """with k as (select case when p_partkey % 3 = 0 then 'rewrite_domain' else 'rewrite_range' end a from part), l as (select a rule from k union all select 'keep' from part union all select 'drop_number' from part
 union all select 'drop_prose' from part union all select 'drop_empty_object' from part) select rule, count(*) n from l group by 1""",
    "table_columns": "select ordinal_position - 1 as position, column_name as \"column\" from information_schema.columns where table_name = 'nation'",
}
