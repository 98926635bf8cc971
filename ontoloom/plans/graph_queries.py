"""Queries of relations, graphs and axioms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions import word_lists as wl
from ontoloom.functions.text import BLANKS, label_key, label_key_sql, last
from ontoloom.operators import axioms as ax
from ontoloom.operators import graph as g
from ontoloom.operators import relations as r
from ontoloom.operators import terms as t
from ontoloom.plans.term_queries import TOKENS_SQL, _in
from ontoloom.sources.tables import table


def _is_a(spark: SparkSession, d: str) -> DataFrame:
    """The is-a links by label key: wide and deep trees, and rings."""
    t = table(spark, d, "taxonomy_is_a").select(label_key(F.col("child")).alias("child"), label_key(F.col("parent")).alias("parent"))
    return t.where("child is not null and parent is not null").distinct()


def _acyclic(spark: SparkSession, d: str) -> DataFrame:
    return g.break_cycles(_is_a(spark, d)).where("not removed").select("child", "parent")


def tax_closure(spark: SparkSession, d: str) -> DataFrame:
    return g.closure(_is_a(spark, d))


def ancestors_bounded(spark: SparkSession, d: str) -> DataFrame:
    return g.nearest_ancestors(_is_a(spark, d), 6, 12)


def tax_depth(spark: SparkSession, d: str) -> DataFrame:
    return g.depths(_acyclic(spark, d)).select("node", "depth", (F.col("depth") + 1).alias("level"))


def roots_leaves(spark: SparkSession, d: str) -> DataFrame:
    return g.roots_and_leaves(_is_a(spark, d))


def components(spark: SparkSession, d: str) -> DataFrame:
    return g.components(_is_a(spark, d))


def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return g.component_sizes(g.components(_is_a(spark, d)))


def lca_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = _acyclic(spark, d)
    first = e.groupBy("parent").agg(F.min("child").alias("a"))
    pairs = e.join(first, "parent").select("a", F.col("child").alias("b")).where("a < b").distinct()
    return g.common_ancestors(pairs, g.closure(e), g.depths(e))


def cycle_report(spark: SparkSession, d: str) -> DataFrame:
    return g.cycles(_is_a(spark, d)).select(F.array_join("nodes", ">").alias("nodes"), "length")


def cycle_break(spark: SparkSession, d: str) -> DataFrame:
    return g.break_cycles(_is_a(spark, d))


def _busy(e: DataFrame, least: int) -> DataFrame:
    return e.where("child <> parent").groupBy("parent").agg(F.count_distinct("child").alias("n")).where(F.col("n") >= least)


def bucket_inference(spark: SparkSession, d: str) -> DataFrame:
    """Parents of three or more children are the buckets."""
    e = _is_a(spark, d)
    return g.nearest_labelled(e, _busy(e, 3).select(F.col("parent").alias("node"), F.upper("parent").alias("label")))


def class_clamp(spark: SparkSession, d: str) -> DataFrame:
    """Every label clamped to parents of two or more children, within four links."""
    e = _is_a(spark, d)
    t = g.clamp(e.select(F.explode(F.array("child", "parent")).alias("term")), _busy(e, 2).select(F.col("parent").alias("term")), e)
    return t.select("term", F.coalesce("class", F.lit("none")).alias("class"), F.coalesce("hops", F.lit(-1)).alias("hops"))


def relation_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_type", "p_brand").distinct()
    base, prep = F.concat_ws(" - ", "p_type", "p_brand"), F.lower("p_type")
    return p.select("p_type", "p_brand", r.relation_key(base).alias("k"), r.relation_key(base, prep).alias("kp"), r.axiom_relation_key(base).alias("ax"), r.valid_relation(base).alias("valid"), r.valid_relation(F.concat(base, F.lit("!"))).alias("bad"))


def generic_spans(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").where("title is not null").select("title").distinct()
    return s.select("title", r.generic_span(F.col("title")).alias("whole"), r.generic_span(F.substring_index("title", " ", 1)).alias("first"))


def relation_diversity(spark: SparkSession, d: str) -> DataFrame:
    tr = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.concat_ws("_", "l_returnflag", "l_linestatus", "l_linenumber").alias("rel"), F.col("l_partkey").alias("o"))
    return r.diverse_relations(tr, 100, 50, 50)


def _names(spark: SparkSession, d: str) -> DataFrame:
    return r.surface_map(table(spark, d, "term_enrichment").select("canonical_id", "canonical_term", F.col("synonyms_json").alias("synonyms")).distinct())


def surface_map(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d)


def span_canonical(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "llm_is_a_edges_final").select(F.concat(F.when(F.col("edge_id") % 2 == 0, "The ").otherwise(""), F.coalesce("child_term", F.lit(""))).alias("span")).union(table(spark, d, "term_candidates").select(F.concat(F.lit("a "), "term_lemma"))).where("span is not null").distinct()
    return r.resolve_spans(s, _names(spark, d)).withColumn("canonical_id", F.coalesce("canonical_id", F.lit(-1)))


def _svo(spark: SparkSession, d: str) -> DataFrame:
    return r.svo(t.tokens(table(spark, d, "sentence_segmented")))


def svo_triples(spark: SparkSession, d: str) -> DataFrame:
    return _svo(spark, d)


def _label_closure(spark: SparkSession, d: str) -> DataFrame:
    return g.closure(_svo(spark, d).select(F.col("subj").alias("child"), last(F.split("subj", " ")).alias("parent")).distinct(), 4)


def taxonomy_like_filter(spark: SparkSession, d: str) -> DataFrame:
    tr = _svo(spark, d).select(F.col("subj").alias("s"), F.when(F.length("subj") % 2 == 0, "include").otherwise("hold").alias("rel"), F.when(F.length("obj") % 2 == 0, last(F.split("subj", " "))).otherwise(F.col("obj")).alias("o")).distinct()
    return r.taxonomy_like(tr, _label_closure(spark, d)).withColumn("like", F.coalesce("like", F.lit("none")))


def extraction_cascade(spark: SparkSession, d: str) -> DataFrame:
    s = _svo(spark, d)
    names = s.select(F.col("subj").alias("surface")).union(s.select("obj")).distinct().where(F.length("surface") % 3 != 0).select("surface", F.abs(F.length("surface")).cast("long").alias("canonical_id"))
    # each canonical id lies under that of the surface's last word
    links = names.select(F.col("canonical_id").cast("string").alias("child"), F.length(last(F.split("surface", " "))).cast("string").alias("parent"))
    return r.cascade(s, names, g.closure(links))


def accept_reject(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    e = ev.select(F.col("event_id").alias("edge_id"))
    v = ev.where("event_id % 4 <> 0").select(F.col("event_id").alias("edge_id"), F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, "Accept").otherwise("reject").alias("decision"), F.round("value", 2).alias("confidence"))).alias("raw"))
    return r.accept_edges(e, v).withColumn("confidence", F.round("confidence", 4))


def json_pick(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", F.concat(F.lit("Sure: "), F.when(F.col("event_id") % 5 == 0, F.lit("none")).otherwise(F.col("props")), F.when(F.col("event_id") % 7 == 0, F.lit(" }")).otherwise(" done")).alias("raw"))
    return ev.select("event_id", F.coalesce(r.outer_json(F.col("raw")), F.lit("none")).alias("json"))


def _event_triples(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    rel = F.concat("event_type", F.when(F.col("event_id") % 3 == 0, "_size").when(F.col("event_id") % 3 == 1, "_by").otherwise(""))
    o = F.when(F.col("event_id") % 3 == 0, F.floor("value").cast("string")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("u"), F.col("user_id") % 7)).when(F.col("user_id") % 2 == 0, "yes").otherwise(F.concat(F.lit("v"), F.col("user_id")))
    return ev.select(F.concat(F.lit("u"), F.col("user_id")).alias("s"), rel.alias("rel"), o.alias("o"))


def _types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("user_id % 5 <> 0").select(F.concat(F.lit("u"), "user_id").alias("term"), F.when(F.col("user_id") % 3 == 0, "Role").otherwise("Entity").alias("bucket")).distinct()


def literal_types(spark: SparkSession, d: str) -> DataFrame:
    x = _event_triples(spark, d).select("o").union(table(spark, d, "part").select(F.concat(F.lit("/usr/"), "p_name"))).union(table(spark, d, "part").select(F.col("p_retailprice").cast("decimal(12,2)").cast("string"))).distinct()
    none = F.lit("none")
    return x.select("o", F.coalesce(ax.literal_type(F.col("o")), none).alias("plain"), F.coalesce(ax.literal_type(F.replace("o", F.lit(" "), F.lit("_")), paths=True), none).alias("with_paths"))


def property_kind(spark: SparkSession, d: str) -> DataFrame:
    return ax.property_kinds(_event_triples(spark, d)).withColumn("datatype", F.coalesce("datatype", F.lit("none")))


def domain_range(spark: SparkSession, d: str) -> DataFrame:
    return ax.domains_and_ranges(_event_triples(spark, d), _types(spark, d))


def assertion_filter(spark: SparkSession, d: str) -> DataFrame:
    tr = _event_triples(spark, d)
    return ax.keep_assertions(tr, ax.domains_and_ranges(tr, _types(spark, d))).groupBy("rel", "kind").agg(F.count("*").alias("n"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.explode(F.array("p_name", F.concat(F.lit("run "), "p_name"), F.concat(F.lit("3.1 "), "p_name"), F.concat(F.lit("owl:"), "p_brand"))).alias("label"))
    return p.union(table(spark, d, "term_candidates").select("term_text")).union(spark.createDataFrame([("owl:Thing",), ("Data Type Property",), ("system",), ("Datatype_Property",), ("",)], "label string")).where("label is not null").distinct()


def class_admission(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("label", F.coalesce(ax.class_problem(F.col("label"), F.when(F.length("label") % 9 == 0, "Property")), F.lit("none")).alias("problem"))


def tax_edge_load(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "taxonomy_is_a").select("child", F.when(F.length("child") % 11 == 0, "Unknown").when(F.length("child") % 11 == 1, "system").when(F.length("child") % 11 == 2, "srun").otherwise(F.col("parent")).alias("parent")).distinct()
    return e.select("child", F.coalesce("parent", F.lit("")).alias("parent"), F.coalesce(ax.link_problem(F.col("child"), F.col("parent"), F.length("child") % 2 == 0), F.lit("none")).alias("problem"))


def local_names(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part").select(F.explode(F.array("p_name", F.upper("p_name"), F.replace("p_name", F.lit(" "), F.lit("-")), F.concat(F.lit("2 "), "p_brand"))).alias("label"))
    return ax.local_names(x).select("label", "name", ax.snake_name(F.col("label")).alias("snake"))


def literal_render(spark: SparkSession, d: str) -> DataFrame:
    x = _event_triples(spark, d).select("o").distinct().union(spark.createDataFrame([('say "x"',), ("a\\b",), ("12.5",), ("-3",), ("On",)], "o string"))
    return x.select("o", *(ax.render_literal(F.col("o"), F.lit(k)).alias(k[0]) for k in ("boolean", "integer", "decimal", "string")))


def predicate_filter(spark: SparkSession, d: str) -> DataFrame:
    ev = _event_triples(spark, d).union(table(spark, d, "part").select("p_brand", F.concat(F.lit("run_"), F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))), F.when(F.col("p_size") % 2 == 0, "_to").otherwise("")), "p_name"))
    c = ev.union(spark.createDataFrame([("a", "related_to", "b"), ("a", "Has Space", "b")], "s string, rel string, o string")).groupBy("rel").agg(F.count("*").alias("n"))
    return c.select("rel", "n", F.coalesce(ax.predicate_problem(F.col("rel"), F.col("n")), F.lit("none")).alias("problem"))


def evidence_sample(spark: SparkSession, d: str) -> DataFrame:
    return ax.sample_evidence(_event_triples(spark, d), 5).select("rel", "s", "o", "rank")


def axiom_validate(spark: SparkSession, d: str) -> DataFrame:
    ev, n = table(spark, d, "events"), F.col("event_id")
    name = F.when(n % 11 == 0, "other").otherwise(F.col("event_type"))
    j = F.to_json(F.struct(F.col("event_type").alias("predicate"), F.struct(name.alias("name"), F.when(n % 7 == 0, "thing").otherwise("object").alias("kind")).alias("property"), F.when(n % 5 != 0, "User").alias("domain_class"), F.when(n % 3 == 0, 1.5).otherwise(0.5).alias("confidence")))
    raw = ev.select("event_id", F.when(n % 13 == 0, F.concat(F.lit("no "), j)).otherwise(j).alias("raw"))
    known = ev.select(F.col("event_type").alias("predicate")).distinct().where("predicate <> 'purchase'")
    return ax.validate_axioms(raw, known).select("event_id", F.coalesce("problem", F.lit("none")).alias("problem"))


def class_set(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "taxonomy_is_a").where("child is not null and trim(parent) <> ''").select("child", "parent")
    return ax.class_set(links, _event_triples(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        tax_closure, ancestors_bounded, tax_depth, roots_leaves, components, component_sizes, lca_pairs, cycle_report, cycle_break, bucket_inference, class_clamp, relation_keys, generic_spans, relation_diversity, surface_map, span_canonical, svo_triples,
        taxonomy_like_filter, extraction_cascade, accept_reject, json_pick, literal_types, property_kind, domain_range, assertion_filter, class_admission, tax_edge_load, local_names, literal_render, predicate_filter,
        evidence_sample, axiom_validate, class_set,
    )
}

_E = f"e as materialized (select distinct {label_key_sql('child')} child, {label_key_sql('parent')} parent from taxonomy_is_a where {label_key_sql('child')} is not null and {label_key_sql('parent')} is not null)"
# cycles: walked from their smallest node, in every length; here each ring is simple, so one link goes of each
_CYCLES = f"""with recursive {_E}, p as (select child f, parent l, [child, parent] ns from e where parent > child union all select f, parent, ns || [parent] from p join e on e.child = p.l where parent > f and not list_contains(ns, parent)),
 cy as (select ns from p join e on e.child = p.l and e.parent = p.f)"""
_BREAK = f"""{_CYCLES}, l as (select ns, ns[i] child, ns[i % len(ns) + 1] parent from (select ns, unnest(range(1, len(ns) + 1)) i from cy)),
 dr as (select distinct (max((parent, child)))[1] p, (max((parent, child)))[2] c from l group by ns),
 br as (select child, parent, child = parent or exists (select 1 from dr where dr.c = child and dr.p = parent) removed from e)"""
_CLOSE = lambda e: f"""cl(node, ancestor, hops) using key (node, ancestor) as (select child, parent, 1 from {e} where child <> parent union
 select cl.node, x.parent, cl.hops + 1 from cl join {e} x on x.child = cl.ancestor and x.child <> x.parent left join recurring.cl r on r.node = cl.node and r.ancestor = x.parent where r.node is null)"""  # noqa: E731
_CL = f"with recursive {_E}, {_CLOSE('e')}"
_ACYCLIC = f"""{_BREAK}, ac as materialized (select child, parent from br where not removed),
 dp(node, depth) as (select distinct parent, 0 from ac where parent not in (select child from ac) union select ac.child, depth + 1 from dp join ac on ac.parent = dp.node), d as (select node, max(depth)::int d from dp group by 1)"""
_T = """ev as (select *, event_type || case event_id % 3 when 0 then '_size' when 1 then '_by' else '' end rel,
 case event_id % 3 when 0 then floor(value)::bigint::varchar when 1 then 'u' || (user_id % 7) else case when user_id % 2 = 0 then 'yes' else 'v' || user_id end end o, 'u' || user_id s from events)"""
_LIT = lambda c: f"case when regexp_matches(lower(regexp_replace(trim({c}, ' '), '^[\"'']+|[\"'']+$', '', 'g')), '^(true|false|yes|no|on|off)$') then 'boolean' when regexp_matches(regexp_replace(trim({c}, ' '), '^[\"'']+|[\"'']+$', '', 'g'), '^[+-]?[0-9]+$') then 'integer' when regexp_matches(regexp_replace(trim({c}, ' '), '^[\"'']+|[\"'']+$', '', 'g'), '^[+-]?[0-9]+\\.[0-9]+$') then 'decimal'"
_KINDS = (
    _T
    + f""", pk0 as (select rel, {_LIT("o")} end t, count(*) c from ev group by 1, 2), pk1 as (select rel, sum(c)::bigint n, max(case when t is not null then (c, t) end) b from pk0 group by 1),
 pk as (select rel, n, case when b is not null and (b[1] / n >= 0.55 or regexp_matches(lower(rel), '{"|".join(ax.LITERAL_HINTS)}')) or (regexp_matches(lower(rel), '{"|".join(ax.LITERAL_HINTS)}') and n >= 2) then 'datatype' else 'object' end kind,
 case when b is not null and (b[1] / n >= 0.55 or regexp_matches(lower(rel), '{"|".join(ax.LITERAL_HINTS)}')) then b[2] when regexp_matches(lower(rel), '{"|".join(ax.LITERAL_HINTS)}') and n >= 2 then 'string' end datatype from pk1)"""
)
_DOMAIN = (
    _KINDS
    + """, ty as (select distinct 'u' || user_id term, case when user_id % 3 = 0 then 'Role' else 'Entity' end b from events where user_id % 5 <> 0),
 tj as (select ev.rel, x.b sb, y.b ob from ev left join ty x on x.term = s left join ty y on y.term = o),
 dm as (select rel, b domain_, c top_d, td from (select rel, sb b, count(*) c, sum(count(*)) over (partition by rel) td, row_number() over (partition by rel order by count(*) desc, sb) k from tj where sb is not null group by 1, 2) where k = 1),
 rm as (select rel, b range_, c top_r, tr from (select rel, ob b, count(*) c, sum(count(*)) over (partition by rel) tr, row_number() over (partition by rel order by count(*) desc, ob) k from tj where ob is not null group by 1, 2) where k = 1),
 dr0 as (select pk.*, domain_, range_, coalesce(top_d / td, 0.0) pd, case when kind = 'datatype' then 1.0 else coalesce(top_r / tr, 0.0) end pr, coalesce(td, 0) / n sc, case when kind = 'datatype' then 1.0 else coalesce(tr, 0) / n end oc from pk left join dm using (rel) left join rm using (rel)),
 dr as (select rel, n, kind, coalesce(domain_, '') "domain", case when kind = 'datatype' then 'Literal' else coalesce(range_, '') end "range", round(pd, 4) purity_domain, round(pr, 4) purity_range, round(sc, 4) subject_coverage, round(oc, 4) object_coverage,
 round(0.10 + 0.40 * least(1.0, log10(n + 1) / 2) + 0.35 * least(pd, pr) + 0.15 * least(sc, oc), 4) confidence, case when n >= 2 and pd >= 0.55 and (kind = 'datatype' or pr >= 0.55) and least(sc, oc) >= 0.30 then 'accepted' else 'candidate' end status from dr0)"""
)
_K = lambda c: f"regexp_replace(regexp_replace(lower(trim({c}, ' ')), '[\\s_]+', '', 'g'), 'owl:|rdf:|rdfs:|xsd:', '', 'g')"
_SEC = lambda c: f"regexp_matches(trim({c}, ' '), '^[0-9]+(\\.[0-9]+)*[a-zA-Z]?($|[^\\p{{L}}\\p{{N}}_])')"
_ACT = lambda c: f"string_split(trim(regexp_replace(replace(lower({c}), '-', ' '), '{BLANKS}', ' ', 'g'), ' '), ' ')[1] in {_in(ax.ACTION_VERBS)}"
_CLASS = lambda c: f"case when coalesce(trim({c}, ' '), '') = '' then 'empty' when {_K(c)} in {_in(ax.RESERVED)} then 'reserved' when {_SEC(c)} then 'section' when {_ACT(c)} then 'action'"
_NAMES = f"""sm0 as (select distinct canonical_id, canonical_term, synonyms_json from term_enrichment), sm1 as (select lower(trim(regexp_replace(canonical_term, '{BLANKS}', ' ', 'g'), ' ')) surface, 1 own, canonical_id from sm0
 union all select lower(trim(regexp_replace(unnest(from_json(synonyms_json, '["VARCHAR"]')), '{BLANKS}', ' ', 'g'), ' ')), 0, canonical_id from sm0 where synonyms_json is not null),
 sm as (select surface, max((own, canonical_id))[2] canonical_id from sm1 where surface <> '' group by 1)"""
_SVO = (
    TOKENS_SQL
    + """, v0 as (select *, row_number() over (partition by doc_id, sent_idx order by pos) n from tk where tag not in ('DET', 'ADV', 'AUX')),
 v1 as (select *, case when tag in ('ADJ', 'NOUN', 'PROPN') then 'N' when tag = 'VERB' then 'V' when tag = 'ADP' then 'P' else 'O' end kind from v0),
 v2 as (select *, case when kind = 'N' then n - row_number() over (partition by doc_id, sent_idx, kind order by pos) else -n - 1000 end isl from v1),
 v3 as (select doc_id, sent_idx, kind, isl, min(n) a, string_agg(lemma, ' ' order by pos) tx from v2 group by 1, 2, 3, 4),
 v4 as (select *, lead(kind, 1) over w k1, lead(kind, 2) over w k2, lead(kind, 3) over w k3, lead(tx, 1) over w t1, lead(tx, 2) over w t2, lead(tx, 3) over w t3 from v3 window w as (partition by doc_id, sent_idx order by a)),
 sv as (select doc_id, sent_idx, tx subj, t1 verb, case when k2 = 'P' then t2 else '' end prep, case when k2 = 'N' then t2 else t3 end obj from v4 where kind = 'N' and k1 = 'V' and (k2 = 'N' or (k2 = 'P' and k3 = 'N')))"""
)
_GEN = lambda c: f"len(list_filter(regexp_extract_all(lower({c}), '[a-z0-9_]+'), lambda w: w not in {_in(wl.STOP_WORDS)})) = 0"
_VALID = lambda c: f"(trim({c}, ' ') <> '' and length(trim({c}, ' ')) <= 80 and regexp_matches({c}, '[A-Za-z]') and not regexp_matches(trim({c}, ' '), '[^A-Za-z0-9_\\-\\s/]'))"
_RK = lambda c: f"regexp_replace(replace(lower(trim(regexp_replace({c}, '{BLANKS}', ' ', 'g'), ' ')), ' ', '_'), '[^a-z0-9_]', '', 'g')"
_RAW = "regexp_replace(trim(o, ' '), '^[\"'']+|[\"'']+$', '', 'g')"
_XS = lambda v, k: f"""'"' || {v} || '"^^<http://www.w3.org/2001/XMLSchema#{k}>'"""
_STR = _XS(f"replace(replace(replace({_RAW}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n')", "string")

ORACLE = {
    "tax_closure": _CL + " select node, ancestor, hops from cl",
    "ancestors_bounded": _CL + ", r as (select *, row_number() over (partition by node order by hops, ancestor) rk from cl where hops <= 6) select node, ancestor, hops, rk as rank from r where rk <= 12",
    "tax_depth": _ACYCLIC + ' select node, d as "depth", d + 1 as "level" from d',
    "roots_leaves": f"with {_E}, f as (select * from e where child <> parent) select distinct parent node, 'root' kind from f where parent not in (select child from f) union all select distinct child, 'leaf' from f where child not in (select parent from f)",
    **dict(zip(("components", "component_sizes"), (f"""with recursive {_E}, u as materialized (select child a, parent b from e union select parent, child from e),
 c(node, c) using key (node) as (select a, min(least(a, b)) from u group by a union select u.a, min(c.c) from c join u on u.b = c.node join recurring.c r on r.node = u.a where c.c < r.c group by u.a) select {x} from c {y}"""
     for x, y in (("node, c component", ""), ("c component, count(*) n_nodes", "group by 1"))))),
    "lca_pairs": _ACYCLIC
    + f""", {_CLOSE('ac')}, up as (select distinct node, ancestor from cl union select node, node from d), f as (select parent, min(child) a from ac group by 1), pr as (select distinct a, child b from ac join f using (parent) where a < child),
 j as (select pr.a, pr.b, x.ancestor, d.d from pr join up x on x.node = pr.a join up y on y.node = pr.b and y.ancestor = x.ancestor join d on d.node = x.ancestor) select a, b, arg_min(ancestor, (-d, ancestor)) ancestor from j group by 1, 2""",
    "cycle_report": _CYCLES + " select array_to_string(ns, '>') nodes, len(ns)::int length from cy",
    "cycle_break": _BREAK + " select child, parent, removed from br",
    "bucket_inference": _CL
    + """, lb as (select parent node, upper(parent) lab from e where child <> parent group by 1 having count(distinct child) >= 3), x as (select node, 0 h, lab from lb union all select cl.node, hops, lab from cl join lb on lb.node = cl.ancestor where hops <= 10)
 select node, arg_min(lab, (h, lab)) as "label", min(h)::int hops from x group by 1""",
    "class_clamp": _CL
    + """, c as (select parent node from e where child <> parent group by 1 having count(distinct child) >= 2), t as (select child term from e union select parent from e),
 x as (select node term, 0 h, node c from c union all select cl.node, hops, c.node from cl join c on c.node = cl.ancestor where hops <= 4 and cl.node <> cl.ancestor), m as (select term, min((h, c)) m from x group by 1)
 select term, coalesce(m[2], 'none') as "class", coalesce(m[1], -1)::int hops from t left join m using (term)""",
    "relation_keys": f"""with p as (select distinct p_type, p_brand, p_type || ' - ' || p_brand b from part) select p_type, p_brand, {_RK("b")} k, {_RK("b")} || '_' || {_RK("p_type")} kp,
 trim(regexp_replace(lower(b), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_') ax, {_VALID("b")} as "valid", {_VALID("b || '!'")} bad from p""",
    "generic_spans": f"select distinct title, {_GEN('title')} whole, {_GEN(chr(39).join(['string_split(title, ', ' ', ')[1]']))} as \"first\" from documents where title is not null",
    "relation_diversity": "select l_returnflag || '_' || l_linestatus || '_' || l_linenumber rel, count(*) n, count(distinct l_suppkey) n_subj, count(distinct l_partkey) n_obj from lineitem group by 1 having count(*) >= 100 and count(distinct l_suppkey) >= 50 and count(distinct l_partkey) >= 50",
    "surface_map": f"with {_NAMES} select * from sm",
    "span_canonical": f"""with {_NAMES}, s as (select case when edge_id % 2 = 0 then 'The ' else '' end || coalesce(child_term, '') span from llm_is_a_edges_final union select 'a ' || term_lemma from term_candidates where term_lemma is not null),
 k as (select distinct span, lower(trim(regexp_replace(span, '{BLANKS}', ' ', 'g'), ' ')) k1 from s) select span, coalesce(x.canonical_id, y.canonical_id, -1) canonical_id from k left join sm x on x.surface = k1 left join sm y on y.surface = regexp_replace(k1, '^{wl.either(wl.DETERMINERS)} ', '')""",
    "svo_triples": f"with {_SVO} select doc_id, sent_idx, subj, verb, prep, obj from sv",
    "taxonomy_like_filter": f"""with recursive {_SVO}, te as (select distinct subj child, string_split(subj, ' ')[-1] parent from sv where subj <> string_split(subj, ' ')[-1]),
 tc as (select child node, parent ancestor, 1 h from te union select tc.node, te.parent, h + 1 from tc join te on te.child = tc.ancestor where h < 4), tm as (select node, ancestor, min(h) h from tc group by 1, 2),
 tr as (select distinct subj s, case when length(subj) % 2 = 0 then 'include' else 'hold' end rel, case when length(obj) % 2 = 0 then string_split(subj, ' ')[-1] else obj end o from sv)
 select s, o, rel, case when s = o then 'self' when a.h = 1 then 'direct' when a.h is not null and rel = 'include' then 'ancestor' else 'none' end as "like" from tr left join tm a on a.node = s and a.ancestor = o""",
    "extraction_cascade": f"""with recursive {_SVO}, nm as (select surface, length(surface)::bigint id from (select subj surface from sv union select obj from sv) where length(surface) % 3 <> 0),
 le as materialized (select distinct id child, length(string_split(surface, ' ')[-1])::bigint parent from nm), {_CLOSE('le')},
 x as (select sv.*, not ({_GEN("subj")}) and not ({_GEN("obj")}) and {_VALID("verb")} a, coalesce(s1.id, s2.id) sid, coalesce(o1.id, o2.id) oid, case when prep <> '' then {_RK("verb")} || '_' || {_RK("prep")} else {_RK("verb")} end rel from sv
  left join nm s1 on s1.surface = subj left join nm s2 on s2.surface = regexp_replace(subj, '^{wl.either(wl.DETERMINERS)} ', '') left join nm o1 on o1.surface = obj left join nm o2 on o2.surface = regexp_replace(obj, '^{wl.either(wl.DETERMINERS)} ', '')),
 y as (select *, a and sid is not null and oid is not null b, a and sid <> oid c, coalesce(sid = oid or u.hops = 1 or (u.hops > 1 and rel in {_in([*r.ISA_KEYS, *r.TAXONOMY_KEYS])}) or (w.hops > 0 and rel in {_in(r.ISA_KEYS)}), false) lk
  from x left join cl u on u.node = sid and u.ancestor = oid left join cl w on w.node = oid and w.ancestor = sid)
 select unnest(['extracted', 'specific', 'canonical', 'not_self', 'not_taxonomy', 'distinct']) step, unnest([count(*), count(*) filter (a), count(*) filter (b), count(*) filter (b and c), count(*) filter (b and c and not lk),
 count(distinct case when b and c and not lk then (doc_id, sent_idx, sid, rel, oid) end)]) n from y""",
    "accept_reject": """with v as (select event_id edge_id, event_id % 3 = 0 a, round(value, 2) c, event_id % 4 <> 0 has from events), w as (select edge_id, a and has a, round(case when has then least(1.0, greatest(0.0, case when c > 1 and c <= 10 then c / 10 else c end)) else 0.0 end, 4) confidence from v)
 select edge_id, confidence, case when a and confidence >= 0.5 then 'accept' else 'reject' end decision from w""",
    "json_pick": """with x as (select event_id, 'Sure: ' || case when event_id % 5 = 0 then 'none' else props end || case when event_id % 7 = 0 then ' }' else ' done' end raw from events), y as (select event_id, regexp_extract(raw, '(?s)(\\{.*\\})', 1) j from x)
 select event_id, case when j <> '' and json_valid(j) then j else 'none' end json from y""",
    "literal_types": f"""with {_T}, x as (select o from ev union select '/usr/' || p_name from part union select p_retailprice::decimal(12, 2)::varchar from part)
 select o, coalesce({_LIT("o")} end, 'none') plain, coalesce({_LIT("replace(o, ' ', '_')")} when regexp_matches(replace(o, ' ', '_'), '^(/|\\./|~/)\\S+$') then 'string' end, 'none') with_paths from x""",
    "property_kind": f"with {_KINDS} select rel, n, kind, coalesce(datatype, 'none') datatype from pk",
    "domain_range": f"with {_DOMAIN} select * from dr",
    "assertion_filter": f"""with {_DOMAIN} select ev.rel, kind, count(*) n from ev join dr using (rel) where status = 'accepted' and ({_CLASS("s")} end) is null and (kind = 'datatype' or (({_CLASS("o")} end) is null and lower(trim(o, ' ')) not in {_in(ax.GENERAL_OBJECTS)})) group by 1, 2""",
    "class_admission": f"""with l as (select unnest([p_name, 'run ' || p_name, '3.1 ' || p_name, 'owl:' || p_brand]) lab from part union select term_text from term_candidates where term_text is not null union select unnest(['owl:Thing', 'Data Type Property', 'system', 'Datatype_Property', '']))
 select distinct lab as "label", coalesce({_CLASS("lab")} when length(lab) % 9 = 0 then 'property' end, 'none') problem from l""",
    "tax_edge_load": f"""with x as (select distinct child, case length(child) % 11 when 0 then 'Unknown' when 1 then 'system' when 2 then 'srun' else parent end parent from taxonomy_is_a)
 select child, coalesce(parent, '') parent, coalesce(case when coalesce(lower(trim(child, ' ')) in ('', 'none', 'null', 'unknown'), true) or coalesce(lower(trim(parent, ' ')) in ('', 'none', 'null', 'unknown'), true) then 'null'
 when lower(trim(child, ' ')) = lower(trim(parent, ' ')) then 'self' when {_SEC("child")} or {_SEC("parent")} then 'section' when {_ACT("child")} then 'action' when {_K("child")} in {_in(ax.RESERVED)} or {_K("parent")} in {_in(ax.RESERVED)} then 'reserved'
 when lower(trim(parent, ' ')) in {_in(ax.INSTANCES)} then 'instance' when lower(trim(parent, ' ')) in {_in(ax.GENERAL_PARENTS)} and not length(child) % 2 = 0 then 'general' end, 'none') problem from x""",
    "local_names": """with l as (select distinct unnest([p_name, upper(p_name), replace(p_name, ' ', '-'), '2 ' || p_brand]) lab from part), b as (select lab, array_to_string(list_transform(list_filter(string_split(regexp_replace(lab, '[^A-Za-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), '') b0 from l),
 c as (select lab, case when b0 = '' then 'Unnamed' when regexp_matches(b0, '^[0-9]') then 'N' || b0 else b0 end base from b), d as (select *, row_number() over (partition by base order by lab) n from c)
 select lab as "label", case when n = 1 then base else base || '_' || n end as "name", case when regexp_matches(trim(regexp_replace(lower(lab), '[^a-z0-9]+', '_', 'g'), '_'), '^[0-9]') then 'n_' else '' end || trim(regexp_replace(lower(lab), '[^a-z0-9]+', '_', 'g'), '_') snake from d""",
    "literal_render": f"""with {_T}, x as (select distinct o from ev union all select unnest(['say "x"', 'a\\b', '12.5', '-3', 'On']))
 select o, case when ({_LIT("o")} end) = 'boolean' then {_XS(f"case when lower({_RAW}) in ('true', 'yes', 'on') then 'true' else 'false' end", "boolean")} else {_STR} end b,
 case when regexp_matches({_RAW}, '^[+-]?[0-9]+$') then {_XS(_RAW, "integer")} else {_STR} end i, case when regexp_matches({_RAW}, '^[+-]?[0-9]+(\\.[0-9]+)?$') then {_XS(_RAW, "decimal")} else {_STR} end d, {_STR} s from x""",
    "predicate_filter": f"""with {_T}, x as (select rel from ev union all select 'run_' || lower(replace(p_type, ' ', '_')) || case when p_size % 2 = 0 then '_to' else '' end from part union all select unnest(['related_to', 'Has Space'])), c as (select rel, count(*) n, lower(trim(rel, ' ')) p from x group by 1)
 select rel, n, case when not regexp_matches(p, '^[a-z][a-z0-9]*(_[a-z0-9]+)*$') then 'name' when p in {_in(ax.BANNED_PREDICATES)} then 'banned' when n < 5 then 'count'
 when string_split(p, '_')[1] in {_in(ax.PLAIN_VERBS)} and not (len(string_split(p, '_')) >= 2 and string_split(p, '_')[-1] in {_in(ax.PREDICATE_PREPOSITIONS)}) then 'plain_verb' else 'none' end problem from c""",
    "evidence_sample": f"""with {_T}, x as (select rel, lower(s) ls, lower(o) lo, min((s, o)) m from ev group by 1, 2, 3), y as (select *, row_number() over (partition by rel order by md5('13|' || rel || '|' || ls || '|' || lo)) rk from x) select rel, m[1] s, m[2] o, rk as rank from y where rk <= 5""",
    "axiom_validate": """select event_id, case when event_id % 13 = 0 then 'json' when event_type = 'purchase' or event_id % 11 = 0 then 'predicate' when event_id % 7 = 0 then 'kind' when event_id % 5 = 0 then 'domain' when event_id % 3 = 0 then 'confidence' else 'none' end problem from events""",
    "class_set": f"""with {_T}, a as (select unnest([child, parent]) term, 1 k from taxonomy_is_a where child is not null and trim(parent, ' ') <> '' union all select term, 2 from (select unnest([s, o]) term from ev) where ({_CLASS("term")} end) is null
 union all select unnest([{", ".join(repr(v) for v in ax.BUCKETS.values())}]), 3) select term, ['taxonomy', 'triple', 'upper'][min(k)] as "source" from a where term is not null group by 1""",
}
