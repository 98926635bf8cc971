"""Queries of the general training-data problems (hierarchies, missing references)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.functions.text import label_key_sql
from ontoloom.operators import hierarchy as h
from ontoloom.operators import references as r
from ontoloom.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return h.hierarchy(table(spark, d, "taxonomy_is_a")).select("node", "root", "depth")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    p = h.paths(table(spark, d, "taxonomy_is_a"))
    return p.select("node", "root", "depth", F.array_join("path", " > ").alias("path"), "on_ring", "n_parents")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return h.descendants(h.paths(table(spark, d, "taxonomy_is_a")))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    occ, enr, edges = (table(spark, d, t) for t in ("term_occurrences", "term_enrichment", "llm_is_a_edges_final"))
    version = F.concat(F.lit("v"), F.col("cleaned_version").cast("string"))
    month = r.month_of(F.col("created_at"))
    refs = [
        r.Reference(occ, "term_occurrences", "term_id", "term_candidates", F.coalesce(version, F.lit("none"))),
        r.Reference(enr, "term_enrichment", "canonical_id", "term_candidates", month, F.col("created_at")),
        r.Reference(edges, "llm_is_a_edges_final", "child_term_id", "llm_terms_final", month),
        r.Reference(edges, "llm_is_a_edges_final", "parent_term_id", "llm_terms_final", month),
    ]
    return r.orphan_references(
        refs,
        [
            r.Target(table(spark, d, "term_candidates"), "term_candidates", "term_id", F.col("created_at")),
            r.Target(table(spark, d, "llm_terms_final"), "llm_terms_final", "term_id"),
        ],
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_column", "period", "ref_id")


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    return r.orphan_summary(_orphans(spark, d))


QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants, "p7_found": p7_found, "p7_summary": p7_summary}

_TREE = f"""
with recursive e as (select distinct {label_key_sql("child")} c, {label_key_sql("parent")} p from taxonomy_is_a),
n as (select node, min(parent) parent, count(distinct parent)::int n_parents from (
    select c node, case when p <> c then p end parent from e where c is not null union all select p, null from e where p is not null) group by node),
t as (select node, node root, 0 depth, node path from n where parent is null
      union all select n.node, t.root, t.depth + 1, t.path || ' > ' || n.node from n join t on n.parent = t.node)"""

_MISSING = """
with c as (select term_id, min(created_at) since_at from term_candidates where term_id is not null group by 1),
l as (select distinct term_id from llm_terms_final where term_id is not null),
x as (
 select 'term_occurrences' ref_table, 'term_id' ref_column, coalesce('v' || cleaned_version, 'none') period, o.term_id ref_id, 'missing' reason
 from term_occurrences o left join c using (term_id) where o.term_id is not null and c.term_id is null
 union all select 'term_enrichment', 'canonical_id', coalesce(strftime(e.created_at, '%Y-%m'), 'none'), canonical_id, case when c.term_id is null then 'missing' else 'later' end
 from term_enrichment e left join c on c.term_id = canonical_id where canonical_id is not null and (c.term_id is null or exists (
   select 1 from term_enrichment f where f.canonical_id = e.canonical_id and f.created_at < c.since_at and strftime(f.created_at, '%Y-%m') is not distinct from strftime(e.created_at, '%Y-%m')))
 union all select 'llm_is_a_edges_final', 'child_term_id', coalesce(strftime(created_at, '%Y-%m'), 'none'), child_term_id, 'missing'
 from llm_is_a_edges_final left join l on l.term_id = child_term_id where child_term_id is not null and l.term_id is null
 union all select 'llm_is_a_edges_final', 'parent_term_id', coalesce(strftime(created_at, '%Y-%m'), 'none'), parent_term_id, 'missing'
 from llm_is_a_edges_final left join l on l.term_id = parent_term_id where parent_term_id is not null and l.term_id is null)"""

ORACLE = {
    "p3_found": _TREE + " select n.node, coalesce(t.root, '') root, coalesce(t.depth, -1) depth from n left join t using (node)",
    "p3_paths": _TREE + " select n.node, coalesce(t.root, '') root, coalesce(t.depth, -1) depth, t.path, t.node is null on_ring, n_parents from n left join t using (node)",
    "p3_descendants": _TREE
    + ", a as (select node, node descendant, 0 distance from t union all select n.parent, a.descendant, a.distance + 1 from a join n on n.node = a.node where n.parent is not null)"
    + " select node, descendant, distance from a where distance > 0",
    "p7_found": _MISSING + " select distinct ref_table, ref_column, period, ref_id from x",
    "p7_summary": _MISSING + " select ref_table, ref_column, period, reason, count(distinct ref_id) n_ids, count(*) n_refs from x group by 1, 2, 3, 4",
}
