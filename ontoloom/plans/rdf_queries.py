"""Queries of RDF output and evaluation, Turtle text, model output and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.operators import graph as g
from ontoloom.operators import labelling as lb
from ontoloom.operators import rdf
from ontoloom.operators import turtle_text as tt
from ontoloom.plans import pipeline
from ontoloom.plans.term_queries import _in
from ontoloom.sources.tables import table

BASE = "http://example.org/o#"


def _triples(spark: SparkSession, d: str) -> DataFrame:
    """Regions as classes under Place; nations and suppliers as their instances; relations with domains and ranges, some of them violated."""
    reg, nat, sup = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    classes = reg.select(F.concat(F.lit("R"), "r_regionkey").alias("name"), F.col("r_name").alias("label")).union(spark.createDataFrame([("Place", "Place"), ("Supplier", "Supplier"), ("balance", "Balance")], "name string, label string"))
    links = reg.select(F.concat(F.lit("R"), "r_regionkey").alias("child"), F.lit("Place").alias("parent"))
    props = spark.createDataFrame([("in", "object", "Supplier", "R1"), ("balance", "datatype", "Supplier", "decimal"), ("near", "object", "Place", "Place"), ("near", "datatype", "", "")], "name string, kind string, domain string, range string")
    n = F.concat(F.lit("N"), "n_nationkey")
    facts = sup.select(F.concat(F.lit("S"), "s_suppkey").alias("s"), F.lit("in").alias("rel"), F.concat(F.lit("N"), "s_nationkey").alias("o"), F.lit(False).alias("literal"), F.lit("").alias("datatype"))
    facts = facts.union(sup.select(F.concat(F.lit("S"), "s_suppkey"), F.lit("balance"), F.col("s_acctbal").cast("decimal(12,2)").cast("string"), F.col("s_suppkey") % 3 != 0, F.lit("decimal")))
    facts = facts.union(nat.select(n, F.lit("near"), F.concat(F.lit("N"), (F.col("n_nationkey") + 1) % 25), F.lit(False), F.lit(""))).union(nat.select(n, F.lit("size"), F.lit("5"), F.lit(True), F.lit("integer")))
    facts = facts.union(sup.where("s_suppkey % 5 = 0").select(F.concat(F.lit("S"), "s_suppkey"), F.lit("near"), F.lit("here"), F.lit(True), F.lit("string")))
    t = rdf.ontology(classes, links, props, facts, BASE)
    types = nat.select(n.alias("s"), F.concat(F.lit("R"), "n_regionkey").alias("o")).union(sup.where("s_suppkey % 4 <> 0").select(F.concat(F.lit("S"), "s_suppkey"), F.lit("Supplier")))
    return t.unionByName(types.select(*rdf.triple(F.concat(F.lit(BASE), "s"), rdf.TYPE, F.concat(F.lit(BASE), "o"))))


def _closed(t: DataFrame) -> DataFrame:
    return g.closure(rdf.taxonomy(t), 8)


def rdf_triples(spark: SparkSession, d: str) -> DataFrame:
    return _triples(spark, d)


def ntriples_export(spark: SparkSession, d: str) -> DataFrame:
    return rdf.n_triples(_triples(spark, d))


def reified_edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "taxonomy_is_a").where("child is not null and trim(parent) <> ''").select(F.md5("child").alias("child"), F.md5("parent").alias("parent"), "method")
    return rdf.reified_edges(e, BASE)


def rdf_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rdf.structure(_triples(spark, d))


def predicate_freq(spark: SparkSession, d: str) -> DataFrame:
    return rdf.predicate_frequencies(_triples(spark, d))


def dup_count(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "taxonomy_is_a").select("child", "parent", "method")
    return e.agg(F.count("*").alias("n"), F.count_distinct(F.struct("child", "parent", "method")).alias("n_distinct")).withColumn("repeated", F.col("n") - F.col("n_distinct"))


def rdf_schema(spark: SparkSession, d: str) -> DataFrame:
    return rdf.schema_problems(_triples(spark, d))


def rdf_usage(spark: SparkSession, d: str) -> DataFrame:
    t = _triples(spark, d)
    return rdf.usage_problems(t, _closed(t))


def rdf_extract(spark: SparkSession, d: str) -> DataFrame:
    return rdf.concepts(_triples(spark, d))


def iri_short(spark: SparkSession, d: str) -> DataFrame:
    x = _triples(spark, d).select(F.explode(F.array("s", "p")).alias("iri")).distinct()
    return x.select("iri", rdf.short_name(F.col("iri")).alias("short"), rdf.display(F.col("iri"), {"o": BASE, "rdfs": rdf.RDFS, "owl": rdf.OWL}).alias("shown"))


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    t = _triples(spark, d)
    return rdf.quality_report(t, _closed(t))


def manual_precision(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 10 < 6, "Valid").when(F.col("event_id") % 10 < 8, " invalid").when(F.col("event_id") % 10 == 8, "AMBIGUOUS").otherwise("").alias("label"))
    p = rdf.manual_precision(e)
    return p.withColumn("precision", F.round("precision", 6)).withColumn("strict_precision", F.round("strict_precision", 6))


def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return rdf.sample(table(spark, d, "part").select("p_partkey", "p_name"), 50)


def _turtle(spark: SparkSession, d: str) -> DataFrame:
    p, k = table(spark, d, "part"), F.col("p_partkey")
    name = F.concat(F.lit("hpc:"), F.when(k % 7 == 0, "-").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("_")))
    a = F.concat(name, F.lit(" a owl:Class ;\n    rdfs:label \""), F.col("p_name"), F.lit('"'), F.when(k % 5 == 0, " ;").otherwise(" ."))
    b = F.concat(F.lit("rdfs:domain(hpc:r"), k % 10, F.lit(") "), name, F.lit(" .\n"), F.when(k % 3 == 0, "12 hpc:x\nplain words here\nhpc:y ;").otherwise("# note"))
    c = F.concat(name, F.lit(" hpc:r ["), F.lit(" hpc:x 1 "), F.when(k % 11 == 0, "").otherwise("]"), F.lit(" ."))
    e = F.when(k % 4 == 0, F.lit('"lit" hpc:p hpc:q .')).otherwise(F.lit(""))
    return p.select(k.alias("id"), F.concat_ws("\n\n", a, b, c, e).alias("text"))


def turtle_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = tt.blocks(_turtle(spark, d))
    return b.select("id", "block_no", F.coalesce(tt.block_problem(F.col("block")), F.lit("kept")).alias("problem"))


def turtle_lines(spark: SparkSession, d: str) -> DataFrame:
    t = _turtle(spark, d).select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return t.select("id", "pos", tt.line_rule(F.col("line")).alias("rule"), tt.rewrite_line(F.col("line")).alias("line"))


def dangling_semicolon(spark: SparkSession, d: str) -> DataFrame:
    t = _turtle(spark, d).select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return tt.fix_endings(t, ["id"]).select("id", "pos", "fixed")


def turtle_salvage(spark: SparkSession, d: str) -> DataFrame:
    pre = f"@prefix hpc: <{BASE}> .\n@prefix owl: <{rdf.OWL}> .\n@prefix rdfs: <{rdf.RDFS}> .\n"
    s = tt.salvage(_turtle(spark, d), pre)
    return s.select("id", "block_no", F.when(F.col("problem").rlike("^[a-z_]+$"), F.col("problem")).when(F.col("problem").isNull(), "kept").otherwise("unreadable").alias("problem"))


def turtle_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    lines = rdf.n_triples(_triples(spark, d)).select(F.col("line").alias("text"), F.md5("line").alias("id"))
    return rdf.read_turtle(lines).select("s", "p", "o", "o_kind", F.coalesce("o_datatype", F.lit("")).alias("o_datatype"))


def fragment_names(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "llm_terms_final").select("chunk_id", "doc_id").distinct()
    return tt.shard(t, 4, 1, "doc_id").select("chunk_id", tt.fragment_id(F.concat("chunk_id", F.lit(" /x:"))).alias("name"))


def model_labels(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "term_candidates").where("term_text is not null").select("term_id", "term_text").distinct()
    a = lb.generate(t.withColumn("prompt", lb.prompt_column('Label the term "{term_text}"')), "prompt", lb.rule_labeller)
    j = F.parse_json(lb.first_json_udf("answer"))
    return a.select("term_id", F.try_variant_get(j, "$.ontology_role", "string").alias("role"), lb.to_confidence(F.try_variant_get(j, "$.confidence", "string")).alias("confidence"))


def pipeline_terms(spark: SparkSession, d: str) -> DataFrame:
    plan = pipeline.between(pipeline.build(), "ingest", "terms")
    c, log = pipeline.run_plan(plan, {"documents": table(spark, d, "documents")}, store=True)
    if any(s != "done" for _, s, _ in log):
        raise RuntimeError(str(log))
    return c["term_candidates"].select("term_lemma", "freq_total", "freq_docs", F.round("tf_idf", 6).alias("tf_idf"))


def _branch(spark: SparkSession, d: str, branch: str) -> pipeline.Catalog:
    c, log = pipeline.run_plan(pipeline.build(branch), {"documents": table(spark, d, "documents")}, store=True)
    if any(s != "done" for _, s, _ in log):
        raise RuntimeError(str(log))
    return c


def _by_predicate(c: pipeline.Catalog) -> DataFrame:
    return c["rdf"].groupBy(rdf.short_name(F.col("p")).alias("predicate"), "o_kind").agg(F.count("*").alias("n"))


def pipeline_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _by_predicate(_branch(spark, d, "hybrid"))


def pipeline_llm(spark: SparkSession, d: str) -> DataFrame:
    return _by_predicate(_branch(spark, d, "llm"))


def pipeline_direct(spark: SparkSession, d: str) -> DataFrame:
    return _by_predicate(_branch(spark, d, "direct"))


QUERIES = {
    f.__name__: f
    for f in (
        rdf_triples, ntriples_export, reified_edges, rdf_coverage, predicate_freq, dup_count, rdf_schema, rdf_usage, rdf_extract, iri_short, quality_report, manual_precision, sample_rows, turtle_blocks, turtle_lines,
        dangling_semicolon, turtle_salvage, turtle_roundtrip, fragment_names, model_labels, pipeline_terms, pipeline_hybrid, pipeline_llm, pipeline_direct,
    )
}

_C = lambda x: f"'{BASE}' || {x}"
_TRIPLES = f"""
cls as (select 'R' || r_regionkey n, r_name l from region union all select unnest(['Place', 'Supplier', 'balance']), unnest(['Place', 'Supplier', 'Balance'])),
prp as (select * from (values ('in', 'object', 'Supplier', 'R1'), ('balance', 'datatype', 'Supplier', 'decimal'), ('near', 'object', 'Place', 'Place'), ('near', 'datatype', '', '')) t(n, k, d, r)),
fct as (select 'S' || s_suppkey s, 'in' r, 'N' || s_nationkey o, false l, '' dt from supplier union all select 'S' || s_suppkey, 'balance', s_acctbal::decimal(12, 2)::varchar, s_suppkey % 3 <> 0, 'decimal' from supplier
 union all select 'N' || n_nationkey, 'near', 'N' || ((n_nationkey + 1) % 25), false, '' from nation union all select 'N' || n_nationkey, 'size', '5', true, 'integer' from nation union all select 'S' || s_suppkey, 'near', 'here', true, 'string' from supplier where s_suppkey % 5 = 0),
t as (select distinct * from (select {_C("n")} s, '{rdf.TYPE}' p, '{rdf.OWL}Class' o, 'iri' o_kind, '' o_datatype from cls union all select {_C("n")}, '{rdf.LABEL}', l, 'literal', '{rdf.XSD}string' from cls
 union all select {_C("'R' || r_regionkey")}, '{rdf.SUBCLASS}', {_C("'Place'")}, 'iri', '' from region union all select {_C("n")}, '{rdf.TYPE}', '{rdf.OWL}' || case when k = 'datatype' then 'DatatypeProperty' else 'ObjectProperty' end, 'iri', '' from prp
 union all select {_C("n")}, '{rdf.DOMAIN}', {_C("d")}, 'iri', '' from prp where d <> '' union all select {_C("n")}, '{rdf.RANGE}', case when k = 'datatype' then '{rdf.XSD}' || r else {_C("r")} end, 'iri', '' from prp where r <> ''
 union all select {_C("s")}, {_C("r")}, case when l then o else {_C("o")} end, case when l then 'literal' else 'iri' end, case when l then '{rdf.XSD}' || dt else '' end from fct)
 union all select {_C("'N' || n_nationkey")}, '{rdf.TYPE}', {_C("'R' || n_regionkey")}, 'iri', '' from nation union all select {_C("'S' || s_suppkey")}, '{rdf.TYPE}', {_C("'Supplier'")}, 'iri', '' from supplier where s_suppkey % 4 <> 0)"""
_REL = f"p not in {_in(rdf.SCHEMA_PREDICATES)}"
_DECL = f"""dc as (select distinct s iri, case o when '{rdf.OWL}Class' then 'class' when '{rdf.OWL}ObjectProperty' then 'object' when '{rdf.OWL}DatatypeProperty' then 'datatype' end kind from t where p = '{rdf.TYPE}' and o in ('{rdf.OWL}Class', '{rdf.OWL}ObjectProperty', '{rdf.OWL}DatatypeProperty')),
dk as (select iri, list(kind) k from dc group by 1)"""
_STRUCT = f"""select 'declared' "section", kind metric, count(*) "value" from dc group by 2 union all select 'statements', unnest(['statements', 'repeated', 'links', 'relations', 'literals']),
 unnest([count(*), count(*) - count(distinct (s, p, o, o_kind, o_datatype)), count(*) filter (p = '{rdf.SUBCLASS}'), count(*) filter ({_REL}), count(*) filter (o_kind = 'literal')]) from t"""
_SCHEMA = f"""sp as (select 'class_and_property' problem, iri from dk where list_contains(k, 'class') and list_has_any(k, ['object', 'datatype']) union select 'object_and_datatype', iri from dk where list_contains(k, 'object') and list_contains(k, 'datatype')
 union select 'object_with_literal_range', s from t join dk on iri = s where p = '{rdf.RANGE}' and starts_with(o, '{rdf.XSD}') and list_contains(k, 'object') union select 'datatype_with_other_range', s from t join dk on iri = s where p = '{rdf.RANGE}' and not starts_with(o, '{rdf.XSD}') and list_contains(k, 'datatype')
 union select 'undeclared', p from t where {_REL} and p not in (select iri from dc where kind in ('object', 'datatype')))"""
_USAGE = f"""ty0 as (select s x, o c from t where p = '{rdf.TYPE}' and o not in {_in(rdf.DECLARATIONS)}), ty1 as (select x, c from ty0 union select x, y.o from ty0 join t y on y.s = c and y.p = '{rdf.SUBCLASS}'), ty as (select x, list(c) cs from ty1 group by 1),
 dm as (select s p, list(o) ds from t where t.p = '{rdf.DOMAIN}' group by 1), rg as (select s p, list_filter(list(o), lambda q: not starts_with(q, '{rdf.XSD}')) rs from t where t.p = '{rdf.RANGE}' group by 1),
 u0 as (select t.s, t.p, t.o, o_kind, ds, rs, a.cs st, b.cs ot, coalesce(k, []) k from t left join dm using (p) left join rg using (p) left join dk on dk.iri = t.p left join ty a on a.x = t.s left join ty b on b.x = t.o where {_REL.replace("p not", "t.p not")}),
 us as (select distinct problem, s, p, o from (select unnest([case when len(ds) > 0 and len(st) > 0 and not list_has_any(st, ds) then 'domain' end, case when o_kind <> 'literal' and len(rs) > 0 and len(ot) > 0 and not list_has_any(ot, rs) then 'range' end,
  case when o_kind = 'literal' and list_contains(k, 'object') then 'literal_object' end, case when o_kind <> 'literal' and list_contains(k, 'datatype') then 'resource_value' end]) problem, s, p, o from u0) where problem is not null)"""
_NT = """'<' || s || '> <' || p || '> ' || case when o_kind = 'literal' then '"' || replace(replace(o, '\\', '\\\\'), '"', '\\"') || '"' || case when o_datatype <> '' then '^^<' || o_datatype || '>' else '' end else '<' || o || '>' end || ' .'"""
_NM = "'hpc:' || case when p_partkey % 7 = 0 then '-' else '' end || replace(p_name, ' ', '_')"
_TEXT = f"""tx as (select p_partkey id, {_NM} || ' a owl:Class ;' || chr(10) || '    rdfs:label "' || p_name || '"' || case when p_partkey % 5 = 0 then ' ;' else ' .' end || chr(10) || chr(10) || 'rdfs:domain(hpc:r' || (p_partkey % 10) || ') ' || {_NM} || ' .' || chr(10) ||
 case when p_partkey % 3 = 0 then '12 hpc:x' || chr(10) || 'plain words here' || chr(10) || 'hpc:y ;' else '# note' end || chr(10) || chr(10) || {_NM} || ' hpc:r [' || ' hpc:x 1 ' || case when p_partkey % 11 = 0 then '' else ']' end || ' .' || chr(10) || chr(10) || case when p_partkey % 4 = 0 then '"lit" hpc:p hpc:q .' else '' end txt from part)"""
_LINES = f"{_TEXT}, ln as (select id, generate_subscripts(a, 1) - 1 pos, unnest(a) line from (select id, string_split(txt, chr(10)) a from tx))"
_BARE = """regexp_replace(block, '"(?:[^"\\\\]|\\\\.)*"', '""', 'g')"""

ORACLE = {
    "rdf_triples": f"with {_TRIPLES} select s, p, o, o_kind, o_datatype from t",
    "ntriples_export": f"with {_TRIPLES} select {_NT} line from t",
    "reified_edges": f"""with e as (select distinct md5(child) c, md5(parent) p, method m from taxonomy_is_a where child is not null and trim(parent, ' ') <> ''), n as (select *, '_:e' || md5(c || '|' || p || '|' || m) b from e)
 select distinct {_C("c")} s, '{rdf.SUBCLASS}' p, {_C("p")} o, 'iri' o_kind, '' o_datatype from n union all select b, '{rdf.OWL}annotatedSource', {_C("c")}, 'iri', '' from n union all select b, '{rdf.OWL}annotatedTarget', {_C("p")}, 'iri', '' from n
 union all select b, '{BASE}method', m, 'literal', '{rdf.XSD}string' from n""",
    "rdf_coverage": f"with {_TRIPLES}, {_DECL} {_STRUCT}",
    "predicate_freq": f"with {_TRIPLES} select p, count(*) n from t where {_REL} group by 1 order by n desc, p limit 10",
    "dup_count": "select count(*) n, count(distinct (child, parent, method)) n_distinct, count(*) - count(distinct (child, parent, method)) repeated from taxonomy_is_a",
    "rdf_schema": f"with {_TRIPLES}, {_DECL}, {_SCHEMA} select problem, iri from sp",
    "rdf_usage": f"with {_TRIPLES}, {_DECL}, {_USAGE} select problem, s, p, o from us",
    "rdf_extract": f"""with {_TRIPLES}, {_DECL}, nm as (select iri from dc where kind = 'class' union select unnest([s, o]) from t where p = '{rdf.SUBCLASS}'), lb as (select s iri, min(o) l from t where p = '{rdf.LABEL}' group by 1)
 select min(coalesce(l, regexp_extract(nm.iri, '([^#/:]*)$', 1))) term from nm left join lb using (iri) where not starts_with(nm.iri, '{rdf.OWL}') group by lower(coalesce(l, regexp_extract(nm.iri, '([^#/:]*)$', 1)))""",
    "iri_short": f"""with {_TRIPLES}, x as (select distinct unnest([s, p]) iri from t) select iri, regexp_extract(iri, '([^#/:]*)$', 1) short, case when starts_with(iri, '{rdf.RDFS}') then 'rdfs:' || substr(iri, {len(rdf.RDFS) + 1})
 when starts_with(iri, '{rdf.OWL}') then 'owl:' || substr(iri, {len(rdf.OWL) + 1}) when starts_with(iri, '{BASE}') then 'o:' || substr(iri, {len(BASE) + 1}) else '<' || iri || '>' end shown from x""",
    "quality_report": f"with {_TRIPLES}, {_DECL}, {_SCHEMA}, {_USAGE} {_STRUCT} union all select 'schema', problem, count(*) from sp group by 2 union all select 'usage', problem, count(*) from us group by 2",
    "manual_precision": """with l as (select event_id % 10 m from events) select count(*) filter (m < 6) "valid", count(*) filter (m in (6, 7)) invalid, count(*) filter (m = 8) ambiguous, count(*) filter (m = 9) "other",
 round(count(*) filter (m < 6) / count(*) filter (m <= 8), 6) "precision", round(count(*) filter (m < 6) / count(*) filter (m <= 7), 6) strict_precision from l""",
    "sample_rows": "select p_partkey, p_name from part order by md5('42|' || p_name || '|' || p_partkey) limit 50",
    "turtle_blocks": f"""with {_TEXT}, bk0 as (select id, generate_subscripts(a, 1)::int - 1 block_no, unnest(a) block from (select id, regexp_split_to_array(trim(txt, ' '), '\\n\\s*\\n') a from tx)), bk as (select *, regexp_extract(block, '(?m)^[ \\t]*([^#\\s].*)$', 1) f, {_BARE} bare from bk0 where trim(block, ' ') <> '')
 select id, block_no, case when regexp_matches(f, '^[A-Za-z][A-Za-z0-9_-]*:-') then 'dash_subject' when regexp_matches(bare, '(^|\\s)[A-Za-z][A-Za-z0-9_-]*:-') then 'dash_name' when length(regexp_replace(bare, '[^\\[]', '', 'g')) <> length(regexp_replace(bare, '[^\\]]', '', 'g')) then 'brackets'
 when regexp_matches(block, '(^|\\n)\\s*"(?:[^"\\\\]|\\\\.)*"(?:\\^\\^\\S+)?\\s+[^\\s.;,]') then 'literal_predicate' else 'kept' end problem from bk""",
    "turtle_lines": f"""with {_LINES}, s as (select id, pos, trim(line, ' ') s from ln) select id, pos::int pos, case when regexp_matches(s, '^rdfs:domain\\([^)]+\\)\\s+\\S+\\s*\\.$') then 'rewrite_domain' when regexp_matches(s, '^-?[0-9]+(\\.[0-9]+)?\\s+\\S') then 'drop_number'
 when regexp_matches(s, '^[A-Za-z][A-Za-z0-9_-]*:[A-Za-z0-9_-]+\\s*[;.]$') then 'drop_empty_object' when s <> '' and not starts_with(s, '#') and not regexp_matches(s, '[:<>"\\[\\].;]') then 'drop_prose' else 'keep' end "rule",
 regexp_replace(s, '^(rdfs:(?:domain|range))\\(\\s*([^)]+?)\\s*\\)\\s+(\\S+)\\s*\\.$', '\\2 \\1 \\3 .') line from s""",
    "dangling_semicolon": f"""with {_LINES}, s as (select id, pos, regexp_replace(line, '\\s+$', '') s, trim(line, ' ') <> '' and not starts_with(trim(line, ' '), '#') re from ln),
 n as (select *, first(case when re then s end ignore nulls) over (partition by id order by pos rows between 1 following and unbounded following) nx from s)
 select id, pos::int pos, case when re and ends_with(s, ';') and (nx is null or regexp_matches(nx, '^\\S')) then regexp_replace(s, '\\s*;$', ' .') when re and ends_with(s, '.') and regexp_matches(nx, '^\\s+\\S') then regexp_replace(s, '\\s*\\.$', ' ;') else s end fixed from n""",
    "turtle_roundtrip": f"with {_TRIPLES} select s, p, o, o_kind, o_datatype from t",
    "fragment_names": "select distinct chunk_id, regexp_replace(chunk_id || ' /x:', '[^A-Za-z0-9._-]+', '_', 'g') as \"name\" from llm_terms_final where doc_id % 4 = 1",
}
