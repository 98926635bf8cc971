"""Axioms: admission of classes and links, literal types, property kinds, domains and ranges, names, validation of proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ontoloom.functions.text import last, squeeze
from ontoloom.operators.relations import axiom_relation_key

#: Names reserved by the vocabularies (without blanks, underscores and prefix), verbs that begin actions, parents too general or instances.
RESERVED = (
    "thing nothing literal resource class property objectproperty datatypeproperty functionalproperty transitiveproperty symmetricproperty asymmetricproperty irreflexiveproperty topdataproperty bottomdataproperty "
    "topobjectproperty bottomobjectproperty nonnegativeinteger integer decimal boolean string"
).split()
ACTION_VERBS = "access grant accept use create start stop run set get show enable disable configure request assign allocate cancel submit launch kill".split()
GENERAL_PARENTS = "system information data thing value parameter option slurm lsf scheduler".split()
INSTANCES = "slurmdbd slurmctld slurmd munged srun sbatch salloc sacct scontrol squeue sinfo".split()
PROPERTY_ROLES = "property predicate relation objectproperty datatypeproperty datatype_property".split()
BUCKETS = {"object": "Entity", "situation": "Situation", "process": "Process", "event": "Event", "description": "Description", "role": "Role", "informationobject": "InformationObject"}
#: Parts of relation names that hint at literals; predicates never used; verbs too plain; prepositions; objects too general.
LITERAL_HINTS = (
    "path dir file filename location port ip address time timeout duration interval date count num number size limit max min memory mem cpu cpus gpu gpus version format type mode state ratio factor usage shares priority"
).split()
BANNED_PREDICATES = "related_to associated_with has have do does did make made create created add add_to use uses set sets enable enabled disable disabled".split()
PLAIN_VERBS = (
    "add get set run use make create apply allocate bind submit request show list print see do does did start stop enable disable configure register save load read write execute launch kill cancel take have"
).split()
PREDICATE_PREPOSITIONS = "to from in on with for into via as by".split()
GENERAL_OBJECTS = "number value thing data information message result request maximum minimum system option parameter".split()


def _key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[\s_]+", ""), "owl:|rdf:|rdfs:|xsd:", "")


def section_id(c: Column) -> Column:
    return F.trim(c).rlike(r"^[0-9]+(\.[0-9]+)*[a-zA-Z]?($|[^\p{L}\p{N}_])")


def action(c: Column) -> Column:
    return F.split(squeeze(F.replace(F.lower(c), F.lit("-"), F.lit(" "))), " ")[0].isin(ACTION_VERBS)


def class_problem(term: Column, role: Column | None = None) -> Column:
    """Why a term is no class: empty, reserved, section, action, property; null if it is one."""
    c = F.when(F.coalesce(F.trim(term), F.lit("")) == "", "empty").when(_key(term).isin(RESERVED), "reserved").when(section_id(term), "section").when(action(term), "action")
    return c if role is None else c.when(F.lower(F.trim(role)).isin(PROPERTY_ROLES), "property")


def null_like(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("", "none", "null", "unknown"), F.lit(True))


def link_problem(child: Column, parent: Column, typed: Column) -> Column:
    """Why an is-a link is not admitted: null, self, section, action, reserved, instance, general; null if it is. ``typed``: the child has a type, which allows general parents."""
    p = F.lower(F.trim(parent))
    return (
        F.when(null_like(child) | null_like(parent), "null").when(F.lower(F.trim(child)) == p, "self").when(section_id(child) | section_id(parent), "section").when(action(child), "action")
        .when(_key(child).isin(RESERVED) | _key(parent).isin(RESERVED), "reserved").when(p.isin(INSTANCES), "instance").when(p.isin(GENERAL_PARENTS) & ~typed, "general")
    )


def bucket(c: Column) -> Column:
    """The upper class of a bucket name; names that aren't in the map stay as they are."""
    m = F.create_map(*(F.lit(x) for kv in BUCKETS.items() for x in kv))
    s = F.nullif(F.lower(F.trim(c)), F.lit(""))
    return F.coalesce(m[s], s)


def literal_type(c: Column, paths: bool = False) -> Column:
    """boolean, integer, decimal (and string for paths, if asked) where an object looks like a literal, else null."""
    s = F.regexp_replace(F.trim(c), "^[\"']+|[\"']+$", "")
    t = F.when(F.lower(s).rlike("^(true|false|yes|no|on|off)$"), "boolean").when(s.rlike(r"^[+-]?[0-9]+$"), "integer").when(s.rlike(r"^[+-]?[0-9]+\.[0-9]+$"), "decimal")
    return t.when(s.rlike(r"^(/|\./|~/)\S+$"), "string") if paths else t


def property_kinds(triples: DataFrame, min_ratio: float = 0.55) -> DataFrame:
    """``rel, n, kind, datatype``: datatype if one literal type has the share ``min_ratio``, or any share with a hint in the name; with a hint and two or more rows, string."""
    t = triples.select("rel", literal_type(F.col("o")).alias("t"))
    per = t.groupBy("rel", "t").agg(F.count("*").alias("c"))
    g = per.groupBy("rel").agg(F.sum("c").alias("n"), F.max(F.when(F.col("t").isNotNull(), F.struct("c", "t"))).alias("best"))
    hint = F.lower("rel").rlike("|".join(LITERAL_HINTS))
    typed = F.col("best").isNotNull() & ((F.col("best.c") / F.col("n") >= min_ratio) | hint)
    text = hint & (F.col("n") >= 2)
    return g.select("rel", "n", F.when(typed | text, "datatype").otherwise("object").alias("kind"), F.when(typed, F.col("best.t")).when(text, "string").alias("datatype"))


def domains_and_ranges(triples: DataFrame, types: DataFrame, min_support: int = 2, min_purity: float = 0.55) -> DataFrame:
    """One row per relation: the commonest type of subjects and objects, purity, coverage, confidence and status, all in one pass.

    ``triples``: s, rel, o; ``types``: term, bucket. Ties go to the smaller name. Literal relations have range Literal.
    """
    k = types.where("bucket is not null").groupBy("term").agg(F.max("bucket").alias("bucket"))
    j = triples.join(k.select(F.col("term").alias("s"), F.col("bucket").alias("sb")), "s", "left").join(k.select(F.col("term").alias("o"), F.col("bucket").alias("ob")), "o", "left")
    def mode(side: str, out: str) -> DataFrame:
        per = j.where(F.col(side).isNotNull()).groupBy("rel", side).agg(F.count("*").alias("c"))
        return per.groupBy("rel").agg(F.min(F.struct((-F.col("c")).alias("m"), F.col(side).alias("b"))).alias("x"), F.sum("c").alias(f"typed_{out}")).select("rel", F.col("x.b").alias(out), (-F.col("x.m")).alias(f"top_{out}"), f"typed_{out}")
    t = property_kinds(triples).join(mode("sb", "domain"), "rel", "left").join(mode("ob", "range"), "rel", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    lit = F.col("kind") == "datatype"
    purity = lambda s: F.when(zero(f"typed_{s}") > 0, F.col(f"top_{s}") / F.col(f"typed_{s}")).otherwise(0.0)
    t = t.withColumn("purity_domain", purity("domain")).withColumn("purity_range", F.when(lit, 1.0).otherwise(purity("range")))
    t = t.withColumn("subject_coverage", zero("typed_domain") / F.col("n")).withColumn("object_coverage", F.when(lit, 1.0).otherwise(zero("typed_range") / F.col("n")))
    cover = F.least("subject_coverage", "object_coverage")
    conf = 0.10 + 0.40 * F.least(F.lit(1.0), F.log10(F.col("n") + 1) / 2) + 0.35 * F.least("purity_domain", "purity_range") + 0.15 * cover
    ok = (F.col("n") >= min_support) & (F.col("purity_domain") >= min_purity) & (lit | (F.col("purity_range") >= min_purity)) & (cover >= 0.30)
    return t.select(
        "rel", "n", "kind", F.coalesce("domain", F.lit("")).alias("domain"), F.when(lit, "Literal").otherwise(F.coalesce("range", F.lit(""))).alias("range"), F.round("purity_domain", 4).alias("purity_domain"),
        F.round("purity_range", 4).alias("purity_range"), F.round("subject_coverage", 4).alias("subject_coverage"), F.round("object_coverage", 4).alias("object_coverage"), F.round(conf, 4).alias("confidence"),
        F.when(ok, "accepted").otherwise("candidate").alias("status"),
    )


def keep_assertions(triples: DataFrame, axioms: DataFrame) -> DataFrame:
    """Triples of accepted relations whose subject is admitted and whose object is a literal or an admitted, not too general term."""
    t = triples.join(axioms.where("status = 'accepted'").select("rel", "kind"), "rel")
    return t.where(class_problem(F.col("s")).isNull() & ((F.col("kind") == "datatype") | (class_problem(F.col("o")).isNull() & ~F.lower(F.trim("o")).isin(GENERAL_OBJECTS))))


def local_names(labels: DataFrame, column: str = "label") -> DataFrame:
    """``label, name``: PascalCase names that are unique; a second label with the same name gets _2 and so on, in order of the labels."""
    words = F.filter(F.split(F.regexp_replace(F.col(column), r"[^A-Za-z0-9]+", " "), " "), lambda w: w != "")
    base = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")
    base = F.when(base == "", "Unnamed").when(base.rlike("^[0-9]"), F.concat(F.lit("N"), base)).otherwise(base)
    t = labels.select(column).distinct().withColumn("base", base)
    n = F.row_number().over(W.partitionBy("base").orderBy(column))
    return t.withColumn("n", n).select(column, F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("n").cast("string"))).alias("name"))


def snake_name(c: Column) -> Column:
    s = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(s == "", "unnamed").when(s.rlike("^[0-9]"), F.concat(F.lit("n_"), s)).otherwise(s)


def render_literal(value: Column, kind: Column) -> Column:
    """A literal in N-Triples syntax by its type; values that don't fit the type become strings."""
    raw = F.regexp_replace(F.trim(value), "^[\"']+|[\"']+$", "")
    esc = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    esc = F.regexp_replace(esc, "\r", r"\\r")
    xsd = lambda v, t: F.concat(F.lit('"'), v, F.lit(f'"^^<http://www.w3.org/2001/XMLSchema#{t}>'))
    return (
        F.when((kind == "boolean") & literal_type(value).eqNullSafe("boolean"), xsd(F.when(F.lower(raw).isin("true", "yes", "on"), "true").otherwise("false"), "boolean"))
        .when((kind == "integer") & raw.rlike("^[+-]?[0-9]+$"), xsd(raw, "integer")).when((kind == "decimal") & raw.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), xsd(raw, "decimal")).otherwise(xsd(esc, "string"))
    )


def predicate_problem(pred: Column, n: Column, allowed: list[str] | None = None, min_count: int = 5) -> Column:
    """Why a predicate gets no axiom: name, banned, count, plain_verb; null if it does. Names in ``allowed`` pass all but the first."""
    p = F.lower(F.trim(pred))
    parts = F.split(p, "_")
    tail = (F.size(parts) >= 2) & last(parts).isin(PREDICATE_PREPOSITIONS)
    c = F.when(~p.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)*$"), "name")
    if allowed:
        c = c.when(p.isin(allowed), None)
    return c.when(p.isin(BANNED_PREDICATES), "banned").when(n < min_count, "count").when(parts[0].isin(PLAIN_VERBS) & ~tail, "plain_verb")


def sample_evidence(triples: DataFrame, k: int, seed: int = 13, by: str = "rel") -> DataFrame:
    """``rel, s, o, rank``: of each relation ``k`` different (subject, object) pairs, case aside, in an order given by the seed."""
    t = triples.groupBy(by, F.lower(F.trim("s")).alias("ls"), F.lower(F.trim("o")).alias("lo")).agg(F.min(F.struct("s", "o")).alias("x"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), by, "ls", "lo"))
    return t.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(key))).where(F.col("rank") <= k).select(by, "x.s", "x.o", "rank")


def validate_axioms(raw: DataFrame, predicates: DataFrame, column: str = "raw") -> DataFrame:
    """Proposals in JSON with ``problem``: json, predicate, kind, domain, confidence; null if the proposal can be used. ``predicates``: predicate."""
    j = F.try_parse_json(column)
    get = lambda p, k="string": F.try_variant_get(j, p, k)
    t = raw.withColumn("predicate", get("$.predicate")).withColumn("kind", get("$.property.kind")).withColumn("name", get("$.property.name")).withColumn("domain", get("$.domain_class")).withColumn("conf", get("$.confidence", "double"))
    t = t.withColumn("parsed", j.isNotNull()).join(predicates.select("predicate", F.lit(True).alias("known")).distinct(), "predicate", "left")
    problem = (
        F.when(~F.col("parsed"), "json").when(F.col("known").isNull() | (F.coalesce("name", F.lit("")) != F.col("predicate")), "predicate").when(~F.coalesce(F.col("kind").isin("object", "datatype"), F.lit(False)), "kind")
        .when(F.coalesce(F.trim("domain"), F.lit("")) == "", "domain").when(F.col("conf").isNull() | ~F.col("conf").between(0, 1), "confidence")
    )
    return t.withColumn("problem", problem).drop("parsed", "known", "name", "conf")


def class_set(links: DataFrame, triples: DataFrame) -> DataFrame:
    """``term, source``: both ends of the links, admitted ends of the triples, and the upper classes, each once under its first source."""
    a = links.select(F.explode(F.array("child", "parent")).alias("term"), F.lit(1).alias("k"))
    b = triples.select(F.explode(F.array("s", "o")).alias("term"), F.lit(2).alias("k")).where(class_problem(F.col("term")).isNull())
    c = links.sparkSession.createDataFrame([(v, 3) for v in BUCKETS.values()], "term string, k int")
    name = F.element_at(F.array(F.lit("taxonomy"), F.lit("triple"), F.lit("upper")), F.col("k"))
    return a.unionByName(b).unionByName(c).where("term is not null").groupBy("term").agg(F.min("k").alias("k")).select("term", name.alias("source"))


# --- loads and finishing of proposals --------------------------------------------------------------------------------------------


def term_types(labels: DataFrame, order: str, role: str = "role", bucket_column: str = "bucket", category: str = "category") -> DataFrame:
    """``term, role, bucket, category``: what each term is; of several rows the last by ``order`` counts, ties by the largest values. Blank values are null."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    t = labels.select(blank("term").alias("term"), F.struct(F.col(order).alias("n"), blank(role).alias("role"), blank(bucket_column).alias("bucket"), blank(category).alias("category")).alias("x"))
    return t.where("term is not null").groupBy("term").agg(F.max("x").alias("x")).select("term", "x.role", "x.bucket", "x.category")


def load_triples(rows: DataFrame, s: str = "s", rel: str = "rel", o: str = "o") -> DataFrame:
    """``s, rel, o``: trimmed triples with a normalised relation; rows with an empty part are dropped, repeated ones stay."""
    t = rows.select(F.trim(s).alias("s"), F.trim(rel).alias("r"), F.trim(o).alias("o")).where("s <> '' and r <> '' and o <> ''")
    return t.select("s", axiom_relation_key(F.col("r")).alias("rel"), "o")


def resolved_links(links: DataFrame, names: DataFrame) -> DataFrame:
    """``child, parent`` and the other columns of ``links``: both ends in their canonical small-letter form, without self links and empty ends.

    ``names``: surface, canonical; a label that isn't in it stands for itself.
    """
    key = lambda c: F.lower(squeeze(F.col(c)))
    n = lambda a, b: names.select(F.col("surface").alias(a), F.col("canonical").alias(b))
    t = links.withColumn("ck", key("child")).withColumn("pk", key("parent")).join(n("ck", "cc"), "ck", "left").join(n("pk", "pc"), "pk", "left")
    t = t.withColumn("child", F.lower(F.coalesce("cc", "ck"))).withColumn("parent", F.lower(F.coalesce("pc", "pk"))).drop("ck", "pk", "cc", "pc")
    return t.where("child <> '' and parent <> '' and child <> parent")


def resolved_parents(links: DataFrame, names: DataFrame, order: str) -> DataFrame:
    """``child, parents``: the distinct parents of each child, in order of their first mention by ``order``, ties by name."""
    t = resolved_links(links, names).groupBy("child", "parent").agg(F.min(order).alias("n"))
    return t.groupBy("child").agg(F.array_sort(F.collect_list(F.struct("n", "parent")))["parent"].alias("parents"))


def known_assertions(triples: DataFrame, predicates: DataFrame) -> DataFrame:
    """The triples (s, rel, o) with non-empty parts whose relation, in small letters, is in ``predicates`` (rel)."""
    t = triples.select(F.trim("s").alias("s"), F.lower(F.trim("rel")).alias("rel"), F.trim("o").alias("o")).where("s <> '' and rel <> '' and o <> ''")
    return t.join(predicates.select(F.lower(F.trim("rel")).alias("rel")).distinct(), "rel", "left_semi").select("s", "rel", "o")


def finish_proposals(proposals: DataFrame, kinds: DataFrame, evidence: DataFrame, clamped: DataFrame, top: str = "owl:Thing") -> DataFrame:
    """``predicate, name, kind, datatype, domain, range, sub_of, inverse_of``: proposals made consistent with the evidence.

    ``proposals``: predicate, name, domain, range, sub_of, inverse_of (arrays); ``kinds``: rel, kind, datatype; ``evidence``: rel, s, o, rank; ``clamped``: term, class (as of
    ``graph.clamp``). A name that is no snake case is the predicate. The kind is that of the evidence. Domain and range are the class of the proposed term, else that of the
    first evidence that has one, else ``top``, as are ranges of datatype properties. Sub- and inverse properties are limited to known predicates.
    """
    key = lambda c: F.lower(F.trim(c))
    c = clamped.where("class is not null").select(key("term").alias("term"), "class").dropDuplicates(["term"])
    of = lambda a, b: c.select(F.col("term").alias(a), F.col("class").alias(b))
    ev = evidence.select(key("rel").alias("predicate"), "rank", key("s").alias("s"), key("o").alias("o")).join(of("s", "sc"), "s", "left").join(of("o", "oc"), "o", "left")
    first = ev.groupBy("predicate").agg(F.min_by("sc", F.when(F.col("sc").isNotNull(), F.col("rank"))).alias("ev_domain"), F.min_by("oc", F.when(F.col("oc").isNotNull(), F.col("rank"))).alias("ev_range"))
    known = kinds.select(key("rel").alias("x")).distinct()
    p = proposals.withColumn("predicate", key("predicate")).join(kinds.select(key("rel").alias("predicate"), "kind", "datatype"), "predicate")
    p = p.withColumn("dk", key("domain")).withColumn("rk", key("range")).join(of("dk", "dc"), "dk", "left").join(of("rk", "rc"), "rk", "left").join(first, "predicate", "left")
    for c_ in ("sub_of", "inverse_of"):
        kept = p.select("predicate", F.explode(F.transform(c_, key)).alias("x")).join(known, "x", "left_semi").groupBy("predicate").agg(F.array_sort(F.collect_set("x")).alias("kept"))
        p = p.drop(c_).join(kept.withColumnRenamed("kept", c_), "predicate", "left")
    limited = lambda a: F.coalesce(a, F.array().cast("array<string>"))
    name = F.when(key("name").rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)*$"), key("name")).otherwise(F.col("predicate"))
    return p.select(
        "predicate", name.alias("name"), "kind", F.when(F.col("kind") == "datatype", F.col("datatype")).alias("datatype"), F.coalesce("dc", "ev_domain", F.lit(top)).alias("domain"),
        F.when(F.col("kind") == "object", F.coalesce("rc", "ev_range", F.lit(top))).otherwise(top).alias("range"), limited(F.col("sub_of")).alias("sub_of"), limited(F.col("inverse_of")).alias("inverse_of"),
    )
