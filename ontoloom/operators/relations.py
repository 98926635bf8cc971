"""Relations that are not is-a: keys and validity, surface maps, subject-verb-object triples, filters, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ontoloom.functions import word_lists as wl
from ontoloom.functions.text import squeeze

#: Relations that say is-a, and such that say something like it.
ISA_KEYS = "be become remain represent".split()
TAXONOMY_KEYS = "type_of kind_of include contain comprise consist_of classify_as categorize_as".split()


def relation_key(base: Column, preposition: Column | None = None) -> Column:
    """Small letters, blanks as underscores, other signs dropped; with the preposition behind it."""
    plain = lambda c: F.regexp_replace(F.replace(F.lower(squeeze(c)), F.lit(" "), F.lit("_")), "[^a-z0-9_]", "")
    b = plain(base)
    if preposition is None:
        return b
    p = F.coalesce(plain(preposition), F.lit(""))
    return F.when((b != "") & (p != ""), F.concat_ws("_", b, p)).otherwise(b)


def axiom_relation_key(c: Column) -> Column:
    """As the axiom stage reads relations: hyphens, blanks and signs as single underscores; 'related_to' where nothing is left."""
    r = F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", "_")
    return F.coalesce(F.nullif(F.trim(r, F.lit("_")), F.lit("")), F.lit("related_to"))


def valid_relation(c: Column, max_len: int = 80) -> Column:
    s = F.trim(c)
    return (s != "") & (F.length(s) <= max_len) & s.rlike("[A-Za-z]") & ~s.rlike(r"[^A-Za-z0-9_\-\s/]")


def generic_span(c: Column) -> Column:
    """No word, or stop words only."""
    return F.forall(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0)), lambda w: w.isin(wl.STOP_WORDS))


def surfaces(c: Column) -> Column:
    """The surface forms in a JSON array of strings, in the values (texts or arrays of them) of a JSON object, or in a list separated by semicolons, else commas."""
    s = F.trim(c)
    whole = F.from_json(s, "array<string>")
    values = F.map_values(F.from_json(s, "map<string,string>"))
    inner = F.flatten(F.transform(values, lambda v: F.when(v.startswith("["), F.coalesce(F.from_json(v, "array<string>"), F.array(v))).otherwise(F.array(v))))
    listed = F.when(s.startswith("["), whole).when(s.startswith("{"), inner).when(s.contains(";"), F.split(s, ";")).otherwise(F.split(s, ","))
    return F.filter(F.transform(listed, lambda x: F.lower(squeeze(x))), lambda x: x != "")


def surface_map(groups: DataFrame) -> DataFrame:
    """``surface, canonical_id``: each canonical term and synonym with the id it stands for; a term's own name goes before synonyms, then the larger id.

    ``groups``: canonical_id, canonical_term, synonyms (text).
    """
    own = groups.select(F.lower(squeeze(F.col("canonical_term"))).alias("surface"), F.lit(1).alias("own"), "canonical_id")
    syn = groups.where("synonyms is not null").select(F.explode(surfaces(F.col("synonyms"))).alias("surface"), F.lit(0).alias("own"), "canonical_id")
    return own.unionByName(syn).where("surface <> ''").groupBy("surface").agg(F.max(F.struct("own", "canonical_id"))["canonical_id"].alias("canonical_id"))


def resolve_spans(spans: DataFrame, names: DataFrame, column: str = "span") -> DataFrame:
    """``spans`` with ``canonical_id`` of the span, else of the span without one leading determiner, else null."""
    keys = spans.withColumn("k1", F.lower(squeeze(F.col(column)))).withColumn("k2", F.regexp_replace("k1", f"^{wl.either(wl.DETERMINERS)} ", ""))
    n1 = names.select(F.col("surface").alias("k1"), F.col("canonical_id").alias("c1"))
    n2 = names.select(F.col("surface").alias("k2"), F.col("canonical_id").alias("c2"))
    return keys.join(n1, "k1", "left").join(n2, "k2", "left").withColumn("canonical_id", F.coalesce("c1", "c2")).drop("k1", "k2", "c1", "c2")


def svo(tokens: DataFrame) -> DataFrame:
    """``doc_id, sent_idx, subj, verb, prep, obj``: noun run, verb, optional preposition, optional determiner, noun run, next to each other.

    An approximation of a dependency parse by the tags of the words in between.
    """
    w = W.partitionBy("doc_id", "sent_idx").orderBy("pos")
    t = tokens.where("tag not in ('DET', 'ADV', 'AUX')").withColumn("n", F.row_number().over(w))
    noun = F.col("tag").isin("ADJ", "NOUN", "PROPN")
    t = t.withColumn("kind", F.when(noun, "N").when(F.col("tag") == "VERB", "V").when(F.col("tag") == "ADP", "P").otherwise("O"))
    t = t.withColumn("island", F.when(noun, F.col("n") - F.row_number().over(W.partitionBy("doc_id", "sent_idx", "kind").orderBy("pos"))).otherwise(-F.col("n") - 1000))
    g = t.groupBy("doc_id", "sent_idx", "kind", "island").agg(F.min("n").alias("at"), F.array_join(F.array_sort(F.collect_list(F.struct("pos", "lemma")))["lemma"], " ").alias("text"))
    o = W.partitionBy("doc_id", "sent_idx").orderBy("at")
    nx = lambda c, k: F.lead(c, k).over(o)
    s = g.select("doc_id", "sent_idx", "kind", "text", *(nx(c, k).alias(f"{c[0]}{k}") for c in ("kind", "text") for k in (1, 2, 3)))
    direct, prep = (F.col("k1") == "V") & (F.col("k2") == "N"), (F.col("k1") == "V") & (F.col("k2") == "P") & (F.col("k3") == "N")
    s = s.where((F.col("kind") == "N") & (direct | prep))
    return s.select("doc_id", "sent_idx", F.col("text").alias("subj"), F.col("t1").alias("verb"), F.when(prep, F.col("t2")).otherwise("").alias("prep"), F.when(direct, F.col("t2")).otherwise(F.col("t3")).alias("obj"))


def taxonomy_like(triples: DataFrame, closure: DataFrame) -> DataFrame:
    """Triples (s, rel, o) with ``like``: self, direct, ancestor or descendant where they repeat the taxonomy, else null.

    ``closure``: node, ancestor, hops. The direct parent always counts; other ancestors with is-a or taxonomy-like verbs, descendants with is-a verbs.
    """
    up = closure.select(F.col("node").alias("s"), F.col("ancestor").alias("o"), F.col("hops").alias("up"))
    down = closure.select(F.col("node").alias("o"), F.col("ancestor").alias("s"), F.col("hops").alias("down"))
    t = triples.join(up, ["s", "o"], "left").join(down, ["s", "o"], "left")
    like = (
        F.when(F.col("s") == F.col("o"), "self").when(F.col("up") == 1, "direct").when(F.col("up").isNotNull() & F.col("rel").isin([*ISA_KEYS, *TAXONOMY_KEYS]), "ancestor")
        .when(F.col("down").isNotNull() & F.col("rel").isin(ISA_KEYS), "descendant")
    )
    return t.withColumn("like", like).drop("up", "down")


def diverse_relations(triples: DataFrame, total: int = 3, subjects: int = 2, objects: int = 2) -> DataFrame:
    """``rel, n, n_subj, n_obj``: relations frequent and diverse enough."""
    g = triples.groupBy("rel").agg(F.count("*").alias("n"), F.count_distinct("s").alias("n_subj"), F.count_distinct("o").alias("n_obj"))
    return g.where((F.col("n") >= total) & (F.col("n_subj") >= subjects) & (F.col("n_obj") >= objects))


def cascade(svo_rows: DataFrame, names: DataFrame, closure: DataFrame) -> DataFrame:
    """``step, n``: how many extracted triples each filter leaves: extracted, specific, canonical, not_self, not_taxonomy, distinct."""
    t = svo_rows.withColumn("specific", ~generic_span(F.col("subj")) & ~generic_span(F.col("obj")) & valid_relation(F.col("verb")))
    t = resolve_spans(t, names, "subj").withColumnRenamed("canonical_id", "sid")
    t = resolve_spans(t, names, "obj").withColumnRenamed("canonical_id", "oid")
    t = taxonomy_like(t.withColumn("s", F.col("sid").cast("string")).withColumn("o", F.col("oid").cast("string")).withColumn("rel", relation_key(F.col("verb"), F.col("prep"))), closure)
    a = F.col("specific")
    b = a & F.col("sid").isNotNull() & F.col("oid").isNotNull()
    c = b & (F.col("sid") != F.col("oid"))
    d = c & F.col("like").isNull()
    g = t.agg(
        F.count("*").alias("extracted"), F.count_if(a).alias("specific"), F.count_if(b).alias("canonical"), F.count_if(c).alias("not_self"), F.count_if(d).alias("not_taxonomy"),
        F.count_distinct(F.when(d, F.struct("doc_id", "sent_idx", "sid", "rel", "oid"))).alias("distinct"),
    )
    return g.unpivot([], g.columns, "step", "n")


def accept_edges(edges: DataFrame, verdicts: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Every edge with ``decision`` and ``confidence``: those without a readable verdict are rejected; confidences over 1 are tenths; low ones reject.

    ``verdicts``: edge_id, raw (JSON with decision, confidence).
    """
    j = F.try_parse_json("raw")
    v = verdicts.select("edge_id", F.lower(F.trim(F.try_variant_get(j, "$.decision", "string"))).alias("d"), F.try_variant_get(j, "$.confidence", "double").alias("c"))
    c = F.coalesce(F.col("c"), F.lit(0.0))
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when((c > 1) & (c <= 10), c / 10).otherwise(c)))
    return edges.join(v, "edge_id", "left").withColumn("confidence", c).withColumn("decision", F.when((F.col("d") == "accept") & (F.col("confidence") >= min_confidence), "accept").otherwise("reject")).drop("d", "c")


def outer_json(c: Column) -> Column:
    """From the first opening to the last closing brace, if that parses and its braces balance outside strings; else null."""
    s = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    bare = F.regexp_replace(s, r'"(?:[^"\\]|\\.)*"', "")
    balanced = F.length(F.regexp_replace(bare, r"[^{]", "")) == F.length(F.regexp_replace(bare, r"[^}]", ""))
    return F.when(balanced & F.try_parse_json(s).isNotNull(), s)


# --- relations proposed by a model -----------------------------------------------------------------------------------------------

#: Kinds of relations, and predicates that belong to the taxonomy.
RELATION_TYPES = "part_of configuration provision usage data_flow logging scheduling other".split()
TAXONOMY_PREDICATES = "is_a isa type_of typeof kind_of subclass_of subclass superclass_of".split()


def proposed_predicate(c: Column, allowed: list[str] | None = None) -> Column:
    """The predicate is a name in small letters, none of the taxonomy and, if there is a list, in it."""
    p = F.trim(c)
    ok = p.rlike("^[a-z][a-z0-9_]{1,63}$") & ~p.isin(TAXONOMY_PREDICATES)
    return F.coalesce(ok if allowed is None else ok & p.isin(allowed), F.lit(False))


def indexed_relations(outputs: DataFrame, cands: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """``doc_id, chunk_id, subj_id, subj, predicate, relation_type, obj_id, obj``: model output in JSON with indexes into the candidates, resolved.

    Indexes out of range, terms related to themselves, predicates that ``proposed_predicate`` refuses and unknown relation types (none: 'other') are dropped; of repeated
    relations (case aside) one stays, with the smallest relation type.
    """
    kind = "struct<relations:array<struct<subject_idx:int,predicate:string,object_idx:int,relation_type:string>>>"
    e = outputs.select("doc_id", "chunk_id", F.explode(F.from_json("raw", kind)["relations"]).alias("e"))
    rtype = F.coalesce(F.nullif(F.trim("e.relation_type"), F.lit("")), F.lit("other"))
    e = e.select("doc_id", "chunk_id", F.col("e.subject_idx").alias("i"), F.trim("e.predicate").alias("predicate"), F.col("e.object_idx").alias("j"), rtype.alias("relation_type"))
    e = e.where(proposed_predicate(F.col("predicate"), allowed) & F.col("relation_type").isin(RELATION_TYPES))
    side = lambda n, i: cands.select("doc_id", "chunk_id", F.col("idx").alias(i), F.col("term_id").alias(f"{n}_id"), F.col("term").alias(n))
    t = e.join(side("subj", "i"), ["doc_id", "chunk_id", "i"]).join(side("obj", "j"), ["doc_id", "chunk_id", "j"]).where(F.lower("subj") != F.lower("obj"))
    g = t.groupBy("doc_id", "chunk_id", F.lower("subj").alias("s"), "predicate", F.lower("obj").alias("o")).agg(F.min(F.struct("relation_type", "subj_id", "subj", "obj_id", "obj")).alias("x"))
    return g.select("doc_id", "chunk_id", "x.subj_id", "x.subj", "predicate", "x.relation_type", "x.obj_id", "x.obj")
