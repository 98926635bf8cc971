"""Canonical terms: technical tokens, keys, variant groups, generic scores, evidence, parents from definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ontoloom.functions import word_lists as wl
from ontoloom.functions.text import last, squeeze

CAPITALS = "^[A-Z0-9_]+$"


def term_type(c: Column) -> Column:
    """config, file, command or null."""
    s = F.trim(c)
    return (
        F.when(s.rlike(CAPITALS) & s.contains("_"), "config").when(F.lower(s).rlike(r"\.(conf|cfg|ini)$"), "file").when(F.lower(s).isin(wl.SCHEDULER_COMMANDS), "command")
    )


def is_technical(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.coalesce((s != "") & (term_type(c).isNotNull() | s.contains("slurm") | s.contains("lsf")), F.lit(False))


def canonical_key(lemma: Column, text: Column) -> Column:
    """Small letters, hyphens, slashes and dots as blanks, no light determiners in front; terms that start in capitals keep their lemma whole."""
    capital = F.split(squeeze(text), " ")[0].rlike(CAPITALS)
    low = F.lower(squeeze(F.when(F.coalesce(squeeze(lemma), F.lit("")) != "", lemma).otherwise(text)))
    plain = squeeze(F.regexp_replace(low, r"[-/.]+", " "))
    return F.trim(F.regexp_replace(F.when(capital, low).otherwise(plain), f"^({wl.either(wl.LIGHT_PREFIXES)}( |$))+", ""))


def canonical_groups(cands: DataFrame, min_tf_idf: float = 0.0) -> DataFrame:
    """One row per canonical term of the important candidates, with its variants.

    ``canonical_id, canonical_term, term_type, member_term_ids, original_terms, synonyms, abbreviations, representative, freq_total, freq_docs, tf_idf``. Repeated rows
    count once; lists are sorted. The lists of a group hold each variant once.
    """
    t = cands.select("term_id", "term_text", "term_lemma", "freq_total", "freq_docs", "tf_idf").distinct().where((F.col("tf_idf") >= min_tf_idf) | is_technical(F.col("term_text")))
    t = t.withColumn("key", canonical_key(F.col("term_lemma"), F.col("term_text"))).where("key <> ''")
    term = F.when(F.col("key").rlike(CAPITALS), F.upper("key")).otherwise(F.col("key"))
    text = squeeze(F.col("term_text"))
    g = t.withColumn("canonical_term", term).withColumn("x", text).groupBy("canonical_term").agg(
        F.min("term_id").alias("canonical_id"), F.sort_array(F.collect_set("term_id")).alias("member_term_ids"), F.sort_array(F.collect_set("x")).alias("original_terms"),
        F.sum("freq_total").alias("freq_total"), F.max("freq_docs").alias("freq_docs"), F.sum("tf_idf").alias("tf_idf"),
    )
    same = lambda x: F.lower(x) == F.lower("canonical_term")
    shortest = F.array_sort(F.transform("original_terms", lambda x: F.struct(F.when(same(x), 0).otherwise(F.length(x)).alias("n"), F.lower(x).alias("l"), x.alias("x"))))
    return g.select(
        "canonical_id", "canonical_term", term_type(F.col("canonical_term")).alias("term_type"), "member_term_ids", "original_terms", F.filter("original_terms", lambda x: ~same(x)).alias("synonyms"),
        F.filter("original_terms", lambda x: x.rlike(CAPITALS) & (F.length(x) > 1)).alias("abbreviations"), F.coalesce(F.get(shortest, F.lit(0))["x"], F.col("canonical_term")).alias("representative"),
        "freq_total", "freq_docs", "tf_idf",
    )


def generic_score(groups: DataFrame) -> DataFrame:
    """``groups`` with ``generic_score``, ``is_generic`` (2.5 or more) and the sorted ``reasons``."""
    can = F.lower(F.trim("canonical_term"))
    head = last(F.split(can, " "))
    anchor = lambda x: F.lower(x).rlike("|".join(wl.ANCHORS)) | is_technical(x)
    anchored = F.exists("original_terms", anchor) | anchor(F.col("canonical_term"))
    signals = [
        ("head", 2.0, head.isin(wl.GENERIC_HEADS)), ("short", 1.0, ~can.contains(" ") & (F.length(can) <= 6) & head.isin(wl.GENERIC_HEADS)), ("no_anchor", 2.0, ~anchored),
        ("spread", 1.5, (F.col("freq_docs") >= 20) & (F.col("tf_idf") < 5)), ("abstract", 2.5, head.isin("information", "data", "datum")), ("technical", -1.5, F.col("term_type").isNotNull()),
    ]
    score = sum((F.when(cond, v).otherwise(0.0) for _, v, cond in signals), F.lit(0.0))
    return groups.withColumn("generic_score", score).withColumn("is_generic", F.col("generic_score") >= 2.5).withColumn("reasons", F.array_compact(F.array(*(F.when(c, n) for n, _, c in signals))))


def evidence(occurrences: DataFrame, sentences: DataFrame, k: int = 3) -> DataFrame:
    """``term_id, doc_id, sent_idx, sentence, rank``: of each term the first ``k`` different non-empty sentences among its first 3k occurrences.

    Ranks are cut off before rows are shuffled (rank limits), so that hot terms stay small.
    """
    order = ["doc_id", "sent_idx", "token_start", "token_end"]
    o = occurrences.select("term_id", *order).distinct().withColumn("r", F.row_number().over(W.partitionBy("term_id").orderBy(*order))).where(F.col("r") <= 3 * k)
    s = sentences.groupBy("doc_id", "sent_idx").agg(F.min("sentence").alias("sentence")).where("trim(sentence) <> ''")
    hit = o.select("term_id", "doc_id", "sent_idx").distinct().join(s, ["doc_id", "sent_idx"])
    return hit.withColumn("rank", F.row_number().over(W.partitionBy("term_id").orderBy("doc_id", "sent_idx"))).where(F.col("rank") <= k).select("term_id", "doc_id", "sent_idx", "sentence", "rank")


def select_specific(groups: DataFrame, cap: int | None = None, column: str = "canonical_id") -> DataFrame:
    """Groups that aren't generic (score under 3), by id, at most ``cap`` of them."""
    t = groups.where("generic_score < 3 and is_generic = 0").orderBy(column)
    return t if cap is None else t.limit(cap)


def suffix_canonical(c: Column) -> Column:
    """Small letters, separators as blanks, and words without the endings ing, ed, es or s where enough is left.

    Words of up to three signs, flags, and words with digits or path signs stay.
    """
    low = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[_\-|,:;]+", " "), r"\s+", " "))

    def cut(x: Column) -> Column:
        n = F.length(x)
        strip = lambda k: F.substr(x, F.lit(1), n - k)
        return (
            F.when((n <= 3) | x.rlike(r"^-|[0-9/\\.]"), x).when((n > 5) & x.endswith("ing"), strip(3)).when((n > 4) & x.endswith("ed"), strip(2))
            .when((n > 4) & x.endswith("es"), strip(2)).when((n > 4) & x.endswith("s"), strip(1)).otherwise(x)
        )

    return F.array_join(F.transform(F.split(low, " "), cut), " ")


def definition_head(definition: Column, limit: int = 200, bad: list[str] | None = None, use_map: bool = True) -> Column:
    """The parent that a definition ('A job queue used for ...') begins with, or null.

    The head ends at a full stop or a clause word; determiners, scheduler names and a trailing preposition go; the last three words stay.
    """
    bad = wl.BAD_HEADS if bad is None else bad
    head = F.regexp_extract(F.lower(squeeze(definition)), rf"^(?:a|an|the) ([^.]{{1,{limit}}})", 1)
    head = F.regexp_replace(head, rf"(^|[^a-z0-9_]){wl.either(wl.CLAUSE_WORDS)}($|[^a-z0-9_]).*$", "")
    words = F.filter(F.split(squeeze(F.regexp_replace(head, r"[^a-z0-9_ -]", " ")), " "), lambda x: (x != "") & ~x.isin([*wl.DETERMINERS[:8], *wl.SCHEDULERS]))
    words = F.when(last(words).isin(wl.TAIL_PREPOSITIONS), F.slice(words, 1, F.size(words) - 1)).otherwise(words)
    phrase = F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 2), F.lit(3)), " ")
    mapped = F.create_map(*(F.lit(x) for kv in wl.PARENT_MAP.items() for x in kv))
    phrase = F.when((F.size(words) > 0) & (phrase != "") & ~phrase.isin(bad), phrase)
    return F.coalesce(mapped[phrase], phrase) if use_map else F.when(F.length(phrase) >= 3, phrase)


def parent_scores(terms: DataFrame, top: int = 50) -> DataFrame:
    """``parent_term, score, class_support, def_support, parent_type``: parents by number of class terms and, twice, of definitions.

    ``terms``: term, definition, confidence. A parent that is a class term scores its count plus mean confidence / 100.
    """
    cls = terms.groupBy(F.lower(squeeze(F.col("term"))).alias("parent_term")).agg(F.count("*").alias("class_support"), F.avg("confidence").alias("conf"))
    heads = terms.select(definition_head(F.col("definition")).alias("parent_term")).where("parent_term is not null").groupBy("parent_term").agg(F.count("*").alias("def_support"))
    n = lambda c: F.coalesce(c, F.lit(0))
    t = cls.join(heads, "parent_term", "full_outer").where(~F.col("parent_term").isin(wl.BAD_HEADS))
    score = n("class_support") + F.coalesce(F.col("conf"), F.lit(0.0)) / 100 + 2 * n("def_support")
    kind = F.when(n("class_support") == 0, "definition").when(n("def_support") == 0, "class").otherwise("both")
    t = t.select("parent_term", score.alias("score"), n("class_support").alias("class_support"), n("def_support").alias("def_support"), kind.alias("parent_type"))
    return t.orderBy(F.desc("score"), "parent_term").limit(top)


#: What a model may answer for a term.
ROLES = ["class", "instance", "property", "relation", "drop"]


def validate_labels(raw: DataFrame, column: str = "raw") -> DataFrame:
    """``raw`` with the checked fields of a label in JSON: role and bucket from their lists, flag and confidence coerced; ``valid`` if it parses."""
    j = F.try_parse_json(column)
    get = lambda path, kind: F.try_variant_get(j, path, kind)
    role = F.lower(F.trim(get("$.ontology_role", "string")))
    conf = F.coalesce(get("$.confidence", "double"), F.lit(0.0))
    yes = F.lower(F.trim(get("$.is_hpc_domain_term", "string"))).isin("true", "1", "yes")
    return raw.select(
        "*", j.isNotNull().alias("valid"), F.when(role.isin(ROLES), role).otherwise("drop").alias("ontology_role"), F.coalesce(yes, F.lit(False)).alias("is_domain"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(conf > 1, conf / 10).otherwise(conf))).alias("confidence"),
    )
