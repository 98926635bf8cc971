"""Is-a links: labels and tokens, head match, Hearst patterns, neighbour expansion, evidence, candidate lists, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ontoloom.functions import word_lists as wl
from ontoloom.functions.text import squeeze

#: Words that make a bad child.
ROLE_WORDS = "user administrator admin owner operator manager".split()
FILE_WORDS = "file files path directory dir conf config cfg".split()
SCHEDULER_HEADS = "host job daemon command queue plugin".split()
BAD_PARENTS = [*wl.BAD_HEADS, "property", "properties"]


def words(c: Column) -> Column:
    """The label's words: small letters, everything but a-z, 0-9, _ and - as blanks."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9_-]+", " "), " "), lambda x: x != "")


def swap_scheduler(c: Column) -> Column:
    """'host lsf' becomes 'lsf host'."""
    s = F.lower(squeeze(c))
    a, b = F.split(s, " ")[0], F.get(F.split(s, " "), F.lit(1))
    return F.when((F.size(F.split(s, " ")) == 2) & b.isin(wl.SCHEDULERS) & a.isin(SCHEDULER_HEADS), F.concat_ws(" ", b, a)).otherwise(s)


def bad_child(c: Column) -> Column:
    low = F.lower(c)
    return (
        low.rlike(r"(^|[^a-z0-9_])or\s+more($|[^a-z0-9_])") | F.arrays_overlap(words(c), F.array(*(F.lit(w) for w in [*ROLE_WORDS, *FILE_WORDS]))) | low.contains("/etc/") | low.contains("/var/") | low.contains("\\")
    )


def head_match(children: DataFrame, parents: DataFrame, min_children: int = 2, max_words: int = 3) -> DataFrame:
    """``child, parent, n_children``: pairs where the parent's words end the child's, for parents with ``min_children`` or more.

    The child's endings of up to ``max_words`` words are joined with the parents on equality, which is linear in the number of
    children instead of a comparison of each child with each parent.
    """
    c = children.select(squeeze(F.col("term")).alias("child")).where("child <> ''").distinct().where(~bad_child(F.col("child"))).withColumn("w", words(F.col("child")))
    ends = F.transform(F.sequence(F.lit(1), F.least(F.lit(max_words), F.size("w"))), lambda n: F.array_join(F.slice("w", F.size("w") - n + 1, n), " "))
    c = c.where(F.size("w") > 0).select("child", F.explode(ends).alias("end"))
    p = parents.select(F.lower(squeeze(F.col("term"))).alias("parent")).distinct().where(~F.col("parent").isin(BAD_PARENTS)).withColumn("end", F.array_join(words(F.col("parent")), " ")).where("end <> ''")
    pairs = c.join(p, "end").where(F.lower("child") != F.col("parent")).select("child", "parent").distinct()
    counts = pairs.groupBy("parent").agg(F.count("*").alias("n_children")).where(F.col("n_children") >= min_children)
    return pairs.join(counts, "parent").select("child", "parent", "n_children")


#: Noun phrases around the three patterns; up to four words are used of each.
NP = r"[a-z0-9_-]+(?: [a-z0-9_-]+){0,3}"


def hearst(sentences: DataFrame, known: DataFrame) -> DataFrame:
    """``child, parent, pattern, n_sentences``: 'x is a y', 'x and other y', 'y such as x' where both are known terms.

    The longest known ending of the left phrase and the longest known beginning of the right one are taken: phrases are expanded to their parts and joined
    with the terms on equality.
    """
    s = sentences.select("doc_id", "sent_idx", F.regexp_replace(F.lower("sentence"), r"\s+", " ").alias("s")).distinct()
    pats = [("is_a", rf"({NP}) is (?:a|an) ({NP})", 1, 2), ("other", rf"({NP}) (?:and|or) other ({NP})", 1, 2), ("such_as", rf"({NP}) such as ({NP})", 2, 1)]
    rows = None
    for name, p, child, parent in pats:
        t = s.where(F.col("s").rlike(p)).select("doc_id", "sent_idx", F.lit(name).alias("pattern"), F.explode(F.arrays_zip(F.regexp_extract_all("s", F.lit(p), F.lit(1)).alias("l"), F.regexp_extract_all("s", F.lit(p), F.lit(2)).alias("r"))).alias("x"))
        t = t.select("doc_id", "sent_idx", "pattern", F.col("x.l").alias("l"), F.col("x.r").alias("r"), F.lit(child == 1).alias("left_is_child"))
        rows = t if rows is None else rows.unionByName(t)
    lw, rw = F.split("l", " "), F.split("r", " ")
    rows = rows.withColumn("hit", F.xxhash64("doc_id", "sent_idx", "pattern", "l", "r"))
    left = rows.select("hit", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(lw)), lambda n: F.array_join(F.slice(lw, n, F.size(lw)), " "))).alias("n", "term"))
    right = rows.select("hit", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(rw)), lambda n: F.array_join(F.slice(rw, F.lit(1), F.size(rw) - n + 1), " "))).alias("n", "term"))
    k = known.select(F.lower(squeeze(F.col("term"))).alias("term")).where("term <> ''").distinct()
    best = lambda x, c: x.join(k, "term").groupBy("hit").agg(F.min(F.struct("n", "term"))["term"].alias(c))
    j = rows.join(best(left, "lt"), "hit").join(best(right, "rt"), "hit")
    j = j.select("doc_id", "sent_idx", "pattern", F.when(F.col("left_is_child"), F.col("lt")).otherwise(F.col("rt")).alias("child"), F.when(F.col("left_is_child"), F.col("rt")).otherwise(F.col("lt")).alias("parent"))
    j = j.where((F.col("child") != F.col("parent")) & ~F.col("parent").isin(BAD_PARENTS) & ~bad_child(F.col("child")))
    return j.groupBy("child", "parent", "pattern").agg(F.count_distinct("doc_id", "sent_idx").alias("n_sentences"))


def expand_by_neighbours(seeds: DataFrame, neighbours: DataFrame, eligible: DataFrame, k: int = 5, min_similarity: float = 0.75) -> DataFrame:
    """``child_id, parent, similarity``: the eligible ones among each seed's ``k`` nearest (similar enough) take the seed's parent.

    ``seeds`` (term_id, parent), ``neighbours`` (term_id, neighbor_term_id, similarity), ``eligible`` (term_id). The cut at k comes before
    eligibility is asked for. Seeds of the parent and the seed itself aren't added again; of several ways the most similar counts.
    """
    n = neighbours.groupBy("term_id", "neighbor_term_id").agg(F.max("similarity").alias("similarity")).where(F.col("similarity") >= min_similarity)
    n = n.withColumn("r", F.row_number().over(W.partitionBy("term_id").orderBy(F.desc("similarity"), "neighbor_term_id"))).where(F.col("r") <= k)
    s = seeds.select("term_id", "parent").distinct()
    new = s.join(n, "term_id").select(F.col("neighbor_term_id").alias("child_id"), "parent", "similarity").join(eligible.select(F.col("term_id").alias("child_id")).distinct(), "child_id", "left_semi")
    new = new.join(s.select(F.col("term_id").alias("child_id"), "parent"), ["child_id", "parent"], "left_anti")
    return new.groupBy("child_id", "parent").agg(F.max("similarity").alias("similarity"))


def edge_evidence(edges: DataFrame, sentences: DataFrame, k: int = 2) -> DataFrame:
    """``child, parent, rank, doc_id, sent_idx, both``: up to ``k`` sentences with both labels, else with the child alone.

    Sentences are found through the words they share with the child's rarest word, then by containment.
    """
    s = sentences.groupBy("doc_id", "sent_idx").agg(F.min(F.lower("sentence")).alias("s"))
    tok = s.select("doc_id", "sent_idx", F.explode(F.array_distinct(F.regexp_extract_all("s", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("w"))
    e = edges.select("child", "parent").distinct().where("child is not null and parent is not null")
    e = e.withColumn("cw", F.regexp_extract_all(F.lower("child"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).where(F.size("cw") > 0)
    freq = tok.groupBy("w").agg(F.count("*").alias("n"))
    pick = e.select("child", "parent", F.explode(F.array_distinct("cw")).alias("w")).join(freq, "w", "left").groupBy("child", "parent").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w"))["w"].alias("w"))
    hit = pick.join(tok, "w").join(s, ["doc_id", "sent_idx"]).where(F.contains(F.col("s"), F.lower("child"))).withColumn("both", F.contains(F.col("s"), F.lower("parent")))
    # sentences with both labels first: k of each link are picked before the shuffle, those with the child alone go where there are others
    w = W.partitionBy("child", "parent")
    hit = hit.withColumn("rank", F.row_number().over(w.orderBy(F.desc("both"), "doc_id", "sent_idx"))).where(F.col("rank") <= k)
    return hit.withColumn("any", F.max("both").over(w)).where(F.col("both") | ~F.col("any")).select("child", "parent", "rank", "doc_id", "sent_idx", "both")


def top_parents(edges: DataFrame, n: int = 10) -> DataFrame:
    """``parent, n_children``: the parents of most different children."""
    return edges.groupBy("parent").agg(F.count_distinct("child").alias("n_children")).orderBy(F.desc("n_children"), "parent").limit(n)


def candidate_lists(edges: DataFrame, n: int = 8) -> DataFrame:
    """``child, parent, candidates``: the parent, then global top parents, ``n`` different labels (case aside), then 'none'."""
    tops = top_parents(edges, n).agg(F.array_sort(F.collect_list(F.struct((-F.col("n_children")).alias("m"), "parent")))["parent"].alias("tops"))
    e = edges.select("child", "parent").distinct().withColumn("tops", tops.scalar())
    more = F.filter("tops", lambda x: F.lower(x) != F.lower("parent"))
    return e.select("child", "parent", F.concat(F.slice(F.concat(F.array("parent"), more), 1, n), F.array(F.lit("none"))).alias("candidates"))


def apply_verdicts(v: DataFrame) -> DataFrame:
    """Rows (candidates, best_parent, accept, confidence, three flags) after the rules: a best parent that is no candidate rejects with confidence of at most 0.3; a false flag rejects."""
    known = F.array_contains("candidates", F.col("best_parent"))
    ok = known & F.col("child_is_class") & F.col("parent_is_class") & F.col("is_a_valid") & F.col("accept")
    return v.withColumn("confidence", F.when(known, F.col("confidence")).otherwise(F.least(F.col("confidence"), F.lit(0.3)))).withColumn("accept", F.coalesce(ok, F.lit(False)))


def chunk_candidates(listed: DataFrame, labels: DataFrame, categories: list[str], min_freq: int = 1, top: int = 16, strict: bool = False) -> DataFrame:
    """``doc_id, chunk_id, idx, term_id, term``: of each chunk the terms that may take part, by frequency and id; ``idx`` counts from 0.

    Terms without a label take part unless ``strict``; labelled ones must be in the domain, not dropped and of a category in the list. Terms that
    differ in case only stand once.
    """
    t = listed.select("doc_id", "chunk_id", "term_id", "term", "freq_total").distinct().where(F.col("freq_total") >= min_freq)
    t = t.join(labels, "term_id", "inner" if strict else "left")
    ok = F.col("label_id").isNull() | (F.col("is_domain") & (F.col("role") != "drop") & F.col("category").isin(categories))
    t = t.where(ok).groupBy("doc_id", "chunk_id", F.lower(F.trim("term")).alias("k")).agg(F.min(F.struct((-F.col("freq_total")).alias("f"), "term_id", "term")).alias("x"))
    idx = F.row_number().over(W.partitionBy("doc_id", "chunk_id").orderBy("x.f", "x.term_id")) - 1
    return t.withColumn("idx", idx).where(F.col("idx") < top).select("doc_id", "chunk_id", "idx", "x.term_id", "x.term")


def indexed_edges(outputs: DataFrame, cands: DataFrame, left: str = "child_idx", right: str = "parent_idx", array: str = "is_a_edges") -> DataFrame:
    """``doc_id, chunk_id, left_id, right_id, left_term, right_term``: model output in JSON with indexes into the candidates, resolved.

    Indexes out of range, pairs of a term with itself and repeated pairs are dropped, as is output that doesn't parse.
    """
    kind = f"struct<{array}:array<struct<{left}:int,{right}:int>>>"
    e = outputs.select("doc_id", "chunk_id", F.explode(F.from_json("raw", kind)[array]).alias("e")).select("doc_id", "chunk_id", F.col(f"e.{left}").alias("l"), F.col(f"e.{right}").alias("r")).where("l <> r").distinct()
    side = lambda n, i: cands.select("doc_id", "chunk_id", F.col("idx").alias(i), F.col("term_id").alias(f"{n}_id"), F.col("term").alias(f"{n}_term"))
    j = e.join(side("left", "l"), ["doc_id", "chunk_id", "l"]).join(side("right", "r"), ["doc_id", "chunk_id", "r"]).where("left_id <> right_id")
    return j.select("doc_id", "chunk_id", "left_id", "right_id", "left_term", "right_term").distinct()


# --- class terms, free-form links ------------------------------------------------------------------------------------------------

#: Phrases of a justification that tell of another relation than is-a.
OTHER_RELATIONS = (
    "consequence of", "result of", "caused by", "due to", "used in", "used by", "stored in", "written in", "written to", "logged to", "example of", "for example", "e.g.", "illustrate", "illustration", "sample of", "part of",
)


def class_terms(labels: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """``term, definition``: the representative labels of domain classes with enough confidence, each once, with the smallest of their definitions.

    ``labels``: term, role, is_domain, confidence, definition. 'host lsf' is represented by 'lsf host'. Null and blank terms count for nothing.
    """
    ok = (F.lower(F.trim("role")) == "class") & F.col("is_domain") & (F.col("confidence") >= min_confidence)
    t = labels.where(ok).select(swap_scheduler(F.col("term")).alias("term"), "definition").where("term <> ''")
    return t.groupBy("term").agg(F.min("definition").alias("definition"))


def weighted_parents(labels: DataFrame, head: Column, min_confidence: float = 0.7) -> DataFrame:
    """``parent, class_support, def_support, score``: class terms and heads of definitions that can be parents; score = max(class_support, 2 * def_support).

    ``labels`` as in ``class_terms``, one row counting once; ``head``: the head of the column definition.
    """
    ok = (F.lower(F.trim("role")) == "class") & F.col("is_domain") & (F.col("confidence") >= min_confidence)
    t = labels.where(ok).select(swap_scheduler(F.col("term")).alias("t"), swap_scheduler(head).alias("h")).where(F.col("t").isNotNull() & (F.col("t") != "") & ~F.col("t").isin(BAD_PARENTS))
    both = t.select(F.explode(F.array(F.struct(F.col("t").alias("parent"), F.lit(1).alias("c"), F.lit(0).alias("d")), F.struct(F.col("h").alias("parent"), F.lit(0).alias("c"), F.lit(1).alias("d")))).alias("x"))
    g = both.where("x.parent <> ''").groupBy("x.parent").agg(F.sum("x.c").alias("class_support"), F.sum("x.d").alias("def_support")).where(~F.col("parent").isin(BAD_PARENTS))
    return g.withColumn("score", F.greatest(F.col("class_support"), 2 * F.col("def_support")))


def lexical_subtype(child: Column, parent: Column) -> Column:
    """The child's label holds the parent's, and is another."""
    c, p = F.lower(F.trim(child)), F.lower(F.trim(parent))
    return F.coalesce((c != "") & (p != "") & (c != p) & F.contains(c, p), F.lit(False))


def other_relation(justification: Column) -> Column:
    """The justification tells of another relation than is-a."""
    j = F.lower(F.coalesce(justification, F.lit("")))
    found = F.lit(False)
    for p in OTHER_RELATIONS:
        found = found | F.contains(j, F.lit(p))
    return found


def free_links(outputs: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """``<keys>, child, parent``: is-a links in model output (JSON between the first and last brace: is_a_edges of child, parent, justification).

    Self links, links justified by another relation and parents that are no part of the child's label are dropped; of repeated links, case aside, the smallest spelling stays.
    Output that doesn't parse gives no link.
    """
    text = F.regexp_extract(F.col(raw), r"(?s)(\{.*\})", 1)
    e = outputs.select(*keys, F.explode(F.from_json(text, "struct<is_a_edges:array<struct<child:string,parent:string,justification:string>>>")["is_a_edges"]).alias("e"))
    e = e.select(*keys, F.trim("e.child").alias("child"), F.trim("e.parent").alias("parent"), "e.justification").where(lexical_subtype(F.col("child"), F.col("parent")) & ~other_relation(F.col("justification")))
    return e.groupBy(*keys, F.lower("child").alias("c"), F.lower("parent").alias("p")).agg(F.min(F.struct("child", "parent")).alias("x")).select(*keys, "x.child", "x.parent")


def with_canonical(listed: DataFrame, names: DataFrame) -> DataFrame:
    """``listed`` (term, ...) as distinct rows with ``canonical_id`` where ``names`` (surface, canonical_id) knows the term, else null."""
    t = listed.distinct().withColumn("surface", F.lower(squeeze(F.col("term"))))
    return t.join(names.select("surface", "canonical_id"), "surface", "left").drop("surface")


def lemma_ids(terms: DataFrame) -> DataFrame:
    """``lemma, term_id``: the id that a lemma stands for (case and blanks aside): the last, that is the largest, of them. ``terms``: term_id, term_lemma."""
    return terms.select(F.lower(squeeze(F.col("term_lemma"))).alias("lemma"), "term_id").where("lemma <> ''").groupBy("lemma").agg(F.max("term_id").alias("term_id"))
