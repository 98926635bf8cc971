"""Term extraction and scoring: tagging, noun runs, candidate rules, frequencies, TF-IDF, cleaning of listed terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ontoloom.functions import word_lists as wl
from ontoloom.functions.text import last, nfkc, squeeze

#: A token: command line flag, word with inner joints, or a single sign.
TOKEN = r"--?[A-Za-z][A-Za-z0-9_-]*(?:[=:][^\s]+)?|[\p{L}\p{N}_]+(?:[.'’|/-][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}_]"
FLAG = r"^-{1,2}[A-Za-z][A-Za-z0-9_-]*([=:][^\s]+)?$"
EDGE = r"^[!-,./:-@\[-^`{-~]+|[!-,./:-@\[-^`{-~]+$"


def tag(token: Column, first: Column) -> Column:
    """Universal part-of-speech tag by lexicon and ending; an approximation in place of a trained tagger."""
    low = F.lower(token)
    return (
        F.when(token.rlike(FLAG), "X").when(~token.rlike(r"[\p{L}\p{N}]"), "PUNCT").when(token.rlike(r"^[0-9][0-9.,]*$"), "NUM")
        .when(low.isin(wl.DETERMINERS), "DET").when(low.isin(wl.ADPOSITIONS), "ADP").when(low.isin(wl.CONJUNCTIONS), "CCONJ").when(low.isin(wl.PRONOUNS), "PRON")
        .when(low.isin(wl.AUXILIARIES), "AUX").when(low.isin(wl.VERBS), "VERB").when(low.isin(wl.ADVERBS) | low.rlike("[a-z]{2}ly$"), "ADV")
        .when(low.isin(wl.ADJECTIVES) | low.rlike("[a-z]{2}(able|ible|al|ful|ic|ive|less|ous|ary)$"), "ADJ").when(low.rlike("[a-z]{3}(ize|ise|ify|ized|ised|ified)$"), "VERB")
        .when(~first & token.rlike(r"^\p{Lu}"), "PROPN").otherwise("NOUN")
    )


def tokens(sentences: DataFrame, normal_form: bool = False) -> DataFrame:
    """``doc_id, sent_idx, pos, token, lemma, tag`` of each sentence (each doc_id and sent_idx once); on demand in Unicode normal form NFKC."""
    s = sentences.groupBy("doc_id", "sent_idx").agg(F.min("sentence").alias("sentence"))
    if normal_form:
        s = s.withColumn("sentence", nfkc("sentence"))
    t = s.select("doc_id", "sent_idx", F.posexplode(F.regexp_extract_all("sentence", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    # The one-row generator computes the tag once; a filter on it would else be pushed below and compute it again.
    t = t.select("doc_id", "sent_idx", "pos", "token", F.inline(F.array(F.struct(tag(F.col("token"), F.col("pos") == 0).alias("tag")))))
    return t.withColumn("lemma", lemma(F.col("token"), F.col("tag")))


def lemma(token: Column, tag_: Column) -> Column:
    """The word in small letters; nouns of more than three letters lose a final s that isn't doubled."""
    low = F.lower(token)
    plural = tag_.isin("NOUN", "PROPN") & (F.length(low) > 3) & low.endswith("s") & ~low.endswith("ss")
    return F.when(plural, F.substr(low, F.lit(1), F.length(low) - 1)).otherwise(low)


def noun_runs(toks: DataFrame) -> DataFrame:
    """``doc_id, sent_idx, token_start, token_end, text, lemma``: maximal runs of adjectives and nouns that end in a noun, and single flags."""
    inside = F.col("tag").isin("ADJ", "NOUN", "PROPN")
    t = toks.where(inside | F.col("token").rlike(FLAG)).withColumn("flag", ~inside)
    t = t.withColumn("island", F.col("pos") - F.row_number().over(W.partitionBy("doc_id", "sent_idx", "flag").orderBy("pos")))
    g = t.groupBy("doc_id", "sent_idx", "flag", F.when(F.col("flag"), F.col("pos")).otherwise(F.col("island")).alias("island")).agg(F.array_sort(F.collect_list(F.struct("pos", "token", "lemma", "tag"))).alias("x"))
    g = g.where(F.col("flag") | last("x.tag").isin("NOUN", "PROPN"))
    return g.select("doc_id", "sent_idx", F.get("x.pos", F.lit(0)).alias("token_start"), last("x.pos").alias("token_end"), F.array_join("x.token", " ").alias("text"), F.array_join("x.lemma", " ").alias("lemma"))


def split_pipes(runs: DataFrame) -> DataFrame:
    """Runs that hold '|' become one row per part, where text and lemma have as many parts."""
    part = lambda c: F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    t = runs.withColumn("tp", part("text")).withColumn("lp", part("lemma"))
    both = F.when((F.size("tp") == F.size("lp")) & (F.size("tp") > 1), F.arrays_zip(F.col("tp").alias("t"), F.col("lp").alias("l"))).otherwise(F.array(F.struct(F.col("text").alias("t"), F.col("lemma").alias("l"))))
    return t.withColumn("b", F.explode(both)).withColumn("text", F.col("b.t")).withColumn("lemma", F.col("b.l")).drop("b", "tp", "lp")


def _edge(c: str) -> Column:
    """Punctuation stripped from the outer sides of the first and the last word."""
    a = F.split(F.col(c), " ")
    cleaned = F.transform(a, lambda x, i: F.when((i == 0) | (i == F.size(a) - 1), F.regexp_replace(x, EDGE, "")).otherwise(x))
    return F.when(F.col(c).rlike(FLAG), F.array(c)).otherwise(F.filter(cleaned, lambda x: x != ""))


def trim_terms(runs: DataFrame) -> DataFrame:
    """Runs without edge punctuation and without stop words at their ends; ``n_tokens`` words are left."""
    t = runs.withColumn("ta", _edge("text")).withColumn("la", _edge("lemma"))
    n = F.least(F.size("ta"), F.size("la"))
    t = t.withColumn("ta", F.slice("ta", F.lit(1), n)).withColumn("la", F.slice("la", F.lit(1), n))
    keep = F.filter(F.transform("la", lambda x, i: F.when(x.isin(wl.STOP_WORDS), F.lit(None).cast("int")).otherwise(i)), lambda i: i.isNotNull())
    t = t.withColumn("keep", keep).withColumn("n", F.size("la"))
    # all stop words: leading ones go first, so that the last word is left
    lo = F.when(F.size("keep") > 0, F.get("keep", F.lit(0))).otherwise(F.greatest(F.lit(0), F.col("n") - 1))
    hi = F.when(F.size("keep") > 0, last("keep")).otherwise(F.greatest(F.lit(0), F.col("n") - 1))
    width = F.greatest(F.lit(0), F.least(F.col("n"), hi - lo + 1))
    t = t.withColumn("ta", F.slice("ta", lo + 1, width)).withColumn("la", F.slice("la", lo + 1, width))
    # The one-row generator keeps filters on the result from being pushed below, where each mention of a column would compute it again.
    x = F.inline(F.array(F.struct(F.array_join("ta", " ").alias("text"), F.array_join("la", " ").alias("lemma"), F.size("ta").alias("n_tokens"))))
    return t.select(*[c for c in t.columns if c not in ("text", "lemma", "ta", "la", "keep", "n")], x)


def reject_reason(text: Column, lem: Column, n_tokens: Column, max_tokens: int = 3, max_chars: int = 60) -> Column:
    """The first rule that rejects a candidate term, or null."""
    compact = F.replace(text, F.lit(" "), F.lit(""))
    flag = text.rlike(FLAG)
    letters = F.length(F.regexp_replace(compact, r"[^\p{L}]", ""))
    return (
        F.when(compact.rlike(r"^[|/\\_=+*~-]*$"), "symbols").when(letters == 0, "no_letter").when(letters / F.greatest(F.length(compact), F.lit(1)) < 0.4, "few_letters").when(text.rlike(r"[<>(){}\[\]]"), "brackets")
        .when(n_tokens > max_tokens, "tokens").when(F.length(lem) > max_chars, "chars").when(lem.rlike("|".join(w.replace(".", r"\.") for w in wl.NOISE)), "noise")
        .when((n_tokens == 1) & lem.isin(wl.STOP_WORDS), "stop_word").when((n_tokens == 1) & (F.length(lem) < 3) & ~flag, "short").when(lem.rlike(r"^[!-/:-@\[-`{-~ ]*[0-9]+[!-/:-@\[-`{-~ ]*$"), "digits")
        .when(lem.rlike("[0-9]{3}"), "digit_run").when(lem.contains("=") & ~flag, "assignment").when(lem.startswith("-") & ~flag, "dash").when(lem.endswith("?"), "question")
    )


def trim_digits(lem: Column, flag: Column) -> Column:
    """'foo12' becomes 'foo' where at least three signs are left that aren't all digits."""
    base = F.trim(F.regexp_replace(lem, "[0-9]+$", ""))
    return F.when(~flag & lem.rlike("[0-9]$") & (F.length(base) >= 3) & ~F.replace(base, F.lit(" "), F.lit("")).rlike("^[0-9]+$"), base).otherwise(lem)


def candidates(toks: DataFrame) -> DataFrame:
    """``doc_id, sent_idx, token_start, token_end, text, lemma, n_tokens``: each lemma once per sentence, at its first place."""
    t = trim_terms(split_pipes(noun_runs(toks)))
    t = t.where(reject_reason(F.col("text"), F.col("lemma"), F.col("n_tokens")).isNull() & (F.col("lemma") != ""))
    flag = F.col("text").rlike(FLAG)
    t = t.withColumn("cut", trim_digits(F.col("lemma"), flag)).withColumn("text", F.when(F.col("cut") != F.col("lemma"), F.trim(F.regexp_replace("text", "[0-9]+$", ""))).otherwise(F.col("text"))).withColumn("lemma", F.col("cut"))
    t = t.withColumn("n_tokens", F.size(F.split("text", " ")))
    g = t.groupBy("doc_id", "sent_idx", "lemma").agg(F.min(F.struct("token_start", "token_end", "text", "n_tokens")).alias("x"))
    return g.select("doc_id", "sent_idx", "x.token_start", "x.token_end", "x.text", "lemma", "x.n_tokens")


def aggregate(cands: DataFrame, min_docs: int = 1) -> DataFrame:
    """``lemma, n_tokens, term_text, freq_total, freq_docs``: counts and first-seen surface; terms of at least ``min_docs`` documents."""
    g = cands.groupBy("lemma", "n_tokens").agg(F.min(F.struct("doc_id", "sent_idx", "token_start", "text")).alias("x"), F.count("*").alias("freq_total"), F.count_distinct("doc_id").alias("freq_docs"))
    return g.where(F.col("freq_docs") >= min_docs).select("lemma", "n_tokens", F.col("x.text").alias("term_text"), "freq_total", "freq_docs")


def kept_occurrences(cands: DataFrame, terms: DataFrame) -> DataFrame:
    """The candidates whose term passed the document threshold of ``aggregate``."""
    return cands.join(terms.select("lemma", "n_tokens"), ["lemma", "n_tokens"], "left_semi")


def tf_idf(terms: DataFrame, cands: DataFrame, max_tokens: int = 3) -> DataFrame:
    """``terms`` with ``idf`` = ln((N+1)/(freq_docs+1)) + 1 and ``tf_idf`` = freq_total * idf (0 for long terms); N documents have a candidate."""
    n = cands.agg(F.count_distinct("doc_id")).scalar()
    t = terms.withColumn("idf", F.log((n + 1) / (F.col("freq_docs") + 1)) + 1)
    return t.withColumn("tf_idf", F.when(F.col("n_tokens") > max_tokens, 0.0).otherwise(F.col("freq_total") * F.col("idf")))


def score_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: n, min, median, mean, p90, p95, max, with linear interpolation."""
    c = F.col(column)
    p = lambda q: F.percentile(c, F.lit(q))
    return df.agg(F.count(c).alias("n"), F.min(c).alias("least"), p(0.5).alias("median"), F.avg(c).alias("mean"), p(0.9).alias("p90"), p(0.95).alias("p95"), F.max(c).alias("most"))


# --- terms listed by a model -------------------------------------------------------------------------------------------------


def artifact_class(c: Column) -> Column:
    """What kind of implementation artefact a term is: url, path, binary, openapi, method, assignment, symbol; null if none."""
    s = F.trim(c)
    tail = F.lower(last(F.split(s, r"[/\\]")))
    binary = tail.rlike(rf"\.({'|'.join(wl.ARTIFACT_ENDINGS)})$")
    parts = F.size(F.filter(F.split(s, r"[/\\]+"), lambda x: x != ""))
    path = s.rlike(r"^(/|\./|\.\./|~|\\\\|[A-Za-z]:\\)") | (s.rlike(r"[/\\]") & ((parts >= 3) | binary))
    version = r"^[vV][0-9]+(\.[0-9]+){1,4}"
    api = F.lower(s).rlike(r"(^|[^a-z0-9_])openapi($|[^a-z0-9_])")
    openapi = F.lower(s).rlike(r"^v[0-9]+(\.[0-9]+){1,4}[_/].*(openapi|swagger)") | (api & (F.lower(s).rlike(r"_(resp|request|response|msg|desc|body|params?)($|[^a-z0-9_])") | s.rlike(version)))
    return (
        F.when(s == "", "empty").when(s.isin(wl.ACCELERATORS) | s.rlike("^[AHVP][0-9]{3}$"), None).when(F.lower(s).rlike("^(https?://|ftp://)"), "url").when(path, "path").when(binary, "binary")
        .when(openapi, "openapi").when(s.rlike("^[A-Za-z]+V[0-9]{3,}[A-Za-z]."), "method").when(s.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\s*=\s*."), "assignment").when(s.rlike(r"^[A-Za-z0-9]+([_/.-][A-Za-z0-9]+){2,}$"), "symbol")
    )


def numeric_heavy(c: Column) -> Column:
    s = F.trim(c)
    digits, letters = F.length(F.regexp_replace(s, "[^0-9]", "")), F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    unit = F.lower(s).rlike(rf"(^|[^\p{{L}}\p{{N}}_])[0-9]+(\.[0-9]+)?\s*({'|'.join(wl.UNITS)})($|[^\p{{L}}\p{{N}}_])")
    return (s == "") | ((digits > 0) & ((digits > letters) | s.rlike("^[0-9]") | unit))


def punctuation_share(c: Column) -> Column:
    s = F.trim(c)
    return F.length(F.regexp_replace(s, r"[\p{L}\p{N}\s]", "")) / F.greatest(F.length(s), F.lit(1))


def generic(c: Column, stop: list[str]) -> Column:
    """The term or, if it has several, each of its words is in the stop list."""
    a = F.filter(F.split(F.lower(squeeze(c)), " "), lambda x: x != "")
    return (F.size(a) == 0) | F.lower(F.trim(c)).isin(stop) | ((F.size(a) >= 2) & F.forall(a, lambda x: x.isin(stop)))


def listed_term_problem(c: Column, stop: list[str] | None = None) -> Column:
    """Why a listed term is dropped: artefact, letters, numeric, punctuation, generic; null if it is kept."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return (
        F.when(c.isNull() | artifact_class(c).isNotNull(), "artifact").when(letters < 3, "letters").when(numeric_heavy(c), "numeric").when(punctuation_share(c) >= 0.5, "punctuation")
        .when(generic(c, stop or wl.STOP_WORDS), "generic")
    )


def accumulate_terms(listed: DataFrame, min_freq: int = 1) -> DataFrame:
    """``term, doc_id, chunk_id, freq_total`` of (term, doc_id, chunk_id) rows: case-sensitive, first place kept, one more per chunk."""
    t = listed.where(listed_term_problem(F.col("term")).isNull()).select(F.trim("term").alias("term"), "doc_id", "chunk_id").distinct()
    g = t.groupBy("term").agg(F.min(F.struct("doc_id", "chunk_id")).alias("x"), F.count("*").alias("freq_total"))
    return g.where(F.col("freq_total") >= min_freq).select("term", "x.doc_id", "x.chunk_id", "freq_total")
