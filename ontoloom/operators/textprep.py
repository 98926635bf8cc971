"""Preparation of texts: ingest, line cleaning, sentence units, case transfer, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ontoloom.functions import word_lists as wl
from ontoloom.functions.text import BLANKS, last, nfkc, squeeze


def normalize_whitespace(c: Column) -> Column:
    """Line and paragraph separators become line feeds, other Unicode spaces spaces, runs of spaces and tabs one; line ends are trimmed."""
    c = F.regexp_replace(c, r"\r\n?|[\x{85}\x{2028}\x{2029}\x{b}\x{c}\x{1c}-\x{1e}]", "\n")
    c = F.regexp_replace(c, r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" +\n", "\n"), r"[ \n]+$", "")


def line_key(c: Column, normal_form: bool = False) -> Column:
    """A line as compared: no byte order mark, blanks squeezed, trimmed; on demand in Unicode normal form NFKC."""
    c = nfkc(c) if normal_form else c
    return squeeze(F.replace(c, F.lit("﻿"), F.lit("")))


def ingest(docs: DataFrame, id_hex: int = 16) -> DataFrame:
    """``doc_key, doc_id, content_hash, text``: the first document (by doc_id) of each normalised text that isn't blank.

    ``doc_key`` is 'doc_' with the first ``id_hex`` digits of the content hash; of texts that share a key only the first comes in.
    """
    t = docs.select("doc_id", normalize_whitespace(F.col("text")).alias("text")).where("trim(text) <> ''").withColumn("content_hash", F.sha2("text", 256))
    t = t.withColumn("doc_key", F.concat(F.lit("doc_"), F.substring("content_hash", 1, id_hex)))
    first = t.groupBy("doc_key").agg(F.min(F.struct("doc_id", "content_hash", "text")).alias("x"))
    return first.select("doc_key", "x.doc_id", "x.content_hash", "x.text")


def id_collisions(docs: DataFrame, lengths: tuple[int, ...] = (4, 8, 16)) -> DataFrame:
    """``id_hex, n_texts, n_keys, n_lost`` for each length of the key."""
    h = docs.select(F.sha2(normalize_whitespace(F.col("text")), 256).alias("h")).where("h is not null").distinct()
    keys = F.explode(F.array(*(F.struct(F.lit(n).alias("id_hex"), F.substring("h", 1, n).alias("key")) for n in lengths))).alias("k")
    per = h.select(keys).groupBy("k.id_hex", "k.key").agg(F.count("*").alias("n"))
    return per.groupBy("id_hex").agg(F.sum("n").alias("n_texts"), F.count("*").alias("n_keys"), (F.sum("n") - F.count("*")).alias("n_lost"))


# --- cleaning ----------------------------------------------------------------------------------------------------------


def is_preserved(key: Column, strict: bool = False) -> Column:
    """A line that is content whatever else it looks like. ``strict`` takes the rule for capitals literally."""
    low = F.lower(key)
    capitals = key.rlike(wl.PRESERVE_CAPITALS if strict else wl.PRESERVE_WORDS)
    return low.rlike("|".join(wl.PRESERVE)) | capitals


def is_technical(key: Column, strict: bool = False) -> Column:
    return (key != "") & (is_preserved(key, strict) | (~key.rlike(wl.NAVIGATION_IN_LINE) & key.rlike(wl.CODE_SYMBOLS)))


def is_structural(key: Column) -> Column:
    return key.isin(wl.STRUCTURAL_HEADERS) | key.rlike(f"^{wl.either(wl.STRUCTURAL_HEADERS)}:")


def n_words(key: Column) -> Column:
    return F.when(key == "", 0).otherwise(F.size(F.split(key, " ")))


def is_boilerplate(key: Column, min_words: int = 4) -> Column:
    """For lines that are neither technical nor structural."""
    letters = F.length(F.regexp_replace(key, r"[^\p{L}]", "")) / F.greatest(F.length(key), F.lit(1))
    short = (n_words(key) < min_words) & ((letters < 0.6) | key.isin(wl.NAVIGATION_LINE))
    return (key == "") | F.lower(key).rlike("|".join(wl.BOILERPLATE)) | short


def lines(docs: DataFrame, normal_form: bool = False) -> DataFrame:
    """``doc_id, pos, line, key, n_lines, lead``: the lines of each text from the first with more than five words on."""
    t = docs.where("text is not null").select("doc_id", F.posexplode(F.split(F.ltrim(F.col("text"), F.lit("﻿")), "\n")).alias("pos", "line"))
    t = t.withColumn("key", line_key(F.col("line"), normal_form))
    w = W.partitionBy("doc_id")
    t = t.withColumn("n_all", F.count("*").over(w)).withColumn("lead", F.coalesce(F.min(F.when(n_words(F.col("key")) > 5, F.col("pos"))).over(w), F.lit(0)))
    return t.where("pos >= lead").withColumn("n_lines", F.col("n_all") - F.col("lead"))


def classify_lines(docs: DataFrame, strict: bool = False, min_words: int = 4, normal_form: bool = False) -> DataFrame:
    """The lines with ``action``: repeated, print, technical, structural, boilerplate or keep; the first that applies."""
    t = lines(docs, normal_form)
    key = F.col("key")
    count = F.when(key != "", F.count("*").over(W.partitionBy("doc_id", "key"))).otherwise(0)
    limit = F.when(F.col("n_lines") < 50, 2).when(F.col("n_lines") < 200, 3).otherwise(4)
    repeated = (count >= limit) & (n_words(key) <= 15) & ~is_structural(key) & ~is_preserved(key, strict)
    action = (
        F.when(repeated, "repeated").when(F.lower(key).rlike(f"{wl.PRINT_COPYRIGHT}|{wl.PRINT_PAGE}"), "print").when(is_technical(key, strict), "technical")
        .when(is_structural(key), "structural").when(is_boilerplate(key, min_words), "boilerplate").otherwise("keep")
    )
    return t.withColumn("action", action)


def clean_documents(docs: DataFrame, strict: bool = False, min_words: int = 4, normal_form: bool = False) -> DataFrame:
    """``doc_id, cleaned_text`` and seven counters: the kept lines without trailing footers, at most one empty line in a row.

    Structural lines get a colon. If only blank lines are left of a text that has others, its lines stay as they are.
    """
    t = classify_lines(docs, strict, min_words, normal_form)
    stays = F.col("action").isin("technical", "structural", "keep")
    body = F.lower("key").rlike(f"{wl.FOOTER}|{wl.PRINT_COPYRIGHT}|{wl.PRINT_PAGE}")
    w = W.partitionBy("doc_id")
    t = t.withColumn("stays", stays).withColumn("last", F.max(F.when(stays & ~body, F.col("pos"))).over(w))
    t = t.withColumn("kept", F.col("stays") & (F.col("pos") <= F.coalesce("last", F.lit(-1))))
    plain = F.replace(F.col("line"), F.lit("﻿"), F.lit(""))
    colon = F.when((F.col("action") == "structural") & ~F.col("key").endswith(":"), F.concat(F.regexp_replace(plain, f"{BLANKS}$", ""), F.lit(":"))).otherwise(plain)
    joined = lambda c, cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", c.alias("x"))))), lambda s: s["x"]), "\n")
    n = lambda cond: F.count_if(cond)
    g = t.groupBy("doc_id").agg(
        F.max("n_all").alias("lines_total"), F.max("lead").cast("long").alias("lines_removed_leading"), n(F.col("action") == "repeated").alias("lines_removed_repeated"),
        n(F.col("action").isin("print", "boilerplate") | (F.col("stays") & ~F.col("kept"))).alias("lines_removed_boilerplate"),
        n(F.col("action") == "technical").alias("lines_technical_preserved"), n(F.col("action") == "structural").alias("lines_structural_preserved"),
        n(F.col("stays")).alias("k"), n(F.col("kept") & (F.col("key") != "")).alias("full"), n(F.col("key") != "").alias("had"), F.max("n_lines").alias("n_lines"),
        joined(colon, F.col("kept")).alias("kept_text"), joined(F.col("line"), F.lit(True)).alias("all_text"),
    )
    fallback = (F.col("full") == 0) & (F.col("had") > 0)
    text = F.regexp_replace(F.when(fallback, F.col("all_text")).otherwise(F.col("kept_text")), r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, f"^{BLANKS}|{BLANKS}$", "")
    return g.select(
        "doc_id", text.alias("cleaned_text"), "lines_total", "lines_removed_leading", "lines_removed_repeated", "lines_removed_boilerplate", "lines_technical_preserved",
        "lines_structural_preserved", F.when(fallback, F.col("n_lines")).otherwise(F.col("k")).alias("lines_kept"),
    )


# --- sentences and chunks ------------------------------------------------------------------------------------------------


def sentence_problem(c: Column) -> Column:
    """Why a sentence is no valid unit: empty, length, fragment, no_letter, colon; null if it is one."""
    s = squeeze(c)
    n = F.length(s)
    closed = s.rlike(r"^\p{Lu}") & s.rlike(r"[.!?]$")
    return (
        F.when(s == "", "empty").when((n > 800) | ((n < 10) & ~closed), "length").when(F.lower(s).rlike("|".join(wl.FRAGMENTS)), "fragment")
        .when(~s.rlike(r"\p{L}"), "no_letter").when(s.endswith(":") & (n_words(s) < 10), "colon")
    )


def emit_sentences(sentences: DataFrame) -> DataFrame:
    """``sentence_id, doc_id, sent_idx, sentence, start_char, end_char``: the valid sentences, each once, numbered anew from 1."""
    rows = sentences.select("doc_id", F.col("sent_idx").alias("old"), "sentence", "start_char", "end_char").distinct().where(sentence_problem(F.col("sentence")).isNull())
    idx = F.row_number().over(W.partitionBy("doc_id").orderBy("old", "sentence", "start_char"))
    return rows.withColumn("sent_idx", idx).select(F.format_string("%d_sent_%05d", "doc_id", "sent_idx").alias("sentence_id"), "doc_id", "sent_idx", "sentence", "start_char", "end_char")


def transfer_case(original: Column, lemma: Column) -> Column:
    """The lemma in the case of the word it stands for."""
    letters = F.regexp_replace(original, r"[^\p{L}]", "")
    upper = (letters != "") & (original == F.upper(original)) & (original != F.lower(original))
    first = F.substring(original, 1, 1)
    each = F.array_join(F.zip_with(F.regexp_extract_all(original, F.lit("(?s)."), F.lit(0)), F.regexp_extract_all(lemma, F.lit("(?s)."), F.lit(0)), lambda o, x: F.when(o != F.lower(o), F.upper(x)).otherwise(x)), "")
    capital = F.concat(F.upper(F.substring(lemma, 1, 1)), F.lower(F.substr(lemma, F.lit(2))))
    return (
        F.when(upper, F.upper(lemma)).when(first != F.lower(first), capital)
        .when((original != F.lower(original)) & (F.length(original) == F.length(lemma)), each).otherwise(lemma)
    )


def chunk(sentences: DataFrame, max_sentences: int = 12, max_tokens: int = 800, overlap: int = 1) -> DataFrame:
    """``chunk_id, doc_id, text, sentence_ids, num_sentences, start_char, end_char, estimated_tokens``: greedy overlapping chunks.

    From sentence i on as many sentences as fit, the first always; the next chunk starts ``overlap`` sentences before the end, but at least one
    further. A sentence's tokens are its words times 1.3, rounded down. The fold over the sentences of a document runs inside the JVM.
    """
    words = F.size(F.filter(F.split(squeeze(F.col("sentence")), " "), lambda x: x != ""))
    t = sentences.select("doc_id", "sent_idx", "sentence_id", "sentence", "start_char", "end_char", F.floor(words * 1.3).cast("int").alias("t"))
    per = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_idx", "sentence_id", "sentence", "start_char", "end_char", "t"))).alias("s"))
    n = F.size("s")
    # end of the greedy chunk that starts at i (exclusive): a window of at most max_sentences sentences is looked at
    def reach(i: Column) -> Column:
        width = F.least(F.lit(max_sentences), n - i)
        def more(acc: Column, k: Column) -> Column:
            full = (k > 0) & (acc["sum"] + F.get("s", i + k)["t"] > max_tokens)
            go = acc["open"] & ~full
            return F.struct(F.when(go, acc["sum"] + F.get("s", i + k)["t"]).otherwise(acc["sum"]).alias("sum"), F.when(go, k + 1).otherwise(acc["n"]).alias("n"), go.alias("open"))
        return i + F.aggregate(F.sequence(F.lit(0), width - 1), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("open")), more)["n"]
    ends = F.transform(F.sequence(F.lit(0), n - 1), reach)
    per = per.withColumn("ends", ends)
    def visit(acc: Column, i: Column) -> Column:
        here = i == acc["next"]
        end = F.get("ends", i)
        nxt = F.greatest(end - overlap, i + 1)
        return F.struct(F.when(here, nxt).otherwise(acc["next"]).alias("next"), F.when(here, F.concat(acc["starts"], F.array(i))).otherwise(acc["starts"]).alias("starts"))
    starts = F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(F.lit(0).alias("next"), F.lit([]).cast("array<int>").alias("starts")), visit)["starts"]
    c = per.select("doc_id", "s", "ends", F.posexplode(starts).alias("no", "i")).withColumn("x", F.slice("s", F.col("i") + 1, F.get("ends", F.col("i")) - F.col("i")))
    return c.select(
        F.format_string("%d_chunk_%04d", F.col("doc_id"), F.col("no") + 1).alias("chunk_id"), "doc_id", F.array_join(F.col("x.sentence"), " ").alias("text"),
        F.array_join(F.col("x.sentence_id"), ",").alias("sentence_ids"), F.size("x").alias("num_sentences"), F.get("x.start_char", F.lit(0)).alias("start_char"),
        last("x.end_char").alias("end_char"), F.aggregate("x.t", F.lit(0), lambda a, b: a + b).alias("estimated_tokens"),
    )
