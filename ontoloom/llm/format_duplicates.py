"""Records that differ only in white space, letter case, punctuation or order, collapsed into one record each.

Dictionary encoding: each distinct value of a column is canonicalised once into its words; the distinct words get
integer ids; a value becomes the sorted tuple of (field, word id); records with the same tuple are one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.session import materialise

#: Runs of letters and digits in any script; marks that belong to a letter go with it.
WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"


def encode(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``id, tuple``: each distinct id with the sorted integer tuple of its fields' words; no row where there is no word.

    Repeated rows are one. An id with several different values keeps the tuple of each.
    """
    rows = records.select(F.col(key).cast("long").alias("id"), *(F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields))).where("id is not null")
    # canonicalise each distinct value once
    values = rows.select(F.posexplode(F.array(*(f"f{i}" for i in range(len(fields))))).alias("field", "value")).where("value is not null").distinct()
    values = materialise(values.withColumn("words", F.regexp_extract_all(F.lower("value"), F.lit(WORD), F.lit(0))).where("size(words) > 0"), "values")
    words = materialise(values.select(F.explode("words").alias("word")).distinct().withColumn("code", F.monotonically_increasing_id()), "words")
    coded = values.select("field", "value", F.explode("words").alias("word")).join(words, "word")
    codes = coded.groupBy("field", "value").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    if len(fields) == 1:
        return rows.join(codes, rows["f0"] == codes["value"]).select("id", F.col("codes").alias("tuple"))
    cells = materialise(rows.distinct().withColumn("row", F.monotonically_increasing_id()), "rows")
    cells = cells.select("id", "row", F.posexplode(F.array(*(f"f{i}" for i in range(len(fields))))).alias("field", "value")).join(codes, ["field", "value"])
    return cells.groupBy("id", "row").agg(F.sort_array(F.collect_list(F.struct("field", "codes"))).alias("tuple")).select("id", "tuple")


def collapse(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``id, keep_id, n_copies``: every record that has a word, with the smallest id of its group and the group's size.

    Records are the same if in each field their lower-cased words (runs of letters and digits in any script) are the same,
    as often as each occurs, in any order. Null fields count as fields without words; records without any word and null ids
    have no row; rows with the same id and words are one record. Groups are counted before the shuffle, so that a group with a
    third of all rows costs a few rows per task.
    """
    coded = materialise(encode(records, key, fields).distinct(), "tuples")
    groups = coded.groupBy("tuple").agg(F.min("id").alias("keep_id"), F.count_distinct("id").alias("n_copies"))
    return coded.join(groups, "tuple").select("id", "keep_id", "n_copies")


def unique(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``keep_id, n_copies``: one row per group of ``collapse``."""
    return encode(records, key, fields).groupBy("tuple").agg(F.min("id").alias("keep_id"), F.count_distinct("id").alias("n_copies")).drop("tuple")
