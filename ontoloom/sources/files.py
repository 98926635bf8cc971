"""File sources and sinks: text folders, stop words, HTML lists, annotations, logs, prompt configurations."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """``title, text, path`` of the .txt files of a folder that aren't blank; the title is the file's name without ending."""
    t = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.col("value").alias("text"), F.input_file_name().alias("path"))
    return t.where("trim(text) <> ''").select(F.url_decode(F.regexp_extract("path", r"([^/]+)\.txt$", 1)).alias("title"), "text", "path")


def stop_words(spark: SparkSession, path: str, by_line: bool = False, fallback: list[str] | None = None) -> DataFrame:
    """``word``: the words of a stop list in small letters, '#' lines left out; one per line, or separated by commas and blanks. A missing file gives ``fallback``."""
    try:
        t = spark.read.text(path)
        t.schema  # noqa: B018
    except Exception:
        return spark.createDataFrame([(w,) for w in fallback or []], "word string")
    t = t.select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    words = F.array(F.lower("v")) if by_line else F.split(F.lower("v"), r"[,\s]+")
    return t.select(F.explode(words).alias("word")).where("word <> ''").distinct()


def list_words(pages: DataFrame, column: str = "html") -> DataFrame:
    """``word``: the single words in HTML list items: bullets stripped, letters and apostrophes only."""
    item = F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1))).alias("item")
    t = pages.select(item).select(F.trim(F.regexp_replace(F.regexp_replace("item", "<[^>]*>", ""), r"^[\s•*·-]+", "")).alias("w"))
    return t.where(F.col("w").rlike("^[A-Za-z']+$")).select(F.lower("w").alias("word")).distinct()


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of manual labels; column names in small letters without a byte order mark."""
    t = spark.read.csv(path, header=True)
    return t.toDF(*(c.replace("﻿", "").strip().lower() for c in t.columns))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One text column as lines of text files."""
    df.select(column).write.mode("overwrite").text(path)


def skipped_log(df: DataFrame) -> DataFrame:
    """``value``: tab-separated lines of term_id, lemma and reason."""
    return df.select(F.concat_ws("\t", F.col("term_id").cast("string"), "lemma", "reason").alias("value"))


@dataclass(frozen=True)
class PromptConfig:
    """What a model stage is asked: instruction, examples and limits."""

    system: str
    examples: list[dict] = field(default_factory=list)
    max_terms: int = 25
    max_new_tokens: int = 220

    @staticmethod
    def load(path: str) -> PromptConfig:
        """From a JSON or YAML file (by its ending); raises ValueError where a field is missing or of the wrong kind."""
        text = Path(path).read_text(encoding="utf-8")
        if path.lower().endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise ValueError("YAML files need the package yaml") from e
            raw = yaml.safe_load(text)
        else:
            raw = json.loads(text)
        if not isinstance(raw, dict) or not str(raw.get("system", "")).strip():
            raise ValueError("a prompt file needs a non-empty 'system'")
        examples = raw.get("examples", [])
        if not isinstance(examples, list) or not all(isinstance(e, dict) and {"input", "output"} <= e.keys() for e in examples):
            raise ValueError("'examples' must be a list of objects with input and output")
        return PromptConfig(raw["system"], examples, int(raw.get("max_terms", 25)), int(raw.get("max_new_tokens", 220)))
