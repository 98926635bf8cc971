"""References to records that do not exist.

Parent keys and child keys of all tables are brought into one long form, tagged by side, and grouped by (parent table,
key): a group without a parent row is an orphan. References are counted per (table, column, period, key) before
they are shuffled, so that a key that holds a third of all rows is one row per map task and period.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reference:
    """One referring column: rows of ``df`` whose ``column`` names a key of ``target``.

    ``period`` is a string column expression; ``at`` the time of the referring row where a key that was created later
    counts as missing, else None.
    """

    df: DataFrame
    table: str
    column: str
    target: str
    period: Column
    at: Column | None = None


@dataclass(frozen=True)
class Target:
    """A table with keys; ``at`` is the time from which a key exists (None: always)."""

    df: DataFrame
    table: str
    key: str
    at: Column | None = None


def month_of(c: Column) -> Column:
    """'YYYY-MM', or 'none' for null."""
    return F.coalesce(F.date_format(c, "yyyy-MM"), F.lit("none"))


def orphan_references(references: list[Reference], targets: list[Target]) -> DataFrame:
    """One row for each distinct missing key of a (table, column, period): ``ref_table, ref_column, period, ref_id,
    n_refs, reason`` with reason 'missing' or 'later'.

    Keys are compared as numbers where all named key columns are of integer types, else as text. Null keys are no references; null keys of a target name nothing. A key whose target row was created after the
    first referring row of the period is 'later' (only where both times are given and not null). Repeated rows of a
    target are one key, created at its earliest time. Empty tables give no rows. Clashing names of extra columns don't matter,
    only the named columns are read.
    """
    none = F.lit(None).cast("timestamp")
    kinds = {df.schema[c].dataType.simpleString() for df, c in [*((r.df, r.column) for r in references), *((t.df, t.key) for t in targets)]}
    kind = "long" if kinds <= {"tinyint", "smallint", "int", "bigint"} else "string"
    parts = []
    for r in references:
        key = F.col(r.column).cast(kind)
        parts.append(
            r.df.select(
                F.lit(r.target).alias("target"), key.alias("id"), F.lit(r.table).alias("ref_table"), F.lit(r.column).alias("ref_column"),
                r.period.alias("period"), (none if r.at is None else r.at.cast("timestamp")).alias("at"),
            )
            .where("id is not null")
            .groupBy("target", "id", "ref_table", "ref_column", "period")
            .agg(F.count("*").alias("n"), F.min("at").alias("at"))
            .withColumn("side", F.lit(0))
        )
    for t in targets:
        parts.append(
            t.df.select(F.lit(t.table).alias("target"), F.col(t.key).cast(kind).alias("id"), (none if t.at is None else t.at.cast("timestamp")).alias("at"))
            .where("id is not null")
            .groupBy("target", "id")
            .agg(F.min("at").alias("at"))
            .select(
                "target", "id", *(F.lit(None).cast("string").alias(c) for c in ("ref_table", "ref_column", "period")), F.lit(0).cast("long").alias("n"), "at", F.lit(1).alias("side")
            )
        )
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    ref = F.struct("ref_table", "ref_column", "period", "n", "at")
    # The list of a key has at most one entry per referring column and period: rows were counted before.
    groups = long.groupBy("target", "id").agg(
        F.max("side").alias("has_parent"),
        F.min(F.when(F.col("side") == 1, F.col("at"))).alias("since"),
        F.collect_list(F.when(F.col("side") == 0, ref)).alias("refs"),
    )
    later = F.exists("refs", lambda r: r["at"] < F.col("since"))
    return (
        groups.where((F.col("has_parent") == 0) | later)
        .select("id", "has_parent", "since", F.explode("refs").alias("r"))
        .where((F.col("has_parent") == 0) | (F.col("r.at") < F.col("since")))
        .select(
            "r.ref_table", "r.ref_column", "r.period", F.col("id").alias("ref_id"), F.col("r.n").alias("n_refs"),
            F.when(F.col("has_parent") == 0, "missing").otherwise("later").alias("reason"),
        )
    )


def orphan_summary(orphans: DataFrame) -> DataFrame:
    """Distinct missing keys and orphan references per table, column, period and reason."""
    return orphans.groupBy("ref_table", "ref_column", "period", "reason").agg(F.count("*").alias("n_ids"), F.sum("n_refs").alias("n_refs"))
