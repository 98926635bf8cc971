"""Table maintenance with the semantics of keyed inserts: first or last wins, accumulation, pending and resumable scans, run ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def version_scan(df: DataFrame, version: int, order: list[str], column: str = "cleaned_version") -> DataFrame:
    """The rows of one version, sorted."""
    return df.where(F.col(column) == version).orderBy(*order)


def pending(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key isn't in ``done`` yet."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def resume(df: DataFrame, done: DataFrame, keys: list[str], order: str, after: object = None, limit: int | None = None) -> DataFrame:
    """The next rows to work on: not done, beyond ``after``, in order, at most ``limit`` of them."""
    t = pending(df, done, keys)
    t = t if after is None else t.where(F.col(order) > after)
    return t.orderBy(order) if limit is None else t.orderBy(order).limit(limit)


def _one(df: DataFrame, keys: list[str], order: list[Column], largest: bool) -> DataFrame:
    # An aggregate instead of a window: rows are reduced before the shuffle, so that a hot key doesn't gather in a task.
    rest = [c for c in df.columns if c not in keys]
    pick = F.struct(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"), F.struct(*[F.col(c).alias(f"r{i}") for i, c in enumerate(rest)] or [F.lit(0)]).alias("r"))
    best = df.groupBy(*keys).agg((F.max if largest else F.min)(pick).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.r.r{rest.index(c)}").alias(c) for c in df.columns])


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the earliest in ``order`` (insert or ignore)."""
    return _one(df, keys, [F.col(c) for c in order], False)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the latest in ``order`` (insert or replace)."""
    return _one(df, keys, [F.col(c) for c in order], True)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``old`` and the first rows of ``new`` whose keys aren't in it."""
    return old.unionByName(first_wins(pending(new, old, keys), keys, order), allowMissingColumns=True)


def insert_or_replace(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last rows of ``new``, and the rows of ``old`` with other keys."""
    latest = last_wins(new, keys, order)
    return pending(old, latest, keys).unionByName(latest, allowMissingColumns=True)


def accumulate(old: DataFrame, new: DataFrame, keys: list[str], total: str, most: str, order: list[str]) -> DataFrame:
    """Accumulating upsert: ``total`` is summed, ``most`` the largest, other columns come from the first row, old rows before new."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in {*keys, total, most}]
    first = F.min(F.struct("_new", *order, *[c for c in rest if c not in order])).alias("x")
    g = rows.groupBy(*keys).agg(F.sum(total).alias(total), F.max(most).alias(most), first)
    return g.select(*keys, total, most, *[F.col(f"x.{c}") for c in rest])


def add_columns(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Additive schema evolution: each missing column with its type and default."""
    for name, (kind, default) in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast(kind))
    return df


def update_column(df: DataFrame, column: str, value: Column, where: Column) -> DataFrame:
    """In-place update: ``value`` where the condition holds, else the old one."""
    return df.withColumn(column, F.when(where, value).otherwise(F.col(column)))


def delete_below(df: DataFrame, column: str, least: float) -> DataFrame:
    """Threshold delete: rows whose ``column`` is at least ``least`` stay."""
    return df.where(F.col(column) >= least)


def ledger(units: DataFrame, keys: list[str], status: Column, error: Column | None = None) -> DataFrame:
    """Rows of a run ledger: unit, status (done, skipped or error) and message."""
    return units.select(*keys, status.alias("status"), (F.lit(None).cast("string") if error is None else error).alias("error_msg"))


def pick_column(columns: list[str], preferred: str | None, candidates: list[str], any_case: bool = True) -> str | None:
    """The preferred column if it is there, else the first of the candidates; with the spelling it has in the table."""
    have = {c.lower() if any_case else c: c for c in reversed(columns)}
    for name in ([preferred] if preferred else []) + candidates:
        if found := have.get(name.lower() if any_case else name):
            return found
    return None


def where_roles(df: DataFrame, condition: str | None, roles: dict[str, str]) -> DataFrame:
    """Filter by a condition that names column roles (such as child, parent) in place of the table's own columns."""
    if not condition:
        return df
    import re

    for role, column in roles.items():
        condition = re.sub(rf"(?<![\w`]){re.escape(role)}(?![\w`])", lambda _, c=column: f"`{c}`", condition)
    return df.where(condition)


def has_table(spark, name: str) -> bool:
    return spark.catalog.tableExists(name)


def columns_of(df: DataFrame) -> DataFrame:
    """``position, column, type``: the columns of a table."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def create_if_missing(spark, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, made empty with the schema if there is none."""
    try:
        return spark.read.schema(schema).parquet(path) if spark.read.parquet(path).columns else spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
        return spark.read.schema(schema).parquet(path)


def reset(df: DataFrame, path: str) -> None:
    """Empty the Parquet table at ``path``; its schema stays."""
    df.limit(0).write.mode("overwrite").parquet(path)


def page(df: DataFrame, order: list[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """The rows behind the first ``offset`` in the given order, at most ``limit``."""
    t = df.orderBy(*order).offset(offset)
    return t if limit is None else t.limit(limit)


def lookup(rows: DataFrame, contexts: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of the context of the same keys, null where there is none; of several contexts the smallest."""
    rest = [c for c in contexts.columns if c not in keys]
    one = contexts.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("x")).select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest))
    return rows.join(one, keys, "left")


def utc_now() -> Column:
    """The time of the query as UTC text, the same for all rows."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
