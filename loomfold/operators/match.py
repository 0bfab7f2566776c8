"""Joins of the assembly stage: lookups, nearest dates, latest versions, and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that should be total; a partial aggregate, so hot keys don't meet in one sort."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*[F.struct(o.isNull().alias("n"), o.alias("v")).alias(f"o{k}") for k, o in enumerate(order)], F.struct(*rest).alias("row"))).alias("first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"first.row.{c}").alias(c) for c in rest])


def outer_coalesce(left: DataFrame, right: DataFrame, keys: list[str], shared: list[str]) -> DataFrame:
    """Full outer join; columns that both have are the left's, or where it has none the right's."""
    other = right.withColumnsRenamed({c: f"{c}_right" for c in shared})
    joined = left.join(other, keys, "full")
    return joined.withColumns({c: F.coalesce(c, f"{c}_right") for c in shared}).drop(*[f"{c}_right" for c in shared])


def lookup(df: DataFrame, table: DataFrame, key: str, column: str, order: list[Column], default: object = None) -> DataFrame:
    """df with column from the table's first row of the key; what df has in it stays where the table has null."""
    one = first_by(table.select(key, column, *[o.alias(f"_o{k}") for k, o in enumerate(order)]), [key], [F.col(f"_o{k}") for k in range(len(order))])
    joined = df.join(one.select(key, F.col(column).alias("_new")), key, "left")
    values = [F.col("_new"), *([F.col(column)] if column in df.columns else []), *([F.lit(default)] if default is not None else [])]
    return joined.withColumn(column, F.coalesce(*values)).drop("_new")


def nearest_date(events: DataFrame, reference: DataFrame, key: str, date: str, ref_date: str, ties: list[str]) -> DataFrame:
    """Per key of reference, the event of least distance in days to its reference date; the earlier ties first."""
    both = events.join(reference.select(key, ref_date), key).withColumn("gap_days", F.abs(F.datediff(date, ref_date)))
    return first_by(both, [key], [F.col("gap_days"), F.col(date), *[F.col(t) for t in ties]])


def latest(files: DataFrame, by: list[str], version: str) -> DataFrame:
    """Rows of the highest version of each group, ties included."""
    top = files.groupBy(*by).agg(F.max(version).alias("_top"))
    return files.join(top, by).filter(F.col(version) == F.col("_top")).drop("_top")


def first_non_null(df: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """The earliest non-null value of each column, per key."""
    return df.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])


def prefix_join(names: DataFrame, variables: DataFrame) -> DataFrame:
    """Columns (name) with the variables (variable) they belong to: of the same name, or ``variable_`` and more.

    Joined on every prefix that ends before an underscore, so it is an equi-join.
    """
    parts = F.split("name", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "_"))
    return names.withColumn("variable", F.explode(prefixes)).join(variables, "variable")


def completeness_choice(one: DataFrame, two: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per column the source with more non-null values (one on a tie), the other filling in where it has none."""
    counts = [d.agg(*[F.count(c).alias(c) for c in columns]).first() for d in (one, two)]
    joined = one.join(two.withColumnsRenamed({c: f"{c}_two" for c in columns}), key, "full")
    pick = lambda c: F.coalesce(c, f"{c}_two") if counts[0][c] >= counts[1][c] else F.coalesce(f"{c}_two", c)
    return joined.select(key, *[pick(c).alias(c) for c in columns])


def row_total(columns: list[str], zero_filled: bool = False) -> Column:
    """Sum of the non-null values; null if there is none, unless zero_filled."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in columns), F.lit(0))
    return total if zero_filled else F.when(F.coalesce(*[F.col(c) for c in columns]).isNotNull(), total)


def masked_least(values: list[str], masks: list[str]) -> Column:
    """The least of the values whose mask is 1; null if there is none."""
    kept = [F.when(F.col(m) == 1, F.col(v)) for v, m in zip(values, masks, strict=True)]
    return F.least(*kept) if len(kept) > 1 else kept[0]


def years_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier) / F.lit(365.25)


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n) with cells that don't occur as 0. The values of each side are crossed, not the rows."""
    counts = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    grid = df.select(row).distinct().crossJoin(df.select(column).distinct())
    return grid.join(counts, [row, column], "left").withColumn("n", F.coalesce("n", F.lit(0)))
