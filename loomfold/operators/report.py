"""Tables behind reports: best matches, ranked rows, summaries that skip missing values, axis positions and decoded genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .match import first_by, years_between


def best_match(variables: DataFrame, dictionary: DataFrame, unmapped: str = "Other / Unmapped") -> DataFrame:
    """(variable, modality, pos, short) from dictionary (name, aliases as array, modality, pos): a name before an alias, then the first in the dictionary."""
    names = dictionary.select(F.col("name").alias("variable"), "modality", "pos", "name", F.lit(1).alias("prio"))
    others = dictionary.select(F.explode("aliases").alias("variable"), "modality", "pos", "name", F.lit(2).alias("prio"))
    keys = names.unionByName(others).filter("variable <> '' and modality is not null")
    best = first_by(keys, ["variable"], [F.col("prio"), F.col("pos")])
    known = variables.select("variable").filter("variable <> ''").distinct().join(best, "variable", "left")
    return known.select("variable", F.coalesce(F.nullif("modality", F.lit("")), F.lit(unmapped)).alias("modality"), "pos", F.coalesce("name", "variable").alias("short"))


def attach_effects(rows: DataFrame, effects: DataFrame, key: str) -> DataFrame:
    """Left join where both sides may repeat a key: a row for each of its effects, and those without one."""
    return rows.join(effects, key, "left")


def onset_variants(onset: list[str], masks: dict[str, list[list[str]]], day: str) -> dict[str, Column]:
    """For each named variant, ``<name>_onset`` and ``<name>_years``: the least onset date whose flags are 1 in all of the variant's lists.

    masks: {variant: lists of flag columns, each as long as onset}; a variant without a list takes every onset.
    """
    out = {}
    for name, lists in masks.items():
        kept = [F.when(F.lit(True) if not lists else _all(F.col(m[k]) == 1 for m in lists), F.col(o)) for k, o in enumerate(onset)]
        least = F.least(*kept) if len(kept) > 1 else kept[0]
        out |= {f"{name}_onset": least, f"{name}_years": years_between(F.col(day), least)}
    return out


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def summary_skipping_nan(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Mean, population deviation, least, greatest and number of the values that are neither null nor NaN."""
    v = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("most"), F.count(v).alias("n"))


def first_row_only(df: DataFrame, keys: list[str], order: list[Column], column: str) -> DataFrame:
    """df with column null except in the first row of each key; only that row is looked up, keys are not sorted."""
    place = F.min(F.struct(*[o.alias(f"_o{k}") for k, o in enumerate(order)])).alias("_first")
    same = df.groupBy(*keys).agg(place)
    here = F.struct(*[o.alias(f"_o{k}") for k, o in enumerate(order)])
    return df.join(same, keys, "left").withColumn(column, F.when(here == F.col("_first"), F.col(column))).drop("_first")


def first_seen(df: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, pos) of each key where it is seen first."""
    return df.groupBy(key).agg(F.min(pos).alias(pos))


def dictionary_order(rows: DataFrame, dictionary: DataFrame, key: str = "variable") -> DataFrame:
    """rows with ``place``, their dictionary position (name, pos); what it lacks comes last, by name."""
    at = dictionary.groupBy(F.col("name").alias(key)).agg(F.min("pos").alias("pos"))
    known = rows.join(at, key, "left")
    order = known.select(key, "pos").distinct().withColumn("place", F.row_number().over(W.orderBy(F.col("pos").asc_nulls_last(), key)))  # a row per variable
    return known.drop("pos").join(order.select(key, "place"), key)


def top_correlates(correlations: DataFrame, n: int = 10) -> DataFrame:
    """(f, side, place, g, r) from (f, g, r): of each f the n greatest and the n least, by bounded aggregates."""
    entry = F.struct(F.round("r", 12).alias("k"), "g", "r")
    known = correlations.filter("r is not null and not isnan(r)")
    # A group has as many rows as there are features.
    both = known.groupBy("f").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, n).alias("negative"), F.slice(F.sort_array(F.collect_list(F.struct((-F.round("r", 12)).alias("k"), "g", "r"))), 1, n).alias("positive"))
    sides = [both.select("f", F.lit(s).alias("side"), F.posexplode(s).alias("place", "x")) for s in ("positive", "negative")]
    return sides[0].unionByName(sides[1]).select("f", "side", (F.col("place") + 1).alias("place"), "x.g", "x.r")


def top_changes(changes: DataFrame, n: int = 10) -> DataFrame:
    """The n features (feature, change) of greatest absolute change in any label."""
    most = changes.groupBy("feature").agg(F.max(F.abs("change")).alias("most"))
    return most.orderBy(F.desc("most"), "feature").limit(n)


def diagnostics(candidates: DataFrame, scores: DataFrame, k: int = 20) -> DataFrame:
    """The k candidates (ind, rank, ...) of least rank with their agreement per view (ind, view, ari) as columns."""
    top = candidates.orderBy("rank", "ind").limit(k)
    views = [r["view"] for r in scores.select("view").distinct().orderBy("view").collect()]
    wide = scores.join(F.broadcast(top.select("ind")), "ind").groupBy("ind").pivot("view", views).agg(F.first("ari"))  # k rows
    return top.join(wide.select("ind", *[F.col(v).alias(f"ari_{v}") for v in views]), "ind", "left")


def decode_genes(population: DataFrame, views: list[str]) -> DataFrame:
    """(ind, ks, linkages, pre_linkage, k_final, fusion) from one column per gene: k_<view>, linkage_<view>, ..."""
    return population.select("ind", F.array(*[f"k_{v}" for v in views]).alias("ks"), F.array(*[f"linkage_{v}" for v in views]).alias("linkages"), "pre_linkage", "k_final", "fusion")


def axis_positions(cells: DataFrame, gap: float = 0.25, step: float = 1.0) -> DataFrame:
    """(x, modality, spacer, x_pos) of heatmap columns (x as ``modality | group``, pos): a spacer after each modality but the last, and running positions."""
    modality = F.trim(F.regexp_replace("x", r"\|.*$", "")).alias("modality")
    base = cells.groupBy("x").agg(F.min("pos").alias("pos")).select("x", modality, "pos")
    order = base.groupBy("modality").agg(F.min("pos").alias("first"))
    last = order.agg(F.max("first").alias("last"))
    real = base.join(order, "modality").select("x", "modality", F.lit(False).alias("spacer"), "first", "pos")
    spacers = order.crossJoin(F.broadcast(last)).filter("first < last").select(F.concat("modality", F.lit(" ")).alias("x"), "modality", F.lit(True).alias("spacer"), "first", F.lit(None).cast("long").alias("pos"))  # one row
    along = W.orderBy("first", F.col("pos").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)  # a row per heatmap column
    return real.unionByName(spacers).select("x", "modality", "spacer", F.sum(F.when(F.col("spacer"), gap).otherwise(step)).over(along).alias("x_pos"))
