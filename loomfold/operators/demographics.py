"""The comparison table of a study: what each group is like, overall too, and whether groups differ, variable by variable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import clean, inference, margins

#: Groups of a comparison at most; they are compared with one another.
MOST_GROUPS = 50


def _kinds(df: DataFrame, names: list[str]) -> tuple[list[str], list[str]]:
    """Those of the names that are numbers, and the other ones."""
    numbers = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    return [n for n in names if n in numbers], [n for n in names if n not in numbers]


def tests(df: DataFrame, comparison: str, numbers: list[str], classes: list[str]) -> DataFrame:
    """(variable, test, statistic, effect, p): two groups by Welch's t and Cohen's d, more by Welch's one-way test and eta squared; classes of two levels by the
    exact test, of more by chi-square, both with Cramer's V. The statistic of an exact test is the table's chi-square. What can't be tested has a null p."""
    groups = [r[0] for r in df.select(comparison).distinct().limit(MOST_GROUPS + 1).collect()]
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups in {comparison}")
    groups.sort()
    rows = None
    group = F.col(comparison).alias("group")
    if numbers:
        long = df.select(group, F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in numbers])).alias("r")).select("group", "r.*")
        if len(groups) == 2:
            own = inference.welch_t(long, tuple(groups), p=True).join(inference.cohens_d(long, tuple(groups)), "variable")
            rows = own.select("variable", F.lit("welch_t").alias("test"), F.col("t").alias("statistic"), F.col("d").alias("effect"), "p")
        else:
            own = inference.eta_squared(long).join(inference.welch_anova(long, p=True), "variable", "left")
            rows = own.select("variable", F.lit("one_way").alias("test"), F.col("f").alias("statistic"), F.col("eta2").alias("effect"), "p")
    if classes:
        long = df.select(F.col(comparison).cast("string").alias("group"), F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in classes])).alias("r")).select("group", "r.*")
        chi = inference.chi_square(long, p=True)
        levels = long.filter("level is not null").groupBy("variable").agg(F.count_distinct("level").alias("levels"))
        two = levels.filter("levels = 2").select("variable")
        exact = margins.fisher(long.join(F.broadcast(two), "variable", "left_semi"), ["variable"]).select("variable", F.col("p").alias("exact_p"))
        own = chi.join(levels, "variable").join(exact, "variable", "left")
        is_two = F.col("levels") == 2
        own = own.select("variable", F.when(is_two, "fisher").otherwise("chi_square").alias("test"), F.col("chi2").alias("statistic"), F.col("cramers_v").alias("effect"), F.when(is_two, F.col("exact_p")).when(F.col("df") > 0, F.col("p")).alias("p"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


def demographic_table(df: DataFrame, dictionary: list[tuple[str, str]], comparison: str, least: int = 30) -> DataFrame:
    """One row per line and group of the table: position, variable, label, level, place, group, n, mean, sd, share, and on a variable's main row test, statistic, effect, p, q, shown.

    dictionary is (name, label) in the order of the table; names that df lacks and the comparison are left out, and so are rows without a comparison. A group of null
    is all rows. A number has one line (level null, place 0) with n, mean and sd; another variable has a line of its n, and one for each level by falling frequency (place
    1, 2, ...; ties by level), with n and its share of the values that are known. The main row is place 0 over all rows. Without more than least rows in both of
    the first two groups nothing is compared, and the table is empty. q is Benjamini-Hochberg's over all variables of the table.
    """
    names = list(dict.fromkeys(n for n, _ in dictionary if n in df.columns and n != comparison))
    numbers, classes = _kinds(df, names)
    own = df.select(comparison, *names).filter(F.col(comparison).isNotNull())
    told = df.sparkSession.createDataFrame([(k, n, dict(dictionary)[n]) for k, n in enumerate(names)], "position long, variable string, label string")
    usable = clean.usable_tables(own, comparison, names, least).filter("usable").select("variable")
    lines = None
    if numbers:
        lines = inference.group_table(own.withColumns({c: F.col(c).cast("double") for c in numbers}), comparison, numbers)
        lines = lines.select("variable", F.lit(None).cast("string").alias("level"), F.lit(0).cast("long").alias("place"), F.col("level").cast("string").alias("group"), "n", "mean", "sd", F.lit(None).cast("double").alias("share"))
    if classes:
        long = own.select(F.col(comparison).cast("string").alias("group"), F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in classes])).alias("r")).select("group", "r.*")
        counts = long.filter("level is not null").groupBy("variable", "level", "group").agg(F.count(F.lit(1)).alias("n"))
        cells = counts.groupingSets([["variable", "level", "group"], ["variable", "level"], ["variable", "group"], ["variable"]], "variable", "level", "group").agg(F.sum("n").alias("n"), F.grouping("level").alias("main"), F.grouping("group").alias("all"))
        whole = cells.filter("main = 1").select("variable", "group", F.col("n").alias("known"))
        order = cells.filter("main = 0 and all = 1").groupBy("variable").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "level"))).alias("order"))  # levels of a variable
        place = order.select("variable", F.posexplode("order").alias("at", "o")).select("variable", F.col("o.level").alias("level"), (F.col("at") + 1).cast("long").alias("place"))
        joined = cells.join(whole.withColumnsRenamed({"variable": "v_", "group": "g_"}), (F.col("variable") == F.col("v_")) & F.col("group").eqNullSafe(F.col("g_"))).join(place, ["variable", "level"], "left")
        none = F.lit(None).cast("double")
        more = joined.select("variable", "level", F.coalesce("place", F.lit(0)).cast("long").alias("place"), "group", "n", none.alias("mean"), none.alias("sd"), F.when(F.col("main") == 0, F.col("n").cast("double") / F.col("known")).alias("share"))
        lines = more if lines is None else lines.unionByName(more)
    found = tests(own, comparison, numbers, classes).join(usable, "variable", "left_semi")
    found = inference.bh(found, "p", ties=["variable"]).withColumn("shown", inference.show_p(F.col("q")))
    main = found.withColumns({"_place": F.lit(0).cast("long"), "_main": F.lit(True)}).withColumnRenamed("variable", "v_")
    on = (F.col("variable") == F.col("v_")) & (F.col("place") == F.col("_place")) & F.col("group").isNull()
    table = lines.join(usable, "variable", "left_semi").join(told, "variable").join(main, on, "left")
    return table.select("position", "variable", "label", "level", "place", "group", "n", "mean", "sd", "share", "test", "statistic", "effect", "p", "q", "shown")
