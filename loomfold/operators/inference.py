"""Group comparisons: statistics as aggregates over all variables at once, p-values on the few rows that result."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pvalues
from ..functions.ranks import hash_key, ranked


def _moments(long: DataFrame) -> DataFrame:
    """(variable, group, n, mean, var) of rows (variable, group, value)."""
    return long.filter("value is not null and group is not null").groupBy("variable", "group").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))


def _two(long: DataFrame, groups: tuple) -> DataFrame:
    side = lambda k: {f"{c}{k}": F.max(F.when(F.col("group") == groups[k], F.col(c))) for c in ("n", "mean", "var")}
    return _moments(long).groupBy("variable").agg(*[v.alias(c) for c, v in (side(0) | side(1)).items()])


def cohens_d(long: DataFrame, groups: tuple) -> DataFrame:
    """(variable, d): difference of the second group's mean from the first's in pooled deviations."""
    pooled = F.sqrt(((F.col("n0") - 1) * F.col("var0") + (F.col("n1") - 1) * F.col("var1")) / (F.col("n0") + F.col("n1") - 2))
    return _two(long, groups).select("variable", F.try_divide(F.col("mean1") - F.col("mean0"), pooled).alias("d"))


def welch_t(long: DataFrame, groups: tuple, p: bool = False) -> DataFrame:
    """(variable, t, df) of the unequal-variances t test, with its two-sided p-value on request."""
    a, b = F.col("var0") / F.col("n0"), F.col("var1") / F.col("n1")
    out = _two(long, groups).select("variable", F.try_divide(F.col("mean0") - F.col("mean1"), F.sqrt(a + b)).alias("t"), F.try_divide(F.pow(a + b, 2), a * a / (F.col("n0") - 1) + b * b / (F.col("n1") - 1)).alias("df"))
    return out.withColumn("p", pvalues.t_p("t", "df")) if p else out


def welch_anova(long: DataFrame, p: bool = False) -> DataFrame:
    """(variable, f, df1, df2) of Welch's one-way test over any number of groups."""
    m = _moments(long).filter("n > 1 and var > 0").withColumn("w", F.col("n") / F.col("var"))
    whole = m.groupBy("variable").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("mean")).alias("swm"), F.count(F.lit(1)).cast("double").alias("k"))
    parts = m.join(whole, "variable").groupBy("variable", "k").agg(
        F.sum(F.col("w") * F.pow(F.col("mean") - F.col("swm") / F.col("sw"), 2)).alias("between"), F.sum(F.pow(1.0 - F.col("w") / F.col("sw"), 2) / (F.col("n") - 1.0)).alias("lam")
    )
    k = F.col("k")
    f = (F.col("between") / (k - 1.0)) / (1.0 + 2.0 * (k - 2.0) / (k * k - 1.0) * F.col("lam"))
    out = parts.filter("k > 1").select("variable", f.alias("f"), (k - 1.0).alias("df1"), ((k * k - 1.0) / (3.0 * F.col("lam"))).alias("df2"))
    return out.withColumn("p", pvalues.f_p("f", "df1", "df2")) if p else out


def eta_squared(long: DataFrame) -> DataFrame:
    """(variable, eta2): the groups' part of the sum of squares."""
    rows = long.filter("value is not null and group is not null")
    total = rows.groupBy("variable").agg(F.avg("value").alias("grand"), (F.var_pop("value") * F.count(F.lit(1))).alias("total"))
    return _moments(long).join(total, "variable").groupBy("variable", "total").agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("between")).select("variable", F.try_divide("between", "total").alias("eta2"))


def chi_square(rows: DataFrame, p: bool = False) -> DataFrame:
    """(variable, n, chi2, df, cramers_v) of rows (variable, group, level)."""
    cells = rows.filter("level is not null and group is not null").groupBy("variable", "group", "level").agg(F.count(F.lit(1)).cast("double").alias("n"))
    r = cells.groupBy("variable", "group").agg(F.sum("n").alias("nr"))
    c = cells.groupBy("variable", "level").agg(F.sum("n").alias("nc"))
    sides = r.groupBy("variable").agg(F.sum("nr").alias("total"), F.count(F.lit(1)).alias("rows")).join(c.groupBy("variable").agg(F.count(F.lit(1)).alias("cols")), "variable")
    # Empty cells need no row: the sum over all of (n - e)^2 / e is that over n > 0 of n^2 / e, less the total.
    sums = cells.join(r, ["variable", "group"]).join(c, ["variable", "level"]).groupBy("variable").agg(F.sum(F.col("n") * F.col("n") / (F.col("nr") * F.col("nc"))).alias("s")).join(sides, "variable")
    chi2 = F.col("total") * (F.col("s") - 1.0)
    out = sums.select("variable", F.col("total").cast("long").alias("n"), chi2.alias("chi2"), ((F.col("rows") - 1) * (F.col("cols") - 1)).cast("long").alias("df"), F.sqrt(F.try_divide(F.greatest(F.lit(0.0), chi2), F.col("total") * (F.least("rows", "cols") - 1))).alias("cramers_v"))
    return out.withColumn("p", pvalues.chi2_p("chi2", F.col("df").cast("double"))) if p else out


def fisher(rows: DataFrame) -> DataFrame:
    """(variable, p) of rows (variable, group, level); null but for two groups and two levels (margins.fisher takes any number)."""
    rows = rows.filter("group is not null and level is not null")
    low = rows.groupBy("variable").agg(F.min("group").alias("g"), F.min("level").alias("l"), F.max("group").alias("g2"), F.max("level").alias("l2"))
    cell = lambda g, l: F.sum(((F.col("group") == F.col("g")) == F.lit(g)).cast("int") * ((F.col("level") == F.col("l")) == F.lit(l)).cast("int"))
    counts = rows.join(low, "variable").groupBy("variable").agg(cell(True, True).alias("a"), cell(True, False).alias("b"), cell(False, True).alias("c"), cell(False, False).alias("d"), F.max(~F.col("group").isin(F.col("g"), F.col("g2")) | ~F.col("level").isin(F.col("l"), F.col("l2")) | (F.col("g") == F.col("g2")) | (F.col("l") == F.col("l2"))).alias("other"))
    return counts.withColumn("p", pvalues.fisher_p(*[F.when(~F.col("other"), F.col(c)) for c in "abcd"])).drop("other")


def bh(df: DataFrame, p: str, families: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """df with ``q``: Benjamini-Hochberg over each family, a table of tests; null p-values are no tests."""
    families = families or []
    down = W.partitionBy(*families).orderBy(F.col(p).desc_nulls_last(), *(ties or []))
    m = F.count(p).over(W.partitionBy(*families))
    rank = m - F.row_number().over(down) + 1
    own = df.withColumn("_raw", F.col(p) * m / rank)
    q = F.least(F.lit(1.0), F.min("_raw").over(down.rowsBetween(W.unboundedPreceding, 0)))
    return own.withColumn("q", F.when(F.col(p).isNotNull(), q)).drop("_raw")


def show_p(p: Column) -> Column:
    return F.when(p < 0.001, "<0.001").when(p > 0.99, ">0.99").otherwise(F.format_string("%.3f", p))


def permutation_p(df: DataFrame, id_col: str, group: str, value: str, n: int, seed: object = "perm") -> DataFrame:
    """One row: observed difference of means (group 1 less group 0), and its permutation p-value over n relabelings by hash."""
    boots = F.explode(F.sequence(F.lit(1), F.lit(n)))
    own = df.select(id_col, F.col(group).alias("_g"), F.col(value).alias("_v")).filter("_g is not null and _v is not null")
    many = own.withColumn("_b", boots)
    to = ranked(many.select(id_col, "_b", "_v"), hash_key("here", id_col, "_b"), [id_col], ["_b"])
    of = ranked(many.select(id_col, "_b", "_g"), hash_key(seed, id_col, "_b"), [id_col], ["_b"])
    dealt = to.select("_b", "rank", "_v").join(of.select("_b", "rank", "_g"), ["_b", "rank"])
    diff = F.avg(F.when(F.col("_g") == 1, F.col("_v"))) - F.avg(F.when(F.col("_g") == 0, F.col("_v")))
    null = dealt.groupBy("_b").agg(diff.alias("d"))
    seen = own.agg(diff.alias("observed"))
    p = (F.sum((F.abs("d") >= F.abs("observed") - 1e-9).cast("int")) + 1.0) / (F.count("d") + 1.0)
    return null.crossJoin(F.broadcast(seen)).groupBy("observed").agg(p.alias("p"))  # one row


def monte_carlo_chi2(df: DataFrame, id_col: str, group: str, level: str, n: int, seed: object = "mc") -> DataFrame:
    """One row: chi-square of two columns and its Monte-Carlo p-value over n relabelings by hash."""
    own = df.select(F.col(id_col).alias("_id"), F.col(group).alias("_g"), F.col(level).alias("_l")).filter("_g is not null and _l is not null")
    many = own.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(n))))
    to = ranked(many.select("_id", "_b", "_l"), hash_key("here", "_id", "_b"), ["_id"], ["_b"])
    of = ranked(many.select("_id", "_b", "_g"), hash_key(seed, "_id", "_b"), ["_id"], ["_b"])
    dealt = to.select("_b", "rank", "_l").join(of.select("_b", "rank", "_g"), ["_b", "rank"])
    null = chi_square(dealt.select(F.col("_b").alias("variable"), F.col("_g").alias("group"), F.col("_l").alias("level"))).select(F.col("chi2").alias("null_chi2"))
    seen = chi_square(own.select(F.lit(0).alias("variable"), F.col("_g").alias("group"), F.col("_l").alias("level"))).select("chi2")
    p = (F.sum((F.col("null_chi2") >= F.col("chi2") - 1e-9).cast("int")) + 1.0) / (F.count("null_chi2") + 1.0)
    return null.crossJoin(F.broadcast(seen)).groupBy("chi2").agg(p.alias("p"))  # one row


def monte_carlo_by(df: DataFrame, id_col: str, stratum: str, group: str, level: str, n: int, families: list[str] | None = None, seed: object = "mc") -> DataFrame:
    """(families, stratum, chi2, p, q): Monte-Carlo chi-square within each stratum, all strata at once, and FDR within each family of strata.

    A stratum with one group or one level has no test: p and q are null.
    """
    keys = [*(families or []), stratum]
    own = df.select(F.col(id_col).alias("_id"), *keys, F.col(group).alias("group"), F.col(level).alias("level")).filter("group is not null and level is not null")
    many = own.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("_key", F.concat_ws(":", *keys, "_id", "_b"))
    to = ranked(many.select("_key", *keys, "_b", "level"), hash_key("here", "_key"), ["_key"], [*keys, "_b"])
    of = ranked(many.select("_key", *keys, "_b", "group"), hash_key(seed, "_key"), ["_key"], [*keys, "_b"])
    dealt = to.select(*keys, "_b", "rank", "level").join(of.select(*keys, "_b", "rank", "group"), [*keys, "_b", "rank"])
    null = chi_square(dealt.select(F.struct(*keys, "_b").alias("variable"), "group", "level")).select("variable.*", F.col("chi2").alias("null_chi2"), "df")
    seen = chi_square(own.select(F.struct(*keys).alias("variable"), "group", "level")).select("variable.*", "chi2", "df")
    p = (F.sum((F.col("null_chi2") >= F.col("chi2") - 1e-9).cast("int")) + 1.0) / (F.count("null_chi2") + 1.0)
    tests = seen.filter("df > 0").join(null.drop("df"), keys).groupBy(*keys, "chi2").agg(p.alias("p"))
    out = seen.select(*keys).join(tests, keys, "left")
    return bh(out, "p", families, ties=[stratum])


#: Cells of a table of counts (outcome by predictors' levels) that a model is fitted on, at most; the driver holds them.
MOST_CELLS = 1_000_000


def _multinomial(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (predictors by classes but the first) and their covariance from counts y (patterns by classes), by Newton's method."""
    n, (p, k) = y.sum(axis=1), (x.shape[1], y.shape[1] - 1)
    beta = np.zeros((p, k))
    for _ in range(100):
        chance = _softmax(x @ beta)[:, 1:]
        slope = (x.T @ (y[:, 1:] - n[:, None] * chance)).T.ravel()
        spread = n[:, None, None] * (np.eye(k) * chance[:, :, None] - chance[:, :, None] * chance[:, None, :])
        curve = np.einsum("ip,iab,iq->apbq", x, spread, x).reshape(k * p, k * p) + 1e-10 * np.eye(k * p)
        step = np.linalg.solve(curve, slope).reshape(k, p).T
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-10:
            break
    return beta, np.linalg.inv(curve)


def _softmax(eta: np.ndarray) -> np.ndarray:
    e = np.exp(np.c_[np.zeros(len(eta)), eta] - np.maximum(0, eta.max(axis=1, initial=0))[:, None])
    return e / e.sum(axis=1, keepdims=True)


def predicted_probabilities(df: DataFrame, outcome: str, factor: str, adjusted: list[str] = (), z: float = 1.959963984540054) -> DataFrame:
    """(model, level, outcome, estimate, low, high): the chance of each outcome at each level of a factor, by multinomial logit.

    ``unadjusted`` has the factor alone; ``adjusted``, if others are given, the mean over all rows as if each had the level. Intervals are by the delta
    method. Rows with a null among these columns are left out. Only the counts of the columns' levels leave the cluster.
    """
    names = [factor, *adjusted]
    cells = df.select(outcome, *names).dropna().groupBy(outcome, *names).agg(F.count(F.lit(1)).alias("n"))
    if cells.count() > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} combinations of levels")
    counts = cells.toPandas().astype({c: str for c in (outcome, *names)})
    told, levels = sorted(counts[outcome].unique()), {c: sorted(counts[c].unique()) for c in names}

    def coded(rows: pd.DataFrame, used: list[str]) -> np.ndarray:
        return np.column_stack([np.ones(len(rows)), *[(rows[c] == v).to_numpy(float) for c in used for v in levels[c][1:]]])

    out = []
    for model, used in [("unadjusted", [factor]), *([("adjusted", names)] if adjusted else [])]:
        table = counts.pivot_table(index=used, columns=outcome, values="n", aggfunc="sum", fill_value=0).reindex(columns=told, fill_value=0)
        patterns, weight = table.index.to_frame(index=False), table.to_numpy(float).sum(axis=1)
        if len(told) < 2:
            out += [(model, v, told[0], 1.0, 1.0, 1.0) for v in levels[factor] if told]
            continue
        beta, cov = _multinomial(coded(patterns, used), table.to_numpy(float))
        for v in levels[factor]:
            x = coded(patterns.assign(**{factor: v}), used)
            chance = _softmax(x @ beta)
            for k, name in enumerate(told):
                slope = chance[:, [k]] * ((np.arange(1, len(told)) == k) - chance[:, 1:])
                jac = np.einsum("i,ia,ip->ap", weight / weight.sum(), slope, x).ravel()
                estimate, se = float(weight @ chance[:, k] / weight.sum()), float(np.sqrt(max(0.0, jac @ cov @ jac)))
                out.append((model, v, name, estimate, estimate - z * se, estimate + z * se))
    return df.sparkSession.createDataFrame(out, "model string, level string, outcome string, estimate double, low double, high double")


def group_table(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    """(variable, level of the comparison or null for all rows, n, mean, sd): group columns and the overall one in one pass."""
    long = df.unpivot([group], values, "variable", "value").select("variable", F.col(group).alias("level"), F.col("value").cast("double").alias("value"))
    stats = [F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")]
    return long.groupingSets([["variable", "level"], ["variable"]], "variable", "level").agg(*stats)


def level_shares(df: DataFrame, group: str, level: str) -> DataFrame:
    """(group, level, n, share of the group); shares are over the aggregated rows."""
    counts = df.groupBy(group, level).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n").cast("double") / F.sum("n").over(W.partitionBy(group)))


def comparison_table(continuous: DataFrame, categorical: DataFrame, groups: tuple) -> DataFrame:
    """(variable, test, statistic, effect, p, q, shown): Welch's t and Cohen's d, chi-square and Cramer's V, and FDR over all."""
    t = welch_t(continuous, groups, p=True).join(cohens_d(continuous, groups), "variable").select("variable", F.lit("welch_t").alias("test"), F.col("t").alias("statistic"), F.col("d").alias("effect"), "p")
    c = chi_square(categorical, p=True).select("variable", F.lit("chi_square").alias("test"), F.col("chi2").alias("statistic"), F.col("cramers_v").alias("effect"), "p")
    return bh(t.unionByName(c), "p", ties=["variable"]).withColumn("shown", show_p(F.col("q")))


def differences_summary(tests: DataFrame, comparisons: list[str]) -> DataFrame:
    """tests (comparison, variable, effect, q) as a column ``ES=..; FDR=..`` per comparison."""
    text = F.format_string("ES=%.2f; FDR=%.3f", "effect", "q")
    return tests.withColumn("shown", text).groupBy("variable").pivot("comparison", comparisons).agg(F.min("shown"))


def heatmap(df: DataFrame, group: str, continuous: list[str], binary: dict[str, str]) -> DataFrame:
    """(variable, level, value, z): group means, or shares of the positive level, and their z over groups."""
    values = [F.avg(c).cast("double").alias(c) for c in continuous] + [F.avg((F.col(c) == v).cast("double")).alias(c) for c, v in binary.items()]
    long = df.groupBy(group).agg(*values).unpivot([group], [*continuous, *binary], "variable", "value").withColumnRenamed(group, "level")
    by = W.partitionBy("variable")  # one row per group
    return long.withColumn("z", F.try_divide(F.col("value") - F.avg("value").over(by), F.stddev_samp("value").over(by)))
