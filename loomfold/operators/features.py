"""Feature preparation as pairs of fit and replay: what is fitted is a small table, so a new cohort gets the same treatment.

Long form throughout: (id, feature, value), value null where missing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import quantiles
from ..sources.store import stored


def adjusted_skew(x: str) -> Column:
    """Sample skewness with the small-sample correction (the built-in function is without it)."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def yeo_johnson(x: Column, l: Column) -> Column:
    """The transform for a lambda; limits at 0 and 2 where the formula has a gap."""
    up = F.when(F.abs(l) < 1e-9, F.log1p(x)).otherwise((F.pow(x + 1.0, l) - 1.0) / l)
    down = F.when(F.abs(l - 2.0) < 1e-9, -F.log1p(-x)).otherwise(-(F.pow(1.0 - x, 2.0 - l) - 1.0) / (2.0 - l))
    return F.when(x >= 0, up).otherwise(down)


def power_likelihood(long: DataFrame, lambdas: list[float]) -> DataFrame:
    """(feature, lambda, ll): profile log-likelihood on a grid; rows are expanded in place and summed on the map side."""
    grid = F.explode(F.array(*[F.lit(float(v)) for v in lambdas]))
    rows = long.filter("value is not null").withColumn("lambda", grid)
    y = yeo_johnson(F.col("value"), F.col("lambda"))
    sign = F.signum("value") * F.log1p(F.abs("value"))
    stats = rows.groupBy("feature", "lambda").agg(F.count(F.lit(1)).cast("double").alias("n"), F.var_pop(y).alias("var"), F.sum(sign).alias("jacobian"))
    return stats.select("feature", "lambda", (-F.col("n") / 2.0 * F.log("var") + (F.col("lambda") - 1.0) * F.col("jacobian")).alias("ll"))


def fit_power(long: DataFrame, threshold: float = 0.75, step: float = 0.05, low: float = -3.0, high: float = 5.0, rounds: int = 2) -> DataFrame:
    """(feature, lambda) of features whose adjusted skewness exceeds the threshold: a grid, then finer ones around its best."""
    skewed = long.filter("value is not null").groupBy("feature").agg(adjusted_skew("value").alias("skew")).filter(F.abs("skew") > threshold)
    rows = stored(long.join(skewed.select("feature"), "feature", "left_semi"))
    best = power_likelihood(rows, [low + step * k for k in range(round((high - low) / step) + 1)]).groupBy("feature").agg(F.max_by("lambda", F.struct("ll", F.col("lambda"))).alias("lambda"))
    for _ in range(rounds):
        best = stored(best)
        near = [step * (k - 10) / 10 for k in range(21)]
        step /= 10
        finer = rows.join(best, "feature").withColumn("step", F.explode(F.array(*[F.lit(v) for v in near]))).withColumn("lambda", F.col("lambda") + F.col("step"))
        y, sign = yeo_johnson(F.col("value"), F.col("lambda")), F.signum("value") * F.log1p(F.abs("value"))
        ll = -F.count(F.lit(1)) / 2.0 * F.log(F.var_pop(y)) + (F.first("lambda") - 1.0) * F.sum(sign)
        best = finer.groupBy("feature", "lambda").agg(ll.alias("ll")).groupBy("feature").agg(F.max_by("lambda", F.struct("ll", F.col("lambda"))).alias("lambda"))
    return best


def apply_power(long: DataFrame, params: DataFrame) -> DataFrame:
    joined = long.join(F.broadcast(params), "feature", "left")  # one row per feature
    return joined.withColumn("value", F.when(F.col("lambda").isNull(), F.col("value")).otherwise(yeo_johnson(F.col("value"), F.col("lambda")))).drop("lambda")


def fit_scale(long: DataFrame, kind: str = "standard") -> DataFrame:
    """(feature, centre, scale): standard (population deviation), minmax or robust (median, quartile range); scale 0 becomes 1."""
    if kind == "robust":
        fitted = quantiles(long, ["feature"], "value", {"centre": 0.5, "low": 0.25, "high": 0.75}).select("feature", "centre", (F.col("high") - F.col("low")).alias("scale"))
        fitted = long.select("feature").distinct().join(fitted, "feature", "left")
    else:
        centre, scale = {"standard": (F.avg("value"), F.stddev_pop("value")), "minmax": (F.min("value"), F.max("value") - F.min("value"))}[kind]
        fitted = long.groupBy("feature").agg(centre.cast("double").alias("centre"), scale.cast("double").alias("scale"))
    return fitted.withColumn("scale", F.when(F.col("scale") == 0, F.lit(1.0)).otherwise(F.col("scale")))


def apply_scale(long: DataFrame, params: DataFrame) -> DataFrame:
    """Replays a scale; 0 where it is next to nothing. Features that were not fitted stay."""
    joined = long.join(F.broadcast(params), "feature", "left")  # one row per feature
    scaled = F.when(F.col("centre").isNull() | F.col("value").isNull(), F.col("value")).when(F.abs("scale") < 1e-12, F.lit(0.0)).otherwise((F.col("value") - F.col("centre")) / F.col("scale"))
    return joined.withColumn("value", scaled).drop("centre", "scale")


#: Rows with gaps and donors that meet in a task at once.
QUERIES_AT_ONCE, DONORS_AT_ONCE = 512, 4096


def _offers(names: list[str], k: int):
    """Of a block of rows with gaps and one of donors (x, null where missing): for each gap the k nearest donors that have the feature, of equally near ones the smaller ids."""

    def matrix(t: pa.Table) -> np.ndarray:
        flat = t.column("x").combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), len(names))

    def run(table: pa.Table) -> pa.Table:
        donors = table.filter(pc.field("gives")).sort_by("id")
        asking = table.filter(~pc.field("gives"))
        out, x, y = [], matrix(asking), matrix(donors)
        total, common = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)))
        for c in range(len(names)):
            square = (x[:, c, None] - y[:, c]) ** 2
            both = ~np.isnan(square)
            total += np.where(both, square, 0.0)
            common += both
        far = np.where(common > 0, np.floor(np.sqrt(len(names) / np.maximum(common, 1) * total) * 1e9 + 0.5) / 1e9, np.inf)
        for c, name in enumerate(names):
            rows, columns = np.flatnonzero(np.isnan(x[:, c])), np.flatnonzero(~np.isnan(y[:, c]))
            if not len(rows) or not len(columns):
                continue
            d = far[np.ix_(rows, columns)]
            last = np.partition(d, min(k, len(columns)) - 1, axis=1)[:, [min(k, len(columns)) - 1]]
            nearer, even = d < last, d == last
            taken = (nearer | (even & (even.cumsum(axis=1) <= k - nearer.sum(axis=1, keepdims=True)))) & np.isfinite(d)
            i, j = np.nonzero(taken)
            out.append(pa.table({"row": asking.column("id").take(rows[i]), "feature": pa.array([name] * len(i), pa.string()), "distance": d[i, j], "donor": donors.column("id").take(columns[j]), "other": y[columns[j], c]}))
        kind = table.schema.field("id").type
        empty = pa.schema([("row", kind), ("feature", pa.string()), ("distance", pa.float64()), ("donor", kind), ("other", pa.float64())])
        return pa.concat_tables(out).cast(empty) if out else empty.empty_table()

    return run


def knn_impute(long: DataFrame, k: int = 7, reference: DataFrame | None = None) -> DataFrame:
    """long with missing values as the mean of the k nearest rows that have the feature; donors come from reference, if given.

    Distance: squares over features that both have, scaled up to all features. Equally near donors go by id. Rows
    without any value stay missing; without a donor the feature's mean is taken. Rows of equal values and gaps are one question, of donors of equal values
    only the k smallest ids can be chosen; these meet a pair of blocks a task, which emits k donors for each gap. Of a feature that an id has twice the smaller value is compared.
    """
    names = sorted(r["feature"] for r in long.select("feature").filter("feature is not null").distinct().collect())  # a study's columns
    once = lambda df: df.groupBy("id", "feature").agg(F.min("value").alias("value"))
    rows = lambda df: once(df).groupBy("id").agg(F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("feature", F.col("value").cast("double").alias("value"))))).alias("m"))
    wide = lambda df: rows(df).select("id", F.array(*[F.try_element_at("m", F.lit(n)) for n in names]).alias("x"))
    own = stored(wide(long)) if names else None
    means = (reference if reference is not None else long).groupBy("feature").agg(F.avg("value").alias("mean"))
    alive = long.groupBy("id").agg(F.count("value").alias("has"))
    joined = long.join(F.broadcast(means), "feature", "left").join(alive, "id")  # one row per feature
    if names:
        asking = own.filter(F.exists("x", lambda v: v.isNull()) & F.exists("x", lambda v: v.isNotNull()))
        asked = stored(asking.groupBy("x").agg(F.min("id").alias("id")))
        giving = (wide(reference) if reference is not None else own).filter(F.exists("x", lambda v: v.isNotNull()))
        giving = stored(giving.withColumn("r", F.row_number().over(W.partitionBy("x").orderBy("id"))).filter(F.col("r") <= k).drop("r"))
        blocks = max(1, -(-asked.count() // QUERIES_AT_ONCE)), max(1, -(-giving.count() // DONORS_AT_ONCE))
        block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        both = asked.select("id", "x", F.lit(False).alias("gives"), block(blocks[0]).alias("p"), every(blocks[1]).alias("q"))
        both = both.unionByName(giving.select("id", "x", F.lit(True).alias("gives"), every(blocks[0]).alias("p"), block(blocks[1]).alias("q")))
        kind = long.schema["id"].dataType.simpleString()
        met = both.repartition(min(2000, blocks[0] * blocks[1]), "p", "q").groupBy("p", "q").applyInArrow(_offers(names, k), f"row {kind}, feature string, distance double, donor {kind}, other double")
        rank = F.row_number().over(W.partitionBy("row", "feature").orderBy("distance", "donor"))
        filled = met.withColumn("r", rank).filter(F.col("r") <= k).groupBy("row", "feature").agg(F.avg("other").alias("filled"))
        same = asking.join(asked.select("x", F.col("id").alias("row")), "x").select("id", "row")
        filled = same.join(filled, "row").select("id", "feature", "filled")
        joined = joined.join(filled, ["id", "feature"], "left")
    else:
        joined = joined.withColumn("filled", F.lit(None).cast("double"))
    return joined.select("id", "feature", F.when(F.col("value").isNotNull(), F.col("value")).when(F.col("has") > 0, F.coalesce("filled", "mean")).alias("value"))


#: Levels of a text column that become columns, at most.
MOST_LEVELS = 1000


def fit_ordinal(long: DataFrame, specs: DataFrame) -> DataFrame:
    """(feature, level, code) from the first label set (set_id, level, code) that has all levels observed in a text feature."""
    seen = long.filter("value is not null").select("feature", F.col("value").alias("level")).distinct()
    n_seen = seen.groupBy("feature").agg(F.count(F.lit(1)).alias("n_seen"))
    covered = seen.join(specs.select("set_id", "level").distinct(), "level").groupBy("feature", "set_id").agg(F.count(F.lit(1)).alias("n"))
    chosen = covered.join(n_seen, "feature").filter("n = n_seen").groupBy("feature").agg(F.min("set_id").alias("set_id"))
    codes = specs.groupBy("set_id", "level").agg(F.max("code").alias("code"))
    return chosen.join(codes, "set_id").select("feature", "level", "code")


def dummy_code(df: DataFrame, id_col: str, specs: DataFrame, frozen: dict | None = None) -> tuple[DataFrame, dict]:
    """(df with numbers only, what was fitted): dates as nanoseconds, logicals as 0 and 1, text by the first label set of specs that has all its
    levels (set_id, level, code), other text as indicators of all levels but the first and of null.

    specs is a parameter: a table of label sets, in order of set_id. With frozen the same columns result for other rows; unknown levels
    have no indicator and no code. Text of more than MOST_LEVELS levels and no label set is no category and raises an error.
    """
    kinds = {f.name: f.dataType for f in df.schema if f.name != id_col}
    text = [c for c, k in kinds.items() if isinstance(k, T.StringType)]
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    if frozen is None:
        frozen = {"codes": {}, "levels": {}}
        if text:
            each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), named(c).alias("value")) for c in text])).alias("r")
            long = df.select(each).select("r.*").filter("value is not null").distinct()
            for r in fit_ordinal(long, specs).collect():  # rows of a label set for each coded column
                frozen["codes"].setdefault(r["feature"], {})[r["level"]] = float(r["code"])
            rest = [c for c in text if c not in frozen["codes"]]
            for c in rest:
                frozen["levels"][c] = []
            levels = long.filter(F.col("feature").isin(rest))
            wide = sorted(r["feature"] for r in levels.groupBy("feature").count().filter(F.col("count") > MOST_LEVELS).collect())
            if wide:
                raise ValueError(f"more than {MOST_LEVELS} levels: {', '.join(wide)}")
            for r in levels.orderBy("feature", "value").collect():  # at most MOST_LEVELS rows a column
                frozen["levels"][r["feature"]].append(r["value"])

    def number(c: str) -> list[Column]:
        if c in frozen["codes"]:
            pairs = [F.lit(x) for pair in frozen["codes"][c].items() for x in pair]
            return [F.element_at(F.create_map(*pairs), named(c).cast("string")).alias(c)]
        if c in frozen["levels"]:
            hot = [F.coalesce((named(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in frozen["levels"][c][1:]]
            return [*hot, named(c).isNull().cast("int").alias(f"{c}_nan")]
        if isinstance(kinds[c], (T.DateType, T.TimestampType)):
            return [(F.unix_micros(named(c).cast("timestamp")) * F.lit(1000)).alias(c)]
        return [named(c).cast("int").alias(c) if isinstance(kinds[c], T.BooleanType) else named(c)]

    return df.select(id_col, *[n for c in kinds for n in number(c)]), frozen


def one_hot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Indicator columns of all levels but the first, and one for null; levels are a frozen, sorted list."""
    hot = {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in levels[1:]}
    return df.withColumns(hot | {f"{column}_nan": F.col(column).isNull().cast("int")}).drop(column)


def dense_codes(df: DataFrame, column: str) -> DataFrame:
    """(column, code): distinct values numbered from 0 in their order."""
    kinds = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return kinds.withColumn("code", F.dense_rank().over(W.orderBy(column)) - 1)  # distinct values only


def z_against(df: DataFrame, value: str, group: str, control: str) -> DataFrame:
    """df with ``z``: the value against mean and sample deviation of the control group."""
    inside = F.when(F.col(group) == control, F.col(value))
    stats = df.agg(F.avg(inside).alias("_mean"), F.stddev_samp(inside).alias("_sd"))
    return df.crossJoin(F.broadcast(stats)).withColumn("z", F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd"))).drop("_mean", "_sd")  # one row


def z_within(df: DataFrame, value: str, group: str) -> DataFrame:
    """df with ``z``: the value against mean and sample deviation of its group; moments are joined, a large group is not sorted in one task."""
    stats = df.groupBy(group).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    return df.join(stats, group, "left").withColumn("z", F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd"))).drop("_mean", "_sd")


def correlations(left: DataFrame, right: DataFrame) -> DataFrame:
    """(f, g, r) of every feature of left with every feature of right over common ids."""
    both = left.select("id", F.col("feature").alias("f"), F.col("value").alias("x")).join(right.select("id", F.col("feature").alias("g"), F.col("value").alias("y")), "id")
    return both.groupBy("f", "g").agg(F.corr("x", "y").alias("r"))


def variance_share(long: DataFrame) -> DataFrame:
    """(feature, mean, share of the summed variance)."""
    stats = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    return stats.crossJoin(F.broadcast(stats.agg(F.sum("var").alias("whole")))).select("feature", "mean", F.try_divide("var", "whole").alias("share"))  # one row


def pca(points: DataFrame, k: int):
    """MLlib PCA on centred vectors: (points with ``scores``, explained variance, loadings as rows)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    own = points.withColumn("_v", array_to_vector("x"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(own).transform(own)
    model = PCA(k=k, inputCol="_c", outputCol="_s").fit(centred)
    return model.transform(centred).withColumn("scores", vector_to_array("_s")).drop("_v", "_c", "_s"), model.explainedVariance.toArray(), model.pc.toArray()


def as_matrix(df: DataFrame, id_col: str, columns: list[str] | None = None) -> DataFrame:
    """(id, x): the columns, in order, as one array of doubles."""
    columns = columns or [c for c in df.columns if c != id_col]
    return df.select(F.col(id_col).alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))


def concat_views(views: list[DataFrame]) -> DataFrame:
    """(id, x): arrays of several views (id, x) one after another, for ids that all have."""
    out = views[0]
    for k, v in enumerate(views[1:]):
        out = out.join(v.select("id", F.col("x").alias(f"x{k}")), "id").select("id", F.concat("x", f"x{k}").alias("x"))
    return out


def pca_by_view(views: dict[str, DataFrame], most: int = 50) -> dict[str, tuple]:
    """pca of each view (id, x), of at most so many components and no more than the view has features."""
    return {name: pca(df, min(most, df.select(F.max(F.size("x"))).first()[0])) for name, df in views.items()}
