"""Change between two time points, and scores of told against true classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .features import pca
from .match import contingency
from .quality import centroids, distance


def change(before: DataFrame, after: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, later, switched, shift) of ids that all three have; before and after are (id, x).

    Both times are standardised by the mean and population deviation of before; later is the nearest centroid of the labels then (the smaller
    label of equally near ones) and shift the growth of the distance to one's own.
    """
    both = labels.join(before.withColumnRenamed("x", "x0"), "id").join(after.withColumnRenamed("x", "x1"), "id")
    stats = both.select(F.posexplode("x0").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    stats = stats.agg(F.sort_array(F.collect_list(F.struct("k", "m", "s"))).alias("stats"))  # one entry per feature
    scaled = lambda x: F.zip_with(x, "stats", lambda v, p: F.when(p["s"] > 0, (v - p["m"]) / p["s"]).otherwise(F.lit(0.0)))
    z = both.crossJoin(F.broadcast(stats)).select("id", "label", scaled("x0").alias("x"), scaled("x1").alias("y"))  # one row
    centres = centroids(z)
    to = z.crossJoin(F.broadcast(centres.withColumnRenamed("label", "cluster")))  # one row per cluster
    near = F.min(F.struct(F.round(distance("y", "centre"), 12).alias("d"), "cluster"))
    own = F.max(F.when(F.col("cluster") == F.col("label"), distance("y", "centre") - distance("x", "centre")))
    out = to.groupBy("id", "label").agg(near.alias("near"), own.alias("shift"))
    return out.select("id", "label", F.col("near.cluster").alias("later"), (F.col("label") != F.col("near.cluster")).alias("switched"), "shift")


def transitions(changes: DataFrame) -> DataFrame:
    """(label, later, n, share of the label), with pairs that don't occur."""
    cells = contingency(changes.select("label", "later"), "label", "later")
    every = changes.select("label").union(changes.select("later")).distinct()
    grid = every.crossJoin(every.withColumnRenamed("label", "later"))  # labels, not ids
    cells = grid.join(cells, ["label", "later"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return cells.withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), F.sum("n").over(W.partitionBy("label"))), F.lit(0.0)))


def feature_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """(feature, n, mean and sd of the change) over (id, feature, value)."""
    both = before.join(after.withColumnRenamed("value", "later"), ["id", "feature"])
    return both.groupBy("feature").agg(F.count_distinct("id").alias("n"), F.avg(F.col("later") - F.col("value")).alias("mean"), F.stddev_samp(F.col("later") - F.col("value")).alias("sd"))


def pca_change(before: DataFrame, after: DataFrame, k: int = 2) -> DataFrame:
    """(id, before, after, moved): scores of both times on the principal components of before, and how far each id moved; for ids that both have."""
    both = before.join(after.withColumnRenamed("x", "y"), "id")
    stats = both.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).agg(F.sort_array(F.collect_list(F.struct("k", "m"))).alias("means"))  # one entry per feature
    _, _, loadings = pca(both.select("id", "x"), k)
    axes = F.array(*[F.array(*[F.lit(float(v)) for v in loadings[:, c]]) for c in range(loadings.shape[1])])
    dot = lambda x, axis: F.aggregate(F.zip_with(F.zip_with(x, "means", lambda v, m: v - m["m"]), axis, lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v)
    own = both.crossJoin(F.broadcast(stats)).withColumn("axes", axes)  # one row
    scores = lambda c: F.transform("axes", lambda axis: dot(F.col(c), axis))
    scored = own.select("id", scores("x").alias("before"), scores("y").alias("after"))
    return scored.withColumn("moved", distance("before", "after"))


def composition(labels: DataFrame) -> DataFrame:
    """(label, n, share), -1 meaning no label."""
    counts = labels.filter("label <> -1").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("whole"))
    return counts.crossJoin(F.broadcast(whole)).select("label", "n", (F.col("n").cast("double") / F.col("whole")).alias("share"))  # one row


def uncertainty(df: DataFrame, p: str) -> DataFrame:
    """df with confidence, entropy and margin of an array of class probabilities."""
    order = F.sort_array(p, asc=False)
    entropy = -F.aggregate(F.transform(p, lambda x: F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return df.withColumns({"confidence": F.array_max(p), "entropy": entropy, "margin": order[0] - F.coalesce(F.get(order, F.lit(1)), F.lit(0.0))})


def class_metrics(rows: DataFrame) -> DataFrame:
    """One row of accuracy, balanced accuracy, macro precision and recall of (truth, told)."""
    cells = rows.groupBy("truth", "told").agg(F.count(F.lit(1)).cast("double").alias("n"))
    true = cells.groupBy(F.col("truth").alias("k")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("truth") == F.col("told"), F.col("n")).otherwise(F.lit(0.0))).alias("tp"))
    told = cells.groupBy(F.col("told").alias("k")).agg(F.sum("n").alias("p"))
    each = true.join(told, "k", "left")
    return each.agg((F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg(F.col("tp") / F.col("t")).alias("balanced_accuracy"), F.avg(F.coalesce(F.try_divide("tp", "p"), F.lit(0.0))).alias("precision"), F.avg(F.col("tp") / F.col("t")).alias("recall"))


def auc(rows: DataFrame) -> DataFrame:
    """One row: area under the ROC curve of (truth 0 or 1, score), by ranks over distinct scores; ties count half."""
    counts = rows.groupBy("score").agg(F.sum("truth").cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    below = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(W.orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    wins = counts.withColumn("wins", F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2.0))
    return wins.agg(F.try_divide(F.sum("wins"), F.sum("pos") * (F.sum("n") - F.sum("pos"))).alias("auc"))


def curve(rows: DataFrame) -> DataFrame:
    """(score, tpr, fpr, precision) of calling what reaches each distinct score positive."""
    counts = rows.groupBy("score").agg(F.sum("truth").cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    w = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    sums = counts.agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    upto = counts.withColumns({"tp": F.sum("pos").over(w), "told": F.sum("n").over(w)}).crossJoin(F.broadcast(sums))  # one row
    return upto.select("score", F.try_divide("tp", "all_pos").alias("tpr"), F.try_divide(F.col("told") - F.col("tp"), F.col("all_n") - F.col("all_pos")).alias("fpr"), F.try_divide("tp", "told").alias("precision"))
