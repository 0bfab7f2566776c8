"""Clustering in groups: every candidate, resample and view is a task; labels come back as rows.

A kernel runs on a group of some thousand subjects, never on a whole table: parallelism is over groups.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, repeats
from ..sources.store import stored


#: What a kernel raises on points that it can't cluster. Anything else is a fault, and ends the query.
DEGENERATE = (ValueError, ArithmeticError)


class Clusterer(Protocol):
    """Anything that labels the rows of a matrix."""

    def execute(self, x: np.ndarray) -> np.ndarray: ...


class Fusion(Protocol):
    """Anything that makes distances of the labels of several views."""

    def execute(self, labels: list[np.ndarray]) -> np.ndarray: ...


@dataclass
class Kernel:
    """A clusterer by name, with its parameters."""

    name: str
    k: int = 2
    linkage: str = "average"
    height: float | None = None
    precomputed: bool = False
    seed: int = 0
    least: int = 0
    quantile: float = 0.3
    rounds: int = 100

    def execute(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        k = min(self.k, len(x))
        if self.name == "null":
            return np.zeros(len(x), int)
        if self.name == "hierarchical":
            method = "average" if self.precomputed and self.linkage == "ward" else self.linkage
            if not self.precomputed:
                return repeats.hierarchical(x, k, method, self.height)
            return kernels.cut(kernels.linkage(x, method), len(x), None if self.height is not None else k, self.height)
        if self.name == "spectral":
            return kernels.spectral(x, self.k, self.seed) if self.precomputed else repeats.knn_spectral(x, self.k, self.seed)
        if self.name == "gmm":
            return kernels.gaussian_mixture(x, k, self.seed)
        if self.name == "kmeans":
            return kernels.kmeans(x, k, self.seed)
        if self.name == "meanshift":
            return repeats.mean_shift(x, self.quantile, self.rounds)
        if self.name == "ensemble":
            run = kernels.ensemble_of_distances if self.precomputed else repeats.ensemble
            return run(x, k, self.linkage, self.seed, self.least)
        raise ValueError(f"no clusterer {self.name}")


@dataclass
class LabelFusion:
    name: str = "agreement"

    def execute(self, labels: list[np.ndarray]) -> np.ndarray:
        return kernels.fused(labels, self.name)


@dataclass
class View:
    """A matrix with its clusterer. One that fails or is empty labels all rows 0 and says so."""

    data: np.ndarray
    clusterer: Clusterer
    status: str = "ok"

    def execute(self) -> np.ndarray:
        try:
            return self.clusterer.execute(self.data)
        except Exception as error:  # a degenerate view must not stop the others
            self.status = f"failed: {error}"
            return np.zeros(len(self.data), int)


@dataclass
class Ensemble:
    views: list[View]
    fusion: Fusion = field(default_factory=LabelFusion)

    def execute(self) -> tuple[list[np.ndarray], np.ndarray]:
        labels = [v.execute() for v in self.views]
        return labels, self.fusion.execute(labels)


def cluster_groups(points: DataFrame, keys: list[str], clusterer: Clusterer) -> DataFrame:
    """(keys, id, label, status) of points (keys, id, x), each group clustered in a task of its own."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id")
        view = View(np.array(own["x"].tolist(), float), clusterer)
        label = view.execute()
        return own[[*keys, "id"]].assign(label=label.astype("int64"), status=view.status)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema if f.name in (*keys, "id"))
    return points.groupBy(*keys).applyInPandas(run, f"{schema}, label long, status string")


def succeeded(found: DataFrame) -> DataFrame:
    """(id, label) of what cluster_groups found, stored; a group that failed has no labels, and raises."""
    told = stored(found)
    if bad := told.filter("status <> 'ok'").select("status").first():
        raise RuntimeError(f"not clustered: {bad['status']}")
    return told.select("id", "label")


def clamp(k: int, n: int, least: int) -> int:
    """No more clusters than rows allow at the least size."""
    return max(1, min(k, n // max(1, least)))


def fuse_views(labels: list[np.ndarray], k_final: int, pre_linkage: str = "average", fusion: str = "agreement", least: int = 0, seed: int = 0) -> tuple[np.ndarray, float]:
    """The final labels of fused views, and their score in the space of the fused distances."""
    return repeats.fused_ensemble(labels, fusion, clamp(k_final, len(labels[0]), least), pre_linkage, seed, least)


def multi_view(views: dict[str, np.ndarray], ks: dict[str, int], k_final: int, linkages: dict[str, str], pre_linkage: str = "average", fusion: str = "agreement", least: int = 0, seed: int = 0) -> dict:
    """One candidate on one resample: cluster each view, fuse, cluster the fused distances, and score."""
    n = len(next(iter(views.values())))
    parts = {v: View(x, Kernel("ensemble", clamp(ks[v], n, least), linkages[v], seed=seed, least=least)) for v, x in views.items()}
    labels = [p.execute() for p in parts.values()]
    final, score = fuse_views(labels, k_final, pre_linkage, fusion, least, seed)
    return {
        "labels": dict(zip(parts, labels, strict=True)),
        "final": final,
        "view_scores": {v: repeats.quality(p.data, m) for (v, p), m in zip(parts.items(), labels, strict=True)},
        "score": score,
        "status": {v: p.status for v, p in parts.items()},
    }


def _member_labels(points, population: DataFrame, boots: DataFrame, views: list[str], least: int) -> tuple[DataFrame, DataFrame]:
    """The settings (view, k, linkage), and (boot, view, k, member, labels) of the clusterers that their ensembles are made of, each on each resample a task's; one that fails has null labels.

    Mean shift knows no number of clusters and a linkage is cut at all of them, so these run once for a view.
    """
    settings = None
    for v in views:
        own = population.select(F.lit(v).alias("view"), F.col(f"k_{v}").cast("long").alias("k"), F.col(f"linkage_{v}").alias("linkage"))
        settings = own if settings is None else settings.unionByName(own)
    settings = settings.distinct()
    each = settings.select("view", "k").distinct().select("view", F.array("k").alias("ks"), F.explode(F.array(*[F.lit(m) for m in repeats.TOLD])).alias("member"))
    shift = settings.groupBy("view").agg(F.sort_array(F.collect_set("k")).alias("ks")).withColumn("member", F.lit("meanshift"))
    linked = settings.groupBy("view", F.col("linkage").alias("member")).agg(F.sort_array(F.collect_set("k")).alias("ks"))
    grid = boots.crossJoin(each.unionByName(shift).unionByName(linked))  # resamples by clusterers is the work to be done

    def run(batches):
        for own in batches:
            out = []
            for r in own.to_dict("records"):
                ids = _ids(points.value, r["ids"], views)
                x, ks = np.array([points.value[r["view"], i] for i in ids], float), [int(k) for k in r["ks"]]
                try:
                    found = repeats.member(x, r["member"], [clamp(k, len(ids), least) for k in ks])
                except DEGENERATE:  # a degenerate view must not stop the others
                    found = [None] * len(ks)
                out += [{"boot": r["boot"], "view": r["view"], "k": k, "member": r["member"], "labels": None if m is None else m.tolist()} for k, m in zip(ks, found, strict=True)]
            if out:
                yield pd.DataFrame(out)

    # Dealt in turn, not by key: a dozen keys would leave cores idle.
    done = grid.repartition(8 * max(1, boots.sparkSession.sparkContext.defaultParallelism)).mapInPandas(run, "boot long, view string, k long, member string, labels array<long>")
    return settings, done


def _by_view(points, population: DataFrame, boots: DataFrame, views: list[str], least: int) -> DataFrame:
    """(boot, view, k, linkage, labels, score) of every distinct setting of a view on every resample, whatever candidates share it; labels and score are null where a member has failed."""
    settings, done = _member_labels(points, population, boots, views, least)
    done = stored(done)
    same = done.filter(F.col("member").isin(*repeats.TOLD, "meanshift")).groupBy("boot", "view", "k").agg(F.map_from_entries(F.collect_list(F.struct("member", "labels"))).alias("members"))  # one entry per member
    fifth = done.select("boot", "view", "k", F.col("member").alias("linkage"), F.col("labels").alias("linked"))
    grid = settings.join(fifth, ["view", "k", "linkage"]).join(same, ["boot", "view", "k"]).join(boots, "boot")

    def run(batches):
        for own in batches:
            out = []
            for r in own.to_dict("records"):
                ids, members = _ids(points.value, r["ids"], views), dict(r["members"])
                x, k = np.array([points.value[r["view"], i] for i in ids], float), clamp(r["k"], len(ids), least)
                found = [members[m] for m in (*repeats.TOLD, "meanshift")] + [r["linked"]]
                label = None if any(m is None for m in found) else repeats.cut_members(x, np.column_stack(found), k, r["linkage"], least)
                score = None if label is None else repeats.quality(x, label) if len(ids) else 0.0
                out.append({"boot": r["boot"], "view": r["view"], "k": r["k"], "linkage": r["linkage"], "labels": None if label is None else label.tolist(), "score": score})
            if out:
                yield pd.DataFrame(out)

    return grid.repartition(4 * max(1, boots.sparkSession.sparkContext.defaultParallelism)).mapInPandas(run, "boot long, view string, k long, linkage string, labels array<long>, score double")


def _ids(data: dict, ids, views: list[str]) -> list:
    return [i for i in ids if all((v, i) in data for v in views)]


#: Rows of a study's points (subjects by views) at most; they go to every task.
MOST_POINTS = 1_000_000


def evaluate_population(points: DataFrame, population: DataFrame, boots: DataFrame, views: list[str], least: int = 0) -> DataFrame:
    """Every candidate on every resample: (ind, boot, view, id, label, score), the fused result as view ``final``.

    points (id, view, x) is small and goes to every task; population has ind, k_<view>, linkage_<view>, k_final, pre_linkage
    and fusion; boots (boot, id) names the subjects of each resample. A view is clustered once for each of its settings, and candidates
    that share one fuse the same labels. A candidate that fails on a resample, or one of whose views does, yields one row of view
    ``failed``, without id, label and score; completed() tells which to keep.
    """
    if points.count() > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} points are no study's")
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast({(r["view"], r["id"]): r["x"] for r in points.collect()})
    samples = stored(boots.groupBy("boot").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("boot", F.col("boot").cast("long")))
    people = stored(population)
    done = stored(_by_view(shared, people, samples, views, least))
    wanted = people.select("ind", F.explode(F.array(*[F.struct(F.lit(k).alias("at"), F.lit(v).alias("view"), F.col(f"k_{v}").cast("long").alias("k"), F.col(f"linkage_{v}").alias("linkage")) for k, v in enumerate(views)])).alias("w")).select("ind", "w.*")
    each = wanted.join(done, ["view", "k", "linkage"]).groupBy("ind", "boot").agg(F.sort_array(F.collect_list(F.struct("at", "labels", "score"))).alias("parts"))  # one entry per view
    grid = each.join(people.select("ind", "k_final", "pre_linkage", "fusion"), "ind").join(samples, "boot")

    def run(batches):
        for own in batches:
            out = []
            for r in own.to_dict("records"):
                ids = _ids(shared.value, r["ids"], views)
                try:
                    if any(p["labels"] is None for p in r["parts"]):
                        raise ValueError("a view has failed")
                    labels = [np.asarray(p["labels"], int) for p in r["parts"]]
                    final, score = fuse_views(labels, r["k_final"], r["pre_linkage"], r["fusion"], least)
                except DEGENERATE:
                    out.append(pd.DataFrame({"ind": [r["ind"]], "boot": [r["boot"]], "view": ["failed"], "id": pd.array([None], "Int64"), "label": pd.array([None], "Int64"), "score": [float("nan")]}))
                    continue
                for v, found, s in [*((v, m, p["score"]) for v, m, p in zip(views, labels, r["parts"], strict=True)), ("final", final, score)]:
                    out.append(pd.DataFrame({"ind": r["ind"], "boot": r["boot"], "view": v, "id": ids, "label": found.astype("int64"), "score": s}))
            if out:
                yield pd.concat(out)

    return grid.repartition(4 * max(1, spark.sparkContext.defaultParallelism)).mapInPandas(run, "ind long, boot long, view string, id long, label long, score double")


def completed(labels: DataFrame, most_failed: float = 0.1) -> DataFrame:
    """The label rows of candidates of which at most a share of resamples failed, without the rows that tell of failures."""
    runs = labels.groupBy("ind", "boot").agg(F.max((F.col("view") == "failed").cast("int")).alias("failed")).groupBy("ind").agg(F.avg("failed").alias("share"))
    return labels.filter("view <> 'failed'").join(runs.filter(F.col("share") <= most_failed).select("ind"), "ind", "left_semi")


def consensus_clusters(consensus: DataFrame, ids: DataFrame, k: int, linkage: str = "average") -> DataFrame:
    """(id, label): linkage of 1 - consensus over all ids, cut at k; pairs never seen together count as 0."""
    rows = ids.select(F.col("id").alias("i"), F.lit(None).cast("long").alias("j"), F.lit(0.0).alias("m")).unionByName(consensus.select("i", "j", "m"))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(own.loc[own["j"].isna(), "i"].unique())
        at = {v: k_ for k_, v in enumerate(names)}
        m = np.eye(len(names))
        pairs = own[own["j"].notna()]
        i, j = pairs["i"].map(at).to_numpy(), pairs["j"].astype("int64").map(at).to_numpy()
        m[i, j] = m[j, i] = pairs["m"].to_numpy()
        label = Kernel("hierarchical", k, linkage, precomputed=True).execute(1 - m)
        return pd.DataFrame({"id": names, "label": label.astype("int64")})

    return rows.groupBy(F.lit(0).alias("_all")).applyInPandas(run, "id long, label long")  # one dense matrix, by definition


def consensus_clusters_of(own: DataFrame, told: DataFrame, k: int, linkage: str = "average") -> DataFrame:
    """consensus_clusters of the consensus of kinds (stability.consensus_kinds), stored: a task has a matrix of kinds with their sizes, and no pair of ids. Fewer kinds than k are parted, and centroid linkage goes on, a row each: then it has the ids."""
    sizes = stored(own.groupBy("kind").agg(F.count(F.lit(1)).alias("size")))
    whole = linkage != "centroid" and sizes.count() >= k
    rows = sizes if whole else own.select("kind", "id")
    sides = rows.withColumns({"b": F.lit(None).cast("long"), "m": F.lit(None).cast("double")}).unionByName(told.select(F.col("a").alias("kind"), "b", "m"), allowMissingColumns=True)

    def run(both: pd.DataFrame) -> pd.DataFrame:
        pairs, own = both[both["b"].notna()], both[both["b"].isna()].sort_values("kind" if whole else "id")
        names, kind = np.unique(own["kind"].to_numpy(), return_inverse=True)
        if whole:
            kind = np.repeat(kind, own["size"].astype(int))
        d = np.ones((len(names), len(names)))
        d[np.searchsorted(names, pairs["kind"]), np.searchsorted(names, pairs["b"].astype("int64"))] = 1 - pairs["m"].to_numpy()
        label = repeats.cut_kinds(d, kind, k, "average" if linkage == "ward" else linkage)
        if whole:
            return pd.DataFrame({"id": names, "label": label[np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])].astype("int64")})
        return pd.DataFrame({"id": own["id"].astype("int64"), "label": label.astype("int64")})

    cut = sides.filter("b is null or m is not null").groupBy(F.lit(0).alias("_all")).applyInPandas(run, "id long, label long")  # kinds only
    if not whole:
        return stored(cut)
    return stored(own.select("id", "kind").join(cut.withColumnRenamed("id", "kind"), "kind").select("id", "label"))


def cophenetic_correlation(consensus: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, ccc): correlation of 1 - consensus with the heights of its average linkage; a dense matrix of a study's subjects for each key."""
    keys = keys or []

    def run(own: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(own[["i", "j"]].to_numpy())
        m = np.eye(len(names))
        i, j = np.searchsorted(names, own["i"]), np.searchsorted(names, own["j"])
        m[i, j] = m[j, i] = own["m"]
        upper = np.triu_indices(len(names), 1)
        c = kernels.cophenetic(kernels.linkage(1 - m), len(names))[upper]
        d = (1 - m)[upper]
        return own[keys].head(1).assign(ccc=[float(np.corrcoef(c, d)[0, 1]) if c.std() > 0 and d.std() > 0 else 0.0])

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in consensus.select(*keys).schema)
    return consensus.groupBy(*(keys or [F.lit(0).alias("_all")])).applyInPandas(run, f"{schema}ccc double")


def cophenetic_of(own: DataFrame, told: DataFrame, keys: list[str]) -> DataFrame:
    """cophenetic_correlation of the consensus of kinds (stability.consensus_kinds): a task has a matrix of kinds with their sizes."""
    sizes = own.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("size"))
    sides = sizes.select(*keys, "kind", "size", F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("m")).unionByName(told.select(*keys, F.col("a").alias("kind"), F.lit(None).cast("long").alias("size"), "b", "m"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        pairs, kinds = rows[rows["size"].isna()], rows[rows["size"].notna()].sort_values("kind")
        met = set(pairs.loc[pairs["kind"] != pairs["b"], "kind"])
        kinds = kinds[kinds["kind"].isin(met) | (kinds["size"] > 1)]  # an id that meets no other has no pair
        if kinds.empty:
            return rows[keys].head(0).assign(ccc=pd.Series(dtype="float64"))
        names = kinds["kind"].to_numpy()
        pairs = pairs[pairs["kind"].isin(names) & pairs["b"].isin(names)]
        d = np.ones((len(names), len(names)))
        d[np.searchsorted(names, pairs["kind"]), np.searchsorted(names, pairs["b"].astype("int64"))] = 1 - pairs["m"].to_numpy()
        return rows[keys].head(1).assign(ccc=[repeats.cophenetic_correlation(d, np.repeat(np.arange(len(names)), kinds["size"].astype(int)))])

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in own.select(*keys).schema)
    if not keys:
        return sides.groupBy(F.lit(0).alias("_all")).applyInPandas(run, "ccc double")  # kinds only
    # In a number of tasks that small tables do not lower: else one task has all keys.
    spread = sides.repartition(4 * max(1, own.sparkSession.sparkContext.defaultParallelism), *keys)
    return spread.groupBy(*keys).applyInPandas(run, f"{schema}ccc double")
