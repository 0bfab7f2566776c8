"""Queries over clustering kernels, search, classification and preparation. Most have no SQL form; some results are known by construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import affinities, assemble, classify, cluster, evolve, features, inference, linkages, longitudinal, pipeline, resample, search, stability
from ..sources.store import stored
from ..sources.tables import table
from .cohort import ORDERS_SQL, changes, first_orders
from .resampling import BOOTS_SQL, LABELS_SQL, SCORES_SQL, boots, labels
from .statistics import by_nation, rounded

#: Centres of three well separated clusters, in two views.
CENTRES = ((0.0, 0.0), (10.0, 0.0), (0.0, 10.0))
BLOB = "id % 3"


def blobs(s, d):
    """The suppliers around three centres (id, x)."""
    own = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 10000.0).alias("a"), (F.col("s_nationkey") / 25.0).alias("b"))
    at = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in CENTRES]), (F.col("id") % 3 + 1).cast("int"))
    return own.select("id", F.array(F.col("a") + at(0), F.col("b") + at(1)).alias("x"))


def view_points(s, d):
    own = blobs(s, d)
    return own.select("id", F.lit("u").alias("view"), "x").unionByName(own.select("id", F.lit("v").alias("view"), F.transform("x", lambda x: x * -2.0).alias("x")))


def clustered(kernel):
    """Labels as they partition the ids: numbered by smallest member."""

    def run(s, d):
        found = cluster.cluster_groups(blobs(s, d).withColumn("g", F.lit(1)), ["g"], kernel)
        first = found.groupBy("label").agg(F.min("id").alias("cluster"))
        return found.join(first, "label").select("id", "cluster", "status")

    return run


def spread(clusterer):
    """The same by a clusterer that spreads one group over tasks."""
    return lambda s, d: clusterer(blobs(s, d)).withColumn("status", F.lit("ok"))


def linked(method):
    """The same by a linkage that holds no matrix of the table."""
    return lambda s, d: linkages.linked(blobs(s, d), method, 3).withColumn("status", F.lit("ok"))


PARTITION_SQL = "select s_suppkey as id, s_suppkey % 3 as cluster, 'ok' as status from supplier"


def samples(s, d, n=3):
    ids = blobs(s, d).select("id").withColumn("boot", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))
    return ids.filter("substr(md5(concat_ws(':', id, boot)), 1, 1) > '2'")


GENES = {"k_u": [2, 3, 4], "linkage_u": ["average", "complete"], "k_v": [2, 3, 4], "linkage_v": ["average", "complete"], "pre_linkage": ["average"], "k_final": [2, 3], "fusion": ["agreement", "consensus"]}


def evaluated(s, d):
    return stored(cluster.evaluate_population(view_points(s, d), search.population(s, 4, GENES, "pop"), samples(s, d), ["u", "v"], least=5))


def found(s, d):
    archive, _ = evolve.search(view_points(s, d), samples(s, d), ["u", "v"], GENES, ["ari_final", "quality_final"], size=4, generations=2, least=5)
    return s.createDataFrame(archive)


def classified(s, d):
    """All 18 points of the grid in 5 by 3 folds; of points that are equally right the first is taken."""
    scores, _ = classify.nested_cv(blobs(s, d).withColumn("label", F.col("id") % 3))
    return rounded(scores, 6, "accuracy", "balanced_accuracy", "precision", "recall", "auc")


def prepared_input(s, d):
    c = table(s, d, "supplier")
    return c.select(F.col("s_suppkey").alias("subject"), F.expr("case when s_suppkey % 6 = 0 then null else s_acctbal end").alias("bal"), F.col("s_nationkey").cast("double").alias("nat_a"), F.expr("case when s_suppkey % 11 = 0 then null else (s_suppkey % 13) * 1.0D end").alias("nat_b"))


META = [("bal", "money"), ("nat", "place")]


def prepared(s, d):
    out, _ = pipeline.fit(prepared_input(s, d), "subject", s.createDataFrame(META, "variable string, view string"))
    return rounded(out, 8, "value")


def replayed(s, d):
    everything = prepared_input(s, d)
    _, fitted = pipeline.fit(everything.filter("nat_a < 13"), "subject", s.createDataFrame(META, "variable string, view string"))
    return rounded(pipeline.replay(everything.filter("nat_a >= 13"), "subject", fitted, with_reference=True), 8, "value")


def raw_files(s, d):
    """Two raw files: scores per visit, and dated ones without visits."""
    e = table(s, d, "events")
    visits = e.select(F.col("user_id").cast("string").alias("src_subject_id"), F.element_at(F.array(F.lit("baseline"), F.lit("month_1"), F.lit("m2")), (F.col("event_id") % 3 + 1).cast("int")).alias("visit"), F.date_format("ts", "MM/dd/yyyy").alias("interview_date"), F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("score"))
    o = table(s, d, "orders")
    dated = o.select(F.col("o_custkey").cast("string").alias("src_subject_id"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("interview_date"), F.col("o_orderpriority").alias("priority"))
    return [visits, dated]


def assembled(s, d):
    return assemble.assemble(raw_files(s, d), ["score", "priority"], "month_2")


def with_pca(s, d):
    points, explained, _ = features.pca(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x")), 2)
    return rounded(points.select("id", F.abs(F.col("scores")[0]).alias("pc1"), F.lit(float(explained[0])).alias("explained")), 5, "pc1", "explained")


def mixed_input(s, d):
    """Numbers, text of a label set and not, a flag and a date, with gaps."""
    o = table(s, d, "orders").filter("o_orderkey % 10 = 0")
    return o.select(F.col("o_orderkey").alias("subject"), F.expr("case when o_orderkey % 60 = 0 then null else o_totalprice end").alias("a_price"), F.expr("case when o_orderkey % 70 = 0 then null else o_orderstatus end").alias("a_status"), F.expr("case when o_orderkey % 90 = 0 then null else o_orderpriority end").alias("b_prio"), (F.col("o_totalprice") > 100000).alias("b_dear"), F.col("o_orderdate").cast("date").alias("b_day"))


def prepared_mixed(s, d):
    """One value per feature: its number of subjects, least and greatest value after preparation."""
    specs = s.createDataFrame([(1, "F", 1), (1, "O", 2), (2, "F", 5), (2, "O", 6), (2, "P", 7)], "set_id int, level string, code int")
    out, _ = pipeline.fit(mixed_input(s, d), "subject", s.createDataFrame([("a", "first"), ("b", "second")], "variable string, view string"), "minmax", specs)
    return rounded(out.groupBy("view", "feature").agg(F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("most")), 6, "least", "most")


def moved(s, d):
    found = longitudinal.pca_change(*[first_orders(s, d, o) for o in (F.asc("o_orderkey"), F.desc("o_orderkey"))])
    return rounded(found.select("id", "moved"), 3, "moved")


def coassoc_cluster(s, d):
    found = cluster.consensus_clusters_of(*stability.consensus_kinds(labels(s, d), []), 3)
    return found.groupBy("label").agg(F.count("*").alias("n"))


QUERIES = {
    "cluster_null": lambda s, d: cluster.cluster_groups(blobs(s, d).withColumn("g", F.col("id") % 2), ["g"], cluster.Kernel("null")),
    **{f"linkage_{m}": linked(m) for m in ("single", "complete", "average", "weighted", "centroid", "median", "ward")},
    "spectral": spread(lambda x: affinities.spectral(x, 3)),
    "gmm": clustered(cluster.Kernel("gmm", 3)),
    "kmeans": clustered(cluster.Kernel("kmeans", 3)),
    "meanshift": spread(affinities.mean_shift),
    "view_ensemble": spread(lambda x: affinities.ensemble(x, 3)),
    "consensus_cut": coassoc_cluster,
    "cophenetic": lambda s, d: rounded(cluster.cophenetic_of(*stability.consensus_kinds(labels(s, d), []), []), 8, "ccc"),
    "population_labels": evaluated,
    "population_fitness": lambda s, d: evolve.fitness(cluster.completed(evaluated(s, d))),
    "search_step": found,
    "crowding": lambda s, d: search.crowding(search.pareto_front(table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), (-F.col("p_retailprice")).alias("cheap")), ["size", "cheap"]), ["size", "cheap"], ["p_partkey"]).select("p_partkey", F.round("crowding", 8).alias("crowding")),
    "nested_cv": classified,
    "roc_curve": lambda s, d: rounded(longitudinal.curve(table(s, d, "labels").select(F.col("quality").alias("truth"), ((F.col("doc_id") % 17) * 1.0).cast("double").alias("score"))), 8, "tpr", "fpr", "precision"),
    "feature_change": lambda s, d: rounded(longitudinal.feature_change(*[first_orders(s, d, o).select("id", F.posexplode("x").alias("feature", "value")) for o in (F.asc("o_orderkey"), F.desc("o_orderkey"))]), 6, "mean", "sd"),
    "switch_rate": lambda s, d: changes(s, d).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("switched").cast("long")).alias("switched")),
    "prepare_views": prepared,
    "replay_views": replayed,
    "prepare_mixed": prepared_mixed,
    "pca_change": moved,
    "assemble_table": assembled,
    "pca_scores": with_pca,
    "stability_permutation": lambda s, d: rounded(stability.permutation_p(labels(s, d), 10), 8, "observed", "p"),
    "multinomial_lr": lambda s, d: s.createDataFrame([classify.multinomial_lr(table(s, d, "customer").select((F.col("c_nationkey") % 3).alias("k"), F.col("c_acctbal").alias("a"), (F.col("c_custkey") % 7).cast("double").alias("b")), "k", ["a"], ["b"])]),
    "variable_fdr": lambda s, d: rounded(inference.bh(inference.welch_t(by_nation(s, d), (0, 1), p=True), "p", ties=["variable"]), 6, "t", "df", "p", "q"),
    "bootstrap_votes": lambda s, d: stability.majority_vote(boots(s, d), ["boot", "id"], "label").groupBy("boot", "label").agg(F.count("*").alias("n")),
}

CURVE_SQL = "with s as (select quality as truth, ((doc_id % 17) * 1.0)::double as score from labels), g as (select score, sum(truth)::double as pos, count(*)::double as n from s group by 1), u as (select score, sum(pos) over w as tp, sum(n) over w as told from g window w as (order by score desc)) select score, round(tp / (select sum(pos) from g), 8) as tpr, round((told - tp) / (select sum(n) - sum(pos) from g), 8) as fpr, round(tp / told, 8) as \"precision\" from u"
ORACLES = {
    "cluster_null": "select s_suppkey % 2 as g, s_suppkey as id, 0::bigint as label, 'ok' as status from supplier",
    **{name: PARTITION_SQL for name in (*(f"linkage_{m}" for m in ("single", "complete", "average", "weighted", "centroid", "median", "ward")), "spectral", "gmm", "kmeans", "meanshift", "view_ensemble")},
    "roc_curve": CURVE_SQL,
    "prepare_mixed": "select * from (values ('first', 'a_price'), ('first', 'a_status'), ('second', 'b_prio_2-HIGH'), ('second', 'b_prio_3-MEDIUM'), ('second', 'b_prio_4-NOT SPECIFIED'), ('second', 'b_prio_5-LOW'), ('second', 'b_prio_nan'), ('second', 'b_dear'), ('second', 'b_day')) t(view, feature), (select count(*) as n, 0.0::double as least, 1.0::double as most from orders where o_orderkey % 10 = 0 and not (o_orderkey % 60 = 0 and o_orderkey % 70 = 0))",
    # All of two features: the components turn the plane, distances stay.
    "pca_change": "with o as (select o_custkey as id, o_orderkey, o_totalprice as p, ((o_orderdate::date - date '1970-01-01') % 100)::double as q from orders) select id, round(sqrt(pow(arg_max(p, o_orderkey) - arg_min(p, o_orderkey), 2) + pow(arg_max(q, o_orderkey) - arg_min(q, o_orderkey), 2)), 3) as moved from o group by 1",
    "crowding": "with p as (select p_partkey as id, p_size::double as size, -p_retailprice as cheap from part), f as (select * from p where not exists (select 1 from p q where q.size >= p.size and q.cheap >= p.cheap and (q.size > p.size or q.cheap > p.cheap))), s as (select id, lag(size) over w as a, lead(size) over w as b, max(size) over () - min(size) over () as span from f window w as (order by size, id)), c as (select id, lag(cheap) over w as a, lead(cheap) over w as b, max(cheap) over () - min(cheap) over () as span from f window w as (order by cheap, id)) select s.id as p_partkey, round(coalesce((s.b - s.a) / s.span, 'infinity'::double) + coalesce((c.b - c.a) / c.span, 'infinity'::double), 8) as crowding from s join c on s.id = c.id",
    "feature_change": "with o as (select o_custkey as id, o_orderkey, o_totalprice as p, ((o_orderdate::date - date '1970-01-01') % 100)::double as q from orders), c as (select id, arg_max(p, o_orderkey) - arg_min(p, o_orderkey) as p, arg_max(q, o_orderkey) - arg_min(q, o_orderkey) as q from o group by id) select 0 as feature, count(*) as n, round(avg(p), 6) as mean, round(stddev_samp(p), 6) as sd from c union all select 1, count(*), round(avg(q), 6), round(stddev_samp(q), 6) from c",
    "switch_rate": f"with {ORDERS_SQL} select label, count(*) as n, sum((label <> later)::int)::bigint as switched from t group by label",
    "bootstrap_votes": f"with {BOOTS_SQL} select boot, label, count(*) as n from v group by all",
    "stability_permutation": f"with {LABELS_SQL}, m as (select boot, id, label, b, concat_ws(':', b, boot, id) as key from l, range(1, 11) t(b)), h as (select boot, id, b, row_number() over (partition by b, boot order by md5(concat_ws(':', key, 'here')), key) as r from m), y as (select boot, label, b, row_number() over (partition by b, boot order by md5(concat_ws(':', key, 'null')), key) as r from m), z as (select b, boot, id, label from h join y using (b, boot, r) union all select 0, boot, id, label from l), c as (select x.b, x.boot as b1, w.boot as b2, x.label as la, w.label as lb, count(*)::double as n from z x join z w on x.b = w.b and x.id = w.id and x.boot < w.boot group by all), s as (select b, b1, b2, sum(n * (n - 1) / 2) as i, sum(n) as n from c group by all), pa as (select b, b1, b2, sum(x * (x - 1) / 2) as p from (select b, b1, b2, la, sum(n) as x from c group by all) group by all), pb as (select b, b1, b2, sum(x * (x - 1) / 2) as q from (select b, b1, b2, lb, sum(n) as x from c group by all) group by all), a as (select b, avg({SCORES_SQL}) as ari from s join pa using (b, b1, b2) join pb using (b, b1, b2) group by b) select round(o.ari, 8) as observed, round((sum(case when a.ari >= o.ari - 1e-12 then 1 else 0 end) + 1.0::double) / (count(*) + 1.0::double), 8) as p from a, (select ari from a where b = 0) o where a.b > 0 group by o.ari",
    "assemble_table": "with v as (select user_id as id, event_id, ts::date as day from events where event_id % 3 = 2), r as (select id, min(day) as ref, arg_min(event_id, (day, event_id::varchar)) as score from v group by id), o as (select o_custkey as id, o_orderpriority, row_number() over (partition by o_custkey order by abs(date_diff('day', ref, o_orderdate::date)) nulls last, o_orderdate::date, o_orderpriority) as k from orders left join r on o_custkey = r.id), s as (select user_id as id from events union select o_custkey from orders) select s.id::varchar as id, r.score::varchar as score, o.o_orderpriority as priority from s left join r on s.id = r.id left join o on s.id = o.id and k = 1",
}
