"""Queries over resampling, stability, consensus, fusion, quality and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion, quality, resample, search, stability
from ..sources.tables import table

LABELS = "(s_suppkey * s_suppkey * boot + s_suppkey) % (boot + 2)"
RANK = "row_number() over (order by md5(concat_ws(':', c_custkey, '{}')), c_custkey)"


def labels(spark, sf_dir, boots=3):
    """Constructed label sets of all suppliers."""
    ids = table(spark, sf_dir, "supplier").select("s_suppkey")
    return ids.withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(boots)))).select("boot", F.col("s_suppkey").alias("id"), F.expr(LABELS).alias("label"))


LABELS_SQL = f"l as (select boot, s_suppkey as id, {LABELS} as label from supplier, range(1, 4) b(boot))"
PAIRS_SQL = "co as (select x.id as i, y.id as j, avg(case when x.label = y.label then 1.0::double else 0.0::double end) as m from l x join l y on x.boot = y.boot and x.id < y.id group by all)"


def views(spark, sf_dir):
    return labels(spark, sf_dir).withColumnRenamed("boot", "view")


def ari_pair(spark, sf_dir):
    both = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 3).alias("a"), (F.col("c_nationkey") % 4).alias("b"))
    sums = stability.pair_sums(both, [])
    return sums.select(F.round(stability.ari(sums), 8).alias("ari"))


def jaccard_pair(spark, sf_dir):
    both = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 3).alias("a"), (F.col("c_nationkey") % 4).alias("b"))
    return stability.pair_sums(both, []).select(F.round(stability.jaccard(), 8).alias("jaccard"))


CELLS_SQL = "c as (select c_custkey % 3 as a, c_nationkey % 4 as b, count(*)::double as n from customer group by all), s as (select sum(n * (n - 1) / 2) as i, (select sum(x * (x - 1) / 2) from (select sum(n) as x from c group by a)) as p, (select sum(x * (x - 1) / 2) from (select sum(n) as x from c group by b)) as q, (select sum(n) from c) as n from c)"


def boots(spark, sf_dir):
    """Five resamples, each of about 80 % by hash, with repeated ids that disagree."""
    c = table(spark, sf_dir, "customer").withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(5)))).filter("substr(md5(concat_ws(':', c_custkey, boot)), 1, 1) > '2'")
    c = c.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return c.select("boot", F.col("c_custkey").alias("id"), F.expr("case when copy = 2 and c_custkey % 7 = boot then 9 else (c_custkey + case when c_custkey % 11 < boot then 1 else 0 end) % 4 end").alias("label"))


BOOTS_SQL = """r as (select boot, c_custkey as id, case when copy = 2 and c_custkey % 7 = boot then 9 else (c_custkey + case when c_custkey % 11 < boot then 1 else 0 end) % 4 end as label
  from customer, range(1, 6) b(boot), range(0, 3) k(copy) where substr(md5(concat_ws(':', c_custkey, boot)), 1, 1) > '2'),
v as (select boot, id, label from (select boot, id, label, row_number() over (partition by boot, id order by count(*) desc, label) as k from r group by boot, id, label) where k = 1),
c as (select x.boot as b1, y.boot as b2, x.label as a, y.label as b, count(*)::double as n from v x join v y on x.id = y.id and x.boot < y.boot group by all),
p as (select b1, b2, sum(n * (n - 1) / 2) as i, sum(n) as n from c group by b1, b2),
pa as (select b1, b2, sum(x * (x - 1) / 2) as p from (select b1, b2, a, sum(n) as x from c group by b1, b2, a) group by b1, b2),
pb as (select b1, b2, sum(x * (x - 1) / 2) as q from (select b1, b2, b, sum(n) as x from c group by b1, b2, b) group by b1, b2),
s as (select * from p join pa using (b1, b2) join pb using (b1, b2))"""


def supplier_points(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 3).alias("label"), F.array(F.col("s_acctbal") / 1000.0, F.col("s_nationkey").cast("double")).alias("x"))


POINTS_SQL = "p as (select s_suppkey as id, s_nationkey % 3 as label, s_acctbal / 1000.0::double as x, s_nationkey::double as y from supplier)"
DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
SILHOUETTE_SQL = f"""d as (select a.id, a.label, b.label as other, avg({DIST}) as m from p a join p b on a.id <> b.id group by all),
e as (select id, label, max(case when other = label then m end) as ina, min(case when other <> label then m end) as outb from d group by all),
sil as (select (avg((outb - ina) / greatest(ina, outb)) + 1) / 2 as silhouette from e)"""
CH_SQL = """cc as (select label, count(*) as n, avg(x) as cx, avg(y) as cy, var_pop(x) + var_pop(y) as v from p group by label),
ch as (select c / (c + 1) as calinski_harabasz from (select (sum(n * ((cx - mx) * (cx - mx) + (cy - my) * (cy - my))) * (sum(n) - count(*))) / (sum(n * v) * (count(*) - 1)) as c from cc, (select avg(x) as mx, avg(y) as my from p)))"""
DB_SQL = """sp as (select p.label, cx, cy, avg(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) as s from p join cc on p.label = cc.label group by all),
db as (select 1 / (1 + avg(w)) as davies_bouldin from (select a.label, max((a.s + b.s) / sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))) as w from sp a join sp b on a.label <> b.label group by a.label))"""


def supplier_distances(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("a"))
    # By the grid's blocks, in a number of tasks that the small table does not lower; broadcast, the one task that reads it would make all pairs.
    blocks = max(8, -(-s.count() // 2048))
    spread = lambda df: df.repartition(4 * max(1, spark.sparkContext.defaultParallelism), "row", "column")
    block = lambda c, name: F.pmod(F.xxhash64(c), F.lit(blocks)).alias(name)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left, right = s.select("i", "a", block("i", "row"), every.alias("column")), s.select(F.col("i").alias("j"), F.col("a").alias("b"), block("i", "column"), every.alias("row"))
    return spread(left).join(spread(right).hint("shuffle_hash"), ["row", "column"]).filter("i < j").select("i", "j", F.abs(F.col("a") - F.col("b")).alias("d"))


SKEWED = "case when s_suppkey % 20 = 0 then 3 when s_suppkey % 10 = 1 then 2 when s_suppkey % 3 = 0 then 1 else 0 end"


def skewed_labels(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.expr(SKEWED).alias("label"))


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), (-F.col("p_retailprice")).alias("cheap"))


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def permuted(s, d):
    t = resample.permute(table(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_suppkey", "s_acctbal", "p1")
    return t.select("s_suppkey", "permuted")


QUERIES = {
    "subsample_md5": lambda s, d: resample.subsample(table(s, d, "customer").select("c_custkey"), "c_custkey", "s1"),
    "merge_resample_md5": lambda s, d: resample.merge_resample(table(s, d, "nation").select("n_nationkey"), "n_nationkey", "m1"),
    "kfold_md5": lambda s, d: resample.k_fold(table(s, d, "customer").select("c_custkey"), "c_custkey", "f1", 5),
    "stratified_kfold": lambda s, d: resample.stratified_k_fold(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", "f2", 5),
    "bootstrap_md5": lambda s, d: resample.bootstrap(table(s, d, "customer").select("c_custkey"), "c_custkey", "b1"),
    "permute_columns": permuted,
    "ari_pair": ari_pair,
    "jaccard_pair": jaccard_pair,
    "ari_mean_boot": lambda s, d: stability.stability(boots(s, d)).agg(F.round(F.avg("ari"), 8).alias("ari"), F.round(F.avg("jaccard"), 8).alias("jaccard"), F.count("*").alias("n_pairs")),
    "score_distribution": lambda s, d: rounded(stability.stability(boots(s, d)), 8, "ari", "jaccard"),
    "coassoc_pairs": lambda s, d: rounded(stability.co_association(labels(s, d)), 8, "m"),
    "pac": lambda s, d: rounded(stability.pac(stability.co_association(labels(s, d))), 8, "pac"),
    "ecdf_consensus": lambda s, d: rounded(stability.ecdf(rounded(stability.co_association(labels(s, d)), 8, "m")), 8, "share"),
    "cluster_consensus": lambda s, d: rounded(stability.cluster_consensus_of(labels(s, d), labels(s, d).filter("boot = 1")), 8, "stability"),
    "assignment_certainty": lambda s, d: rounded(stability.certainty_of(labels(s, d), labels(s, d).filter("boot = 2")), 6, "best", "second", "margin").drop("best_cluster"),
    "majority_vote": lambda s, d: stability.majority_vote(table(s, d, "events").select("user_id", "event_type"), ["user_id"], "event_type"),
    "fuse_agreement": lambda s, d: rounded(fusion.agreement(views(s, d)), 8, "d"),
    "fuse_disagreement": lambda s, d: fusion.disagreement(views(s, d)),
    "fuse_consensus": lambda s, d: fusion.consensus(views(s, d)),
    "consensus_labels": lambda s, d: fusion.consensus_labels(views(s, d)).select("id", F.col("label").cast("long").alias("label")),
    "min_cluster_size": lambda s, d: fusion.min_cluster_size(supplier_distances(s, d), skewed_labels(s, d), 12),
    "silhouette": lambda s, d: rounded(quality.silhouette_score(supplier_points(s, d)), 8, "silhouette"),
    "calinski": lambda s, d: rounded(quality.calinski_harabasz(supplier_points(s, d)), 8, "calinski_harabasz"),
    "davies": lambda s, d: rounded(quality.davies_bouldin(supplier_points(s, d)), 8, "davies_bouldin"),
    "composite_quality": lambda s, d: rounded(quality.composite(supplier_points(s, d)), 8, "silhouette", "calinski_harabasz", "davies_bouldin", "quality"),
    "compactness": lambda s, d: rounded(quality.compactness(supplier_distances(s, d)), 8, "compactness"),
    "pareto_front": lambda s, d: search.pareto_front(parts(s, d), ["size", "cheap"]).select("p_partkey", "size", "cheap"),
    "ideal_point": lambda s, d: rounded(search.ideal_distance(parts(s, d), ["size", "cheap"]), 8, "distance").select("p_partkey", "distance"),
}

SCORES_SQL = "(i - p * q / (n * (n - 1) / 2)) / ((p + q) / 2 - p * q / (n * (n - 1) / 2))"
FUSE_SQL = f"with {LABELS_SQL}, f as (select x.id as i, y.id as j, sum(case when x.label = y.label then 1 else 0 end) as agree, count(*) as views from l x join l y on x.boot = y.boot and x.id < y.id group by all) select i, j, "

ORACLES = {
    "subsample_md5": f"select c_custkey from (select c_custkey, {RANK.format('s1')} as r, count(*) over () as n from customer) where r <= floor(n * 0.8::double)",
    "merge_resample_md5": "select n_nationkey from (select n_nationkey, row_number() over (order by md5(concat_ws(':', n_nationkey, 'm1')), n_nationkey) as r, count(*) over () as n from nation) where r <= greatest(3, round(n * 0.8::double))",
    "kfold_md5": f"select c_custkey, ({RANK.format('f1')} - 1) % 5 as fold from customer",
    "stratified_kfold": "select c_custkey, c_mktsegment, (row_number() over (partition by c_mktsegment order by md5(concat_ws(':', c_custkey, 'f2')), c_custkey) - 1) % 5 as fold from customer",
    "bootstrap_md5": f"with r as (select c_custkey, {RANK.format('order')} as r from customer), n as (select count(*) as n from customer) select pos, c_custkey from (select pos, ('0x' || substr(md5(concat_ws(':', pos, 'b1')), 1, 8))::bigint % n + 1 as r from n, range(0, (select count(*) from customer)) p(pos)) join r using (r)",
    "permute_columns": "with h as (select s_suppkey, row_number() over (order by md5(concat_ws(':', s_suppkey, 'here')), s_suppkey) as r from supplier), t as (select s_acctbal, row_number() over (order by md5(concat_ws(':', s_suppkey, 'p1')), s_suppkey) as r from supplier) select s_suppkey, s_acctbal as permuted from h join t using (r)",
    "ari_pair": f"with {CELLS_SQL} select round({SCORES_SQL}, 8) as ari from s",
    "jaccard_pair": f"with {CELLS_SQL} select round(i / (p + q - i), 8) as jaccard from s",
    "ari_mean_boot": f"with {BOOTS_SQL} select round(avg({SCORES_SQL}), 8) as ari, round(avg(i / (p + q - i)), 8) as jaccard, count(*) as n_pairs from s",
    "score_distribution": f"with {BOOTS_SQL} select b1, b2, round({SCORES_SQL}, 8) as ari, round(i / (p + q - i), 8) as jaccard from s",
    "coassoc_pairs": f"with {LABELS_SQL}, {PAIRS_SQL} select i, j, round(m, 8) as m from co",
    "pac": f"with {LABELS_SQL}, {PAIRS_SQL} select round(avg(case when m > 0.1::double and m < 0.9::double then 1.0::double else 0.0::double end), 8) as pac, count(*) as n_pairs from co",
    "ecdf_consensus": f"with {LABELS_SQL}, {PAIRS_SQL}, v as (select round(m, 8) as m, count(*) as n from co group by 1) select m, n, round((sum(n) over (order by m))::double / (select sum(n) from v)::double, 8) as share from v",
    "cluster_consensus": f"with {LABELS_SQL}, {PAIRS_SQL}, r as (select id, label from l where boot = 1), g as (select r.label, avg(m) as stability from co join r on co.i = r.id join r q on co.j = q.id and q.label = r.label group by 1) select r.label, count(*) as n, round(coalesce(max(stability), 0), 8) as stability from r left join g on r.label = g.label group by 1",
    "assignment_certainty": f"with {LABELS_SQL}, {PAIRS_SQL}, r as (select id, label from l where boot = 2), b as (select i as id, j as other, m from co union all select j, i, m from co), a as (select b.id, label, avg(m) as m from b join r on b.other = r.id group by all), o as (select id, m, row_number() over (partition by id order by m desc, label) as k from a), t as (select id, max(case when k = 1 then m end) as best, coalesce(max(case when k = 2 then m end), 0) as second from o group by id) select id, round(best, 6) as best, round(second, 6) as second, round(best - second, 6) as margin, best < 0.6::double - 1e-12 as uncertain from t",
    "majority_vote": "select user_id, event_type from (select user_id, event_type, row_number() over (partition by user_id order by count(*) desc, event_type) as k from events group by user_id, event_type) where k = 1",
    "fuse_agreement": FUSE_SQL + "round((views - agree)::double / views, 8) as d from f",
    "fuse_disagreement": FUSE_SQL + "(views - agree)::bigint as d from f",
    "fuse_consensus": FUSE_SQL + "(case when views <> agree then 1 else 0 end)::int as d from f",
    "consensus_labels": f"with {LABELS_SQL}, w as (select id, max(case when boot = 1 then label end) as a, max(case when boot = 2 then label end) as b, max(case when boot = 3 then label end) as c from l group by id) select id, dense_rank() over (order by a, b, c) - 1 as label from w",
    "min_cluster_size": f"with p as (select s_suppkey as id, s_acctbal as x, {SKEWED} as label from supplier), z as (select label, count(*) as n from p group by label), m as (select a.id, b.label as target, avg(abs(a.x - b.x)) as m from p a join p b on true where a.label in (select label from z where n < 12) and b.label in (select label from z where n >= 12) group by all), t as (select id, target, row_number() over (partition by id order by m, target) as k from m) select p.id, coalesce(t.target, p.label) as label from p left join t on p.id = t.id and k = 1",
    "silhouette": f"with {POINTS_SQL}, {SILHOUETTE_SQL} select round(silhouette, 8) as silhouette from sil",
    "calinski": f"with {POINTS_SQL}, {CH_SQL} select round(calinski_harabasz, 8) as calinski_harabasz from ch",
    "davies": f"with {POINTS_SQL}, {CH_SQL}, {DB_SQL} select round(davies_bouldin, 8) as davies_bouldin from db",
    "composite_quality": f"with {POINTS_SQL}, {SILHOUETTE_SQL}, {CH_SQL}, {DB_SQL} select round(silhouette, 8) as silhouette, round(calinski_harabasz, 8) as calinski_harabasz, round(davies_bouldin, 8) as davies_bouldin, round((silhouette + calinski_harabasz + davies_bouldin) / 3, 8) as quality from sil, ch, db",
    "compactness": "select round(1 - (avg(d) - min(d)) / (max(d) - min(d)), 8) as compactness from (select abs(a.s_acctbal - b.s_acctbal) as d from supplier a join supplier b on a.s_suppkey < b.s_suppkey)",
    "pareto_front": "with p as (select p_partkey, p_size::double as size, -p_retailprice as cheap from part) select * from p where not exists (select 1 from p q where q.size >= p.size and q.cheap >= p.cheap and (q.size > p.size or q.cheap > p.cheap))",
    "ideal_point": "with p as (select p_partkey, p_size::double as size, -p_retailprice as cheap from part), r as (select min(size) as a, max(size) as b, min(cheap) as c, max(cheap) as d from p) select p_partkey, round(sqrt(pow(1 - (size - a) / (b - a), 2) + pow(1 - (cheap - c) / (d - c), 2)), 8) as distance from p, r",
}
