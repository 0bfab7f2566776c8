"""Queries over features and inference."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import features, inference, match
from ..sources.tables import table


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def acctbal(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("c_acctbal").alias("feature"), F.col("c_acctbal").alias("value"))


def scale(kind):
    def run(s, d):
        long = acctbal(s, d)
        return rounded(features.apply_scale(long, features.fit_scale(long, kind)), 8, "value").select("id", "value")

    return run


def by_nation(s, d):
    """Two variables of customers, in two groups."""
    c = table(s, d, "customer").select((F.col("c_nationkey") < 12).cast("int").alias("group"), F.col("c_acctbal"), F.col("c_custkey").cast("double").alias("c_custkey"))
    return c.unpivot(["group"], ["c_acctbal", "c_custkey"], "variable", "value")


LONG_SQL = "g as (select (c_nationkey < 12)::int as grp, 'c_acctbal' as variable, c_acctbal as value from customer union all select (c_nationkey < 12)::int, 'c_custkey', c_custkey::double from customer), m as (select variable, grp, count(*)::double as n, avg(value) as mean, var_samp(value) as v from g group by all), t as (select variable, max(case when grp = 0 then n end) as n0, max(case when grp = 1 then n end) as n1, max(case when grp = 0 then mean end) as m0, max(case when grp = 1 then mean end) as m1, max(case when grp = 0 then v end) as v0, max(case when grp = 1 then v end) as v1 from m group by variable)"


def segments(s, d):
    c = table(s, d, "customer")
    return c.select(F.lit("nation").alias("variable"), F.col("c_mktsegment").alias("group"), F.col("c_nationkey").cast("string").alias("level"))


CHI_SQL = "c as (select c_mktsegment as r, c_nationkey as k, count(*)::double as n from customer group by all), f as (select r.r, k.k, coalesce(n, 0) as n, nr * nk / (select sum(n) from c) as e from (select r, sum(n) as nr from c group by r) r cross join (select k, sum(n) as nk from c group by k) k left join c on c.r = r.r and c.k = k.k), x as (select sum((n - e) * (n - e) / e) as chi2, sum(n) as n, (count(distinct r) - 1) * (count(distinct k) - 1) as df, least(count(distinct r), count(distinct k)) - 1 as m from f)"


def p_values(s, d):
    n = table(s, d, "nation")
    return n.select("n_nationkey", F.expr("((n_nationkey * 7 + 3) % 25 + 0.5D) / 60.0D").alias("p"), (F.col("n_regionkey") % 2).alias("family"))


P_SQL = "p as (select n_nationkey, ((n_nationkey * 7 + 3) % 25 + 0.5::double) / 60.0::double as p, n_regionkey % 2 as family from nation)"
BH_SQL = "b as (select *, p * count(*) over (partition by family) / row_number() over (partition by family order by p, n_nationkey desc) as raw from p), q as (select *, least(1.0::double, min(raw) over (partition by family order by p desc, n_nationkey rows unbounded preceding)) as q from b)"


def supplier_gaps(s, d):
    """Two features of suppliers with injected gaps."""
    t = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.expr("case when s_suppkey % 5 = 0 then null else s_acctbal / 1000.0D end").alias("bal"), F.expr("case when s_suppkey % 7 = 3 then null else s_nationkey * 1.0D end").alias("nat"), F.expr("(s_suppkey % 13) * 1.0D").alias("key"))
    return t.unpivot(["id"], ["bal", "nat", "key"], "feature", "value")


GAPS_SQL = "w as (select s_suppkey as id, case when s_suppkey % 5 = 0 then null else s_acctbal / 1000.0::double end as bal, case when s_suppkey % 7 = 3 then null else s_nationkey * 1.0::double end as nat, (s_suppkey % 13) * 1.0::double as key from supplier), g as (select id, 'bal' as feature, bal as value from w union all select id, 'nat', nat from w union all select id, 'key', key from w)"


def discovery(s, d):
    """The gaps of the suppliers of half of the nations, as donors for all."""
    known = table(s, d, "supplier").filter("s_nationkey < 13").select(F.col("s_suppkey").alias("id"))
    return supplier_gaps(s, d).join(known, "id", "left_semi")


def knn_sql(donors):
    return f"with {GAPS_SQL}, dn as (select id as donor, feature, value as other from g where value is not null {donors}), nd as (select distinct id from g where value is null), ds as (select g.id, donor, sqrt(3.0::double / count(*) * sum((value - other) * (value - other))) as dist from g join nd using (id) join dn using (feature) where value is not null and id <> donor group by all), r as (select x.id, x.feature, other, row_number() over (partition by x.id, x.feature order by round(dist, 9), ds.donor) as k from g x join ds using (id) join dn on ds.donor = dn.donor and x.feature = dn.feature where x.value is null), a as (select id, feature, avg(other) as filled from r where k <= 7 group by all) select g.id, g.feature, round(coalesce(g.value, filled), 8) as value from g left join a using (id, feature)"


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def ordinal(s, d):
    o = table(s, d, "orders").select(F.lit("priority").alias("feature"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("value"))
    rows = [(1, v, k) for k, v in enumerate(["F", "O", "P"])] + [(2, v, k) for k, v in enumerate(PRIORITIES)] + [(3, v, 9) for v in PRIORITIES]
    codes = features.fit_ordinal(o, s.createDataFrame(rows, "set_id long, level string, code long"))
    return o.join(codes.select("feature", F.col("level").alias("value"), "code"), ["feature", "value"], "left").select("id", "code")


EVENT_TYPES = "select distinct event_type from events"


def one_hot(s, d):
    e = table(s, d, "events").select("event_id", F.expr("case when event_id % 9 = 0 then null else event_type end").alias("event_type"))
    levels = sorted(r[0] for r in e.filter("event_type is not null").select("event_type").distinct().collect())
    hot = features.one_hot(e, "event_type", levels)
    names = [c for c in hot.columns if c != "event_id"]
    return hot.unpivot(["event_id"], names, "indicator", "value").filter("value = 1").select("event_id", "indicator")


def dims(s, d, low, high):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("k", "v"))
    return e.filter(F.col("k").between(low, high - 1)).select("id", F.concat(F.lit("d"), "k").alias("feature"), F.col("v").cast("double").alias("value"))


CORR_SQL = "e as (select vec_id as id, k, embedding[k + 1]::double as v from embeddings, range(0, 64) t(k)), c as (select 'd' || a.k as f, 'd' || b.k as g, corr(a.v, b.v) as r from e a join e b on a.id = b.id and a.k < 32 and b.k >= 32 group by all)"


def correlates(s, d):
    r = features.correlations(dims(s, d, 0, 32), dims(s, d, 32, 64)).withColumn("r", F.round("r", 8))
    ranked = r.withColumn("place", F.row_number().over(W.partitionBy("f").orderBy(F.desc("r"), "g")))
    return ranked.filter("place <= 2")


def heat(s, d):
    c = table(s, d, "customer").withColumn("europe", (F.col("c_nationkey") % 5 == 0).cast("string"))
    return rounded(inference.heatmap(c, "c_mktsegment", ["c_acctbal", "c_custkey"], {"europe": "true"}), 6, "value", "z")


def customers(s, d):
    return table(s, d, "customer").withColumn("g", (F.col("c_nationkey") < 12).cast("int"))


def perm_sql(seed, what):
    return f"""h as (select b, o.v, row_number() over (partition by b order by md5(concat_ws(':', id, b, 'here')), id) as r from o, range(1, 21) t(b)),
  k as (select b, o.g, row_number() over (partition by b order by md5(concat_ws(':', id, b, '{seed}')), id) as r from o, range(1, 21) t(b)), dealt as (select b, v, g from h join k using (b, r)), {what}"""


MC_CHI = lambda source, name, key: f"{name}c as (select {key} as b, g, v, count(*)::double as n from {source} group by all), {name}x as (select b, sum(n) * (sum(n * n / (nr * nc)) - 1) as chi2 from {name}c join (select b, g, sum(n) as nr from {name}c group by all) using (b, g) join (select b, v, sum(n) as nc from {name}c group by all) using (b, v) group by b)"

GROUPS = (0, 1)
QUERIES = {
    "skew_g1": lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.round(features.adjusted_skew("value"), 6).alias("skew")),
    "yeo_johnson": lambda s, d: table(s, d, "customer").select("c_custkey", F.round(features.yeo_johnson(F.col("c_acctbal"), F.lit(0.3)), 6).alias("y")),
    "yj_grid": lambda s, d: rounded(features.power_likelihood(acctbal(s, d), [-2 + 0.2 * k for k in range(21)]), 5, "lambda", "ll").drop("feature"),
    "yj_fit": lambda s, d: rounded(features.fit_power(table(s, d, "events").select(F.lit("value").alias("feature"), "value")), 2, "lambda"),
    "standard_scale": scale("standard"),
    "minmax_scale": scale("minmax"),
    "robust_scale": scale("robust"),
    "knn_impute": lambda s, d: rounded(features.knn_impute(supplier_gaps(s, d)), 8, "value"),
    "knn_impute_ref": lambda s, d: rounded(features.knn_impute(supplier_gaps(s, d), reference=discovery(s, d)), 8, "value"),
    "ordinal_encode": ordinal,
    "one_hot": one_hot,
    "dense_codes": lambda s, d: features.dense_codes(table(s, d, "part"), "p_type").select("p_type", F.col("code").cast("long").alias("code")),
    "z_vs_control": lambda s, d: rounded(features.z_against(table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_acctbal", "c_mktsegment", "BUILDING"), 8, "z").select("c_custkey", "z"),
    "corr_block": lambda s, d: rounded(features.correlations(dims(s, d, 0, 32), dims(s, d, 32, 64)), 8, "r"),
    "top_correlates": correlates,
    "latent_variance": lambda s, d: rounded(features.variance_share(dims(s, d, 0, 64)), 8, "mean", "share"),
    "bh_fdr": lambda s, d: rounded(inference.bh(p_values(s, d), "p", ["family"], ["n_nationkey"]), 8, "p", "q"),
    "chi_square": lambda s, d: rounded(inference.chi_square(segments(s, d)), 6, "chi2", "cramers_v").select("n", "chi2", "df", "cramers_v"),
    "chi_square_p": lambda s, d: rounded(inference.chi_square(segments(s, d), p=True), 8, "p").select("variable", "p"),
    "cohens_d": lambda s, d: rounded(inference.cohens_d(by_nation(s, d), GROUPS), 8, "d"),
    "welch_t": lambda s, d: rounded(inference.welch_t(by_nation(s, d), GROUPS), 6, "t", "df"),
    "welch_t_p": lambda s, d: rounded(inference.welch_t(by_nation(s, d), GROUPS, p=True), 6, "t", "df", "p"),
    "welch_anova_p": lambda s, d: rounded(inference.welch_anova(table(s, d, "customer").select(F.lit("c_acctbal").alias("variable"), F.col("c_mktsegment").alias("group"), F.col("c_acctbal").alias("value")), p=True), 6, "f", "df2", "p"),
    "fisher_exact": lambda s, d: rounded(inference.fisher(table(s, d, "labels").select(F.lit("quality").alias("variable"), F.col("toxic").alias("group"), F.col("quality").alias("level"))), 6, "p"),
    "eta_squared": lambda s, d: rounded(inference.eta_squared(table(s, d, "customer").select(F.lit("c_acctbal").alias("variable"), F.col("c_mktsegment").alias("group"), F.col("c_acctbal").alias("value"))), 8, "eta2"),
    "perm_pvalue": lambda s, d: rounded(inference.permutation_p(customers(s, d), "c_custkey", "g", "c_acctbal", 20), 8, "observed", "p"),
    "monte_carlo_chi2": lambda s, d: rounded(inference.monte_carlo_chi2(customers(s, d), "c_custkey", "g", "c_mktsegment", 20), 8, "chi2", "p"),
    "group_table": lambda s, d: rounded(inference.group_table(table(s, d, "customer").withColumn("key", F.col("c_custkey").cast("double")), "c_mktsegment", ["c_acctbal", "key"]), 6, "mean", "sd"),
    "comparison_table": lambda s, d: rounded(inference.comparison_table(by_nation(s, d), segments(s, d), GROUPS), 6, "statistic", "effect", "p", "q"),
    "heatmap_data": heat,
    "level_proportion": lambda s, d: rounded(inference.level_shares(table(s, d, "events"), "user_id", "event_type"), 8, "share"),
    "contingency": lambda s, d: match.contingency(table(s, d, "orders"), "o_orderstatus", "o_orderpriority"),
}

SCALE_SQL = "with s as (select {} as c, {} as w from customer) select c_custkey as id, round((c_acctbal - c) / w, 8) as value from customer, s"
YJ = "case when c_acctbal >= 0 then case when abs(l) < 1e-9 then ln(1 + c_acctbal) else (pow(c_acctbal + 1, l) - 1) / l end else case when abs(l - 2) < 1e-9 then -ln(1 - c_acctbal) else -(pow(1 - c_acctbal, 2 - l) - 1) / (2 - l) end end"
ORACLES = {
    "skew_g1": "select event_type, round(skewness(value), 6) as skew from events group by 1",
    "yeo_johnson": f"select c_custkey, round({YJ}, 6) as y from customer, (select 0.3::double as l)",
    "yj_grid": f"with g as (select -2 + 0.2::double * k as l from range(0, 21) t(k)), y as (select l, {YJ} as y, sign(c_acctbal) * ln(1 + abs(c_acctbal)) as j from customer, g) select round(l, 5) as \"lambda\", round(-count(*) / 2.0::double * ln(var_pop(y)) + (l - 1) * sum(j), 5) as ll from y group by l",
    "standard_scale": SCALE_SQL.format("avg(c_acctbal)", "stddev_pop(c_acctbal)"),
    "minmax_scale": SCALE_SQL.format("min(c_acctbal)", "max(c_acctbal) - min(c_acctbal)"),
    "robust_scale": SCALE_SQL.format("quantile_cont(c_acctbal, 0.5)", "quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)"),
    "knn_impute": knn_sql(""),
    "knn_impute_ref": knn_sql("and id in (select s_suppkey from supplier where s_nationkey < 13)").replace("and id <> donor ", ""),
    "ordinal_encode": "select o_orderkey as id, (substr(o_orderpriority, 1, 1)::bigint - 1) as code from orders",
    "one_hot": f"with e as (select event_id, case when event_id % 9 = 0 then null else event_type end as t from events) select event_id, case when t is null then 'event_type_nan' else 'event_type_' || t end as indicator from e where t is null or t <> (select min(event_type) from ({EVENT_TYPES}))",
    "dense_codes": "select distinct p_type, dense_rank() over (order by p_type) - 1 as code from part",
    "z_vs_control": "select c_custkey, round((c_acctbal - m) / sd, 8) as z from customer, (select avg(c_acctbal) as m, stddev_samp(c_acctbal) as sd from customer where c_mktsegment = 'BUILDING')",
    "corr_block": f"with {CORR_SQL} select f, g, round(r, 8) as r from c",
    "top_correlates": f"with {CORR_SQL}, k as (select f, g, round(r, 8) as r, row_number() over (partition by f order by round(r, 8) desc, g)::int as place from c) select * from k where place <= 2",
    "latent_variance": "with e as (select k, avg(embedding[k + 1]::double) as mean, var_pop(embedding[k + 1]::double) as v from embeddings, range(0, 64) t(k) group by k) select 'd' || k as feature, round(mean, 8) as mean, round(v / (select sum(v) from e), 8) as share from e",
    "bh_fdr": f"with {P_SQL}, {BH_SQL} select n_nationkey, round(p, 8) as p, family, round(q, 8) as q from q",
    "chi_square": f"with {CHI_SQL} select n::bigint as n, round(chi2, 6) as chi2, df::bigint as df, round(sqrt(chi2 / (n * m)), 6) as cramers_v from x",
    "cohens_d": f"with {LONG_SQL} select variable, round((m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)), 8) as d from t",
    "welch_t": f"with {LONG_SQL} select variable, round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 6) as t, round(pow(v0 / n0 + v1 / n1, 2) / (pow(v0 / n0, 2) / (n0 - 1) + pow(v1 / n1, 2) / (n1 - 1)), 6) as df from t",
    "eta_squared": "with m as (select c_mktsegment, count(*) as n, avg(c_acctbal) as m from customer group by 1), g as (select avg(c_acctbal) as g, var_pop(c_acctbal) * count(*) as t from customer) select 'c_acctbal' as variable, round(sum(n * (m - g) * (m - g)) / max(t), 8) as eta2 from m, g",
    "perm_pvalue": "with o as (select c_custkey as id, (c_nationkey < 12)::int as g, c_acctbal as v from customer), " + perm_sql("perm", "z as (select b, avg(case when g = 1 then v end) - avg(case when g = 0 then v end) as d from dealt group by b), s as (select avg(case when g = 1 then v end) - avg(case when g = 0 then v end) as observed from o)") + " select round(observed, 8) as observed, round((sum(case when abs(d) >= abs(observed) - 1e-9 then 1 else 0 end) + 1) / (count(*) + 1), 8) as p from z, s group by observed",
    "monte_carlo_chi2": "with o as (select c_custkey as id, (c_nationkey < 12)::int as g, c_mktsegment as v from customer), " + perm_sql("mc", MC_CHI("dealt", "n", "b") + ", " + MC_CHI("o", "s", "0")) + " select round(sx.chi2, 8) as chi2, round((sum(case when nx.chi2 >= sx.chi2 - 1e-9 then 1 else 0 end) + 1) / (count(*) + 1), 8) as p from nx, sx group by sx.chi2",
    "group_table": "with l as (select c_mktsegment as level, 'c_acctbal' as variable, c_acctbal as v from customer union all select c_mktsegment, 'key', c_custkey::double from customer) select variable, level, count(v) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd from l group by grouping sets ((variable, level), (variable))",
    "heatmap_data": "with g as (select c_mktsegment as level, avg(c_acctbal) as c_acctbal, avg(c_custkey::double) as c_custkey, avg(case when c_nationkey % 5 = 0 then 1.0::double else 0.0::double end) as europe from customer group by 1), l as (unpivot g on c_acctbal, c_custkey, europe into name variable value value) select variable, level, round(value, 6) as value, round((value - avg(value) over w) / stddev_samp(value) over w, 6) as z from l window w as (partition by variable)",
    "level_proportion": "select user_id, event_type, count(*) as n, round(count(*)::double / sum(count(*)) over (partition by user_id)::double, 8) as share from events group by user_id, event_type",
    "contingency": "select s.o_orderstatus, p.o_orderpriority, count(o.o_orderkey) as n from (select distinct o_orderstatus from orders) s cross join (select distinct o_orderpriority from orders) p left join orders o on o.o_orderstatus = s.o_orderstatus and o.o_orderpriority = p.o_orderpriority group by all",
}
