"""Queries over recodes of single columns, flags from lists, and the tables behind reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, features, inference, match, quality, report, resample
from ..sources.tables import table
from .cohort import GAPPY_SQL, first_orders, gappy_events, rounded
from .resampling import labels as label_sets
from .resampling import supplier_points

P = 8


def coded(s, d):
    p = table(s, d, "part").select("p_partkey", (F.col("p_size") % 6).alias("item"), (F.col("p_size") - 5).alias("other"))
    return clean.shift_codes(p, ["item", "absent"])


def years(s, d):
    c = table(s, d, "customer")
    return c.select("c_custkey", F.round(clean.months_to_years(F.col("c_custkey")), P).alias("years"), clean.threshold(F.col("c_nationkey"), 3).alias("t"), clean.prefix_group(F.col("c_mktsegment")).alias("site"))


def overridden(s, d):
    return clean.override(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), s.createDataFrame([(1, "X"), (3, None), (-5, "Y")], "o_orderkey long, o_orderstatus string"), "o_orderkey", "o_orderstatus")


def doses(s, d):
    p = table(s, d, "part").select("p_partkey", F.expr("case when p_size % 5 = 0 then -3 when p_size % 7 = 0 then -300 else p_size end").alias("Dose_a"), F.expr("case when p_size % 3 = 0 then -3 else p_size end").alias("plain"), F.expr("case when p_size % 4 = 0 then -300.0D else p_retailprice end").alias("on_MED"))
    return clean.sentinels_to_null(clean.rewrite_by_name(p, ["dose", "med"], (-3, -300), 0), (-3, -300), ["Dose_a", "plain", "on_MED"])


def flagged(s, d):
    o = table(s, d, "orders")
    c = clean.flag_listed(table(s, d, "customer").select("c_custkey"), o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "sample", "Discovery", "Test")
    return clean.flag_listed(c, o.filter("o_orderpriority = '5-LOW' and o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "ineligible")


def special(s, d):
    """Columns of numbers and text with and without codes of not applicable."""
    c = table(s, d, "customer")
    return c.select("c_custkey", F.expr("case when c_custkey % 50 = 0 then -3 else c_nationkey end").alias("a"), F.expr("case when c_custkey % 20 = 1 then '-300' else c_mktsegment end").alias("b"), F.expr("case when c_custkey = 7 then -7.0D else abs(c_acctbal) end").alias("c"), "c_mktsegment")


def usable(s, d):
    o = table(s, d, "orders").select("o_orderstatus", F.expr("case when o_orderkey % 3 = 0 then o_totalprice end").alias("often"), F.expr("case when o_orderkey % 400 = 0 then o_totalprice end").alias("rare"), F.expr("case when o_orderstatus = 'F' then 1 end").alias("one"))
    return clean.usable_tables(o, "o_orderstatus", ["often", "rare", "one"])


def per_view(s, d):
    e = gappy_events(s, d)
    views = clean.missing_filter_views({"u": e.select("event_id", "a", "b"), "v": e.select("event_id", "c", "b")}, ["event_id"], 0.6, 0.5)
    return views["u"].select("event_id", F.lit("u").alias("view")).unionByName(views["v"].select("event_id", F.lit("v").alias("view")))


def split_cohorts(s, d):
    e = gappy_events(s, d)
    one, two = clean.missing_filter_split(e.filter("event_id % 2 = 1"), e.filter("event_id % 2 = 0"), ["event_id"], 0.4, 0.5)
    return one.unionByName(two, allowMissingColumns=True)


def aligned(s, d):
    out, _ = clean.align_schema(table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), "p_name"), ["p_partkey"], ["missing", "size"])
    return out


def best(s, d):
    """Brands as variables; a dictionary that names some, as element or alias, more than once."""
    rows = [("Brand#11", ["Brand#12"], "Mood", 3), ("Brand#12", ["Brand#13", "Brand#11"], "Cognition", 2), ("x", ["Brand#13", "Brand#21"], "Sleep", 1), ("Brand#22", None, "", 5)]
    return report.best_match(table(s, d, "part").select(F.col("p_brand").alias("variable")), s.createDataFrame(rows, "name string, aliases array<string>, modality string, pos int"))


def effects(s, d):
    o = table(s, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return report.attach_effects(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), o, "o_custkey")


LINES = (1, 2, 3)


def onsets(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("ship"), "l_linenumber")
    wide = li.groupBy("l_orderkey").pivot("l_linenumber", list(LINES)).agg(F.min("ship"))
    wide = wide.select("l_orderkey", *[F.col(str(k)).alias(f"d{k}") for k in LINES], *[F.expr(f"case when (l_orderkey + {k}) % 4 = 0 then null else (l_orderkey + {k}) % 2 end").alias(f"a{k}") for k in LINES], *[((F.col("l_orderkey") * k) % 3).alias(f"b{k}") for k in LINES], F.lit("2002-01-01").cast("date").alias("day"))
    names = lambda c: [f"{c}{k}" for k in LINES]
    out = report.onset_variants(names("d"), {"symptoms": [], "lifetime": [names("a")], "past_year": [names("a"), names("b")]}, "day")
    return rounded(wide.select("l_orderkey", *[v.alias(c) for c, v in out.items()]), 6, "symptoms_years", "lifetime_years", "past_year_years")


def skipping(s, d):
    e = table(s, d, "events").select("event_type", F.expr("case when event_id % 5 = 0 then double('NaN') when event_id % 7 = 0 then null else value end").alias("v"))
    return rounded(report.summary_skipping_nan(e, ["event_type"], "v"), 6, "mean", "sd", "least", "most")


def correlates(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("k", "v")).select("id", "k", F.concat(F.lit("d"), "k").alias("feature"), F.col("v").cast("double").alias("value"))
    r = features.correlations(e.filter("k < 4"), e.filter("k >= 32"))
    return rounded(report.top_correlates(r.withColumn("r", F.round("r", 8)), 3), 6, "r")


def changes_by_feature(s, d):
    e = table(s, d, "events").groupBy("event_type", (F.col("user_id") % 7).alias("f")).agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))).alias("change"))
    return rounded(report.top_changes(e.select(F.concat(F.lit("f"), "f").alias("feature"), "change"), 4), 6, "most")


def diagnosed(s, d):
    c = table(s, d, "part").select(F.col("p_partkey").alias("ind"), (F.col("p_size") * 10 + F.col("p_partkey") % 7).alias("rank"))
    scores = table(s, d, "part").select(F.col("p_partkey").alias("ind"), F.explode(F.array(F.lit("u"), F.lit("v"))).alias("view"), F.col("p_retailprice").alias("price")).select("ind", "view", F.when(F.col("view") == "u", F.col("price")).otherwise(-F.col("price")).alias("ari"))
    return report.diagnostics(c, scores, 20)


def axis(s, d):
    o = table(s, d, "orders").groupBy(F.concat_ws(" | ", "o_orderstatus", "o_orderpriority").alias("x")).agg(F.min("o_orderkey").alias("pos"))
    return report.axis_positions(o)


SETS = [(1, "F", 1), (1, "O", 2), (2, "F", 5), (2, "O", 6), (2, "P", 7), (3, "P", 9), (3, "F", 9), (3, "O", 9)]


def dummies(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.expr("case when o_orderkey % 11 = 0 then null else o_orderstatus end").alias("status"), F.expr("case when o_orderkey % 9 = 0 then null else o_orderpriority end").alias("prio"), (F.col("o_totalprice") > 100000).alias("dear"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_totalprice").alias("price"))
    out, _ = features.dummy_code(o, "o_orderkey", s.createDataFrame(SETS, "set_id int, level string, code int"))
    return out.withColumnsRenamed({c: c.replace("-", "_").replace(" ", "_") for c in out.columns})


def joined_views(s, d):
    views = [first_orders(s, d, o) for o in (F.asc("o_orderkey"), F.desc("o_orderkey"))]
    return features.concat_views(views).select("id", *[F.round(F.col("x")[k], 6).alias(f"x{k}") for k in range(4)])


def copies(s, d):
    """Ids that a resample drew more than once, told apart by their draw."""
    drawn = resample.bootstrap(table(s, d, "customer").select("c_custkey"), "c_custkey", "b2")
    return resample.distinct_rows(drawn, "c_custkey", "pos")


def strata(s, d):
    c = table(s, d, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("stratum"), F.col("c_mktsegment").alias("grp"), F.expr("case when c_nationkey % 5 = 4 then 0 else c_custkey % 2 end").alias("lvl"))
    return rounded(inference.monte_carlo_by(c, "c_custkey", "stratum", "grp", "lvl", 8), P, "chi2", "p", "q")


def quality_p(s, d):
    return rounded(quality.permutation_p(supplier_points(s, d), 5), 6, "observed", "null_mean", "null_sd", "p")


def components_of(s, d):
    own = supplier_points(s, d)
    return rounded(quality.component_table({"features": own, "scaled": own.withColumn("x", F.transform("x", lambda v: v * 3.0))}), 6, "value")


def site_chances(s, d, adjusted=()):
    c = table(s, d, "customer").select("c_mktsegment", (F.col("c_nationkey") % 2).alias("site"), (F.col("c_custkey") % 3).alias("recruit"))
    return rounded(inference.predicted_probabilities(c, "c_mktsegment", "site", list(adjusted)), 5, "estimate", "low", "high")


QUERIES = {
    "site_probabilities": site_chances,
    "site_probabilities_adjusted": lambda s, d: site_chances(s, d, ["recruit"]),
    "code_shift": coded,
    "simple_recodes": years,
    "override_rows": overridden,
    "dose_rewrite": doses,
    "listed_flags": flagged,
    "not_applicable": lambda s, d: clean.not_applicable_columns(special(s, d)),
    "usable_tables": usable,
    "relabel": lambda s, d: table(s, d, "orders").select("o_orderkey", clean.relabel(F.col("o_orderstatus"), {"F": "done", "O": "open"}).alias("state")),
    "epoch_number": lambda s, d: table(s, d, "events").select("event_id", clean.epoch(F.col("ts")).alias("ns"), clean.epoch(F.col("ts").cast("date")).alias("day_ns")),
    "append_constants": lambda s, d: clean.append_constants(table(s, d, "region"), [(90, "added"), (91, None)], ["r_regionkey", "r_name"]),
    "view_missing_filter": per_view,
    "cohort_missing_filter": split_cohorts,
    "replay_missing_rows": lambda s, d: clean.rows_by_missing(gappy_events(s, d).select("event_id", "a", "c"), ["event_id"], 0.5),
    "low_cardinality": lambda s, d: s.createDataFrame([(c,) for c in clean.low_cardinality(table(s, d, "part"), ["p_size", "p_partkey"], 50)], "name string"),
    "conditional_rename": lambda s, d: clean.rename_if_present(table(s, d, "region"), {"r_name": "name", "absent": "other"}),
    "align_features": aligned,
    "best_match": best,
    "effects_join": effects,
    "onset_variants": onsets,
    "nan_summary": skipping,
    "first_row_value": lambda s, d: report.first_row_only(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_orderkey")], "o_totalprice"),
    "first_seen": lambda s, d: report.first_seen(table(s, d, "events").select("user_id", "event_id"), "user_id", "event_id"),
    "dictionary_order": lambda s, d: report.dictionary_order(table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("variable")).agg(F.count("*").alias("n")), s.createDataFrame([("5-LOW", 1), ("1-URGENT", 2), ("none", 3), ("5-LOW", 4)], "name string, pos int")),
    "top_correlates": correlates,
    "top_changes": changes_by_feature,
    "diagnostics": diagnosed,
    "axis_positions": axis,
    "dummy_code": dummies,
    "as_matrix": lambda s, d: features.as_matrix(table(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey").select("id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b")),
    "concat_views": joined_views,
    "resample_rows": copies,
    "stratified_tests": strata,
    "quality_permutation": quality_p,
    "quality_components": components_of,
    "nan_free_labels": lambda s, d: match.lookup(table(s, d, "supplier").select(F.col("s_suppkey").alias("id")), label_sets(s, d).filter("boot = 1 and id % 3 > 0"), "id", "label", [F.col("boot")], -1),
}

HERE = "row_number() over (partition by {by} order by md5(concat_ws(':', {key}, '{seed}')), {key})"
POINTS = "p as (select s_suppkey as id, s_nationkey % 3 as label, 0 as k, s_acctbal / 1000.0::double as v from supplier union all select s_suppkey, s_nationkey % 3, 1, s_nationkey::double from supplier)"
#: The composite of point sets: of e (b, id, label, x, y).
QUALITY_SQL = """d as (select a.b, a.id, a.label, c.label as other, avg(sqrt((a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y))) as m from e a join e c on a.b = c.b and a.id <> c.id group by all),
f as (select b, id, label, max(case when other = label then m end) as ina, min(case when other <> label then m end) as outb from d group by all),
sil as (select b, (avg((outb - ina) / greatest(ina, outb)) + 1) / 2 as silhouette from f group by b),
cc as (select b, label, count(*) as n, avg(x) as cx, avg(y) as cy, var_pop(x) + var_pop(y) as v from e group by all),
mm as (select b, avg(x) as mx, avg(y) as my from e group by b),
ch as (select b, c / (c + 1) as calinski_harabasz from (select cc.b, (sum(n * ((cx - mx) * (cx - mx) + (cy - my) * (cy - my))) * (sum(n) - count(*))) / (sum(n * v) * (count(*) - 1)) as c from cc join mm on cc.b = mm.b group by cc.b)),
sp as (select e.b, e.label, cx, cy, avg(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))) as s from e join cc on e.b = cc.b and e.label = cc.label group by all),
db as (select b, 1 / (1 + avg(w)) as davies_bouldin from (select a.b, a.label, max((a.s + c.s) / sqrt((a.cx - c.cx) * (a.cx - c.cx) + (a.cy - c.cy) * (a.cy - c.cy))) as w from sp a join sp c on a.b = c.b and a.label <> c.label group by all) group by b),
q as (select sil.b, silhouette, calinski_harabasz, davies_bouldin, (silhouette + calinski_harabasz + davies_bouldin) / 3 as quality from sil join ch on sil.b = ch.b join db on sil.b = db.b)"""
CHI_SQL = "select {by}, sum(n * n / (nr * nc)) as s, any_value(total) as total, any_value(rows_) as rows_, any_value(cols) as cols from (select *, sum(n) over (partition by {by}, grp) as nr, sum(n) over (partition by {by}, lvl) as nc, sum(n) over (partition by {by}) as total from {cells}) join (select {by}, count(distinct grp) as rows_, count(distinct lvl) as cols from {cells} group by {by}) using ({by}) group by {by}"
ONSET_SQL = ", ".join(f"min(case when {w} then l_shipdate::date end) as {n}_onset, round(date_diff('day', min(case when {w} then l_shipdate::date end), date '2002-01-01') / 365.25::double, 6) as {n}_years" for n, w in (("symptoms", "true"), ("lifetime", "am"), ("past_year", "am and bm")))

ORACLES = {
    # With the factor alone the model is saturated: its chances are the shares.
    "site_probabilities": "with n as (select c_nationkey % 2 as site, c_mktsegment as outcome, count(*)::double as n from customer group by all), p as (select *, n / sum(n) over (partition by site) as p, sum(n) over (partition by site) as whole from n) select 'unadjusted' as model, site::varchar as level, outcome, round(p, 5) as estimate, round(p - 1.959963984540054::double * sqrt(p * (1 - p) / whole), 5) as low, round(p + 1.959963984540054::double * sqrt(p * (1 - p) / whole), 5) as high from p",
    "code_shift": "select p_partkey, case when p_size % 6 <= 3 then p_size % 6 + 1 else p_size % 6 end as item, p_size - 5 as other from part",
    "simple_recodes": "select c_custkey, round(c_custkey / 12.0::double, 8) as years, case when c_nationkey < 3 then 0 when c_nationkey = 3 then 1 else c_nationkey end as t, left(c_mktsegment, 2) as site from customer",
    "override_rows": "select o_orderkey, case o_orderkey when 1 then 'X' when 3 then null else o_orderstatus end as o_orderstatus from orders",
    "dose_rewrite": "select p_partkey, case when p_size % 5 = 0 or p_size % 7 = 0 then 0 else p_size end as \"Dose_a\", case when p_size % 3 = 0 then null else p_size end as plain, case when p_size % 4 = 0 then 0 else p_retailprice end as \"on_MED\" from part",
    "listed_flags": "select c_custkey, case when c_custkey in (select o_custkey from orders where o_orderstatus = 'P') then 'Discovery' else 'Test' end as sample, c_custkey in (select o_custkey from orders where o_orderpriority = '5-LOW' and o_totalprice > 100000) as ineligible from customer",
    "not_applicable": "select 'a' as \"column\" from customer where c_custkey % 50 = 0 having count(*) > 0 union all select 'b' from customer where c_custkey % 20 = 1 having count(*) > 0 union all select 'c' from customer where c_custkey = 7 having count(*) > 0",
    "usable_tables": "with n as (select o_orderstatus, count(*) as n from orders group by 1 order by 1 limit 2) select variable, min(n) > 30 and count(*) = 2 as usable from n, (values ('often'), ('rare'), ('one')) v(variable) group by 1",
    "relabel": "select o_orderkey, case o_orderstatus when 'F' then 'done' when 'O' then 'open' end as state from orders",
    "epoch_number": "select event_id, epoch_us(ts) * 1000 as ns, epoch_us(ts::date::timestamp) * 1000 as day_ns from events",
    "append_constants": "select * from region union all select 90, 'added' union all select 91, null",
    "view_missing_filter": f"with {GAPPY_SQL} select event_id, 'u' as view from e where (a is not null)::int + (b is not null)::int >= 1 union all select event_id, 'v' from e where (c is not null)::int + (b is not null)::int >= 1",
    "cohort_missing_filter": f"with {GAPPY_SQL} select event_id, a, c from e where (a is not null)::int + (c is not null)::int >= 1",
    "replay_missing_rows": f"with {GAPPY_SQL} select event_id, a, c from e where (a is not null)::int + (c is not null)::int >= 1",
    "low_cardinality": "select 'p_size' as name from part having count(distinct p_size) <= 50 union all select 'p_partkey' from part having count(distinct p_partkey) <= 50",
    "conditional_rename": "select r_regionkey, r_name as name from region",
    "align_features": "select p_partkey, null::double as missing, p_size::double as size from part",
    "best_match": "with k(variable, modality, pos, name, prio) as (values ('Brand#11', 'Mood', 3, 'Brand#11', 1), ('Brand#12', 'Mood', 3, 'Brand#11', 2), ('Brand#12', 'Cognition', 2, 'Brand#12', 1), ('Brand#13', 'Cognition', 2, 'Brand#12', 2), ('Brand#11', 'Cognition', 2, 'Brand#12', 2), ('Brand#13', 'Sleep', 1, 'x', 2), ('Brand#21', 'Sleep', 1, 'x', 2), ('Brand#22', '', 5, 'Brand#22', 1)), m as (select *, row_number() over (partition by variable order by prio, pos) as r from k) select v.variable, coalesce(nullif(modality, ''), 'Other / Unmapped') as modality, pos, coalesce(name, v.variable) as short from (select distinct p_brand as variable from part) v left join m on v.variable = m.variable and r = 1",
    "effects_join": "with o as (select o_custkey, o_orderstatus, count(*) as n from orders group by all) select c_custkey as o_custkey, c_mktsegment, o_orderstatus, n from customer left join o on c_custkey = o_custkey",
    "onset_variants": f"with l as (select l_orderkey, l_shipdate, (l_orderkey + l_linenumber) % 4 <> 0 and (l_orderkey + l_linenumber) % 2 = 1 as am, (l_orderkey * l_linenumber) % 3 = 1 as bm from lineitem where l_linenumber <= 3 union all select l_orderkey, null, false, false from lineitem) select l_orderkey, {ONSET_SQL} from l group by 1",
    "nan_summary": "select event_type, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as sd, round(min(v), 6) as least, round(max(v), 6) as most, count(v) as n from (select event_type, case when event_id % 5 <> 0 and event_id % 7 <> 0 then value end as v from events) group by 1",
    "first_row_value": "select o_custkey, o_orderkey, case when o_orderkey = min(o_orderkey) over (partition by o_custkey) then o_totalprice end as o_totalprice from orders",
    "first_seen": "select user_id, min(event_id) as event_id from events group by 1",
    "dictionary_order": "with n as (select o_orderpriority as variable, count(*) as n from orders group by 1) select variable, n, (row_number() over (order by case variable when '5-LOW' then 1 when '1-URGENT' then 2 else 9 end, variable))::int as place from n",
    "top_correlates": "with e as (select vec_id as id, k, embedding[k + 1]::double as v from embeddings, range(0, 64) t(k)), c as (select 'd' || a.k as f, 'd' || b.k as g, round(corr(a.v, b.v), 8) as r from e a join e b on a.id = b.id and a.k < 4 and b.k >= 32 group by all), t as (select f, 'positive' as side, (row_number() over (partition by f order by r desc, g))::int as place, g, r from c union all select f, 'negative', (row_number() over (partition by f order by r, g))::int, g, r from c) select f, side, place, g, round(r, 6) as r from t where place <= 3",
    "top_changes": "with c as (select event_type, 'f' || (user_id % 7) as feature, avg(case when event_id % 2 = 0 then value else -value end) as change from events group by all) select feature, round(max(abs(change)), 6) as most from c group by 1 order by max(abs(change)) desc, feature limit 4",
    "diagnostics": "select p_partkey as ind, p_size * 10 + p_partkey % 7 as rank, p_retailprice as ari_u, -p_retailprice as ari_v from part order by rank, ind limit 20",
    "axis_positions": "with b as (select o_orderstatus || ' | ' || o_orderpriority as x, o_orderstatus as modality, min(o_orderkey) as pos from orders group by all), o as (select modality, min(pos) as first from b group by 1), a as (select x, b.modality, false as spacer, first, pos from b join o on b.modality = o.modality union all select modality || ' ', modality, true, first, null from o where first < (select max(first) from o)) select x, modality, spacer, sum(case when spacer then 0.25::double else 1.0::double end) over (order by first, pos nulls last) as x_pos from a",
    "dummy_code": "select o_orderkey, (case when o_orderkey % 11 = 0 then null when o_orderstatus = 'F' then 5 when o_orderstatus = 'O' then 6 else 7 end)::double as status, " + ", ".join(f"coalesce((o_orderkey % 9 <> 0 and o_orderpriority = '{v}')::int, 0) as \"prio_{v.replace('-', '_').replace(' ', '_')}\"" for v in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + ", (o_orderkey % 9 = 0)::int as prio_nan, (o_totalprice > 100000)::int as dear, epoch_us(o_orderdate::timestamp) * 1000 as \"at\", o_totalprice as price from orders",
    "as_matrix": "select c_custkey as id, c_nationkey::double as a, c_acctbal as b from customer",
    "concat_views": "with o as (select o_custkey as id, o_orderkey, o_totalprice as p, ((o_orderdate::date - date '1970-01-01') % 100)::double as q from orders) select id, round(arg_min(p, o_orderkey), 6) as x0, round(arg_min(q, o_orderkey), 6) as x1, round(arg_max(p, o_orderkey), 6) as x2, round(arg_max(q, o_orderkey), 6) as x3 from o group by 1",
    "resample_rows": "with r as (select c_custkey, row_number() over (order by md5(concat_ws(':', c_custkey, 'order')), c_custkey) as r from customer), n as (select count(*) as n from customer), b as (select pos, c_custkey from (select pos, ('0x' || substr(md5(concat_ws(':', pos, 'b2')), 1, 8))::bigint % n + 1 as r from n, range(0, (select count(*) from customer)) p(pos)) join r using (r)) select c_custkey, pos, c_custkey || '#' || row_number() over (partition by c_custkey order by pos) as row_id from b",
    "stratified_tests": f"with o as (select c_custkey as id, c_nationkey % 5 as stratum, c_mktsegment as grp, case when c_nationkey % 5 = 4 then 0 else c_custkey % 2 end as lvl from customer), m as (select *, concat_ws(':', stratum, id, b) as key from o, range(1, 9) t(b)), x as (select stratum, b, lvl, {HERE.format(by='stratum, b', key='key', seed='here')} as r from m), y as (select stratum, b, grp, {HERE.format(by='stratum, b', key='key', seed='mc')} as r from m), z as (select stratum * 100 + b as sb, grp, lvl, count(*)::double as n from x join y using (stratum, b, r) group by all), w as (select stratum, grp, lvl, count(*)::double as n from o group by all), nul as (select sb // 100 as stratum, total * (s - 1) as c from ({CHI_SQL.format(by='sb', cells='z')})), seen as (select stratum, total * (s - 1) as c, rows_, cols from ({CHI_SQL.format(by='stratum', cells='w')})), p as (select seen.stratum, seen.c as chi2, (sum(case when nul.c >= seen.c - 1e-9 then 1 else 0 end) + 1.0::double) / (count(*) + 1.0::double) as p from seen join nul on seen.stratum = nul.stratum where rows_ > 1 and cols > 1 group by all), k as (select *, row_number() over (order by p desc, stratum) as k, count(*) over () as m from p), q as (select *, least(1.0::double, min(p * m / (m - k + 1)) over (order by k)) as q from k) select s.stratum, round(chi2, 8) as chi2, round(p, 8) as p, round(q, 8) as q from seen s left join q on s.stratum = q.stratum",
    "quality_permutation": f"with {POINTS}, m as (select *, concat_ws(':', b, k, id) as key from p, range(1, 6) t(b)), h as (select b, k, id, label, {HERE.format(by='b, k', key='key', seed='here')} as r from m), t as (select b, k, v, {HERE.format(by='b, k', key='key', seed='quality')} as r from m), z as (select h.b, id, label, k, v from h join t using (b, k, r) union all select 0, id, label, k, v from p), e as (select b, id, label, max(case when k = 0 then v end) as x, max(case when k = 1 then v end) as y from z group by all), {QUALITY_SQL} select round(o.quality, 6) as observed, round(avg(q.quality), 6) as null_mean, round(stddev_pop(q.quality), 6) as null_sd, round((sum(case when q.quality >= o.quality - 1e-12 then 1 else 0 end) + 1.0::double) / (count(*) + 1.0::double), 6) as p from q, (select quality from q where b = 0) o where q.b > 0 group by o.quality",
    "quality_components": f"with e as (select b, s_suppkey as id, s_nationkey % 3 as label, s_acctbal / 1000.0::double * b as x, s_nationkey::double * b as y from supplier, (values (1.0::double), (3.0::double)) t(b)), {QUALITY_SQL} select case when b = 1 then 'features' else 'scaled' end as space, component, round(value, 6) as value from (unpivot q on silhouette, calinski_harabasz, davies_bouldin, quality into name component value value)",
    "nan_free_labels": "select s_suppkey as id, case when s_suppkey % 3 > 0 then (s_suppkey * s_suppkey + s_suppkey) % 3 else -1 end as label from supplier",
}
