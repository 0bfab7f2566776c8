"""Queries over cleaning, joins, aggregation, reshaping and assembly."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..operators import clean, features, longitudinal, match
from ..sources import tables as sources
from ..sources.tables import table


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def values(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


#: A small dictionary.
DICTIONARY = [("size", "1=tiny;2=small;3=medium"), ("brand", "0 = no; 1 = yes; -900=missing;-9=unknown"), ("free", None), ("one", "1=only"), ("seg", "BUILDING=B; HOUSEHOLD = H;note"), ("none", "-9=a;-3=b"), ("type", "0=even;1=a;1=b;2=c")]
NOTES_SQL = "n(name, notes) as (values ('size', '1=tiny;2=small;3=medium'), ('brand', '0 = no; 1 = yes; -900=missing;-9=unknown'), ('free', null), ('one', '1=only'), ('seg', 'BUILDING=B; HOUSEHOLD = H;note'), ('none', '-9=a;-3=b'), ('type', '0=even;1=a;1=b;2=c'))"
CODES_SQL = "c as (select name, pos, trim(split_part(p, '=', 1)) as code, trim(split_part(p, '=', 2)) as label from (select name, unnest(string_split(part, ';')) as p, generate_subscripts(string_split(part, ';'), 1) as pos from (select name, case when strpos(notes, '-900') > 0 then left(notes, strpos(notes, '-900') - 1) else notes end as part from n)) where contains(p, '=')), k as (select * exclude (pos, nth) from (select *, count(*) over (partition by name) as n_codes, bool_and(code in ('-900', '-300', '-7', '-998', '-997', '-9', '-3')) over (partition by name) as uncoded, row_number() over (partition by name, code order by pos) as nth from c) where nth = 1)"


def notes(s):
    return values(s, "name string, notes string", *DICTIONARY)


def recoded(s, d):
    """Whole maps, one that is whole but for missing codes, and one with a value left over."""
    codes = clean.parse_notes(notes(s))
    p = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.expr("case when p_partkey % 9 = 0 then '-9' when p_partkey % 10 = 0 then null else cast(p_size % 3 + 1 as string) end").alias("size"), (F.col("p_size") % 4).cast("string").alias("brand"), F.lit("BUILDING").alias("seg"), (F.col("p_size") % 2).cast("string").alias("type"))
    return clean.recode(p.unpivot(["id"], ["size", "brand", "seg", "type"], "name", "value").select("name", "id", "value"), codes)


def gappy_events(s, d):
    return table(s, d, "events").select("event_id", F.expr("case when event_id % 7 = 0 then null else value end").alias("a"), F.expr("case when event_id % 2 = 0 then null else user_id end").alias("b"), F.expr("case when event_id % 3 = 0 then null else event_type end").alias("c"))


GAPPY_SQL = "e as (select event_id, case when event_id % 7 = 0 then null else value end as a, case when event_id % 2 = 0 then null else user_id end as b, case when event_id % 3 = 0 then null else event_type end as c from events)"


def units(s, d):
    at = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("temp"), at("F", "°F", "deg fahrenheit", "Celsius", "FAH", None).alias("temp_unit"), F.col("o_totalprice").alias("height"), at("in", "Inches", "internal", "cm", "2 in", "line").alias("height_unit"), F.col("o_totalprice").alias("weight"), at("lbs", "Pounds", "kg", "LB", "g", None).alias("weight_unit"))
    return rounded(clean.standardise(o, {"temperature": ("temp", "temp_unit"), "height": ("height", "height_unit"), "weight": ("weight", "weight_unit")}), 6, "temp", "height", "weight")


def typed(s, d):
    c = table(s, d, "customer").select("c_acctbal", "c_mktsegment", (F.col("c_nationkey") % 2).alias("flag"), (F.col("c_nationkey") % 3).alias("three"), (F.col("c_custkey") > 5).alias("logical"), F.lit("same").alias("single"), F.when(F.col("c_nationkey") > 4, "a").otherwise("b").alias("two"), F.lit(None).cast("double").alias("none"), F.when(F.col("c_nationkey") > 4, 3).otherwise(7).alias("far"))
    return clean.variable_types(c, c.columns)


LEVEL = "case p_brand when 'Brand#11' then (case when p_size % 2 = 0 then 'high' else 'Low' end) when 'Brand#12' then (case when p_size % 2 = 0 then 'No' else 'YES' end) when 'Brand#13' then 'only' else p_type || (p_size % 2) end"


def positive(s, d):
    return clean.positive_level(table(s, d, "part").select(F.col("p_brand").alias("variable"), F.expr(LEVEL).alias("level"), F.col("p_partkey").alias("pos")))


def distribution(s, d):
    e = table(s, d, "events")
    sums = e.groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("se"), F.min("value").alias("least"), F.max("value").alias("most"))
    cuts = {f"q{int(1000 * q)}": q for q in (0.025, 0.25, 0.5, 0.75, 0.975)}
    return rounded(sums.join(quantiles(e, ["event_type"], "value", cuts), "event_type", "left"), 6, "mean", "sd", "se", *cuts, "least", "most")


def orders_by_day(s, d):
    return table(s, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"), F.max(F.expr("case when o_orderstatus = 'F' then o_orderkey end")).alias("last_id"))


def events_by_day(s, d):
    return table(s, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n_events"), F.max("event_id").alias("last_id"))


def references(s, d):
    o = table(s, d, "orders").filter("o_orderstatus = 'F'")
    return o.groupBy(F.col("o_custkey").alias("user_id")).agg(F.min(F.col("o_orderdate").cast("date")).alias("ref_date"))


def nearest(s, d):
    e = table(s, d, "events").select("user_id", "event_id", F.col("ts").cast("date").alias("day"))
    return match.nearest_date(e, references(s, d), "user_id", "day", "ref_date", ["event_id"]).select("user_id", "event_id", F.col("gap_days").cast("long").alias("gap_days"))


LINES = list(range(1, 8))


def masked(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("ship"), "l_linenumber")
    wide = li.groupBy("l_orderkey").pivot("l_linenumber", LINES).agg(F.min("ship"))
    wide = wide.select("l_orderkey", *[F.col(str(k)).alias(f"d{k}") for k in LINES], *[((F.col("l_orderkey") + k) % 2).alias(f"m{k}") for k in LINES])
    onset = match.masked_least([f"d{k}" for k in LINES], [f"m{k}" for k in LINES])
    return wide.select("l_orderkey", onset.alias("onset"), F.round(match.years_between(F.lit("2002-01-01").cast("date"), onset), 6).alias("years"))


def two_sources(s, d):
    e = gappy_events(s, d).select("event_id", "a", F.col("b").cast("double").alias("b"))
    one, two = e.filter("event_id % 5 < 4"), e.select("event_id", F.expr("case when event_id % 4 = 0 then null else a + 1 end").alias("a"), F.expr("coalesce(b, -1)").alias("b"))
    return rounded(match.completeness_choice(one, two, "event_id", ["a", "b"]), 6, "a", "b")


def first_orders(s, d, order):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", F.col("o_totalprice").alias("price"), (F.unix_date(F.col("o_orderdate").cast("date")) % 100).cast("double").alias("day"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(order, "o_orderkey"))
    return o.withColumn("r", rank).filter("r = 1").select("id", F.array(F.col("price"), F.col("day")).alias("x"))


def changes(s, d):
    labels = table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 3).alias("label"))
    return longitudinal.change(first_orders(s, d, F.asc("o_orderkey")), first_orders(s, d, F.desc("o_orderkey")), labels)


ORDERS_SQL = "o as (select o_custkey as id, o_orderkey, o_totalprice as p, ((o_orderdate::date - date '1970-01-01') % 100)::double as q from orders), f as (select id, arg_min(p, o_orderkey) as p, arg_min(q, o_orderkey) as q, arg_max(p, o_orderkey) as p2, arg_max(q, o_orderkey) as q2, any_value(c_nationkey % 3) as label from o join customer on id = c_custkey group by id), s as (select avg(p) as mp, stddev_pop(p) as sp, avg(q) as mq, stddev_pop(q) as sq from f), z as (select id, label, (p - mp) / sp as p, (q - mq) / sq as q, (p2 - mp) / sp as p2, (q2 - mq) / sq as q2 from f, s), c as (select label, avg(p) as cp, avg(q) as cq from z group by label), t as (select z.id, z.label, arg_min(c.label, sqrt((p2 - cp) * (p2 - cp) + (q2 - cq) * (q2 - cq))) as later from z, c group by all)"

QUERIES = {
    "scan_filter_project": lambda s, d: table(s, d, "lineitem").filter("l_shipdate >= timestamp'1998-01-01' and l_discount > 0.05").select("l_orderkey", "l_linenumber"),
    "sentinel_null": lambda s, d: clean.sentinels_to_null(table(s, d, "part").select("p_partkey", "p_name", "p_size"), (9, 19), ["p_size"]),
    "recode_notes": recoded,
    "unit_convert": units,
    "not_assessed": lambda s, d: table(s, d, "events").select("event_id", clean.not_assessed_to_null(F.expr("case when event_id % 10 = 0 then 'Not Assessed' else event_type end")).alias("t")),
    "multi_hot_code": lambda s, d: table(s, d, "part").select("p_partkey", *[((F.col("p_size") % k) == 0).cast("int").alias(f"f{k}") for k in (2, 3, 5, 7)]).select("p_partkey", clean.multi_hot({2: "f2", 3: "f3", 5: "f5", 7: "f7"}).alias("code")),
    "combine_yes_no": lambda s, d: table(s, d, "events").select("event_id", clean.combine_detail(F.expr("case when event_id % 3 = 0 then 'No' when event_id % 3 = 1 then 'Yes' end"), F.expr("case when event_id % 2 = 1 then event_type end")).alias("v")),
    "missing_columns": lambda s, d: clean.missing_filter(gappy_events(s, d), ["event_id"], 0.4, 1.0).select("event_id", "a", "c"),
    "missing_rows": lambda s, d: clean.missing_filter(gappy_events(s, d), ["event_id"], 0.6, 0.4).select("event_id", "a", "b", "c"),
    "drop_constant": lambda s, d: clean.drop_constant_columns(table(s, d, "nation").withColumn("same", F.lit(1))).select("n_nationkey", "n_name", "n_regionkey"),
    "drop_empty": lambda s, d: clean.drop_empty_columns(table(s, d, "nation").withColumn("none", F.lit(None).cast("string")).withColumn("blank", F.lit(""))),
    "rows_with_data": lambda s, d: clean.rows_with_data(gappy_events(s, d), ["event_id"]).select("event_id"),
    "shared_ids": lambda s, d: clean.shared_ids([table(s, d, "customer").select(F.col("c_custkey").alias("id")), table(s, d, "orders").select(F.col("o_custkey").alias("id")), table(s, d, "events").select(F.col("user_id").alias("id"))], "id"),
    "variable_types": typed,
    "positive_level": positive,
    "group_flag": lambda s, d: table(s, d, "orders").select("o_orderkey", clean.flag_group(F.expr("nullif(o_orderstatus, 'P')"), "F").alias("g")).filter("g is not null"),
    "test_id_exclusion": lambda s, d: table(s, d, "customer").filter(~F.col("c_name").rlike("[05]$")).join(table(s, d, "nation").filter("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_anti").select("c_custkey"),
    "outer_coalesce": lambda s, d: match.outer_coalesce(orders_by_day(s, d), events_by_day(s, d), ["day"], ["last_id"]).select("day", "n", "n_events", "last_id"),
    "lookup_default": lambda s, d: match.lookup(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderstatus").alias("status")), "c_custkey", "status", [F.col("o_orderkey")], "none"),
    "lookup_broadcast": lambda s, d: table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name"),
    "semi": lambda s, d: table(s, d, "customer").join(table(s, d, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"),
    "anti": lambda s, d: table(s, d, "customer").join(table(s, d, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"),
    "cross": lambda s, d: table(s, d, "region").select("r_name").crossJoin(table(s, d, "orders").select("o_orderpriority").distinct()),
    "prefix_join": lambda s, d: match.prefix_join(table(s, d, "part").select(F.expr("replace(p_brand, '#', '_') || '_' || p_size").alias("name")).distinct(), table(s, d, "part").select(F.expr("replace(p_brand, '#', '_')").alias("variable")).distinct()),
    "nearest_date": nearest,
    "reference_dates": references,
    "earliest_row": lambda s, d: match.first_by(table(s, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type"),
    "first_non_null": lambda s, d: match.first_non_null(table(s, d, "events").withColumn("v", F.expr("case when event_id % 3 = 0 then null else event_id end")).withColumn("t", F.expr("case when event_id % 4 = 0 then null else event_type end")), "user_id", F.struct("ts", "event_id"), ["v", "t"]),
    "completeness_choice": two_sources,
    "row_total_null_aware": lambda s, d: rounded(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("case when l_orderkey % 2 = 0 then null else l_quantity end").alias("a"), F.expr("case when l_orderkey % 3 = 0 then null else l_tax end").alias("b"), F.expr("case when l_orderkey % 5 = 0 then null else l_discount end").alias("c")).select("l_orderkey", "l_linenumber", match.row_total(["a", "b", "c"]).alias("total"), match.row_total(["a", "b", "c"], True).cast("double").alias("filled")), 6, "total", "filled"),
    "masked_min_date": masked,
    "union_ids": lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("id")).union(table(s, d, "orders").select("o_custkey")).distinct().filter("id is not null"),
    "bind_rows": lambda s, d: table(s, d, "region").unionByName(table(s, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_name"), allowMissingColumns=True),
    "intersect_ids": lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("id")).intersect(table(s, d, "events").select("user_id")),
    "except_ids": lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("id")).exceptAll(table(s, d, "events").select("user_id").distinct()),
    "explode_alias": lambda s, d: table(s, d, "part").select("p_partkey", F.explode(F.split(F.col("p_name"), r"\s+")).alias("word")).distinct(),
    "unpivot": lambda s, d: table(s, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation")).unpivot(["c_custkey"], ["c_acctbal", "nation"], "variable", "value"),
    "pivot": lambda s, d: table(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0),
    "top_n": lambda s, d: table(s, d, "events").select("event_type", "event_id", "value", F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("value"), "event_id")).alias("place")).filter("place <= 3"),
    "cumsum": lambda s, d: rounded(table(s, d, "events").groupBy("event_type").agg(F.sum("value").alias("v")).select("event_type", (F.sum("v").over(W.orderBy(F.desc("v")))).alias("upto")), 4, "upto"),
    "dist_summary": distribution,
    "z_within_label": lambda s, d: rounded(features.z_within(table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_acctbal", "c_mktsegment").select("c_custkey", "z"), 8, "z"),
    "composition": lambda s, d: rounded(longitudinal.composition(table(s, d, "customer").select(F.expr("case when c_custkey % 10 = 0 then -1 else c_nationkey % 4 end").alias("label"))), 8, "share"),
    "paired_change": lambda s, d: rounded(changes(s, d), 6, "shift").select("id", "label", "later", "switched"),
    "transitions": lambda s, d: rounded(longitudinal.transitions(changes(s, d)), 8, "share"),
    "entropy_margin": lambda s, d: rounded(longitudinal.uncertainty(table(s, d, "events").select("event_id", F.expr("transform(array(event_id % 7 + 1, event_id % 5 + 1, event_id % 3 + 1), x -> x / ((event_id % 7 + 1 + event_id % 5 + 1 + event_id % 3 + 1) * 1.0D))").alias("p")), "p"), 8, "confidence", "entropy", "margin").drop("p"),
    "confusion": lambda s, d: match.contingency(table(s, d, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("told")), "truth", "told"),
    "class_metrics": lambda s, d: rounded(longitudinal.class_metrics(table(s, d, "labels").select(F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("told"))), 8, "accuracy", "balanced_accuracy", "precision", "recall"),
    "auc": lambda s, d: rounded(longitudinal.auc(table(s, d, "labels").select(F.col("quality").alias("truth"), ((F.col("doc_id") % 17 + F.col("quality") * 5) * 1.0).cast("double").alias("score"))), 8, "auc"),
}

ORACLES = {
    "scan_filter_project": "select l_orderkey, l_linenumber from lineitem where l_shipdate >= timestamp '1998-01-01' and l_discount > 0.05::double",
    "sentinel_null": "select p_partkey, p_name, case when p_size in (9, 19) then null else p_size end as p_size from part",
    "recode_notes": f"with {NOTES_SQL}, {CODES_SQL}, v as (select 'size' as name, p_partkey as id, case when p_partkey % 9 = 0 then '-9' when p_partkey % 10 = 0 then null else (p_size % 3 + 1)::varchar end as value from part union all select 'brand', p_partkey, (p_size % 4)::varchar from part union all select 'seg', p_partkey, 'BUILDING' from part union all select 'type', p_partkey, (p_size % 2)::varchar from part), j as (select v.*, k.label from v left join k on v.name = k.name and v.value = k.code and n_codes >= 2 and not uncoded), f as (select name, bool_and(label is not null) as whole from j where value not in ('-300', '-900', 'N/A', '<NA>', 'NA', '-7', '-997', '-998', '-9', '-3') group by name) select j.name, id, value, case when label is null then value when whole then label else value || '=' || label end as recoded from j join f on j.name = f.name",
    "unit_convert": "with o as (select o_orderkey as id, o_totalprice as v, (['F', '°F', 'deg fahrenheit', 'Celsius', 'FAH', null])[o_orderkey % 6 + 1] as tu, (['in', 'Inches', 'internal', 'cm', '2 in', 'line'])[o_orderkey % 6 + 1] as hu, (['lbs', 'Pounds', 'kg', 'LB', 'g', null])[o_orderkey % 6 + 1] as wu from orders) select id, round(case when contains(lower(tu), 'fah') or contains(lower(tu), '°f') then (v - 32) * 5 / 9 else v end, 6) as temp, 'Celsius' as temp_unit, round(case when contains(lower(hu), 'inch') or regexp_matches(lower(hu), '(^|[^a-z0-9_])in($|[^a-z0-9_])') then v * 2.54::double else v end, 6) as height, 'cm' as height_unit, round(case when contains(lower(wu), 'lb') or contains(lower(wu), 'pound') then v * 0.45359237::double else v end, 6) as weight, 'kg' as weight_unit from orders join o on o_orderkey = id",
    "not_assessed": "select event_id, case when event_id % 10 = 0 then null else event_type end as t from events",
    "multi_hot_code": "select p_partkey, case when p_size % 7 = 0 then 7 when p_size % 5 = 0 then 5 when p_size % 3 = 0 then 3 when p_size % 2 = 0 then 2 end as code from part",
    "combine_yes_no": "select event_id, nullif(replace(case when event_id % 3 = 0 then 'No' when event_id % 3 = 1 then 'Yes' else 'NA' end || ' ' || case when event_id % 2 = 0 then 'NA' else event_type end, 'No NA', 'No'), 'NA NA') as v from events",
    "missing_columns": f"with {GAPPY_SQL} select event_id, a, c from e",
    "missing_rows": f"with {GAPPY_SQL} select * from e where (a is not null)::int + (b is not null)::int + (c is not null)::int >= 2",
    "drop_constant": "select n_nationkey, n_name, n_regionkey from nation",
    "drop_empty": "select n_nationkey, n_name, n_regionkey from nation",
    "rows_with_data": f"with {GAPPY_SQL} select event_id from e where a is not null or b is not null or c is not null",
    "shared_ids": "select c_custkey as id from customer intersect select o_custkey from orders intersect select user_id from events",
    "variable_types": "with c as (select * from customer), t(variable, n, zero_one) as (select 'c_acctbal', count(distinct c_acctbal), bool_and(c_acctbal in (0, 1)) from c union all select 'flag', count(distinct c_nationkey % 2), bool_and(c_nationkey % 2 in (0, 1)) from c union all select 'three', count(distinct c_nationkey % 3), bool_and(c_nationkey % 3 in (0, 1)) from c union all select 'far', count(distinct c_nationkey > 4), false from c), x(variable, n) as (select 'c_mktsegment', count(distinct c_mktsegment) from c union all select 'single', 1 union all select 'two', count(distinct c_nationkey > 4) from c) select variable, case when zero_one then 'binary' else 'continuous' end as kind from t union all select variable, case when n = 2 then 'binary' when n > 2 then 'categorical' end from x union all select 'logical', 'binary' union all select 'none', null",
    "positive_level": f"with r as (select p_brand as variable, {LEVEL} as level, p_partkey as pos from part), l as (select variable, level, min(pos) as pos from r group by all), h as (select variable, arg_min(level, pos) as hit from l where lower(level) in ('1', 'yes', 'true', 'positive', 'present', 'high', 'case', 'chr') group by 1), o as (select variable, list_sort(list(level)) as levels from l group by 1) select o.variable, case when len(levels) > 1 then coalesce(hit, levels[2]) end as level from o left join h using (variable)",
    "group_flag": "select o_orderkey, case o_orderstatus when 'F' then 1 else 0 end as g from orders where o_orderstatus in ('F', 'O')",
    "test_id_exclusion": "select c_custkey from customer where not regexp_matches(c_name, '[05]$') and c_nationkey not in (select n_nationkey from nation where n_regionkey = 0)",
    "outer_coalesce": "with o as (select o_orderdate::date as day, count(*) as n, max(case when o_orderstatus = 'F' then o_orderkey end) as last_id from orders group by 1), e as (select ts::date as day, count(*) as n_events, max(event_id) as last_id from events group by 1) select coalesce(o.day, e.day) as day, n, n_events, coalesce(o.last_id, e.last_id) as last_id from o full join e on o.day = e.day",
    "lookup_default": "select c_custkey, coalesce((select arg_min(o_orderstatus, o_orderkey) from orders where o_custkey = c_custkey), 'none') as status from customer",
    "lookup_broadcast": "select c_custkey, n_name from customer left join nation on c_nationkey = n_nationkey",
    "semi": "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')",
    "anti": "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')",
    "cross": "select r_name, o_orderpriority from region cross join (select distinct o_orderpriority from orders)",
    "prefix_join": "with n as (select distinct replace(p_brand, '#', '_') || '_' || p_size as name from part), v as (select distinct replace(p_brand, '#', '_') as variable from part) select name, variable from n join v on name = variable or starts_with(name, variable || '_')",
    "nearest_date": "with r as (select o_custkey as user_id, min(o_orderdate::date) as ref from orders where o_orderstatus = 'F' group by 1), j as (select e.user_id, event_id, abs(date_diff('day', ref, ts::date)) as gap, row_number() over (partition by e.user_id order by abs(date_diff('day', ref, ts::date)), ts::date, event_id) as k from events e join r on e.user_id = r.user_id) select user_id, event_id, gap as gap_days from j where k = 1",
    "reference_dates": "select o_custkey as user_id, min(o_orderdate::date) as ref_date from orders where o_orderstatus = 'F' group by 1",
    "earliest_row": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as k from events) where k = 1",
    "first_non_null": "select user_id, arg_min(case when event_id % 3 = 0 then null else event_id end, (ts, event_id)) filter (where event_id % 3 <> 0) as v, arg_min(event_type, (ts, event_id)) filter (where event_id % 4 <> 0) as t from events group by user_id",
    "completeness_choice": f"with {GAPPY_SQL}, o as (select event_id, a, b::double as b from e where event_id % 5 < 4), t as (select event_id, case when event_id % 4 = 0 then null else a + 1 end as a, coalesce(b::double, -1) as b from e), n as (select (select count(a) from o) >= (select count(a) from t) as pa, (select count(b) from o) >= (select count(b) from t) as pb) select event_id, round(case when pa then coalesce(o.a, t.a) else coalesce(t.a, o.a) end, 6) as a, round(case when pb then coalesce(o.b, t.b) else coalesce(t.b, o.b) end, 6) as b from t full join o using (event_id), n",
    "row_total_null_aware": "with l as (select l_orderkey, l_linenumber, case when l_orderkey % 2 = 0 then null else l_quantity end as a, case when l_orderkey % 3 = 0 then null else l_tax end as b, case when l_orderkey % 5 = 0 then null else l_discount end as c from lineitem) select l_orderkey, l_linenumber, round(case when coalesce(a, b, c) is not null then coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) end, 6) as total, round(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0), 6)::double as filled from l",
    "masked_min_date": "with o as (select l_orderkey, min(case when (l_orderkey + l_linenumber) % 2 = 1 then l_shipdate::date end) as onset from lineitem group by 1) select l_orderkey, onset, round(date_diff('day', onset, date '2002-01-01') / 365.25::double, 6) as years from o",
    "union_ids": "select c_custkey as id from customer union select o_custkey from orders",
    "bind_rows": "select r_regionkey, r_name, null::varchar as n_name from region union all select n_regionkey, null, n_name from nation",
    "intersect_ids": "select c_custkey as id from customer intersect select user_id from events",
    "except_ids": "select c_custkey as id from customer except select user_id from events",
    "explode_alias": "select distinct p_partkey, unnest(regexp_split_to_array(p_name, '\\s+')) as word from part",
    "unpivot": "select c_custkey, 'c_acctbal' as variable, c_acctbal as value from customer union all select c_custkey, 'nation', c_nationkey::double from customer",
    "pivot": "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as F, count(*) filter (where o_orderstatus = 'O') as O, count(*) filter (where o_orderstatus = 'P') as P from orders group by 1",
    "top_n": "select event_type, event_id, value, place from (select *, row_number() over (partition by event_type order by value desc, event_id)::int as place from events) where place <= 3",
    "cumsum": "with t as (select event_type, sum(value) as v from events group by 1) select event_type, round(sum(v) over (order by v desc), 4) as upto from t",
    "dist_summary": "select event_type, count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, round(stddev_samp(value) / sqrt(count(value)), 6) as se, " + ", ".join(f"round(quantile_cont(value, {q}), 6) as q{int(1000 * q)}" for q in (0.025, 0.25, 0.5, 0.75, 0.975)) + ", round(min(value), 6) as least, round(max(value), 6) as most from events group by 1",
    "z_within_label": "select c_custkey, round((c_acctbal - avg(c_acctbal) over w) / stddev_samp(c_acctbal) over w, 8) as z from customer window w as (partition by c_mktsegment)",
    "composition": "with l as (select c_nationkey % 4 as label from customer where c_custkey % 10 <> 0) select label, count(*) as n, round(count(*)::double / (select count(*) from l)::double, 8) as share from l group by label",
    "paired_change": f"with {ORDERS_SQL} select id, label, later, label <> later as switched from t",
    "transitions": f"with {ORDERS_SQL}, g as (select a.label, b.label as later from (select distinct label from t) a, (select distinct label from t) b), n as (select label, later, count(*) as n from t group by all) select g.label, g.later, coalesce(n, 0) as n, round(coalesce(n, 0)::double / (sum(coalesce(n, 0)) over (partition by g.label))::double, 8) as share from g left join n on g.label = n.label and g.later = n.later",
    "entropy_margin": "with e as (select event_id, (event_id % 7 + 1)::double as a, (event_id % 5 + 1)::double as b, (event_id % 3 + 1)::double as c from events), p as (select event_id, a / (a + b + c) as a, b / (a + b + c) as b, c / (a + b + c) as c from e), s as (select *, greatest(a, b, c) as m, list_sort([a, b, c])[2] as n from p) select event_id, round(m, 8) as confidence, round(-(a * ln(a) + b * ln(b) + c * ln(c)), 8) as entropy, round(m - n, 8) as margin from s",
    "confusion": "select a.truth, b.told, count(l.doc_id) as n from (select distinct quality as truth from labels) a cross join (select distinct toxic as told from labels) b left join labels l on quality = truth and toxic = told group by all",
    "class_metrics": "with l as (select quality as truth, 1 - toxic as told from labels), c as (select distinct truth as k from l), r as (select k, count(*) filter (where truth = k and told = k)::double as tp, count(*) filter (where truth = k)::double as t, count(*) filter (where told = k)::double as p from l, c group by k) select round((select avg((truth = told)::int::double) from l), 8) as accuracy, round(avg(tp / t), 8) as balanced_accuracy, round(avg(coalesce(tp / nullif(p, 0), 0)), 8) as \"precision\", round(avg(tp / t), 8) as recall from r",
    "auc": "with s as (select quality as truth, ((doc_id % 17 + quality * 5) * 1.0)::double as score from labels), r as (select truth, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0::double as r from s) select round((sum(case when truth = 1 then r end) - count(*) filter (where truth = 1) * (count(*) filter (where truth = 1) + 1) / 2.0::double) / (count(*) filter (where truth = 1) * count(*) filter (where truth = 0)), 8) as auc from r",
}
