"""Queries that write files into the shared folder and read them by the readers of a cohort's files; streams over such files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import tables as sources
from ..sources.store import shared_dir
from ..sources.tables import table
from ..streaming import latest

PEOPLE = "c_custkey long, c_name string, c_acctbal double"


def folder(s) -> str:
    return f"{shared_dir(s)}/loomfold-files-{uuid.uuid4().hex}"


def people(s, d):
    return table(s, d, "customer").select("c_custkey", F.expr("case when c_custkey % 10 = 0 then 'NaN' when c_custkey % 10 = 1 then '' else c_name end").alias("c_name"), "c_acctbal")


def csv_scan(s, d):
    return sources.read_csv(s, sources.write_dated(people(s, d), folder(s), "baseline", "2024-01-02"), PEOPLE)


def registry(s, d):
    """By path, by base name and by frame: three sources of one registry."""
    root = folder(s)
    sources.write_dated(table(s, d, "region").select("r_name"), root, "baseline", "a", "regions")
    names = sources.Registry(s, f"{root}/baseline")
    names.add("nations", table(s, d, "nation").select(F.col("n_name").alias("r_name")))
    return names.read("regions_a").unionByName(names.read(f"{root}/baseline/regions_a")).unionByName(names.read("nations"))


def listed(s, d):
    root = folder(s)
    table(s, d, "orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").option("header", True).csv(root)
    return sources.list_files(s, root).select(F.regexp_extract("path", r"o_orderstatus=([^/]+)/", 1).alias("status")).distinct()


def header(s, d):
    path = sources.write_dated(table(s, d, "customer"), folder(s), "baseline", "a")
    return s.createDataFrame([(c,) for c in sources.header_columns(s, path, ["c_name", "absent", "c_acctbal"])], "name string")


def newest(s, d):
    root = folder(s)
    for k, day in enumerate(("30.12.2022", "01.02.2023", "28.01.2023")):
        sources.write_dated(table(s, d, "nation").filter(F.col("n_nationkey") % 3 == k).select("n_nationkey"), root, "baseline", f"{day}.csv", "meta")
        sources.write_dated(table(s, d, "region").select(F.col("r_regionkey").alias("n_nationkey")), root, "baseline", f"{day}.csv", "other")
    return sources.newest_table(s, root, "meta", "n_nationkey long")


def generations(s, d):
    root = folder(s)
    for fold, gen in ((0, 1), (0, 2), (1, 1)):
        sources.write_generation(table(s, d, "supplier").filter(F.col("s_suppkey") % 3 == fold + gen - 1).select("s_suppkey"), root, fold, gen)
    return sources.read_generations(s, root).filter("fold = 0").select("s_suppkey", F.col("fold").cast("int").alias("fold"), F.col("gen").cast("int").alias("gen"))


def streamed(s, d, result, keys):
    root = folder(s)
    table(s, d, "events").write.parquet(f"{root}/in")
    stream = s.readStream.schema(table(s, d, "events").schema).parquet(f"{root}/in")
    return latest.run_once(result(stream), f"{root}/out", keys)


QUERIES = {
    "csv_scan": csv_scan,
    "csv_registry": registry,
    "csv_files": listed,
    "csv_header": header,
    "newest_table": newest,
    "generation_store": generations,
    "stream_earliest": lambda s, d: streamed(s, d, lambda e: latest.earliest_dates(e.withColumn("day", F.col("ts").cast("date")), "user_id", "day"), ["user_id"]),
    "stream_windows": lambda s, d: streamed(s, d, lambda e: latest.windowed_counts(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type"), ["start", "event_type"]).select(F.col("start").cast("date").alias("day"), "event_type", "count"),
}

ORACLES = {
    "csv_scan": "select c_custkey, case when c_custkey % 10 > 1 then c_name end as c_name, c_acctbal from customer",
    "csv_registry": "select r_name from region union all select r_name from region union all select n_name from nation",
    "csv_files": "select distinct o_orderstatus as status from orders",
    "csv_header": "select column_name as name from (describe customer) where column_name in ('c_name', 'absent', 'c_acctbal')",
    "newest_table": "select n_nationkey from nation where n_nationkey % 3 = 1",
    "generation_store": "select s_suppkey, 0 as fold, (s_suppkey % 3 + 1)::int as gen from supplier where s_suppkey % 3 < 2",
    "stream_earliest": "select user_id, min(ts::date) as ref_date from events group by 1",
    "stream_windows": "select ts::date as day, event_type, count(*) as count from events group by all",
}
