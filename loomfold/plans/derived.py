"""Queries over notes, paths, folds and genes that are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, inference, report, search
from ..sources import tables as sources
from ..sources.tables import table
from .cohort import CODES_SQL
from .files import folder


def notes(s, d):
    """A note for each brand: the containers of its parts by size; some codes are told twice, some notes go on after -900."""
    p = table(s, d, "part").select(F.col("p_brand").alias("name"), F.concat((F.col("p_size") % 4).cast("string"), F.lit(" = "), "p_type").alias("pair")).distinct()
    told = p.groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("pair")), ";").alias("notes"))  # few sizes and containers
    return told.withColumn("notes", F.concat("notes", F.when(F.col("name").endswith("3"), ";-900=missing;5=late").when(F.col("name").endswith("4"), ";-9=unknown").otherwise(";x")))


NOTES_SQL = """n as (select p_brand as name, string_agg(p, ';' order by p) || case when p_brand like '%3' then ';-900=missing;5=late' when p_brand like '%4' then ';-9=unknown' else ';x' end as notes
  from (select distinct p_brand, (p_size % 4)::varchar || ' = ' || p_type as p from part) group by p_brand)"""


def shown(s, d):
    """A shown p-value for each order, or a text that is none."""
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, F.lit("<0.001")).when(k % 5 == 1, F.lit(">0.99")).when(k % 5 == 2, F.concat(F.lit(" 0."), F.lpad((k % 1000).cast("string"), 3, "0"))).when(k % 5 == 3, F.col("o_orderpriority"))
    return table(s, d, "orders").select("o_orderkey", clean.parse_p(text).alias("p"))


def paths(s, d):
    """A path for each page: dated ones, versions in numbered folders, and ones that are left out."""
    k = F.col("page_id")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k * 7919 % 1500).cast("int")), "dd.MM.yyyy")
    base = F.concat(F.lit("b"), (k % 20).cast("string"))
    dated, version = F.concat(F.lit("/r/"), base, F.lit("_"), day, F.lit(".csv")), F.concat(F.lit("/r/csv/"), (k * 31 % 97).cast("string"), F.lit("/"), base, F.lit(".csv"))
    path = F.when(k % 4 == 0, version).when(k % 4 == 1, F.concat(F.lit("/r/basetable/"), base, F.lit("_"), day, F.lit(".csv"))).otherwise(dated)
    return sources.file_parts(table(s, d, "pages").select(path.alias("path")))


_DAY = "(date '2020-01-01' + (page_id * 7919 % 1500)::int)"
_FILES = f"f as (select 'b' || page_id % 20 as base, {_DAY} as dated, page_id * 31 % 97 as version, page_id % 4 as kind from pages)"


def dictionary(s, d):
    """A dictionary with an entry for each part: every third has aliases, four of five are included."""
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    alias = F.when(k % 3 == 0, F.concat(F.lit("a"), key, F.lit(", b"), key))
    columns = [F.concat(F.lit("v"), key), F.col("p_name"), alias, F.when(k % 5 == 0, "No").when(k % 5 == 1, "yes").otherwise("Yes"), F.lit("No"), F.when(k % 2 == 0, "num").otherwise("cat"), F.col("p_brand"), F.when(k % 2 == 1, F.concat(F.lit("0="), "p_brand", F.lit(";1="), "p_type"))]
    return table(s, d, "part").select(*[c.alias(n) for c, n in zip(columns, sources.DICTIONARY, strict=True)])


def dictionary_read(s, d):
    path = sources.write_dated(dictionary(s, d), folder(s), "meta", "a")
    return sources.read_dictionary(s, path).select("ElementName", "Aliases", "Modality", "Notes")


_ENTRIES = "e as (select p_partkey as k, 'v' || p_partkey as name, case when p_partkey % 3 = 0 then 'a' || p_partkey || ', b' || p_partkey end as aliases, p_brand as modality, case when p_partkey % 2 = 1 then '0=' || p_brand || ';1=' || p_type end as notes from part)"
DOMAINS = {"k_u": [2, 3], "linkage_u": ["a", "b"], "k_v": [4, 5], "linkage_v": ["c", "d"], "pre_linkage": ["e"], "k_final": [2, 3], "fusion": ["agreement", "consensus"]}


def genes(s, d, domains, seed):
    """A candidate for each customer."""
    return search.configured(table(s, d, "customer").select(F.col("c_custkey").alias("ind")), "ind", domains, seed)


def decoded(s, d):
    out = report.decode_genes(genes(s, d, DOMAINS, "dg"), ["u", "v"])
    return out.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("ks", "linkages")})


def draw(gene, options, seed):
    return f"({options})[('0x' || substr(md5(concat_ws(':', c_custkey, '{gene}', '{seed}')), 1, 8))::bigint % {len(options)} + 1]"


def told_folds(s, d):
    """The choice of a fold for each order."""
    return table(s, d, "orders").select((F.col("o_custkey") % 5).alias("k"), F.col("o_orderpriority").alias("linkage"), (F.col("o_orderkey") % 7 % 3).alias("k_final"), F.array("o_orderstatus", F.col("o_orderpriority")).alias("views"))


def crossed(s, d):
    k = F.col("s_suppkey")
    child = search.crossover(F.sequence(k, k + 4), F.sequence(F.col("s_nationkey").cast("long"), F.col("s_nationkey") + F.lit(4).cast("long")), (k % 6).cast("int"))
    return table(s, d, "supplier").select(k.alias("id"), F.array_join(F.transform(child, lambda x: x.cast("string")), ",").alias("genes"))


def differences(s, d):
    """Effects and rates of two comparisons, from the orders of each priority."""
    o = table(s, d, "orders").filter("o_orderstatus in ('F', 'O')").groupBy(F.col("o_orderstatus").alias("comparison"), F.col("o_orderpriority").alias("variable"))
    tests = o.agg(((F.sum("o_orderkey") % 401 - 200) / 100.0).alias("effect"), ((F.sum("o_custkey") % 1001) / 1000.0).alias("q"))
    return inference.differences_summary(tests, ["F", "O"])


QUERIES = {
    "parse_notes": lambda s, d: clean.parse_notes(notes(s, d)),
    "categorical_infer": lambda s, d: notes(s, d).select("name", clean.is_categorical(F.col("notes")).alias("categorical")),
    "parse_p": shown,
    "latest_file": lambda s, d: sources.newest(paths(s, d).filter("layout = 'dated'").distinct()).select("path", "base"),
    "latest_version": lambda s, d: sources.newest(paths(s, d).filter("layout = 'versioned'").distinct(), "version").select("base", "version"),
    "dictionary_variables": lambda s, d: sources.variables(dictionary(s, d), ["v3", "other"]).select("ElementName", "Modality", "alias_of"),
    "dictionary_read": dictionary_read,
    "population_init": lambda s, d: genes(s, d, {"k": [2, 3, 4, 5], "linkage": ["average", "complete", "ward"], "fusion": ["agreement", "consensus"]}, "g0"),
    "decode_genes": decoded,
    "mode_params": lambda s, d: search.mode_params(told_folds(s, d), ["k", "linkage", "k_final"]),
    "mode_positions": lambda s, d: search.mode_by_position(told_folds(s, d), "views"),
    "crossover": crossed,
    "diff_summary": differences,
}

_LESS = "('-9', '-99', '999', '-900', '-3', '-7', '-300')"
ORACLES = {
    "parse_notes": f"with {NOTES_SQL}, {CODES_SQL} select name, code, label, n_codes from k where n_codes >= 2 and not uncoded",
    "categorical_infer": f"with {NOTES_SQL} select name, len(list_filter(list_distinct(regexp_extract_all(notes, '(-?\\d+)\\s*=', 1)), lambda x: x not in {_LESS})) >= 2 as categorical from n",
    "parse_p": "select o_orderkey, case o_orderkey % 5 when 0 then 0.001::double when 1 then 0.99::double when 2 then ('0.' || lpad((o_orderkey % 1000)::varchar, 3, '0'))::double end as p from orders",
    "latest_file": f"with {_FILES} select distinct '/r/' || base || '_' || strftime(dated, '%d.%m.%Y') || '.csv' as path, base from (select *, max(dated) over (partition by base) as top from f where kind > 1) where dated = top",
    "latest_version": f"with {_FILES} select base, max(version)::int as version from f where kind = 0 group by base",
    "dictionary_variables": f"with {_ENTRIES}, i as (select * from e where k % 5 <> 0) select name as \"ElementName\", modality as \"Modality\", null::varchar as alias_of from i union all select trim(unnest(string_split(aliases, ','))), modality, name from i union all select x, null, null from (values ('v3'), ('other')) v(x) where x not in (select name from i)",
    "dictionary_read": f"with {_ENTRIES} select name as \"ElementName\", aliases as \"Aliases\", modality as \"Modality\", notes as \"Notes\" from e",
    "population_init": f"select c_custkey as ind, {draw('k', [2, 3, 4, 5], 'g0')} as k, {draw('linkage', ['average', 'complete', 'ward'], 'g0')} as linkage, {draw('fusion', ['agreement', 'consensus'], 'g0')} as fusion from customer",
    "decode_genes": f"select c_custkey as ind, concat_ws(',', {draw('k_u', DOMAINS['k_u'], 'dg')}, {draw('k_v', DOMAINS['k_v'], 'dg')}) as ks, concat_ws(',', {draw('linkage_u', DOMAINS['linkage_u'], 'dg')}, {draw('linkage_v', DOMAINS['linkage_v'], 'dg')}) as linkages, 'e' as pre_linkage, {draw('k_final', DOMAINS['k_final'], 'dg')} as k_final, {draw('fusion', DOMAINS['fusion'], 'dg')} as fusion from customer",
    "mode_params": "with f as (select o_custkey % 5 as k, o_orderpriority as linkage, o_orderkey % 7 % 3 as k_final from orders) select (select k from f group by k order by count(*) desc, k limit 1) as k, (select linkage from f group by linkage order by count(*) desc, linkage limit 1) as linkage, (select k_final from f group by k_final order by count(*) desc, k_final limit 1) as k_final",
    "mode_positions": "select 0 as pos, (select o_orderstatus from orders group by 1 order by count(*) desc, 1 limit 1) as value union all select 1, (select o_orderpriority from orders group by 1 order by count(*) desc, 1 limit 1)",
    "crossover": "select s_suppkey as id, array_to_string(range(s_suppkey, s_suppkey + least(5, s_suppkey % 6)) || range(s_nationkey + least(5, s_suppkey % 6), s_nationkey + 5), ',') as genes from supplier",
    "diff_summary": "with t as (select o_orderstatus as c, o_orderpriority as variable, printf('ES=%.2f; FDR=%.3f', ((sum(o_orderkey) % 401 - 200) / 100.0)::double, ((sum(o_custkey) % 1001) / 1000.0)::double) as shown from orders where o_orderstatus in ('F', 'O') group by all) select variable, min(shown) filter (where c = 'F') as F, min(shown) filter (where c = 'O') as O from t group by variable",
}
