"""URL filter: rules by host and path, else a list of canonical URLs behind a blocked Bloom filter.

A listed URL sets one bit in each of eight 64-bit lanes of one 512-bit block, chosen by a first hash; the bits come
from a second. The filter is a table with a row per block, built by OR, and probed by a join on the block number; up to
MAX_BLOCKS rows (about 5 MB) it is broadcast, beyond that the join is by block. Possible hits go to a hash join on the URL
itself, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, table

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Names of query parameters that do not change a page.
TRACKING = r"utm_.*|ref"
MAX_BLOCKS, BLOCK_BITS, BITS_PER_KEY = 65_536, 512, 20
#: Bytes of listed URLs up to which they are broadcast.
MOST_BYTES = 32 << 20
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path without closing slashes, and the query without tracking and empty parameters; null for what has no host."""
    given = F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    query = F.array_join(F.filter(given, lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(f"(?s)^({TRACKING})$")), "&")
    return F.when(host(url) != "", F.concat(host(url), F.regexp_replace(path(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does. One expression per rule: meant for some hundreds of them."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _lanes(c: Column) -> list[Column]:
    bits = F.xxhash64(c, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * k).bitwiseAND(63).cast("int")) for k in range(8)]


def bloom(listed: DataFrame, n_blocks: int) -> DataFrame:
    """The filter of listed (url): block and lanes l0 to l7."""
    block = F.pmod(F.xxhash64("url"), F.lit(n_blocks)).alias("block")
    return listed.select(block, *[x.alias(f"l{k}") for k, x in enumerate(_lanes(F.col("url")))]).groupBy("block").agg(*[F.bit_or(f"l{k}").alias(f"l{k}") for k in range(8)])


def _is_listed(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """pages (url, ...) with in_list; listed has distinct non-null urls."""
    n, size = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("url")), F.lit(0))).first()
    n_blocks = -(-n * BITS_PER_KEY // BLOCK_BITS) or 1
    blocks, hits = bloom(listed, n_blocks), listed.select(F.col("url").alias("listed_url"), F.lit(True).alias("in_list"))
    probed = pages.withColumn("block", F.pmod(F.xxhash64("url"), F.lit(n_blocks))).join(F.broadcast(blocks) if n_blocks <= MAX_BLOCKS else blocks.hint("merge"), "block", "left")
    possible = F.col("url").isNotNull() & F.col("block").isNotNull()
    for k, x in enumerate(_lanes(F.col("url"))):
        possible = possible & (F.coalesce(F.col(f"l{k}"), F.lit(0)).bitwiseAND(x) == x)
    possible, told = F.coalesce(possible, F.lit(False)), [*pages.columns, F.coalesce("in_list", F.lit(False)).alias("in_list")]
    if size <= MOST_BYTES:
        sought = probed.withColumn("sought", F.when(possible, F.col("url")))
        return sought.join(F.broadcast(hits), F.col("sought") == F.col("listed_url"), "left").select(*told)
    # The pages that the filter stops are not shuffled.
    checked = probed.filter(possible).join(hits, F.col("url") == F.col("listed_url"), "left").select(*told)
    return checked.unionByName(probed.filter(~possible).select(*pages.columns, F.lit(False).alias("in_list")))


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of pages (page_id, url): page_id, host, path, rule, verdict, listed.

    listed (url) holds raw URLs in any form and with repeats. A null url or one without ``://`` has an empty host and path,
    fits no rule, is in no list and is allowed. A url of any length is read whole. Rows that repeat stay; other columns are not read; an empty page
    table gives an empty result and an empty list blocks nothing.
    """
    own = pages.select("page_id", canonical(F.col("url")).alias("url"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    known = listed.select(canonical(F.col("url")).alias("url")).filter("url is not null").distinct()
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    of_list = F.when(F.col("in_list"), F.lit("block")).otherwise("allow")
    return _is_listed(own, known).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, of_list).alias("verdict"), F.col("in_list").alias("listed"))


def query(spark, sf_dir):
    """Blocks what the stated list, every page whose id is divisible by 50, has in canonical form."""
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages.select("page_id", "url"), pages.filter("page_id % 50 = 0").select("url"))


ORACLE_SQL = rf"""
with p as (
  select page_id, url, translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), '{UPPER}', '{LOWER}') as host, coalesce(regexp_extract(url, '{PARTS}', 2), '') as path,
    case when contains(split_part(url, '#', 1), '?') then substr(split_part(url, '#', 1), strpos(url, '?') + 1) else '' end as given
  from pages),
q as (select *, array_to_string(list_filter(string_split(given, '&'), lambda x: x <> '' and split_part(x, '=', 1) <> 'ref' and not starts_with(split_part(x, '=', 1), 'utm_')), '&') as query from p),
c as (select *, case when host <> '' then host || rtrim(path, '/') || case when query <> '' then '?' || query else '' end end as canonical from q),
r(rule_host, rule_path, decided) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f as (select page_id, url, max_by(rule_host || rule_path, length(rule_host || rule_path)) as rule, max_by(decided, length(rule_host || rule_path)) as decided
  from c join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by all)
select c.page_id, c.host, c.path, f.rule, coalesce(f.decided, case when canonical in (select canonical from c where page_id % 50 = 0 and canonical is not null) then 'block' else 'allow' end) as verdict,
  coalesce(canonical in (select canonical from c where page_id % 50 = 0 and canonical is not null), false) as listed
from c left join f on c.page_id = f.page_id and c.url = f.url
"""
