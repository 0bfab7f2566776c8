"""Queries over tables of given margins: Monte-Carlo tests without relabelled rows, and exact tests of any number of levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import demographics, margins, stability
from ..sources.tables import table
from .resampling import BOOTS_SQL, SCORES_SQL, boots

REPLICATES = margins.REPLICATES


def by_nation(s, d):
    """Of each nation's customers: is the balance above 5000 (group), and their segment (level)."""
    return table(s, d, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") > 5000).cast("int").alias("group"), F.col("c_mktsegment").alias("level"))


def over_all(s, d):
    """Two tests over all customers: halves of nations by segment, and segments by the last digit of the key."""
    c = table(s, d, "customer")
    halves = c.select(F.lit("halves").alias("test"), (F.col("c_nationkey") < 12).cast("string").alias("group"), F.col("c_mktsegment").alias("level"))
    return halves.unionByName(c.select(F.lit("digits").alias("test"), F.col("c_mktsegment").alias("group"), (F.col("c_custkey") % 10).cast("string").alias("level")))


def checked(s, d):
    """Of 20,000 replicates of each test: how many break a margin, and whether the mean chi-square is within six standard errors of n df / (n - 1)."""
    tests = margins.stored(margins.tables(over_all(s, d), ["test"]))
    drawn = margins.sampled(tests, ["test"], REPLICATES)
    both = drawn.join(tests.select("test", "n", "df", "in_group", "in_level"), "test")
    wide = F.size("in_level")
    row = lambda i: F.aggregate(F.slice(F.col("cells"), i * wide + 1, wide), F.lit(0).cast("long"), lambda a, b: a + b)
    column = lambda j: F.aggregate(F.filter("cells", lambda _, k: k % wide == j), F.lit(0).cast("long"), lambda a, b: a + b)
    sound = F.forall(F.sequence(F.lit(0), F.size("in_group") - 1), lambda i: row(i) == F.get("in_group", i)) & F.forall(F.sequence(F.lit(0), wide - 1), lambda j: column(j) == F.get("in_level", j))
    found = both.groupBy("test", "n", "df").agg(F.count(F.lit(1)).alias("replicates"), F.sum((~sound).cast("long")).alias("broken"), F.avg("sampled").alias("mean"), F.stddev_samp("sampled").alias("sd"))
    expected = F.col("n") * F.col("df") / (F.col("n") - 1)
    return found.select("test", "n", "df", "replicates", "broken", F.round(expected, 8).alias("expected"), (F.abs(F.col("mean") - expected) <= 6 * F.col("sd") / F.sqrt("replicates")).alias("mean_fits"))


def tested(s, d):
    found = margins.monte_carlo(over_all(s, d), ["test"])
    return found.select("test", "n", F.round("chi2", 6).alias("chi2"), "df", "replicates", ((F.col("p") > 0) & (F.col("p") <= 1)).alias("has_p"))


def strata(s, d):
    rows = by_nation(s, d).withColumn("family", F.col("nation") % 2)
    found = margins.stratified(rows, "nation", ["family"])
    return found.select("family", "nation", "n", F.round("chi2", 6).alias("chi2"), "df", (F.col("q") >= F.col("p") - 1e-12).alias("q_is_no_less"))


def agreement(s, d):
    found = margins.agreement_p(stability.boot_pairs(boots(s, d)))
    return found.select(F.round("observed", 8).alias("observed"), "replicates", ((F.col("p") > 0) & (F.col("p") <= 1)).alias("has_p"))


QUERIES = {
    "margin_draws": checked,
    "monte_carlo_margins": tested,
    "monte_carlo_p": lambda s, d: margins.monte_carlo(over_all(s, d), ["test"]),
    "stratified_margins": strata,
    "agreement_margins": agreement,
    "fisher_levels": lambda s, d: margins.fisher(by_nation(s, d), ["nation"]).select("nation", "n", "groups", "levels", F.round("p", 8).alias("p")),
    "margin_tables": lambda s, d: margins.tables(by_nation(s, d), ["nation"]).select("nation", "n", F.round("chi2", 6).alias("chi2"), "df", F.array_join(F.transform("cells", lambda x: x.cast("string")), ",").alias("cells")),
}

_ALL = "c as (select 'halves' as test, (c_nationkey < 12)::varchar as g, c_mktsegment as l from customer union all select 'digits', c_mktsegment, (c_custkey % 10)::varchar from customer)"
_NATION = "c as (select c_nationkey as test, (c_acctbal > 5000)::int::varchar as g, c_mktsegment as l from customer)"
_CHI = """e as (select test, g, l, count(*)::double as n from c group by all), x as (select test, sum(n)::bigint as n, greatest(0, sum(n) * (sum(n * n / (ng * nl)) - 1)) as chi2, ((count(distinct g) - 1) * (count(distinct l) - 1))::bigint as df
  from (select *, sum(n) over (partition by test, g) as ng, sum(n) over (partition by test, l) as nl from e) group by test)"""
#: Every table of two rows and up to five columns with the margins of a nation, and its chance.
_FISHER = f"""with {_NATION}, s as (select test, l, count(*) as size, sum(g::int) as x from c group by all), w as (select test, l, size, x, row_number() over (partition by test order by l) as j, count(*) over (partition by test) as k from s),
  lg as (select test, sum(size) as n, sum(x) as r, max(k) as k, sum(lgamma(size + 1) - lgamma(x + 1) - lgamma(size - x + 1)) as seen, {", ".join(f"coalesce(max(size) filter (where j = {j}), 0) as s{j}" for j in range(1, 6))} from w group by test),
  a as (select *, unnest(range(0, s1 + 1)) as x1 from lg), b as (select *, unnest(range(0, s2 + 1)) as x2 from a), c3 as (select *, unnest(range(0, s3 + 1)) as x3 from b where x1 + x2 <= r), c4 as (select *, unnest(range(0, s4 + 1)) as x4 from c3 where x1 + x2 + x3 <= r),
  t as (select *, r - x1 - x2 - x3 - x4 as x5 from c4 where r - x1 - x2 - x3 - x4 between 0 and s5),
  v as (select test, n, r, k, seen, {" + ".join(f"lgamma(s{j} + 1) - lgamma(x{j} + 1) - lgamma(s{j} - x{j} + 1)" for j in range(1, 6))} as w from t)
  select test as nation, n::bigint as n, (case when any_value(r) in (0, n) then 1 else 2 end)::int as groups, any_value(k)::int as levels,
    case when any_value(r) in (0, n) or any_value(k) = 1 then null else round(least(1.0, sum(case when w <= seen + 1e-7 then exp(w - (lgamma(n + 1) - lgamma(r + 1) - lgamma(n - r + 1))) else 0 end)), 8) end as p from v group by test, n"""
ORACLES = {
    "margin_draws": f"with {_ALL}, {_CHI} select test, n, df, {REPLICATES}::bigint as replicates, 0::bigint as broken, round(n * df / (n - 1), 8) as expected, true as mean_fits from x",
    "monte_carlo_margins": f"with {_ALL}, {_CHI} select test, n, round(chi2, 6) as chi2, df, {REPLICATES}::bigint as replicates, true as has_p from x",
    "stratified_margins": f"with {_NATION}, {_CHI} select test % 2 as family, test as nation, n, round(chi2, 6) as chi2, df, case when df > 0 then true end as q_is_no_less from x",
    "agreement_margins": f"with {BOOTS_SQL} select round(avg({SCORES_SQL}), 8) as observed, {REPLICATES}::bigint as replicates, true as has_p from s",
    "fisher_levels": _FISHER,
    "margin_tables": f"with {_NATION}, {_CHI}, m as (select a.test, g, l from (select distinct test, g from c) a join (select distinct test, l from c) b on a.test = b.test) select x.test as nation, x.n, round(chi2, 6) as chi2, df, string_agg(coalesce(e.n, 0)::bigint::varchar, ',' order by m.g, m.l) as cells from x join m using (test) left join e using (test, g, l) group by all",
}


def people(s, d):
    """Customers in two and in three groups, with numbers, classes of two and of five levels, and gaps."""
    c = table(s, d, "customer")
    gap = F.expr("case when c_custkey % 17 = 0 then null else c_mktsegment end")
    return c.select((F.col("c_nationkey") < 12).cast("string").alias("two"), F.concat(F.lit("g"), F.col("c_nationkey") % 3).alias("three"), F.expr("case when c_custkey % 13 = 0 then null else c_acctbal end").alias("balance"), F.col("c_custkey").alias("number"), gap.alias("segment"), F.when(F.col("c_acctbal") > 4000, "rich").otherwise("poor").alias("wealth"))


ORDER = [("segment", "Segment"), ("balance", "Balance"), ("absent", "Absent"), ("wealth", "Wealth"), ("number", "Number")]


def compared(group):
    def run(s, d):
        found = demographics.demographic_table(people(s, d), ORDER, group)
        return found.select("position", "label", "level", "place", "group", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round("share", 8).alias("share"), "test", F.round("statistic", 6).alias("statistic"), F.round("effect", 8).alias("effect"))

    return run


def compared_sql(group, first, second):
    """The same from cells and moments; first and second are the parts of the tests that depend on the number of groups."""
    return f"""with c as (select (c_nationkey < 12)::varchar as two, 'g' || c_nationkey % 3 as three, case when c_custkey % 13 = 0 then null else c_acctbal end as balance, c_custkey::double as number, case when c_custkey % 17 = 0 then null else c_mktsegment end as segment,
    case when c_acctbal > 4000 then 'rich' else 'poor' end as wealth from customer), o as (select {group} as g, * from c),
  num as (select g, 'balance' as v, balance as x from o union all select g, 'number', number from o), cls as (select g, 'segment' as v, segment as l from o where segment is not null union all select g, 'wealth', wealth from o),
  m as (select v, g, count(x)::double as n, avg(x) as m, var_samp(x) as s from num where x is not null group by v, g), w as (select v, count(x)::double as n, avg(x) as grand, var_pop(x) * count(x) as total from num group by v),
  t as ({first}), e as ({second}),
  k as (select v, g, l, count(*)::double as n from cls group by all), ch as (select v, sum(n) as n, sum(n) * (sum(n * n / (ng * nl)) - 1) as chi, least(count(distinct g), count(distinct l)) - 1 as q, count(distinct l) as levels
    from (select *, sum(n) over (partition by v, g) as ng, sum(n) over (partition by v, l) as nl from k) group by v),
  tests as (select v, '{"welch_t" if group == "two" else "one_way"}' as test, statistic, effect from t join e using (v) union all select v, case when levels = 2 then 'fisher' else 'chi_square' end, chi, sqrt(chi / (n * q)) from ch),
  lines as (select v, null::varchar as l, 0::bigint as place, g, count(x) as n, avg(x) as m, stddev_samp(x) as s, null::double as share from num group by grouping sets ((v, g), (v))
    union all select v, null, 0, g, count(*), null, null, null from cls group by grouping sets ((v, g), (v))
    union all select a.v, a.l, b.place, a.g, a.n, null, null, a.n::double / b2.n from (select v, l, g, count(*) as n from cls group by grouping sets ((v, l, g), (v, l))) a
      join (select v, l, row_number() over (partition by v order by count(*) desc, l) as place from cls group by v, l) b on a.v = b.v and a.l = b.l join (select v, g, count(*) as n from cls group by grouping sets ((v, g), (v))) b2 on a.v = b2.v and a.g is not distinct from b2.g),
  d(position, v, label) as (values (0::bigint, 'segment', 'Segment'), (1, 'balance', 'Balance'), (2, 'wealth', 'Wealth'), (3, 'number', 'Number')), ok as (select min(n) > 30 and count(*) = 2 as ok from (select g, count(*) as n from o group by g order by g limit 2))
  select position, label, l as level, place, g as "group", lines.n, round(m, 6) as mean, round(s, 6) as sd, round(share, 8) as share, case when place = 0 and g is null then test end as test, round(case when place = 0 and g is null then statistic end, 6) as statistic,
    round(case when place = 0 and g is null then effect end, 8) as effect from lines join d using (v) join tests using (v), ok where ok"""


_PAIR = "(select v, max(n) filter (g = 'false') as n0, max(n) filter (g = 'true') as n1, max(m) filter (g = 'false') as m0, max(m) filter (g = 'true') as m1, max(s) filter (g = 'false') as s0, max(s) filter (g = 'true') as s1 from m group by v)"
_ONE_WAY = """select v, (b / (k - 1)) / (1 + 2 * (k - 2) / (k * k - 1) * lam) as statistic from (select v, k, sum(w * (m - swm / sw) * (m - swm / sw)) as b, sum((1 - w / sw) * (1 - w / sw) / (n - 1)) as lam
  from (select v, n, m, n / s as w, sum(n / s) over (partition by v) as sw, sum(n / s * m) over (partition by v) as swm, (count(*) over (partition by v))::double as k from m) group by v, k)"""
QUERIES |= {
    "demographic_two": compared("two"),
    "demographic_three": compared("three"),
    "demographic_p": lambda s, d: demographics.demographic_table(people(s, d), ORDER, "three").filter("test is not null").select("variable", "test", F.round("p", 8).alias("p"), F.round("q", 8).alias("q"), "shown"),
}
ORACLES |= {
    "demographic_two": compared_sql("two", f"select v, (m0 - m1) / sqrt(s0 / n0 + s1 / n1) as statistic from {_PAIR}", f"select v, (m1 - m0) / sqrt(((n0 - 1) * s0 + (n1 - 1) * s1) / (n0 + n1 - 2)) as effect from {_PAIR}"),
    "demographic_three": compared_sql("three", _ONE_WAY, "select v, sum(m.n * (m - grand) * (m - grand)) / any_value(total) as effect from m join w using (v) group by v"),
}
