"""Cleaning a subject table: sentinels, dictionary recodes, units, and filters by missing share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Codes that mean missing, codes that mean not applicable, and placeholder dates.
SENTINELS = (-9, -99, 999, -900)
NOT_APPLICABLE = (-3, -7, -300)
PLACEHOLDER_DATES = ("1903-03-03", "1909-09-09", "1901-01-01", "1909-09-01", "1901-09-09")
#: Keys of a note that alone make no recoding; values that a mapping need not have to be whole.
UNCODED_KEYS = ("-900", "-300", "-7", "-998", "-997", "-9", "-3")
UNCODED_VALUES = (*UNCODED_KEYS, "N/A", "<NA>", "NA")
#: Levels, lower-cased, that count as the positive one.
POSITIVE_LEVELS = ("1", "yes", "true", "positive", "present", "high", "case", "chr")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def sentinels_to_null(df: DataFrame, values: Iterable = SENTINELS, columns: Iterable[str] | None = None, numeric_only: bool = True) -> DataFrame:
    """Values in the list become null; text, logical and date columns are left alone unless numeric_only is off."""
    values, chosen = list(values), set(columns if columns is not None else df.columns)

    def clean(f: T.StructField) -> Column:
        if f.name not in chosen or numeric_only and not is_numeric(f.dataType):
            return F.col(f.name)
        listed = values if is_numeric(f.dataType) else [str(v) for v in values]
        return F.when(~F.coalesce(F.col(f.name).isin(listed), F.lit(False)), F.col(f.name)).alias(f.name)

    return df.select(*[clean(f) for f in df.schema])


def placeholder_dates_to_null(c: Column) -> Column:
    return F.when(~c.isin(*[F.lit(d).cast("date") for d in PLACEHOLDER_DATES]), c)


def not_assessed_to_null(c: Column) -> Column:
    return F.when(F.lower(c) != "not assessed", c)


def rename_if_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def parse_notes(dictionary: DataFrame, name: str = "name", notes: str = "notes") -> DataFrame:
    """(name, code, label, n_codes) from notes ``code=label;code=label`` of two pairs at least.

    What stands from -900 on is left out. A code is any text before the first equals sign, its label the text up to the next one. Notes
    whose codes all mean missing give none. A code that a note repeats has its first label; n_codes counts the pairs.
    """
    text = F.regexp_replace(F.coalesce(notes, F.lit("")), r"(?s)-900.*$", "")
    parts = F.filter(F.transform(F.split(text, ";"), lambda p: F.trim(p)), lambda p: p.contains("="))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.split_part(p, F.lit("="), F.lit(1))).alias("code"), F.trim(F.split_part(p, F.lit("="), F.lit(2))).alias("label")))
    rows = dictionary.select(F.col(name).alias("name"), pairs.alias("pairs")).filter(F.size("pairs") >= 2)
    rows = rows.filter(F.exists("pairs", lambda p: ~p["code"].isin(*UNCODED_KEYS)))
    first = F.filter("pairs", lambda p, k: F.array_position(F.col("pairs.code"), p["code"]) == k + 1)
    return rows.select("name", F.size("pairs").cast("long").alias("n_codes"), F.explode(first).alias("p")).select("name", "p.code", "p.label", "n_codes")


def recode(values: DataFrame, codes: DataFrame) -> DataFrame:
    """values (name, id, value) with ``recoded``: the label where all values of the variable have one, missing codes aside, else ``code=label``; unknown codes stay."""
    joined = values.join(codes.select("name", F.col("code").alias("value"), "label"), ["name", "value"], "left")
    full = joined.filter(~F.col("value").isin(*UNCODED_VALUES)).groupBy("name").agg(F.min(F.col("label").isNotNull()).alias("full"))
    mixed = F.when(F.col("label").isNull(), F.col("value")).when(F.coalesce("full", F.lit(True)), F.col("label")).otherwise(F.concat_ws("=", "value", "label"))
    return joined.join(full, "name", "left").select("name", "id", "value", mixed.alias("recoded"))


def is_categorical(notes: Column, sentinels: Iterable = (*SENTINELS, *NOT_APPLICABLE)) -> Column:
    """Whether a note names two codes or more besides sentinels."""
    keys = F.array_distinct(F.regexp_extract_all(F.coalesce(notes, F.lit("")), F.lit(r"(-?\d+)\s*="), F.lit(1)))
    return F.size(F.array_except(keys, F.array(*[F.lit(str(s)) for s in sentinels]))) >= 2


#: Patterns of the units that are converted, and the unit that results.
UNIT_PATTERNS = {"temperature": ("fah|°f|fahrenheit", "Celsius"), "height": ("inch|inches|\\bin\\b", "cm"), "weight": ("lb|pound", "kg")}


def standard_unit(quantity: str, value: Column, unit: Column) -> Column:
    """Fahrenheit to Celsius, inches to centimetres, pounds to kilograms where the unit's pattern is found in any case; else as it is."""
    converted = {"temperature": (value - 32.0) * 5.0 / 9.0, "height": value * 2.54, "weight": value * 0.45359237}[quantity]
    return F.when(F.lower(unit).rlike(UNIT_PATTERNS[quantity][0]), converted).otherwise(value)


def standardise(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """df with values and units of {quantity: (value, unit column)} in standard units; afterwards each row's unit is the standard one."""
    present = {q: c for q, c in columns.items() if set(c) <= set(df.columns)}
    return df.withColumns({v: standard_unit(q, F.col(v), F.col(u)) for q, (v, u) in present.items()} | {u: F.lit(UNIT_PATTERNS[q][1]) for q, (_, u) in present.items()})


def non_empty_counts(df: DataFrame) -> dict[str, int]:
    """Non-null, non-empty values per column, in one pass."""
    filled = [F.count(F.when(F.col(f.name).cast("string") != "", 1)).alias(f.name) for f in df.schema]
    return df.agg(*filled).first().asDict() if df.columns else {}


def drop_empty_columns(df: DataFrame) -> DataFrame:
    counts = non_empty_counts(df)
    return df.select(*[c for c in df.columns if counts[c]])


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Columns of more than one value, null counting as one."""
    aggs = [(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in df.columns]
    kinds = df.agg(*aggs).first().asDict()
    return df.select(*[c for c in df.columns if (kinds[c] or 0) > 1])


def rows_with_data(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(how="all", subset=[c for c in df.columns if c not in keys])


def missing_filter(df: DataFrame, keys: list[str], col_share: float, row_share: float) -> DataFrame:
    """Columns non-null in at least ceil((1 - col_share) n) rows, then rows non-null in at least ceil((1 - row_share) of these)."""
    others = [c for c in df.columns if c not in keys]
    stats = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in others]).first()
    kept = [c for c in others if stats[c] >= -(-((1 - col_share) * stats["_n"]) // 1)]
    return rows_by_missing(df.select(*keys, *kept), keys, row_share)


def rows_by_missing(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    kept = [c for c in df.columns if c not in keys]
    return df.dropna(thresh=int(-(-((1 - share) * len(kept)) // 1)), subset=kept) if kept else df


def missing_filter_split(one: DataFrame, two: DataFrame, keys: list[str], col_share: float, row_share: float) -> tuple[DataFrame, DataFrame]:
    """The same columns for two cohorts: those that pass in both, sorted."""
    passing = [set(missing_filter(d, keys, col_share, 1.0).columns) for d in (one, two)]
    kept = sorted(c for c in passing[0] & passing[1] if c not in keys)
    return tuple(rows_by_missing(d.select(*keys, *kept), keys, row_share) for d in (one, two))


def shared_ids(tables: list[DataFrame], id_col: str) -> DataFrame:
    """Ids that every table has."""
    every = tables[0].select(id_col, F.lit(0).alias("t"))
    for k, t in enumerate(tables[1:], 1):
        every = every.unionByName(t.select(id_col, F.lit(k).alias("t")))
    return every.groupBy(id_col).agg(F.count_distinct("t").alias("n")).filter(F.col("n") == len(tables)).select(id_col)


def low_cardinality(df: DataFrame, columns: list[str], most: int = 5) -> list[str]:
    """Numeric columns of at most so many values, to be treated as categories."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    return [c for c in columns if counts[c] <= most]


def variable_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, kind): numbers are continuous, binary if all are 0 or 1; logicals are binary; text is binary with two levels, categorical with more.

    A column without a value, or of text with one level, has kind null. Two passes of plain aggregates, no distinct values are gathered.
    """
    fields = {f.name: f.dataType for f in df.schema if f.name in columns}
    text = [c for c in columns if not isinstance(fields[c], (T.NumericType, T.BooleanType))]
    seen = df.agg(*[F.min(F.col(c).cast("string")).alias(f"{c}_low") for c in text], *[F.max(F.col(c).cast("string")).alias(f"{c}_high") for c in text], *[F.min(F.col(c).isin(0, 1)).alias(c) for c in columns if is_numeric(fields[c])], *[F.count(c).alias(c) for c in columns if isinstance(fields[c], T.BooleanType)]).first().asDict()
    more = df.agg(F.lit(0).alias("_"), *[F.max(~F.col(c).cast("string").isin(seen[f"{c}_low"], seen[f"{c}_high"])).alias(c) for c in text if seen[f"{c}_low"] != seen[f"{c}_high"]]).first().asDict()

    def kind(c: str) -> str | None:
        if c in text:
            return None if c not in more else "categorical" if more[c] else "binary"
        if isinstance(fields[c], T.BooleanType):
            return "binary" if seen[c] else None
        return None if seen[c] is None else "binary" if seen[c] else "continuous"

    return df.sparkSession.createDataFrame([(c, kind(c)) for c in columns], "variable string, kind string")  # one row per column


def positive_level(levels: DataFrame) -> DataFrame:
    """(variable, level) of rows (variable, level, pos): of a variable's levels the first, by pos, that is a positive word, else the second in order; null if it has one."""
    each = levels.filter("level is not null").groupBy("variable", "level").agg(F.min("pos").alias("pos"))
    hit = F.min(F.when(F.lower("level").isin(*POSITIVE_LEVELS), F.struct("pos", "level")))
    first = each.groupBy("variable").agg(F.min("level").alias("least"), F.count(F.lit(1)).alias("n"), hit.alias("hit"))
    second = each.join(first.select("variable", "least"), "variable").filter("level > least").groupBy("variable").agg(F.min("level").alias("second"))
    return first.join(second, "variable", "left").select("variable", F.when(F.col("n") > 1, F.coalesce("hit.level", "second")).alias("level"))


def parse_p(text: Column) -> Column:
    """A p-value shown as ``<0.001`` or ``>0.99`` as its bound."""
    return F.regexp_replace(F.trim(text), "^[<>]", "").try_cast("double")


def align_schema(df: DataFrame, keys: list[str], features: list[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """df with exactly the features of a frozen list, absent ones null, and which were kept, extra and missing."""
    have = set(df.columns) - set(keys)
    report = {"kept": [f for f in features if f in have], "extra": sorted(have - set(features)), "missing": [f for f in features if f not in have]}
    return df.select(*keys, *[F.col(f) if f in have else F.lit(None).cast("double").alias(f) for f in features]), report


def shift_codes(df: DataFrame, columns: list[str], codes: tuple[int, ...] = (0, 1, 2, 3), by: int = 1) -> DataFrame:
    """Listed whole codes moved by a step, before they are recoded; other values stay."""
    return df.withColumns({c: F.when(F.col(c).isin(*codes), F.col(c) + by).otherwise(F.col(c)) for c in columns if c in df.columns})


def months_to_years(months: Column) -> Column:
    return months / 12.0


def threshold(value: Column, below: float, low: object = 0, at: object = 1) -> Column:
    """Values under a bound become low, the bound itself at; others stay."""
    return F.when(value < below, F.lit(low)).when(value == below, F.lit(at)).otherwise(value)


def multi_hot(flags: dict[object, str]) -> Column:
    """The last of the codes, in order, whose flag column is 1; null if none is."""
    out = F.lit(None)
    for code, c in flags.items():
        out = F.when(F.col(c) == 1, F.lit(code)).otherwise(out)
    return out


def prefix_group(ids: Column, n: int = 2) -> Column:
    """The site, as the first characters of an id."""
    return F.substring(ids, 1, n)


def flag_group(group: Column, positive: object) -> Column:
    """1 for the group named, 0 for any other, null for none."""
    return F.when(group == positive, 1).when(group.isNotNull(), 0)


def override(df: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """df with column replaced where changes (key, column) has a row of the key; changes is a short hand-made list."""
    new = changes.groupBy(key).agg(F.max(column).alias("_new"), F.lit(True).alias("_has"))
    joined = df.join(new, key, "left")
    return joined.withColumn(column, F.when(F.col("_has"), F.col("_new")).otherwise(F.col(column))).select(*df.columns)


def combine_detail(answer: Column, detail: Column) -> Column:
    """An answer with its detail after it; ``No`` without a detail stays, neither is null."""
    text = F.concat(F.coalesce(answer, F.lit("NA")), F.lit(" "), F.coalesce(detail, F.lit("NA")))
    return F.when(text == "No NA", "No").when(text != "NA NA", text)


def rewrite_by_name(df: DataFrame, patterns: list[str], values: Iterable, to: object) -> DataFrame:
    """Numeric columns whose name holds one of the patterns, in any case, with listed values rewritten."""
    listed, kinds = list(values), {f.name: f.dataType for f in df.schema}
    hit = [c for c in df.columns if is_numeric(kinds[c]) and any(p.lower() in c.lower() for p in patterns)]
    return df.withColumns({c: F.when(F.col(c).isin(listed), F.lit(to).cast(kinds[c])).otherwise(F.col(c)) for c in hit})


def relabel(column: Column, labels: dict) -> Column:
    """Levels by their label; levels without one are null."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.element_at(table, column)


def not_applicable_columns(df: DataFrame, codes: Iterable = NOT_APPLICABLE) -> DataFrame:
    """(column) of the columns that hold a code of not applicable, as number or text, in one pass."""
    listed = [str(c) for c in codes]
    found = df.agg(*[F.max(F.regexp_replace(F.col(c).cast("string"), r"\.0$", "").isin(listed)).alias(c) for c in df.columns]).first()
    return df.sparkSession.createDataFrame([(c,) for c in df.columns if found[c]], "column string")


def flag_listed(df: DataFrame, listed: DataFrame, key: str, name: str, inside: object = True, outside: object = False) -> DataFrame:
    """df with name: inside where the key is in listed (key), else outside."""
    there = listed.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_there", F.lit(True))
    return df.join(there, key, "left").withColumn(name, F.when(F.col("_there"), F.lit(inside)).otherwise(F.lit(outside))).drop("_there")


def missing_filter_views(views: dict[str, DataFrame], keys: list[str], col_share: float, row_share: float) -> dict[str, DataFrame]:
    return {name: missing_filter(df, keys, col_share, row_share) for name, df in views.items()}


def usable_tables(df: DataFrame, group: str, columns: list[str], least: int = 30) -> DataFrame:
    """(variable, usable): whether both of the first two groups, in order, have more than least rows; a row without a value counts."""
    counts = df.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("n")).orderBy("_g").limit(2)
    both = counts.agg(((F.count(F.lit(1)) == 2) & (F.min("n") > least)).alias("usable"))
    return both.select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("variable"), F.coalesce("usable", F.lit(False)).alias("usable"))


def epoch(c: Column) -> Column:
    """A date or timestamp as nanoseconds since 1970."""
    return F.unix_micros(c.cast("timestamp")) * F.lit(1000)


def append_constants(df: DataFrame, rows: list[tuple], columns: list[str]) -> DataFrame:
    """df with constant rows of the named columns put under it; other columns are null there."""
    kinds = {f.name: f.dataType for f in df.schema}
    more = df.sparkSession.createDataFrame(rows, T.StructType([T.StructField(c, kinds[c]) for c in columns]))
    return df.unionByName(more, allowMissingColumns=True)
