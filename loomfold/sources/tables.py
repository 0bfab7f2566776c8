"""Readers: the driver tables and the cohort's own files. Schemas are explicit, so plans prune and push down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV with header; all columns text unless a schema is given; ``nan`` and empty cells are null."""
    df = spark.read.option("header", True).option("nullValue", "").option("nanValue", "nan")
    df = (df.schema(schema) if schema else df).csv(path)
    return df.select(*[F.when(F.lower(f.name) != "nan", F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])


def list_files(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """(path) of all files below root; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")


def file_parts(files: DataFrame, excluded: str = "basetables?/") -> DataFrame:
    """(path, base, dated, version, layout): the date ``_DD.MM.YYYY`` in the name, the version folder above it, 9999 without one."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    dated = F.regexp_extract(name, r"_(\d{2}\.\d{2}\.\d{4})\.csv$", 1)
    version = F.regexp_extract("path", r"/csv/(\d+)/[^/]*$", 1)
    out = files.filter(~F.col("path").rlike(excluded)).select(
        "path", F.regexp_replace(name, r"(_\d{2}\.\d{2}\.\d{4})?\.csv$", "").alias("base"), F.try_to_timestamp(F.nullif(dated, F.lit("")), F.lit("dd.MM.yyyy")).cast("date").alias("dated"), F.coalesce(F.nullif(version, F.lit("")).try_cast("int"), F.lit(9999)).alias("version")
    )
    return out.withColumn("layout", F.when(F.col("dated").isNotNull(), "dated").when(F.col("version") != 9999, "versioned").otherwise("flat"))


def newest(files: DataFrame, by: str = "dated") -> DataFrame:
    top = files.groupBy("base").agg(F.max(by).alias("_top"))
    return files.join(top, "base").filter(F.col(by) == F.col("_top")).drop("_top")


def header_columns(spark: SparkSession, path: str, wanted: list[str]) -> list[str]:
    """Those of the wanted columns that a CSV has; only its header is read."""
    have = set(spark.read.option("header", True).csv(path).columns)
    return [c for c in wanted if c in have]


def newest_table(spark: SparkSession, root: str, prefix: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The most recent of the tables ``<prefix>_DD.MM.YYYY.csv`` below root, each a CSV folder; an error if there is none."""
    folders = list_files(spark, root).select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path")).distinct()
    found = newest(file_parts(folders).filter(F.col("base") == prefix).filter("layout = 'dated'")).limit(1).collect()
    if not found:
        raise ValueError(f"no table {prefix} below {root}")
    return read_csv(spark, found[0]["path"], schema)


class Registry:
    """Names of frames; a source is a registered frame, a path, or a base name below root."""

    def __init__(self, spark: SparkSession, root: str = ""):
        self.spark, self.root, self.frames = spark, root.rstrip("/"), {}

    def add(self, name: str, df: DataFrame) -> DataFrame:
        self.frames[name] = df
        return df

    def read(self, source: str) -> DataFrame:
        if source not in self.frames:
            self.frames[source] = read_csv(self.spark, source if "/" in source else f"{self.root}/{source}")
        return self.frames[source]


DICTIONARY = ("ElementName", "Label", "Aliases", "Include_basetable", "Include_demographics", "Datatype", "Modality", "Notes")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary as text; columns that are needed and absent raise."""
    df = read_csv(spark, path)
    absent = [c for c in DICTIONARY if c not in df.columns]
    if absent:
        raise ValueError(f"dictionary has no column {', '.join(absent)}")
    return df


def variables(dictionary: DataFrame, required: list[str] = (), flag: str = "Include_basetable") -> DataFrame:
    """(ElementName, Label, Datatype, Modality, alias_of): included variables, a row more for each alias, and required ones."""
    chosen = dictionary.filter(F.lower(flag) == "yes")
    names = F.filter(F.split(F.regexp_replace(F.coalesce("Aliases", F.lit("")), r"\s", ""), ","), lambda a: a != "")
    columns = ["Label", "Datatype", "Modality"]
    own = chosen.select("ElementName", *columns, F.lit(None).cast("string").alias("alias_of"))
    aliases = chosen.select(F.explode(names).alias("ElementName"), *columns, F.col("ElementName").alias("alias_of"))
    out = own.unionByName(aliases).dropDuplicates(["ElementName"])
    if required:
        more = dictionary.sparkSession.createDataFrame([(r,) for r in required], "ElementName string").join(out, "ElementName", "left_anti")
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def write_dated(df: DataFrame, root: str, timepoint: str, day: str, name: str = "basetable") -> str:
    """A CSV folder per time point and day; returns its path."""
    path = f"{root.rstrip('/')}/{timepoint}/{name}_{day}"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_generation(df: DataFrame, root: str, fold: int, gen: int) -> str:
    path = f"{root.rstrip('/')}/fold={fold}/gen={gen}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_generations(spark: SparkSession, root: str) -> DataFrame:
    """All generations of all folds, with fold and gen as columns; filters on them prune folders."""
    return spark.read.parquet(root)


def typed(c: Column, kind: str) -> Column:
    """A text cell as a type, null where it is none."""
    return c.try_cast(kind)
