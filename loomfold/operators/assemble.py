"""Cohort assembly: many raw files and a dictionary into one row per subject.

Every file is read once, unpivoted to (id, visit, date, variable, value), and two selections give each variable its value: rows of
the visit asked for, else the row nearest in time to the subject's reference date, else the earliest. One pivot makes the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .match import first_by

VISIT_ALIASES = {"month_2": ("month_2", "m2")}


def long_values(file: DataFrame, wanted: list[str], id_col: str = "src_subject_id", date_format: str = "MM/dd/yyyy") -> DataFrame:
    """A raw file of text cells as (id, visit, date, variable, value); files without visits or dates have null there."""
    columns = [c for c in wanted if c in file.columns]
    visit = F.lower("visit") if "visit" in file.columns else F.lit(None).cast("string")
    day = F.try_to_timestamp("interview_date", F.lit(date_format)).cast("date") if "interview_date" in file.columns else F.lit(None).cast("date")
    own = file.filter(F.col(id_col).isNotNull() & (F.col(id_col) != ""))
    own = own.select(F.col(id_col).alias("id"), visit.alias("visit"), day.alias("date"), *[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    if not columns:
        return own.select("id", "visit", "date", F.lit(None).cast("string").alias("variable"), F.lit(None).cast("string").alias("value")).limit(0)
    return own.unpivot(["id", "visit", "date"], columns, "variable", "value")


def assemble(files: list[DataFrame], wanted: list[str], timepoint: str, **options) -> DataFrame:
    """One row per subject that any file has, a text column per variable."""
    rows = None
    for f in files:
        one = long_values(f, wanted, **options)
        rows = one if rows is None else rows.unionByName(one)
    visits = VISIT_ALIASES.get(timepoint, (timepoint,))
    spine = rows.select("id").distinct()
    at_visit = F.col("visit").isin(*visits)
    reference = rows.filter(at_visit).groupBy("id").agg(F.min("date").alias("ref_date"))
    # A variable that has visits anywhere is taken at the visit only; others by the nearest date. One row a variable: dealt by it, a few tasks would read all values.
    dated = rows.groupBy("variable").agg(F.max(F.col("visit").isNotNull()).alias("has_visit"))
    known = rows.filter("value is not null").join(F.broadcast(dated), "variable").filter(~F.col("has_visit") | at_visit).join(reference, "id", "left")
    gap = F.abs(F.datediff("date", "ref_date"))
    picked = first_by(known.select("id", "variable", "value", gap.alias("gap"), "date"), ["id", "variable"], [F.col("gap"), F.col("date"), F.col("value")])
    wide = picked.groupBy("id").pivot("variable", wanted).agg(F.min("value"))
    return spine.join(wide, "id", "left")
