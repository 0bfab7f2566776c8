"""P-values as Arrow-batched functions of test statistics; the statistics themselves are plain aggregates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import special


def _columns(name):
    def run(*columns: pd.Series) -> pd.Series:
        f = getattr(special, name)
        return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype="float64")

    return run


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _columns("t_two_sided")(t, df)


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _columns("f_upper")(f, d1, d2)


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _columns("chi2_upper")(x, df)


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _columns("fisher_two_sided")(a, b, c, d)
