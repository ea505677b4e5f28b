"""Running a NumPy kernel on each series of a long frame: one group a series, series spread over the cluster."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewave.operators.series import AT, ID, X

#: Kernels whose work grows with the square of a series' length refuse longer ones.
MAX_SQUARE = 20_000


def _type(df: DataFrame, c: str) -> str:
    return dict(df.dtypes)[c]


def per_series(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], out: str = "y", at: str = AT, x: str = X, id_: str = ID) -> DataFrame:
    """df with out = kernel(x in order of at), a value for each sample."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        return pdf.assign(**{out: np.asarray(kernel(pdf[x].to_numpy(float)), float)})

    from pyspark.sql import functions as F

    return df.groupBy(id_).applyInPandas(run, df.withColumn(out, F.lit(0.0)).schema)


def summary(df: DataFrame, kernel: Callable[..., dict], schema: str, columns: list[str] | None = None, at: str = AT, id_: str = ID) -> DataFrame:
    """One row per series: kernel(arrays of the columns in order of at) gives the fields of schema."""
    columns = columns or [X]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        got = kernel(*[pdf[c].to_numpy(float) for c in columns])
        return pd.DataFrame({id_: [pdf[id_].iloc[0]]} | {n: [got[n]] for n in names})

    return df.groupBy(id_).applyInPandas(run, f"{id_} {_type(df, id_)}, {schema}")


def table(df: DataFrame, kernel: Callable[..., dict], schema: str, columns: list[str] | None = None, at: str = AT, id_: str = ID) -> DataFrame:
    """Several rows per series: kernel gives equally long sequences for the fields of schema."""
    columns = columns or [X]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        got = pd.DataFrame({n: v for n, v in kernel(*[pdf[c].to_numpy() for c in columns]).items() if n in names})
        got.insert(0, id_, pdf[id_].iloc[0] if len(got) else None)
        return got[[id_, *names]]

    return df.groupBy(id_).applyInPandas(run, f"{id_} {_type(df, id_)}, {schema}")
