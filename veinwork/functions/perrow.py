"""Python functions over column values, in Arrow batches."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F


def per_row(f: Callable, returns: str) -> Callable[..., Column]:
    """``f`` of one or more plain values as a function of columns.

    The function's module travels with the plan, so executors need no copy of
    this package. Structs are returned as dicts or tuples, arrays as lists.
    """
    cloudpickle.register_pickle_by_value(sys.modules[f.__module__])
    names = [x.split(":")[0].strip().partition(" ")[0] for x in returns[7:-1].split(",")] if returns.startswith("struct<") else None

    def value(v):
        if isinstance(v, np.ndarray):
            return v.tolist()
        return None if v is pd.NA or (isinstance(v, float) and v != v) else v

    def run(columns: tuple) -> pd.Series | pd.DataFrame:
        found = [f(*map(value, row)) for row in zip(*columns)]
        if names is None:
            return pd.Series(found, dtype=object)
        return pd.DataFrame([[None] * len(names) if r is None else list(r) for r in found], columns=names, dtype=object)

    def one(a: pd.Series):
        return run((a,))

    def two(a: pd.Series, b: pd.Series):
        return run((a, b))

    def three(a: pd.Series, b: pd.Series, c: pd.Series):
        return run((a, b, c))

    kind = pd.DataFrame if names else pd.Series

    def apply(*columns: Column | str) -> Column:
        g = (one, two, three)[len(columns) - 1]
        g.__annotations__ = {**dict.fromkeys("abc"[: len(columns)], pd.Series), "return": kind}
        return F.pandas_udf(g, returns)(*columns)

    return apply
