"""Arrow functions that are made when they are used, so that workers can import their modules without a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """A function of pandas series as a function of columns, with its result's type."""

    def put(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return call

    return put
