"""Arrow-batched functions that are declared before there is a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(kind: str):
    """Declare a pandas function over columns; the Spark function is made when it is first used on columns, so workers
    can import the module as well."""

    def declare(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def over(*columns) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return over

    return declare
