"""One Python function, usable on plain values and on columns."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def py_or_udf(
    returnType: T.DataType | str = T.StringType(), null_safe: bool = False, useArrow: bool = True
) -> Callable[[Callable], Callable]:
    """Decorator: a call with any ``Column`` argument becomes a Spark UDF, any other runs directly.

    With ``null_safe`` a null (or ``None``) argument gives null without calling the function.  Rows
    travel to Python in Arrow batches; prefer the native column functions wherever they fit.
    """

    def decorate(func: Callable) -> Callable:
        @functools.wraps(func)
        def on_values(*args, **kwargs):
            if null_safe and any(value is None for value in (*args, *kwargs.values())):
                return None
            return func(*args, **kwargs)

        @functools.wraps(func)
        def on_values_or_columns(*args, **kwargs):
            if any(isinstance(value, Column) for value in (*args, *kwargs.values())):
                return F.udf(on_values, returnType, useArrow=useArrow)(*args, **kwargs)
            return on_values(*args, **kwargs)

        return on_values_or_columns

    return decorate
