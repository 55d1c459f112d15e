"""Scalar functions over Arrow batches; null in, null out."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def scalar(fn: Callable[..., Any], kind: str) -> Callable[..., Column]:
    """fn as a function of columns; rows with a null argument give null."""

    def call(*args: Any) -> Any:
        return None if any(a is None for a in args) else fn(*args)

    call.__name__ = getattr(fn, "__name__", "function")
    return F.udf(call, kind, useArrow=True)
