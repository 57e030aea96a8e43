"""Operators over DataFrames: set algebra, grouped and windowed computations, matrices, regression; hooks around them."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def hooked(f: Callable, before: Callable[[str], object] = lambda name: None, after: Callable[[str, object], object] = lambda name, result: None) -> Callable:
    """``f`` with a call before and one after it, which gets the result; the result is handed on as it is."""

    @wraps(f)
    def run(*args, **kw):
        before(f.__name__)
        result = f(*args, **kw)
        after(f.__name__, result)
        return result

    return run


def ran(df: DataFrame) -> tuple[float, int]:
    """Seconds that the whole of ``df`` takes, and its rows, counted in the same pass; nothing is kept of it."""
    seen = Observation()
    start = time.perf_counter()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start, seen.get["rows"]


def timed(f: Callable, tell: Callable[[str, float, int | None], None] = print) -> Callable:
    """``f``, telling after every call its name, seconds and rows. A DataFrame is run for that, as building its plan takes no time worth telling;
    other results have no rows, and their seconds are those of the call."""

    @wraps(f)
    def run(*args, **kw):
        start = time.perf_counter()
        result = f(*args, **kw)
        seconds, rows = time.perf_counter() - start, None
        if isinstance(result, DataFrame):
            more, rows = ran(result)
            seconds += more
        tell(f.__name__, seconds, rows)
        return result

    return run
