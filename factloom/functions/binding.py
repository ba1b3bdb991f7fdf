"""Binding an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.

    Splitting the steps over several ``withColumn`` calls does not guarantee
    that: the optimizer merges projections, and an array that is referenced once
    inside a lambda would then be rebuilt for every element.

    Written as a fold over nothing, whose start is the value and whose last step is
    the body. (A ``transform`` over a list of one would do as well, but copies what
    the body returns.)
    """
    nothing = F.array().cast("array<int>")
    return F.aggregate(nothing, value, lambda bound, _: bound, body)
