"""Expression helpers."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Spark does not share a subexpression between the branches of CASE or
    inside lambdas, so an array built by a regex split and referenced five
    times would be built five times. Binding it as the element of a
    one-element ``transform`` evaluates it once per row, JVM-side.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
