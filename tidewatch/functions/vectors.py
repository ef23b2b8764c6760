"""Array arithmetic as column expressions."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.get(F.transform(F.array(value), body), 0)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def vector_sum(values: Column, dims: int, weight: Column | None = None) -> Column:
    """Aggregate: element-wise sum of an array column, combined map-side."""
    parts = [F.get(values, i) for i in range(dims)]
    return F.array(*[F.sum(p if weight is None else p * weight) for p in parts])


def vector_mean(values: Column, dims: int) -> Column:
    return F.array(*[F.avg(F.get(values, i)) for i in range(dims)])


def smooth_max(values: Sequence[Column], temperature: float) -> Column:
    """Normalised log-sum-exp; zero when every value is zero."""
    top = F.greatest(*values)
    raised = values[0] * 0.0
    for v in values:
        raised = raised + F.exp((v - top) / F.lit(float(temperature)))
    return top + F.lit(float(temperature)) * F.log(raised / F.lit(float(len(values))))


def log_sum_exp(values: Column) -> Column:
    """Stable log-sum-exp of an array."""
    def raised(pair: Column) -> Column:
        return pair["top"] + F.log(total(F.transform(pair["values"], lambda x: F.exp(x - pair["top"]))))

    return bind(values, lambda v: bind(F.struct(v.alias("values"), F.array_max(v).alias("top")), raised))
