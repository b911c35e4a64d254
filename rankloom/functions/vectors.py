"""Vector expressions over ``array<float>``; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def inner_product(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def l2_normalize(vector: Column) -> Column:
    """Unit vector in single precision; a zero vector stays as it is.

    The norm enters as one repeated array, so that it is computed once per row and not once per
    element inside the lambda.
    """
    norms = F.array_repeat(l2_norm(vector), F.size(vector))
    return F.zip_with(
        vector,
        norms,
        lambda x, n: F.when(n > 0, (x.cast("double") / n).cast("float")).otherwise(x),
    )
