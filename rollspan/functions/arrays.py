"""Array arithmetic on Catalyst's higher-order functions.

`let` binds a value once: an expression written inside a lambda would otherwise be
evaluated again for every element.
"""

from pyspark.sql import functions as F


def let(value, body):
    """Evaluate `value` once and hand it to `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values):
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean(values):
    return total(values) / F.size(values)


def dot(left, right):
    return total(F.zip_with(left, right, lambda a, b: a * b))


def roll(values, k):
    """Circular shift to the right by k places, 0 < k < size."""
    n = F.size(values)
    return F.concat(F.slice(values, n - k + 1, F.lit(k)), F.slice(values, F.lit(1), n - k))


def deviations(values):
    """Values less their mean; the first value goes first, so constants give zeros."""
    first = F.element_at(values, 1)
    shifted = F.transform(values, lambda x: x - first)
    return let(
        F.struct(shifted.alias("v"), mean(shifted).alias("m")),
        lambda s: F.transform(s["v"], lambda x: x - s["m"]),
    )


def non_decreasing(values):
    return F.array_sort(values) == values
