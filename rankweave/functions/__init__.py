"""Column functions of integer keys and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_width(value: Column) -> Column:
    """Bits of a non-negative long; 0 for 0."""
    return F.when(value == 0, 0).otherwise(F.length(F.bin(value)))


def varint_length(value: Column) -> Column:
    """Bytes of a non-negative long at seven bits a byte; at least 1."""
    return F.greatest(F.lit(1), F.ceil(bit_width(value) / 7)).cast("int")


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x) without overflow for large |x|."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


# The published rational approximation of the error function (Abramowitz and Stegun, 7.1.26), of absolute error under 1.5e-7.
ERF = (0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution, within 1e-7."""
    t = 1 / (1 + ERF[0] * F.abs(z) / F.sqrt(F.lit(2.0)))
    tail = F.lit(0.0)
    for a in reversed(ERF[1:]):
        tail = t * (tail + a)
    half = 0.5 * tail * F.exp(-z * z / 2)
    return F.when(z >= 0, 1 - half).otherwise(half)
