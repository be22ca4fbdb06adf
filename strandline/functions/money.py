"""Money as whole cents: splitting, scaling and allocating without losing any."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1


def _whole(a: Column, b: Column) -> Column:
    """a / b cut towards zero, by integer division: nothing passes through a double."""
    return F.call_function("div", a, b)


def cents(amount: Column) -> Column:
    """Whole cents of an amount; exact for decimals, and for doubles as long as they tell cents apart."""
    return F.round(amount * 100).cast("long")


def split(total: Column, n: Column, place: Column) -> Column:
    """The share of the row at `place` (from 0) of total cents split n ways: odd cents go to the first rows, with total's sign."""
    each = _whole(total.cast("long"), n.cast("long"))
    left = total - each * n
    return each + F.when(place < F.abs(left), F.signum(left).cast("long")).otherwise(F.lit(0).cast("long"))


def scale(amount: Column, factor: Column) -> Column:
    """amount * factor, cut towards zero."""
    return (amount * factor).cast("long")


def scale_ratio(amount: Column, over: Column, under: Column) -> Column:
    """amount * over / under in exact arithmetic, cut towards zero."""
    product = amount.cast("decimal(19,0)") * over.cast("decimal(19,0)")
    return _whole(product, under.cast("decimal(19,0)"))


def shuffled(n: int, seed: int) -> list[int]:
    """The numbers below n in a fixed random order: Fisher-Yates driven by the published SplitMix64 generator."""
    state = seed & _MASK

    def draw() -> int:
        nonlocal state
        state = (state + 0x9E3779B97F4A7C15) & _MASK
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        return z ^ (z >> 31)

    out = list(range(n))
    for i in range(n - 1, 0, -1):
        j = draw() % (i + 1)
        out[i], out[j] = out[j], out[i]
    return out


def allocate(total: int, weights: list[float], denominator: float, seed: int) -> list[int]:
    """Shares of total cents by weight over denominator; leftover cents go one each to rows in a seeded order."""
    shares = [int(total * w / denominator) for w in weights]
    if abs(sum(weights) - denominator) > 1e-9 * max(1.0, abs(denominator)):
        return shares
    left = total - sum(shares)
    if abs(left) > len(weights):
        raise ValueError("more left over than rows to take it")
    for i in shuffled(len(weights), seed)[: abs(left)]:
        shares[i] += 1 if left > 0 else -1
    return shares
