"""Waveforms of synthetic series: functions of the seconds since a series began."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.timebin import seconds


def _phase(t: Column, period: str, phase: float) -> Column:
    return F.pmod(t / F.lit(float(seconds(period))) + F.lit(phase / (2 * math.pi)), F.lit(1.0))


def sine(t: Column, amplitude: float, period: str, offset: float = 0.0, phase: float = 0.0) -> Column:
    return F.lit(offset) + F.lit(amplitude) * F.sin(F.lit(2 * math.pi) * t / F.lit(float(seconds(period))) + F.lit(phase))


def triangle(t: Column, amplitude: float, period: str, offset: float = 0.0, phase: float = 0.0) -> Column:
    """From -1 up to 1 in the first half of a period, and down again in the second."""
    x = _phase(t, period, phase)
    return F.lit(offset) + F.lit(amplitude) * F.when(x < 0.5, 4 * x - 1).otherwise(3 - 4 * x)


def square(t: Column, amplitude: float, period: str, offset: float = 0.0, phase: float = 0.0) -> Column:
    """The sign of the sine, where zero counts as positive."""
    s = F.sin(F.lit(2 * math.pi) * t / F.lit(float(seconds(period))) + F.lit(phase))
    return F.lit(offset) + F.lit(amplitude) * F.when(s >= 0, 1.0).otherwise(-1.0)


def line(t: Column, slope: float, offset: float = 0.0) -> Column:
    return F.lit(offset) + F.lit(slope) * t


SHAPES = {"sine": sine, "triangle": triangle, "square": square, "line": line}


def total(t: Column, components: list[dict]) -> Column:
    """The sum of waveforms, each a dict with `type` and the shape's own arguments."""
    out = None
    for c in components:
        c = dict(c)
        kind = c.pop("type")
        if kind not in SHAPES:
            raise ValueError(f"unknown waveform {kind!r}")
        value = SHAPES[kind](t, **c)
        out = value if out is None else out + value
    return F.lit(0.0) if out is None else out
