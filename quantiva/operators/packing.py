"""Packing of cut lengths into stock bars, by counts of equal pieces.

Pieces and bars are held as runs of equal ones, so the work for a diameter grows with its different lengths (12,000
whole millimetres at most), whatever the number of pieces. Equal pieces are counted before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import STOCK_BAR

BAR, LEAST = STOCK_BAR * 1000, 50
Runs = list[tuple[int, int]]


def _cut(pieces: Runs, bar: int, least: int) -> tuple[int, Runs]:
    """Whole bars of pieces that are longer than one, and what is left of all pieces, longest first."""
    whole, rest = 0, {}
    for length, n in pieces:
        bars = max(0, -(-length // bar) - 1)
        whole += bars * n
        if length - bars * bar > least:
            rest[length - bars * bar] = rest.get(length - bars * bar, 0) + n
    return whole, sorted(rest.items(), reverse=True)


def first_fit_decreasing(pieces: Runs, bar: int = BAR, least: int = LEAST) -> tuple[int, int]:
    """Bars and useful millimetres of (length, number) pieces, each put into the first bar that has room for it."""
    whole, rest = _cut(pieces, bar, least)
    runs: Runs = []  # (room, bars) in the order in which bars were opened
    for length, n in rest:
        out: Runs = []
        for room, bars in runs:
            fit = room // length
            if not n or not fit:
                out.append((room, bars))
                continue
            full = min(bars, n // fit)  # bars that take as many pieces as they have room for
            n -= full * fit
            if full:
                out.append((room - fit * length, full))
            if full < bars:
                if n:
                    out.append((room - n * length, 1))
                if bars - full - bool(n):
                    out.append((room, bars - full - bool(n)))
                n = 0
        if n:
            fit = bar // length
            if n // fit:
                out.append((bar - fit * length, n // fit))
            if n % fit:
                out.append((bar - n % fit * length, 1))
        runs = out
    return whole + sum(b for _, b in runs), whole * bar + sum(length * n for length, n in rest)


def bar_by_bar(pieces: Runs, bar: int = BAR, slack: int = 1) -> tuple[int, int]:
    """Bars and useful millimetres when each bar takes, longest first, every piece that fits; pieces longer than a bar
    are left out. A pattern of cuts is used for as many bars as its pieces last."""
    left = dict(sorted(((length, n) for length, n in pieces if length <= bar + slack), reverse=True))
    used, useful = 0, sum(length * n for length, n in left.items())
    while left:
        room, taken = bar, {}
        for length, n in left.items():
            fit = min(n, (room + slack) // length)
            if fit > 0:
                taken[length] = fit
                room -= fit * length
        times = min(left[length] // fit for length, fit in taken.items())
        used += times
        left = {length: n - times * taken.get(length, 0) for length, n in left.items() if n > times * taken.get(length, 0)}
    return used, useful


def pack(pieces: DataFrame, keys: list[str], length_mm: str, count: str, how: Callable[[Runs], tuple[int, int]] = first_fit_decreasing) -> DataFrame:
    """``keys``, bars, useful_mm and waste_mm of each group."""
    distinct = pieces.groupBy(*keys, length_mm).agg(F.sum(count).cast("bigint").alias("n"))
    schema = ", ".join(f"`{k}` {pieces.schema[k].dataType.simpleString()}" for k in keys) + ", bars bigint, useful_mm bigint, waste_mm bigint"

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        bars, useful = how([(int(x), int(n)) for x, n in zip(df[length_mm], df["n"], strict=True)])
        return pd.DataFrame([[*key, bars, useful, bars * BAR - useful]])

    return distinct.groupBy(*keys).applyInPandas(run, schema)
