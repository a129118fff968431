"""Bins, buckets and ranks."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def left_closed(x: Column, edges: list[float]) -> Column:
    """Index of the bin [lo, hi) that holds ``x``; the last bin holds its upper edge; null outside."""
    out = F.when(x == edges[-1], len(edges) - 2)
    for i, (lo, hi) in enumerate(pairwise(edges)):
        out = out.when((x >= lo) & (x < hi), i)
    return out


def right_closed(x: Column, edges: list[float], include_lowest: bool = False) -> Column:
    """Index of the bin (lo, hi] that holds ``x``; null outside."""
    out = F.when(F.lit(include_lowest) & (x == edges[0]), 0)
    for i, (lo, hi) in enumerate(pairwise(edges)):
        out = out.when((x > lo) & (x <= hi), i)
    return out


def label(x: Column, edges: list[float]) -> Column:
    out = F.when(x < edges[0], F.lit(f"<{edges[0]:g}")).when(x >= edges[-1], F.lit(f">={edges[-1]:g}"))
    for lo, hi in pairwise(edges):
        out = out.when((x >= lo) & (x < hi), F.lit(f"{lo:g}-{hi:g}"))
    return out


def average_percent_rank(value: Column, over: WindowSpec, same: WindowSpec, everything: WindowSpec) -> Column:
    """Rank over count, ties at their mean rank. ``over`` orders by the value, ``same`` groups equal values, and
    ``everything`` is the whole partition."""
    mean_rank = F.rank().over(over) + (F.count(value).over(same) - 1) / 2
    return mean_rank / F.count(value).over(everything)


def row_median(*values: Column) -> Column:
    """Median of a row's values, nulls left out; null without any."""
    there = F.array_sort(F.array_compact(F.array(*[v.cast("double") for v in values])))
    n = F.size(there)
    at = lambda i: F.try_element_at(there, i.cast("int"))
    return (at(F.floor((n + 1) / 2)) + at(F.ceil((n + 1) / 2))) / 2
