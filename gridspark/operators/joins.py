"""Joins beyond equality: intervals, as-of, cascades of keys, matching in tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import geo


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, event: str, span: str, days: int) -> DataFrame:
    """Left rows with the right rows of their keys whose ``event`` lies within ``days`` before ``at``, ends included.

    Both sides are cut into slices of ``days``; a left row looks into its own and the slice before, so that the join is
    one on equality and no key's events are all paired. ``span`` names the column of the distance in days.
    """
    size = 86_400 * days
    slice_of = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / size)
    looking = left.withColumn("_slice", F.explode(F.array(slice_of(at), slice_of(at) - 1)))
    named = right.withColumn("_slice", slice_of(event))
    gap = F.unix_seconds(F.col(at).cast("timestamp")) - F.unix_seconds(F.col(event).cast("timestamp"))
    return looking.join(named, [*keys, "_slice"]).withColumn(span, gap / 86_400).filter((gap >= 0) & (gap <= size)).drop("_slice")


def _instant(c: str) -> Column:
    """A time as microseconds."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def carry_last(left: DataFrame, right: DataFrame, keys: list[str], at: Column, event: Column, strict: bool, tie: list[Column], slice_us: int) -> DataFrame:
    """(l, r): left rows as structs, each with its keys' last right row at or (``strict``) before ``at``; of equal times the first by ``tie``.

    Each key's time is cut into slices. Inside a slice both sides are put in one order and the last right row is carried along; the
    last row of each slice is carried over to the next by a window over the slices. So no task sorts more than a slice of a
    key, and no rows are paired.
    """
    names = [f"k{i}" for i in range(len(keys))]
    order = F.struct(*tie) if tie else F.lit(0)
    a = left.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], at.alias("t"), F.lit(0 if strict else 1).alias("side"), F.struct(*left.columns).alias("l"))
    b = right.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], event.alias("t"), F.lit(1 if strict else 0).alias("side"), F.struct(*right.columns).alias("r"), order.alias("tie")
    ).filter("t is not null")
    both = a.unionByName(b, allowMissingColumns=True).withColumn("slice", F.floor(F.col("t") / slice_us))
    w = Window.partitionBy(*names, "slice").orderBy("t", "side", F.desc("tie"))
    seen = both.withColumn("own", F.last("r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(w))
    ends = seen.groupBy(*names, "slice").agg(F.max_by("own", "n").alias("end"))
    before = Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(n).alias(f"e{n}") for n in names], F.col("slice").alias("e_slice"), F.last("end", ignorenulls=True).over(before).alias("before"))
    carried = carried.filter(F.col("before").isNotNull()).repartition(*[f"e{n}" for n in names], "e_slice")
    same = F.col("slice") == F.col("e_slice")
    for n in names:
        same = same & (F.col(n) == F.col(f"e{n}"))
    return seen.filter(F.col("l").isNotNull()).join(carried, same, "left").select("l", F.coalesce("own", "before").alias("r"))


#: A week in microseconds.
WEEK = 7 * 86_400 * 1_000_000


def asof_join(
    left: DataFrame, right: DataFrame, key: str, at: str, event: str, values: list[str], strict: bool = False, tie: list[Column] | None = None, slice_us: int = WEEK
) -> DataFrame:
    """Left rows with the ``values`` of the key's last right row at or (``strict``) before them.

    Of right rows at one time the first by ``tie`` counts. Right values that are null are carried as null; a left row without a time, or
    with a null key, finds nothing. ``slice_us`` bounds what one task sorts of a key.
    """
    met = carry_last(left, right, [key], _instant(at), _instant(event), strict, tie or [], slice_us)
    return met.select("l.*", F.col(f"r.{event}").alias(f"{event}_asof"), *[F.col(f"r.{v}").alias(v) for v in values])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, event: str, values: list[str], tie: list[str], slice_us: int = WEEK) -> DataFrame:
    """Left rows with the ``values`` of the right row of their keys nearest in time, and its ``distance`` in microseconds.

    The nearest is the last one at or before, or the first one after: two as-of passes. Of equally near ones the first by ``tie`` counts;
    left rows whose keys have no right row are gone. Rows are told apart by their content, which does not depend on how ``left`` is computed; equal rows come as often as they were.
    """
    rows = left.groupBy(*left.columns).agg(F.count(F.lit(1)).alias("_times"))
    order = [F.col(c) for c in tie]
    t, e = _instant(at), _instant(event)
    found = None
    for sign in (1, -1):
        met = carry_last(rows, right, keys, t * sign, e * sign, False, order, slice_us).filter(F.col("r").isNotNull())
        gap = F.abs(F.unix_micros(F.col(f"l.{at}").cast("timestamp")) - F.unix_micros(F.col(f"r.{event}").cast("timestamp")))
        part = met.select("l", F.struct(gap.alias("distance"), *[F.col(f"r.{c}").alias(f"_t{i}") for i, c in enumerate(tie)]).alias("o"), "r")
        found = part if found is None else found.union(part)
    best = found.groupBy("l").agg(F.min_by(F.struct("r", F.col("o.distance").alias("distance")), "o").alias("b"))
    each = best.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("l._times"))))
    return each.select(*[F.col(f"l.{c}").alias(c) for c in left.columns], *[F.col(f"b.r.{v}").alias(v) for v in values], "b.distance")


def cascade_join(left: DataFrame, right: DataFrame, levels: list[list[str]], values: list[str], order: list[str]) -> DataFrame:
    """Left rows with values looked up level by level: each level fills only what is still null.

    Of the right rows of a key the first in ``order`` counts. ``level`` is the first level that gave any value (null: none).
    """
    out = left
    for i, keys in enumerate(levels):
        kept = F.min_by(F.struct(*values), F.struct(*order)).alias(f"_v{i}")
        out = out.join(right.groupBy(*keys).agg(kept), keys, "left")
    hits = range(len(levels))
    gave = [F.when(reduce(Column.__or__, [F.col(f"_v{i}.{v}").isNotNull() for v in values]), i + 1) for i in hits]
    picked = [F.coalesce(*[F.col(f"_v{i}.{v}") for i in hits]).alias(v) for v in values]
    return out.select(*left.columns, *picked, F.coalesce(*gave).alias("level"))


def home_away(games: DataFrame, stats: DataFrame, home: str, away: str, key: str, period: list[str], values: list[str]) -> DataFrame:
    """Games with the values of both sides as ``_home`` and ``_away``, and their difference as ``_diff``."""
    out = games
    for side, name in ((home, "home"), (away, "away")):
        own = stats.select(F.col(key).alias(side), *period, *[F.col(v).alias(f"{v}_{name}") for v in values])
        out = out.join(own, [side, *period], "left")
    return out.withColumns({f"{v}_diff": F.col(f"{v}_home") - F.col(f"{v}_away") for v in values})


def unique_lookup(df: DataFrame, key: Column, value: str) -> DataFrame:
    """(key, value) of the keys that stand for exactly one value."""
    return df.groupBy(key.alias("key")).agg(F.min(value).alias(value), F.countDistinct(value).alias("_n")).filter("_n = 1").drop("_n")


def tiered_match(left: DataFrame, right: DataFrame, row: str, tiers: list[tuple[str, list[str]]], value: str) -> DataFrame:
    """Match left rows in tiers of keys; a tier counts only for keys with one right value, and rows keep the first tier that hits."""
    found = []
    for i, (name, keys) in enumerate(tiers):
        one = right.groupBy(*keys).agg(F.min(value).alias("_value"), F.countDistinct(value).alias("_n")).filter("_n = 1").drop("_n")
        found.append(left.join(one, keys).select(row, "_value", F.lit(i).alias("_tier"), F.lit(name).alias("_name")))
    best = reduce(DataFrame.unionByName, found).groupBy(row).agg(F.min_by(F.struct("_value", "_name"), "_tier").alias("m"))
    return left.join(best, row, "left").select(*left.columns, F.col("m._value").alias(value), F.col("m._name").alias("match_method"))


def gap_audit(a: DataFrame, b: DataFrame, keys: list[str], reason_a: str, reason_b: str) -> DataFrame:
    """Keys on one side only, with the reason."""
    left = a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti").withColumn("reason", F.lit(reason_a))
    right = b.select(*keys).distinct().join(a.select(*keys), keys, "left_anti").withColumn("reason", F.lit(reason_b))
    return left.unionByName(right)


#: Widths of the cubes in which near places are looked for: the radius and its halves, so many in all.
CUBE_WIDTHS = 10
AXES = ("x", "y", "z")


def _located(df: DataFrame, key: str, radius_km: float) -> DataFrame:
    """(``key``, lat, lon, x, y, z): rows with coordinates as points in space, in radii."""
    lat, lon = F.radians("lat"), F.radians("lon")
    axes = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    points = df.select(F.col(key), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return points.withColumns({a: v * geo.EARTH_KM / radius_km for a, v in axes.items()}).filter("NOT isnan(x + y + z)")


def _in_cubes(points: DataFrame, level: Column) -> DataFrame:
    """Points with their cube of a level, whose width is the radius halved so often."""
    return points.withColumn("_level", level).withColumns({f"_{a}": F.floor(F.col(a) * F.pow(F.lit(2.0), F.col("_level"))) for a in AXES})


def nearest_places(left: DataFrame, right: DataFrame, row: str, place: str, n: int, radius_km: float) -> DataFrame:
    """(``row``, ``place``, km, rank): of every left row the ``n`` right places nearest to it within ``radius_km``; those that are equally far to a tenth of a millimetre by ``place``.

    Both sides have lat and lon. Points lie on the sphere in space, which is cut into cubes: a left row looks into its own cube and those around it, so that the join is one on equality, and poles
    and the date line are no edges. Cubes are as wide as the radius, or smaller where places are dense: if a row's cube holds ``n`` places, none of the nearest is farther than the cube's diagonal, and cubes twice as wide and
    those around them hold all that are nearer than that. Rows of one position are looked up once, and of the places of one position only the first ``n`` can be among the nearest. Rows without coordinates find nothing.
    """
    levels = F.explode(F.array(*[F.lit(i) for i in range(CUBE_WIDTHS) if i == 0 or radius_km / 2**i > 0.001]))
    cube, at = ["_level", *[f"_{a}" for a in AXES]], ["_lat", "_lon"]
    rows = _located(left, row, radius_km).withColumnsRenamed({"lat": "_lat", "lon": "_lon"})
    first = F.row_number().over(Window.partitionBy("lat", "lon").orderBy(place))
    places = _in_cubes(_located(right, place, radius_km).withColumn("_n", first).filter(F.col("_n") <= n), levels).select(F.col(place), "lat", "lon", *cube)
    full = places.groupBy(*cube).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n)
    asked = _in_cubes(rows.groupBy(*at).agg(*[F.first(a).alias(a) for a in AXES]), levels).join(full.hint("merge"), cube, "left")
    finest = asked.groupBy(*at).agg(F.max(F.when(F.col("_n").isNotNull(), F.col("_level"))).alias("_full"), *[F.first(a).alias(a) for a in AXES])
    looking = _in_cubes(finest, F.greatest(F.col("_full") - 1, F.lit(0))).select(*at, *cube)
    for c in cube[1:]:
        looking = looking.withColumn(c, F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])))
    km = geo.haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    met = looking.join(places.hint("merge"), cube).withColumn("km", km).filter(F.col("km") <= radius_km)
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("km", 7), place))
    near = met.select(*at, place, "km").withColumn("rank", rank(*at)).filter(F.col("rank") <= n)
    found = rows.select(row, *at).join(near, at).select(row, place, "km")
    return found.withColumn("rank", rank(row)).filter(F.col("rank") <= n)
