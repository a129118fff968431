"""Manifests of what has to be fetched: games matched to the events of their week, and how far each one is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_events(manifest: DataFrame, events: DataFrame) -> DataFrame:
    """The manifest with ``event_id`` and ``events_status``: matched, no_match (the week has events, none of them fits) or pending.

    Of the events of a game's week and sides the nearest in time counts, however far; of equally near ones the smaller id, one without a time last. A game that no event
    fits keeps the id that it had, so a run over what an earlier one left gives the same. Without any events the manifest stays as it is.

    Manifest: season, week, home, away, kickoff, event_id, events_status. Events: season, week, home, away, event_id, starts.
    """
    known = events.filter("season IS NOT NULL AND week IS NOT NULL")
    weeks = known.select("season", "week").distinct().withColumn("_has", F.lit(True))
    sides = ["season", "week", "home", "away"]
    offered = known.filter("event_id IS NOT NULL").select(*sides, F.col("event_id").alias("_event"), "starts")
    gap = F.abs(F.unix_micros(F.col("kickoff").cast("timestamp")) - F.unix_micros(F.col("starts").cast("timestamp")))
    # Events of one time stand for their smallest id, and games of one kickoff are asked for once: what is paired are the times of a week's sides, not their rows.
    times = offered.groupBy(*sides, "starts").agg(F.min("_event").alias("_event"))
    near = manifest.select(*sides, "kickoff").distinct().join(times, sides)
    best = near.groupBy(*sides, "kickoff").agg(F.min_by("_event", F.struct(gap.isNull(), gap, "_event")).alias("_event"))
    best = best.withColumnsRenamed({c: f"_{c}" for c in (*sides, "kickoff")})
    same = reduce(Column.__and__, [F.col(c) == F.col(f"_{c}") for c in sides], F.col("kickoff").eqNullSafe(F.col("_kickoff")))
    none = known.limit(1).select(F.lit(True).alias("_any"))  # one row, or none
    out = manifest.join(best, same, "left").join(weeks, ["season", "week"], "left").join(F.broadcast(none), F.lit(True), "left")
    event = F.coalesce("_event", "event_id")
    status = F.when(event.isNotNull(), "matched").when(F.col("_has"), "no_match").otherwise("pending")
    changed = {"event_id": event, "events_status": F.when(F.col("_any"), status).otherwise(F.col("events_status"))}
    return out.select(*[changed.get(c, F.col(c)).alias(c) for c in manifest.columns])


def _with_markets(manifest: DataFrame, found: DataFrame, keys: list[str], on: Column, other: list[str]) -> DataFrame:
    """The manifest with the set of markets found for each of its events, as ``_found``."""
    sets = found.dropna(subset=keys).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.collect_set("market").alias("_found"))
    return manifest.join(sets, on, "left").select(*other, "_found")


def market_status(manifest: DataFrame, markets: DataFrame) -> DataFrame:
    """``markets_status`` from (event_id, market): missing_event, pending (nothing seen of the event), available (a target among them) or no_target_markets.

    The manifest's targets are an array of markets.
    """
    other = [c for c in manifest.columns if c != "markets_status"]
    out = _with_markets(manifest, markets, ["event_id"], F.col("event_id") == F.col("_k0"), other)
    status = F.when(F.col("event_id").isNull(), "missing_event").when(F.col("_found").isNull(), "pending")
    status = status.when(F.arrays_overlap("targets", "_found"), "available").otherwise("no_target_markets")
    return out.withColumn("markets_status", status).drop("_found")


def odds_status(manifest: DataFrame, odds: DataFrame) -> DataFrame:
    """``odds_status`` from (event_id, snapshot, market): done once all targets are there for the manifest's snapshot; else missing_event, no_target_markets or pending."""
    other = [c for c in manifest.columns if c != "odds_status"]
    same = (F.col("event_id") == F.col("_k0")) & (F.col("snapshot") == F.col("_k1"))
    out = _with_markets(manifest, odds, ["event_id", "snapshot"], same, other)
    done = (F.size("targets") > 0) & (F.size(F.array_except("targets", "_found")) == 0)
    status = F.when(F.col("event_id").isNull(), "missing_event").when(F.coalesce(done, F.lit(False)), "done")
    return out.withColumn("odds_status", status.when(F.col("markets_status") == "no_target_markets", "no_target_markets").otherwise("pending")).drop("_found")


def open_weeks(manifest: DataFrame) -> DataFrame:
    """The weeks that still have a game without an event, one row each."""
    return manifest.filter("events_status = 'pending'").groupBy("season", "week").agg(F.count(F.lit(1)).alias("games"), F.min("kickoff").alias("first_kickoff"))
