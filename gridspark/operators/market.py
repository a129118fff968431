"""Model against market: benchmark columns, closing-line value, policies, the picks ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import odds


def benchmark(df: DataFrame) -> DataFrame:
    """From home_win_prob, home_moneyline, away_moneyline, home_margin: no-vig prices, both sides' picks, agreement, edge and profit."""
    home, away = odds.american_to_implied(F.col("home_moneyline"), None), odds.american_to_implied(F.col("away_moneyline"), None)
    out = df.withColumns({"home_implied_prob_novig": odds.no_vig(home, away), "away_implied_prob_novig": odds.no_vig(away, home)})
    model, market = F.col("home_win_prob") >= 0.5, F.col("home_implied_prob_novig") >= 0.5
    tie, home_won = F.col("home_margin") == 0, F.col("home_margin") > 0
    profit = F.when(model, odds.american_profit(F.col("home_moneyline"), home_won, tie)).otherwise(odds.american_profit(F.col("away_moneyline"), ~home_won, tie))
    side = F.when(model, F.col("home_implied_prob_novig")).otherwise(F.col("away_implied_prob_novig"))
    own = F.greatest(F.col("home_win_prob"), 1 - F.col("home_win_prob"))
    return out.withColumns(
        {"model_home": model, "market_home": market, "favorite_agreement": model == market, "model_pick_prob": own, "prob_edge_model_side": own - side, "home_tie": tie, "model_side_profit": profit}
    )


def spread_grade(df: DataFrame) -> DataFrame:
    """From pred_home_margin, home_margin, spread_line (points the home side gives): edge, side, result and grade."""
    edge, result = F.col("pred_home_margin") - F.col("spread_line"), F.col("home_margin") - F.col("spread_line")
    won = F.when(edge >= 0, result > 0).otherwise(result < 0)
    grade = F.when(result.isNull() | edge.isNull(), "unavailable").when(result == 0, "push").when(won, "win").otherwise("loss")
    return df.withColumns({"edge_points": edge, "result_points": result, "side": F.when(edge >= 0, "home").otherwise("away"), "grade": grade})


def closing_line_value(picks: DataFrame, close: DataFrame) -> DataFrame:
    """Picks (game_id, side, odds) against the closing odds of their side: movement of the break-even probability, and its status."""
    joined = picks.join(close, "game_id", "left")
    closing = F.when(F.col("side") == "home", F.col("home_close")).otherwise(F.col("away_close"))
    value = odds.american_to_implied(closing, None) - odds.american_to_implied(F.col("odds"), None)
    status = F.when(value.isNull(), "missing").when(value > 0, "beat").when(value < 0, "lost").otherwise("even")
    return joined.withColumns({"closing_odds": closing, "clv": value, "clv_status": status})


def best_price(offers: DataFrame, keys: list[str], price: str, tie: list[str]) -> DataFrame:
    """The offer of the highest decimal price of each key."""
    w = Window.partitionBy(*keys).orderBy(odds.american_to_decimal(F.col(price)).desc_nulls_last(), *tie)
    return offers.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def best_policy(summary: DataFrame, keys: list[str], least_bets: int, least_roi: float) -> DataFrame:
    """Of each key's candidates (bets, roi, threshold) the eligible one of highest return, else the best of all; ties to more bets,
    then the lower threshold."""
    ok = (F.col("bets") >= least_bets) & (F.col("roi") > least_roi)
    order = F.struct(F.coalesce(ok, F.lit(False)).alias("eligible"), "roi", "bets", (-F.col("threshold")).alias("t"))
    return summary.groupBy(*keys).agg(F.max_by(F.struct("threshold", "bets", "roi", F.coalesce(ok, F.lit(False)).alias("eligible")), order).alias("p")).select(*keys, "p.*")


def picks_of_record(ledger: DataFrame, lead_hours: int = 2) -> DataFrame:
    """For each game the last pick recorded at least ``lead_hours`` before kickoff (locked), else the first after (late)."""
    lock = F.col("kickoff") - F.expr(f"INTERVAL {lead_hours} HOURS")
    timed = ledger.withColumn("_ok", F.col("recorded_at") <= lock)
    us = F.unix_micros(F.col("recorded_at").cast("timestamp"))
    order = F.struct(F.col("_ok").cast("int"), F.when(F.col("_ok"), us).otherwise(-us))
    named = F.struct(*ledger.columns, F.when(F.col("_ok"), "locked").otherwise("late").alias("status"))
    return timed.groupBy("game_id").agg(F.max_by(named, order).alias("p")).select("p.*")


def publish_status(ev: Column, severity: Column, known: Column, least_ev: float = 0.02) -> Column:
    """Ladder of reasons for which an edge is held back."""
    return F.when(~F.coalesce(known, F.lit(False)), "no_roster").when(severity >= 0.75, "injury").when(ev.isNull(), "no_price").when(ev < least_ev, "no_edge").otherwise("publish")


def signal_score(df: DataFrame, parts: dict[str, float], key: str) -> DataFrame:
    """Weighted mean of percentile ranks (ties at their mean) within a key; a null part counts as 0."""
    out = df
    for name in parts:
        value = Window.partitionBy(key, name)
        rank = F.rank().over(Window.partitionBy(key).orderBy(F.col(name).asc_nulls_first())) + (F.count(F.lit(1)).over(value) - 1) / 2
        out = out.withColumn(f"_{name}", F.when(F.col(name).isNotNull(), rank / F.count(F.lit(1)).over(Window.partitionBy(key))).otherwise(0.0))
    total = sum((F.col(f"_{n}") * w for n, w in parts.items()), F.lit(0.0))
    return out.withColumn("signal_score", total / sum(parts.values())).drop(*[f"_{n}" for n in parts])


def wide_odds(offers: DataFrame, key: str, book: str, books: list[str], values: list[str], order: str) -> DataFrame:
    """One row per game with ``odds_{book}_{value}`` of the named books: the last offer of each; one pass and no pivot's extra scan."""
    last = [
        F.max_by(v, F.when(F.col(book) == b, F.col(order))).alias(f"odds_{b}_{v}") for b in books for v in values
    ]
    return offers.filter(F.col(book).isin(*books)).groupBy(key).agg(*last)


def filled_from_opponent(df: DataFrame, pairs: dict[str, str], team: str, opponent: str, period: list[str]) -> DataFrame:
    """Defensive values, and where they are missing what the opponent's offence did in the same period; ``_source`` says which."""
    other = df.select(F.col(team).alias(opponent), *period, *[F.col(o).alias(f"_o_{d}") for d, o in pairs.items()])
    out = df.join(other, [opponent, *period], "left")
    new = {d: F.coalesce(F.col(d), F.col(f"_o_{d}")) for d in pairs}
    source = {f"{d}_source": F.when(F.col(d).isNotNull(), "own").when(F.col(f"_o_{d}").isNotNull(), "opponent").otherwise("none") for d in pairs}
    return out.withColumns(source).withColumns(new).drop(*[f"_o_{d}" for d in pairs])


def board_status(df: DataFrame, rules: list[tuple[str, str, Column]], default: tuple[str, str]) -> DataFrame:
    """``status`` and ``reason`` of the first rule (status, reason, condition) that holds; a null condition does not."""
    status, reason = F.lit(default[0]), F.lit(default[1])
    for s, r, holds in reversed(rules):
        on = F.coalesce(holds, F.lit(False))
        status, reason = F.when(on, s).otherwise(status), F.when(on, r).otherwise(reason)
    return df.withColumn("status", status).withColumn("reason", reason)


def attach_policy(df: DataFrame, bins: DataFrame, segment: str, prob: str, width: float, least: int) -> DataFrame:
    """Calibrated probability of each row: its (segment, bin) if that has ``least`` rows, else its bin over all segments, else its own.

    ``bins``: segment, bin, n, rate. Small tables, joined by key.
    """
    cell = F.floor(F.col(prob) / width + 1e-9).cast("int")
    own = bins.filter(F.col("n") >= least).select(segment, F.col("bin").alias("_bin"), F.col("rate").alias("_own"))
    whole = bins.groupBy(F.col("bin").alias("_bin")).agg(F.sum("n").alias("_n"), F.try_divide(F.sum(F.col("n") * F.col("rate")), F.sum("n")).alias("_all"))
    whole = whole.filter(F.col("_n") >= least).drop("_n")
    out = df.withColumn("_bin", cell).join(own, [segment, "_bin"], "left").join(whole, "_bin", "left")
    level = F.when(F.col("_own").isNotNull(), "segment").when(F.col("_all").isNotNull(), "overall").otherwise("raw")
    return out.withColumn("calibrated", F.coalesce("_own", "_all", F.col(prob))).withColumn("calibration_level", level).drop("_bin", "_own", "_all")


def travel(schedule: DataFrame, venues: DataFrame, at: str, km) -> DataFrame:
    """Distance (``km`` of two points) and hours' shift of each side between its home venue and the game's.

    schedule: game_id, venue, home, away; venues: venue, team, lat, lon and the offset from UTC in hours, one row a team.
    """
    place = venues.select(F.col("venue").alias(at), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("offset").alias("_off")).dropDuplicates([at])
    out = schedule.join(place, at, "left")
    for side in ("home", "away"):
        own = venues.select(F.col("team").alias(side), F.col("lat").alias("_a"), F.col("lon").alias("_b"), F.col("offset").alias("_c"))
        out = out.join(own, side, "left").withColumns(
            {f"{side}_km": km(F.col("_a"), F.col("_b"), F.col("_lat"), F.col("_lon")), f"{side}_shift": F.abs(F.col("_c") - F.col("_off"))}
        ).drop("_a", "_b", "_c")
    return out.drop("_lat", "_lon", "_off")
