"""Predictions against results: weekly metrics, what went wrong, model and market side by side, volatile games."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions import bins, odds
from gridspark.functions.time import week_bucket
from gridspark.operators.aggregates import auc, scope_rollup
from gridspark.operators.reshape import sides


def decided(predictions: DataFrame, actuals: DataFrame, keys: list[str], made_at: str) -> DataFrame:
    """The last prediction of each key (by ``made_at``) with its decided result, its errors, and whether it took the wrong side.

    Predictions: home_win_prob, pred_home_margin; actuals: home_margin (null: not over; 0: a tie, which decides nothing).
    """
    kept = [c for c in predictions.columns if c not in keys]
    last = predictions.groupBy(*keys).agg(F.max_by(F.struct(*kept), made_at).alias("_p")).select(*keys, "_p.*")
    p, y = odds.held(F.col("home_win_prob"), 0.0, 1.0), F.col("actual_home_win")
    safe = lambda x: odds.held(x, 1e-9, 1 - 1e-9)
    rows = last.join(actuals, keys).filter("home_margin <> 0").withColumns({"home_win_prob": p, "actual_home_win": (F.col("home_margin") > 0).cast("int")})
    gap = F.col("pred_home_margin") - F.col("home_margin")
    q = F.col("home_win_prob")
    return rows.withColumns({
        "misclassified": (q >= 0.5) != (y == 1), "prob_error_sq": F.pow(q - y, 2), "log_loss_component": -(y * F.ln(safe(q)) + (1 - y) * F.ln(safe(1 - q))), "margin_error": gap, "abs_margin_error": F.abs(gap),
    })


def metrics(keys: list[str], rows: DataFrame) -> DataFrame:
    """Games, accuracy, Brier score, log loss and margin errors by ``keys`` (one row without any), with the area under the ROC curve."""
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_games"), F.avg(1 - F.col("misclassified").cast("double")).alias("accuracy"), F.avg("prob_error_sq").alias("brier"), F.avg("log_loss_component").alias("log_loss"),
        F.avg("abs_margin_error").alias("mae_margin"), F.sqrt(F.avg(F.col("margin_error") * F.col("margin_error"))).alias("rmse_margin"),
    )
    areas = auc(rows, "home_win_prob", "actual_home_win", keys)
    return sums.join(areas, keys, "left") if keys else sums.crossJoin(F.broadcast(areas))  # one row and one row


def probability_bins(rows: DataFrame, edges: list[float] | None = None) -> DataFrame:
    """Right-closed bins of the predicted probability: games, mean probability, rate and mean margin error; bins without games are there too."""
    edges = edges or [i / 10 for i in range(11)]
    every = rows.sparkSession.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))], "bin int, low double, high double")
    sums = rows.withColumn("bin", bins.right_closed(F.col("home_win_prob"), edges)).filter("bin IS NOT NULL").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n_games"), F.avg("home_win_prob").alias("mean_prob"), F.avg("actual_home_win").alias("actual_win_rate"), F.avg("margin_error").alias("mean_margin_error")
    )
    return every.join(sums, "bin", "left").na.fill(0, ["n_games"])


def team_errors(rows: DataFrame, home: str = "home_team", away: str = "away_team") -> DataFrame:
    """By team, from both sides of its games: how many, mean margin error, and share of games on the wrong side."""
    each = sides(rows, {"team": home}, {"team": away}, ("home", "away"), ["abs_margin_error", "misclassified"])
    return each.groupBy("team").agg(
        F.count(F.lit(1)).alias("n_games"), F.avg("abs_margin_error").alias("mean_abs_margin_error"), F.avg(F.col("misclassified").cast("double")).alias("misclassified_rate")
    )


def worst(rows: DataFrame, n: int = 10, confident: float = 0.2) -> DataFrame:
    """The ``n`` largest margin errors, and the ``n`` surest of the confident predictions that took the wrong side; ties by game_id."""
    sure = F.abs(F.col("home_win_prob") - 0.5)
    far = rows.orderBy(F.desc("abs_margin_error"), "game_id").limit(n).select("game_id", F.lit("margin").alias("report"), F.col("abs_margin_error").alias("value"))
    missed = rows.filter(F.col("misclassified") & (sure >= confident)).orderBy(sure.desc(), "game_id").limit(n).select("game_id", F.lit("confidence").alias("report"), sure.alias("value"))
    return far.unionByName(missed)


def no_vig_home(home: Column, away: Column) -> Column:
    """The home side's part of both implied probabilities, held to 0.0001 and 0.9999; null without both."""
    return odds.held(F.when(home + away > 0, home / (home + away)), 1e-4, 1 - 1e-4)


def attach_market(history: DataFrame, features: DataFrame, order: str) -> DataFrame:
    """History with ``market_prob``, the no-vig probability of the game's last feature row by ``order``."""
    p = no_vig_home(F.col("implied_home"), F.col("implied_away"))
    return history.join(features.groupBy("game_id").agg(F.max_by(p, order).alias("market_prob")), "game_id", "left")


def against_market(rows: DataFrame, sources: list[str], market: str = "market_prob") -> DataFrame:
    """Over all, by season and by part of the season: scores of each source's probability and of the market's on the same decided games, and their differences.

    Needs season, week and home_margin; a game without any of the probabilities, or tied, is out for all of them.
    """
    names = [*sources, market]
    whole = rows.filter("home_margin <> 0").dropna(subset=names).withColumns({"y": (F.col("home_margin") > 0).cast("int"), "week_bucket": F.coalesce(week_bucket(F.col("week")), F.lit("unknown"))})
    pairs = F.array(*[F.named_struct(F.lit("source"), F.lit(n), F.lit("p"), F.col(n)) for n in names])
    each = whole.select("season", "week_bucket", "y", F.inline(pairs)).withColumn("q", odds.held(F.col("p"), 1e-6, 1 - 1e-6))
    q, y = F.col("q"), F.col("y")
    sums = [
        F.count(F.lit(1)).alias("n_games"), F.avg(F.pow(q - y, 2)).alias("brier"), F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("logloss"), F.avg(((q >= 0.5) == (y == 1)).cast("double")).alias("accuracy"),
    ]
    sets = [["source"], ["source", "season"], ["source", "week_bucket"]]
    out = scope_rollup(each, sets, sums)
    areas = None
    for s in sets:
        part = auc(each.withColumn("season", F.col("season").cast("string")), "q", "y", s)
        part = part.withColumns({c: F.lit("all") for c in ("season", "week_bucket") if c not in s}).select("source", "season", "week_bucket", "auc")
        areas = part if areas is None else areas.unionByName(part)
    out = out.join(areas, ["source", "season", "week_bucket"], "left")
    names = ("brier", "logloss", "accuracy", "auc")
    base = out.filter(F.col("source") == market).select("season", "week_bucket", *[F.col(c).alias(f"_{c}") for c in names])
    return out.join(base, ["season", "week_bucket"]).withColumns({f"{c}_minus_market": F.col(c) - F.col(f"_{c}") for c in names}).drop(*[f"_{c}" for c in names])


def attach_blend(games: DataFrame, blend: DataFrame, order: str) -> DataFrame:
    """Games with what the blend of model and market picked: its last row of each (season, week, game_id) by ``order``, whom it followed, and its profit.

    Games: model_home_pick and market_home_pick, which differ; blend: blend_home_pick, blend_correct, blend_profit. ``blend_followed`` is model, vegas, or unavailable without a blend.
    """
    keys = ["season", "week", "game_id"]
    last = blend.groupBy(*keys).agg(F.max_by(F.struct("blend_home_pick", "blend_correct", "blend_profit"), order).alias("_b"))
    out = games.join(last, keys, "left").select(*games.columns, "_b.*")
    pick = F.col("blend_home_pick")
    followed = F.when(pick.isNull(), "unavailable").when(pick == F.col("model_home_pick"), "model").when(pick == F.col("market_home_pick"), "vegas").otherwise("other")
    return out.withColumns({"blend_available": F.col("blend_home_pick").isNotNull(), "blend_followed": followed})


#: Columns that pass into the matrix of volatile games as they are, and words on quarterbacks of this week and of the last ones.
VOLATILE_AS_IS = (
    "home_rest", "away_rest", "sched_rest_days_home", "sched_rest_days_away", "sched_back_to_back_travel_home", "sched_back_to_back_travel_away", "away_travel_distance_km",
    "away_travel_distance_miles", "timezone_diff_hours", "timezone_diff_hours_abs", "away_travel_east", "away_travel_west", "travel_km_short_rest", "travel_km_back_to_back",
    "travel_km_per_rest_day", "timezone_diff_short_rest",
)
QB_NOW = tuple(f"inj_qb_{w}_{s}" for w in ("questionable", "doubtful", "out", "reserve") for s in ("home", "away"))
QB_RECENT = tuple(f"inj_{w}_rolling3_{s}" for w in ("qb_questionable", "qb_doubtful", "qb_reserve", "practice_limited") for s in ("home", "away"))


def volatility_matrix(games: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs of a model of volatile games, all numbers, 0 where unknown: weather and how it moved, quarterbacks in doubt, rest, travel, roof, and how sure and at one the predictions are.

    Columns that the table lacks count as null.
    """
    have = set(games.columns)
    col = lambda c: F.col(c).try_cast("double") if c in have else F.lit(None).cast("double")
    first = lambda *names: F.coalesce(*[col(c) for c in names])
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    wind = first("weather_wind_mph_wx", "weather_wind_mph", "wind")
    temp = first("weather_temp_kickoff_f_wx", "weather_temp_kickoff_f", "weather_temp_f_wx", "weather_temp_f", "temp")
    off = F.abs(temp - 60)
    now, recent = (sum((zero(col(c)) for c in names), F.lit(0.0)) for names in (QB_NOW, QB_RECENT))
    km, hours = zero(col("away_travel_distance_km")), zero(col("timezone_diff_hours_abs"))
    indoor = (zero(col("roof_is_dome")) != 0) | (zero(col("home_indoor")) != 0) | (zero(col("away_indoor")) != 0)
    p = first("home_win_prob", "home_win_prob_capped", "home_win_prob_calibrated", "home_win_prob_model_raw")
    p = F.when((p >= 0) & (p <= 1), p)
    sure, safe = F.abs(p - 0.5), odds.held(p, 1e-6, 1 - 1e-6)
    margin = F.abs(col("pred_home_margin"))
    told = {
        "wind_mph": wind, "temp_f": temp, "weather_temp_deviation": off, "wind_temp_interaction": zero(wind) * zero(off), "weather_temp_delta": temp - first("weather_temp_f", "temp"),
        "wind_mph_delta": wind - first("wind", "weather_wind_mph"), "qb_uncertainty_score": now + recent, "qb_uncertain": flag((now > 0) | (recent > 0)), "qb_uncertainty_recent": now,
        "qb_uncertainty_trend": now - recent, "short_rest": flag(F.least(col("home_rest"), col("away_rest")) <= 6),
        "back_to_back_travel": flag((zero(col("sched_back_to_back_travel_home")) > 0) | (zero(col("sched_back_to_back_travel_away")) > 0)), "indoor_game": flag(indoor), "outdoor_game": flag(~indoor),
        **{c: col(c) for c in VOLATILE_AS_IS}, "travel_timezone_product": km * hours, "travel_short_rest_flag": flag(zero(col("travel_km_short_rest")) > 0),
        "travel_rest_pressure": km * F.greatest(F.lit(0.0), 7 - zero(col("away_rest"))), "rest_diff": col("home_rest") - col("away_rest"), "rest_days_diff": col("sched_rest_days_home") - col("sched_rest_days_away"),
        "model_confidence_abs": sure, "model_uncertainty": odds.held(1 - 2 * sure, 0.0, 1.0), "model_logit_abs": F.abs(F.ln(safe / (1 - safe))), "pred_margin_abs": margin,
        "pred_margin_confidence": F.tanh(margin / 14), "model_margin_disagreement": F.abs(sure - F.tanh(margin / 14)),
    }
    return games.select(*keys, *[zero(v).cast("double").alias(k) for k, v in told.items()])


def shrink_volatile(
    rows: DataFrame, threshold: float, strength: float, margin_strength: float = 0.0, p: str = "home_win_prob", margin: str = "pred_home_margin", volatility: str = "volatility_prob"
) -> DataFrame:
    """Probabilities and margins of volatile games drawn to the market's: by their volatility times the strength. Without a line, to a half and to 0.

    Needs implied_home, implied_away and spread_close_home. ``volatile`` says which games were.
    """
    home, away = F.col("implied_home"), F.col("implied_away")
    anchor = F.coalesce(F.when((home > 0) & (away > 0), home / (home + away)), F.lit(0.5))
    level = F.coalesce(F.col("spread_close_home").cast("double"), F.lit(0.0))
    v = F.coalesce(F.col(volatility), F.lit(0.0))
    on = v >= threshold
    drawn = lambda x, to, s: F.when(on, to + (x - to) * (1 - max(0.0, min(1.0, s)) * v)).otherwise(x)
    new = {p: drawn(F.col(p), anchor, strength), "volatile": on.cast("int")}
    if margin_strength > 0:
        new[margin] = drawn(F.col(margin), level, margin_strength)
    return rows.withColumns(new)


def unstarted(games: DataFrame, now: Column, kickoff: Column) -> DataFrame:
    """Games that have not begun at ``now``, and those whose kickoff is not known."""
    return games.filter(F.coalesce(kickoff > now, F.lit(True)))


def supported_seasons(df: DataFrame, season: str, least: int | None = None, most: int | None = None) -> DataFrame:
    """Rows of the seasons that a source has."""
    out = df if least is None else df.filter(F.col(season) >= least)
    return out if most is None else out.filter(F.col(season) <= most)


def replace_week(stored: DataFrame, new: DataFrame, season: int, week: int) -> DataFrame:
    """A cumulative table with one week's rows replaced by ``new``; without new rows the week is gone, and all others stay."""
    kept = stored.filter(~(F.col("season").eqNullSafe(F.lit(season)) & F.col("week").eqNullSafe(F.lit(week))))
    return kept.unionByName(new, allowMissingColumns=True)


def same_columns(*tables: DataFrame) -> tuple[list[str], list[list[str]]]:
    """Columns that all tables have, in the order of the first, and what each has beside them."""
    shared = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
    return shared, [sorted(set(t.columns) - set(shared)) for t in tables]


def top_features(values: DataFrame, n: int, feature: str = "feature", value: str = "value") -> DataFrame:
    """The ``n`` features with the greatest mean size of (row, feature, value), ties by name, with their rank."""
    mean = values.groupBy(feature).agg(F.avg(F.abs(value)).alias("mean_abs"), F.avg(value).alias("mean"))
    return mean.orderBy(F.desc("mean_abs"), feature).limit(n)
