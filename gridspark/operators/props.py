"""Players' markets: labels and candidates made ready, their history and context before each week, and reports on what was projected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampNTZType, TimestampType

from gridspark.functions import odds, teams
from gridspark.operators.aggregates import auc, scope_rollup
from gridspark.operators.windows import ordered, prior_mean, prior_std
from gridspark.sources.scratch import folder, written

KEYS = ["season", "week", "game_id", "team", "player_id", "market"]
#: Families of markets by what their names begin with, and the markets that count events and no yards.
FAMILIES = {"qb_": "passing", "rb_": "rushing", "wrte_": "receiving", "def_": "defense"}
COUNTED = ("qb_passing_tds", "rb_rushing_tds", "wrte_receiving_tds", "anytime_td", "def_sacks")


def market_family(market: Column) -> Column:
    out = F.lit("other")
    for start, family in FAMILIES.items():
        out = F.when(F.startswith(market, F.lit(start)), family).otherwise(out)
    return out


def _cleaned(df: DataFrame, markets: list[str]) -> DataFrame:
    """Rows with their keys in one spelling. The texts leave a generator, so that what filters them does not make them anew for each condition."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    told = {c: text(c) for c in ("game_id", "player_id")} | {"market": F.lower(text("market"))} | {c: F.nullif(teams.abbreviation(F.col(c)), F.lit("")) for c in ("team", "opponent")}
    told |= {c: F.col(c).try_cast("int") for c in ("season", "week")}
    rows = df.select(F.inline(F.array(F.struct(*[told.get(c, F.col(c)).alias(c) for c in df.columns])))).dropna(subset=[*KEYS, "opponent"])
    return rows.filter((F.col("team") != F.col("opponent")) & F.col("market").isin(*markets)).withColumn("market_family", market_family(F.col("market")))


def _last(df: DataFrame, order: str) -> DataFrame:
    names = [c for c in df.columns if c not in KEYS]
    return df.groupBy(*KEYS).agg(F.max_by(F.struct(*names), order).alias("_l")).select(*KEYS, *[F.col(f"_l.{c}").alias(c) for c in names])


def _last_as_spelt(df: DataFrame, order: str) -> DataFrame:
    """The last row by ``order`` of each key as it is spelt, before keys are cleaned: what is repeated is not cleaned again.

    Texts are keys here and numbers are aggregates, so the rows are held in a hash table and not sorted.
    """
    fixed = (NumericType, BooleanType, DateType, TimestampType, TimestampNTZType)
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, fixed) and f.name not in (*KEYS, "opponent", order)]
    keys = [c for c in df.columns if c not in (*numbers, order)]
    return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in numbers], F.max(order).alias(order)).select(*df.columns)


def prepare_labels(labels: DataFrame, markets: list[str], order: str, before: tuple[int, int] | None = None) -> DataFrame:
    """Labels with their keys, a number and two different teams, in the known ``markets`` and before a (season, week); the last by ``order`` of each key.

    Needs KEYS, opponent and actual_value; actual_over_zero is derived.
    """
    known = labels.withColumn("actual_value", F.col("actual_value").try_cast("double")).dropna(subset=["actual_value"])
    rows = _cleaned(_last_as_spelt(known, order), markets)
    if before:
        rows = rows.filter((F.col("season") < before[0]) | ((F.col("season") == before[0]) & (F.col("week") < before[1])))
    return _last(rows.withColumn("actual_over_zero", F.col("actual_value") > 0), order)


def prepare_candidates(candidates: DataFrame, markets: list[str], order: str) -> DataFrame:
    """Players to be projected, in the form of labels without a value; they count as active and not as played."""
    told = {
        "actual_value": F.lit(None).cast("double"), "actual_over_zero": F.lit(False), "played": F.lit(False), "active": F.lit(True),
        "value_type": F.when(F.col("market").isin(*COUNTED), "count").otherwise("yards"),
    }
    return _last(_cleaned(_last_as_spelt(candidates, order), markets).withColumns(told), order)


def player_history(rows: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """What a player did in a market before each row: games, mean, deviation, last one, three and five, share above 0; and within the season."""
    order, v = ["season", "week", "game_id", "team", *(tie or [])], F.col("actual_value")
    w, s = ordered(["player_id", "market"], order), ordered(["season", "player_id", "market"], order)
    return rows.withColumns({
        "player_games_prior": F.row_number().over(w) - 1, "player_avg_prior": prior_mean(v, w), "player_std_prior": prior_std(v, w), "player_last1_value": F.lag(v).over(w),
        "player_last3_avg": prior_mean(v, w, 3), "player_last5_avg": prior_mean(v, w, 5), "player_over_zero_rate_prior": prior_mean(F.col("actual_over_zero").cast("double"), w),
        "player_season_games_prior": F.row_number().over(s) - 1, "player_season_avg_prior": prior_mean(v, s), "player_season_last3_avg": prior_mean(v, s, 3),
    })


def weekly_context(rows: DataFrame, entity: str, prefix: str) -> DataFrame:
    """Per week, ``entity`` (team, or the opponent that allowed it) and market: means of the totals, means and numbers of players of earlier weeks, over all and the last three."""
    weekly = rows.groupBy("season", "week", entity, "market").agg(
        F.coalesce(F.sum("actual_value"), F.lit(0.0)).alias("total"), F.avg("actual_value").alias("mean"), F.countDistinct("player_id").alias("players")
    )
    w = ordered([entity, "market"], ["season", "week"])
    return weekly.select("season", "week", entity, "market", *[
        prior_mean(F.col(c), w, n).alias(f"{prefix}_{name}")
        for name, c, n in (("weekly_total_avg_prior", "total", None), ("weekly_total_last3_avg", "total", 3), ("weekly_mean_avg_prior", "mean", None), ("weekly_mean_last3_avg", "mean", 3), ("players_avg_prior", "players", None))
    ])


def game_sides(rows: DataFrame) -> DataFrame:
    """is_home and is_away by the teams in season_week_away_home ids; null for ids of another make."""
    parts = F.split("game_id", "_")
    at = lambda i: teams.abbreviation(F.try_element_at(parts, F.lit(i)))
    whole = F.size(parts) >= 4
    return rows.withColumns({"is_home": F.when(whole, F.col("team") == at(4)), "is_away": F.when(whole, F.col("team") == at(3))})


def features(labels: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Labels with history, context of team and opponent, and sides; with ``candidates`` only their rows, to whose weeks the labels are history."""
    rows = labels if candidates is None else labels.withColumn("_asked", F.lit(False)).unionByName(candidates.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    rows = written(rows, folder(rows.sparkSession, "labels") + "/rows")
    out = player_history(rows, None if candidates is None else ["_asked"])
    for entity, prefix in (("team", "team_market"), ("opponent", "opponent_allowed")):
        out = out.join(weekly_context(rows, entity, prefix), ["season", "week", entity, "market"], "left")
    out = game_sides(out)
    return out if candidates is None else out.filter("_asked").drop("_asked")


def probability_input(rows: DataFrame) -> DataFrame:
    """Decided rows with a line, a projection and a result: pushes go; ``residual``, ``model_edge`` and its size come."""
    numbers = ("season", "week", "line", "model_projection", "actual_value")
    out = rows.withColumns({c: F.col(c).try_cast("double") for c in numbers}).dropna(subset=list(numbers)).filter("actual_value <> line")
    edge = F.col("model_projection") - F.col("line")
    return out.withColumns({
        "season": F.col("season").cast("int"), "week": F.col("week").cast("int"), "market": F.trim("market"), "residual": F.col("actual_value") - F.col("model_projection"),
        "actual_over_line": F.col("actual_value") > F.col("line"), "model_edge": edge, "abs_model_edge": F.abs(edge),
    })


def _scores(p: str, y: str) -> dict[str, Column]:
    """Brier score, log loss and share of right sides of a probability where it is there."""
    q, t = odds.held(F.col(p), 1e-6, 1 - 1e-6), F.col(y).cast("double")
    return {"brier": F.avg(F.pow(q - t, 2)), "logloss": F.avg(-(t * F.ln(q) + (1 - t) * F.ln(1 - q))), "pick_accuracy": F.avg(((F.col(p) >= 0.5) == (t == 1)).cast("double"))}


def _areas(rows: DataFrame, p: str, y: str, sets: list[list[str]], out: str) -> DataFrame:
    """The area under the ROC curve for every set of columns, a column outside of it reading "all"."""
    names = sorted({c for s in sets for c in s})
    known = rows.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("_y", F.col(y).cast("int"))
    parts = []
    for s in sets:
        named = auc(known.withColumns({c: F.col(c).cast("string") for c in s}), p, "_y", s).withColumnRenamed("auc", out)
        parts.append(named.withColumns({c: F.lit("all") for c in names if c not in s}).select(*names, out))
    return reduce(DataFrame.unionByName, parts)


def over_probability_summary(scored: DataFrame) -> DataFrame:
    """Over all and by market: how the model's and the market's probabilities of going over did, the projection's side, and by which method rows were calibrated."""
    y = "actual_over_line"
    methods = ("residual_cdf", "market_residual_blend", "market_implied_fallback", "base_rate_fallback")
    each = {f"{who}_{k}": v for who in ("model", "market") for k, v in _scores(f"prob_over_{who}", y).items()}
    side = F.when(F.col("model_edge") != 0, ((F.col("model_edge") > 0) == F.col(y)).cast("double"))
    sums = [
        F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("actual_over_rate"), *[v.alias(k) for k, v in each.items()], F.avg(side).alias("projection_pick_accuracy"),
        F.avg("prob_over_model").alias("mean_prob_over_model"), F.avg("prob_over_market").alias("mean_prob_over_market"), F.avg(F.col("prob_over_model") - F.col("prob_over_market")).alias("mean_prob_edge"),
        *[F.count_if(F.col("method") == m).alias(f"{m}_rows") for m in methods],
    ]
    sets = [[], ["market"]]
    out = scope_rollup(scored, sets, sums)
    for who in ("model", "market"):
        out = out.join(_areas(scored, f"prob_over_{who}", y, sets, f"{who}_auc"), "market", "left")
    return out


def confidence_tier(sample_size: Column) -> Column:
    n = F.coalesce(sample_size, F.lit(0))
    return F.when(n >= 20, "high").when(n >= 5, "medium").otherwise("low")


def attach_tiers(rows: DataFrame, history: DataFrame, order: str) -> DataFrame:
    """Rows with the games that ``history`` (KEYS, player_games_prior) knew of their player before, else their own sample_size, and the tier that makes."""
    known = history.groupBy(*KEYS).agg(F.max_by("player_games_prior", order).alias("_known"))
    size = F.coalesce(F.col("_known"), F.col("sample_size"), F.lit(0)).cast("int")
    out = rows.join(known, KEYS, "left").withColumn("sample_size", size).drop("_known")
    return out.withColumn("confidence_tier", confidence_tier(F.col("sample_size")))


def tier_metrics(rows: DataFrame) -> DataFrame:
    """Over all, by tier, by market and by both: errors of projections, and scores of the probability of more than 0."""
    gap, y = F.col("model_projection") - F.col("actual_value"), "actual_over_zero"
    scores = _scores("prob_over_zero", y)
    both = F.col("prob_over_zero").isNotNull()
    rows = rows.select("market", "confidence_tier", "sample_size", "model_projection", "actual_value", y, "prob_over_zero")
    rows = written(rows, folder(rows.sparkSession, "tiers") + "/rows")
    sums = [
        F.count(F.lit(1)).alias("n_rows"), F.avg("sample_size").alias("avg_sample_size"), F.min("sample_size").alias("min_sample_size"), F.max("sample_size").alias("max_sample_size"),
        F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), scores["brier"].alias("brier_over_zero"), scores["logloss"].alias("logloss_over_zero"),
        F.avg(F.when(both, F.col(y).cast("double"))).alias("actual_over_zero_rate"), F.avg("prob_over_zero").alias("prob_over_zero_mean"),
    ]
    sets = [[], ["confidence_tier"], ["market"], ["market", "confidence_tier"]]
    out = scope_rollup(rows, sets, sums)
    return out.join(_areas(rows, "prob_over_zero", y, sets, "auc_over_zero"), ["market", "confidence_tier"], "left")


def quality_report(rows: DataFrame) -> DataFrame:
    """Over all, by group, by market, and by group, market and book: how many projections have a line, an edge, a word on injuries and rosters, and how lines and edges spread.

    A row without a book stands under no_line, one without a group or market under unknown.
    """
    text = lambda c, default: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))
    named = rows.withColumns({"prediction_group": text("prediction_group", "unknown"), "market": text("market", "unknown"), "sportsbook": text("sportsbook", "no_line")})
    line, flag = F.col("line").isNotNull(), F.coalesce("roster_flag", F.lit("unknown"))
    derived = F.coalesce(F.col("line_type") == "anytime_td_fallback", F.lit(False))
    on = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    with_line = lambda c: F.avg(F.when(line, c))
    sums = [
        F.count(F.lit(1)).alias("rows"), F.count_if(line).alias("rows_with_lines"), F.count_if(line & ~derived).alias("exact_line_rows"), F.count_if(line & derived).alias("fallback_line_rows"),
        F.count_if(~line).alias("missing_line_rows"), on("bettable").alias("bettable_rows"), on("recommended").alias("edge_recommended_rows"),
        *[F.count_if(F.col("edge_tier") == t).alias(f"edge_{t}_rows") for t in ("strong", "lean", "below_threshold", "no_positive_ev", "unavailable")],
        on("injury_reported").alias("injury_reported_rows"), F.count_if(flag != "unknown").alias("roster_validated_rows"), F.count_if(flag == "unknown").alias("roster_unknown_rows"),
        F.count_if(flag == "team_mismatch").alias("roster_mismatch_rows"), F.count_if(flag.isin("inactive_roster", "practice_squad")).alias("roster_exclusion_rows"),
        with_line(F.col("line_range")).alias("avg_line_range"), F.max(F.when(line, F.col("line_range"))).alias("max_line_range"), with_line(F.abs("edge")).alias("avg_abs_edge"),
        with_line(F.col("edge_ev")).alias("avg_edge_ev"), with_line(F.col("book_count")).alias("avg_line_book_count"),
    ]
    return scope_rollup(named, [[], ["prediction_group"], ["market"], ["prediction_group", "market", "sportsbook"]], sums)


def roster_line_audit(predictions: DataFrame, raw: DataFrame, prepared: DataFrame, books: list[str], flags: list[str]) -> DataFrame:
    """Every prediction with one of the roster ``flags``, for every book: how many offers the book has in its market, how many could be read, how many fit, and what came of it.

    Predictions: row, game_id, market, name_key, roster_flag, sportsbook, line. Raw: market, sportsbook. Prepared: game_id, market, name_key, sportsbook. ``books`` is a short list; the offers are counted by market and book before they meet the predictions.
    """
    asked = predictions.filter(F.coalesce(F.lower("roster_flag"), F.lit("unknown")).isin(*flags)).withColumnsRenamed({"sportsbook": "selected_sportsbook", "line": "selected_line"})
    each = asked.withColumn("sportsbook", F.explode(F.array(*[F.lit(b) for b in sorted({b.strip().lower() for b in books})])))
    count = lambda df, keys, name: df.withColumn("sportsbook", F.lower(F.trim("sportsbook"))).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    scope, fit = ["market", "sportsbook"], ["game_id", "market", "name_key", "sportsbook"]
    out = each.join(count(raw, scope, "raw_rows"), scope, "left").join(count(prepared, scope, "prepared_line_rows"), scope, "left").join(count(prepared, fit, "matchable_line_rows"), fit, "left")
    out = out.na.fill(0, ["raw_rows", "prepared_line_rows", "matchable_line_rows"])
    published = F.coalesce((F.lower(F.trim("selected_sportsbook")) == F.col("sportsbook")) & F.col("selected_line").isNotNull(), F.lit(False))
    status = F.when(published, "published").when(F.col("matchable_line_rows") > 0, "matchable_not_published").when(F.col("raw_rows") == 0, "vendor_no_rows")
    status = status.when(F.col("prepared_line_rows") == 0, "raw_unprepared").otherwise("no_matching_line")
    return out.withColumns({"published": published, "line_availability_status": status})


def labels_to_projections(labels: DataFrame, projections: DataFrame) -> DataFrame:
    """Projections with their labels (null where there is none), errors, and the chance of more than 0 that a counted market's projection makes."""
    known = labels.groupBy(*KEYS).agg(F.max("actual_value").alias("actual_value"))
    out = projections.join(known, KEYS, "left")
    gap, p = F.col("projection") - F.col("actual_value"), F.col("projection")
    chance = F.when(F.col("market").isin(*COUNTED), 1 - F.exp(-F.greatest(p, F.lit(0.0))))
    return out.withColumns({"label_available": F.col("actual_value").isNotNull(), "error": gap, "abs_error": F.abs(gap), "squared_error": gap * gap, "prob_over_zero": chance})
