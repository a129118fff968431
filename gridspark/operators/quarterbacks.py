"""How fit the quarterbacks of a schedule are, from injury reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.text import ladder
from gridspark.operators.windows import ewm, ordered, prior_mean, rows_since

#: Words of status and practice reports in the order in which they are looked for, and what they weigh.
SEVERITY = [
    ("out", 2.0), ("injured reserve", 2.0), ("doubt", 1.5), ("question", 1.0), ("limited", 0.5), ("did not practice", 0.7), ("dnp", 0.7),
]
#: A quarterback with this severity missed the game; with that one the injury is serious, and healed after so many games at most.
MISSED, SERIOUS, HEALED = 1.0, 1.5, 8


def _name(x: Column) -> Column:
    return F.nullif(F.upper(F.trim(x)), F.lit(""))


def _id(x: Column) -> Column:
    return F.nullif(F.trim(x.cast("string")), F.lit(""))


def report_severity(status: Column, practice: Column) -> Column:
    """The heavier of two reports; nothing known weighs nothing."""
    each = [ladder(F.coalesce(x, F.lit("")), SEVERITY, 0.0) for x in (status, practice)]
    return F.greatest(*each)


def team_quarterbacks(schedule: DataFrame, roster: DataFrame) -> DataFrame:
    """(season, week, game_id, team, opponent, qb_name, qb_player_id): both sides of every game whose sides are known.

    The id is the schedule's, else that of the roster's player of the team and name; of several the smallest, so that a game keeps one row a side.
    """
    side = lambda own, other: F.struct(
        F.col(f"{own}_team").alias("team"), F.col(f"{other}_team").alias("opponent"), _name(F.col(f"{own}_qb_name")).alias("qb_name"), _id(F.col(f"{own}_qb_id")).alias("qb_id")
    )
    rows = schedule.filter("season IS NOT NULL AND week IS NOT NULL AND home_team IS NOT NULL AND away_team IS NOT NULL")
    each = rows.select("season", "week", "game_id", F.inline(F.array(side("home", "away"), side("away", "home"))))
    known = roster.select("team", _name(F.col("full_name")).alias("qb_name"), _id(F.col("gsis_id")).alias("listed")).filter("qb_name IS NOT NULL")
    known = known.groupBy("team", "qb_name").agg(F.min("listed").alias("listed"))
    return each.join(known, ["team", "qb_name"], "left").withColumn("qb_player_id", F.coalesce("qb_id", "listed")).drop("qb_id", "listed")


def attach_severity(games: DataFrame, injuries: DataFrame) -> DataFrame:
    """Adds ``qb_status_flag``: the worst report of the week on the quarterback, by his id, else by team and name; 0 without any."""
    passers = injuries.filter(F.contains(F.upper(F.col("position")), F.lit("QB")))
    told = passers.select(
        "season", "week", "team", _name(F.col("player_name")).alias("qb_name"), _id(F.col("player_id")).alias("qb_player_id"),
        report_severity(F.col("status"), F.col("practice")).alias("severity"),
    )
    worst = lambda keys, name: told.dropna(subset=keys).groupBy(*keys).agg(F.max("severity").alias(name))
    out = games.join(worst(["season", "week", "qb_player_id"], "_by_id"), ["season", "week", "qb_player_id"], "left")
    out = out.join(worst(["season", "week", "team", "qb_name"], "_by_name"), ["season", "week", "team", "qb_name"], "left")
    return out.withColumn("qb_status_flag", F.coalesce("_by_id", "_by_name", F.lit(0.0))).drop("_by_id", "_by_name")


def quarterback_health(schedule: DataFrame, injuries: DataFrame, roster: DataFrame) -> DataFrame:
    """One row a team and game: the quarterback's status and what the team's earlier games say of it.

    qb_status_delta_rolling3 is the status against the mean of the last three; qb_missed_last_game, whether the one before was out or doubtful;
    qb_games_started_rolling5 counts the last five games, this one among them; qb_recovery_score_rolling3 is the exponential mean of the games before, and
    qb_weeks_since_injury the games since the last serious status, eight at most. Histories run over seasons.
    """
    rows = attach_severity(team_quarterbacks(schedule, roster), injuries)
    order = ["season", "week", "game_id"]
    w = ordered(["team"], order)
    flag = F.col("qb_status_flag")
    out = ewm(rows, "qb_status_flag", ["team"], order, 3, "_recovery")
    out = rows_since(out, flag >= SERIOUS, ["team"], order, HEALED, "_since")
    return out.select(
        "season", "week", "game_id", "team", "qb_player_id", "qb_status_flag",
        F.coalesce(flag - prior_mean(flag, w, 3), F.lit(0.0)).alias("qb_status_delta_rolling3"),
        F.coalesce(F.lag(flag).over(w) >= MISSED, F.lit(False)).cast("int").alias("qb_missed_last_game"),
        F.count(flag).over(w.rowsBetween(-4, 0)).cast("double").alias("qb_games_started_rolling5"),
        F.coalesce("_recovery", F.lit(0.0)).alias("qb_recovery_score_rolling3"), F.col("_since").cast("double").alias("qb_weeks_since_injury"),
    )
