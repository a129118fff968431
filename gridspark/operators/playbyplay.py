"""Season tables of teams out of plays, from a list of what is summed for which side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Total:
    """What one play adds to a side's sum; null adds nothing."""

    name: str
    side: str
    value: Column


@dataclass(frozen=True)
class Share:
    """One sum over another; null where that is 0."""

    name: str
    part: tuple[str, ...]
    whole: tuple[str, ...]


def number(c: str) -> Column:
    return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))


def season_table(plays: DataFrame, totals: list[Total], shares: list[Share], keys: list[str], sides: dict[str, str], game: str, mean: str = "{}_mean") -> DataFrame:
    """One row per ``keys`` and team: ``games`` (a game counts once for each side the team was seen on), every total as ``name_sum`` and per game, and the shares.

    ``sides`` names the column that holds the team of each side. A play becomes one row a side; sums of a team are made
    where plays are read, and what is shuffled by game is only which games a team was seen in. A team that was never on a side has null totals there.
    """
    columns = {t.name: F.when(F.col("_side") == t.side, t.value) for t in totals}
    rows = F.array(*[F.struct(F.lit(side).alias("_side"), F.col(c).alias("team")) for side, c in sides.items()])
    each = plays.select("*", F.inline(rows)).filter(F.col("team").isNotNull() & F.col(game).isNotNull())
    group = [*keys, "team"]
    summed = each.groupBy(*group).agg(*[F.sum(v).alias(f"{n}_sum") for n, v in columns.items()])
    played = each.select(*group, "_side", game).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("games"))
    # Both are one row a team; put together by grouping, so that keys which are null meet.
    sums = played.unionByName(summed, allowMissingColumns=True).groupBy(*group).agg(*[F.max(c).alias(c) for c in ("games", *(f"{n}_sum" for n in columns))])
    whole = lambda names: sum((F.col(f"{n}_sum") for n in names[1:]), F.col(f"{names[0]}_sum"))
    means = {mean.format(n): F.try_divide(F.col(f"{n}_sum"), F.col("games")) for n in columns}
    return sums.withColumns(means | {s.name: F.try_divide(whole(s.part), whole(s.whole)) for s in shares})


def _only(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise(0.0)


def offence_and_defence() -> tuple[list[Total], list[Share]]:
    """The totals and shares of a season's team table, over the columns of the play-by-play frame."""
    passes, runs, gained = number("pass_attempt"), number("rush_attempt"), number("yards_gained")
    loss = F.greatest(-gained, F.lit(0.0))
    yards = lambda c: F.coalesce(F.col(c).try_cast("double"), gained)
    tackled = _only(runs > 0, number("tackled_for_loss"))
    recovered = sum((_only(F.coalesce(F.upper(F.trim(F.col(c).cast("string"))) == F.col("team").cast("string"), F.lit(False)), F.lit(1.0)) for c in ("fumble_recovery_1_team", "fumble_recovery_2_team")), F.lit(0.0))
    offence = {
        "passing_attempts": passes, "passing_completions": number("complete_pass"), "passing_yards": _only(passes > 0, yards("passing_yards")),
        "passing_touchdowns": number("pass_touchdown"), "passing_interceptions": number("interception"), "passing_sacks": number("sack"),
        "passing_sack_yards": _only(number("sack") > 0, loss), "passing_air_yards": _only(passes > 0, number("air_yards")),
        "passing_yards_after_catch": _only(passes > 0, number("yards_after_catch")), "rushing_attempts": runs, "rushing_yards": _only(runs > 0, yards("rushing_yards")),
        "rushing_touchdowns": number("rush_touchdown"), "rushing_tlost": tackled, "rushing_tlost_yards": _only(tackled > 0, loss),
        "passing_first_downs": number("first_down_pass"), "rushing_first_downs": number("first_down_rush"),
        "offense_successful_plays": _only(passes + runs > 0, number("success")), "offense_epa": number("epa"),
        "offense_plays": passes + runs, "offense_yards": _only(passes > 0, yards("passing_yards")) + _only(runs > 0, yards("rushing_yards")),
    }
    defence = {
        "defense_sacks": number("sack"), "defense_qb_hits": number("qb_hit"), "defense_interceptions": number("interception"), "defense_forced_fumbles": number("fumble_forced"),
        "defense_fumble_recoveries": recovered, "defense_tloss": number("tackled_for_loss"), "defense_tloss_yards": _only(number("tackled_for_loss") > 0, loss),
        "defense_touchdowns": number("return_touchdown"),
    }
    totals = [Total(n, side, v) for side, names in (("offence", offence), ("defence", defence)) for n, v in names.items()]
    shares = [
        Share("passing_cmp_pct", ("passing_completions",), ("passing_attempts",)), Share("passing_avg_yards", ("passing_yards",), ("passing_attempts",)),
        Share("rushing_avg_yards", ("rushing_yards",), ("rushing_attempts",)), Share("offense_pass_rate", ("passing_attempts",), ("offense_plays",)),
        Share("offense_success_rate", ("offense_successful_plays",), ("offense_plays",)), Share("offense_epa_per_play", ("offense_epa",), ("offense_plays",)),
    ]
    return totals, shares


def game_scores(plays: DataFrame, game: str = "game_id") -> DataFrame:
    """The final score of each game: the highest that any of its plays shows; games without both are left out."""
    best = lambda c: F.max(F.col(c).try_cast("double")).alias(c)
    return plays.filter(F.col(game).isNotNull()).groupBy(game).agg(best("home_score"), best("away_score")).dropna()


def stat_table(stats: DataFrame, keys: list[str], category: str, values: str) -> DataFrame:
    """(keys, stat, mean, total, n) of JSON objects of numbers, one object a row; what is no number is left out, a broken text whole."""
    each = stats.select(*keys, category, F.explode(F.from_json(values, "map<string,string>")).alias("name", "v")).withColumn("v", F.col("v").try_cast("double"))
    named = F.concat_ws("_", F.col(category), F.col("name")).alias("stat")
    return each.filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy(*keys, named).agg(F.avg("v").alias("mean"), F.sum("v").alias("total"), F.count("v").alias("n"))
