"""State that runs through time across keys: ratings and strengths."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.sources.scratch import folder, written

#: One week of one league: its games in order of their ids, and the league's state, which it may change. Gives one tuple a game.
Week = Callable[[list, dict], Iterator[tuple]]


def fold_weeks(games: DataFrame, step: Week, out: str, weeks_a_job: int = 52) -> DataFrame:
    """The rows that ``step`` gives for every week of every league, the weeks in order.

    Needs league, season, week and game_id. Leagues run side by side. Their states (JSON, one row a league) lie in the shared folder between jobs,
    and a job takes no more than ``weeks_a_job`` weeks on; so a task holds a league's games of those weeks, whatever its history. ``out`` is
    the schema of the tuples, league, season and week first. Games of one id go by home_order and away_order where those are there, else by the sides' names.
    """
    spark = games.sparkSession
    root = folder(spark, "weeks")
    #: One row a week of the calendar.
    calendar = games.select("season", "week").filter("season IS NOT NULL AND week IS NOT NULL").distinct()
    calendar = calendar.withColumn("part", F.floor((F.row_number().over(Window.orderBy("season", "week")) - 1) / weeks_a_job).cast("int"))
    calendar = written(calendar.coalesce(1), f"{root}/calendar")
    parts = (calendar.agg(F.max("part")).first()[0] or 0) + 1
    stored = written(games.join(F.broadcast(calendar), ["season", "week"]), f"{root}/games", "part")
    names = [f.split()[0] for f in out.split(", ")]
    sides = ["home_order", "away_order"] if "home_order" in games.columns else ["home", "away"]

    def run(key: tuple, rows: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        state = json.loads(states["state"].iloc[0]) if len(states) else {}
        found = []
        if len(rows):
            rows = rows.sort_values(["season", "week", "game_id", *sides], kind="stable")
            for _, week in rows.groupby(["season", "week"], sort=True):
                found += step([r for r in week.astype(object).where(week.notna(), None).itertuples(index=False)], state)
        told = pd.DataFrame(found, columns=names)
        told["state"] = None
        last = pd.DataFrame([{names[0]: key[0], "state": json.dumps(state)}])
        return pd.concat([told, last]).reindex(columns=[*names, "state"])

    kind = dict(games.dtypes)["league"]
    states = spark.createDataFrame([], f"league {kind}, state string")
    paths = []
    for part in range(parts):
        rows = stored.filter(F.col("part") == part).drop("part")
        done = rows.groupBy("league").cogroup(states.groupBy("league")).applyInPandas(run, f"{out}, state string")
        paths.append(f"{root}/week-{part}")
        states = written(done, paths[-1]).filter("state IS NOT NULL").select("league", "state")
    return spark.read.schema(f"{out}, state string").parquet(*paths).filter("state IS NULL").drop("state")


def _won(margin: float) -> float:
    return 0.5 if margin == 0 else float(margin > 0)


def _chance(edge: float) -> float:
    return 1 / (1 + 10 ** (-edge / 400))


def _margin_factor(margin: float, winner_edge: float) -> float:
    return math.log(abs(margin) + 1) * 2.2 / (winner_edge * 0.001 + 2.2)


def _sides(games: DataFrame, league: str, *more: str, kept: tuple[str, ...] = ()) -> DataFrame:
    text, number = ("game_id", "home", "away"), ("home_score", "away_score", *more)
    return games.select(
        F.col(league).alias("league"), F.col("season").cast("int").alias("season"), F.col("week").cast("int").alias("week"),
        *[F.col(c).cast("string").alias(c) for c in text], *[F.col(c).cast("double").alias(c) for c in number], *kept,
    )


def _league_type(games: DataFrame, league: str) -> str:
    return dict(games.dtypes)[league]


def elo(
    games: DataFrame, league: str, k: float = 20.0, home_edge: float = 55.0, regress: float = 0.33, start: float = 1500.0, weeks_a_job: int = 52
) -> DataFrame:
    """Ratings before each game: (league, season, week, game_id, home, away, home_elo, away_elo, home_probability).

    All games of a week see the ratings before that week; between seasons every rating is drawn to ``start``. Needs league, season,
    week, game_id, home, away, home_score, away_score; games without scores change nothing. A week's moves are added up by game_id's text, then home and away in their
    own order: where a side plays many games a week, ratings swing, and the last digit of a sum grows from week to week.
    """

    def step(week: list, state: dict) -> Iterator[tuple]:
        rating = state.setdefault("rating", {})
        if state.get("season") not in (None, week[0].season):
            rating.update({t: r + regress * (start - r) for t, r in rating.items()})
        state["season"], moves = week[0].season, {}
        for g in week:
            h, a = rating.get(g.home, start), rating.get(g.away, start)
            edge = h + home_edge - a
            p = _chance(edge)
            yield g.league, g.season, g.week, g.game_id, g.home, g.away, h, a, p
            if g.home_score is not None and g.away_score is not None:
                margin = g.home_score - g.away_score
                held = max(edge * (1 if margin >= 0 else -1), -2000)
                shift = k * math.log(abs(margin) + 1) * 2.2 / (held * 0.001 + 2.2) * (_won(margin) - p)
                moves[g.home] = moves.get(g.home, 0.0) + shift
                moves[g.away] = moves.get(g.away, 0.0) - shift
        rating.update({t: rating.get(t, start) + m for t, m in moves.items()})

    out = f"league {_league_type(games, league)}, season int, week int, game_id string, home string, away string, home_elo double, away_elo double, home_probability double"
    typed = games.withColumns({"home_order": F.col("home"), "away_order": F.col("away")})
    return fold_weeks(_sides(typed, league, kept=("home_order", "away_order")), step, out, weeks_a_job)


#: Ratings begin and rest at MEAN, a season keeps CARRY of the distance to it; exponential means halve in HALF_LIFE games and keep half of theirs.
MEAN, CARRY, STEP, AT_HOME, HALF_LIFE, FORM_CARRY = 1505.0, 2 / 3, 20.0, 48.0, 8.0, 0.5
STRENGTHS = ("strength_elo", "strength_pdiff_ewm", "strength_pass_epa_ewm", "strength_pass_epa_def_ewm", "strength_season_games")
_FORMS = STRENGTHS[1:-1]


def team_strength(games: DataFrame, league: str, weeks_a_job: int = 52) -> DataFrame:
    """Strength of both sides before each game: the columns of ``STRENGTHS`` with _home and _away.

    A margin-adjusted rating; exponential means (half-life of eight games) of the point difference, of pass EPA and of the pass EPA
    conceded; and games of the season so far. What a side has is drawn to the mean (of the rating, or of all games of the league so far) at
    its first game of another season, once however many it missed. A mean that a side lacks is the league's. All games of a week see what was before the week; then its
    final games count one after the other in order of their ids. Missing EPA leaves a mean as it is; games without both scores count nothing.

    Needs season, week, game_id, home, away, home_score, away_score, home_epa, away_epa. A row without season, week or a side has null strengths.
    """
    fade = 1 - 0.5 ** (1 / HALF_LIFE)

    def step(week: list, state: dict) -> Iterator[tuple]:
        teams, means = state.setdefault("teams", {}), state.setdefault("means", {})

        def of(name: str, season: int) -> dict:
            team = teams.setdefault(name, {"elo": MEAN, "season": None, "games": 0, "form": {}})
            if team["season"] not in (None, season):
                team["elo"] = MEAN + (team["elo"] - MEAN) * CARRY
                for key, value in team["form"].items():
                    mean = means[key][0] if key in means else value
                    team["form"][key] = mean + (value - mean) * FORM_CARRY
                team["games"] = 0
            team["season"] = season
            return team

        for g in week:
            shown = []
            for name in (g.home, g.away):
                team = of(name, g.season)
                forms = [team["form"].get(f, means.get(f, [None])[0]) for f in _FORMS]
                shown += [team["elo"], *forms, team["games"]]
            yield g.league, g.season, g.week, g.game_id, g.home, g.away, *shown
        for g in week:
            if g.home_score is None or g.away_score is None:
                continue
            home, away = teams[g.home], teams[g.away]
            margin = g.home_score - g.away_score
            edge = home["elo"] + AT_HOME - away["elo"]
            if margin:
                shift = STEP * _margin_factor(margin, edge if margin > 0 else -edge) * (_won(margin) - _chance(edge))
                home["elo"] += shift
                away["elo"] -= shift
            for team, sign, own, other in ((home, 1, g.home_epa, g.away_epa), (away, -1, g.away_epa, g.home_epa)):
                team["games"] += 1
                for form, value in zip(_FORMS, (sign * margin, own, other), strict=True):
                    if value is None:
                        continue
                    mean, n = means.get(form, [0.0, 0])
                    means[form] = [(mean * n + value) / (n + 1), n + 1]
                    before = team["form"].get(form)
                    team["form"][form] = value if before is None else (1 - fade) * before + fade * value

    wide = [(f"{c}_{side}", "int" if c == STRENGTHS[-1] else "double") for side in ("home", "away") for c in STRENGTHS]
    out = f"league {_league_type(games, league)}, season int, week int, game_id string, home string, away string, " + ", ".join(" ".join(c) for c in wide)
    rows = _sides(games, league, "home_epa", "away_epa")
    whole = F.col("season").isNotNull() & F.col("week").isNotNull() & F.col("home").isNotNull() & F.col("away").isNotNull()
    found = fold_weeks(rows.filter(whole), step, out, weeks_a_job)
    rest = rows.filter(~whole).select(*[c for c in rows.columns if c in found.columns], *[F.lit(None).cast(kind).alias(c) for c, kind in wide])
    return found.unionByName(rest.select(*found.columns))
