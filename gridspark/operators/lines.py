"""Offered lines against what a model projected and what came: every line with the way it was matched, or why it was not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import odds, teams, text
from gridspark.operators.aggregates import scope_rollup
from gridspark.sources.scratch import folder, written

GAME = ["season", "week", "game_id", "market"]
#: Markets whose lines an initial and a last name alone must not match.
STRICT_MARKETS = ("first_td", "last_td", "anytime_td")


def with_row_id(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """A row's id from the text of ``columns``, and its number among rows that are alike there: no order of the whole table is needed."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    rest = [c for c in df.columns if c not in columns]
    marked = df.withColumn("_digest", digest)
    alike = Window.partitionBy("_digest").orderBy(*[F.col(c) for c in rest]) if rest else Window.partitionBy("_digest").orderBy("_digest")
    return marked.withColumn(out, F.concat_ws(":", "_digest", F.row_number().over(alike).cast("string"))).drop("_digest")


def with_name_keys(df: DataFrame) -> DataFrame:
    """The keys of ``player_name``. Its words leave a generator: they are made once a row, and no filter on the keys makes them anew."""
    words = df.select("*", F.inline(F.array(F.struct(text.name_parts(F.col("player_name")).alias("_words")))))
    key = lambda letters: F.when(F.size("_words") > 1, F.concat_ws(":", F.substring(F.col("_words")[0], 1, letters), F.element_at("_words", -1)))
    return words.withColumns({"name_key": key(1), "prefix_key": key(2)}).drop("_words")


def prepare_lines(lines: DataFrame, books: list[str] | None = None, comparable_only: bool = False) -> DataFrame:
    """Lines with a number, their book in lower case, the keys of their player's name and a ``line_id``.

    Needs the columns of GAME, sportsbook, player_name, line, comparable, over_odds and under_odds.
    """
    book = F.lower(F.trim("sportsbook"))
    rows = with_name_keys(lines.withColumn("sportsbook", book))
    rows = rows.withColumns({"comparable": F.coalesce("comparable", F.lit(False)), "line": F.col("line").cast("double")}).dropna(subset=[*GAME, "name_key", "sportsbook", "line"])
    if books:
        rows = rows.filter(F.col("sportsbook").isin(*[b.strip().lower() for b in books]))
    return with_row_id(rows.filter("comparable") if comparable_only else rows, [*GAME, "name_key", "sportsbook", "line"], "line_id")


def prepare_predictions(predictions: DataFrame, order: str) -> DataFrame:
    """The last prediction by ``order`` of every game, market and player, with the keys of the player's name.

    Needs the columns of GAME, player_id, player_name, projection and actual.
    """
    spelt = predictions.groupBy(*GAME, "player_id", "player_name").agg(*[F.max_by(c, order).alias(c) for c in ("projection", "actual")], F.max(order).alias("_order"))
    last = spelt.groupBy(*GAME, "player_id").agg(F.max_by(F.struct("player_name", "projection", "actual"), "_order").alias("p")).select(*GAME, "player_id", "p.*")
    return with_name_keys(last).dropna(subset=[*GAME, "name_key"])


def identities(identity: DataFrame) -> DataFrame:
    """(season, week, team, name_key, prefix_key) of names that stand for one player, with his id and the surest alias."""
    keys = ["season", "week", "team", "name_key", "prefix_key"]
    known = identity.dropna(subset=[*keys, "player_id"]).select(*keys, "player_id", "alias", "confidence").distinct()
    one = known.groupBy(*keys).agg(
        F.countDistinct("player_id").alias("_n"), F.min("player_id").alias("identity_id"), F.max_by("alias", F.struct(F.coalesce("confidence", F.lit(0.0)), "alias")).alias("alias")
    )
    return one.filter("_n = 1").drop("_n")


def match_lines(lines: DataFrame, predictions: DataFrame, identity: DataFrame, strict_markets: tuple[str, ...] = STRICT_MARKETS) -> DataFrame:
    """Every prepared line with its prediction, ``match_method`` and ``reason``.

    Three tiers, each for what the ones before left: the player whom one of the game's teams knows by that name (identity_strict), the same initial letters and last name
    (strict_prefix; of several players the smallest id), and the initial and last name where both a line's and a prediction's are the only ones in the game and market
    (initial_last_unique; not in ``strict_markets``). What is not matched says why, by the last tier that could have matched it:
    no_prediction (none in its game and market), strict_market, several_lines, several_players, or no_such_name.
    """
    name, spot, root = [*GAME, "name_key"], [*GAME, "name_key", "prefix_key"], folder(lines.sparkSession, "matches")
    shown = F.struct("player_id", F.col("player_name").alias("model_player_name"), "projection", "actual").alias("_p")
    spots = written(predictions.select(*GAME, "player_id", "name_key", "prefix_key", shown), f"{root}/predictions")
    #: What a line's match depends on is its game, market and name: lines that share these are matched once.
    asked = written(lines.select(*spot).distinct(), f"{root}/names")
    team = asked.select(*spot, F.explode(teams.game_teams(F.col("game_id").cast("string"))).alias("team"))
    known = team.join(identities(identity), ["season", "week", "team", "name_key", "prefix_key"])
    sure = known.join(spots.select(*GAME, F.col("player_id").alias("identity_id"), "_p"), [*GAME, "identity_id"])
    sure = sure.groupBy(*spot).agg(F.countDistinct("identity_id").alias("_n"), F.min_by(F.struct("_p", "alias"), F.struct("identity_id", "team")).alias("m")).filter("_n = 1")
    first = sure.select(*spot, F.lit(0).alias("tier"), "m._p", "m.alias")
    strict = asked.join(spots.drop("player_id"), spot).groupBy(*spot).agg(F.min_by("_p", "_p.player_id").alias("_p"))
    second = strict.select(*spot, F.lit(1).alias("tier"), "_p", F.lit(None).cast("string").alias("alias"))
    tiers = first.unionByName(second).groupBy(*spot).agg(F.min_by(F.struct("_p", "alias", "tier"), "tier").alias("m"))
    #: Names that the first two tiers left, with how many prefixes and predictions they have in game and market.
    rest = asked.join(tiers, spot, "left")
    prefixes = rest.filter("m IS NULL").groupBy(*name).agg(F.countDistinct("prefix_key").alias("_prefixes"))
    people = spots.groupBy(*name).agg(F.count(F.lit(1)).alias("_people"), F.min_by("_p", "player_id").alias("_only"))
    games = spots.groupBy(*GAME).agg(F.count(F.lit(1)).alias("_game"))
    out = rest.join(prefixes, name, "left").join(people, name, "left").join(games, GAME, "left")
    left, loose = F.col("m").isNull(), ~F.col("market").isin(*strict_markets)
    third = left & loose & (F.col("_prefixes") <= 1) & (F.col("_people") == 1)
    method = F.when(F.col("m.tier") == 0, "identity_strict").when(F.col("m.tier") == 1, "strict_prefix").when(third, "initial_last_unique")
    reason = F.when(method.isNotNull(), F.lit(None)).when(F.col("_game").isNull(), "no_prediction").when(F.col("_people").isNull(), "no_such_name")
    reason = reason.when(~loose, "strict_market").when(F.col("_people") > 1, "several_players").otherwise("several_lines")
    chosen = F.when(third, F.col("_only")).otherwise(F.col("m._p"))
    matches = written(out.select(*spot, method.alias("match_method"), reason.alias("reason"), F.col("m.alias").alias("alias"), chosen.alias("_c")), f"{root}/matches")
    return lines.join(matches, spot, "left").select(*lines.columns, "match_method", "reason", "alias", "_c.*")


def _metrics() -> dict[str, Column]:
    """The book's margin, what came of a line, and the model's side of it; a push decides nothing."""
    over, under = odds.american_to_implied(F.col("over_odds"), None), odds.american_to_implied(F.col("under_odds"), None)
    edge, push = F.col("projection") - F.col("line"), F.col("actual") == F.col("line")
    pick = F.when(edge > 0, "over").when(edge < 0, "under").otherwise("push")
    right = F.when(push, None).when(pick == "over", F.col("actual") > F.col("line")).when(pick == "under", F.col("actual") < F.col("line"))
    return {
        "over_implied": over, "under_implied": under, "book_hold": over + under - 1, "actual_over_line": F.coalesce(F.col("actual") > F.col("line"), F.lit(False)),
        "actual_push": F.coalesce(push, F.lit(False)), "model_edge": edge, "model_pick": pick, "model_pick_correct": right,
        "model_error": F.col("projection") - F.col("actual"), "line_error": F.col("line") - F.col("actual"),
    }


def market_metrics(matched: DataFrame) -> DataFrame:
    """Matched lines with the book's margin, what came of the line, and the model's side of it."""
    return matched.filter("match_method IS NOT NULL").withColumns(_metrics())


def join_summary(matched: DataFrame) -> DataFrame:
    """Over all, by market and by book: lines, how many each tier matched and each reason kept out (they add up), and how model and line did on the matched."""
    methods, reasons = ("identity_strict", "strict_prefix", "initial_last_unique"), ("no_prediction", "no_such_name", "strict_market", "several_players", "several_lines")
    hit = F.col("match_method").isNotNull()
    game = F.when(hit, F.col("game_id")).alias("game_id")
    rows = matched.withColumns({c: F.when(hit, v) for c, v in _metrics().items()})
    counts = {
        "lines": F.count(F.lit(1)), "matched": F.count_if(hit), **{m: F.count_if(F.col("match_method") == m) for m in methods}, **{r: F.count_if(F.col("reason") == r) for r in reasons},
        "comparable_rows": F.count_if(hit & F.col("comparable")), "two_way_rows": F.count_if(hit & F.col("over_odds").isNotNull() & F.col("under_odds").isNotNull()), "picks": F.count("model_pick_correct"),
    }
    means = {
        "pick_accuracy": F.col("model_pick_correct").cast("double"), "over_rate": F.col("actual_over_line").cast("double"), "mean_edge": F.col("model_edge").cast("double"),
        "model_mae": F.abs("model_error").cast("double"), "line_mae": F.abs("line_error").cast("double"),
    }
    # Sums by game and player first: what the sets and the distinct counts multiply is these, and not the lines.
    cells = rows.groupBy("market", "sportsbook", game, "player_id").agg(
        *[v.alias(c) for c, v in counts.items()], *[F.sum(v).alias(f"{c}_sum") for c, v in means.items()], *[F.count(v).alias(f"{c}_n") for c, v in means.items()]
    )
    sums = [
        *[F.sum(c).alias(c) for c in ("lines", "matched")], F.try_divide(F.sum("matched"), F.sum("lines")).alias("matched_rate"), *[F.sum(c).alias(c) for c in (*methods, *reasons)],
        F.countDistinct("game_id").alias("games"), F.countDistinct("player_id").alias("players"), *[F.sum(c).alias(c) for c in ("comparable_rows", "two_way_rows", "picks")],
        *[F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(c) for c in means],
    ]
    return scope_rollup(cells, [[], ["market"], ["sportsbook"]], sums)
