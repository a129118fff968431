"""Players: who is available, what was offered on them, what they did and may do next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active_roster(roster: DataFrame, season: int, statuses: list[str], positions: list[str] | None = None) -> DataFrame:
    """Each player's row of the latest (season, week) up to ``season``, if its status, and position, is one of those asked for."""
    w = Window.partitionBy("player_id").orderBy(F.desc("season"), F.desc("week"))
    last = roster.filter(F.col("season") <= season).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    good = F.col("status").isin(*statuses)
    return last.filter(good & F.col("position").isin(*positions) if positions else good)


def attach_availability(predictions: DataFrame, availability: DataFrame) -> DataFrame:
    """Predictions (player_id, name_key, team, …) with the roster's word on each: by player_id, else by a name that one player has.

    Of an id's rows the one of highest priority counts. ``roster_flag``: unknown, team_mismatch, practice_squad, ok, inactive_roster.
    """
    values = F.struct("current_team", "active", "practice", "reserve", "injury_status")
    by_id = availability.filter("player_id is not null").groupBy("player_id").agg(F.max_by(values, "priority").alias("_i"))
    by_name = availability.filter("name_key is not null").groupBy("name_key").agg(
        F.max_by(values, "priority").alias("_n"), F.countDistinct("player_id").alias("_people")
    )
    out = predictions.join(by_id, "player_id", "left").join(by_name.filter("_people = 1").drop("_people"), "name_key", "left")
    out = out.withColumn("_a", F.when(F.col("_i.current_team").isNotNull(), F.col("_i")).otherwise(F.col("_n")))
    there, same = F.col("_a.current_team").isNotNull(), F.col("_a.current_team") == F.col("team")
    active, practice, reserve = (F.coalesce(F.col(f"_a.{c}"), F.lit(False)) for c in ("active", "practice", "reserve"))
    flag = F.when(~there, "unknown").when(~same, "team_mismatch").when(active, "ok").when(reserve, "inactive_roster").when(practice, "practice_squad")
    flag = flag.when(F.col("_a.active").isNotNull(), "inactive_roster").otherwise("unknown")
    return out.select(
        *predictions.columns, F.col("_a.current_team").alias("current_team"), F.coalesce(there & same & active, F.lit(False)).alias("active_current_roster"),
        flag.alias("roster_flag"), F.col("_a.injury_status").alias("injury_status"),
    )


def attach_by_id_then_name(left: DataFrame, right: DataFrame, id_: str, name: str, value: str, severity: str) -> DataFrame:
    """The worst ``value`` by ``severity`` of the row's id, else of its name."""
    worst = F.max_by(value, F.struct(severity, value))
    a = right.filter(F.col(id_).isNotNull()).groupBy(id_).agg(worst.alias("_by_id"))
    b = right.filter(F.col(name).isNotNull()).groupBy(name).agg(worst.alias("_by_name"))
    return left.join(a, id_, "left").join(b, name, "left").withColumn(value, F.coalesce("_by_id", "_by_name")).drop("_by_id", "_by_name")


def attach_offers(predictions: DataFrame, offers: DataFrame, row: str, tiers: list[tuple[str, list[str]]], price: Column, id_: str) -> DataFrame:
    """The best offer of each prediction: tiers of keys, strictest first; predictions and offers (``id_``) matched in one tier are out of the next.

    Within the first tier that matches, the highest ``price`` counts, then the smaller offer. Count, mean and range of the matched
    offers' lines go along. Each tier's offers are summed up by its keys before predictions meet them, so no prediction is paired with every offer of its keys. ``row`` is a key.
    """
    out, left, right = predictions, predictions, offers.withColumn("_price", price)
    tier = lambda field: F.coalesce(*[F.col(f"_t{i}") for i in range(len(tiers))])[field]
    for i, (name, keys) in enumerate(tiers):
        best = F.min_by(F.struct(id_, F.lit(name).alias("tier"), F.col("_price").alias("price"), "line"), F.struct(-F.col("_price"), id_))
        lines = [F.count(F.lit(1)).alias("n_offers"), F.avg("line").alias("line_mean"), (F.max("line") - F.min("line")).alias("line_range")]
        summed = right.groupBy(*keys).agg(best.alias("_o"), *lines).select(*keys, F.struct("_o", "n_offers", "line_mean", "line_range").alias(f"_t{i}"))
        out = out.join(summed, keys, "left")
        if i + 1 < len(tiers):
            taken = right.join(left.select(*keys).distinct(), keys, "left_semi").select(id_).distinct()
            left = left.join(summed.select(*keys), keys, "left_anti")
            right = right.join(taken, id_, "left_anti")
    told = out.select(*predictions.columns, tier("_o").alias("_o"), *[tier(c).alias(c) for c in ("n_offers", "line_mean", "line_range")])
    return told.select(*predictions.columns, "_o.*", F.coalesce("n_offers", F.lit(0)).alias("n_offers"), "line_mean", "line_range")


def merge_on_line(lines: DataFrame, probabilities: DataFrame, keys: list[str], line: str, order: str, values: list[str], digits: int = 3) -> DataFrame:
    """Lines with the last probability row (by ``order``) of their keys and rounded line."""
    on = F.bround(F.col(line), digits)
    last = probabilities.withColumn("_line", on).groupBy(*keys, "_line").agg(F.max_by(F.struct(*values), order).alias("_v"))
    return lines.withColumn("_line", on).join(last, [*keys, "_line"]).select(*lines.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def fallback_offers(offers: DataFrame, market: str, other: str, keys: list[str]) -> DataFrame:
    """Offers, and for keys without one in ``market`` those of the ``other`` market in its place, marked as derived."""
    have = offers.filter(F.col("market") == market).select(*keys).distinct()
    derived = offers.filter(F.col("market") == other).join(have, keys, "left_anti").withColumn("market", F.lit(market)).withColumn("derived", F.lit(True))
    return offers.withColumn("derived", F.lit(False)).unionByName(derived)


def offered_candidates(offers: DataFrame, teams: Column, identity: DataFrame, active: DataFrame, history: DataFrame) -> DataFrame:
    """Offers whose player is known for one of their game's teams, is active there and has a history in the market."""
    each = offers.withColumn("team", F.explode(teams))
    known = each.join(identity, ["name_key", "team"]).join(active, ["player_id", "team"], "left_semi")
    return known.join(history, ["player_id", "market"], "left_semi").select("offer_id", "player_id", "team", "market")


def add_missing(candidates: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates, and of ``more`` one row for each key they lack; ``line_offered`` tells them apart."""
    new = more.join(candidates.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)
    return candidates.withColumn("line_offered", F.lit(False)).unionByName(new.withColumn("line_offered", F.lit(True)), allowMissingColumns=True)


def game_id_lookup(schedule: DataFrame) -> DataFrame:
    """(season, week, team, opponent) to game_id, in both orientations; of several games the last id."""
    cols = lambda a, b: schedule.select("season", "week", F.col(a).alias("team"), F.col(b).alias("opponent"), "game_id")
    return cols("home", "away").unionByName(cols("away", "home")).groupBy("season", "week", "team", "opponent").agg(F.max("game_id").alias("game_id"))


def actuals(plays: DataFrame, roles: dict[str, tuple[str, list[Column]]], keys: list[str]) -> DataFrame:
    """Per player what their plays add up to: each role names the column of its player and its sums; statistics as one JSON text."""
    parts = []
    for role, (who, sums) in roles.items():
        each = plays.filter(F.col(who).isNotNull()).groupBy(*keys, F.col(who).alias("player_id")).agg(*sums)
        names = [c for c in each.columns if c not in (*keys, "player_id")]
        parts.append(each.select(*keys, "player_id", F.lit(role).alias("role"), F.to_json(F.struct(*names)).alias("stats")))
    return reduce(DataFrame.unionByName, parts)


def credits(plays: DataFrame, shares: dict[str, float], keys: list[str]) -> DataFrame:
    """Sum of what each column's player is credited with a play: full, half and other shares in one pass."""
    rows = F.array(*[F.struct(F.col(c).alias("player_id"), F.lit(float(s)).alias("share")) for c, s in shares.items()])
    return plays.select(*keys, F.inline(rows)).filter("player_id is not null").groupBy(*keys, "player_id").agg(F.sum("share").alias("credit"))


def projections(games: DataFrame, keys: list[str], period: list[str], values: list[str], per_team: str, rank_by: str) -> DataFrame:
    """Per player: sums over distinct periods as rates, the last team, and the rank of ``rank_by``'s rate within that team."""
    when = F.struct(*period)
    out = games.groupBy(*keys).agg(
        F.countDistinct(when).alias("games"), F.max_by(per_team, when).alias(per_team), F.max(period[0]).alias(f"last_{period[0]}"),
        *[F.sum(v).alias(v) for v in values],
    )
    out = out.withColumns({f"{v}_pg": F.try_divide(F.col(v), F.col("games")) for v in values})
    w = Window.partitionBy(per_team).orderBy(F.desc(f"{rank_by}_pg"), *keys)
    return out.withColumn("team_rank", F.row_number().over(w))


def penalties(plays: DataFrame, who: list[str], name: str, order: str) -> DataFrame:
    """Penalties and yards, distinct games, rates per game and the last name, by ``who``."""
    out = plays.groupBy(*who).agg(
        F.count(F.lit(1)).alias("penalties"), F.sum("yards").alias("yards"), F.countDistinct("game_id").alias("games"), F.max_by(name, order).alias(name)
    )
    return out.withColumns({f"{c}_pg": F.try_divide(F.col(c), F.col("games")) for c in ("penalties", "yards")})


def prior_summary(labels: DataFrame, keys: list[str], period: list[str], at: tuple, value: str, name: str) -> DataFrame:
    """Per key the count and mean of ``value`` strictly before ``at``, and the last name."""
    when = F.struct(*period)
    kinds = dict(labels.dtypes)
    early = labels.filter(when < F.struct(*[F.lit(x).cast(kinds[c]).alias(c) for c, x in zip(period, at, strict=True)]))
    return early.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max_by(name, when).alias(name))


def novelty_labels(candidates: DataFrame, events: DataFrame, keys: list[str], markets: list[str]) -> DataFrame:
    """Every candidate in each of the few ``markets``, and whether an event of that kind is there."""
    each = candidates.withColumn("market", F.explode(F.array(*[F.lit(m) for m in markets])))
    hits = events.select(*keys, "market").distinct().withColumn("_hit", F.lit(True))
    return each.join(hits, [*keys, "market"], "left").withColumn("label", F.coalesce("_hit", F.lit(False))).drop("_hit")


def offer_gap(known: Column, available: Column, reserve: Column, practice: Column, active: Column, position: Column, history: Column) -> Column:
    """Why an offer has no prediction: the first reason that holds."""
    return (
        F.when(~known, "non_player").when(~available, "no_availability").when(reserve, "injured_reserve").when(practice, "practice_squad")
        .when(~active, "inactive").when(~position, "position").when(~history, "no_history").otherwise("unexplained")
    )


def line_coverage(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per set of keys, and over all, how many offers came through each step, and a status.

    Rows: player_id and the flags prepared, matched, published.
    """
    out = rows.groupingSets([[F.col(k) for k in keys], []], *[F.col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("raw"), F.countDistinct("player_id").alias("players"), *[F.count_if(F.col(c)).alias(c) for c in ("prepared", "matched", "published")],
        F.grouping(keys[0]).alias("_all"),
    )
    status = F.when(F.col("published") > 0, "published").when(F.col("matched") > 0, "matched_not_published").when(F.col("prepared") > 0, "prepared_not_matched")
    shown = {k: F.when(F.col("_all") == 1, "all").otherwise(F.col(k).cast("string")) for k in keys}
    return out.withColumns(shown).withColumn("status", status.otherwise("not_prepared")).drop("_all")


def drop_empty_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    """Without the columns that are null, or 0, in every row, but for those to keep; one pass over the table says which."""
    numeric = {c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")}
    rest = [c for c in df.columns if c not in keep]
    full = [F.count_if((F.col(c) != 0) if c in numeric else F.col(c).isNotNull()).alias(c) for c in rest]
    counts = df.agg(*full).first().asDict() if rest else {}
    return df.drop(*[c for c in rest if not counts[c]])


def matrix(df: DataFrame, columns: list[str], ranges: dict[str, tuple[float, float]], keep: list[str]) -> DataFrame:
    """Exactly ``columns`` as doubles, 0 where missing or null, held in their ranges."""
    have = set(df.columns)

    def value(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
        return F.greatest(F.lit(float(ranges[c][0])), F.least(F.lit(float(ranges[c][1])), v)) if c in ranges else v

    return df.select(*keep, *[value(c).alias(c) for c in columns])
