"""Feeds of nested JSON, and tables in HTML, as rows. A feed is a table of payload texts; nothing is fetched here.

Each flattener is from_json and explode, so that a payload is read by the task that holds it and rows go on without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.text import slug

ROSTER = "struct<team:string,athletes:array<struct<position:string,items:array<struct<id:string,name:string,status:string>>>>>"
DEPTH = "struct<team:string,positions:array<struct<position:string,athletes:array<struct<id:string>>>>>"
INJURIES = "struct<injuries:array<struct<status:string,type:string,date:string,detail:string,athlete:struct<id:string,displayName:string,shortName:string>,team:struct<abbreviation:string>>>>"
ARTICLES = "struct<articles:array<struct<headline:string,published:string,categories:array<struct<type:string,team:string>>>>>"
HOURS = "struct<days:array<struct<hours:array<struct<at:bigint,temp:double,wind:double,precip:double,conditions:string,source:string>>>>>"
PERIODS = "struct<response:array<struct<periods:array<struct<at:bigint,temp:double,wind:double>>>>>"
TIMELINES = "struct<timelines:array<struct<step:string,intervals:array<struct<at:bigint,values:map<string,double>>>>>>"
STATS = "struct<role:string,statistics:map<string,struct<totals:map<string,double>,players:array<struct<id:string,values:map<string,double>>>>>>"
MOVES = "struct<players:array<struct<id:string,transactions:array<struct<at:string,kind:string,from:string,to:string>>>>>"
EVENTS = "struct<timestamp:string,data:array<struct<id:string,home:string,away:string,commence:bigint>>>"


def parsed(feed: DataFrame, schema: str, payload: str = "payload") -> DataFrame:
    """The feed's other columns and its payload as a struct ``x``; a payload that is no JSON gives a null struct."""
    return feed.withColumn("x", F.from_json(payload, schema)).drop(payload)


def roster(feed: DataFrame) -> DataFrame:
    """Groups of athletes to one row per athlete."""
    keep = [c for c in feed.columns if c != "payload"]
    groups = parsed(feed, ROSTER).select(*keep, "x.team", F.explode("x.athletes").alias("g"))
    return groups.select(*keep, "team", F.col("g.position").alias("position_group"), F.inline("g.items"))


def depth_chart(feed: DataFrame) -> DataFrame:
    """Positions and their athletes to one row per athlete, with the rank from the order (1 first)."""
    keep = [c for c in feed.columns if c != "payload"]
    spots = parsed(feed, DEPTH).select(*keep, "x.team", F.explode("x.positions").alias("p"))
    ranked = spots.select(*keep, "team", "p.position", F.posexplode("p.athletes").alias("i", "a"))
    return ranked.select(*keep, "team", "position", (F.col("i") + 1).alias("rank"), F.col("a.id").alias("id"))


def injuries(feed: DataFrame) -> DataFrame:
    """One row per reported athlete: id, names, team, status (else the type), type, detail and date."""
    keep = [c for c in feed.columns if c != "payload"]
    each = parsed(feed, INJURIES).select(*keep, F.explode("x.injuries").alias("i"))
    return each.select(
        *keep, F.col("i.team.abbreviation").alias("team"), F.col("i.athlete.id").alias("id"), F.col("i.athlete.displayName").alias("display_name"), F.col("i.athlete.shortName").alias("short_name"),
        F.coalesce("i.status", "i.type").alias("injury_status"), F.col("i.type").alias("injury_type"), F.col("i.detail").alias("injury_detail"), F.col("i.date").alias("injury_date"),
    )


def in_season(news: DataFrame, season: int, published: str = "published") -> DataFrame:
    """News between June of the year before and March of the year after a season, marked with it; what has no readable time is out."""
    at = F.try_to_timestamp(F.col(published).cast("string"))
    start, end = (F.lit(f"{y}-{md}").cast("timestamp") for y, md in ((season - 1, "06-01"), (season + 1, "03-01")))
    return news.filter((at >= start) & (at <= end)).withColumn("season", F.lit(season))


def articles(feed: DataFrame) -> DataFrame:
    """One row per article and team it is filed under."""
    keep = [c for c in feed.columns if c != "payload"]
    each = parsed(feed, ARTICLES).select(*keep, F.explode("x.articles").alias("a"))
    filed = each.select(*keep, "a.headline", "a.published", F.explode("a.categories").alias("c"))
    return filed.filter("c.type = 'team'").select(*keep, "headline", "published", F.col("c.team").alias("team"))


def hours(feed: DataFrame) -> DataFrame:
    """days[].hours[] to rows."""
    keep = [c for c in feed.columns if c != "payload"]
    return parsed(feed, HOURS).select(*keep, F.inline(F.flatten(F.transform("x.days", lambda d: d["hours"]))))


def periods(feed: DataFrame) -> DataFrame:
    """response[].periods[] to rows."""
    keep = [c for c in feed.columns if c != "payload"]
    return parsed(feed, PERIODS).select(*keep, F.inline(F.flatten(F.transform("x.response", lambda r: r["periods"]))))


def timelines(feed: DataFrame, step: str, fields: list[str]) -> DataFrame:
    """timelines[].intervals[] of one ``step`` to rows, with ``fields`` of their values."""
    keep = [c for c in feed.columns if c != "payload"]
    lines = parsed(feed, TIMELINES).select(*keep, F.explode("x.timelines").alias("t")).filter(F.col("t.step") == step)
    each = lines.select(*keep, F.explode("t.intervals").alias("i"))
    return each.select(*keep, F.col("i.at").alias("at"), *[F.try_element_at("i.values", F.lit(f)).alias(f) for f in fields])


def team_stats(feed: DataFrame) -> DataFrame:
    """Categories of a team's statistics to one row per (category, name)."""
    keep = [c for c in feed.columns if c != "payload"]
    each = parsed(feed, STATS).select(*keep, "x.role", F.explode("x.statistics").alias("category", "s"))
    return each.select(*keep, "role", "category", F.explode("s.totals").alias("name", "value"))


def player_stats(feed: DataFrame) -> DataFrame:
    """Categories of players' statistics to one row per (category, player, name)."""
    keep = [c for c in feed.columns if c != "payload"]
    each = parsed(feed, STATS).select(*keep, "x.role", F.explode("x.statistics").alias("category", "s"))
    people = each.select(*keep, "role", "category", F.explode("s.players").alias("p"))
    return people.select(*keep, "role", "category", F.col("p.id").alias("id"), F.explode("p.values").alias("name", "value"))


def season_stats(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Sums and counts of flattened statistics by ``keys``, category and name."""
    return stats.groupBy(*keys, "category", "name").agg(F.sum("value").alias("total"), F.count("value").alias("games"))


def transactions(feed: DataFrame) -> DataFrame:
    """Players' transactions to rows."""
    keep = [c for c in feed.columns if c != "payload"]
    each = parsed(feed, MOVES).select(*keep, F.explode("x.players").alias("p"))
    return each.select(*keep, F.col("p.id").alias("id"), F.inline("p.transactions"))


def historical_events(feed: DataFrame) -> DataFrame:
    """Event lists of snapshots to rows, with the snapshot's time."""
    keep = [c for c in feed.columns if c != "payload"]
    return parsed(feed, EVENTS).select(*keep, F.col("x.timestamp").alias("snapshot"), F.inline("x.data"))


_ROW, _CELL = r"(?is)<tr\b[^<>]*>(.*?)</tr\s*>", r"(?is)<t%s\b([^<>]*)>(.*?)</t%s\s*>"


def _cells(row: Column, kind: str = "d") -> Column:
    """Texts of a row's cells (``kind``: d, h or [dh]) without tags; a cell that spans n columns stands n times."""
    pattern = F.lit(_CELL % (kind, kind))
    spans, texts = F.regexp_extract_all(row, pattern, F.lit(1)), F.regexp_extract_all(row, pattern, F.lit(2))
    wide = F.transform(spans, lambda a: F.coalesce(F.nullif(F.regexp_extract(a, r"(?i)\bcolspan\s*=\s*[\"']?(\d{1,3})", 1), F.lit("")).cast("int"), F.lit(1)))
    return F.flatten(F.zip_with(texts, wide, lambda t, n: F.array_repeat(F.trim(F.regexp_replace(t, "<[^<>]*>", "")), n)))


def html_rows(pages: DataFrame, html: str, columns: list[str]) -> DataFrame:
    """Body rows of HTML tables: one row per tr with td cells that fill all ``columns``; header rows have none.

    A cell over several columns fills each of them. Rows with fewer cells are filled with nulls, surplus cells are left out. Tags within a cell are dropped and white space is
    trimmed; patterns only, no row leaves the JVM.
    """
    keep = [c for c in pages.columns if c != html]
    each = pages.select(*keep, F.explode(F.regexp_extract_all(html, F.lit(_ROW), F.lit(1))).alias("r")).withColumn("c", _cells(F.col("r")))
    return each.filter(F.size("c") > 0).select(*keep, *[F.try_element_at("c", F.lit(i + 1)).alias(n) for i, n in enumerate(columns)])


def stitched_tables(pages: DataFrame, html: str, id_columns: list[str]) -> DataFrame:
    """Pages whose rows stand in two tables, names in the first and values in the second, as long rows: (page columns, row, ``id_columns``, name, value).

    Rows meet by their position among the body rows of their table; header rows, wherever they are repeated, count in neither. Names of values come from the second table's
    last header row, as snake case, a repeated one with a number behind it. A row that one table lacks keeps what the other has.
    """
    keep = [c for c in pages.columns if c != html]
    tables = F.regexp_extract_all(html, F.lit(r"(?is)<table\b[^<>]*>(.*?)</table\s*>"), F.lit(1))
    two = pages.select(*keep, tables.alias("t")).filter(F.size("t") >= 2)
    body = lambda t: F.filter(F.transform(F.regexp_extract_all(t, F.lit(_ROW), F.lit(1)), lambda r: _cells(r)), lambda c: F.size(c) > 0)
    heads = F.filter(F.transform(F.regexp_extract_all(F.col("t")[1], F.lit(_ROW), F.lit(1)), lambda r: _cells(r, "h")), lambda c: F.size(c) > 0)
    named = two.select(*keep, body(F.col("t")[0]).alias("a"), body(F.col("t")[1]).alias("b"), F.try_element_at(heads, F.lit(-1)).alias("h"))
    plain = F.transform(F.coalesce("h", F.array().cast("array<string>")), slug)
    seen = F.transform(plain, lambda n, i: F.size(F.filter(F.slice(F.col("n"), F.lit(1), i), lambda m: m == n)))
    named = named.withColumn("n", plain).withColumn("n", F.zip_with("n", seen, lambda n, k: F.when(k > 0, F.concat_ws("_", n, k.cast("string"))).otherwise(n)))
    rows = named.select(*keep, "n", F.posexplode(F.zip_with("a", "b", lambda x, y: F.struct(x.alias("x"), y.alias("y")))).alias("row", "r"))
    ids = [F.try_element_at("r.x", F.lit(i + 1)).alias(c) for i, c in enumerate(id_columns)]
    values = F.filter(F.arrays_zip(F.col("n").alias("name"), F.col("r.y").alias("value")), lambda v: v["name"].isNotNull())
    return rows.select(*keep, "row", *ids, F.explode_outer(values).alias("v")).select(*keep, "row", *id_columns, "v.name", "v.value")


def paged(rows: DataFrame, feed: list[str], page: str, key: list[str]) -> DataFrame:
    """Rows of a feed's pages up to the first page that brings nothing new, each ``key`` from the first page that has it.

    A server that is asked beyond its last page sends an earlier one again; so the first page without a new key ends the feed.
    """
    w = Window.partitionBy(*feed, *key).orderBy(page)
    fresh = rows.withColumn("_new", F.rank().over(w) == 1)
    pages = fresh.groupBy(*feed, F.col(page).alias("_page")).agg(F.bool_or("_new").alias("_any"))
    order = Window.partitionBy(*feed).orderBy("_page").rowsBetween(Window.unboundedPreceding, 0)
    #: A page counts if it and all before it are there, from the first on, and bring something new.
    good = pages.withColumn("_ok", F.min(F.col("_any").cast("int")).over(order)).withColumn("_ok", (F.col("_ok") == 1) & (F.row_number().over(Window.partitionBy(*feed).orderBy("_page")) == F.col("_page")))
    kept = good.withColumn("_ok", F.min(F.col("_ok").cast("int")).over(order)).filter("_ok = 1").drop("_any", "_ok")
    same = F.col(page) == F.col("_page")
    for c in feed:
        same = same & (F.col(c) == F.col(f"_f_{c}"))
    named = kept.select(*[F.col(c).alias(f"_f_{c}") for c in feed], "_page")
    return fresh.filter("_new").join(named, same).select(*rows.columns)


def team_totals(values: DataFrame, keys: list[str], category: str, name: str = "name", value: str = "value", prefix: str = "espn") -> DataFrame:
    """(keys, stat, total) of long tables of texts: sums of what reads as a number, by team and season, null where nothing does.

    ``stat`` is prefix, category and name; a stat that two tables of one category bring is taken from the first that has a number, by the table's ``source``.
    """
    stat = F.lower(F.concat_ws("_", F.lit(prefix), F.trim(F.col(category)), F.col(name))).alias("stat")
    per = values.dropna(subset=[*keys, name]).groupBy(*keys, stat, "source").agg(F.sum(number(F.col(value))).alias("total"))
    first = F.min_by("total", F.when(F.col("total").isNotNull(), F.col("source")))
    return per.groupBy(*keys, "stat").agg(first.alias("total"))


def number(x: Column) -> Column:
    """A number out of a table's text: thousands separators, percent signs and spaces gone; null where nothing is left."""
    return F.nullif(F.regexp_replace(x, r"[,%\s]", ""), F.lit("")).try_cast("double")


def records(feed: DataFrame, fields: str) -> DataFrame:
    """Rows of payloads that are a JSON list of records, or an object that holds it as "data"; ``fields`` is their schema, names not in it are left out."""
    keep = [c for c in feed.columns if c != "payload"]
    listed = F.startswith(F.ltrim("payload"), F.lit("["))
    rows = F.when(listed, F.from_json("payload", f"array<struct<{fields}>>")).otherwise(F.from_json("payload", f"struct<data:array<struct<{fields}>>>")["data"])
    return feed.select(*keep, F.inline(F.filter(F.coalesce(rows, F.array().cast(f"array<struct<{fields}>>")), lambda r: r.isNotNull())))


#: A bookmaker's price on a player: its line, and odds of one side or of both.
PROP = "id:bigint,game_id:bigint,player_id:bigint,vendor:string,prop_type:string,line_value:string,market:struct<type:string,odds:int,over_odds:int,under_odds:int>"


def player_prices(feed: DataFrame) -> DataFrame:
    """Prices on players, one row a record; a market with one side has its odds as the over's."""
    each = records(feed, PROP)
    return each.select(
        *[c for c in each.columns if c not in ("line_value", "market")], F.col("line_value").try_cast("double").alias("line"), F.col("market.type").alias("market_type"),
        F.coalesce("market.over_odds", "market.odds").alias("over_odds"), F.col("market.under_odds").alias("under_odds"),
    )


def numbered(feed: DataFrame, kind: str, fields: dict[str, str]) -> DataFrame:
    """Rows of payloads whose records lie under numbers in fantasy_content.``kind`` ({"0": …, "1": …, "count": 2}); ``fields`` maps names to JSON paths in a record."""
    keep = [c for c in feed.columns if c != "payload"]
    held = F.from_json("payload", f"struct<fantasy_content:struct<{kind}:map<string,string>>>")["fantasy_content"][kind]
    each = feed.select(*keep, F.explode(held).alias("_n", "_r")).filter(F.col("_n").rlike("^[0-9]+$"))
    return each.select(*keep, F.col("_n").cast("int").alias("position"), *[F.get_json_object("_r", path).alias(n) for n, path in fields.items()])


def from_file_name(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Whole numbers out of the name of the file that each row comes from, one for each group of ``pattern``."""
    return df.withColumns({n: F.nullif(F.regexp_extract(F.input_file_name(), pattern, i + 1), F.lit("")).cast("int") for i, n in enumerate(names)})
