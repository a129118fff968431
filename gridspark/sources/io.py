"""Scans and sinks on Spark's own readers and writers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType, keep_extra: bool = False) -> DataFrame:
    """Columns of a schema in its order: those there are cast (null where a value does not fit), the others are null."""
    known = [F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    names = set(schema.names)
    return df.select(*known, *[c for c in df.columns if keep_extra and c not in names])


def nan_to_null(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, ORC, JSON or CSV by the path's suffix (parquet without one); a column list reaches the scan."""
    kind = next((k for k in ("parquet", "orc", "json", "csv") if path.rstrip("/").endswith(f".{k}")), "parquet")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    df = reader.format(kind).load(path)
    return df.select(*columns) if columns else df


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union by name of several tables; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_table(spark, p) for p in paths])


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Structs as columns, all the way down; arrays and maps stay."""

    def walk(kind: T.StructType, path: list[str]) -> list:
        out = []
        for f in kind.fields:
            at = [*path, f.name]
            out += walk(f.dataType, at) if isinstance(f.dataType, T.StructType) else [F.col(".".join(f"`{p}`" for p in at)).alias(separator.join(at))]
        return out

    return df.select(*walk(df.schema, []))


#: Nested bookmaker feed: events, bookmakers, markets, outcomes.
ODDS = "id string, home_team string, away_team string, bookmakers array<struct<key: string, markets: array<struct<key: string, outcomes: array<struct<name: string, price: double, point: double>>>>>>"


def flatten_odds(df: DataFrame, payload: str) -> DataFrame:
    """JSON events to one row per (event, bookmaker, market, outcome); what does not parse gives no row."""
    event = df.select(F.from_json(payload, ODDS).alias("e"))
    books = event.select("e.id", "e.home_team", "e.away_team", F.explode("e.bookmakers").alias("b"))
    markets = books.select("id", "home_team", "away_team", F.col("b.key").alias("book"), F.explode("b.markets").alias("m"))
    return markets.select("id", "home_team", "away_team", "book", F.col("m.key").alias("market"), F.explode("m.outcomes").alias("o")).select(
        "id", "home_team", "away_team", "book", "market", F.col("o.name").alias("outcome"), "o.price", "o.point"
    )


def jsonable(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that any sink can hold the table."""
    return df.select(*[F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(c) for c in df.columns])


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that ``df`` holds; rows of one partition are written together."""
    df.repartition(*by).write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row; NaN as null, and nulls written, so that every object has all fields."""
    nan_to_null(df).write.option("ignoreNullFields", False).mode("overwrite").json(path)


#: Names under which tables hold a team, the first that is there counts.
TEAM_COLUMNS = ("team", "team_abbr", "team_abbreviation", "abbr", "club", "club_code", "team_code")


def first_column(df: DataFrame, names: tuple[str, ...] = TEAM_COLUMNS) -> str | None:
    return next((n for n in names if n in df.columns), None)


def with_team(df: DataFrame, out: str = "team") -> DataFrame:
    """The column that holds a team as ``out``, trimmed and in upper case; an error says which names were looked for."""
    name = first_column(df)
    if name is None:
        raise ValueError(f"no column of a team among {df.columns}; looked for {list(TEAM_COLUMNS)}")
    return df.withColumn(out, F.upper(F.trim(F.col(name).cast("string"))))
