"""Deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the name space of domain names (RFC 4122), as hex digits.
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = DNS) -> Column:
    """Version 5 UUID of a name, as text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(digest, a, n)
    #: The two top bits of the ninth byte are 10.
    variant = F.lower(F.hex(F.conv(part(17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(19, 2)), part(21, 12))


def game_uid(season: Column, week: Column, away: Column, home: Column, prefix: str = "games", relaxed: bool = False) -> Column:
    """Id of a game from its season, week and sides; ``relaxed`` reads the Los Angeles spellings as one."""
    side = (lambda c: F.when(c.isin("LA", "LAR", "LAC"), "LA").otherwise(c)) if relaxed else (lambda c: c)
    return uuid5(F.concat(F.lit(f"{prefix}:"), F.concat_ws("|", season.cast("string"), week.cast("string"), side(away), side(home))))
