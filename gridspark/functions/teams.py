"""Names of teams and positions, and other small texts of the domain, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other abbreviations of a team and the one that counts. "LA" alone says nothing without a name.
ABBREVIATIONS = {
    "JAC": "JAX", "WSH": "WAS", "ARZ": "ARI", "KAN": "KC", "NOR": "NO", "TAM": "TB", "GNB": "GB", "SFO": "SF", "NWE": "NE", "RAM": "LAR",
    "SD": "LAC", "STL": "LAR", "OAK": "LV",
}
#: Full names of teams, and their abbreviations.
NAMES = {
    "Arizona Cardinals": "ARI", "Atlanta Falcons": "ATL", "Baltimore Ravens": "BAL", "Buffalo Bills": "BUF", "Carolina Panthers": "CAR", "Chicago Bears": "CHI",
    "Cincinnati Bengals": "CIN", "Cleveland Browns": "CLE", "Dallas Cowboys": "DAL", "Denver Broncos": "DEN", "Detroit Lions": "DET", "Green Bay Packers": "GB",
    "Houston Texans": "HOU", "Indianapolis Colts": "IND", "Jacksonville Jaguars": "JAX", "Kansas City Chiefs": "KC", "Las Vegas Raiders": "LV", "Los Angeles Chargers": "LAC",
    "Los Angeles Rams": "LAR", "Miami Dolphins": "MIA", "Minnesota Vikings": "MIN", "New England Patriots": "NE", "New Orleans Saints": "NO", "New York Giants": "NYG",
    "New York Jets": "NYJ", "Philadelphia Eagles": "PHI", "Pittsburgh Steelers": "PIT", "San Francisco 49ers": "SF", "Seattle Seahawks": "SEA", "Tampa Bay Buccaneers": "TB",
    "Tennessee Titans": "TEN", "Washington Commanders": "WAS",
    "Oakland Raiders": "LV", "San Diego Chargers": "LAC", "St. Louis Rams": "LAR", "Washington Football Team": "WAS", "Washington Redskins": "WAS", "Phoenix Cardinals": "ARI",
    "Los Angeles Raiders": "LV",
}
#: Other codes that stand before a team's last name, beside its abbreviation.
CODES = {"GNB": "GB", "JAC": "JAX", "KAN": "KC", "SFO": "SF", "WSH": "WAS", "LA": ("LAC", "LAR"), "NY": ("NYG", "NYJ")}
_LAST = {abbr: name.split(" ")[-1] for name, abbr in list(NAMES.items())[:32]}
#: A code and the last name, as in "KC Chiefs".
SHORT = {f"{code} {_LAST[t]}": t for code, of in [*((t, t) for t in _LAST), *CODES.items()] for t in (of if isinstance(of, tuple) else (of,))}
#: Positions and their groups.
POSITIONS = {
    "RB": ("RB", "FB", "RUNNING BACK", "FULLBACK"), "WR": ("WR", "WIDE RECEIVER"), "TE": ("TE", "TIGHT END"),
    "DL": ("DE", "DT", "NT", "DL", "EDGE", "DEFENSIVE END", "DEFENSIVE TACKLE"), "LB": ("LB", "ILB", "OLB", "MLB", "LINEBACKER"),
    "DB": ("CB", "DB", "S", "FS", "SS", "SAF", "SAFETY", "CORNERBACK"),
}


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def abbreviation(x: Column, name: Column | None = None) -> Column:
    """Trimmed, upper case, other spellings replaced; "LA" by the team's name, where that tells."""
    v = F.upper(F.trim(x))
    known = F.coalesce(_lookup(ABBREVIATIONS, v), v)
    if name is None:
        return known
    lower = F.lower(name)
    return F.when((v == "LA") & F.contains(lower, F.lit("rams")), "LAR").when((v == "LA") & F.contains(lower, F.lit("chargers")), "LAC").otherwise(known)


def from_name(x: Column) -> Column:
    """Abbreviation of a team's full name, or of its code and last name; null for all others, whatever word they end in."""
    return _lookup(NAMES | SHORT, x)


def position_group(x: Column) -> Column:
    """The group of a position; one that is not known stands for itself, an empty one is null."""
    v = F.nullif(F.upper(F.trim(x)), F.lit(""))
    out = v
    for group, names in POSITIONS.items():
        out = F.when(v.isin(*names), group).otherwise(out)
    return out


def json_like(x: Column, field: str = "abbreviation") -> Column:
    """A field of a text that is JSON, or JSON but for its quotes; a plain text stands for itself."""
    fixed = F.replace(x, F.lit("'"), F.lit('"'))
    return F.when(F.startswith(F.ltrim(x), F.lit("{")), F.get_json_object(fixed, f"$.{field}")).otherwise(x)


def game_teams(game_id: Column) -> Column:
    """The two last parts of season_week_away_home, normalised, once if equal; an empty array for shorter ids."""
    parts = F.split(F.upper(F.trim(game_id)), "_")
    return F.when(F.size(parts) >= 4, F.array_distinct(F.transform(F.slice(parts, -2, 2), abbreviation))).otherwise(F.array().cast("array<string>"))


def milestone(x: Column) -> Column:
    """The number before a plus sign, as in "2+ touchdowns"."""
    return F.nullif(F.regexp_extract(x, r"(\d+)\s*\+", 1), F.lit("")).cast("double")


def mountain_time(x: Column) -> Column:
    """A UTC time as Mountain Time; nothing for null."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(x, "America/Denver"), "yyyy-MM-dd HH:mm"), F.lit(""))


def listed(x: Column) -> Column:
    """A JSON list of texts, or texts set apart by commas, as an array without empty ones."""
    raw = F.when(F.startswith(F.trim(x), F.lit("[")), F.from_json(F.trim(x), "array<string>")).otherwise(F.split(x, ","))
    return F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")


def round_half_even(x: Column, digits: int) -> Column:
    return F.bround(F.when(~F.isnan(x), x), digits)


def play_uid(game: Column, play: Column, desc: Column) -> Column:
    """Identity of a play: its game and number, or a hash of its text where it has no number."""
    return F.concat_ws("_", game, F.coalesce(play.cast("string"), F.substring(F.sha1(desc), 1, 12)))
