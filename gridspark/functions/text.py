"""Text, key and coercion expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: generational suffixes that are no part of a name's key.
SUFFIXES = r"\b(jr|sr|ii|iii|iv|v)\b\.?"


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def name_parts(name: Column) -> Column:
    """Lower-case words of a name: "Last, First" turned round, suffixes and punctuation dropped."""
    turned = F.when(F.instr(name, ",") > 0, F.regexp_replace(name, r"^\s*([^,]*),\s*(.*)$", "$2 $1")).otherwise(name)
    bare = F.regexp_replace(F.regexp_replace(F.lower(turned), SUFFIXES, " "), r"[^a-z0-9]+", " ")
    return F.filter(F.split(F.trim(bare), " "), lambda w: w != "")


def initial_last_key(name: Column) -> Column:
    p = name_parts(name)
    return F.when(F.size(p) > 1, F.concat_ws(":", F.substring(p[0], 1, 1), F.element_at(p, -1)))


def prefix_key(name: Column, letters: int = 2) -> Column:
    p = name_parts(name)
    return F.when(F.size(p) > 1, F.concat_ws(":", F.substring(p[0], 1, letters), F.element_at(p, -1)))


def full_key(name: Column) -> Column:
    p = name_parts(name)
    return F.when(F.size(p) > 1, F.concat_ws(":", p[0], F.element_at(p, -1)))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def clean_number(x: Column) -> Column:
    """Number in a table cell: "mm:ss" as seconds, percent and rank marks and commas dropped, dashes as null."""
    t = F.trim(F.regexp_replace(x, "−", "-"))
    clock = F.split(t, ":")
    seconds = F.expr("1") * clock[0].try_cast("double") * 60 + F.try_element_at(clock, F.lit(2)).try_cast("double")
    bare = F.regexp_replace(t, r"^(T-|#)|%$|,", "")
    return F.when(t.rlike(r"^\d+:\d+$"), seconds).when(t.rlike(r"^-*$"), None).otherwise(bare.try_cast("double"))


def to_number(x: Column) -> Column:
    """Number or null, NaN as null."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d), d)


def to_flag(x: Column, default: bool = False) -> Column:
    """Boolean of the usual spellings; anything else is ``default``."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin("true", "1", "yes", "y", "t"), True).when(t.isin("false", "0", "no", "n", "f"), False).otherwise(F.lit(default))


def text_id(x: Column) -> Column:
    """Id as text without a decimal part: 12.0 as "12"."""
    d = x.try_cast("double")
    return F.when(d.isNotNull() & (d == F.floor(d)), d.cast("bigint").cast("string")).otherwise(F.trim(x.cast("string")))


def ladder(x: Column, rungs: list[tuple[str, float]], default: float | None = None) -> Column:
    """Score of the first substring, in order, that the lower-cased text contains."""
    t, out = F.lower(x), None
    for part, score in rungs:
        out = F.when(F.contains(t, F.lit(part)), score) if out is None else out.when(F.contains(t, F.lit(part)), score)
    return out.otherwise(F.lit(default))


def fingerprint(values: list[Column], digits: int = 6, length: int = 16) -> Column:
    """Leading hex digits of the SHA-1 of values rounded to ``digits`` places."""
    parts = [F.coalesce(F.format_string(f"%.{digits}f", v.cast("double")), F.lit("")) for v in values]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, length)


def set_hash(values: Column) -> Column:
    """Hash of an array that does not depend on its order."""
    return F.sha1(F.array_join(F.array_sort(values), "|"))
