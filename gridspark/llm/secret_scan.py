"""Secret spans by pattern, and weaker spans that count only where complementary parts lie close together.

Everything is a DataFrame expression. A text is split at a pattern's matches; the lengths of the pieces and of the
matches, summed in a window, give each match its place. Identifiers, secrets and endpoints meet in an interval
join on slices of the text, so no task ever holds the pairs of a whole text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import Scratch, as_struct, from_struct

_VALUE = r"[A-Za-z0-9+/_.=-]"
#: A word boundary of ASCII words, which ``\b`` is only in some Java versions.
_START, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_IS = r"""["']?\x20*[:=]\x20*["']?"""

#: Fixed values of the contract: the base kinds, in the order in which they are listed.
ASSIGN = rf"(?i)(password|passwd|secret|token|api_?key){_IS}({_VALUE}+)"
ASSIGN_LEAST = 8
#: Runs are maximal, so the least lengths (16 and 32 characters) can stand in the patterns themselves.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

#: Weak candidates, of which none is reported alone.
IDENT = rf"(?i){_START}(?:user(?:_?name|_?id)?|login|account|client_?id|(?:access_?)?key_?id){_IS}[A-Za-z0-9._@-]{{3,}}"
WEAK = (
    rf"(?i:{_START}(?:pwd|pass|pass(?:phrase|code)|auth|credentials?|private_?key|access_?key|signature){_IS}{_VALUE}{{6,}})"
    r"|[A-Za-z0-9+/_-]{24,}"
)
#: A host has 63 characters before its first dot at most and 189 behind; so no place of a text is looked at more than some hundred times.
ENDPOINT = (
    rf"(?i){_START}[a-z][a-z0-9+.-]{{1,15}}://[a-z0-9._~:@-]+|{_START}[a-z0-9][a-z0-9-]{{0,62}}\.[a-z0-9.-]{{1,189}}:[0-9]{{2,5}}{_END}"
)

KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "ident": IDENT, "weak": WEAK, "endpoint": ENDPOINT}
BASE = ("assign", "access", "hex")
#: What a part is to the others; a weak candidate needs all the roles named with it in its scope.
ROLES = {"access": "identifier", "ident": "identifier", "assign": "secret", "hex": "secret", "weak": "secret", "endpoint": "endpoint"}
NEEDS = {"ident": ("secret",), "weak": ("identifier",), "endpoint": ("identifier", "secret")}

#: Code points in a slice of the interval join.
SLICE = 512


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _hits(kind: str) -> Column:
    """For a text with a match: the kind, the lengths of the pieces between its matches, and the matches."""
    pattern = F.lit(KINDS[kind])
    cut = F.struct(
        F.lit(kind).alias("kind"),
        F.transform(F.split(_text(), pattern, -1), F.length).alias("gaps"),
        F.regexp_extract_all(_text(), pattern, F.lit(0)).alias("matches"),
    )
    return F.when(F.rlike(_text(), pattern), cut)


def _place(texts: DataFrame) -> DataFrame:
    """(key, hits) to (key, kind, start, end, match), matches that fail their kind's test left out."""
    flat = (
        texts.select("key", F.explode("hits").alias("hit"))
        .select("key", "hit.kind", F.posexplode(F.arrays_zip("hit.matches", "hit.gaps")).alias("i", "x"))
        .select("key", "kind", "i", F.col("x.matches").alias("match"), F.col("x.gaps").alias("gap"))
        .filter(F.col("match").isNotNull())
    )
    upto = Window.partitionBy("key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("match")
    placed = flat.withColumn("end", F.sum(F.col("gap") + size).over(upto)).withColumn("start", F.col("end") - size)
    strong = F.length(F.regexp_extract("match", ASSIGN, 2)) >= ASSIGN_LEAST
    #: A bare run of 24 characters is a candidate only with all three of a small and a large letter and a digit.
    opaque = (
        F.rlike("match", F.lit("[a-z]")) & F.rlike("match", F.lit("[A-Z]")) & F.rlike("match", F.lit("[0-9]"))
    ) | F.rlike("match", F.lit("[:=]"))
    good = F.when(F.col("kind") == "assign", strong).when(F.col("kind") == "weak", opaque).otherwise(F.lit(True))
    return placed.filter(good).select("key", "kind", "start", "end")


def _slices(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / SLICE), F.floor(F.greatest(start, end - 1) / SLICE)))


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """The weak candidates in whose scope the complementary roles occur and that no base span overlaps."""
    weak = parts.filter(~F.col("kind").isin(*BASE))
    near = weak.select(
        "key", "kind", "start", "end",
        _slices(F.greatest(F.lit(0), F.col("start") - scope), F.col("end") + scope).alias("slice"),
    )
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    others = parts.select(
        F.col("key").alias("o_key"),
        role[F.col("kind")].alias("o_role"),
        F.col("kind").isin(*BASE).alias("o_base"),
        F.col("start").alias("o_start"),
        F.col("end").alias("o_end"),
        _slices(F.col("start"), F.col("end")).alias("o_slice"),
    )
    met = near.join(
        others,
        (F.col("key") == F.col("o_key"))
        & (F.col("slice") == F.col("o_slice"))
        & (F.col("o_start") <= F.col("end") + scope)
        & (F.col("o_end") >= F.col("start") - scope),
    )
    overlap = F.col("o_base") & (F.col("o_start") < F.col("end")) & (F.col("start") < F.col("o_end"))
    seen = met.groupBy("key", "kind", "start", "end").agg(
        F.bool_or(overlap).alias("covered"),
        *[F.bool_or(F.col("o_role") == r).alias(r) for r in ("identifier", "secret")],
    )
    enough = reduce(
        Column.__or__,
        [(F.col("kind") == k) & reduce(Column.__and__, [F.col(r) for r in roles]) for k, roles in NEEDS.items()],
    )
    return seen.filter(~F.col("covered") & enough).select("key", "kind", "start", "end")


def _marked(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` of every row, with the key of its text (equal texts share one) and the hits of each pattern that matches."""
    hits = F.filter(F.array(*[_hits(k) for k in KINDS]), lambda h: h.isNotNull())
    return docs.select(*columns, F.md5(F.encode(_text(), "UTF-8")).alias("key"), hits.alias("hits"))


def _spans(found: DataFrame, scratch: Scratch, scope: int) -> DataFrame:
    """(key, kind, start, end) of every reported span, from rows with key and hits."""
    texts = found.select("key", "hits").filter(F.size("hits") > 0).dropDuplicates(["key"])
    parts = scratch.write(_place(texts), "parts")
    return parts.filter(F.col("kind").isin(*BASE)).union(_linked(parts, scope))


def scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_spans, spans (kind:start:end, by start).

    Places are code points, ends exclusive. Weak candidates count within ``scope`` code points of their
    complement. A null text counts as empty and has no spans; null doc_ids and repeated rows keep their rows; other
    columns are not read; an empty table returns none.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = scratch.write(_marked(docs, F.col("doc_id")), "hits")
    spans = _spans(rows, scratch, scope)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    label = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    listed = spans.withColumn("s", F.struct("start", order.alias("o"), label.alias("label")))
    base = F.col("kind").isin(*BASE)
    join = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: s["label"]), ",")
    by_text = listed.groupBy("key").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE],
        join(F.collect_list(F.when(base, F.col("s")))).alias("base_spans"),
        join(F.collect_list("s")).alias("spans"),
    )
    return rows.drop("hits").join(by_text, "key", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_spans", "spans")],
    )


def redact(docs: DataFrame, scope: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; n_chars, if there, counts the new text.

    The patterns go over the texts once; only texts with a match of some pattern are shuffled, the others pass by.
    """
    scratch = Scratch(docs.sparkSession, "redact")
    rows = as_struct(docs)
    found = scratch.write(_marked(rows.withColumn("text", F.col("d.text")), F.col("d")), "hits")
    suspects, clean = found.filter(F.size("hits") > 0), from_struct(found.filter(F.size("hits") == 0), docs.columns)
    spans = _spans(found, scratch, scope)
    so_far = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    #: A span that starts after every earlier end opens a new run of overlapping spans.
    opened = spans.withColumn("new", F.when(F.col("start") > F.max("end").over(so_far), 1).otherwise(0))
    run = F.sum("new").over(Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    runs = opened.withColumn("run", run).groupBy("key", "run").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    cuts = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("cuts"))
    n, text = F.size("cuts"), F.col("d.text")
    after = lambda i: F.when(i == 0, 0).otherwise(F.col("cuts")[F.greatest(i - 1, F.lit(0))]["e"])
    before = lambda i: F.when(i == n, F.length(text)).otherwise(F.col("cuts")[F.least(i, n - 1)]["s"])
    piece = lambda i: F.substring(text, (after(i) + 1).cast("int"), (before(i) - after(i)).cast("int"))
    rebuilt = F.array_join(F.transform(F.sequence(F.lit(0), n), piece), mark)
    named = cuts.withColumnRenamed("key", "of_key")
    cleaned = suspects.select("d", "key").join(named, F.col("key") == F.col("of_key"), "left")
    cleaned = cleaned.select("d", F.col("cuts").isNotNull().alias("cut"), F.when(F.col("cuts").isNotNull(), rebuilt).otherwise(text).alias("new"))
    changed = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        count = F.when(F.col("cut"), F.length("new")).otherwise(F.col("d.n_chars"))
        changed["n_chars"] = count.cast(docs.schema["n_chars"].dataType)
    return from_struct(cleaned, docs.columns, **changed).union(clean)
