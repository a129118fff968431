"""URL verdicts: rules first, and for all other pages trust and distrust that spread over edges between hosts.

Edges are links with a host of their own (relative ones stay on their host and make none) and, both ways, the step from a
host to the host its name hangs from, down to the last two labels. Personalised PageRank spreads trust from the hosts whose pages rules
allow, along the edges; distrust spreads from the hosts whose pages rules block, against them. At each step a host hands a part, ``keep``, of what it has to
its neighbours, by the number of edges to each; every host starts with the share of its pages that a rule allows, or blocks. The same without seeds, every
host starting with 1, is ordinary PageRank; a host's score is the one over the other: the part of all that reaches it which comes from seeds. So a host with many
neighbours has no higher score than one with few. Scores count against the mean share of all hosts; all four sums go through the same Spark joins, round by round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gridspark.llm.common import Scratch


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Evidence is broadcast to the pages up to so many hosts, about 10 MB.
BROADCAST_HOSTS = 100_000
#: Rounds that make one job, after which the scores are written; and edges for which a round has a task, four tasks at least.
AT_ONCE, EDGES_A_TASK = 3, 100_000
#: A link with a host of its own, with or without a scheme.
LINK = r"""(?i)<a\s[^<>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add host, path, rule and rule_verdict: of the rules that fit, the longest (of equally long ones, the first by name)."""
    rows = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    best_name, best_verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        best_name = F.when(fits, r.name).otherwise(best_name)
        best_verdict = F.when(fits, r.verdict).otherwise(best_verdict)
    return rows.withColumn("rule", best_name).withColumn("rule_verdict", best_verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from pages of one host to another, and one each way between a host and the one it hangs from."""
    links = pages.select(
        F.col("host").alias("src"),
        F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("to"),
    )
    to = F.when(F.startswith("to", F.lit("//")), F.concat(F.lit("x:"), F.col("to"))).otherwise(F.col("to"))
    pairs = links.select("src", host_of(to).alias("dst"))
    hosts = pairs.select(F.col("dst").alias("h")).union(pages.select(F.col("host").alias("h"))).filter("h <> ''").distinct()
    labels = F.split("h", r"\.")
    ups = hosts.filter(F.size(labels) > 2).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.size(labels) - 3), lambda i: F.slice(labels, i + 1, F.size(labels)))).alias("l")
    )
    ups = ups.select(F.array_join("l", ".").alias("src"), F.array_join(F.slice("l", 2, F.size("l")), ".").alias("dst")).distinct()
    down = ups.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    linked = pairs.filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    return linked.union(ups).union(down).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, scratch: Scratch, keep: float = 0.85, max_rounds: int = 150, tolerance: float = 2e-4) -> DataFrame:
    """Edges (kind, src, dst, n) and seeds (kind, host, seed) to (kind, host, score, mean).

    ``seeded`` is what reaches a host if every host starts with its seed, ``all`` if each starts with 1; a host keeps ``1 - keep`` of its start, and hands
    ``keep`` of what it has to those its edges lead to, weighed by n; a host without edges hands on nothing. ``score`` is seeded over all, between the smallest and the largest seed, 0 included;
    ``mean`` is the mean seed of the kind over all hosts. Rounds end when no score moves by more than ``tolerance`` in one, or with an error after
    ``max_rounds``; every third is written to the shared folder.
    """
    tasks = max(4, edges.count() // EDGES_A_TASK)  # coalesce never makes more than the shuffle has
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    shares = scratch.write(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all") * keep).alias("w")).coalesce(tasks), "shares")
    ends = [edges.select("kind", F.col(c).alias("host"), F.lit(0.0).alias("seed")) for c in ("src", "dst")]
    every = seeds.select("kind", "host", F.col("seed").cast("double")).unionByName(ends[0]).unionByName(ends[1])
    started = every.groupBy("kind", "host").agg(F.max("seed").alias("seed"))
    state = scratch.write(started.select("kind", "host", "seed", (F.col("seed") * (1 - keep)).alias("seeded"), F.lit(1 - keep).alias("all")).coalesce(tasks), "score")
    base = state.select("kind", "host", "seeded", "all")
    mean = state.groupBy("kind").agg(F.avg("seed").alias("mean"))  # one row a kind
    score = F.try_divide("seeded", "all")

    def told(found: DataFrame) -> DataFrame:
        return found.withColumn("score", score).select("kind", "host", "score").join(F.broadcast(mean), "kind")

    if shares.isEmpty() or keep == 0:
        return told(state.withColumns({"seeded": F.col("seed"), "all": F.lit(1.0)}))

    def step(old: DataFrame) -> DataFrame:
        handed = shares.join(old.select("kind", F.col("host").alias("src"), "seeded", "all"), ["kind", "src"])
        parts = handed.select("kind", F.col("dst").alias("host"), (F.col("seeded") * F.col("w")).alias("seeded"), (F.col("all") * F.col("w")).alias("all")).union(base)
        return parts.groupBy("kind", "host").agg(F.sum("seeded").alias("seeded"), F.sum("all").alias("all")).coalesce(tasks)

    first = state
    for _ in range(max_rounds // AT_ONCE):
        new = state.select("kind", "host", "seeded", "all")
        for _ in range(AT_ONCE - 1):
            new = step(new)
        last = step(new).join(new.select("kind", "host", score.alias("old")), ["kind", "host"])
        seen = Observation()
        before, state = state, scratch.write(last.observe(seen, F.max(F.abs(score - F.col("old"))).alias("moved")), "score")
        if before is not first:
            scratch.drop(before)
        moved = seen.get["moved"]
        if moved is None or moved <= tolerance:
            return told(state)
    raise RuntimeError(f"scores still move by {moved} after {max_rounds} rounds")


def evidence(ruled: DataFrame, scratch: Scratch, keep: float = 0.85, tolerance: float = 2e-4) -> DataFrame:
    """(host, trust, distrust) from pages with host, html and rule_verdict: scores over the mean of all hosts, 0 without any seed.

    Seeds are the shares of a host's pages that rules allow, and block.
    """
    edges = scratch.write(host_edges(ruled), "edges")
    per = scratch.write(
        ruled.filter("host <> ''").groupBy("host").agg(
            (F.count_if(F.col("rule_verdict") == "allow") / F.count(F.lit(1))).alias("good"),
            (F.count_if(F.col("rule_verdict") == "block") / F.count(F.lit(1))).alias("bad"),
        ),
        "seeds",
    )
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(
        edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), "n")
    )
    seeds = per.select(F.lit("trust").alias("kind"), "host", F.col("good").alias("seed")).union(per.select(F.lit("distrust"), "host", "bad"))
    scores = spread(both, seeds, scratch, keep, tolerance=tolerance).withColumn("score", F.try_divide("score", "mean"))
    value = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return scratch.write(scores.groupBy("host").agg(value("trust"), value("distrust")), "evidence")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, least_distrust: float = 1.0, keep: float = 0.85) -> DataFrame:
    """One row per row of ``pages``: page_id, url, host, path, rule, verdict, trust, distrust.

    Where no rule fits, a page is blocked if its host's distrust (1: that of the mean host) reaches ``least_distrust`` and exceeds its trust; else it is
    allowed. ``keep`` 0 leaves every host its own seeds. Null urls, or urls without ``://``, have an empty host and path and no evidence. Null html has no
    links; repeated rows keep their rows; other columns are not read; an empty table returns none.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    ruled = match_rules(pages.select("page_id", "url", "html"), rules)
    found = evidence(ruled, scratch, keep).withColumnRenamed("host", "h")
    found = F.broadcast(found) if found.count() <= BROADCAST_HOSTS else found
    rows = ruled.drop("html").join(found, F.col("host") == F.col("h"), "left").drop("h")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    bad = (F.col("distrust") >= least_distrust) & (F.col("distrust") > F.col("trust"))
    verdict = F.coalesce("rule_verdict", F.when(bad, "block").otherwise("allow"))
    return rows.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
