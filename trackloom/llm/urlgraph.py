"""URL filters: allow and block rules, and link-graph propagation where no rule fits.

Host edges are the absolute links (``href``/``src``) and mail addresses of the pages,
summed per pair of hosts. Trust spreads along edges by personalised PageRank from hosts
with allowed pages; distrust spreads against them from hosts most of whose pages are blocked. A page
that no rule judges takes the verdict of its host: block where distrust exceeds trust by
more than the threshold's share of both. Scores are shares of a walk and shrink as hosts are
added; their ratio does not, so the verdict is free of the number of hosts.

Both walks run in one frame keyed by (walk, host); edges hold each host's share of its
out- or in-weight. A round is one join and one summed shuffle; every few rounds the
scores are written to the shared folder, so a lost executor repeats a few rounds at most, and
the walks end once a round changes them by less than a tolerance. A link's host is all between
``://`` and the path, with port and user as pages have them.
Mass at hosts without edges is dropped, not spread. Only DataFrame operations are used.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule
and is allowed. A null ``html`` has no links. Repeated rows count as pages of their own.
Tables without edges or seeds leave the scores at zero, so unjudged pages are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import LOWER, UPPER, take, written

# Fixed values of the query: (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
DAMPING = 0.85
ROUNDS_PER_WRITE = 4
#: Walks end when a round moves less than this share of a walk, at ``ROUNDS`` at the latest: by then
#: a walk that loses nothing at dead ends moves 0.85 ** 60 = 6e-5.
TOLERANCE = 1e-4
ROUNDS = 60
BROADCAST_HOSTS = 100_000
THRESHOLD = 1e-4
LINK = "(?i)(?:href|src)\\s*=\\s*[\"']?[a-z][a-z0-9+.-]*://([^/?#\"'\\s>]+)"
MAIL = "(?i)[a-z0-9._%+-]@((?:[a-z0-9-]+\\.)+[a-z]{2,})"


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return _lower(host), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null: one CASE expression."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    cases = [
        ((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in longest
    ]
    return F.coalesce(
        *[F.when(c, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for c, (v, h, p) in zip(cases, longest)]
    )


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links and mail addresses from the pages (``_host``, ``_html``)."""
    found = F.concat(F.regexp_extract_all("_html", F.lit(LINK), 1), F.regexp_extract_all("_html", F.lit(MAIL), 1))
    links = pages.filter("_html is not null").select(F.col("_host").alias("src"), F.explode(found).alias("dst"))
    links = links.select("src", _lower(F.col("dst")).alias("dst")).filter("src != dst and src != '' and dst != ''")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(_walk, host, score). ``seeds`` holds (_walk, host, score), each walk summing to one."""
    both = edges.select(F.lit("trust").alias("_walk"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight").union(
        edges.select(F.lit("distrust"), "dst", "src", "weight")
    )
    whole = both.groupBy("_walk", "a").agg(F.sum("weight").alias("_all"))
    shares = written(
        both.join(whole, ["_walk", "a"]).select("_walk", F.col("a").alias("host"), "b", (F.col("weight") / F.col("_all")).alias("_share")),
        "edges",
    )
    start = seeds.withColumn("score", (1 - damping) * F.col("score"))
    scores = seeds
    for k in range(rounds):
        moved = scores.join(shares, ["_walk", "host"]).select("_walk", F.col("b").alias("host"), (damping * F.col("score") * F.col("_share")).alias("score"))
        last, scores = scores, start.union(moved).groupBy("_walk", "host").agg(F.sum("score").alias("score"))
        if k % ROUNDS_PER_WRITE == ROUNDS_PER_WRITE - 1:
            scores = written(scores, "scores")
            if _moved(last, scores) < tolerance:
                break
        elif k % ROUNDS_PER_WRITE == ROUNDS_PER_WRITE - 2:
            scores = written(scores, "scores")
    return scores


def _moved(last: DataFrame, scores: DataFrame) -> float:
    """The larger of both walks' summed changes in a round."""
    both = last.union(scores.select("_walk", "host", -F.col("score"))).groupBy("_walk", "host").agg(F.abs(F.sum("score")).alias("d"))
    return max([r["d"] for r in both.groupBy("_walk").agg(F.sum("d").alias("d")).collect()], default=0.0)  # two rows


def host_scores(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust) from judged pages (``_host``, ``_fit``) and host edges."""
    side = lambda v: F.count_if(F.coalesce(F.col("_fit.verdict") == v, F.lit(False)))
    hosts = pages.filter("_host != ''").groupBy(F.col("_host").alias("host")).agg(
        side("allow").alias("allowed"), side("block").alias("blocked"), F.count(F.lit(1)).alias("n")
    )
    votes = hosts.filter("allowed > 0").select(F.lit("trust").alias("_walk"), "host", F.col("allowed").alias("n")).union(
        hosts.filter("2 * blocked > n").select(F.lit("distrust"), "host", "blocked")
    )
    sums = F.broadcast(votes.groupBy("_walk").agg(F.sum("n").alias("_n")))  # two rows
    seeds = written(votes.join(sums, "_walk").select("_walk", "host", (F.col("n") / F.col("_n")).alias("score")), "seeds")
    scores = propagated(edges, seeds)
    best = lambda w: F.coalesce(F.max(F.when(F.col("_walk") == w, F.col("score"))), F.lit(0.0)).alias(w)
    return scores.groupBy("host").agg(best("trust"), best("distrust"))


def filtered(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict`` and the scores of its host."""
    df = take(pages, _id=page_id, _url=url, _html=html)
    host, path = split_url(F.col("_url").cast("string"))
    df = df.select("_id", F.col("_html").cast("string").alias("_html"), host.alias("_host"), path.alias("_path"))
    df = df.withColumn("_fit", matched_rule(F.col("_host"), F.col("_path"), rules))
    scores = written(host_scores(df, host_edges(df)).withColumnRenamed("host", "_host"), "hosts")
    if scores.count() <= BROADCAST_HOSTS:  # bounded by the check; else a shuffle join
        scores = F.broadcast(scores)
    out = df.drop("_html").join(scores, "_host", "left").fillna(0.0, ["trust", "distrust"])
    own = F.when(F.col("distrust") - F.col("trust") > THRESHOLD * (F.col("distrust") + F.col("trust")), "block").otherwise("allow")
    return out.select(
        F.col("_id").alias("page_id"),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_fit.rule").alias("rule"),
        F.coalesce("_fit.verdict", own).alias("verdict"),
        "trust",
        "distrust",
    )


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns of query op2."""
    return filtered(pages).drop("trust", "distrust")
