"""Bounded searches: the best page of each site, and listings behind a ceiling of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Steps
from ..types import join_keys
from .ordered import placed


def visit_sites(starts: DataFrame, pages: DataFrame, links: DataFrame, most: int = 12, overlap: float = 0.8) -> DataFrame:
    """Best-first visits of all sites at once: site, nth, url, found, score, certain and home (is it the home page again).

    starts: site, url, weight (what is tried without a link; the first one of a site is its home).  pages: site, url, score
    (0: nothing of interest), certain, words (distinct).  links: site, url, target, weight (0: never followed), at (place in the page).
    Each round is a join: every open site takes its best untried address (weight, then round of discovery, place, address), the
    page is looked up, and its links join the frontier.  A site is closed by a certain page or after `most` visits, found or not.
    A page that shares `overlap` of the smaller word set with the home page is a soft 404, the home page under another address.
    """
    steps, kept = Steps(starts.sparkSession, "site-search"), Steps(starts.sparkSession, "site-visits")
    pages = steps.put(pages.select("site", "url", "score", "certain", "words"))
    order = F.struct((-F.col("weight")).alias("w"), "round", "at", "url")
    first = starts.groupBy("site", "url").agg(F.max("weight").cast("double").alias("weight"))
    frontier = steps.put(first.select("site", "url", "weight", F.lit(0).alias("round"), F.lit(0).cast("long").alias("at")))
    homes = steps.put(join_keys(starts.groupBy("site").agg(F.max_by("url", "weight").alias("url")), pages.select("site", "url", "words"), ["site", "url"]).select("site", F.col("words").alias("home_words")))
    targets = steps.put(links.where("weight > 0").groupBy("site", "url", "target").agg(F.max(F.col("weight").cast("double")).alias("weight"), F.min("at").cast("long").alias("at")))
    visits = None
    for n in range(1, most + 1):
        left = frontier  # whatever was found less what was visited, of sites without a certain page
        if visits is not None:
            left = join_keys(join_keys(frontier, visits.select("site", "url"), ["site", "url"], "left_anti"), visits.where("certain").select("site"), ["site"], "left_anti")
        picked = left.groupBy("site").agg(F.min(order).alias("p")).select("site", "p.url")
        seen = join_keys(join_keys(picked, pages, ["site", "url"], "left"), homes, ["site"], "left")
        share = F.size(F.array_intersect("words", "home_words")) / F.greatest(F.least(F.size("words"), F.size("home_words")), F.lit(1))
        seen = steps.put(seen.select("site", F.lit(n).cast("long").alias("nth"), "url", F.col("score").isNotNull().alias("found"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("certain", F.lit(False)).alias("certain"), F.coalesce(share >= overlap, F.lit(False)).alias("home")))
        visits = seen if visits is None else visits.unionByName(seen)
        if n == most or seen.isEmpty():
            break
        found = join_keys(seen.where("not certain").select("site", "url"), targets, ["site", "url"]).groupBy("site", F.col("target").alias("url")).agg(F.max("weight").alias("weight"), F.min("at").alias("at"))
        fresh = join_keys(found, frontier.select("site", "url"), ["site", "url"], "left_anti").select("site", "url", "weight", F.lit(n).alias("round"), "at")
        frontier = frontier.unionByName(steps.put(fresh))
    visits = kept.put(visits)
    steps.end()
    return visits


def best_pages(visits: DataFrame) -> DataFrame:
    """site, status (found, notFound, unreachable), url, score, certain and visited: of each site the page of highest score, the first visited one of ties.

    The home page, under whatever address, counts only if it is certain; unreachable is a site none of whose addresses was found.
    """
    counts = F.col("found") & (F.col("score") > 0) & (F.col("certain") | ~F.col("home"))
    best = F.max(F.when(counts, F.struct("score", (-F.col("nth")).alias("n"), "url", "certain"))).alias("best")
    status = F.when(F.col("best").isNotNull(), "found").when(F.col("reached"), "notFound").otherwise("unreachable")
    each = visits.groupBy("site").agg(best, F.max("found").alias("reached"), F.count(F.lit(1)).alias("visited"))
    return each.select("site", status.alias("status"), "best.url", "best.score", "best.certain", "visited")


def _cells(df: DataFrame, facets: list[str], ceiling: int) -> DataFrame:
    """Each combination of facet values with the depth of the search that has it, and the number of hits of that search."""
    cells = df.groupBy(*facets).agg(F.count(F.lit(1)).alias("__n"))
    counts = ["__n0", *[f"__n{k}" for k in range(1, len(facets) + 1)]]
    cells = cells.crossJoin(F.broadcast(cells.agg(F.sum("__n").alias("__n0"))))  # one row
    cells = cells.withColumns({f"__n{k}": F.sum("__n").over(Window.partitionBy(*facets[:k])) for k in range(1, len(facets) + 1)})
    depth = F.coalesce(*[F.when(F.col(c) <= ceiling, k) for k, c in enumerate(counts)], F.lit(len(facets)))
    return cells.withColumn("depth", depth).withColumn("hits", F.element_at(F.array(*counts), F.col("depth") + 1)).select(*facets, "depth", "hits", "__n")


def covering_searches(df: DataFrame, facets: list[str], ceiling: int) -> DataFrame:
    """Searches that together have every row once, none of more than `ceiling` hits: depth, facets, hits and parts.

    A search fixes the first `depth` facets (the others are null) and is as short as the ceiling allows.  What is above it
    with all facets fixed is read in `parts` ranges of the row key.  Work after the one count is by combinations of values.
    """
    masked = [F.when(F.col("depth") > i, F.col(f)).alias(f) for i, f in enumerate(facets)]
    return _cells(df, facets, ceiling).groupBy("depth", *masked).agg(F.first("hits").alias("hits")).withColumn("parts", F.ceil(F.col("hits") / ceiling).cast("int"))


def searched_rows(df: DataFrame, facets: list[str], key: list[str], ceiling: int) -> DataFrame:
    """df with the depth of the search that returns each row, and its part: ranges of the key, of `ceiling` rows."""
    found = join_keys(df, _cells(df, facets, ceiling).select(*facets, "depth", "hits"), facets)
    whole = found.where(F.col("hits") <= ceiling).withColumn("part", F.lit(0).cast("long"))
    split = placed(found.where(F.col("hits") > ceiling), facets, [], [F.col(c) for c in key], "__at")
    return whole.unionByName(split.withColumn("part", F.floor((F.col("__at") - 1) / ceiling).cast("long")).drop("__at")).drop("hits")
