"""Breadth-first traversal of link graphs: a job for each level, frontiers as joins."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions import urls as u
from . import links as ln
from .lineage import cut


def bfs_depth(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth): all nodes that edges (src, dst) lead to from seeds (node), with the number of steps. No caps: every node once, whatever the size."""
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null"), "edges")  # else every level would make them again
    seen = cut(seeds.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)), "bfs")
    front, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = edges.join(front, edges["src"] == front["node"]).select(F.col("dst").alias("node")).where("node is not null").distinct()
        new = cut(new.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        if new.isEmpty():
            break
        seen, front = seen.unionByName(new), new
    return seen


@F.pandas_udf(T.BooleanType())
def robots_allow(robots: pd.Series, url: pd.Series) -> pd.Series:
    """Whether a robots file lets any agent read a URL. No file: it does."""
    from urllib.robotparser import RobotFileParser

    known: dict[str, RobotFileParser] = {}

    def one(text, address):
        if text is None:
            return True
        if text not in known:
            known[text] = RobotFileParser()
            known[text].parse(text.splitlines())
        return known[text].can_fetch("*", address)

    return pd.Series([one(r, a) for r, a in zip(robots, url, strict=True)], dtype=bool)


def allowed(rows: DataFrame, robots: DataFrame | None, url: str = "url") -> DataFrame:
    """rows whose URL its site's robots file (host with scheme, robots_txt) allows."""
    if robots is None:
        return rows
    host = F.concat(u.scheme(F.col(url)), F.lit("://"), u.netloc(F.col(url)))
    return rows.withColumn("_host", host).join(robots.select(F.col("host").alias("_host"), "robots_txt"), "_host", "left").where(robots_allow("robots_txt", F.col(url))).drop("_host", "robots_txt")


def follow(url: Column, start: Column, include: Iterable[str] | None, exclude: Iterable[str] | None) -> Column:
    """Which links a crawl follows: those of the host that match an include pattern, or without these the focus rule, and no exclude pattern."""
    out = u.same_host(url, start) & (tx.matches_any(url, include) if include else ln.should_follow(url, start))
    return out & ~tx.matches_any(url, exclude) if exclude else out


def crawl(pages: DataFrame, links: DataFrame, start_url: str, max_depth: int = 2, max_pages: int = 50, include: Iterable[str] | None = None, exclude: Iterable[str] | None = None, robots: DataFrame | None = None) -> DataFrame:
    """(seq, url, depth) of the pages that a crawl of stored pages (url, success) and links (src, pos, dst) reads, in its order.

    Pages that are missing or failed don't count against max_pages. The page that fills the cap isn't expanded, so a level holds
    max_pages rows at the most. Addresses are normalised; the start is the only seed.
    """
    spark = pages.sparkSession
    include, exclude = list(include or []), list(exclude or [])
    start, _ = ln._normal(start_url)
    at = F.lit(start)
    good = pages.where("success").select(u.normalize(F.col("url")).alias("url")).distinct()
    hops = links.select(u.normalize(F.col("src")).alias("src"), "pos", u.normalize(F.col("dst")).alias("dst"))
    front = spark.createDataFrame([(start, 0)], "url string, rank long")
    seen, found, n = front.select("url"), None, 0
    for depth in range(max_depth + 1):
        w = Window.orderBy("rank")  # max_pages rows at the most
        take = front.join(good, "url").orderBy("rank").limit(max_pages - n)
        got = cut(take.withColumn("seq", F.row_number().over(w) - 1 + n).select("seq", "url", F.lit(depth).alias("depth")), "crawl")
        found = got if found is None else found.unionByName(got)
        n += got.count()
        if n >= max_pages or depth == max_depth:
            break
        step = hops.join(F.broadcast(got.select(F.col("url").alias("src"), "seq")), "src").where(follow(F.col("dst"), at, include, exclude))
        step = allowed(step, robots, "dst")
        order = F.struct("seq", (~u.same_family(F.col("dst"), at)).alias("f"), (~ln.product_relevant(F.col("dst"))).alias("p"), "pos")
        new = step.groupBy(F.col("dst").alias("url")).agg(F.min(order).alias("o")).join(seen, "url", "left_anti")
        new = cut(new.withColumn("rank", F.col("o")), "crawl")
        if new.isEmpty():
            break
        front = new.select("url", "rank")
        seen = seen.unionByName(new.select("url"))
    return found


def crawl_focused(pages: DataFrame, links: DataFrame, start_url: str, modality: str | None = None, include: Iterable[str] = (), exclude: Iterable[str] = (), **options) -> DataFrame:
    """A crawl along a focus plan."""
    plan = ln.focus_plan(start_url, modality, include, exclude)
    return crawl(pages, links, plan.start_url, include=plan.include, exclude=plan.exclude, **options)


def map_site(pages: DataFrame, links: DataFrame, start_url: str, robots: DataFrame | None = None, max_pages: int | None = 200) -> DataFrame:
    """All addresses (url) of the start's host that its pages lead to, sorted. links: (src, pos, dst).

    Pages are read in the order in which they are found, as long as fewer than max_pages addresses are known: the page that reaches the number is
    read whole, so there may be a few more. Without a number all pages are read.
    """
    spark = pages.sparkSession
    start, _ = ln._normal(start_url)
    good = pages.where("success").select(u.normalize(F.col("url")).alias("src")).distinct()
    hops = links.select(u.normalize(F.col("src")).alias("src"), "pos", u.normalize(F.col("dst")).alias("dst")).where(u.same_host(F.col("dst"), F.lit(start)))
    hops = allowed(hops.join(good, "src"), robots, "dst")
    if not max_pages:
        return bfs_depth(hops, spark.createDataFrame([(start,)], "node string")).select(F.col("node").alias("url")).orderBy("url")
    front = spark.createDataFrame([(start, 0)], "url string, rank int")
    seen, n = front.select("url"), 1
    while n < max_pages:
        step = hops.join(F.broadcast(front.select(F.col("url").alias("src"), "rank")), "src")  # as many rows as the cap and a page's links, at the most
        new = cut(step.groupBy(F.col("dst").alias("url")).agg(F.min(F.struct("rank", "pos", "dst")).alias("at")).join(seen, "url", "left_anti"), "map")
        last = -1
        for r in new.groupBy("at.rank").agg(F.count("*").alias("n")).orderBy("rank").collect():  # a row for each page of the level
            if n >= max_pages:
                break
            last, n = r.rank, n + r.n
        if last < 0:
            break
        new = new.where(F.col("at.rank") <= last)
        seen = cut(seen.unionByName(new.select("url")), "map")
        front = cut(new.select("url", (F.row_number().over(Window.orderBy("at")) - 1).alias("rank")), "map")
    return seen.orderBy("url")
