"""From a page table to named article texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import fixed
from corpusloom.functions.html import read_articles, read_links
from corpusloom.functions.text import safe_stem
from corpusloom.operators.ordering import rank_in_group, running_sum
from corpusloom.session import saved


def articles(pages: DataFrame, selectors=None) -> DataFrame:
    """Replace `html` by title, content and sections."""
    return read_articles(pages, "html", selectors)


def complete(arts: DataFrame) -> DataFrame:
    """Drop articles without a title or a body."""
    return arts.filter((F.length("title") > 0) & (F.length("content") > 0))


def links(pages: DataFrame, part: str = fixed.LINK_PART, base: Column | None = None) -> DataFrame:
    """Distinct absolute link targets per page with their place. `base` is the
    site's address; by default the page's own url."""
    rows = pages.select("page_id", (F.col("url") if base is None else base).alias("_base"), "html")
    found = read_links(rows, part, "_base")
    return found.select("page_id", F.posexplode(F.array_distinct("links")).alias("position", "link"))


def unseen(urls: DataFrame, visited: DataFrame) -> DataFrame:
    """Rows whose url was not visited yet."""
    return urls.join(visited.select("url"), "url", "left_anti")


def first_urls(urls: DataFrame, order: str, limit: int | None) -> DataFrame:
    return urls if not limit else urls.orderBy(order).limit(limit)


def crawl_report(arts: DataFrame) -> DataFrame:
    """Number of articles that could be stored, and of all urls."""
    ok = (F.length("title") > 0) & (F.length("content") > 0)
    return arts.agg(F.count_if(ok).alias("stored"), F.count(F.lit(1)).alias("total"))


def file_names(arts: DataFrame, order: str, existing: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """Add `file_stem`: the safe title, with `_1`, `_2`, ... from the second use
    on. Numbers in use are skipped: those of `existing` (column file_stem), and
    those that are some article's own title. A title may be shared by any
    number of articles: they are ranked range by range, never in one task."""
    # keys and stems only, parsed once; the articles are joined at the end
    stemmed = saved(arts.select(F.col(order).alias("_key"), safe_stem("title").alias("_stem")))
    ranked = saved(rank_in_group(stemmed, ["_stem"], ["_key"], "_rank", buckets))
    # a number that is given is at most the number of rows, so longer ones clash with none
    split = r"\A(.*)_([1-9][0-9]{0,17})\z"

    def numbered(names: DataFrame) -> DataFrame:
        return names.filter(F.rlike("n", F.lit(rf"(?s){split}"))).select(
            F.regexp_extract("n", rf"(?s){split}", 1).alias("_s"),
            F.regexp_extract("n", rf"(?s){split}", 2).cast("long").alias("_k"),
        )

    own = stemmed.select(F.col("_stem").alias("n"))
    taken = numbered(own)
    if existing is not None:
        old = existing.select(F.col("file_stem").alias("n"))
        taken = taken.unionByName(numbered(old)).unionByName(old.select(F.col("n").alias("_s"), F.lit(0).cast("long").alias("_k")))
    taken = saved(taken.distinct().join(stemmed.select(F.col("_stem").alias("_s")).distinct(), "_s", "left_semi"))
    placed = ranked.select("_stem", (F.col("_rank") - 1).alias("_place"), "_key")
    if taken.isEmpty():
        moved, number = placed, F.col("_place")
    else:
        moved = _skip_taken(placed, taken, buckets)
        number = F.col("_place") + F.col("_skip")
    name = F.when(number == 0, F.col("_stem")).otherwise(F.concat("_stem", F.lit("_"), number.cast("string")))
    named = moved.select("_key", name.alias("file_stem"))
    return arts.join(named, F.col(order) == F.col("_key")).drop("_key")


def _skip_taken(placed: DataFrame, taken: DataFrame, buckets: int | None) -> DataFrame:
    """Add how many numbers in use lie before each place's number. The j-th
    number k in use pushes on every place beyond the k - j + 1 free numbers below
    it, so it is a running count over places and pushes."""
    pushes = rank_in_group(taken, ["_s"], ["_k"], "_j", buckets)
    pushes = pushes.groupBy(F.col("_s").alias("_stem"), (F.col("_k") - F.col("_j") + 1).alias("_place")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    places = placed.withColumns({"_n": F.lit(0).cast("long"), "_kind": F.lit(1)})
    events = places.unionByName(pushes.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    return running_sum(events, ["_stem"], ["_place", "_kind"], F.col("_n"), "_skip", buckets).filter("_kind = 1")


def article_text(title: Column, url: Column, content: Column, sections: Column) -> Column:
    """The text layout that articles are stored in."""
    head = F.concat(
        F.lit(fixed.TITLE_MARK + " "), title, F.lit("\n" + fixed.URL_MARK + " "), url,
        F.lit("\n" + fixed.RULE + "\n\n" + fixed.BODY_MARK + "\n\n"), content, F.lit("\n\n"),
    )
    parts = F.array_join(
        F.transform(
            sections,
            lambda s, i: F.concat(
                F.lit("\n--- "), (i + 1).cast("string"), F.lit(". "), s["title"], F.lit(" ---\n\n"), s["content"], F.lit("\n")
            ),
        ),
        "",
    )
    tail = F.concat(F.lit(fixed.RULE + "\n" + fixed.PARTS_MARK + "\n\n"), parts)
    return F.concat(head, F.when(F.size(sections) > 0, tail).otherwise(""))
