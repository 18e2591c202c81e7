"""Page urls from sitemaps that were fetched, through nested indexes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions import fixed
from corpusloom.session import saved

_LOCAL = re.compile(r"\Afile:/+")  # local paths are written with one slash or three
_LOCS = "struct<url: array<struct<loc: string>>, sitemap: array<struct<loc: string>>>"


def address(url: Column | str) -> Column:
    """A url without white space around it, scheme, fragment and percent-encoding: what a
    sitemap goes by."""
    url = F.trim(F.col(url) if isinstance(url, str) else url)
    url = F.regexp_replace(F.regexp_replace(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*", "")
    return F.coalesce(F.try_url_decode(url), url)


def fetched_sitemaps(spark: SparkSession, folder: str) -> DataFrame:
    """(url, xml) of the files below `folder`, each stored under its host and path, such as
    `folder/a.org/maps/topic.xml`, percent-encoded where needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    base = _LOCAL.sub("file:/", base.rstrip("/") + "/")
    raw = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    name = F.regexp_replace("_metadata.file_path", _LOCAL.pattern, "file:/")
    return raw.select(F.url_decode(F.substr(name, F.lit(len(base) + 1))).alias("url"), F.col("value").alias("xml"))


def parsed_sitemaps(fetched: DataFrame) -> DataFrame:
    """(url, xml) -> address, pages, children: the urls in each sitemap. A sitemap that names
    others is an index, and its own pages do not count; one that cannot be parsed has
    neither."""
    read = F.from_xml("xml", _LOCS, {"mode": "PERMISSIVE", "ignoreNamespace": "true"})
    rows = fetched.select(address("url").alias("address"), read.alias("x"))

    def locs(name: str) -> Column:
        trimmed = F.transform(F.col(f"x.{name}"), lambda e: F.trim(e["loc"]))
        return F.coalesce(F.filter(trimmed, lambda u: u.isNotNull()), F.array().cast("array<string>"))

    rows = rows.select("address", locs("url").alias("pages"), locs("sitemap").alias("children"))
    return rows.withColumn("pages", F.when(F.size("children") == 0, F.col("pages")).otherwise(F.array().cast("array<string>")))


def sitemap_pages(
    fetched: DataFrame, roots: DataFrame, child_part: str = fixed.SITEMAP_CHILD_PART, part: str = fixed.SITEMAP_PAGE_PART
) -> DataFrame:
    """Urls of pages that hold `part`, from the sitemaps at `roots` (url) and all that indexes
    among them name, at any depth, whose url holds `child_part`. One row for each time a
    sitemap lists a page. A sitemap is found by its full url and read once, however often
    and from wherever it is named, so indexes that name each other do no harm; ones that
    were not fetched are left out.

    The frontier is expanded level by level: children of the sitemaps found last, without those
    found before, until there are none. Only addresses move, and no list of them comes to the
    driver."""
    sitemaps = saved(parsed_sitemaps(fetched).dropDuplicates(["address"]))
    edges = sitemaps.select("address", F.explode("children").alias("child"))
    edges = edges.filter(F.contains("child", F.lit(child_part))).select("address", address("child").alias("child")).distinct()
    edges = saved(edges)
    seen = frontier = saved(roots.select(address("url").alias("address")).distinct())
    while True:
        found = edges.join(frontier, "address").select(F.col("child").alias("address")).distinct()
        frontier = saved(found.join(seen, "address", "left_anti"))
        if frontier.isEmpty():
            break
        seen = saved(seen.unionByName(frontier))
    pages = sitemaps.join(seen, "address", "left_semi").select(F.explode("pages").alias("url"))
    return pages.filter(F.contains("url", F.lit(part)))
