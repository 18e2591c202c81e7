"""Structured documents, what is derived from them, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import article, fixed
from corpusloom.functions.text import document_id, ellipsis


def parse_articles(files: DataFrame, source: str, language: str = "vi") -> DataFrame:
    """(file_name, value) -> structured documents."""
    text = F.col("value")
    parts = files.withColumns(
        {"metadata": article.metadata(text, source, language), "content": article.main_content(text)}
    )
    return parts.select(
        document_id("file_name").alias("id"),
        F.col("metadata.title").alias("title"),
        F.col("metadata.url").alias("url"),
        "content",
        article.authors(text).alias("authors"),
        article.reviewers(text).alias("reviewers"),
        article.references(text).alias("references"),
        # main_content cleans what stands behind the body mark
        article.section_map(article.section_entries(F.col("content"), F.contains(text, F.lit(fixed.BODY_MARK)))).alias("sections"),
        "metadata",
    )


def instruction_rows(docs: DataFrame) -> DataFrame:
    """One row that asks what the title is, and one per section. (The outer
    explode only keeps Spark from testing the array for emptiness first, which
    would parse every section twice.)"""

    def row(instruction, output, section):
        return F.struct(
            instruction.alias("instruction"),
            F.lit("").alias("input"),
            output.alias("output"),
            F.struct(
                F.col("url").alias("source"), F.col("title").alias("title"), section.cast("string").alias("section")
            ).alias("metadata"),
        )

    intro = row(F.concat("title", F.lit(fixed.WHAT_IS)), ellipsis("content", 500), F.lit(None))
    long_enough = F.filter(F.map_entries("sections"), lambda e: F.length(e["value"]) > 50)
    more = F.transform(
        long_enough,
        lambda e: row(
            F.concat(F.lit(fixed.EXPLAIN), F.lower(e["key"]), F.lit(fixed.EXPLAIN_OF), F.col("title")), e["value"], e["key"]
        ),
    )
    return docs.select(F.explode_outer(F.concat(F.array(intro), more)).alias("r")).select("r.*")


def statistics(docs: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    chars = F.coalesce(F.sum(F.length("content").cast("long")), F.lit(0))
    return docs.agg(
        n.alias("documents"),
        chars.alias("characters"),
        F.coalesce(F.expr("sum(length(content)) div count(1)"), F.lit(0)).alias("characters_per_document"),
        F.coalesce(F.sum(F.size("sections")), F.lit(0)).alias("sections"),
        F.coalesce(F.sum(F.size("references")), F.lit(0)).alias("references"),
        F.count_if(F.size("authors") > 0).alias("with_author"),
        F.count_if(F.size("reviewers") > 0).alias("with_reviewer"),
    )


def first_preview(docs: DataFrame, order: str, n: int = 200) -> DataFrame:
    """The first document, its content cut to n characters."""
    first = docs.orderBy(order).limit(1)
    return first.withColumn("content", F.concat(F.substring("content", 1, n), F.lit("...")))
