"""From pages or documents to searchable chunks, and from questions to prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions.text import clean_text
from corpusloom.functions.vectors import Encoder
from corpusloom.operators import chunking, dialogue, documents, retrieval, web
from corpusloom.session import saved


def pages_to_documents(pages: DataFrame, source: str, order: str = "page_id") -> DataFrame:
    """Pages -> article texts -> structured documents, without files between."""
    arts = web.file_names(web.complete(web.articles(pages)), order)
    text = web.article_text(F.col("title"), F.col("url"), F.col("content"), F.col("sections"))
    named = arts.select(F.concat("file_stem", F.lit(".txt")).alias("file_name"), text.alias("value"))
    return documents.parse_articles(named, source)


def chunked(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Documents (id, title, url, content) -> chunks."""
    placed = chunking.with_position(docs.select("id", "title", "url", "content"), order or ["id"])
    return chunking.explode_chunks(placed, chunking.recursive_chunks(F.col("content")))


def embedded(chunks: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """Chunks with the vectors of their labelled texts."""
    texts = chunks.withColumn("_text", chunking.embed_text("title", "content"))
    return chunking.encode(texts, "_text", "embedding", encoder, keep_text=False)


def vectors(chunks: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """Only ids and vectors, for a search over chunks that are not stored."""
    texts = chunks.select("id", chunking.embed_text("title", "content").alias("_text"))
    return chunking.encode(texts, "_text", "embedding", encoder, keep_text=False)


def document_rows(docs: DataFrame) -> DataFrame:
    """Rows of a plain (doc_id, text) table as documents: the cleaned first line is
    the title, the cleaned text is the content."""
    return docs.select(
        F.col("doc_id").alias("id"),
        clean_text(F.substring_index("text", "\n", 1)).alias("title"),
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"),
        clean_text("text").alias("content"),
    )


def answers(
    questions: DataFrame,
    corpus: DataFrame,
    texts: DataFrame | None = None,
    encoder: Encoder | None = None,
    k: int = 10,
    cell_bits: int | None = None,
    **search,
) -> DataFrame:
    """(query_id, question, search_text) and embedded chunks -> prompts. Texts
    are only fetched for hits, k per question; `texts` (id, title, content) is
    where from, when the chunks are not a stored table. `cell_bits` and `search` (see
    `retrieval.nearest`) choose cells."""
    asked = chunking.encode(questions.select("query_id", "search_text"), "search_text", "embedding", encoder)
    hits = saved(retrieval.nearest(corpus, asked, k, cell_bits, **search))  # used twice; k rows per question
    rows = hits.join((corpus if texts is None else texts).select("id", "title", "content"), "id")
    gated = retrieval.gates(questions, hits)
    context = retrieval.document_context(rows)
    joined = gated.join(context, "query_id", "left")
    joined = joined.withColumn("context", F.when(F.col("use_documents"), F.coalesce("context", F.lit(""))).otherwise(""))
    return dialogue.prompts(joined)
