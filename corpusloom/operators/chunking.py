"""Documents to chunks, chunks to vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.functions import fixed
from corpusloom.functions.arrow import parts
from corpusloom.functions.chunks import split_text
from corpusloom.functions.vectors import Encoder, WordHashEncoder, unit
from corpusloom.operators.ordering import rank_in_group


def recursive_chunks(
    content: Column, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP, separators=None
) -> Column:
    seps = list(separators or fixed.CHUNK_SEPARATORS)

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([split_text(x, size, overlap, seps) if x else [] for x in s])

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<string>")(content)


def window_chunks(content: Column, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP) -> Column:
    """Fixed windows of `size` characters that share `overlap`; no Python."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(content) - overlap) / F.lit(step)) - 1)
    starts = F.sequence(F.lit(0).cast("long"), last.cast("long"))
    return F.when(
        F.length(content) > 0,
        F.transform(starts, lambda i: F.substr(content, (i * step + 1).cast("int"), F.lit(size))),
    ).otherwise(F.array().cast("array<string>"))


def with_position(docs: DataFrame, order: list[str], buckets: int | None = None) -> DataFrame:
    """0-based place of each document in the whole list; empty ones count."""
    ranked = rank_in_group(docs, [], order, "doc_position", buckets)
    return ranked.withColumn("doc_position", F.col("doc_position") - 1)


def explode_chunks(docs: DataFrame, chunks: Column) -> DataFrame:
    """(id, title, url, content, doc_position) -> one row per chunk with the id
    `{id}_{place of the document}_chunk_{number}`. Empty documents give none."""
    rows = docs.filter(F.length("content") > 0).select(
        F.col("id").alias("_id"), "title", "url", "doc_position", F.posexplode(chunks).alias("chunk_number", "content")
    )
    return rows.select(
        F.concat_ws("_", "_id", "doc_position", F.lit("chunk"), "chunk_number").alias("id"),
        "title",
        "url",
        "content",
        "doc_position",
        "chunk_number",
    )


def embed_text(title: Column | str, content: Column | str) -> Column:
    """What is encoded for a chunk: its title and its text, labelled."""
    title = F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit(""))
    content = F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit(""))
    return F.concat(F.lit(fixed.EMBED_TITLE_LABEL), title, F.lit("\n" + fixed.EMBED_BODY_LABEL), content)


def encode(
    df: DataFrame, text: str, out: str = "embedding", encoder: Encoder | None = None, keep_text: bool = True
) -> DataFrame:
    """Add the vector of column `text`; one encoder per Python worker, Arrow
    batches in and out, of which a slice of few texts is encoded at a time. Every
    column of `df` makes the trip, so select first."""
    encoder = encoder or WordHashEncoder()
    place = df.columns.index(text)
    kept = [i for i in range(len(df.columns)) if keep_text or i != place]
    names = [*(df.columns[i] for i in kept), out]
    schema = T.StructType([*(df.schema[i] for i in kept), T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in parts(batch, place)):
            texts = [x or "" for x in part.column(place).to_pylist()]
            matrix = np.asarray(encoder(texts), dtype=np.float32)
            ends = np.arange(0, matrix.size + 1, matrix.shape[1] or 1, dtype=np.int32)[: len(texts) + 1]
            vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel()))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), vectors], names=names)

    return df.mapInArrow(run, schema)


def normalised(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.withColumn(vector, unit(vector))


def vector_report(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Size check before a search: number of vectors and of dimensions."""
    return df.agg(
        F.count(F.lit(1)).alias("vectors"),
        F.min(F.size(vector)).alias("min_dimensions"),
        F.max(F.size(vector)).alias("max_dimensions"),
    )
