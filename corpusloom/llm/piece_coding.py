"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of a model has a white-space marker behind anything else, merges never
cross from a chunk (markers and what follows them) to the next one, so each distinct
chunk of the corpus is segmented once and ids are put back by position. Other models get
whole texts as chunks, which is right for any of them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corpusloom.llm.chunk_table import BLOCK, Placed, by_chunk
from corpusloom.llm.shared import map_batches

MARK = "▁"
_CHUNK = re.compile(rb"\x20+[^\x20]*")
_models: dict[str, object] = {}


def model_at(path: str):
    from sentencepiece import SentencePieceProcessor

    if path not in _models:
        _models[path] = SentencePieceProcessor(model_file=path)
    return _models[path]


def can_cut(path: str) -> bool:
    """Whether chunks can be segmented on their own: markers stand only at the start of
    pieces, a marker is added ahead of a text, texts are not changed otherwise, and
    unknown characters become bytes (else neighbours would merge into one id)."""
    model = model_at(path)
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    probe = "  Aé́ﬁＡ\t b\n "
    kept = model.normalize(probe) == MARK + probe.replace(" ", MARK)
    return kept and MARK in pieces and any(map(model.is_byte, ids)) and all(MARK not in p.lstrip(MARK) for p in pieces)


def chunks(texts: pa.Array) -> pa.ListArray:
    """Chunks of each text in order, each without its first marker; spaces and markers are
    the same to a model. A space is added ahead of a text, as the model does."""
    texts = pa.compute.replace_substring(texts, MARK.encode(), b" ")
    simple = pa.compute.split_pattern(texts, b" ")
    sizes, found = np.asarray(simple.value_lengths()).copy(), simple.flatten()
    # an empty chunk tells of an empty text or of spaces side by side or at an end
    odd = np.unique(np.repeat(np.arange(len(sizes)), sizes)[np.asarray(pa.compute.binary_length(found)) == 0])
    if not len(odd):
        return simple
    ends, parts, last = np.cumsum(sizes), [], 0
    for i, text in zip(odd.tolist(), texts.take(pa.array(odd)).to_pylist()):
        own = [c[1:] for c in _CHUNK.findall(b" " + text)] if text else []
        parts += [found.slice(last, ends[i] - sizes[i] - last), pa.array(own, pa.binary())]
        last, sizes[i] = ends[i], len(own)
    joined = pa.concat_arrays([*parts, found.slice(last)])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), joined)


def _whole(texts: pa.Array) -> pa.ListArray:
    some = np.asarray(pa.compute.binary_length(texts)) > 0
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some))), pa.int32()), texts.filter(pa.array(some)))


def encoded(
    docs: DataFrame, model: str, end: bool = True, keep: list[str] | None = None, block: int = BLOCK, buckets: int | None = None
) -> DataFrame:
    """The columns `keep` (doc_id) and `ids`, array of int: a text's ids by the file `model`,
    as the library gives them without sampling, and with `end` the model's end id.

    A null text is empty and has only the end id. There is one row for each row of
    `docs`, so null or repeated doc_id are kept. Other columns are ignored, whatever
    their names. An empty table gives no rows."""
    keep = keep or ["doc_id"]
    cut = chunks if can_cut(model) else _whole

    def work():
        found = model_at(model)

        def segment(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            ids = found.encode([c.decode("utf-8", "replace") for c in new], num_threads=1)
            ids = [i if c else [found.piece_to_id(MARK)] for c, i in zip(new, ids)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            return sizes, np.fromiter((x for i in ids for x in i), np.int64, int(sizes.sum()))

        return segment

    def place(blocks: Iterable[Placed]) -> Iterator[pa.RecordBatch]:
        last = np.array([model_at(model).eos_id()] if end else [], np.int64)
        for b in blocks:
            places, n = b.places()
            ends = np.concatenate(([0], np.cumsum(n)))[b.bounds]
            ids = np.insert(b.values[places], np.repeat(ends[1:], len(last)), np.tile(last, len(ends) - 1))
            ends = ends + np.arange(len(ends)) * len(last)
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.rows.columns, column], [*keep, "ids"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return by_chunk(docs, keep, cut, work, place, schema, block=block, buckets=buckets)


def decoded(coded: DataFrame, model: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns and `name`, the text that the library decodes `ids` to. Null ids give
    null; in an array, nulls and numbers that are no ids of the model are passed over."""
    kept = [c for c in coded.columns if c != name]
    schema = T.StructType([*(coded.schema[c] for c in kept), T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model_at(model)
        size = found.get_piece_size()
        for batch in batches:
            lists, flat = batch.column(ids).to_pylist(), batch.column(ids).flatten()
            known = [i for i in lists if i is not None]
            least, most = pa.compute.min_max(flat).values()
            if flat.null_count or len(flat) and not 0 <= least.as_py() <= most.as_py() < size:
                known = [[x for x in i if x is not None and 0 <= x < size] for i in known]
            texts = iter(found.decode(known, num_threads=1) if known else [])
            column = pa.array([None if i is None else next(texts) for i in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), column], [*kept, name])

    return map_batches(coded, run, schema)
