"""Arrays of tokens: cutting, marking and labelling, all without Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusloom.functions import fixed
from corpusloom.functions.text import words

# A tokenizer turns a batch of texts into one list of token numbers per text.
Tokenizer = Callable[[Sequence[str]], list[list[int]]]
# A formatting turns a row, its values by column, into the texts to train on.
Formatting = Callable[[dict], list[str]]


def keep_first(tokens: Column, n: int | None) -> Column:
    return tokens if n is None else F.slice(tokens, 1, n)


def keep_last(tokens: Column, n: int | None) -> Column:
    if n is None:
        return tokens
    size = F.size(tokens)
    return F.when(size > n, F.slice(tokens, size - n + 1, F.lit(n))).otherwise(tokens)


def truncate(tokens: Column, n: int | None, mode: str = "keep_start") -> Column:
    if mode not in ("keep_start", "keep_end"):
        raise ValueError(f"unknown truncation mode: {mode}")
    return keep_first(tokens, n) if mode == "keep_start" else keep_last(tokens, n)


def with_begin(tokens: Column, begin) -> Column:
    """Put the begin token in front unless it is there."""
    if begin is None:
        return tokens
    has = F.coalesce(F.get(tokens, F.lit(0)) == F.lit(begin), F.lit(False))
    return F.when(has, tokens).otherwise(F.concat(F.array(F.lit(begin)), tokens))


def with_end(tokens: Column, end) -> Column:
    if end is None:
        return tokens
    has = F.coalesce(F.try_element_at(tokens, F.lit(-1)) == F.lit(end), F.lit(False))
    return F.when(has, tokens).otherwise(F.concat(tokens, F.array(F.lit(end))))


def word_tokens(text: Column | str, limit: int | None = None) -> Column:
    """Default tokens: the words themselves; no vocabulary is needed."""
    return keep_first(words(text), limit)


def formatted(df: DataFrame, formatting: Formatting, keep: Sequence[str], out: str = "text") -> DataFrame:
    """The texts that `formatting` makes of each row, none to many: `keep`, `place` (from 0
    in the row) and the text, in Arrow batches."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("place", T.IntegerType()), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [formatting(row) for row in batch.to_pylist()]
            if any(isinstance(t, str) for t in texts):
                raise ValueError("formatting gives a list of texts for each row")
            rows = pa.array([i for i, t in enumerate(texts) for _ in t], pa.int64())
            columns = [batch.column(c).take(rows) for c in keep]
            places = pa.array([i for t in texts for i in range(len(t))], pa.int32())
            yield pa.RecordBatch.from_arrays([*columns, places, pa.array([x for t in texts for x in t], pa.string())], schema.names)

    return df.mapInArrow(run, schema)


def begin_is_written(df: DataFrame, text: str, begin: str, order: Sequence[str], template: str = "") -> bool:
    """Whether texts bring their begin token: the first one starts with it, or the template
    that made them holds it. One row is read, once for a table."""
    first = df.orderBy(*order).select(text).first()
    return begin in template or bool(first and (first[0] or "").startswith(begin))


def tokenize(
    df: DataFrame, text: str, out: str = "input_ids", tokenizer: Tokenizer | None = None, limit: int | None = None,
    begin=None, skip: tuple[str, ...] = ("labels", "input_ids"), written: bool | None = None, mask: str | None = None,
) -> DataFrame:
    """Add tokens of a text column, cut to `limit`. A table that has tokens is
    returned as it is. `begin` is added once, also when the text has it; with `written`
    (see `begin_is_written`) the whole table goes by that, and it is added to all texts or to
    none. `mask` names a column with a 1 for each token."""
    if any(c in df.columns for c in skip):
        return df
    if tokenizer is None:
        tokens = words(text)
    else:

        def run(s: pd.Series) -> pd.Series:
            return pd.Series(tokenizer([x or "" for x in s]))

        run.__annotations__ = {"s": pd.Series, "return": pd.Series}
        tokens = F.pandas_udf(run, "array<bigint>")(text)
    if written is None:
        tokens = with_begin(tokens, begin)
    elif begin is not None and not written:
        tokens = F.concat(F.array(F.lit(begin)), tokens)
    df = df.withColumn(out, keep_first(tokens, limit))
    return df if mask is None else df.withColumn(mask, F.array_repeat(F.lit(1), F.size(out)))


def masked_labels(prompt: Column, answer: Column, ignore=fixed.IGNORE_LABEL) -> Column:
    """Labels of prompt + answer: the prompt's places hold the ignore value."""
    return F.concat(F.array_repeat(F.lit(ignore), F.size(prompt)), answer)


def step_rows(
    prompt: Column, steps: Column, labels: Column, separator: Column, begin=None, max_prompt: int | None = None,
    max_completion: int | None = None, max_length: int | None = None, last_only: bool = False,
) -> Column:
    """Tokens and labels of step-labelled answers: (input_ids, labels).

    `steps` is an array of token arrays. A separator follows every step, and the
    step's label sits on its last token; every other place is ignored."""
    n = F.size(steps)
    ignore = F.lit(fixed.IGNORE_LABEL).cast("long")
    ended = F.transform(steps, lambda s: F.concat(s, separator))

    def marks(step: Column, i: Column) -> Column:
        label = F.get(labels, i).cast("long")
        if last_only:
            label = F.when(i == n - 1, label).otherwise(ignore)
        return F.concat(F.array_repeat(ignore, F.size(step) - 1), F.array(label))

    answer = keep_first(F.flatten(ended), max_completion)
    answer_labels = keep_first(F.flatten(F.transform(ended, marks)), max_completion)
    if begin is not None:
        prompt = F.concat(F.array(F.lit(begin)), prompt)
    prompt = keep_last(prompt, max_prompt)
    return F.struct(
        keep_first(F.concat(prompt, answer), max_length).alias("input_ids"),
        keep_first(masked_labels(prompt, answer_labels, ignore), max_length).alias("labels"),
    )
