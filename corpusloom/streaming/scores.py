"""Running statistics of scores that arrive in batches."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState


def prompt_buffers(scores: DataFrame, buffer: int = 16) -> DataFrame:
    """(prompt_id, place, score) -> after every batch, number, mean and population deviation
    of the last `buffer` scores of each prompt that got new ones. `place` is their order, in
    a batch and over batches; missing scores are passed over. State is a ring of `buffer`
    scores; their sum and sum of squares change with each score that enters or leaves."""
    key = scores.schema["prompt_id"].dataType.simpleString()
    out = f"prompt_id {key}, n bigint, mean double, deviation double"
    state = "ring array<double>, shift double, total double, squares double"

    def update(prompt: tuple, frames: Iterable[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        ring, shift, total, squares = kept.get if kept.exists else ([], None, 0.0, 0.0)
        ring = list(ring)
        new: list[tuple] = []
        for frame in frames:  # only the last ones of a batch can stay, so no more are held
            frame = frame[frame["score"].notna()]
            new = sorted([*new, *zip(frame["place"], frame["score"])])[-buffer:]
        for _, score in new:
            shift = float(score) if shift is None else shift  # keeps the squares small
            ring.append(float(score))
            total += ring[-1] - shift
            squares += (ring[-1] - shift) ** 2
            if len(ring) > buffer:
                gone = ring.pop(0) - shift
                total -= gone
                squares -= gone**2
        if not ring:
            return
        kept.update((ring, shift, total, squares))
        mean = total / len(ring)
        deviation = math.sqrt(max(squares / len(ring) - mean**2, 0.0))
        yield pd.DataFrame({"prompt_id": [prompt[0]], "n": [len(ring)], "mean": [shift + mean], "deviation": [deviation]})

    return scores.groupBy("prompt_id").applyInPandasWithState(update, out, state, "update", "NoTimeout")
