"""Preference rows (prompt, chosen, rejected) and unpaired rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.chat import is_conversational
from corpusloom.functions import fixed
from corpusloom.functions.text import let
from corpusloom.functions.tokens import keep_first, keep_last, masked_labels, truncate, with_begin, with_end


def _shared_length(a: Column, b: Column) -> Column:
    """Length of the common start of two strings, by bisection: shorter
    starts agree when a longer one does, so not every place is looked at."""
    top = F.least(F.length(a), F.length(b))

    def step(range_: Column, _: Column) -> Column:
        low, high = range_["low"], range_["high"]
        middle = F.floor((low + high + 1) / 2).cast("int")
        same = F.substr(a, F.lit(1), middle) == F.substr(b, F.lit(1), middle)
        return F.struct(
            F.when(same, middle).otherwise(low).alias("low"),
            F.when(same, high).otherwise(middle - 1).alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), top.alias("high"))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(top + 1)).cast("int") + 1)
    return F.aggregate(steps, start, step, lambda r: r["low"])


def split_prompt(a: Column, b: Column) -> Column:
    """(prompt, chosen, rejected) of two answers that start with the prompt. A
    space at the prompt's end goes to the answers. When one answer is the start
    of the other, its last character stays in the answers."""

    def split(same: Column) -> Column:
        whole = same == F.least(F.length(a), F.length(b))
        spaced = (same > 0) & (F.substr(a, same, F.lit(1)) == " ")
        n = F.when(whole, F.greatest(same - 1, F.lit(0))).when(spaced, same - 1).otherwise(same)
        return F.struct(
            F.substr(a, F.lit(1), n).alias("prompt"),
            F.substr(a, n + 1, F.length(a)).alias("chosen"),
            F.substr(b, n + 1, F.length(b)).alias("rejected"),
        )

    return let(_shared_length(a, b), split)


def extract_prompt(df: DataFrame) -> DataFrame:
    """Split off the shared start of chosen and rejected as the prompt: of texts, or of
    conversations their shared messages. Rows that have a prompt stay as they are."""
    if "prompt" in df.columns:
        return df
    rest = [c for c in df.columns if c not in ("chosen", "rejected")]
    form = extract_prompt_messages if is_conversational(df.schema["chosen"].dataType) else split_prompt
    parts = df.select(*rest, form(F.col("chosen"), F.col("rejected")).alias("_p"))
    return parts.select(*rest, "_p.*")


def extract_prompt_messages(chosen: Column, rejected: Column) -> Column:
    """The same for arrays of messages: (prompt, chosen, rejected)."""
    top = F.least(F.size(chosen), F.size(rejected))
    apart = F.array_position(
        F.transform(F.zip_with(F.slice(chosen, 1, top), F.slice(rejected, 1, top), lambda x, y: x == y), lambda e: e), F.lit(False)
    )
    n = F.when(apart > 0, apart - 1).otherwise(F.greatest(top - 1, F.lit(0))).cast("int")
    return F.struct(
        F.slice(chosen, F.lit(1), n).alias("prompt"),
        F.slice(chosen, n + 1, F.size(chosen)).alias("chosen"),
        F.slice(rejected, n + 1, F.size(rejected)).alias("rejected"),
    )


def unpair(df: DataFrame) -> DataFrame:
    """Each paired row becomes a wanted and an unwanted completion."""
    rest = [c for c in df.columns if c not in ("chosen", "rejected")]
    both = F.array(
        F.struct(F.col("chosen").alias("completion"), F.lit(True).alias("label")),
        F.struct(F.col("rejected").alias("completion"), F.lit(False).alias("label")),
    )
    return df.select(*rest, F.explode(both).alias("_p")).select(*rest, "_p.*")


def by_label(df: DataFrame, label: Column | str = "label") -> tuple[DataFrame, DataFrame]:
    """(wanted rows, unwanted rows); each is a filter that reaches the scan."""
    label = F.col(label) if isinstance(label, str) else label
    return df.filter(label), df.filter(~label)


def fitting_pairs(df: DataFrame, limit: int, a: str = "chosen", b: str = "rejected") -> DataFrame:
    """Keep pairs whose both sides have at most `limit` tokens."""
    return df.filter((F.size(a) <= limit) & (F.size(b) <= limit))


def pair_tokens(
    df: DataFrame, end, begin=None, max_prompt: int | None = None, max_completion: int | None = None,
    special: bool = False,
) -> DataFrame:
    """Token columns prompt, chosen, rejected: end token on both answers, the
    prompt's last and the answers' first tokens kept."""
    prompt = F.col("prompt")
    if special:
        if begin is not None:
            prompt = F.concat(F.array(F.lit(begin)), prompt)
        prompt = F.concat(prompt, F.array(F.lit(end)))
    ended = {c: keep_first(F.concat(c, F.array(F.lit(end))), max_completion) for c in ("chosen", "rejected")}
    return df.withColumns({"prompt": keep_last(prompt, max_prompt), **ended})


def prompts_agree(a: Column, b: Column) -> Column:
    """Prompt tokens of the two sides may differ in one token and one in length."""

    def check(sides: Column) -> Column:
        a, b = sides["a"], sides["b"]
        n = F.least(F.size(a), F.size(b))
        apart = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x != y)
        return (F.size(F.filter(apart, lambda v: v)) <= 1) & (F.abs(F.size(a) - F.size(b)) <= 1)

    return let(F.struct(a.alias("a"), b.alias("b")), check)


def checked_prompts(df: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose prompts agree, rows set aside)."""
    ok = F.coalesce(prompts_agree(F.col(a), F.col(b)), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def marked_pair(df: DataFrame, begin, end) -> DataFrame:
    """Begin token on the prompt and end token on the answers, where missing."""
    return df.withColumns(
        {"prompt": with_begin(F.col("prompt"), begin), "chosen": with_end(F.col("chosen"), end),
         "rejected": with_end(F.col("rejected"), end)}
    )


def truncated_pair(df: DataFrame, max_length: int, max_prompt: int, mode: str = "keep_end") -> DataFrame:
    """Prompt first, then the answers, are cut when prompt and longer answer
    exceed `max_length`."""
    longer = F.greatest(F.size("chosen"), F.size("rejected"))
    staged = df.withColumn("_longer", longer)
    too_long = F.size("prompt") + F.col("_longer") > max_length
    staged = staged.withColumn("prompt", F.when(too_long, truncate(F.col("prompt"), max_prompt, mode)).otherwise(F.col("prompt")))
    still = F.size("prompt") + F.col("_longer") > max_length
    cut = {
        c: F.when(still, F.slice(c, 1, max(max_length - max_prompt, 0))).otherwise(F.col(c)) for c in ("chosen", "rejected")
    }
    return staged.withColumns(cut).drop("_longer")


def pair_labels(df: DataFrame, ignore=fixed.IGNORE_LABEL) -> DataFrame:
    """Sequences and labels of both sides."""
    out = df
    for side in ("chosen", "rejected"):
        out = out.withColumn(f"{side}_labels", masked_labels(F.col("prompt"), F.col(side), ignore))
        out = out.withColumn(f"{side}_input_ids", F.concat("prompt", side))
    return out
