"""Text cleaning, cutting and naming as Column expressions (no Python workers),
plus the one normalisation Spark has no built-in for."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from corpusloom.functions import fixed

# Unicode white space including the four ASCII separators U+001C..U+001F.
SPACE = r"[\s\x1c-\x1f]"
# the same, character by character
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` evaluated once, also where the optimizer merges
    projections or moves a filter below one."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def strip(c: Column | str) -> Column:
    """Remove Unicode white space at both ends."""
    return F.trim(_col(c), F.lit(_SPACES))


def repaired(c: Column | str, repairs=fixed.TEXT_REPAIRS) -> Column:
    """Known broken words replaced. Looking for one is cheaper than replacing, and few
    texts have any."""

    def replaced(out: Column) -> Column:
        found = F.lit(False)
        for wrong, _ in repairs:
            found = found | F.contains(out, F.lit(wrong))
        new = out
        for wrong, right in repairs:
            new = F.replace(new, F.lit(wrong), F.lit(right))
        return F.when(found, new).otherwise(out)

    return let(_col(c), replaced)


def clean_text(c: Column | str, repairs=fixed.TEXT_REPAIRS) -> Column:
    """Repair known broken words, turn pipes into spaces, squeeze white space,
    drop it before punctuation and trim. NULL gives ''."""
    out = repaired(F.coalesce(_col(c), F.lit("")), repairs)
    # pipes, and runs of white space that are not one plain space already
    out = F.regexp_replace(out, r"(?U)[\s\x1c-\x1f|](?:[\s\x1c-\x1f|]++|(?<! ))", " ")
    return F.trim(F.regexp_replace(out, " ([.,;:!?])", "$1"))


def ellipsis(c: Column | str, n: int) -> Column:
    """First n characters and '...' when longer than n, else unchanged."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def always_ellipsis(c: Column | str, n: int) -> Column:
    return F.concat(F.substring(_col(c), 1, n), F.lit("..."))


def cut(c: Column | str, n: int) -> Column:
    return F.substring(_col(c), 1, n)


def safe_stem(c: Column | str, n: int = 100) -> Column:
    """File stem of a title: letters, digits, space, '-' and '_'. The cut comes
    after the trim, so a space can end the stem."""
    return F.substring(F.trim(F.regexp_replace(_col(c), r"[^\p{L}\p{N} _-]", "")), 1, n)


def document_id(file_name: Column | str) -> Column:
    """Id of an article file from its (URL-encoded) name."""
    name = F.url_decode(F.replace(_col(file_name), F.lit("+"), F.lit("%2B")))
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")
    return F.replace(F.replace(F.lower(stem), F.lit(" "), F.lit("_")), F.lit(","), F.lit(""))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC of the stripped text; Spark has no built-in for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x.strip()))


def words(c: Column | str) -> Column:
    """White-space words; no empty ones."""
    return F.filter(F.split(_col(c), rf"(?U){SPACE}+"), lambda w: w != "")
