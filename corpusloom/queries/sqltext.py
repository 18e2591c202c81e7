"""Pieces of SQL that several checks share."""

from __future__ import annotations

from corpusloom.functions import fixed

# white space as a character class body for RE2 (no Unicode \s there)
SPACE = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def clean(e: str) -> str:
    out = f"coalesce({e}, '')"
    for wrong, right in fixed.TEXT_REPAIRS:
        out = f"replace({out}, {lit(wrong)}, {lit(right)})"
    out = f"regexp_replace(replace({out}, '|', ' '), '[{SPACE}]+', ' ', 'g')"
    return f"trim(regexp_replace({out}, ' ([.,;:!?])', '\\1', 'g'))"


def ellipsis(e: str, n: int) -> str:
    return f"CASE WHEN length({e}) > {n} THEN substring({e}, 1, {n}) || '...' ELSE {e} END"


def stem(e: str, n: int = 100) -> str:
    return f"substring(trim(regexp_replace({e}, '[^\\p{{L}}\\p{{N}} _-]', '', 'g')), 1, {n})"


def md5_number(e: str, digits: int = 7) -> str:
    return f"('0x' || substring(md5({e}), 1, {digits}))::BIGINT"


MESSAGES = "messages AS (SELECT conv_id AS session_id, turn, role, text AS content FROM conversations)"


def word_hash(rows: str, name: str = "enc", dim: int = 256) -> str:
    """CTEs `<name>_w` (id, d, w): unit vectors of `rows` (id, text), sparse."""
    return f"""
{name}_t AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS t FROM {rows}),
{name}_c AS (SELECT id, {md5_number('t')} % {dim} AS d, count(*)::DOUBLE AS c FROM {name}_t GROUP BY ALL),
{name}_n AS (SELECT id, sqrt(sum(c * c)) AS n FROM {name}_c GROUP BY id),
{name}_w AS (SELECT id, d, (c / n)::FLOAT::DOUBLE AS w FROM {name}_c JOIN {name}_n USING (id)),
{name}_l AS (SELECT id, sqrt(sum(w * w)) AS l FROM {name}_w GROUP BY id)"""
