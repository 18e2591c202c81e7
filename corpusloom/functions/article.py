"""Parts of an article in its text layout, each as a Column expression."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from corpusloom.functions import fixed
from corpusloom.functions.text import SPACE, clean_text, let, repaired, strip

_U = "(?U)"
_SPLIT, _NAME_END, _FAR, _TAKEN = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"  # Unicode noncharacters, never part of text


def _contains_any(c: Column, parts) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(c, F.lit(part))
    return out


def header_value(content: Column, mark: str, first_lines: int = 5) -> Column:
    lines = F.slice(F.split(content, "\n", first_lines + 1), 1, first_lines)
    hits = F.filter(lines, lambda line: F.startswith(line, F.lit(mark)))
    return F.coalesce(strip(F.replace(F.try_element_at(hits, F.lit(-1)), F.lit(mark), F.lit(""))), F.lit(""))


def metadata(content: Column, source: str, language: str = "vi") -> Column:
    return F.struct(
        header_value(content, fixed.TITLE_MARK).alias("title"),
        header_value(content, fixed.URL_MARK).alias("url"),
        F.lit(source).alias("source"),
        F.lit(language).alias("language"),
    )


def _person(block: Column, organisations) -> Column:
    """At most one name: the first line that is no degree, no organisation and
    of a plausible length."""
    lines = F.transform(F.split(block, "\n"), strip)
    names = F.filter(
        lines,
        lambda x: ~x.isin(fixed.DEGREES)
        & ~_contains_any(x, organisations)
        & (F.length(x) > 5)
        & (F.length(x) < 50)
        & F.rlike(x, F.lit(r"\p{L}")),
    )
    return F.transform(F.slice(names, 1, 1), lambda x: strip(F.rtrim(x, F.lit(","))))


def authors(content: Column) -> Column:
    block = F.regexp_extract(
        content,
        rf"(?sU){fixed.AUTHOR_LEAD}{SPACE}+(.*?)(?={fixed.REVIEWER_LEAD}|{fixed.REVIEWED})",
        1,
    )
    return _person(block, fixed.AUTHOR_ORGANISATIONS)


def reviewers(content: Column) -> Column:
    block = F.regexp_extract(
        content, rf"(?sU){fixed.REVIEWER_LEAD}{SPACE}+(.*?)(?={fixed.REVIEWED})", 1
    )
    return _person(block, fixed.REVIEWER_ORGANISATIONS)


def after_body_mark(content: Column) -> Column:
    """Text behind the body mark; NULL when there is no mark."""
    at = F.instr(content, fixed.BODY_MARK)
    return F.when(at > 0, F.substr(content, at + F.lit(len(fixed.BODY_MARK))))


def after_revision(body: Column) -> Column:
    """Text behind the revision line; NULL when there is none."""

    def behind_version(tail: Column) -> Column:
        version = F.regexp_extract(tail, r"(?sU)\A.*?v\d+_vi", 0)
        return let(version, lambda v: F.when(F.length(v) > 0, F.substr(tail, F.length(v) + 1)))

    def behind_lead(b: Column) -> Column:
        at = F.instr(b, fixed.REVISION_LEAD)
        return let(F.when(at > 0, F.substr(b, at + F.lit(len(fixed.REVISION_LEAD)))), behind_version)

    return let(body, behind_lead)


_INLINE = r"[\s\x1c-\x1f&&[^\n]]"
_WORD_IN_LINE = f".*?(?:{'|'.join(map(re.escape, fixed.HEADER_WORDS))})"
# up to the first character of the first line that has text and no header word
_TO_FIRST_LINE = rf"(?dmU)\A(?s:.*?)^(?={_INLINE}*+[^\s\x1c-\x1f])(?!{_WORD_IN_LINE})."
_LINE_END = rf"(?U)(?={SPACE})(?<!{SPACE}){_INLINE}*+\n{SPACE}*+"


def after_header_lines(body: Column) -> Column:
    """Lines from the first one without a header word on, joined by a space. Only lines
    up to that one are looked at one by one."""

    def from_first(b: Column) -> Column:
        lines = lambda to: F.regexp_replace(strip(F.substr(b, F.length(to))), _LINE_END, " ")
        return let(F.regexp_extract(b, _TO_FIRST_LINE, 0), lambda to: F.when(F.length(to) > 0, lines(to)).otherwise(""))

    return let(body, from_first)


def before_footer(body: Column) -> Column:
    """Cut at the first footer text, in list order, that occurs at all."""

    def cut(b: Column) -> Column:
        cuts = [
            F.when(F.contains(b, F.lit(mark)), F.substr(b, F.lit(1), F.instr(b, mark) - F.lit(1))) for mark in fixed.FOOTERS
        ]
        return F.coalesce(*cuts, b)

    return let(body, cut)


def main_content(content: Column) -> Column:
    """The cleaned body; a text without the body mark is passed on as it is."""

    def body_text(body: Column) -> Column:
        main = F.coalesce(after_revision(body), after_header_lines(body))
        return F.when(body.isNotNull(), clean_text(before_footer(main)))

    return F.coalesce(let(after_body_mark(content), body_text), content)


def references(content: Column, limit: int = 10) -> Column:
    groups = F.regexp_extract_all(content, F.lit(rf"{_U}\({fixed.REFERENCE_LEAD}{SPACE}+([^)]+)\)"), F.lit(1))
    parts = F.flatten(
        F.transform(groups, lambda g: F.split(g, rf"{_U}{SPACE}+và{SPACE}+(?:xem{SPACE}+)?"))
    )
    parts = F.transform(parts, lambda p: F.trim(p, F.lit(". ")))
    kept = F.filter(
        parts,
        lambda p: (F.length(p) > 20) & (F.length(p) < 150) & ~_contains_any(p, fixed.REFERENCE_STOPS),
    )
    return F.slice(F.array_distinct(F.transform(kept, lambda x: clean_text(x))), 1, limit)


def _names() -> str:
    return "|".join(re.escape(head) for head in sorted(fixed.SECTION_HEADERS, key=len, reverse=True))


def _section_start() -> str:
    """Where a section's text starts: behind a header between pipes, or behind a
    header, white space and before a capital, unless another header follows
    within 50 characters. Every alternative has its header as a group."""
    heads = sorted(fixed.SECTION_HEADERS, key=len, reverse=True)
    starts = [rf"({_names()})(?<=(?:\|{SPACE}{{0,100}}|{_FAR})(?:{_names()})){SPACE}*\|"]
    for head in heads:
        others = "|".join(f".{{0,{50 - len(other)}}}{re.escape(other)}" for other in heads if other != head)
        starts.append(f"({re.escape(head)}){SPACE}+(?=[{fixed.SECTION_CAPITALS}])(?!{others})")
    initials = "".join(sorted({head[0] for head in heads}))  # a quick test before the alternatives
    return f"(?sU)(?=[{initials}])(?:{'|'.join(starts)})"


_START = _section_start()
_HEADER = "".join(f"${i}" for i in range(1, len(fixed.SECTION_HEADERS) + 2))  # one of them is set
# a left pipe and more white space before a header than a look-behind can span
_WIDE_GAP = rf"(?U)\|{SPACE}{{100,}}+(?=(?:{_names()}))"
# a header between pipes and the same one behind it: its left pipe is taken
_TAKEN_PIPE = rf"(?U)(\|{SPACE}*+({_names()}){SPACE}*+\|{SPACE}*+)(?=\2{SPACE}*+\|)"


def section_entries(content: Column, cleaned: Column | None = None) -> Column:
    """All sections as (header, text), in text order, bad lengths left out. Headers
    whose left pipe is far away, or taken by the same header before, get a mark that
    does not count as text. Where `cleaned` says that the content went through clean_text,
    its parts need only repairs, and no white space is looked for again."""

    def piped(c: Column) -> Column:
        taken = F.regexp_replace(c, _TAKEN_PIPE, f"$1{_TAKEN}")
        return F.when(F.contains(c, F.lit("|")), F.regexp_replace(taken, _WIDE_GAP, f"$0{_FAR}")).otherwise(c)

    def entries(marked: Column) -> Column:
        marks = F.contains(marked, F.lit(_FAR)) | F.contains(marked, F.lit(_TAKEN))
        text = F.when(marks, F.translate(marked, _FAR + _TAKEN, "")).otherwise(marked)
        pieces = F.slice(F.split(text, _SPLIT), 2, 1 << 30)
        found = F.transform(
            pieces,
            lambda piece: F.struct(
                F.substring_index(piece, _NAME_END, 1).alias("header"),
                F.ltrim(strip(F.substring_index(piece, _NAME_END, -1)), F.lit("| \n\t")).alias("text"),
            ),
        )
        kept = F.filter(found, lambda e: (F.length(e["text"]) > 50) & (F.length(e["text"]) < 20000))

        def with_text(use) -> Column:
            return F.transform(kept, lambda e: F.struct(e["header"].alias("header"), use(e["text"]).alias("text")))

        if cleaned is None:
            return with_text(clean_text)
        return F.when(cleaned & ~marks, with_text(lambda t: F.trim(repaired(t)))).otherwise(with_text(clean_text))

    return let(F.regexp_replace(let(content, piped), _START, f"$0{_SPLIT}{_HEADER}{_NAME_END}"), entries)


def section_map(entries: Column) -> Column:
    """Header -> text; a repeated header keeps its first place and last text."""

    def build(rows: Column) -> Column:
        heads = F.array_distinct(F.transform(rows, lambda e: e["header"]))
        texts = F.transform(
            heads, lambda h: F.element_at(F.filter(rows, lambda e: e["header"] == h), -1)["text"]
        )
        return F.map_from_arrays(heads, texts)

    return let(entries, build)
