"""Recursive character splitting of one text: the per-row helper of chunking."""

from __future__ import annotations

from corpusloom.functions import fixed


def split_text(text: str, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP, separators=None) -> list[str]:
    """Overlapping chunks of at most `size` characters, cut at the coarsest
    separator there is. A separator stays at the start of the piece behind it.
    A run without any separator is kept whole, however long."""
    seps = list(fixed.CHUNK_SEPARATORS if separators is None else separators)
    at = next((i for i, s in enumerate(seps) if s in text), None)
    finer = [] if at is None else seps[at + 1 :]
    head, *tail = [text] if at is None else text.split(seps[at])
    out: list[str] = []
    small: list[str] = []
    for piece in filter(None, [head, *(seps[at] + t for t in tail)]):
        if len(piece) < size:
            small.append(piece)
            continue
        out += pack_pieces(small, size, overlap)
        small = []
        out += split_text(piece, size, overlap, finer) if finer else [piece]
    return out + pack_pieces(small, size, overlap)


def pack_pieces(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Join neighbouring pieces up to `size`; each chunk starts with the last
    pieces of the one before, up to `overlap` characters."""
    out = []
    first = total = 0
    for i, piece in enumerate(pieces):
        if total + len(piece) > size and i > first:
            out.append("".join(pieces[first:i]).strip())
            while total > overlap or (total and total + len(piece) > size):
                total -= len(pieces[first])
                first += 1
        total += len(piece)
    out.append("".join(pieces[first:]).strip())
    return [c for c in out if c]
