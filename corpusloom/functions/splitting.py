"""Per-document splitting on character offsets.

Pieces of a text are contiguous, so a run of them is an ascending list of offsets and a chunk is
a pair of offsets: windows are found by binary search, and no piece is copied before it is final.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

from corpusloom import constants as C

_FENCED = re.compile(C.FENCE_PATTERN)
_SECTION = re.compile(C.API_SECTION_PATTERN, re.DOTALL)

Span = tuple[int, int]


def _windows(cuts: Sequence[int], size: int, overlap: int) -> Iterator[Span]:
    """Widest windows of at most ``size`` over a run of pieces. The next window starts at the
    first piece that keeps the overlap within bounds and leaves room for the piece to come."""
    first, end = 0, len(cuts) - 1
    while True:
        last = bisect_right(cuts, cuts[first] + size) - 1
        yield cuts[first], cuts[last]
        if last == end:
            return
        first = bisect_left(cuts, max(cuts[last] - overlap, cuts[last + 1] - size))


def _cuts(text: str, lo: int, hi: int, separator: str) -> Sequence[int]:
    """Piece starts (a separator opens the piece that follows it), closed by ``hi``."""
    if not separator:
        return range(lo, hi + 1)
    cuts, at, step = [lo], text.find(separator, lo, hi), len(separator)
    while at >= 0:
        if at > lo:
            cuts.append(at)
        at = text.find(separator, at + step, hi)
    cuts.append(hi)
    return cuts


def split_spans(
    text: str, size: int, overlap: int, separators: Sequence[str], lo: int = 0, hi: int | None = None
) -> Iterator[Span]:
    """Chunk spans of a text: cut at the coarsest separator present, go finer in long pieces."""
    hi = len(text) if hi is None else hi
    level = next(i for i, s in enumerate(separators) if not s or text.find(s, lo, hi) >= 0)
    finer = separators[level + 1 :]
    cuts = _cuts(text, lo, hi, separators[level])
    if isinstance(cuts, range) and size > 1:
        yield from _windows(cuts, size, overlap)
        return
    run = [lo]
    for start, stop in zip(cuts, cuts[1:]):
        if stop - start < size:
            run.append(stop)
            continue
        if len(run) > 1:
            yield from _windows(run, size, overlap)
        if finer:
            yield from split_spans(text, size, overlap, finer, start, stop)
        else:
            yield start, stop
        run = [stop]
    if len(run) > 1:
        yield from _windows(run, size, overlap)


def split_text(
    text: str, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP, separators: Sequence[str] = C.TEXT_SEPARATORS
) -> list[str]:
    if not text:
        return []
    pieces = (text[a:b].strip() for a, b in split_spans(text, size, overlap, separators))
    return [p for p in pieces if p]


def code_and_text(text: str) -> Iterator[tuple[str, str]]:
    """Code fences and the text between them. Blank text is not a part of its own: it stays in
    front of the text that follows. An unclosed fence right after a fence counts as code."""
    held, at = "", 0
    for fence in _FENCED.finditer(text):
        held += text[at : fence.start()]
        if held.strip():
            yield "text", held
            held = ""
        yield "code", fence.group()
        at = fence.end()
    tail = text[at:]
    if tail.startswith(C.FENCE):
        if held.strip():
            yield "text", held
            held = ""
        yield "code", tail
    else:
        held += tail
    if held.strip():
        yield "text", held


def api_sections(text: str) -> Iterator[str]:
    """Sections headed by ``###`` and the non-blank gaps between them."""
    at = 0
    for section in _SECTION.finditer(text):
        for part in (text[at : section.start()], section.group()):
            if part.strip():
                yield part
        at = section.end()
    if text[at:].strip():
        yield text[at:]


def pieces(text: str, kind: str | None, size: int, overlap: int) -> Iterator[tuple[str, str]]:
    """(chunk type, unstripped chunk) of one document, in order."""
    if kind == "api_reference":
        for section in api_sections(text):
            whole = len(section) <= size
            for part in [section] if whole else split_text(section, size, overlap):
                yield "api_reference", part
    elif C.FENCE in text:
        for what, part in code_and_text(text):
            if what == "code" and len(part) <= size:
                yield what, part
                continue
            separators = C.CODE_SEPARATORS if what == "code" else C.TEXT_SEPARATORS
            for p in split_text(part, size, overlap, separators):
                yield what, p
    else:
        for p in split_text(text, size, overlap):
            yield "text", p
