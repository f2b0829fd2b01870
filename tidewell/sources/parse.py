"""Parsing texts into blocks, and planning chunks: sequential per document, so Arrow-batched Python.

Both are stated as data over the whole text instead of a walk with state.  Lines get a kind; runs of kinds are blocks;
sections are a fold over the headings.  A chunk's end is looked up among the sorted offsets at which a chunk may end.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalar import ENTITIES


class Block(NamedTuple):
    type: str
    start: int
    end: int
    section: str
    level: int
    text: str


#: Line patterns of Markdown in the order in which they are tried, what HTML elements are, and the marks
#: after which a chunk may end, the best first.
_LINES = {
    "heading": r"^\s{0,3}#{1,6}\s+",
    "list_item": r"^\s*(?:[-*+]\s+|\d+[.)]\s+)",
    "table_row": r"^\s*\|.*\|\s*$",
    "footnote": r"^\s*\[\^.*\]:",
    "caption": r"!\[[^\]]*\]\([^)]+\)",
    "citation": r"\[[^\]]+\]\([^)]+\)",
}
_ELEMENTS = {"li": "list_item", "pre": "code", "code": "code", "table": "table", "tr": "table", "caption": "caption", "figcaption": "caption", "footer": "footnote", "blockquote": "citation"}
_ELEMENT = re.compile(r"<(h[1-6]|p|li|pre|code|table|tr|caption|figcaption|blockquote|aside|footer)[^>]*>[\s\S]*?</\1\s*>", re.I)
_MARKS = "\n.; "
_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_KINDS = {k: re.compile(p) for k, p in _LINES.items()}


def decode_html(s: str) -> str:
    for a, b in ENTITIES.items():
        s = s.replace(a, b)
    return re.sub("<[^>]*>", " ", s).strip()


def section_paths(headings: list[tuple[int, str]]) -> list[str]:
    """For each block, given as (level, label) with level 0 for what is no heading, the path of headings it lies under."""

    def under(path: dict[int, str], heading: tuple[int, str]) -> dict[int, str]:
        level, label = heading
        return {**{k: v for k, v in path.items() if k < level}, level: label} if level else path

    paths = itertools.accumulate(headings, under, initial={})
    return [" > ".join(v for _, v in sorted(p.items()) if v) for p in itertools.islice(paths, 1, None)]


def _line_kind(line: str) -> str:
    return next((k for k, p in _KINDS.items() if p.search(line)), "paragraph")


def parse_lines(text: str, markdown: bool) -> list[Block]:
    """Paragraphs; in Markdown also headings, list items, table rows, footnotes, captions, citations and fenced code.

    A fence without an end holds its own line only; what follows it is read as a text of its own, without sections above.
    """
    lines = [m.span() for m in _LINE.finditer(text)]
    bare = [text[a:b].strip() for a, b in lines]
    fences = [k for k, line in enumerate(bare) if line.startswith("```")] if markdown else []
    if len(fences) % 2:
        fences.append(fences[-1])
    code = {k: first for first, last in zip(fences[::2], fences[1::2]) for k in range(first, last + 1)}
    # lines of one block share a number: a fence's first line, a paragraph's run, or the line itself
    kinds = ["code" if k in code else "" if not line else _line_kind(text[slice(*lines[k])]) if markdown else "paragraph" for k, line in enumerate(bare)]
    fresh = [kinds[k] != "paragraph" or k == 0 or kinds[k - 1] != "paragraph" for k in range(len(lines))]
    starts = itertools.accumulate(range(len(lines)), lambda held, k: code.get(k, k if fresh[k] else held))
    rows = []
    for _, run in itertools.groupby((x for x in zip(starts, range(len(lines))) if kinds[x[1]]), key=lambda x: x[0]):
        own = [k for _, k in run]
        kind, a, b = kinds[own[0]], lines[own[0]][0], lines[own[-1]][1]
        level = len(bare[own[0]]) - len(bare[own[0]].lstrip("#")) if kind == "heading" else 0
        rows.append((kind, a, b, level, bare[own[0]][level:].strip() if level else "", own[0]))
    open_fence = fences[-1] if len(fences) > 1 and fences[-1] == fences[-2] else len(lines)
    paths = [p for part in (True, False) for p in section_paths([(r[3], r[4]) for r in rows if (r[5] <= open_fence) is part])]
    return [Block(kind, a, b, path, level, text[a:b]) for (kind, a, b, level, _, _), path in zip(rows, paths)]


def parse_html(text: str) -> list[Block]:
    """Block elements with their text; without any, the page's text as paragraphs."""
    found = [(m, m[1].lower(), decode_html(m[0])) for m in _ELEMENT.finditer(text)]
    levels = [int(tag[1]) if tag[0] == "h" else 0 for _, tag, _ in found]
    paths = section_paths(list(zip(levels, (body for *_, body in found))))
    kinds = ["heading" if level else _ELEMENTS.get(tag, "paragraph") for level, (_, tag, _) in zip(levels, found)]
    out = [Block(kind, *m.span(), path, level, body) for kind, level, path, (m, _, body) in zip(kinds, levels, paths, found) if body]
    return out or parse_lines(decode_html(text), False)


def parse(text: str, kind: str) -> list[Block]:
    return parse_html(text) if kind == "html" else parse_lines(text, kind == "markdown")


class Chunk(NamedTuple):
    start: int
    end: int
    section: str
    parser: str


class Ends:
    """Where chunks of a text may end: for each mark the ascending offsets of its occurrences."""

    def __init__(self, text: str, marks: str = _MARKS):
        self.size = len(text)
        letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = [np.flatnonzero(letters == ord(m)).tolist() for m in marks]

    def last(self, low: int, high: int) -> int | None:
        """The last occurrence in [low, high] of the first mark that has one."""
        for at in self.at:
            k = bisect.bisect_right(at, high) - 1
            if k >= 0 and at[k] >= low:
                return at[k]
        return None


def windows(start: int, end: int, size: int, overlap: int, cut: Callable[[int, int], int]) -> Iterator[tuple[int, int]]:
    """Overlapping stretches from ``start`` to ``end``; ``cut(a, b)`` moves the end of one that would be [a, b)."""
    a, b = start, None
    while b is None or b < end:
        b = min(end, cut(a, min(end, a + size)))
        yield a, b
        a = b if b <= overlap else max(b - overlap, a + 1)


def fast_chunks(text: str, target: int = 1600, overlap: int = 200) -> Iterator[Chunk]:
    """Windows of ``target`` characters that end at the last space over 80 characters in, overlapping."""
    ends = Ends(text, " ")

    def cut(a: int, b: int) -> int:
        space = ends.last(a + 81, b) if b < len(text) else None
        return b if space is None else space

    return (Chunk(a, b, "", "fast-v1") for a, b in windows(0, len(text), target, overlap, cut) if b > a)


def block_chunks(text: str, blocks: list[Block], mode: str = "structured", target: int = 1600, most: int = 2400, least: int = 160, overlap: int = 200) -> list[Chunk]:
    """Blocks gathered up to ``target``: a heading begins a chunk, tables and code end one, larger blocks are split, a small tail is joined."""
    ends = Ends(text)

    def cut(a: int, b: int) -> int:
        mark = ends.last(a + least - 1, b) if b < len(text) else None
        return b if mark is None else mark + 1

    large = [b.end - b.start > most for b in blocks]

    def group(head: int, k: int) -> int:
        """The first block of the chunk that block k falls into, given that of the block before."""
        own, prev = blocks[k], blocks[k - 1]
        full = prev.end - blocks[head].start >= target or prev.type in ("table", "code") or large[k - 1]
        return k if full or large[k] or own.type == "heading" or own.end - blocks[head].start > target else head

    heads = list(itertools.accumulate(range(1, len(blocks)), group, initial=0)) if blocks else []
    out: list[Chunk] = []
    for head, members in itertools.groupby(range(len(blocks)), key=heads.__getitem__):
        first, last = blocks[head], blocks[max(members)]
        spans = windows(first.start, first.end, most, overlap, cut) if large[head] else [(first.start, last.end)]
        out += [Chunk(a, b, first.section, f"{mode}-{'dense' if large[head] else 'adaptive'}-v1") for a, b in spans]
    if len(out) > 1 and out[-1].end - out[-1].start < least:
        out[-2:] = [out[-2]._replace(end=out[-1].end)]
    return out


#: Characters of text and of results that are held as Python objects at once, and rows of a result.
_HELD_CHARS, _HELD_ROWS = 1 << 20, 4096


def _in_parts(plan: Callable[[str], Iterator[tuple]], fields: list[pa.Field], weight: Callable[[tuple], int]) -> Callable:
    """A function of batches (id, text) that gives the rows (id, n, *values) of each text in parts of bounded size."""

    def run(batches):
        for batch in batches:
            kinds = [batch.schema.field(0).type, *[f.type for f in fields]]
            names = ["id", *[f.name for f in fields]]

            def made(rows: list[tuple], kinds=kinds, names=names):
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

            rows, held = [], 0
            for i, text in zip(batch.column(0), batch.column(1)):  # one text at a time becomes a Python object
                key = i.as_py()
                for n, values in enumerate(plan(text.as_py())):
                    rows.append((key, n, *values))
                    held += weight(values)
                    if held >= _HELD_CHARS or len(rows) >= _HELD_ROWS:
                        yield made(rows)
                        rows, held = [], 0
            if rows:
                yield made(rows)

    return run


def parse_blocks(docs: DataFrame, id: str, text: str, kind: str = "markdown", with_text: bool = True) -> DataFrame:  # noqa: A002
    """(id, n, type, start, end, section, level, text), a row for each block; nulls give none. Without ``with_text`` texts stay away."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where("text is not null")
    fields = [pa.field("n", pa.int32()), pa.field("type", pa.string()), pa.field("start", pa.int32()), pa.field("end", pa.int32()), pa.field("section", pa.string()), pa.field("level", pa.int32())]
    fields += [pa.field("text", pa.string())] if with_text else []
    run = _in_parts(lambda t: (b if with_text else b[:-1] for b in parse(t, kind)), fields, lambda b: len(b[3]) + (len(b[5]) if with_text else 0))
    kind_of = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind_of}, n int, type string, start int, end int, section string, level int{', text string' * with_text}").withColumnRenamed("id", id)


def chunk(docs: DataFrame, id: str, text: str, mode: str = "fast", kind: str = "markdown", with_text: bool = True, **limits: int) -> DataFrame:  # noqa: A002
    """(id, n, start, end, section, parser, text), a row for each chunk; modes fast, structured and semantic. Without ``with_text`` texts stay away."""
    if mode not in ("fast", "structured", "semantic"):
        raise ValueError("mode must be fast, structured or semantic")
    target, least, most = limits.get("target", 1600), limits.get("least", 160), limits.get("most", 2400)
    if target < 80 or (mode != "fast" and (most < target or least > target)):
        raise ValueError("invalid chunk sizes")
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where("text is not null")

    def plan(t: str) -> Iterator[tuple]:
        chunks = fast_chunks(t, **limits) if mode == "fast" else block_chunks(t, parse(t, kind), mode, **limits)
        return ((*c, t[c.start : c.end]) if with_text else tuple(c) for c in chunks)

    fields = [pa.field("n", pa.int32()), pa.field("start", pa.int32()), pa.field("end", pa.int32()), pa.field("section", pa.string()), pa.field("parser", pa.string())]
    fields += [pa.field("text", pa.string())] if with_text else []
    run = _in_parts(plan, fields, lambda c: len(c[2]) + (len(c[4]) if with_text else 0))
    kind_of = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind_of}, n int, start int, end int, section string, parser string{', text string' * with_text}").withColumnRenamed("id", id)
