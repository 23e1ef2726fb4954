"""Many strings in one text: a dictionary automaton per text reads it once, whatever the number of strings.

Arrow functions over (text, entities) columns. Time is linear in the text, the dictionary and the occurrences; choosing among
overlapping occurrences marks characters instead of comparing pairs. Offsets are code points, ends are exclusive."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import Points, is_alnum, slices, text_bytes

SPANS = "array<struct<start:int,end:int,label:string>>"
Span = tuple[int, int, "str | None"]


@lru_cache(1 << 14)
def _kind(c: str) -> str:
    """L for letters, N for numbers, _ for the low line, else nothing."""
    k = unicodedata.category(c)[0]
    return k if k in "LN" else "_" if c == "_" else ""


def occurrences(text: str, needles: set[str]) -> dict[str, list[int]]:
    """Starts of the occurrences of every needle, from the left; those of one needle don't overlap."""
    import ahocorasick

    if not needles or not text:
        return {}
    automaton = ahocorasick.Automaton()
    for n in needles:
        automaton.add_word(n, n)
    automaton.make_automaton()
    found: dict[str, list[int]] = {}
    free: dict[str, int] = {}
    for last, n in automaton.iter(text):
        start = last + 1 - len(n)
        if start >= free.get(n, 0):
            found.setdefault(n, []).append(start)
            free[n] = last + 1
    return found


def located(text: str, entities: list[tuple[str, str | None]]) -> list[Span]:
    """All occurrences of all entities, by entity, then from the left."""
    found = occurrences(text, {e for e, _ in entities})
    return [(s, s + len(e), label) for e, label in entities for s in found.get(e, ())]


def longest_free(n: int, spans: list[Span], taken: list[Span]) -> list[Span]:
    """`taken` and those spans that overlap nothing chosen before: the longest first, then the leftmost; in order of place."""
    used, out = bytearray(n), list(taken)
    for start, end, _ in taken:
        a, b = max(start, 0), min(end, n)
        if a < b:
            used[a:b] = b"\x01" * (b - a)
    for start, end, label in sorted(spans, key=lambda s: (s[0] - s[1], s[0], s[1], s[2] is None, s[2] or "")):
        if used.find(1, start, end) < 0:
            used[start:end] = b"\x01" * (end - start)
            out.append((start, end, label))
    return sorted(out, key=lambda s: (s[0], s[1], s[2] is None, s[2] or ""))


def not_in_ascii_word(text: str, span: Span) -> bool:
    """Neither end lies inside a word that goes on over an ASCII character of the span."""
    start, end, _ = span
    left = start > 0 and text[start].isascii() and _kind(text[start - 1]) in ("L", "N")
    right = end < len(text) and text[end - 1].isascii() and _kind(text[end]) in ("L", "N")
    return not (left or right)


def whole_word(text: str, span: Span) -> bool:
    start, end, _ = span
    return not (start > 0 and _kind(text[start - 1])) and not (end < len(text) and _kind(text[end]))


def _rows(column: pa.Array, fields: list[str]) -> list[list[tuple] | None]:
    """Lists of tuples of an array of lists of structs."""
    flat = column.flatten()
    values = list(zip(*(flat.field(f).to_pylist() for f in fields))) if len(flat) else []
    ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(column), 0).to_pylist()]).tolist()
    return [values[a:b] if ok else None for a, b, ok in zip(ends, ends[1:], column.is_valid().to_pylist())]


def _spans_array(rows: list[list[Span] | None]) -> pa.Array:
    ends = np.cumsum([0, *(len(r or ()) for r in rows)])
    flat = [s for r in rows for s in r or ()]
    each = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.int32()), pa.array([s[1] for s in flat], pa.int32()), pa.array([s[2] for s in flat], pa.string())], ["start", "end", "label"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each, mask=pa.array([r is None for r in rows], pa.bool_()))


def _arrow(column: pa.Array, lists: pa.Array, least: int, choose: Callable[[str, list[Span]], list[Span]]) -> Iterator[pa.Array]:
    """Spans of a batch, by slices of its texts: a text's spans take many times its own memory."""
    for texts, entities in slices(text_bytes(column), column, lists):
        out = []
        for text, own in zip(texts.to_pylist(), _rows(entities, ["text", "label"])):
            if text is None or own is None:
                out.append(None)
                continue
            trimmed = [(e.strip(" "), label) for e, label in own if e is not None]
            out.append(choose(text, located(text, [(e, label) for e, label in trimmed if len(e) >= max(least, 1)])))
        yield _spans_array(out)


def locate(text: Column, entities: Column, least: int) -> Column:
    """All occurrences of the (text, label) entities of `least` characters or more."""

    @F.arrow_udf(SPANS)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ents in batches:
            yield from _arrow(texts, ents, least, lambda text, spans: spans)

    return run(text, entities)


def _matches(texts: list[str | None], at: np.ndarray, entities: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and entity of all occurrences in the texts of a slice, by place of their ends; one entity per string, that
    with the first label."""
    import ahocorasick

    flat = entities.flatten()
    names, labels = [n.strip(" ") if n else "" for n in flat.field("text").to_pylist()], flat.field("label")
    rank = lambda i: (not labels[i].is_valid, labels[i].as_py() or "")
    size = np.array([len(n) for n in names], dtype="int64")
    ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(entities), 0).to_pylist()]).tolist()
    last, which = [np.zeros(0, "int64")], [np.zeros(0, "int64")]
    for text, a, b, base in zip(texts, ends, ends[1:], at.tolist()):
        own = dict(zip(names[a:b], range(a, b)))
        if len(own) < b - a:
            for i in range(a, b):
                if rank(i) < rank(own[names[i]]):
                    own[names[i]] = i
        own.pop("", None)
        if text and own:
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for name, i in own.items():
                automaton.add_word(name, i)
            automaton.make_automaton()
            found = np.fromiter(chain.from_iterable(automaton.iter(text)), "int64")
            last.append(found[::2] + base)
            which.append(found[1::2])
    end, entity = np.concatenate(last) + 1, np.concatenate(which)
    return end - size[entity], end, entity


def _without_own_overlaps(start: np.ndarray, end: np.ndarray, entity: np.ndarray) -> np.ndarray:
    """Which occurrences stay if those of one entity must not overlap, from the left (given by place of their ends)."""
    keep, order = np.ones(len(start), bool), np.argsort(entity, kind="stable")
    e, a, b = entity[order], start[order], end[order]
    close = (e[1:] == e[:-1]) & (a[1:] < b[:-1])
    free, before = 0, -1
    for k in np.flatnonzero(np.isin(e, e[1:][close])).tolist() if close.any() else ():
        free, before = (0 if e[k] != before else free), e[k]
        keep[order[k]] = a[k] >= free
        free = b[k] if a[k] >= free else free
    return keep


def _disjoint(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the spans, sorted by place, overlap nothing chosen before: the longest first, then the leftmost. Only spans that
    touch another one are looked at one by one."""
    reach = np.concatenate([[0], np.maximum.accumulate(end)[:-1]])
    keep = (start >= reach) & (end <= np.concatenate([start[1:], [n]]))
    rest = np.flatnonzero(~keep)
    used = bytearray(n if len(rest) else 0)
    for k in rest[np.lexsort((start[rest], (start - end)[rest]))].tolist():
        a, b = int(start[k]), int(end[k])
        if used.find(1, a, b) < 0:
            used[a:b] = b"\x01" * (b - a)
            keep[k] = True
    return keep


def _aligned(column: pa.Array, lists: pa.Array) -> Iterator[pa.Array]:
    """Alignment of a batch, by slices of its texts; occurrences are numbers, never Python objects."""
    given = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    for texts, entities in slices(text_bytes(column) + 16 * given, column, lists):
        p = Points(texts)
        start, end, entity = _matches(texts.to_pylist(), p.at, entities)
        alnum, ascii_ = is_alnum(p.codes), p.codes < 128  # a line feed stands behind each text, and so before the next
        inside = (start > 0) & ascii_[start] & alnum[start - 1] | ascii_[end - 1] & alnum[end]
        keep = np.flatnonzero(_without_own_overlaps(start, end, entity) & ~inside)
        keep = keep[np.lexsort((end[keep], start[keep]))]
        if len(keep):
            keep = keep[_disjoint(len(p.codes), start[keep], end[keep])]
        start, end, entity = start[keep], end[keep], entity[keep]
        ends = np.searchsorted(start, p.at)
        base = np.repeat(p.at[:-1], np.diff(ends))
        labels = entities.flatten().field("label").take(pa.array(entity)).cast(pa.string())
        each = pa.StructArray.from_arrays([pa.array(start - base, pa.int32()), pa.array(end - base, pa.int32()), labels], ["start", "end", "label"])
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each, mask=pc.or_(pc.is_null(texts), pc.is_null(entities)))


def align(text: Column, entities: Column) -> Column:
    """Disjoint occurrences, longest first, that don't end inside an ASCII word; entities that come twice count once."""

    @F.arrow_udf(SPANS)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ents in batches:
            yield from _aligned(texts, ents)

    return run(text, entities)


def name_words(text: str) -> list[str]:
    """Words of two characters or more that begin with a capital letter."""
    words = "".join(c if _kind(c) else " " for c in text).split()
    return [w for w in words if len(w) > 1 and unicodedata.category(w[0]) == "Lu"]


def propagated(text: str, spans: list[Span], names: tuple[str, ...], least: int) -> list[Span]:
    """The spans, and other whole-word occurrences of their texts, and of the single words of those that are names."""
    values = [(text[max(a, 0):max(b, 0)], label) for a, b, label in spans]
    values += [(w, label) for v, label in values if label in names for w in name_words(v)]
    wanted = [(e, label) for e, label in dict.fromkeys((v.strip(" "), label) for v, label in values) if len(e) >= least]
    return longest_free(len(text), [s for s in located(text, wanted) if whole_word(text, s)], spans)


def propagate(text: Column, spans: Column, names: tuple[str, ...], least: int = 2) -> Column:
    @F.arrow_udf(SPANS)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, given in batches:
            for texts, spans in slices(text_bytes(column), column, given):
                yield _spans_array([None if t is None or own is None else propagated(t, own, names, least)
                                    for t, own in zip(texts.to_pylist(), _rows(spans, ["start", "end", "label"]))])

    return run(text, spans)
