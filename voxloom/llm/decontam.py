"""Benchmark decontamination by pigeonhole edit matching.

A test item of m words may occur with at most e = floor(rate * m) word edits. Cut into e + 1 pieces, at
least one piece then occurs unchanged (the pigeonhole principle). One Aho-Corasick automaton finds all
piece hits in a document's words in a single pass; around each hit, Myers' bit-parallel algorithm (one
integer as a column of the edit matrix, words as its alphabet) verifies the whole item. Words are runs of
letters, digits and underscores, lower-cased, so layout and punctuation don't matter.

The documents stay where they are: no shuffle. The items are broadcast in blocks of at most
``BLOCK_CHARS`` characters; a larger benchmark takes more passes over the documents, each a job of its own
whose broadcast is freed before the next, and not more memory.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, windows

RATE = 0.2
BLOCK_CHARS = 16_000_000
#: Bytes of text searched at a time.
WINDOW_BYTES = 4_000_000
HIT = "item_id long, edits int, first_word int, n_words int, occurrences int"
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def budget(m: int, rate: float = RATE) -> int:
    return int(m * rate + 1e-9)


def pieces(m: int, e: int) -> list[tuple[int, int]]:
    """Word ranges of e + 1 pieces of nearly equal length."""
    return [(m * i // (e + 1), m * (i + 1) // (e + 1)) for i in range(e + 1)]


def myers(pattern: dict[str, int], m: int, text: list[str], anchored: bool = False) -> list[int]:
    """Word edit distance of an m-word pattern to the best match that ends at each word of ``text``.

    ``pattern`` has a bit set of positions for each word. ``anchored``: the match must begin at the text's
    first word; otherwise anywhere.
    """
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = mask, 0, m, []
    for w in text:
        eq = pattern.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) | anchored
        mh <<= 1
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv & mask
        out.append(score)
    return out


def positions(words: list[str]) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, w in enumerate(words):
        bits[w] = bits.get(w, 0) | 1 << i
    return bits


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            e, k = budget(len(words), rate), len(self.items)
            self.items.append((item_id, len(words), e, positions(words), positions(words[::-1])))
            for a, b in pieces(len(words), e):
                found.setdefault(f" {' '.join(words[a:b])} ", []).append((k, a))
        self.auto = ahocorasick.Automaton()
        for piece, at in found.items():
            self.auto.add_word(piece, (len(piece), at))
        if found:
            self.auto.make_automaton()

    def hits(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item_id, edits, first word, words, occurrences) of the best match of each item found, by item."""
        words = words_of(text)
        if not words or not self.items:
            return []
        joined = f" {' '.join(words)} "
        starts: dict[int, int] | None = None
        found: dict[int, Found] = {}
        seen: set[tuple[int, int]] = set()
        for end, (length, at) in self.auto.iter(joined):
            if starts is None:
                starts, pos = {}, 0
                for i, w in enumerate(words):
                    starts[pos] = i
                    pos += len(w) + 1
            q = starts[end - length + 1]
            for k, offset in at:
                if (k, q - offset) not in seen:
                    seen.add((k, q - offset))
                    self.verify(words, k, q - offset, found)
        return [(self.items[k][0], f.edits, f.first, f.stop - f.first, f.times) for k, f in sorted(found.items())]

    def verify(self, words: list[str], k: int, begin: int, found: dict[int, Found]) -> None:
        _, m, e, forward, backward = self.items[k]
        f = found.get(k)
        if f and f.holds(begin, e):
            return
        low = max(0, begin - e)
        scores = myers(forward, m, words[low : begin + m + e])
        edits = min(scores, default=m)
        if edits > e:
            return
        stop = low + scores.index(edits) + 1
        back = myers(backward, m, words[max(0, stop - m - e) : stop][::-1], anchored=True)
        first = stop - back.index(edits) - 1 if edits in back else low
        if not f:
            f = found[k] = Found()
        f.add(begin, e, edits, first, stop)


class Found:
    """The occurrences of one item in one text, with the best of them; a place is looked up in constant time."""

    def __init__(self) -> None:
        self.places: dict[int, list[int]] = {}  # begins by begin // (e + 1)
        self.times, self.edits, self.first, self.stop = 0, 1 << 30, 0, 0

    def holds(self, begin: int, e: int) -> bool:
        """Whether an occurrence begins at most ``e`` words away."""
        at = begin // (e + 1)
        return any(abs(begin - x) <= e for cell in (at - 1, at, at + 1) for x in self.places.get(cell, ()))

    def add(self, begin: int, e: int, edits: int, first: int, stop: int) -> None:
        self.places.setdefault(begin // (e + 1), []).append(begin)
        self.times += 1
        if edits < self.edits:
            self.edits, self.first, self.stop = edits, first, stop


_MATCHERS: dict[tuple, Matcher] = {}


def matcher(shared, rate: float) -> Matcher:
    """This worker's matcher of a broadcast block of items; one is kept at a time."""
    key = (shared.id, rate)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(shared.value, rate)
    return _MATCHERS[key]


class Shared:
    """A broadcast value with a name that tells it from others in a worker's cache."""

    def __init__(self, broadcast):
        self.id, self.broadcast = uuid.uuid4().hex, broadcast

    @property
    def value(self):
        return self.broadcast.value


class Block:
    """A block of items, broadcast to the tasks."""

    def __init__(self, spark, items: list[tuple[int, str]], rate: float):
        self.broadcast, self.rate = spark.sparkContext.broadcast(items), rate
        self.shared = Shared(self.broadcast)

    def hits(self, docs: DataFrame) -> DataFrame:
        """One row for each hit in ``docs`` (doc_id, text); a text is searched once."""
        shared, rate = self.shared, self.rate
        names = ["doc_id", *(x.split()[0] for x in HIT.split(", "))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in windows(batches, WINDOW_BYTES):
                m, at, rows = matcher(shared, rate), [], []
                for i, t in enumerate(b.column(1)):
                    for hit in m.hits(t.as_py()):
                        at.append(i)
                        rows.append(hit)
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), *[pa.int32()] * 4)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

        kind = dict(docs.dtypes)["doc_id"]
        return docs.mapInArrow(lean(run), f"doc_id {kind}, {HIT}")

    def clean(self, text: Column) -> Column:
        """Whether a text has no hit."""
        shared, rate = self.shared, self.rate

        @F.pandas_udf("boolean")
        def none(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                m = matcher(shared, rate)
                yield pd.Series([not m.hits(t) for t in texts], dtype=bool)

        return none(text)


def blocks(items: DataFrame, item_col: str, text_col: str, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``limit`` characters (at least one item each), read one partition at a time."""
    block, size = [], 0
    rows = items.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("i is not null and t is not null").distinct()
    for r in rows.toLocalIterator():
        if block and size + len(r["t"]) > limit:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    if block:
        yield block


def in_turn(todo: Iterator[list]) -> Iterator[tuple[list, bool]]:
    """Each block, and whether it is the last."""
    held = next(todo, None)
    while held is not None:
        after = next(todo, None)
        yield held, after is None
        held = after


def hits(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, limit: int = BLOCK_CHARS) -> DataFrame:
    """One row (doc_id, item_id, edits, first_word, n_words, occurrences) for each item found in each row of ``docs``.

    edits, first_word and n_words are those of the best match; occurrences begin more than the edit budget apart. Null
    and empty texts have no hits and very long ones are searched whole; rows that repeat are searched each; items that
    are null, without an id or without words match nothing; items with the same words all match; repeated item rows
    count once. Null ids stay. Other columns of ``docs`` are ignored; an empty table, or no items, give no rows.
    """
    kept, out = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text")), None
    for items_of, last in in_turn(blocks(items, item_col, item_text_col, limit)):
        block = Block(docs.sparkSession, items_of, rate)
        found = block.hits(kept)
        if not (last and out is None):
            found = materialise(found)
            block.broadcast.destroy()
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], f"doc_id {dict(kept.dtypes)['doc_id']}, {HIT}") if out is None else out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, limit: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` without any hit, with their columns, whatever their names.

    Null and empty texts hold no item and stay, whatever their ids; very long texts are searched whole; repeated rows stay
    or go together; without items all rows stay, and an empty table stays empty.
    """
    for items_of, last in in_turn(blocks(items, item_col, item_text_col, limit)):
        block = Block(docs.sparkSession, items_of, rate)
        docs = docs.filter(block.clean(F.col(text_col)))
        if not last:
            docs = materialise(docs)
            block.broadcast.destroy()
    return docs
