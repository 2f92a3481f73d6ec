"""Token counts by rank-synchronous array merging.

The tokenizer's vocabulary (a byte-fallback BPE model) becomes two arrays: symbols, and a sorted table of
symbol pairs with their merged symbol and score. A batch's texts are cut into pre-tokens where no piece of
the vocabulary can reach across; distinct pre-tokens that the worker hasn't counted yet are laid out as one
ragged array of symbols. In each round every sequence finds its best pair (highest score, leftmost) and all
of them are merged at once; after the last round the surviving symbols of each sequence are counted, a
character outside the vocabulary as its UTF-8 bytes. Equal pairs of one sequence are merged in the same
round as long as no pair that arises would come before them, so a long run needs few rounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, strings, windows

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Bytes that a worker's cache of pre-tokens may take; it takes no more then. Each needs about ``ENTRY`` beside its characters.
CACHE_BYTES, ENTRY = 64_000_000, 110
#: Bytes of text counted at a time.
WINDOW_BYTES = 4_000_000
SPACE = "▁"
_NONE = np.int64(-1)


class Counter:
    """Counts the tokens of texts as the sentencepiece library does for one model file."""

    def __init__(self, model: str):
        import public_tokenizers
        import sentencepiece

        self.load(sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model)))

    def load(self, sp) -> None:
        n = sp.vocab_size()
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))}
        symbols = sorted(set(pieces) | {c for p in pieces for c in p})
        number = {s: i for i, s in enumerate(symbols)}
        keys, merged = [], []
        for p in pieces:
            for i in range(1, len(p)):
                a, b = number.get(p[:i]), number.get(p[i:])
                if a is not None and b is not None:
                    keys.append(a * len(symbols) + b)
                    merged.append(number[p])
        order = np.argsort(np.array(keys, np.int64))
        self.n, self.pair_keys, self.pair_to = len(symbols), np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        self.score = np.array([pieces.get(s, -np.inf) for s in symbols])
        self.cost = np.array([1 if s in pieces else len(s.encode()) for s in symbols], np.int64)
        self.of_char = np.full(0x110000, -1, np.int64)
        for s, i in number.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.inner = np.unique(np.array([(ord(a) << 21) | ord(b) for p in pieces for a, b in zip(p, p[1:], strict=False)], np.int64))
        spaced = {c for p in pieces for c, d in zip(p, p[1:], strict=False) if d == SPACE and c != SPACE}
        self.can_split = not spaced and not any("\n" in p and len(p) > 1 for p in pieces)
        self.known: dict[str, int] = {}
        self.room = CACHE_BYTES

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbol (-1: none) and score of each pair; unknown characters (-1) never merge."""
        key = np.where((left < 0) | (right < 0), _NONE, left * self.n + right)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        ok = self.pair_keys[at] == key
        to = np.where(ok, self.pair_to[at], _NONE)
        return to, np.where(ok, self.score[to], -np.inf)

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token (spaces already written as the space symbol)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        symbol = self.of_char[codes]
        unknown = symbol < 0
        n_bytes = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        out = np.bincount(owner[unknown], n_bytes[unknown], len(words)).astype(np.int64)
        # a sequence: characters between which pieces reach across
        joint = np.isin((codes[:-1] << 21) | codes[1:], self.inner) & (owner[:-1] == owner[1:])
        seq = np.cumsum(np.r_[0, ~joint]) if len(codes) else np.zeros(0, np.int64)
        keep = ~unknown
        symbol, seq, owner = symbol[keep], seq[keep], owner[keep]
        self.merge(symbol, seq, owner, out)
        return out

    def merge(self, symbol: np.ndarray, seq: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        """Merge to the end; add the costs of surviving symbols to ``out`` by owner."""

        def links() -> tuple[np.ndarray, np.ndarray]:
            to, score = np.full(len(symbol), _NONE), np.full(len(symbol), -np.inf)
            same = np.flatnonzero(seq[:-1] == seq[1:])
            to[same], score[same] = self.pairs(symbol[same], symbol[same + 1])
            return to, score

        to, score = links()
        while len(symbol):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.maximum.reduceat(score, first)
            live = best > -np.inf
            lengths = np.diff(np.r_[first, len(symbol)])
            if not live.all():  # finished sequences leave
                done = np.repeat(~live, lengths)
                out += np.bincount(owner[done], self.cost[symbol[done]], len(out)).astype(np.int64)
                symbol, seq, owner, to, score = (x[~done] for x in (symbol, seq, owner, to, score))
                if not len(symbol):
                    return
                first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
                best, lengths = best[live], lengths[live]
            top = np.repeat(best, lengths)
            at = self.chosen(symbol, seq, to, score, np.flatnonzero(score == top))
            symbol[at] = to[at]
            gone = np.zeros(len(symbol), bool)
            gone[at + 1] = True
            stale = np.zeros(len(symbol), bool)
            stale[at] = True
            stale[np.maximum(at - 1, 0)] = True
            symbol, seq, owner, to, score, stale = (x[~gone] for x in (symbol, seq, owner, to, score, stale))
            i = np.flatnonzero(stale)
            to[i], score[i] = _NONE, -np.inf
            i = i[i + 1 < len(seq)]
            i = i[seq[i] == seq[i + 1]]
            to[i], score[i] = self.pairs(symbol[i], symbol[i + 1])

    def chosen(self, symbol: np.ndarray, seq: np.ndarray, to: np.ndarray, score: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the places of best pairs, those to merge now: all of a sequence that can't overlap or be overtaken, else its first."""
        opens = np.r_[True, seq[at[1:]] != seq[at[:-1]]]
        if opens.all():
            return at
        # drop a place that overlaps the chosen one before it: every other one of a run of neighbours
        run = np.cumsum(np.r_[True, (np.diff(at) != 1)]) - 1
        start = np.flatnonzero(np.r_[True, np.diff(run) != 0])
        odd = (np.arange(len(at)) - start[run]) % 2 == 1
        kept = at[~odd]
        # a pair that arises beside a merged place must score below it, else only the first place is safe
        new, limit = to[kept], score[kept]
        right = np.minimum(kept + 2, len(symbol) - 1)
        ok_right = (kept + 2 < len(symbol)) & (seq[right] == seq[kept])
        left = np.maximum(kept - 1, 0)
        ok_left = (kept > 0) & (seq[left] == seq[kept])
        before = symbol[left].copy()
        previous = np.r_[_NONE, kept[:-1]]
        joined = (previous >= 0) & (previous + 1 == left)
        before[joined] = to[previous[joined]]
        over = np.zeros(len(kept), bool)
        over[ok_right] |= self.pairs(new[ok_right], symbol[right[ok_right]])[1] >= limit[ok_right]
        over[ok_left] |= self.pairs(before[ok_left], new[ok_left])[1] >= limit[ok_left]
        if not over.any():
            return kept
        bad = np.isin(seq[kept], seq[kept[over]])
        lead = np.r_[True, seq[kept[1:]] != seq[kept[:-1]]]
        return kept[~bad | lead]

    def lookup(self, vocab: pa.Array) -> np.ndarray:
        """Tokens of distinct pre-tokens, from the worker's cache or counted now."""
        words = strings(vocab)
        out = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = words[missing].tolist()
            out[missing] = counted = self.count(new)
            if self.room > 0:
                self.known.update(zip(new, counted.tolist(), strict=True))
                self.room -= sum(map(len, new)) + ENTRY * len(new)
        return out

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null counts as empty.

        With one space between words, a word and the space before it is a pre-token, and so is a line feed. Texts
        that have runs of spaces, or the space symbol itself, are cut by a regular expression instead.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.match_substring(texts, SPACE)) if self.can_split else pa.array(np.ones(len(texts), bool))
        out = np.zeros(len(texts), np.int64)
        slow = odd.to_numpy(zero_copy_only=False)
        if not slow.all():
            plain = texts.filter(pc.invert(odd))
            spaced = pc.replace_substring(pc.replace_substring(plain, " ", f" {SPACE}"), "\n", " \n ")
            lists = pc.split_pattern(pc.binary_join_element_wise(SPACE, spaced, ""), " ")
            coded = lists.flatten().dictionary_encode()
            total = np.r_[0, np.cumsum(self.lookup(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)])]
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            out[~slow] = np.where(pc.equal(plain, "").to_numpy(zero_copy_only=False), 0, np.diff(total[offsets]))
        for i in np.flatnonzero(slow).tolist():
            t = SPACE + texts[i].as_py().replace(" ", SPACE)
            if self.can_split:
                distinct, times = np.unique(np.array(_RUNS.findall(t), object), return_counts=True)
                out[i] = (self.lookup(pa.array(distinct, pa.string())) * times).sum()
            elif len(t) > 1:
                out[i] = self.count([t])[0]
        return out


_RUNS = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
_LOADED: dict[str, Counter] = {}


def counts(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs``, in one pass without a shuffle.

    ``model`` names a sentencepiece BPE file of the public tokenizers. Null and empty texts have no tokens; very
    long texts are counted whole, a batch of about ``WINDOW_BYTES`` bytes (one text at least) at a time. Repeated
    rows and ids stay, other columns are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _LOADED:
            _LOADED[model] = Counter(model)
        for b in windows(batches, WINDOW_BYTES):
            n_bytes = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, pa.array(_LOADED[model].texts(b.column(1)))], names=["doc_id", "n_bytes", "n_tokens"])

    kept = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
