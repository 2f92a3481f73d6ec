"""Hierarchical multi-length packing of documents into token sequences.

Each task packs the documents of its own input partition, so nothing is shuffled; within it, windows of a few
megabytes of text are taken one after another:

1. a document's ids (and an end id) are cut into full windows of the longest tier; the rest is routed to the
   shortest tier that holds it (256, 512, 1024 or 2048 tokens);
2. tiers are packed from the longest down: the longest piece opens a sequence, the largest pieces that fit its
   gap follow, from its own tier or shorter ones, and a gap that none fits is closed by cutting the shortest
   piece left. Every sequence so ends exactly at its tier's length, a power of two;
3. what is left when a window's pieces run out opens the next window. Only a partition's last sequence can
   need padding;
4. sequences are dealt to training steps of about ``STEP_TOKENS`` tokens each, longest first to the step with
   fewest tokens.

Sequence and step ids hold the partition's number in their upper bits; a retried task gives the same ids.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, windows
from .tokenizer_ids import loaded

TOKENIZER = "word_bpe_49k.json"
TIERS = (2048, 1024, 512, 256)
END_ID = 1
STEP_TOKENS = 65_536
#: Bytes of text in a window of packing.
WINDOW_BYTES = 3_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"

Piece = tuple[int, int, int]  # item, start in it, length


def tier_of(length: int) -> int:
    return next(t for t in reversed(TIERS) if t >= length)


def pack(pieces: list[Piece]) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Sequences (tier, pieces) that are all full, and the pieces left over: less than one sequence of the longest tier."""
    done: list[tuple[int, list[Piece]]] = []
    pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in TIERS}
    for item, start, length in pieces:
        while length >= TIERS[0]:
            done.append((TIERS[0], [(item, start, TIERS[0])]))
            start, length = start + TIERS[0], length - TIERS[0]
        if length:
            pools[tier_of(length)].append((length, item, start))
    for p in pools.values():
        p.sort()
    for at, tier in enumerate(TIERS):
        while pools[tier]:
            length, item, start = pools[tier].pop()
            row, gap = [(item, start, length)], tier - length
            while gap:
                fits = next(((p, k) for t in TIERS[at:] if (k := bisect_left(p := pools[t], (gap + 1, -1, -1)) - 1) >= 0), None)
                if fits:
                    length, item, start = fits[0].pop(fits[1])
                    row.append((item, start, length))
                    gap -= length
                    continue
                pool = next((pools[t] for t in reversed(TIERS[at:]) if pools[t]), None)
                if pool is None:
                    return done, row
                length, item, start = pool.pop(0)
                row.append((item, start, gap))
                insort(pools[tier_of(length - gap)], (length - gap, item, start + gap))
                gap = 0
            done.append((tier, row))
    return done, []


def deal_steps(lengths: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step for each sequence: longest first, to the step with fewest tokens."""
    steps = [(0, g) for g in range(max(1, round(sum(lengths) / step_tokens)))]
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        tokens, g = heapq.heappop(steps)
        out[i] = g
        heapq.heappush(steps, (tokens + lengths[i], g))
    return out


def packer(tokenizer: str, step_tokens: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        next_seq = next_step = base
        held: list[tuple] = []  # (doc id, ids, start of these ids, tokens of the document), carried over

        def rows(items: list[tuple], sequences: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
            nonlocal next_seq, next_step
            steps = deal_steps([sum(p[2] for p in seq) for _, seq in sequences], step_tokens)
            cols: list[list] = [[] for _ in range(10)]
            for g, (tier, seq) in zip(steps, sequences, strict=True):
                offset = 0
                for item, start, length in seq:
                    doc, ids, begin, tokens = items[item]
                    part = ids[start : start + length]
                    for c, v in zip(cols, (doc, begin + start, length, zlib.crc32(part), tokens, next_seq, offset, tier, next_step + g, part if with_ids else None), strict=True):
                        c.append(v)
                    offset += length
                next_seq += 1
            next_step += max(steps, default=-1) + 1
            kinds = (pa.int64(),) * 7 + (pa.int32(), pa.int64(), pa.list_(pa.int32()))
            names = [f.split()[0] for f in SCHEMA.split(", ")] + ["ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)][: 10 if with_ids else 9], names=names[: 10 if with_ids else 9])

        for b in windows(batches, WINDOW_BYTES):
            flat, at = loaded(tokenizer).encode(b.column(1))
            items = list(held)
            end = np.array([END_ID], "<u4")
            for doc, x, y in zip(b.column(0).to_pylist(), at.tolist(), at[1:].tolist(), strict=False):
                ids = np.concatenate([flat[x:y], end])
                items.append((doc, ids, 0, len(ids)))
            done, left = pack([(i, 0, len(x[1])) for i, x in enumerate(items)])
            held = [(items[i][0], items[i][1][s : s + n].copy(), items[i][2] + s, items[i][3]) for i, s, n in left]
            yield rows(items, done)
        if held:
            size = sum(len(x[1]) for x in held)
            yield rows(held, [(tier_of(size) if size in TIERS else TIERS[0], [(i, 0, len(x[1])) for i, x in enumerate(held)])])

    return run


def packed(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_id (and ids).

    ``tokenizer`` names a file of the public tokenizers. Every row of ``docs`` is packed, repeated ones as well; a
    null or empty text is its end id alone; a very long text fills sequences of its own; rows with a null id are packed
    and stay null. ``tier`` is the length a sequence is padded to. Sequences depend on the order of a partition's rows, so a task that
    is tried again gives the same ones where its input comes in the same order, as files do. Other columns are ignored. An empty table gives no rows.
    """
    kept = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(lean(packer(tokenizer, step_tokens, with_ids)), SCHEMA + (", ids array<int>" if with_ids else ""))
