"""Phrase collocations by hierarchical pair naming.

1. Tasks turn texts into chunks: the distinct words of about ``CHUNK`` consecutive words of a language, and the sequence of
   their places. Everything global happens on distinct words and pairs of a chunk, so a very frequent one is one row a chunk.
2. Words of at least ``min_count`` occurrences get a global id, that of the first chunk and place that has them; it is joined
   to the chunks and replaces them.
3. Level k names pairs: adjacent (k-1)-gram ids of a chunk that are both frequent are a candidate k-gram. One shuffle by
   pair counts it over all chunks and names it (``named``: id, a, b, f); the names go back to their chunks for the next level.
4. A name's pair is also its two parents, the phrase without its last and without its first word. Following them gives the
   counts of all beginnings and ends (``grams``), so that cuts need no search by text, and tells which phrases a longer one
   contains: counts don't grow with length, so one that is one word longer stands for all longer ones.

A chunk that ends within a piece repeats the words that phrases of its own last words need, but counts only phrases that
begin before them, so no phrase is lost or counted twice.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, Stage, lean, materialise, spread_join, windows

MAX_WORDS, MIN_COUNT, COVER, TOP = 3, 10, 50, 2000
#: Words of a chunk, chunks' worth of words that a task holds over all languages, and bytes of text cut into words at a time.
CHUNK, HELD, WINDOW_BYTES = 1 << 21, 4, 1 << 20
#: Bits of a place in a chunk, which is below CHUNK and the words of a window, and of a chunk's number in its task.
PLACE_BITS, NUMBER_BITS = 22, 18
#: Parts in which the first phrases of a language are found before they meet.
SALTS = 64
#: What separates pieces, and a byte that no UTF-8 text has to stand for it.
SEPARATORS, BREAK = ".,;:!?\n\x0b\x0c\r", b"\xff"
_TABLE = bytes.maketrans((ASCII_UPPER + SEPARATORS).encode(), ASCII_LOWER.encode() + BREAK * len(SEPARATORS))


class Places(dict):
    """The place of each word in order of first use; ``BREAK`` is at 0."""

    def __init__(self) -> None:
        super().__init__({BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place


@dataclass
class Chunk:
    places: Places = field(default_factory=Places)
    codes: array = field(default_factory=lambda: array("i"))
    letters: int = 0

    def add(self, words: list[bytes]) -> int:
        """Add words, and return by how much the chunk's weight grew."""
        before, known = self.weight(), len(self.places)
        self.codes.extend(map(self.places.__getitem__, words))
        if len(self.places) > known:
            self.letters += sum(map(len, words))
        return self.weight() - before

    def weight(self) -> int:
        """Words, or an eighth of the bytes of texts with new words where those are more."""
        return max(len(self.codes), self.letters // 8)

    def cut(self, context: int) -> tuple[int, list[bytes]]:
        """How many words are the chunk's own, and the last ones, at most ``context``, with which the next one begins."""
        at = len(self.codes)
        while at and len(self.codes) - at < context and self.codes[at - 1]:
            at -= 1
        words = list(self.places)
        return at, [words[c] for c in self.codes[at:]]


def words_in_windows(text: bytes, limit: int) -> Iterator[list[bytes]]:
    """The words of a text, and BREAK between pieces, about ``limit`` bytes at a time; a word is never cut."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        end = at + limit
        ends = [x for x in (text.find(c, end) for c in (b" ", b"\t", BREAK)) if x >= 0] if end < len(text) else []
        end = min(ends, default=len(text))
        yield text[at:end].replace(BREAK, b" \xff ").split()
        at = end


def packed(codes: np.ndarray) -> bytes:
    """Codes compressed by byte planes: low bytes first, then the next."""
    return pa.compress(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpacked(data: pa.Scalar, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data.as_buffer(), 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").ravel()


def long_list(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, pa.int64()))


def chunks(docs: DataFrame, lang_col: str, text_col: str, max_words: int, size: int = CHUNK) -> DataFrame:
    """(chunk, lang, n, own, codes, words, counts): ``counts`` are of the words among the ``own`` first of ``n`` codes."""

    def row(number: int, lang: str, c: Chunk, own: int) -> pa.RecordBatch:
        codes = np.frombuffer(c.codes, np.int32)
        counts = np.bincount(codes[:own], minlength=len(c.places))[1:]
        words = pa.array(list(c.places)[1:], pa.binary()).cast(pa.string())
        words = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        columns = [pa.array([number], pa.int64()), pa.array([lang]), pa.array([len(codes)], pa.int32()), pa.array([own], pa.int32()), pa.array([packed(codes)]), words, long_list(counts)]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "lang", "n", "own", "codes", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, total = TaskContext.get().partitionId() << NUMBER_BITS, {}, 0
        for b in windows(batches, WINDOW_BYTES):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                for words in words_in_windows(text.as_py() or b"", WINDOW_BYTES):
                    if not words:
                        continue
                    chunk = held.setdefault(lang, Chunk())
                    total += chunk.add(words)
                    full = list(held) if total >= HELD * size else [lang] if chunk.weight() >= size else []
                    for name in full:
                        c = held.pop(name)
                        total -= c.weight()
                        own, last = c.cut(max_words - 1)
                        yield row(number, name, c, own)
                        number += 1
                        if last:
                            held[name] = Chunk()
                            total += held[name].add(last)
                if lang in held:
                    total += held[lang].add([BREAK])
        for name, c in held.items():
            yield row(number, name, c, len(c.codes))
            number += 1

    kept = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return kept.mapInArrow(lean(run), "chunk long, lang string, n int, own int, codes binary, words array<string>, counts array<long>")


def pair_codes(codes: np.ndarray, own: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, a, b, counts) of the next level: the place (from 1; 0: none) of each pair of neighbours that both have an id.

    ``ids`` are the global ids of places, -1 where there is none. Pairs that begin at ``own`` or later aren't counted.
    """
    left, right = codes[:-1].astype(np.int64), codes[1:].astype(np.int64)
    at = np.flatnonzero((ids[left] >= 0) & (ids[right] >= 0))
    pairs, place = np.unique(left[at] * len(ids) + right[at], return_inverse=True)
    out = np.zeros(max(len(codes) - 1, 0), np.int32)
    out[at] = place + 1
    return out, ids[pairs // len(ids)], ids[pairs % len(ids)], np.bincount(place[at < own], minlength=len(pairs))


SEQUENCE = "chunk long, n int, own int, codes binary, ids array<long>"


def sequence(chunk: int, own: int, codes: np.ndarray, ids: np.ndarray) -> pa.Table:
    """A chunk as one row: codes, and the global id of each code's place (-1: none)."""
    columns = [pa.array([chunk], pa.int64()), pa.array([len(codes)], pa.int32()), pa.array([own], pa.int32()), pa.array([packed(codes)], pa.binary()), long_list(ids)]
    return pa.Table.from_arrays(columns, names=["chunk", "n", "own", "codes", "ids"])


def fields(rows: pa.Table | pa.RecordBatch, i: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(chunk, own, codes, ids) of a row."""
    r = {c: rows.column(c)[i] for c in ("chunk", "n", "own", "codes")}
    ids = rows.column("ids")[i].values.to_numpy() if "ids" in rows.schema.names else np.zeros(0, np.int64)
    return r["chunk"].as_py(), r["own"].as_py(), unpacked(r["codes"], r["n"].as_py()), ids


def renamed(level: DataFrame, found: DataFrame, pairs: bool) -> DataFrame:
    """The next level's chunks: places of words, or of pairs (``pairs``) of ``level``, with the ids that ``found`` (at, id) gives them."""

    def join(chunk: pa.Table, named: pa.Table) -> pa.Table:
        if not chunk.num_rows or not named.num_rows:
            return sequence(0, 0, np.zeros(0, np.int32), np.zeros(0, np.int64)).slice(0, 0)
        number, own, codes, ids = fields(chunk, 0)
        if pairs:
            codes = pair_codes(codes, own, ids)[0]
        fresh_ids = np.full(int(codes.max(initial=0)) + 1, -1, np.int64)
        fresh_ids[(named.column("at").to_numpy() & ((1 << PLACE_BITS) - 1)) + 1] = named.column("id").to_numpy()
        return sequence(number, own, np.where(fresh_ids[codes] >= 0, codes, 0).astype(np.int32), fresh_ids)

    keyed = found.select(F.shiftright("at", PLACE_BITS).alias("chunk"), "at", "id")
    kept = level.select("chunk", "n", "own", "codes", *(["ids"] if pairs else []))
    return kept.groupBy("chunk").cogroup(keyed.groupBy("chunk")).applyInArrow(join, SEQUENCE)


def pairs_of(level: DataFrame) -> DataFrame:
    """(at, a, b, c): each chunk's distinct pairs of adjacent ids, where they are, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                chunk, own, codes, ids = fields(b, i)
                _, left, right, counts = pair_codes(codes, own, ids)
                at = (chunk << PLACE_BITS) + np.arange(len(left))
                for k in range(0, len(left), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 16)]) for c in (at, left, right, counts)], names=["at", "a", "b", "c"])

    return level.mapInArrow(lean(run), "at long, a long, b long, c long")


def named(rows: DataFrame, keys: list[str], min_count: int) -> Stage:
    """(at, id, *keys, f) of rows whose keys have at least ``min_count`` occurrences; the smallest ``at`` is the id.

    Only that row holds keys and count, as the others just tell their chunk its id.
    """
    same = W.partitionBy(*keys)
    counted = rows.withColumn("f", F.sum("c").over(same)).withColumn("id", F.min("at").over(same)).filter(F.col("f") >= min_count)
    return Stage(counted.select("at", "id", *[F.when(F.col("at") == F.col("id"), F.col(c)).alias(c) for c in (*keys, "f")]))


def parents(names: DataFrame, side: str, shorter: DataFrame, columns: list[str]) -> DataFrame:
    """``names`` with columns of the parent on one side; a parent of very many phrases makes no hot key."""
    used = names.groupBy(side).agg(F.count("*").alias("uses"))
    right = used.join(shorter.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    return spread_join(names, right, side, "uses")


def grams(names: DataFrame, shorter: DataFrame) -> DataFrame:
    """(id, lang, text, last, f, begins, ends): ``begins`` and ``ends`` are the counts of both sides of each cut, first cut first."""
    both = parents(parents(names, "a", shorter, ["lang", "text", "f", "begins"]), "b", shorter, ["last", "f", "ends"])
    text = F.concat_ws(" ", "a_text", "b_last").alias("text")
    begins, ends = F.concat("a_begins", F.array("a_f")).alias("begins"), F.concat(F.array("b_f"), "b_ends").alias("ends")
    return materialise(both.select("id", F.col("a_lang").alias("lang"), text, F.col("b_last").alias("last"), "f", begins, ends))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact up to counts of 10^16."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * wide(a) * wide(a), wide(left) * wide(right))


def worst_cut(f: Column, begins: Column, ends: Column) -> Column:
    """struct(score, k, l, r) of the cut with the lowest score, ties to the first."""
    cuts = F.transform(F.arrays_zip(begins.alias("l"), ends.alias("r")), lambda x, i: F.struct(score(f, x["l"], x["r"]).alias("score"), (i + 1).alias("k"), x["l"].alias("l"), x["r"].alias("r")))
    return F.array_min(cuts)


def mined(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, cover: int = COVER, top: int = TOP, size: int = CHUNK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by score, count and text.

    Words, pieces and counts are of whole texts, A-Z lower-cased; a null or empty text has none, a null language is
    "und". A phrase has 2 to ``max_words`` words and at least ``min_count`` occurrences a within pieces; l and r are the counts of its
    two parts at its worst cut, n all words of the language. One that lies in a longer phrase of at least ``cover`` percent of its
    occurrences is left out. Rows that repeat count each, very long texts are cut where a chunk ends without losing a
    phrase, and an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    if max_words < 2 or not 1 <= size <= CHUNK:
        raise ValueError(f"a phrase has at least two words, a chunk at most {CHUNK}")
    first = Stage(chunks(docs, lang_col, text_col, max_words, size))
    counted = materialise(first.df.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n")))
    words = first.df.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x"))
    at = F.shiftleft("chunk", PLACE_BITS) + F.col("place")
    rows = named(words.select(at.alias("at"), "lang", F.col("x.words").alias("word"), F.col("x.counts").alias("c")), ["lang", "word"], min_count)
    none = F.array().cast("array<long>")
    shorter = materialise(rows.df.filter("at = id").select("id", "lang", F.col("word").alias("text"), F.col("word").alias("last"), "f", none.alias("begins"), none.alias("ends")))
    held, found = [Stage(renamed(first.df, rows.df, False))], []
    first.drop()
    rows.drop()
    level = held[0].df
    for k in range(2, max_words + 1):
        if k == max_words:
            # the last level names nothing in the chunks: counts by pair are enough
            total = pairs_of(level).groupBy("a", "b").agg(F.sum("c").alias("f")).filter(F.col("f") >= min_count)
            names = materialise(total.select(F.monotonically_increasing_id().alias("id"), "a", "b", "f"))
        else:
            rows = named(pairs_of(level), ["a", "b"], min_count)
            names = materialise(rows.df.filter("at = id").select("id", "a", "b", "f"))
            level, held = renamed(level, rows.df, True), [*held, rows]
        if k + 1 != max_words:
            # before the last level chunks are renamed as they are read
            after = [] if k == max_words else [Stage(level)]
            for stage in held:
                stage.drop()
            held = after
            level = held[0].df if held else None
        if found:
            longer = names.select(F.col("a").alias("id"), "f").union(names.select("b", "f")).groupBy("id").agg(F.max("f").alias("longest"))
            covered = 100 * F.coalesce("longest", F.lit(0)) >= cover * F.col("f")
            found[-1] = found[-1].join(longer, "id", "left").filter(~covered).drop("longest")
        shorter = grams(names, shorter)
        found.append(shorter)
    both = found[0]
    for more in found[1:]:
        both = both.unionByName(more)
    cut = both.withColumn("cut", worst_cut(F.col("f"), F.col("begins"), F.col("ends"))).select("lang", F.col("text").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    thinned = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = thinned.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.join(counted, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
split AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
one AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(w) AS p FROM split) GROUP BY lang, p),
two AS MATERIALIZED (SELECT lang, x, y, count(*) AS f FROM (SELECT lang, w[i] AS x, w[i + 1] AS y FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM split)) GROUP BY lang, x, y),
three AS MATERIALIZED (SELECT lang, x, y, z, count(*) AS f FROM (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM split)) GROUP BY lang, x, y, z),
longest AS (SELECT lang, x, y, max(f) AS m FROM (SELECT lang, x, y, f FROM three WHERE f >= {MIN_COUNT} UNION ALL SELECT lang, y, z, f FROM three WHERE f >= {MIN_COUNT}) GROUP BY lang, x, y),
cuts AS (
  SELECT t.lang, t.x || ' ' || t.y AS phrase, t.f AS a, 1 AS k, p.f AS l, q.f AS r FROM two t JOIN one p ON p.lang = t.lang AND p.p = t.x JOIN one q ON q.lang = t.lang AND q.p = t.y
    LEFT JOIN longest m ON m.lang = t.lang AND m.x = t.x AND m.y = t.y WHERE t.f >= {MIN_COUNT} AND NOT (100 * coalesce(m.m, 0) >= {COVER} * t.f)
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, p.f, q.f FROM three t JOIN one p ON p.lang = t.lang AND p.p = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z WHERE t.f >= {MIN_COUNT}
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, p.f, q.f FROM three t JOIN two p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN one q ON q.lang = t.lang AND q.p = t.z WHERE t.f >= {MIN_COUNT}),
scored AS (SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM worst)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
