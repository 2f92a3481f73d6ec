"""Vector code compression: product quantisation in exact integers, screened by float32 matrix products.

1. Components become integers. Vectors are cut into equal parts, each with a codebook of its own.
2. ``nearest`` multiplies a block of parts with its codebook in float32. The rounding error of such a product has a rigorous
   bound, so each squared distance lies in a known interval. Entries whose interval overlaps the best one are computed
   anew in int64, and ties go to the smaller index: codes are exact, whatever order a matrix product sums in.
3. A round of Lloyd's algorithm is one job: each task adds its parts by entry and emits 16 numbers for each component; sums of
   integers don't depend on the order of tasks, so a retried task changes nothing. The driver gets the codebooks' size.
4. Errors by label are partial sums; labels with very many rows are joined by a broadcast of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, spread_join

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Numbers of a block of vectors, which bounds a task's memory.
BLOCK = 1 << 20
#: Unit round-offs of float32 and float64.
U32, U64 = 2.0**-24, 2.0**-53


def nearest(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The index of each row's nearest entry by squared distance, exactly; ties to the smaller index. Both are int64.

    A dot product of m terms in float32 is off by at most g |x| |c|, g = (m + 2) u / (1 - (m + 2) u), in any order of
    summation; two of the m + 2 roundings are those of the factors.
    """
    terms = (x.shape[1] + 2) * U32
    x64, c64 = x.astype(np.float64), entries.astype(np.float64)
    products = (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    lengths, sizes = np.sqrt((x64 * x64).sum(axis=1)), (c64 * c64).sum(axis=1)
    # what float64 adds here is far below the second term
    radius = (2 * terms / (1 - terms)) * (1 + 1e-9) * lengths[:, None] * np.sqrt(sizes)[None, :] + (8 + x.shape[1]) * U64 * (sizes[None, :] + 2 * np.abs(products))
    middle = sizes[None, :] - 2 * products
    near = ~(middle - radius > (middle + radius).min(axis=1, keepdims=True))
    best = near.argmax(axis=1)
    open_rows = np.flatnonzero(near.sum(axis=1) > 1)
    if len(open_rows):
        i, k = np.nonzero(near[open_rows])
        exact = np.full((len(open_rows), len(entries)), np.iinfo(np.int64).max)
        exact[i, k] = ((x[open_rows[i]] - entries[k]) ** 2).sum(axis=1)
        best[open_rows] = exact.argmin(axis=1)
    return best


def blocks(batches: Iterator[pa.RecordBatch], column: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows with a vector of ``dim`` finite components, in blocks, with those vectors as integers."""
    for whole in batches:
        for at in range(0, whole.num_rows, max(1, BLOCK // max(dim, 1))):
            b = whole.slice(at, max(1, BLOCK // max(dim, 1)))
            rows = np.flatnonzero(pc.fill_null(pc.list_value_length(b.column(column)), -1).to_numpy(zero_copy_only=False) == dim)
            flat = b.column(column).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
            fine = np.isfinite(flat).all(axis=1)
            if fine.any():
                x = np.floor(SCALE * flat[fine])
                if np.abs(x).max(initial=0) * max(dim, 1) ** 0.5 >= 2.0**30:
                    raise ValueError("a component is so large that squared distances exceed a long")
                yield b.take(pa.array(rows[fine])), x.astype(np.int64)


@dataclass
class Codebooks:
    """Entries of each part: int64 of shape (parts, entries, components of a part)."""

    entries: np.ndarray

    @property
    def dim(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The nearest entry of each part, (rows, parts)."""
        return np.stack([nearest(p, c) for p, c in zip(self.parts(x), self.entries, strict=True)], axis=1)

    def parts(self, x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(x.reshape(len(x), self.entries.shape[0], -1).transpose(1, 0, 2))

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """The integer vectors that ``codes`` stand for."""
        return np.concatenate([c[codes[:, p]] for p, c in enumerate(self.entries)], axis=1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def starts(vectors: DataFrame, id_col: str, vector_col: str, parts: int, entries: int) -> Codebooks | None:
    """Codebooks of the vectors with the smallest ids; None if no usable row has an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            lengths = pc.fill_null(pc.list_value_length(b.column(1)), -1).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[lengths >= 0]).tolist():
                for rows, x in blocks(iter([b]), 1, dim):
                    ids = rows.column(0).to_numpy()
                    low = ids <= np.unique(ids)[:entries][-1]
                    ends = pa.array(np.arange(low.sum() + 1) * dim, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[low]), pa.ListArray.from_arrays(ends, pa.array(x[low].ravel()))], names=["id", "x"])

    named = vectors.select(F.col(id_col).cast("long"), vector_col).mapInArrow(lean(run), "id long, x array<long>")
    low = materialise(named.groupBy("id", F.size("x").alias("dim")).agg(F.min("x").alias("x")))
    first = low.orderBy("id", "x").first()
    if first is None:
        return None
    if first["dim"] % parts:
        raise ValueError(f"vectors of {first['dim']} components can't be cut into {parts} equal parts")
    found = [r["x"] for r in low.filter(F.col("dim") == first["dim"]).orderBy("id").limit(entries).collect()]
    return Codebooks(np.array(found, np.int64).reshape(len(found), parts, -1).transpose(1, 0, 2).copy())


def moved(vectors: DataFrame, books: Codebooks, vector_col: str) -> Codebooks:
    """One round: every part goes to its nearest entry, and entries become the floor of their parts' mean."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.entries.shape, np.int64), np.zeros((parts, entries), np.int64)
        for _, x in blocks(batches, 0, books.dim):
            for p, (own, code) in enumerate(zip(books.parts(x), books.codes(x).T, strict=True)):
                order = np.argsort(code, kind="stable")
                used, first, n = np.unique(code[order], return_index=True, return_counts=True)
                sums[p, used] += np.add.reduceat(own[order], first, axis=0)
                counts[p, used] += n
        at, rows = np.nonzero(counts), counts[counts > 0]
        ends = pa.array(np.arange(len(rows) + 1) * width, pa.int32())
        columns = [pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(rows), pa.ListArray.from_arrays(ends, pa.array(sums[at].ravel()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

    added = vectors.select(vector_col).mapInArrow(lean(run), "part int, entry int, n long, sums array<long>")
    total = added.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = books.entries.copy()
    for r in total.collect():
        out[r["part"], r["entry"], r["at"]] = r["x"] // r["n"]
    return Codebooks(out)


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all usable vectors, from those of the smallest ids.

    ``entries`` is at most 256. An id that repeats starts one entry, by its smallest vector; fewer ids make fewer
    entries. None if no usable row has an id.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: entries must be from 1 to 256")
    books = starts(vectors, id_col, vector_col, parts, entries)
    for _ in range(rounds if books else 0):
        books = moved(vectors, books, vector_col)
    return books


def encoded(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """The usable rows with their code (two hexadecimal digits for each part) and squared error instead of the vector."""
    others = [c for c in vectors.columns if c.lower() not in {vector_col.lower(), code.lower(), error.lower()}]
    fields = vectors.select(*others).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in blocks(batches, 0, books.dim):
            codes = books.codes(x)
            errors = ((x - books.decoded(codes)) ** 2).sum(axis=1)
            digits = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(digits, pa.string()), pa.array(errors, pa.int64())], names=[*others, code, error])

    return vectors.select(vector_col, *others).mapInArrow(lean(run), fields.add(code, "string").add(error, "long"))


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of each usable row of ``vectors``, which is read once a round.

    Left out are rows whose vector is null or holds a null or non-finite component, or has another length than that of the
    smallest id. Rows that repeat stay; a row with a null id is coded and counted but starts no codebook, and where no
    row has an id, or the table is empty, there are no rows. ``label_error`` adds the errors of rows of equal label, null
    labels together. Other columns are ignored, whatever their names. A component so large that squared distances could
    exceed a long is an error.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    books = fit(rows, "id", "vector", parts, entries, rounds)
    if books is None:
        return rows.filter(F.lit(False)).select(F.col("id").alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
    coded = materialise(encoded(rows, books, "vector"))
    of_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    both = spread_join(coded, of_label, "label", "rows")
    return both.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _oracle() -> str:
    rounds = ""
    for r in range(ROUNDS + 1):
        rounds += f"""
d{r} AS MATERIALIZED (SELECT rid, part, entry, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS dist FROM comps v JOIN c{r} c USING (part, pos) GROUP BY rid, part, entry),
a{r} AS MATERIALIZED (SELECT rid, part, entry, dist FROM d{r} QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY dist, entry) = 1),"""
        if r < ROUNDS:
            rounds += f"""
s{r} AS (SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM comps JOIN a{r} USING (rid, part) GROUP BY part, entry, pos),
c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{r} c LEFT JOIN s{r} USING (part, entry, pos)),"""
    return f"""
WITH usable AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT rid, unnest(range(len(embedding))) AS i, len(embedding) // {PARTS} AS width, unnest(embedding) AS x FROM usable),
comps AS MATERIALIZED (SELECT rid, i // width AS part, i % width AS pos, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM flat),
c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, pos, x FROM comps WHERE rid <= {ENTRIES}),{rounds}
codes AS (SELECT rid, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c{ROUNDS}) AS codebooks_sha256
FROM codes JOIN usable USING (rid)
"""


ORACLE_SQL = _oracle()
