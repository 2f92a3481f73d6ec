"""Outside services as injected clients: embedders, tokenizers, encoders, paraphrase models, hidden-state providers.

Real clients are the user's: any picklable object with the method below. Credentials come from its constructor,
never from this package. The classes here are deterministic stand-ins for tests and dry runs.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator
from dataclasses import MISSING, dataclass, fields
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pooling import METHODS, pad_tokens


@dataclass(frozen=True)
class Api:
    """How a paraphrase service is reached. The defaults here and below are fixed values."""

    base_url: str
    api_key: str
    model: str
    temperature: float = 0.7
    max_tokens: int = 4096
    reasoning: dict | None = None

    def __post_init__(self) -> None:
        if not self.api_key.strip():
            raise ValueError("api.api_key must not be empty")


@dataclass(frozen=True)
class Processing:
    batch_size: int = 50
    max_retries: int = 3
    retry_delay: float = 5
    concurrency: int = 3


@dataclass(frozen=True)
class Prompt:
    system: str
    user_template: str = "{lines}"
    strict: str = ""


@dataclass(frozen=True)
class Settings:
    api: Api
    prompt: Prompt
    processing: Processing = Processing()


def read_settings(text: str) -> Settings:
    """Settings from JSON with the parts api, prompt and, if wanted, processing; a KeyError names what is missing, other keys are ignored."""
    data = json.loads(text)

    def part(kind: type, name: str):
        given = data[name] if name != "processing" else data.get(name, {})
        lacking = [f.name for f in fields(kind) if f.default is MISSING and f.name not in given]
        if lacking:
            raise KeyError(f"{name}.{lacking[0]}")
        return kind(**{f.name: given[f.name] for f in fields(kind) if f.name in given})

    return Settings(part(Api, "api"), part(Prompt, "prompt"), part(Processing, "processing"))


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Paraphraser(Protocol):
    def paraphrase(self, lines: list[str], strict: bool) -> str: ...


class Tokenizer(Protocol):
    pad: int

    def ids(self, texts: list[str]) -> list[list[int]]: ...


class Encoder(Protocol):
    """A vector for each row of token ids and masks, all of one length."""

    def encode(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray: ...


class HiddenStates(Protocol):
    """One forward pass: for each layer the last token's attention to every position (None: no attention), and the positions' vectors."""

    def states(self, text: str) -> list[tuple[np.ndarray | None, np.ndarray]]: ...


class HashEmbedder:
    """A vector of ``dim`` numbers from a text's hash."""

    def __init__(self, dim: int = 16):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little")
            out.append(np.random.default_rng(seed).standard_normal(self.dim).tolist())
        return out


class CountEmbedder:
    """Vectors from a text's length, so that SQL can check them."""

    def __init__(self, dim: int = 16):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[len(t) * (i + 1) % 17 for i in range(self.dim)] for t in texts]


class WordLengths:
    """A word's length is its token."""

    pad = 0

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [[len(w) for w in t.split(" ")] for t in texts]


class SumEncoder:
    """Vectors from the sum of ids weighted by their places and the number of real ones."""

    def __init__(self, dim: int = 128):
        self.dim = dim

    def encode(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        total = (ids * mask * np.arange(1, ids.shape[1] + 1)).sum(axis=1)
        return (total[:, None] + np.arange(self.dim) * mask.sum(axis=1)[:, None]) % 101 / 101


class WordStates:
    """Layers of states made up from the lengths and places of words; the first layer has no attention."""

    def __init__(self, layers: int = 3, dim: int = 8):
        self.layers, self.dim = layers, dim

    def states(self, text: str) -> list[tuple[np.ndarray | None, np.ndarray]]:
        n = np.array([len(w) for w in text.split(" ")])
        at = np.arange(len(n))
        vectors = lambda layer: (n[:, None] * np.arange(1, self.dim + 1) + (3 * at + 7 * layer)[:, None]) % 17 / 17
        return [(1.0 + (n + at) % 5 if layer else None, vectors(layer)) for layer in range(self.layers)]


class EchoClient:
    """Answers each line with itself; the first, not strict, answer of a batch of an odd number of lines lacks a line."""

    def paraphrase(self, lines: list[str], strict: bool) -> str:
        return "\n".join(lines if strict or len(lines) % 2 == 0 else lines[1:])


def with_retries(call, tries: int, wait: float):
    """``call()``, again after ``wait`` seconds if it raises, ``tries`` times at most."""
    for attempt in range(1, tries + 1):
        try:
            return call()
        except Exception:
            if attempt == tries:
                raise
            time.sleep(wait)


def embedded(rows: DataFrame, embedder: Embedder, text: str = "text", batch: int = 256, tries: int = 3, wait: float = 0.0, name: str = "vector") -> DataFrame:
    """``rows`` with a column of vectors from the embedder, asked ``batch`` texts at a time; null texts get null."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out: list = [None] * len(s)
            known = [i for i, t in enumerate(s) if t is not None]
            for at in range(0, len(known), batch):
                part = known[at : at + batch]
                for i, v in zip(part, with_retries(lambda p=part: embedder.embed([s.iloc[i] for i in p]), tries, wait), strict=True):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out, dtype=object)

    return rows.withColumn(name, vectors(text))


def tokenized(rows: DataFrame, tokenizer: Tokenizer, text: str = "text", length: int = 128) -> DataFrame:
    """``rows`` with columns ids and mask: a text's token ids cut or filled to ``length``, and which are real; null texts have none."""

    @F.pandas_udf("array<int>")
    def ids(s: pd.Series) -> pd.Series:
        return pd.Series(tokenizer.ids(s.fillna("").tolist()), dtype=object)

    own = F.when(F.col(text).isNotNull(), ids(text)).otherwise(F.array().cast("array<int>"))
    filled, mask = pad_tokens(F.col("ids"), tokenizer.pad, length)
    return rows.withColumn("ids", own).withColumn("mask", mask).withColumn("ids", filled)


def encoded(rows: DataFrame, encoder: Encoder, batch: int = 256, name: str = "vector") -> DataFrame:
    """``rows`` (ids, mask, of one length) with a column of vectors from the encoder, asked ``batch`` rows at a time."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, mask in batches:
            out = []
            for at in range(0, len(ids), batch):
                out += list(encoder.encode(np.stack(ids.iloc[at : at + batch].to_list()), np.stack(mask.iloc[at : at + batch].to_list())).astype(np.float32))
            yield pd.Series(out, dtype=object)

    return rows.withColumn(name, vectors("ids", "mask"))


def hidden_states(rows: DataFrame, provider: HiddenStates, key: str, text: str) -> DataFrame:
    """(key, layer, pos, attn, vec): a row for each layer and position of a text; attn is null in layers without attention.

    One text at a time leaves the task. Where only pooled vectors are wanted, ``pooled_states`` saves the shuffle of
    positions. Null texts have no rows.
    """

    def parts(states):
        for layer, (attn, x) in enumerate(states):
            n = len(x)
            yield n, {"layer": [layer] * n, "pos": list(range(n)), "attn": [None] * n if attn is None else list(map(float, attn)), "vec": list(np.asarray(x, float))}

    return _per_text(rows, provider, key, text, parts, "layer int, pos int, attn double, vec array<double>")


def pooled_states(rows: DataFrame, provider: HiddenStates, key: str, text: str) -> DataFrame:
    """(key, layer, pool, vec) by each of ``pooling.METHODS``, pooled in the task that has the text's states; null texts have no rows."""

    def parts(states):
        for layer, (attn, x) in enumerate(states):
            x = np.asarray(x, float)
            weights = None if attn is None else attention_weights(np.asarray(attn, float))
            pooled = [x[-1] if weights is None or m == "last" else weights[m] @ x for m in METHODS]
            yield len(METHODS), {"layer": [layer] * len(METHODS), "pool": list(METHODS), "vec": pooled}

    return _per_text(rows, provider, key, text, parts, "layer int, pool string, vec array<double>")


def attention_weights(attn: np.ndarray) -> dict[str, np.ndarray]:
    """The weights of ``pooling.attention`` for one text."""
    share = attn / (attn.sum() + 1e-10)
    comp, inv = 1 - share, 1 / (share + 1e-8)
    return {"attn": share, "comp": comp / (comp.sum() + 1e-10), "inv": inv / (inv.sum() + 1e-10)}


def _per_text(rows: DataFrame, provider: HiddenStates, key: str, text: str, parts, columns: str) -> DataFrame:
    """The rows that ``parts`` makes of each text's states, beside the key; a batch leaves the task for each layer."""
    kept = rows.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                for n, cells in parts(provider.states(b.column(1)[i].as_py())):
                    own = b.column(0).take(pa.array([i] * n))
                    arrays = [pa.array(v, KINDS[c]) for c, v in cells.items()]
                    yield pa.RecordBatch.from_arrays([own, *arrays], names=["key", *cells])

    kind = kept.schema["key"].dataType.simpleString()
    return kept.mapInArrow(run, f"key {kind}, {columns}").withColumnRenamed("key", key)


KINDS = {"layer": pa.int32(), "pos": pa.int32(), "attn": pa.float64(), "pool": pa.string(), "vec": pa.list_(pa.float64())}
