"""Language identification: script ranges narrow the candidates, Viterbi labels spans.

Learning (documents outside the held-out fold, at most ``SAMPLE_DOCS`` of them per language): letter trigrams,
word ends included, and the scripts of letters are counted per language by a Spark aggregate. Only the
``MAX_GRAMS`` most frequent trigrams per language are kept, which bounds the model that is shipped to tasks.

Prediction: each distinct word of a batch is scored once per language (sum of log trigram probabilities); a
language that has less than ``SCRIPT_SHARE`` of its letters in the word's script is no candidate. A Viterbi
pass over a text's words, where changing the language costs ``SWITCH``, labels spans; many texts advance
together, one word a step. The language of most letters is the text's language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise, windows

SAMPLE_DOCS = 4000
MAX_GRAMS = 50_000
SCRIPT_SHARE = 0.01
SWITCH = 8.0
SMOOTH = 0.5
WINDOW_BYTES = 8_000_000
UNKNOWN = "und"
RESULT = "lang_pred string, score double, spans array<struct<lang:string,first_word:int,n_words:int>>"
#: First code points of the ranges of scripts, in order; letters of ranges named "other" are a script of their own.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2100, "latin"), (0x2190, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x2DE0, "cyrillic"), (0x2E00, "other"),
    (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB13, "other"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
)
_STARTS = np.array([s for s, _ in SCRIPTS], np.int64)
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF_RANGE = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words (runs of letters and their marks, lower-cased) of texts: code of each word, distinct words, and each text's first word."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), r"[^\p{L}\p{M}]+")
    coded = lists.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    # combining marks alone are no word, and an empty string isn't either
    word = pc.match_substring_regex(distinct, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
    if not word.all():
        kept = word[codes]
        offsets, codes = np.r_[0, np.cumsum(kept)][offsets], codes[kept]
        codes, distinct = (np.cumsum(word) - 1)[codes], distinct.filter(pa.array(word))
    return codes, distinct, offsets


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of words with a space at both ends (one per letter), each one's word, and the words' scripts by first letter."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    middle = np.flatnonzero(codes[1:-1] != 32) + 1
    keys = codes[middle - 1] << 42 | codes[middle] << 21 | codes[middle + 1]
    owner = np.cumsum(codes == 32)[middle] - 1
    first = middle[codes[middle - 1] == 32]
    return keys, owner, _SCRIPT_OF_RANGE[np.searchsorted(_STARTS, codes[first], side="right") - 1]


@dataclass
class Model:
    langs: list[str]  # most frequent first
    keys: np.ndarray  # trigrams, ascending
    logs: np.ndarray  # [trigram + 1, language]; the last row is for unknown trigrams
    allowed: np.ndarray  # [script, language]
    switch: float = SWITCH

    def word_scores(self, words: list[str]) -> np.ndarray:
        """[word, language]: sums of log probabilities. Languages that a word's script rules out score far below; words of no language's script score 0."""
        if not words:
            return np.zeros((0, len(self.langs)))
        keys, owner, scripts = trigrams(words)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        at = np.where(self.keys[at] == keys, at, len(self.keys)) if len(self.keys) else np.zeros(len(keys), np.int64)
        sums = np.add.reduceat(self.logs[at], np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), axis=0)
        ok = self.allowed[scripts]
        return np.where(ok.any(axis=1)[:, None], np.where(ok, sums, -1e4), 0.0)

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """The best language of each word of several texts; ``scores`` holds their words one text after another."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lengths)
        begins = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        at = 0
        while at < len(order):
            longest = int(lengths[order[at]])
            group = order[at : at + max(1, min(512, 2_000_000 // longest))]
            at += len(group)
            size = lengths[group]
            value, rows = scores[begins[group]], np.arange(len(group))
            came = np.zeros((longest, len(group), value.shape[1]), np.int16)
            stay = np.arange(value.shape[1])
            for t in range(1, longest):
                n = int(np.searchsorted(-size, -t))  # texts that still have a word
                best = value[:n].argmax(axis=1)
                jump = value[rows[:n], best][:, None] - self.switch
                moves = jump > value[:n]
                came[t, :n] = np.where(moves, best[:, None], stay)
                value[:n] = np.where(moves, jump, value[:n]) + scores[begins[group[:n]] + t]
            label = value.argmax(axis=1)
            path = np.zeros((longest, len(group)), np.int64)
            for t in range(longest - 1, -1, -1):
                n = int(np.searchsorted(-size, -t))
                path[t, :n] = label[:n]
                label[:n] = came[t, rows[:n], label[:n]]
            for i, g in enumerate(group.tolist()):
                out[g] = path[: size[i], i]
        return out

    def predict(self, texts: pa.Array) -> list[dict]:
        codes, distinct, offsets = words_of(texts)
        if not self.langs:
            return [{"lang_pred": UNKNOWN, "score": 0.0, "spans": []}] * len(texts)
        scores = self.word_scores(distinct.to_pylist())
        letters = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(float)
        sure = np.abs(scores).max(axis=1, initial=0) > 0
        labels = self.viterbi(scores[codes], np.diff(offsets))
        out = []
        for i, label in enumerate(labels):
            if not len(label):
                out.append({"lang_pred": UNKNOWN, "score": 0.0, "spans": []})
                continue
            mine = codes[offsets[i] : offsets[i + 1]]
            weight = np.bincount(label, letters[mine], len(self.langs))
            best = int(weight.argmax())
            known = letters[mine][sure[mine]].sum() / letters[mine].sum()
            cuts = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
            spans = [{"lang": self.langs[label[a]], "first_word": int(a), "n_words": int(b - a)} for a, b in zip(cuts, np.r_[cuts[1:], len(label)], strict=True)]
            out.append({"lang_pred": self.langs[best], "score": float(weight[best] / weight.sum() * (known + (1 - known) / len(self.langs))), "spans": spans})
        return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, max_grams: int = MAX_GRAMS, switch: float = SWITCH) -> Model:
    """A model from rows with a text and a language.

    Where a language has more than ``sample_docs`` rows, a share of them that is expected to hold that many is
    taken by the hash of the whole row's text and id, so that copies of one text are sampled like any rows. Of a
    language's trigrams the ``max_grams`` most frequent are kept (about 8 MB of counts a language); a language that has more of them,
    as those of very many letters do, is judged by those alone.
    """
    known = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not langs:
        return Model([], np.zeros(0, np.int64), np.zeros((1, 0)), np.zeros((len(_NAMES), 0), bool), switch)
    share = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, sample_docs / sizes[k]))])
    taken = known.filter(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in known.columns]), F.lit(1_000_000)) < F.element_at(share, F.col(lang_col)) * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in windows(batches, WINDOW_BYTES):
            lang = np.array(b.column(0).to_pylist(), object)
            for name in np.unique(lang):
                codes, distinct, _ = words_of(b.column(1).filter(pa.array(lang == name)))
                if not len(codes):
                    continue
                per_word = np.bincount(codes, minlength=len(distinct))
                keys, owner, scripts = trigrams(distinct.to_pylist())
                grams, back = np.unique(keys, return_inverse=True)
                letters = np.bincount(owner, minlength=len(distinct)) * per_word
                scr = np.bincount(scripts, letters, len(_NAMES))
                seen = np.flatnonzero(scr)
                ks = np.concatenate([grams, -1 - seen])
                ns = np.concatenate([np.bincount(back, per_word[owner]), scr[seen]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ks)), pa.array(ks), pa.array(ns)], names=["lang", "gram", "n"])

    pairs = taken.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(lean(count), "lang string, gram long, n long")
    # every language reads the sums below; texts are counted only once
    summed = materialise(pairs.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in summed.filter("gram >= 0").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    top = None
    for name in langs:
        part = summed.filter((F.col("lang") == name) & (F.col("gram") >= 0)).orderBy(F.desc("n"), "gram").limit(max_grams)
        top = part if top is None else top.unionByName(part)
    got = top.unionByName(summed.filter("gram < 0")).toPandas()
    return assemble(got, langs, totals, switch)


def assemble(got: pd.DataFrame, langs: list[str], totals: dict[str, int], switch: float) -> Model:
    grams = got[got["gram"] >= 0]
    keys = np.unique(grams["gram"].to_numpy(np.int64))
    counts = np.zeros((len(keys) + 1, len(langs)))
    col = grams["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    np.add.at(counts, (np.searchsorted(keys, grams["gram"].to_numpy(np.int64)), col), grams["n"].to_numpy(float))
    total = np.array([float(totals.get(x, 0)) for x in langs])
    logs = np.log((counts + SMOOTH) / (total + SMOOTH * (len(keys) + 1)))
    scripts = np.zeros((len(_NAMES), len(langs)))
    for r in got[got["gram"] < 0].itertuples():
        scripts[-1 - r.gram, langs.index(r.lang)] = r.n
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    return Model(langs, keys, logs, allowed, switch)


def language_column(text: Column, model: Model) -> Column:
    """A struct column: lang_pred, score, and spans (lang, first_word, n_words) in words of letters."""

    @F.pandas_udf(RESULT)
    def predict(texts: pd.Series) -> pd.DataFrame:
        batch, rows = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), []
        for b in windows(iter([batch]), WINDOW_BYTES, 0):
            rows += model.predict(b.column(0))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "spans"])

    return predict(text)


def identified(docs: DataFrame, model: Model, text_col: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct column ``name``: lang_pred, score and spans; a clashing column is replaced.

    Texts that are null, empty or without a letter (combining marks are none) get ``und`` and score 0, and so does
    every text if nothing was learned. Very long texts are labelled whole, repeated rows each get the same result, an
    empty table gives no rows. Equal weights go to the language with more learning rows, then the smaller name. The score is the
    share of letters in spans of the language, where letters of scripts that were never learned count as a guess.
    """
    return docs.withColumn(name, language_column(F.col(text_col), model))
