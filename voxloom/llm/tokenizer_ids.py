"""Token ids of whole texts by a public tokenizer file, with a bounded cache of words per Python worker.

The tokenizer splits at white space before anything else, and drops it; so a text's ids are those of its
words one after another, and each distinct word needs the library only once per worker.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import strings

#: Bytes that a worker's cache of words may take; it takes no more words then. Each needs about ``ENTRY`` beside its characters.
CACHE_BYTES, ENTRY = 64_000_000, 130
_LATIN_END = "ɐ"
_TAIL = re.compile(r"(?<=[A-Za-z0-9])([!-&(-/:-@\[-`{-~]+)$")


class WordIds:
    """Ids of words and texts. A word's place in the cache is found by one hash lookup, however large the cache is."""

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.place: dict[str, int] = {}
        self.room = CACHE_BYTES
        self.flat, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)  # ids of word i: flat[ends[i]:ends[i + 1]]

    def ids_of(self, words: list[str]) -> list[np.ndarray]:
        """The library's ids of words. Plain Latin words go to it joined by spaces, a word's final marks by themselves."""
        out: dict[str, np.ndarray] = {}
        tails = {w: (w[: m.start()], m[1]) for w in words if not w.isalpha() and "<|" not in w and (m := _TAIL.search(w))}
        parts = list({x for ab in tails.values() for x in ab})
        for x in parts:
            i = self.place.get(x)
            if i is not None:
                out[x] = self.flat[self.ends[i] : self.ends[i + 1]]
        rest = {x for x in (*words, *parts) if x not in out and x not in tails}
        plain = [x for x in rest if x.isalpha() and max(x) < _LATIN_END]
        self.ask_joined(plain, out)
        self.ask([x for x in rest if x not in out], out)
        return [np.concatenate([out[tails[w][0]], out[tails[w][1]]]) if w in tails else out[w] for w in words]

    def ask(self, words: list[str], out: dict[str, np.ndarray]) -> None:
        for w, e in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False), strict=True):
            out[w] = np.array(e.ids, "<u4")

    def ask_joined(self, plain: list[str], out: dict[str, np.ndarray], chunk: int = 20_000) -> None:
        for at in range(0, len(plain), chunk):
            part = plain[at : at + chunk]
            e = self.library.encode(" ".join(part), add_special_tokens=False)
            owner = np.array(e.word_ids, np.int64)
            if owner[-1:].tolist() == [len(part) - 1]:  # else a word that the library splits or drops: asked one by one
                out.update(zip(part, np.split(np.array(e.ids, "<u4"), np.searchsorted(owner, np.arange(1, len(part)))), strict=True))

    def lookup(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, starts, sizes) of the ids of distinct words. The cache takes new words until it is full."""
        plain = pc.and_(pc.string_is_ascii(vocab), pc.invert(pc.match_substring(vocab, "<|")))
        keys = strings(pc.if_else(plain, pc.ascii_lower(vocab), vocab))
        at, flat, ends = np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys)), self.flat, self.ends
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            asked = keys[unknown].tolist()
            new = {w: i for i, w in enumerate(dict.fromkeys(asked), len(ends) - 1)}
            ids = self.ids_of(list(new))
            at[unknown] = [new[w] for w in asked]
            flat = np.concatenate([flat, *ids])
            ends = np.concatenate([ends, ends[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
            if self.room > 0:
                self.place.update(new)
                self.room -= sum(map(len, new)) + ENTRY * len(new)
                self.flat, self.ends = flat, ends
        return flat, ends[at], ends[at + 1] - ends[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts, one after another, and where each text's begin (and the last's end)."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        flat, starts, sizes = self.lookup(coded.dictionary)
        per_word = sizes[codes]
        ends = np.cumsum(per_word)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(starts[codes] - (ends - per_word), per_word) + np.arange(total)] if total else flat[:0]
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return ids, np.r_[0, ends][offsets]


_LOADED: dict[str, WordIds] = {}


def loaded(name: str) -> WordIds:
    """This worker's cache for a tokenizer file."""
    if name not in _LOADED:
        _LOADED[name] = WordIds(name)
    return _LOADED[name]
