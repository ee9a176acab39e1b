"""Token ids of whole texts, through a bounded memory of words already encoded.

The vocabulary ``word_bpe_49k`` drops white space and never joins characters
across it, so the ids of a text are those of its white-space-separated words
in turn.  Every word's ids come from the public tokenizer; a worker keeps them
by a 64-bit hash of the word and its length, and asks the tokenizer only for
words it has not met.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from pagesift.llm.common import U64, pieces, space_flags, span_hashes

KEPT_WORDS = 600_000
TEXT_BYTES = 2 << 20
ID = np.dtype("<u4")
# Byte classes for cuts inside words: 1 an ASCII letter or digit, 2 ASCII
# punctuation but the apostrophe (contractions), 0 all else.
_CLASS = np.array([1 if chr(c).isalnum() else 2 if 32 < c < 127 and c != 0x27 else 0
                   for c in range(128)] + [0] * 128, np.int8)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _part_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the words, cut also where the vocabulary's pre-tokens end for
    certain: between an ASCII letter or digit and punctuation."""
    kind = _CLASS[buf]
    space = space_flags()[buf]
    start = ~space
    start[1:] &= space[:-1] | (kind[1:] + kind[:-1] == 3) & (kind[1:] != kind[:-1])
    starts = np.flatnonzero(start)
    end = ~space
    end[:-1] &= space[1:] | start[1:]
    return starts, np.flatnonzero(end) + 1


class WordEncoder:
    """Ids of texts as arrays of little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        vocab = self.model.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.model.get_vocab_size() + 1, bool)
        self.ends[[i for word, i in vocab.items() if word.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """Known words: sorted hashes, where each one's ids start in the store,
        how many they are."""
        self.hashes, self.at, self.size = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, ID)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, ID) for e in found]

    def _ask(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``words`` end to end and how many each has.  Words of letters
        go in one text, cut at the ids that end a word; others one by one."""
        found: list[np.ndarray | None] = [None] * len(words)
        letters = [i for i, w in enumerate(words) if w.isalpha()]
        joined = [letters[i:i + 2000] for i in range(0, len(letters), 2000)]
        for part, ids in zip(joined, self.plain([" ".join([words[i] for i in p]) for p in joined])):
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part) and cut[-1] == len(ids):
                for i, got in zip(part, np.split(ids, cut[:-1])):
                    found[i] = got
        others = [i for i, got in enumerate(found) if got is None]
        for i, got in zip(others, self.plain([words[i] for i in others])):
            found[i] = got
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids, size = self._ask(words)
        at = np.cumsum(size) - size + len(self.store)
        self.store = np.concatenate([self.store, ids])
        where = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, where, hashes)
        self.at = np.insert(self.at, where, at)
        self.size = np.insert(self.size, where, size)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        # A text with "<|" may hold a special token, matched before lower-casing.
        raw = {i: self.plain([t.decode("utf-8", "replace")])[0]
               for i, t in enumerate(texts) if b"<|" in t}
        plain = [b"" if i in raw else t for i, t in enumerate(texts)]
        whole = b"\n".join(plain)
        buf = np.frombuffer(whole, np.uint8)
        starts, ends = _part_spans(buf)
        hashes, inverse, first = _distinct(span_hashes(buf, starts, ends, lower=True) ^
                                           (ends - starts).astype(U64))
        if len(self.hashes) > KEPT_WORDS:
            self._forget()
        place = np.searchsorted(self.hashes, hashes)
        new = np.flatnonzero(place == len(self.hashes)) if not len(self.hashes) else np.flatnonzero(
            self.hashes[np.minimum(place, len(self.hashes) - 1)] != hashes)
        if len(new):
            self._learn(hashes[new], [whole[a:b].decode("utf-8", "replace") for a, b in
                                      zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            place = np.searchsorted(self.hashes, hashes)
        at, size = self.at[place][inverse], self.size[place][inverse]
        total = np.r_[0, np.cumsum(size)]
        ids = self.store[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        doc = np.cumsum([0] + [len(t) + 1 for t in plain])
        cut = total[np.searchsorted(starts, doc)]
        return [raw[i] if i in raw else ids[cut[i]:cut[i + 1]] for i in range(len(texts))]


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, for each element its place there, and for each
    value one place in ``x``."""
    order = np.argsort(x)
    s = x[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    inverse = np.empty(len(x), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return s[new], inverse, order[new]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    return WordEncoder(path)


def encode_all(path: str, texts: list[bytes]) -> list[np.ndarray]:
    """Ids of ``texts``, for a bounded number of text bytes at a time."""
    model, out = encoder(path), []
    for a, b in pieces(texts, TEXT_BYTES):
        out += model.encode(texts[a:b])
    return out
