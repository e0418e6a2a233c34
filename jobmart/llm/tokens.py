"""Token ids of whole texts, by a tokenizer file of the ``tokenizers`` library.

Vocabularies that drop white space give a text the ids of its words, one after the other.
For those the ids of each distinct word are kept per Python worker, in a cache of a fixed
number of entries, and only new words go through the library. Whether a tokenizer is of that
kind is probed when it is loaded; any other one encodes whole texts.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

CACHE_WORDS = 300_000
CACHE_STEMS = 500_000
#: White space of every kind, letters with marks, digits, signs, contractions: the words of
#: this text, encoded alone, must give the ids of the text for the cache to be used.
PROBE = "Ab'll  céd\téf\n12 ß.\x0bx,\x0cy!! \r <|endoftext|> İZ aΣ 中文 it's ́q"
#: Latin letters, then ASCII signs but no apostrophe, which may join a contraction, and no
#: mark that opens a special token.
PLAIN = re.compile(
    rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:;=-@\[-`{-~]*)"
).fullmatch


def _visible_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others take the
    code points from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes, without special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}
        self.alphabet = _visible_bytes()
        self.by_word = self._whole([PROBE])[0] == b"".join(
            self._whole([w.decode() for w in PROBE.encode().split()])
        )
        self.plain = self.by_word and self._plain_agrees()

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _plain_agrees(self) -> bool:
        """Words of Latin letters and signs may go straight to the model if the normalizer
        and the splitter do no more than lower their case and split the signs off."""
        words = "A the Thonandreere. x, OUERTION!! zzqq### naïve Éßø$$$ (x dont_".split()
        try:
            alone = [self._learn([w.encode()])[w.encode()] for w in words]
        except Exception:  # a model without this entry point
            return False
        self.stems = {}
        return alone == self._whole(words)

    def _stem(self, part: bytes) -> bytes:
        visible = part.decode().lower().encode().decode("latin-1").translate(self.alphabet)
        ids = array("I", [t.id for t in self.tokenizer.model.tokenize(visible)]).tobytes()
        self.stems[part] = ids
        return ids

    def _learn(self, new: Iterable[bytes], plain: bool = True) -> dict[bytes, bytes]:
        """Ids of words that are not in the cache. Words that are not plain go through the
        library joined by spaces; an id belongs to the word in which its offset lies."""
        found: dict[bytes, bytes] = {}
        rest: list[bytes] = []
        if len(self.stems) > CACHE_STEMS:
            self.stems = {}
        stems, stem = self.stems, self._stem
        for word in new:
            m = PLAIN(word) if plain else None
            if m is None:
                rest.append(word)
                continue
            head, tail = m.groups()
            head = head.lower()
            ids = stems.get(head) or stem(head)
            if tail:
                ids += stems.get(tail) or stem(tail)
            found[word] = ids
        for at in range(0, len(rest), 512):
            some = rest[at : at + 512]
            texts = [w.decode("utf-8", "replace") for w in some]
            got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            ends = np.cumsum([len(t) + 1 for t in texts])
            begins = np.fromiter((a for a, _ in got.offsets), np.int64, len(ids))
            cuts = np.searchsorted(begins, ends[:-1], "left")
            found.update(zip(some, (x.tobytes() for x in np.split(ids, cuts)), strict=True))
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return self._whole([t.decode("utf-8", "replace") for t in texts])
        split = [t.split() for t in texts]
        words = set().union(*split)
        new = words.difference(self.words)
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words, new = {}, words
        known = self.words
        known.update(self._learn(new, self.plain))
        return [b"".join([known[w] for w in x]) for x in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker; the vocabulary is installed on every machine."""
    return Encoder(path)


def slices(texts: list[bytes], most: int = 2 << 20) -> Iterable[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes together, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
