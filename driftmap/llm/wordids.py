"""Token ids of whole texts, with the tokenizers library asked once for each new word.

The vocabulary drops white space before its merges, so a text's ids are the ids of its
space-separated words in order. Words are kept with their ids in a bounded table. A new word
of plain Latin-1 letters is the ids of its pieces (the pre-tokenizer's own pattern), kept in
a second table; new pieces go to the library's merges, all other words to the whole library.

``WordTable`` does the same for many rows at once: words of up to ``LONG`` bytes are found by those
bytes, A-Z as a-z, in arrays of a tenth of a dictionary's size.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np

_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+\Z")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: How byte-level vocabularies write the bytes that don't print.
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
#: Python splits at these, the tokenizer doesn't.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
assert sys.byteorder == "little" and array("I").itemsize == 4
_ENCODERS: dict[str, "WordEncoder"] = {}


class _Table(dict):
    """A bounded table that makes what it lacks; when full it starts anew, so it never changes a result."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) < 100:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class WordEncoder:
    """``ids(text)`` gives little-endian uint32 ids, as ``Tokenizer.encode`` does without special tokens."""

    def __init__(self, path: str, most: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size(True)
        self.words = _Table(self._word, most)
        self.parts = _Table(self._piece, most)
        self.model = self.tok.model
        # word-wise encoding holds for this family only: the library's own way serves any other file
        config = self.tok.to_str()
        self.by_word = '"end_of_word_suffix":"</w>"' in config and r"[^\\s\\p{L}\\p{N}]+" in config and '"Lowercase"' in config

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """One piece by the library's merges alone; what comes before them is done."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(_BYTE_LEVEL)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _word(self, word: str) -> bytes:
        if _PLAIN.match(word) and "<|" not in word:
            return b"".join(map(self.parts.__getitem__, _PIECES.findall(word.lower())))
        return self._whole(word)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or any(c in text for c in _NOT_SPACE):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


#: Bytes of a word that a table can hold, and words that are looked up at once.
LONG, STEP = 24, 1 << 17
_BELOW = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordTable:
    """Ids of words in numpy arrays: open addressing over the words' hashes, equality by all their bytes.

    When full it starts anew, so it never changes a result. Words that are longer than ``LONG``
    bytes, or have a ``<`` (the special tokens do, and they tell cases apart), are asked one by one.
    """

    def __init__(self, path: str, bits: int = 21, most_parts: int = 1 << 18):
        self.encoder = WordEncoder(path, most_parts)
        self.size, self.by_word = self.encoder.size, self.encoder.by_word
        self.bits, self.most = bits, 1 << (bits - 1)
        # a word's 24 bytes, and its first id's place, number of ids and length as one number: a look-up reads one cache line
        self.words = np.zeros((1 << bits, 4), dtype=np.uint64)
        self.pool, self.used, self.n = np.zeros(1 << 16, dtype=np.uint32), 0, 0

    def _put(self, ids: bytes, at: int) -> int:
        """Writes ids into the pool and says how many."""
        new = np.frombuffer(ids, dtype=np.uint32)
        while at + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[at : at + len(new)] = new
        return len(new)

    def ids(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words data[s:e], one word after the other, and how many each has; h: hashes that are equal for words equal but for A-Z."""
        low = np.zeros(len(data) + LONG + 8, dtype=np.uint8)
        low[: len(data)] = _LOWER[data]
        window = np.ndarray(len(data) + LONG, dtype="<u8", buffer=low, strides=(1,))
        raw = data.tobytes()
        odd = np.zeros(len(s), dtype=bool)
        odd[np.searchsorted(s, np.flatnonzero(data == ord("<")), "right") - 1] = True
        out = [self._some(raw, window, s[i : i + STEP], e[i : i + STEP], h[i : i + STEP], odd[i : i + STEP]) for i in range(0, len(s), STEP)]
        return (np.concatenate([x for x, _ in out]), np.concatenate([c for _, c in out])) if out else (np.empty(0, np.uint32), np.empty(0, np.int64))

    def _some(self, raw: bytes, window: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.n + len(s) > self.most:
            self.words.fill(0)
            self.used = self.n = 0
        size = e - s
        odd = odd | (size > LONG)
        own = np.zeros((len(s), 3), dtype=np.uint64)
        own[:, 0] = window[s] & _BELOW[np.minimum(size, 8)]
        for k in (1, 2):
            at = np.flatnonzero(size > 8 * k)
            own[at, k] = window[s[at] + 8 * k] & _BELOW[np.minimum(size[at] - 8 * k, 8)]
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        found = np.zeros(len(s), dtype=np.int64)
        todo, missing = np.flatnonzero(~odd), []
        while len(todo):
            there = self.words[slot[todo]]
            tail, mine = there[:, 3].view(np.int64), own[todo]
            same = (tail & 255 == size[todo]) & (there[:, 0] == mine[:, 0]) & (there[:, 1] == mine[:, 1]) & (there[:, 2] == mine[:, 2])
            found[todo[same]] = tail[same]
            missing.append(todo[tail == 0])
            todo = todo[~same & (tail != 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        missing = np.concatenate(missing) if missing else np.empty(0, np.int64)
        if len(missing):
            found[missing] = self._new(raw, s, e, own, slot, missing)
        count, start = found >> 8 & 0xFFFF, found >> 24
        at, words = self.used, self.encoder.words
        for i in np.flatnonzero(odd).tolist():
            start[i], count[i] = at, self._put(words[raw[s[i] : e[i]].decode()], at)
            at += count[i]
        ends = np.cumsum(count)
        return self.pool[np.repeat(start - ends + count, count) + np.arange(ends[-1])], count

    def _new(self, raw: bytes, s: np.ndarray, e: np.ndarray, own: np.ndarray, slot: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """Enters the words at ``missing``, each once, and gives what the table holds for each."""
        known: dict[bytes, int] = {}
        entry, first, ids, word, piece = [], [], [], self.encoder._word, self.encoder.parts.__getitem__
        for i, a, b in zip(missing.tolist(), s[missing].tolist(), e[missing].tolist()):
            key = raw[a:b].lower()
            n = known.setdefault(key, len(first))
            if n == len(first):
                first.append(i)
                # letters alone are one piece
                ids.append(piece(key.decode()) if key.isalpha() else word(key.decode()))
            entry.append(n)
        first, count = np.array(first), np.array([len(x) // 4 for x in ids])
        tail = (self.used + np.cumsum(count) - count << 24) | count << 8 | (e[first] - s[first])
        self.used += self._put(b"".join(ids), self.used)
        self.n += len(first)
        new, at = np.column_stack([own[first], tail.view(np.uint64)]), slot[first]
        left = np.arange(len(first))
        while len(left):
            free = left[self.words[at[left], 3] == 0]
            self.words[at[free]] = new[free]
            # of those that want one place the last has it: a place in the pool is a word's own
            left = left[self.words[at[left], 3] != new[left, 3]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        return tail[np.array(entry)]


_TABLES: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    """One table for each Python worker and file."""
    if path not in _TABLES:
        _TABLES[path] = WordTable(path)
    return _TABLES[path]
