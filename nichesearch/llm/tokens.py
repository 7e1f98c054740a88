"""Encoding texts with a public tokenizer's library, each distinct chunk of a text once.

A byte-level BPE model splits a text by a fixed pattern and encodes each piece on its own.
No piece reaches over a single space or line feed that stands between two other characters:
the space opens the next piece, the line feed is one of its own. Nor does any begin with a
letter or digit and go on to a punctuation mark. So a text may be cut before each of these, and every distinct chunk is encoded once and looked up afterwards. A 64-bit
hash finds the place, and the chunk's bytes are compared with those kept there: a chunk whose
hash another one has goes to the library, as do chunks of more than ``LONG`` bytes. That is done under such a model for texts without unusual white space or the strings of
special tokens; all others go to the library whole. Tokenizers are read from the path given,
never trained and never copied.

What a worker keeps is bounded by the bytes of its arrays. Beyond that it keeps the chunks
met more than once since it last made room.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import types
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np

#: White space beyond ASCII's usual four: texts with any go to the library whole.
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Chunks, and bytes of chunks with their ids, that one Python worker keeps: some 60 MB with its tables.
MAX_CHUNKS, MAX_BYTES = 1_000_000, 32 << 20
#: Bytes of the longest chunk that is kept.
LONG = 256
_JOINED = 256
#: Characters that are looked up at once, and after which a long text is cut (at a chunk's begin).
_AT_ONCE = 1 << 18
_CUT = re.compile(r"(?<=[^\s])[ \n](?=[^\s])")


def digest(path: str) -> str:
    """Of the tokenizer: its file and its library's version."""
    name = "sentencepiece" if path.endswith(".model") else "tokenizers"
    version = __import__(name).__version__
    return hashlib.sha256(Path(path).read_bytes() + f"\0{name} {version}".encode()).hexdigest()


def encoder(path: str) -> Encoder | PieceEncoder:
    """The encoder of ``path``, kept for as long as this Python process lives."""
    kept = sys.modules.setdefault("_nichesearch_kept", types.ModuleType("_nichesearch_kept")).__dict__
    if path not in kept:
        kept[path] = PieceEncoder(path) if path.endswith(".model") else Encoder(path)
    return kept[path]


class PieceEncoder:
    """sentencepiece: texts go to the library whole."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode(texts, num_threads=1)
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def count(self, texts: list[str]) -> np.ndarray:
        return self.encode(texts)[1]


class Table:
    """64-bit hashes to places 0, 1, 2 ... in the order of insertion: open addressing, whole arrays at a time."""

    def __init__(self, capacity: int):
        self.bits = max(10, (4 * capacity // 3).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.zeros(1 << self.bits, np.int32)
        self.n = 0

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places, or -1."""
        found, slots, left = np.full(len(hashes), -1, np.int32), self._slots(hashes), np.arange(len(hashes))
        while len(left):
            keys = self.keys[slots]
            same = keys == hashes[left]
            found[left[same]] = self.values[slots[same]]
            on = ~same & (keys != 0)
            left, slots = left[on], (slots[on] + 1) & (len(self.keys) - 1)
        return found

    def hashes(self) -> np.ndarray:
        """By place."""
        used = np.flatnonzero(self.keys)
        found = np.zeros(self.n, np.uint64)
        found[self.values[used]] = self.keys[used]
        return found

    def add(self, hashes: np.ndarray) -> None:
        """Distinct hashes that it lacks."""
        places, slots = np.arange(self.n, self.n + len(hashes)), self._slots(hashes)
        self.n += len(hashes)
        while len(places):
            _, first = np.unique(slots, return_index=True)
            first = first[self.keys[slots[first]] == 0]
            self.keys[slots[first]], self.values[slots[first]] = hashes[first], places[first]
            on = np.ones(len(places), bool)
            on[first] = False
            hashes, places, slots = hashes[on], places[on], (slots[on] + 1) & (len(self.keys) - 1)


class Rows:
    """Rows of different lengths behind each other in one growing array."""

    def __init__(self, dtype: type):
        self.flat, self.starts, self.sizes = np.zeros(1 << 12, dtype), np.zeros(1 << 10, np.int32), np.zeros(1 << 10, np.uint16)
        self.n = self.used = 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        starts = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        for name, at, values in (("flat", self.used, flat), ("starts", self.n, starts), ("sizes", self.n, sizes)):
            own = getattr(self, name)
            if at + len(values) > len(own):
                grown = np.zeros(max(len(own) * 5 // 4, at + len(values)), own.dtype)
                grown[:at] = own[:at]
                own = grown
                setattr(self, name, own)
            own[at : at + len(values)] = values
        self.n, self.used = self.n + len(sizes), self.used + len(flat)

    def take(self, places: np.ndarray) -> np.ndarray:
        """The rows at the places, behind each other."""
        return self.flat[spread(self.starts[places], self.sizes[places])]

    def keep(self, places: np.ndarray) -> None:
        flat, sizes = self.take(places), self.sizes[places]
        self.__init__(self.flat.dtype.type)
        self.add(flat, sizes)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1 ... of each row, as many as its size."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """The tokenizers library, without added special tokens, truncation or padding."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        stated = json.loads(Path(path).read_text())
        split = stated.get("pre_tokenizer") or {}
        self.special = [x["content"] for x in stated.get("added_tokens") or []]
        self.by_chunk = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not stated.get("normalizer") and not stated["model"].get("dropout")
        self.opens = np.zeros(self.library.get_vocab_size(), bool)  # tokens that begin with a space
        for token, i in self.library.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.space = np.zeros(256, bool)
        self.space[list(b" \t\n\r")] = True
        self.cut = np.zeros(256, bool)
        self.cut[list(b" \n")] = True
        self.word, self.mark, self.latin = np.zeros((3, 256), bool)
        self.word[[x for x in range(128) if chr(x).isalnum()]] = True
        self.mark[[x for x in range(33, 127) if not chr(x).isalnum()]] = True
        self.latin[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True  # second bytes of À to ÿ without × and ÷
        self.clear()

    def clear(self) -> None:
        self.table = Table(MAX_CHUNKS)
        self.uses, self.bytes = np.zeros(MAX_CHUNKS, np.uint8), np.zeros(MAX_CHUNKS, np.uint16)
        self.chunks, self.ids = Rows(np.uint64), Rows(np.uint32)  # a chunk's words of eight bytes

    def _full(self, more: int) -> bool:
        return self.table.n + more > MAX_CHUNKS or 8 * self.chunks.used + 4 * self.ids.used > MAX_BYTES

    def _make_room(self) -> None:
        """Keep what was met again, if that is less than half."""
        n = self.table.n
        places = np.flatnonzero(self.uses[:n] > 1)
        hashes, own, chunks, ids = self.table.hashes()[places], self.bytes[places], self.chunks, self.ids
        half = 2 * (8 * int(chunks.sizes[places].sum()) + 4 * int(ids.sizes[places].sum())) <= MAX_BYTES and 2 * len(places) <= MAX_CHUNKS
        self.clear()
        if half and len(places):
            chunks.keep(places)
            ids.keep(places)
            self.chunks, self.ids = chunks, ids
            self.bytes[: len(places)] = own
            self.table.add(hashes)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _encoded(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, and the number of each one's.

        Chunks that open with their only white space are encoded many at a time: the first token of each begins with a space, and no other does.
        """
        lengths = np.zeros(len(chunks), np.int64)
        texts = [x.decode() for x in chunks]
        joined = [i for i, x in enumerate(chunks) if x[:1] == b" " and len(x.split()) == 1 and x[-1:] not in (b" ", b"\n", b"\t", b"\r")]
        found, _ = self._library(["".join(texts[i] for i in joined[k : k + _JOINED]) for k in range(0, len(joined), _JOINED)])
        first = np.flatnonzero(self.opens[found])
        if len(first) == len(joined):
            lengths[joined] = np.diff(first, append=len(found))
        else:
            found, joined = np.zeros(0, np.uint32), []
        alone = np.ones(len(chunks), bool)
        alone[joined] = False
        rest = np.flatnonzero(alone)
        more, lengths[rest] = self._library([texts[i] for i in rest.tolist()])
        order = np.concatenate([np.array(joined, np.int64), rest])
        starts = np.zeros(len(chunks), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate([found, more])[spread(starts, lengths)], lengths

    def _chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All bytes, the begin and size of each chunk, and the number of each text's chunks."""
        coded = [x.encode("utf-8", "replace") for x in texts]
        data = np.frombuffer(b"".join(coded), np.uint8)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        if not len(data):
            return data, *np.zeros((2, 0), np.int64), np.zeros(len(texts), np.int64)
        space = self.space[data]
        opens = self.cut[data]
        opens[1:] &= ~space[:-1]
        opens[:-1] &= ~space[1:]
        after = self.word[data[:-1]]
        after[1:] |= (data[:-2] == 0xC3) & self.latin[data[1:-1]]
        opens[1:] |= after & self.mark[data[1:]]
        begins = np.cumsum(sizes) - sizes
        opens[begins[sizes > 0]] = True
        starts = np.flatnonzero(opens)
        counts = np.diff(np.searchsorted(starts, np.append(begins, len(data))))
        return data, starts, np.diff(starts, append=len(data)), counts

    @staticmethod
    def _words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For the first eight bytes, the next ... of chunks: which chunks reach there, and these bytes as a word without what follows the chunk's end."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        words = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
        own, k = np.arange(len(starts)), 0
        while len(own):
            left = np.minimum(sizes[own] - 8 * k, 8).astype(np.uint64)
            yield own, words[starts[own] + 8 * k] << (np.uint64(64) - np.uint64(8) * left)
            k += 1
            own = own[sizes[own] > 8 * k]

    def _hashed(self, sizes: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Never 0."""
        hashes = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for own, word in words:
            x = (hashes[own] ^ word) * np.uint64(0xD6E8FEB86659FD93)
            hashes[own] = (x ^ x >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F)
        hashes ^= hashes >> np.uint64(29)
        return hashes | np.uint64(1)

    def _same(self, sizes: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]], places: np.ndarray) -> np.ndarray:
        """Whether each chunk is the one kept at its place, byte by byte."""
        kept, first = self.chunks.flat, self.chunks.starts[places]
        same = (places >= 0) & (self.bytes[places] == sizes)
        for k, (own, word) in enumerate(words):
            # a chunk of another size may be shorter than this one: its words are not looked at
            same[own] &= kept[np.where(same[own], first[own] + k, 0)] == word
        return same

    def _keep(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        many = -(-sizes // 8)
        rows, begins = np.zeros(int(many.sum()), np.uint64), np.cumsum(many) - many
        for k, (own, word) in enumerate(self._words(data, starts, sizes)):
            rows[begins[own] + k] = word
        self.chunks.add(rows, many)

    def _lengths(self, texts: list[str], wanted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of ids of each chunk, the number of each text's chunks and, if wanted, all ids."""
        data, starts, sizes, counts = self._chunks(texts)
        if not len(starts):
            return np.zeros(0, np.int64), counts, np.zeros(0, np.uint32)
        short = np.flatnonzero(sizes <= LONG)
        words = list(self._words(data, starts[short], sizes[short]))
        hashes = self._hashed(sizes[short], words)
        found = self.table.find(hashes)
        if (found < 0).any():
            if self._full(int((found < 0).sum())):
                self._make_room()
                found = self.table.find(hashes)
            new = np.flatnonzero(found < 0)
            _, first = np.unique(hashes[new], return_index=True)
            first = new[first][: MAX_CHUNKS - self.table.n]
            at = short[first]
            ids, lengths = self._encoded([data[a : a + n].tobytes() for a, n in zip(starts[at].tolist(), sizes[at].tolist(), strict=True)])
            self.bytes[self.table.n : self.table.n + len(at)] = sizes[at]
            self.table.add(hashes[first])
            self._keep(data, starts[at], sizes[at])
            self.ids.add(ids, lengths)
            found[new] = self.table.find(hashes[new])
        same, places = np.zeros(len(starts), bool), np.full(len(starts), -1, np.int32)
        same[short], places[short] = self._same(sizes[short], words, found), found
        lengths = np.where(same, self.ids.sizes[places], 0).astype(np.int64)
        own = places[same]
        self.uses[own] = np.minimum(self.uses[own], 2) + 1  # portions that had it
        others = np.flatnonzero(~same)
        if len(others):
            odd, lengths[others] = self._library([data[a : a + n].tobytes().decode() for a, n in zip(starts[others].tolist(), sizes[others].tolist(), strict=True)])
        if not wanted:
            return lengths, counts, np.zeros(0, np.uint32)
        if not len(others):
            return lengths, counts, self.ids.take(places)
        ids = np.zeros(int(lengths.sum()), np.uint32)
        begins = np.cumsum(lengths) - lengths
        ids[spread(begins[same], lengths[same])] = self.ids.take(places[same])
        ids[spread(begins[others], lengths[others])] = odd
        return lengths, counts, ids

    def _plain(self, text: str) -> bool:
        return self.by_chunk and not _ODD.search(text) and not any(x in text for x in self.special)

    def _split(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[str]]:
        plain = [self._plain(x) for x in texts]
        return np.array(plain, bool), [x for x, p in zip(texts, plain, strict=True) if p], [x for x, p in zip(texts, plain, strict=True) if not p]

    def _portions(self, texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        """Texts, or parts of long ones, portion by portion, and which text each belongs to."""
        held: list[str] = []
        owners: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            at = 0
            while True:
                cut = _CUT.search(text, at + _AT_ONCE) if len(text) - at > _AT_ONCE else None
                part = text[at : cut.start()] if cut else text[at:]
                held.append(part)
                owners.append(i)
                size += len(part)
                if size >= _AT_ONCE:
                    yield owners, held
                    held, owners, size = [], [], 0
                if not cut:
                    break
                at = cut.start()
        if held:
            yield owners, held

    def _all(self, texts: list[str], wanted: bool) -> tuple[np.ndarray, np.ndarray]:
        counts, found = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint32)]
        for owners, parts in self._portions(texts):
            lengths, chunks, ids = self._lengths(parts, wanted)
            found.append(ids)
            np.add.at(counts, owners, np.diff(np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(chunks)])]))
        return np.concatenate(found), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of each text's ids."""
        plain, some, others = self._split(texts)
        ids, counts = self._all(some, True)
        if not others:
            return ids, counts
        odd, odd_counts = self._library(others)
        a, b = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []), iter(np.split(odd, np.cumsum(odd_counts)[:-1]))
        merged = [next(a) if p else next(b) for p in plain]
        return np.concatenate(merged), np.fromiter(map(len, merged), np.int64, len(merged))

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of each text's ids."""
        plain, some, others = self._split(texts)
        found = np.zeros(len(texts), np.int64)
        found[plain], found[~plain] = self._all(some, False)[1], self._library(others)[1]
        return found
