"""Token ids of many words at once, as the tokenizers library gives them for a BPE vocabulary with word ends.

A chunk's distinct words are normalised and split as the vocabulary file says,
and the merges of all of them are applied together over flat arrays: in each
round every word merges its pair of lowest rank.  Words met before are looked
up.  Words that may hold a special token go to the library itself.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import regex

from .common import Words
from .tokens import _byte_letters

#: Words kept per worker; a full table is emptied before the next chunk.
CACHE_WORDS = 400_000
_NONE = np.int32(1 << 30)


class _Ranks:
    """Rank of a pair of ids: open addressing over arrays."""

    def __init__(self, pairs: np.ndarray):
        self.bits = max(4, int(4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, _NONE, np.int32)
        self.mask = (1 << self.bits) - 1
        for k, (key, at) in enumerate(zip(pairs.tolist(), self._home(pairs).tolist())):
            while self.keys[at] >= 0 and self.keys[at] != key:
                at = (at + 1) & self.mask
            if self.keys[at] < 0:
                self.keys[at], self.rank[at] = key, k

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.rank[at], _NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            same = found == keys[open_]
            out[open_[same]] = self.rank[at[open_[same]]]
            open_ = open_[~same & (found >= 0)]
        return out


class _Strings:
    """Byte strings laid end to end."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    @classmethod
    def of(cls, words: pa.Array) -> _Strings:
        bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        return cls(np.frombuffer(words.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0])

    def hashes(self) -> np.ndarray:
        view = Words.__new__(Words)
        view.data, view.start, view.end = self.data, self.bounds[:-1], self.bounds[1:]
        return view._hashes()

    def same(self, mine: np.ndarray, other: _Strings, theirs: np.ndarray) -> np.ndarray:
        """Whether strings ``mine`` equal the other's strings ``theirs``."""
        size = self.bounds[mine + 1] - self.bounds[mine]
        ok = size == other.bounds[theirs + 1] - other.bounds[theirs]
        some = np.flatnonzero(ok & (size > 0))
        if len(some):
            a = _gather(self.data, self.bounds[mine[some]], size[some])
            b = _gather(other.data, other.bounds[theirs[some]], size[some])
            ok[some] = np.logical_and.reduceat(a == b, np.cumsum(size[some]) - size[some])
        return ok

    def plus(self, other: _Strings, which: np.ndarray) -> _Strings:
        size = other.bounds[which + 1] - other.bounds[which]
        data = np.concatenate([self.data, _gather(other.data, other.bounds[which], size)])
        return _Strings(data, np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(size)]))


class Encoder:
    """Built in each worker from the text of a vocabulary file."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_str(spec)
        self.width = max(self.library.get_vocab(with_added_tokens=True).values()) + 1
        parsed = json.loads(spec)
        vocab: dict[str, int] = parsed["model"]["vocab"]
        suffix = parsed["model"]["end_of_word_suffix"] or ""
        pairs, made = [], []
        for pair in parsed["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pairs.append(vocab[a] << 32 | vocab[b])
            made.append(vocab[a + b])
        self.ranks, self.made = _Ranks(np.array(pairs, np.int64)), np.array(made, np.int32)
        letters = _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        self.split = regex.compile(parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self._clear()

    def _clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.row = np.zeros(0, np.int64)
        self.letters = _Strings(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def merged(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all non-empty ``parts`` in a row, and the number of ids of each."""
        size = np.array([len(p) for p in parts], np.int64)
        raw = np.frombuffer(b"".join(parts), np.uint8)
        last = np.cumsum(size) - 1
        sym = self.inner[raw]
        sym[last] = self.final[raw[last]]
        rank = np.full(len(sym), _NONE, np.int32)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[last] = _NONE
        owner = np.arange(len(parts))
        done_sym: list[np.ndarray] = []
        done_owner: list[np.ndarray] = []
        while len(owner):
            first = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, first)
            live = least < _NONE
            if not live.all():
                keep = np.repeat(live, size)
                done_sym.append(sym[~keep])
                done_owner.append(np.repeat(owner[~live], size[~live]))
                sym, rank, size, owner, least = sym[keep], rank[keep], size[live], owner[live], least[live]
                if not len(owner):
                    break
                first = np.cumsum(size) - size
            hit = rank == np.repeat(least, size)
            spots = np.flatnonzero(hit)
            run = np.flatnonzero(np.diff(spots) == 1)
            if len(run):  # a pair of equal symbols overlaps itself: every second one of a run goes
                head = np.concatenate([[True], np.diff(spots) != 1])
                spots = spots[(np.arange(len(spots)) - np.flatnonzero(head)[np.cumsum(head) - 1]) % 2 == 0]
            sym[spots] = self.made[rank[spots]]
            gone = np.zeros(len(sym), bool)
            gone[spots + 1] = True
            rank[spots] = rank[spots + 1]  # of the last symbol: none
            ends = rank == _NONE
            ends[:] = False
            ends[first + size - 1] = True
            ends[spots] |= ends[spots + 1]
            keep = ~gone
            place = np.cumsum(keep) - 1
            size = size - np.add.reduceat(gone.astype(np.int64), first)
            sym, rank, ends = sym[keep], rank[keep], ends[keep]
            at = place[spots]
            todo = np.concatenate([at, at[at > 0] - 1])
            todo = todo[~ends[todo]]
            rank[todo] = self.ranks(sym[todo], sym[todo + 1])
        sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(owner, minlength=len(parts)).astype(np.int64)

    def _parts(self, word: str) -> list[str]:
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
            if "Σ" in word:  # its final form depends on its neighbours; the normaliser takes letters one by one
                word = word.replace("Σ", "σ")
        word = word.lower()
        return [word] if word.isalpha() else self.split.findall(word)

    def _learn(self, words: list[bytes]) -> None:
        """Append the ids of new words to the pool."""
        index: dict[bytes, int] = {}
        spots: list[int] = []
        count: list[int] = []
        special: list[tuple[int, list[int]]] = []
        for k, w in enumerate(words):
            if b"<|" in w:
                special.append((k, self.library.encode(w.decode(), add_special_tokens=False).ids))
                count.append(0)
                continue
            parts = self._parts(w.decode())
            count.append(len(parts))
            spots += [index.setdefault(p.encode(), len(index)) for p in parts]
        ids, sizes = self.merged(list(index)) if index else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        part = np.array(spots, np.int64)
        flat = _gather(ids, (np.cumsum(sizes) - sizes)[part], sizes[part])
        per_part = np.concatenate([[0], np.cumsum(sizes[part])])
        edge = np.concatenate([[0], np.cumsum(count)])
        start = per_part[edge[:-1]]
        size = per_part[edge[1:]] - start
        for k, found in special:
            start[k], size[k] = len(flat), len(found)
            flat = np.concatenate([flat, np.array(found, np.uint32)])
        self.start = np.concatenate([self.start, start + len(self.pool)])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, flat])

    def _rows(self, words: pa.Array) -> np.ndarray:
        """The pool's row of each of the distinct ``words``; new ones are learned."""
        own = _Strings.of(words)
        hashes = own.hashes()
        row = np.full(len(words), -1, np.int64)
        if len(self.hash):
            near = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
            met = np.flatnonzero(self.hash[near] == hashes)
            met = met[own.same(met, self.letters, self.row[near[met]])]  # equal hashes of differing words: learned again
            row[met] = self.row[near[met]]
        new = np.flatnonzero(row < 0)
        if len(new):
            row[new] = np.arange(len(self.size), len(self.size) + len(new))
            self._learn(words.take(pa.array(new)).to_pylist())
            self.letters = self.letters.plus(own, new)
            self.hash, self.row = np.concatenate([self.hash, hashes[new]]), np.concatenate([self.row, row[new]])
            order = np.argsort(self.hash, kind="stable")
            self.hash, self.row = self.hash[order], self.row[order]
        return row

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each text; null texts have none."""
        if len(self.size) >= CACHE_WORDS:
            self._clear()
        found = Words(texts, hashed=False)
        size = found.end - found.start
        if not len(size):
            return np.zeros(0, np.uint32), np.zeros(found.rows, np.int64)
        bounds = np.concatenate([[0], np.cumsum(size)])
        solid = found.data[~((found.data == 32) | ((found.data >= 9) & (found.data <= 13)))]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(solid)]).dictionary_encode()
        row = self._rows(coded.dictionary)[coded.indices.to_numpy()]
        sizes = self.size[row]
        total = np.concatenate([[0], np.cumsum(sizes)])[found.first]
        return _gather(self.pool, self.start[row], sizes), np.diff(total)


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``pool[start : start + size]`` of all rows, one after the other."""
    if not len(size):
        return pool[:0]
    ends = np.cumsum(size)
    return pool[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]


_encoders: dict[str, Encoder] = {}


def encoder(path: str, spec: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(spec)
    return _encoders[path]
