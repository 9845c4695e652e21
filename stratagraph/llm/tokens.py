"""Operator 8: BPE encoding and decoding by a tokenization automaton.

The merges of a vocabulary are compiled into a deterministic automaton over
tokens.  Its states are the tokens just emitted; an arc ``t -> u`` exists
exactly when replaying the merges, one gadget after another, over the two
neighbours never joins symbols across their border.  A sequence whose arcs all
exist is the only one that the merges produce, so a pre-split word is encoded
by walking the arcs, longest label first, and undoing a step that leads
nowhere.  Gadgets of a pair are replayed when the pair is first met and the
arc is then kept in the transition table (a full table has the square of the
vocabulary as cells; texts touch a small part).  Decoding emits arc labels.

Null texts count as empty; empty texts have no ids.  Rows repeat as given.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import mapped, sha_hex

#: Where the public vocabulary lies; a parameter of every function.
VOCABULARY = "word_bpe_49k.json"
#: Entries kept per worker of the table from a written word to its ids.
CACHE_WORDS = 800_000
#: Arcs kept per worker; a full table is emptied and filled anew.
CACHE_ARCS = 1_500_000

_CONTROLS = re.compile("[\x1c-\x1f]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: printable Latin-1 stand for themselves, others follow U+0100 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Automaton:
    """Tokens, arcs and the walk; built from a parsed vocabulary file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.label = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.label |= {i: t for t, i in self.special.items()}
        rank = {}
        made = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ids = self.vocab[a], self.vocab[b]
            rank.setdefault(ids, k)
            made.setdefault(self.vocab[a + b], (k, ids))
        self.rank, self.made = rank, made
        self.letters = _byte_letters()
        # inner tokens and word-final tokens, by their bare letters
        self.inner = {t: i for t, i in self.vocab.items() if not (self.suffix and t.endswith(self.suffix) and t != self.suffix)}
        self.final = {t.removesuffix(self.suffix): i for t, i in self.vocab.items() if self.suffix and t.endswith(self.suffix)} if self.suffix else self.inner
        # the longest token that starts with these three letters (shorter ones need no entry)
        self.span: dict[str, int] = {}
        for t in (*self.inner, *self.final):
            self.span[t[:3]] = max(self.span.get(t[:3], 0), len(t))
        self.arcs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words: dict[str, tuple[bytes, str]] = {}

    def joins_never(self, left: int, right: int) -> bool:
        """Whether the arc left -> right exists: no merge fires across the border while the gadgets build both sides.

        The border symbols are refined downward in gadget order: the side made
        by the later gadget is opened first, since at that gadget's turn its
        parts were what stood at the border.
        """
        arc = left << 32 | right
        known = self.arcs.get(arc)
        if known is not None:
            return known
        a, b, limit = left, right, 1 << 60
        ok = True
        while True:
            fires = self.rank.get((a, b))
            if fires is not None and fires < limit:
                ok = False
                break
            ra = self.made[a][0] if a in self.made else -1
            rb = self.made[b][0] if b in self.made else -1
            if ra < 0 and rb < 0:
                break
            # Before its own gadget the newer side stood as two parts. A pair with the
            # left side's gadget still to come is met by merges up to that gadget, and
            # one with the right side's gadget by those before it.
            if ra > rb:
                limit = ra
                a = self.made[a][1][1]
            else:
                limit = rb + 1
                b = self.made[b][1][0]
        if len(self.arcs) >= CACHE_ARCS:
            self.arcs.clear()
        self.arcs[arc] = ok
        return ok

    def walk(self, word: str) -> list[int]:
        """The ids of one pre-split word, given in byte letters."""
        n = len(word)
        whole = self.final.get(word)
        inner, final, joins, reached, span = self.inner, self.final, self.joins_never, self._reached, self.span
        if whole is not None and reached(whole):
            return [whole]
        path: list[int] = []
        sizes: list[int] = []
        at, most = 0, n - 1 if whole is not None else n
        while at < n:
            found = 0
            for size in range(min(most, n - at, span.get(word[at : at + 3], 2)), 0, -1):
                piece = word[at : at + size]
                token = (final if at + size == n else inner).get(piece)
                if token is not None and reached(token) and (not path or joins(path[-1], token)):
                    path.append(token)
                    sizes.append(size)
                    at += size
                    found = 1
                    break
            if found:
                most = n
                continue
            if not path:
                raise ValueError(f"no path through the automaton for {word!r}")
            path.pop()
            size = sizes.pop()
            at -= size
            most = size - 1
        return path

    def _reached(self, token: int) -> bool:
        """Whether the token's own parts meet by an arc, so that the merges do make it from its letters."""
        known = self.whole.get(token)
        if known is None:
            made = self.made.get(token)
            known = made is None or (self._joins_before(*made[1], made[0]) and self._reached(made[1][0]) and self._reached(made[1][1]))
            self.whole[token] = known
        return known

    def _joins_before(self, a: int, b: int, k: int) -> bool:
        """Whether a and b stand side by side when gadget k comes: no earlier one joins across their border."""
        limit = k
        while True:
            fires = self.rank.get((a, b))
            if fires is not None and fires < limit:
                return False
            ra = self.made[a][0] if a in self.made else -1
            rb = self.made[b][0] if b in self.made else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit = min(limit, ra)
                a = self.made[a][1][1]
            else:
                limit = min(limit, rb + 1)
                b = self.made[b][1][0]

    def word(self, written: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the labels joined by spaces, of a run without white space."""
        ids: list[int] = []
        for piece in self.split.findall(written):
            # printable ASCII letters stand for their own bytes
            ids += self.walk(piece if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in piece.encode("utf-8")]))
        out = b"".join([i.to_bytes(4, "little") for i in ids]), " ".join([self.label[i] for i in ids])
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        self.words[written] = out
        return out

    def runs(self, text: str) -> Iterator[list[str] | int]:
        """Special ids, and the runs without white space of the normalised text between them."""
        at = 0
        for mark in self.marks.finditer(text) if self.marks and "<|" in text else ():
            if mark.start() > at:
                yield self._normal(text[at : mark.start()])
            yield self.special[mark[0]]
            at = mark.end()
        if at < len(text):
            yield self._normal(text[at:])

    @staticmethod
    def _normal(text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # the final form of sigma depends on its neighbours; the normaliser takes letters one by one
                text = text.replace("Σ", "σ")
        text = text.lower()
        # str.split() also ends runs at \x1c-\x1f, which are not white space to the pattern
        return regex.split(r"\p{White_Space}+", text) if _CONTROLS.search(text) else text.split()

    def encode(self, text: str) -> tuple[bytes, str]:
        ids: list[bytes] = []
        labels: list[str] = []
        known = self.words
        for run in self.runs(text):
            if isinstance(run, int):
                ids.append(np.array([run], "<u4").tobytes())
                labels.append(self.label[run])
                continue
            for w in run:
                hit = known.get(w) or self.word(w)
                if hit[0]:
                    ids.append(hit[0])
                    labels.append(hit[1])
        return b"".join(ids), " ".join(labels)

    def decode(self, ids: bytes) -> str:
        """Arc labels of the ids, joined as a vocabulary without a decoder prescribes."""
        return " ".join([self.label[i] for i in np.frombuffer(ids, "<u4").tolist()])


_loaded: dict[str, Automaton] = {}


def _automaton(path: str, spec: str | None = None) -> Automaton:
    if path not in _loaded:
        _loaded[path] = Automaton(json.loads(spec) if spec else json.load(open(path, encoding="utf-8")))
    return _loaded[path]


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """Add to every row ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, unless switched off, ``ids`` and ``decoded``.

    Added columns of the same names are replaced.  The vocabulary (a file of
    fixed size, about 2 MB) is sent along by the driver, so that executors
    need no copy of it.
    """
    path = vocabulary or default_vocabulary()
    spec = docs.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())
    kinds = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    kinds |= {"ids": "array<int>", "decoded": "string"} if with_ids else {}

    def make():
        machine = _automaton(path, spec.value)

        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c: [] for c in kinds}
            for t in batch.column(text):
                ids, labels = machine.encode(t.as_py() or "")
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(sha_hex(ids))
                out["decoded_sha256"].append(sha_hex(labels.encode("utf-8")))
                if with_ids:
                    out["ids"].append(np.frombuffer(ids, "<u4").astype(np.int32))
                    out["decoded"].append(labels)
            types = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
            return {c: pa.array(v, types.get(c, pa.string())) for c, v in out.items()}

        return each

    return mapped(docs, make, kinds)
