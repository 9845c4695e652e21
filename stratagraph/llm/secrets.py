"""Operator 2: secret scans.

Three written forms are matched over whole texts: credential assignments,
access keys and long hexadecimal runs.  To these the operator adds ``value``
spans: values in a credential context whose guess cost is high.  The cost of a
value is the least log10 number of guesses over all its segmentations into
common words, dates, repeats and sequences, keyboard walks and brute-force
spans, found by dynamic programming.

Null texts count as empty and have no spans; repeated rows are scanned each.
Offsets are code points, ends exclusive.  Columns of the added names are
replaced.
"""

from __future__ import annotations

import json
import math
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, sha_hex
from .tokens import default_vocabulary

#: Order of kinds where spans start together.
KINDS = ("assign", "access", "hex", "value")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.A)
HEX = re.compile(r"[0-9a-f]{16,}", re.A)
#: Wider credential contexts, whose values are costed. Possessive so that long values don't backtrack.
CONTEXT = re.compile(
    r"""(?:passwords?|passwd|passphrase|pwd|secret|token|api[_-]?key|credentials?|auth|private[_-]?key|login)["']?\x20*[:=]\x20*(?:"([^"\s]{6,}+)"|'([^'\s]{6,}+)'|([^\s"',;<>|]{6,}+))""",
    re.I | re.A,
)
#: Guess cost (log10) from which a value in context counts as a secret.
MIN_COST = 9.0

# Common password words by rank (those of the vocabulary are added), and rows of a keyboard.
COMMON = (
    "password 123456 qwerty letmein admin welcome login master dragon monkey sunshine princess football baseball "
    "shadow iloveyou secret test guest default changeme user root hello access flower love summer winter spring "
    "autumn january february march april may june july august september october november december monday friday "
    "sunday service server database example sample demo temp system security private public token key pass word "
    "the and for you with this that from have are not but all was one our out day get has him his how man new now "
    "old see two way who boy did its let put say she too use company office london paris berlin madrid happy blue "
    "red green black white star tiger lion eagle hunter killer batman superman michael jordan robert daniel thomas"
).split()
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qazwsxedcrfvtgbyhnujmikolp")

#: Letters that a word of the vocabulary has at least and at most.
SHORTEST, _LONGEST = 4, 24


@cache
def ranks() -> dict[str, int]:
    """Rank of each common word: COMMON, and the whole words of the tokenizer's vocabulary, whose ids follow frequency."""
    with open(default_vocabulary(), encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model["end_of_word_suffix"] or ""
    words = [t.removesuffix(end) for t in sorted(model["vocab"], key=model["vocab"].get) if t.endswith(end)]
    words = [w for w in words if SHORTEST <= len(w) <= _LONGEST and w.isascii() and w.isalpha()]
    found = {w: i for i, w in reversed(list(enumerate(words, 1)))}
    return found | {w: min(i, found.get(w, i)) for i, w in reversed(list(enumerate(COMMON, 1)))}


_LEET = str.maketrans("0134578@$!", "oieastbasi")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d", re.A)
_NEXT = {(a, b) for row in KEY_ROWS for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))}
_RULES = (lambda a, b: (a, b) in _NEXT, lambda a, b: ord(b) - ord(a) == 1, lambda a, b: ord(a) - ord(b) == 1)


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100


def guess_cost(value: str, enough: float = math.inf, words: dict[str, int] | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation needs; 0 for an empty value.

    ``best[i]`` is the least cost of the first i characters.  Every span adds
    its own guesses and log10(2) for the cut before it, so that many short
    spans don't undercut one long one.

    A cost of ``enough`` or more may come back as ``enough``: places that cost
    as much already lead to nothing cheaper, and a value ends where no other
    place is left.  A start within the stretch of repeats or neighbours of an
    earlier start is skipped where the earlier one is no dearer at any end, so
    that time grows with the length of the value.
    """
    words = ranks() if words is None else words
    n = len(value)
    low = value.lower()
    plain = low.translate(_LEET)
    best = [0.0] + [math.inf] * n
    cut = math.log10(2)
    spread = math.log10(max(1, sum({_alphabet(c): _alphabet(c) for c in value}.values())))
    reach = 0
    done: dict = {}  # stretch -> (its end, last start that was followed, cost there)

    def dearer(kind, i: int, here: float, least: int) -> bool:
        end, p, at = done.get(kind, (0, 0, 0.0))
        return i + least <= end and here >= at + math.log10((i - p + least) / least)

    for i in range(n):
        if i > reach:
            break
        if best[i] >= enough:
            continue
        here = best[i] + (cut if i else 0.0)
        # brute force, one character at a time; a run of them has one cut only
        best[i + 1] = min(best[i + 1], best[i] + spread)
        ends = [i + 1]
        for j in range(i + 2, min(n, i + _LONGEST) + 1):
            rank = words.get(low[i:j])
            cost = math.log10(rank) if rank else None
            if cost is None and (rank := words.get(plain[i:j])):
                cost = math.log10(rank) + 0.6  # substitutions
            if cost is not None:
                best[j] = min(best[j], here + max(0.3, cost) + (0.5 if value[i:j] != low[i:j] else 0.0))
                ends.append(j)
        if value[i].isdigit() and (m := _DATE.match(value, i)):
            best[m.end()] = min(best[m.end()], here + math.log10(365 * 120))
            ends.append(m.end())
        for unit in (1, 2, 3, 4):  # repeats of a short unit
            kind = unit, i % unit
            if dearer(kind, i, here, 2 * unit):
                continue
            j = i + unit
            while j + unit <= n and value[j : j + unit] == value[i : i + unit]:
                j += unit
                best[j] = min(best[j], here + unit * spread + math.log10((j - i) / unit))
            done[kind] = j, i, here
            ends.append(j)
        for k, rule in enumerate(_RULES):
            if dearer(k, i, here, 3):
                continue
            j = i + 1
            while j < n and rule(low[j - 1], low[j]):
                j += 1
                if j - i >= 3:
                    best[j] = min(best[j], here + math.log10(47 * (j - i)))
            done[k] = j, i, here
            ends.append(j)
        reach = max(reach, *ends)
    return min(best[n], enough)


def find(text: str, min_cost: float = MIN_COST, words: dict[str, int] | None = None) -> list[tuple[str, int, int]]:
    """All spans of one text as (kind, start, end), by start and kind."""
    spans = []
    if ":" in text or "=" in text:
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        taken = [s[1:] for s in spans]
        for m in CONTEXT.finditer(text):
            k = next(k for k in (1, 2, 3) if m[k] is not None)
            at, to = m.span(k)
            # a base span that ends inside the value leaves its rest to the value's span
            if not any(a <= at and to <= b for a, b in taken) and guess_cost(m[k], min_cost, words) >= min_cost:
                spans.append(("value", at, to))
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every maximal covered stretch replaced by ``[SECRET]``."""
    out, at, end = [], 0, 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= end:
            out += [text[at:a], "[SECRET]"]
        at = end = max(end, b)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, text: str = "text", min_cost: float = MIN_COST, redact: bool = False) -> DataFrame:
    """Add ``n_assign``, ``n_access``, ``n_hex``, ``n_value``, ``base_sha256`` and ``spans``; with ``redact``, mask the text in place instead.

    One narrow pass over the rows, no shuffle.  With ``redact`` the columns
    stay as they are; null texts stay null.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks())

    def make():
        words = sent.value

        def each(batch: pa.RecordBatch) -> dict:
            texts = batch.column(text).to_pylist()
            found = [find(t, min_cost, words) if t else [] for t in texts]
            if redact:
                return {text: pa.array([masked(t, s) if s else t for t, s in zip(texts, found)], batch.column(text).type)}
            counts = {f"n_{kind}": pa.array([sum(x[0] == kind for x in s) for s in found], pa.int64()) for kind in KINDS}
            base = [sha_hex(written([x for x in s if x[0] != "value"]).encode()) for s in found]
            return counts | {"base_sha256": pa.array(base, pa.string()), "spans": pa.array([written(s) for s in found], pa.string())}

        return each

    return mapped(docs, make, {} if redact else {f"n_{k}": "bigint" for k in KINDS} | {"base_sha256": "string", "spans": "string"})
