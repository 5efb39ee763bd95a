"""Secrets in texts: three fixed patterns, and a guess-cost search over values in credential contexts.

The guess cost of a value is the least cost of any segmentation of it into dictionary words, dates,
repeats, keyboard walks and brute-force spans, by dynamic programming over positions: log10 of each
segment's guesses, plus log10(2) for each segment after the first. A value that follows a credential key
and costs at least ``min_log10`` is a secret that its owner didn't choose from habit, and becomes a span of
kind ``guess``.

The dictionary has the whole words of public tokenisers' vocabularies and a short list of words that guessing
begins with. They are ranked by their number in the corpus, counted over all rows but not inside the values
under test, so that a secret doesn't raise its own rank; and by their place in the vocabularies, whichever is
better. It has a fixed size, is counted in fixed memory and is broadcast.

Texts are scanned as UTF-8 bytes (all patterns are ASCII); positions are given in code points. Each row is
scanned by itself; only the counts of words, summed in the tasks first, are shuffled.

Defined cases: null and empty texts have no spans (the digest is that of the empty string); repeated rows
each give a row; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import BLOCK_BYTES, arrow_slices, bounded_batches, row_blocks, text_view, texts, tidy

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(rb"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
HEX_LEAST, ACCESS_LEAST, ASSIGN_LEAST = 24, 20, 6

#: A key that names a credential and a separator; the value follows, up to a blank, quote, comma, semicolon or bracket.
CONTEXT = re.compile(rb"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|(?:api|access|private|secret)[_-]?key)["']?[\x20\t]*(?::|=>?|(?<=[\x20\t])is(?=[\x20\t]))[\x20\t]*["']?""")
VALUE = re.compile(rb"""[^\x00-\x20\x7f-\xff"'<>,;()\[\]{}]+""")
#: Lower-case parts, one of which every credential key has.
KEY_PARTS = (b"pass", b"pwd", b"secret", b"token", b"credential", b"auth", b"key")

# Words that guessing tools try first, in rough order of use.
COMMON_WORDS = (
    "password", "admin", "welcome", "login", "qwerty", "letmein", "monkey", "dragon", "master", "hello",
    "freedom", "whatever", "shadow", "sunshine", "princess", "football", "baseball", "secret", "summer", "winter",
    "spring", "autumn", "love", "trust", "superman", "batman", "michael", "jordan", "hunter", "killer",
    "george", "charlie", "andrew", "thomas", "robert", "daniel", "jennifer", "computer", "internet", "server",
    "test", "user", "root", "guest", "default", "change", "changeme", "example", "sample", "public",
    "private", "token", "key", "pass", "access", "database", "service", "system", "company", "office",
    "home", "house", "money", "coffee", "orange", "banana", "apple", "cheese", "chocolate", "pepper",
    "flower", "tiger", "eagle", "horse", "purple", "yellow", "green", "black", "white", "silver",
    "golden", "diamond", "angel", "magic", "happy", "lucky", "smile", "star", "moon", "world",
    "the", "and", "you", "for", "with", "this", "that", "from", "have", "your",
)
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")

SEGMENT = math.log10(2)
LEAST_WORD, LONGEST_WORD = 3, 16
WORD_BYTES = bytes(c if chr(c).isalnum() and c < 128 or c == 95 or c >= 128 else 32 for c in range(256))
VOCABULARIES = ("word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken")


def vocabularies() -> tuple[str, ...]:
    import public_tokenizers

    return tuple(public_tokenizers.path(name) for name in VOCABULARIES)


def whole_words(path: str) -> list[str]:
    """The words that are tokens of their own, in the vocabulary's order: with the sign of a word's end, or with
    a blank before them in a list of byte tokens."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
        found = [t[1:].decode() for t in tokens if t[:1] == b" " and t.isascii()]
    else:
        with open(path, encoding="utf-8") as f:
            ids = json.load(f)["model"]["vocab"]
        found = [t.removesuffix("</w>") for t, _ in sorted(ids.items(), key=lambda x: x[1]) if t.endswith("</w>")]
    low = dict.fromkeys(w.lower() for w in found)
    return [w for w in low if w.isascii() and w.isalpha() and LEAST_WORD <= len(w) <= LONGEST_WORD]


@cache
def listed_words(paths: tuple[str, ...] | None = None) -> dict[str, int]:
    """Ranks of the short list's words and of the vocabularies' whole words; None: the public ones."""
    return ranked(list(COMMON_WORDS), *map(whole_words, vocabularies() if paths is None else paths))


def ranked(*lists: list[str]) -> dict[str, int]:
    """Each word's best place in the lists, from 1."""
    out: dict[str, int] = {}
    for words in lists:
        for i, w in enumerate(words, 1):
            out[w] = min(i, out.get(w, i))
    return out


def learn_words(docs: DataFrame, paths: tuple[str, ...] | None = None) -> dict[str, int]:
    """The dictionary, ranked by the numbers of its words in ``docs`` (ties by word) where that is better."""
    listed = listed_words(paths)
    shipped = docs.sparkSession.sparkContext.broadcast(frozenset(w.encode() for w in listed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter[bytes] = Counter()
        for batch in arrow_slices(batches, limit=BLOCK_BYTES):
            data, offsets = text_view(batch.column(0))
            raw = data.tobytes().lower()
            rows = (raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            own = Counter(b" ".join(without_values(x) if any(k in x for k in KEY_PARTS) else x for x in rows).translate(WORD_BYTES).split())
            for w in own.keys() & shipped.value:
                sums[w] += own[w]
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])

    counted = texts(docs).select("text").mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    own = ranked([r["word"] for r in sorted(counted.collect(), key=lambda r: (-r["n"], r["word"]))])  # as many as the dictionary at most
    return {w: min(i, own.get(w, i)) for w, i in listed.items()}


def without_values(text: bytes) -> bytes:
    """The text but for the values in credential contexts."""
    out, done = [], 0
    for m in CONTEXT.finditer(text):
        if m.end() >= done and (found := VALUE.match(text, m.end())):
            out.append(text[done : m.end()])
            done = found.end()
    return b" ".join([*out, text[done:]])


UNLEET = str.maketrans("@4301!$57", "aaeoiisst")
LONGEST_UNIT = 8
NEIGHBOURS = {(a, b) for row in KEY_ROWS for x, y in zip(row, row[1:], strict=False) for a, b in ((x, y), (y, x))} | {(a, b) for r, s in zip(KEY_ROWS, KEY_ROWS[1:], strict=False) for i in range(len(r)) for j in (i, i - 1) if 0 <= j < len(s) for a, b in ((r[i], s[j]), (s[j], r[i]))}


def char_cost(ch: str) -> float:
    """log10 of the alphabet that a brute-force guesser needs for this character."""
    return 1.0 if ch.isdigit() else math.log10(26) if ch.isascii() and ch.isalpha() else math.log10(33)


def word_cost(part: str, ranks: dict[str, int]) -> float | None:
    """A word of the dictionary, its case and its digits-for-letters forms."""
    low = part.lower()
    plain = low if low in ranks else low.translate(UNLEET)
    if plain not in ranks:
        return None
    cost = math.log10(ranks[plain] + 1)
    if plain != low:
        cost += SEGMENT * sum(a != b for a, b in zip(plain, low, strict=True))
    if part != low:
        upper = sum(c.isupper() for c in part)
        cost += SEGMENT if part[0].isupper() and upper == 1 or part.isupper() else SEGMENT * min(upper, len(part) - upper) + SEGMENT
    return cost


def segments(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, float]]:
    """(start, end, cost) of each word, date, repeat and keyboard walk in the value; linear in its length."""
    n = len(value)
    for i in range(n):
        for j in range(i + LEAST_WORD, min(n, i + LONGEST_WORD) + 1):
            if (cost := word_cost(value[i:j], ranks)) is not None:
                yield i, j, cost
    for i in range(n):
        if m := DATE.match(value, i):
            yield i, m.end(), math.log10(150) if m.end() - i == 4 else math.log10(365 * 150) + (SEGMENT * 2 if not value[i : m.end()].isdigit() else 0)
    low = value.lower()
    i = 0
    while i < n - 1:  # walks: maximal runs of neighbouring keys
        j = i
        while j + 1 < n and (low[j], low[j + 1]) in NEIGHBOURS:
            j += 1
        if j - i >= 2:
            for a in range(i, j - 1):
                yield a, j + 1, math.log10(47) + (j - a) * SEGMENT
        i = max(j, i + 1)
    for unit in range(1, LONGEST_UNIT + 1):
        i = 0
        while i + 2 * unit <= n:
            j = i + unit
            while j < n and value[j] == value[j - unit]:
                j += 1
            times = (j - i) // unit
            if times * unit >= 3 and times >= 2:
                one = sum(map(char_cost, value[i : i + unit]))
                yield i, i + times * unit, one + math.log10(times)
            i = max(i + 1, j - unit + 1)


def guess_cost(value: str, ranks: dict[str, int]) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs."""
    n = len(value)
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in segments(value, ranks):
        ending.setdefault(j, []).append((i, cost))
    best = [0.0] + [math.inf] * n
    brute = [math.inf] * (n + 1)  # the cheapest that ends in an open brute-force span
    for j in range(1, n + 1):
        start = best[j - 1] + (SEGMENT if j > 1 else 0.0)
        brute[j] = min(brute[j - 1], start) + char_cost(value[j - 1])
        found = brute[j]
        for i, cost in ending.get(j, ()):
            found = min(found, best[i] + cost + (SEGMENT if i else 0.0))
        best[j] = found
    return best[n]


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the three fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(out)


def guess_spans(text: bytes, ranks: dict[str, int], min_log10: float, min_length: int) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, cost) of the values in credential contexts that cost enough. A key inside a value
    counts only if its own value starts after that one."""
    out = []
    done = 0
    for m in CONTEXT.finditer(text):
        if m.end() < done or not (found := VALUE.match(text, m.end())):
            continue
        done = found.end()
        value = found[0].rstrip(b".:!?")
        if len(value) >= min_length and (cost := guess_cost(value.decode(), ranks)) >= min_log10:
            out.append((m.end(), 3, m.end() + len(value), cost))
    return out


HEX_BYTES = np.zeros(256, bool)
HEX_BYTES[[*range(48, 58), *range(97, 103)]] = True


def _has_hex(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last bytes of the runs of at least HEX_LEAST hex digits; a run may cross rows."""
    mark = np.zeros(len(data) + 2, np.int8)
    mark[1:-1] = HEX_BYTES[data]
    step = np.diff(mark)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = ends - starts >= HEX_LEAST
    return starts[long], ends[long] - 1


NO_SPANS = hashlib.sha256(b"").hexdigest()
SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, max_guess_log10 double"


def scan_secrets(docs: DataFrame, min_log10: float = 10.0, min_length: int = 8, dictionary: dict[str, int] | None = None, **how) -> DataFrame:
    """One row per document: counts of the base spans, their digest, all spans, and how many values in
    credential contexts cost at least ``min_log10`` (and the costliest's log10, null without one). The
    dictionary is learned from ``docs`` unless one is given."""
    rows = texts(docs)
    shipped = docs.sparkSession.sparkContext.broadcast(learn_words(docs, **how) if dictionary is None else dictionary)
    names = ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_view(batch.column(1))
            out: list[tuple] = []
            for a, b in row_blocks(offsets):
                block = data[offsets[a] : offsets[b]]
                first, last = (np.searchsorted(offsets, x + offsets[a], side="right") - 1 for x in _has_hex(block))
                hexed = {i for s, e in zip(first.tolist(), last.tolist(), strict=True) for i in range(s, e + 1)}
                raw = block.tobytes()
                low = raw.lower()
                base = int(offsets[a])
                for i in range(a, b):
                    s, e = int(offsets[i]) - base, int(offsets[i + 1]) - base
                    keyed = any(low.find(k, s, e) >= 0 for k in KEY_PARTS)
                    if not keyed and i not in hexed and raw.find(b"AKIA", s, e) < 0:
                        out.append((0, 0, 0, NO_SPANS, "", 0, None))
                        continue
                    out.append(summary(raw[s:e], shipped.value, min_log10, min_length, keyed))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names[1:]]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, {SCHEMA}")


def summary(text: bytes, ranks: dict[str, int], min_log10: float, min_length: int, keyed: bool = True) -> tuple:
    """The result columns of one text."""
    base = base_spans(text)
    more = guess_spans(text, ranks, min_log10, min_length) if keyed else []
    spans = sorted([*base, *(x[:3] for x in more)])
    if not text.isascii() and spans:
        ends = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        point = lambda at: int(ends[at - 1]) if at else 0
    else:
        point = lambda at: at
    say = lambda found: ",".join(f"{KINDS[k]}:{point(s)}:{point(e)}" for s, k, e in found)
    counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    return (*counts, hashlib.sha256(say(base).encode()).hexdigest(), say(spans), len(more), max((x[3] for x in more), default=None))


MASK = b"[secret]"


def masked(text: bytes, ranks: dict[str, int], min_log10: float, min_length: int) -> bytes:
    """The text with each span, overlapping ones together, replaced by MASK."""
    out, done = [], 0
    for s, e in sorted((x[0], x[2]) for x in [*base_spans(text), *guess_spans(text, ranks, min_log10, min_length)]):
        if s >= done:
            out += [text[done:s], MASK]
        done = max(done, e)
    return b"".join([*out, text[done:]])


def mask_secrets(docs: DataFrame, min_log10: float = 10.0, min_length: int = 8, dictionary: dict[str, int] | None = None, **how) -> DataFrame:
    """The rows and columns of ``docs``, with every span of :func:`scan_secrets` in ``text`` masked and
    ``n_chars``, where there is one, counted again for the rows changed."""
    names = docs.columns
    at = names.index("text")
    shipped = docs.sparkSession.sparkContext.broadcast(learn_words(docs, **how) if dictionary is None else dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            changed: dict[int, str] = {}
            for i, text in enumerate(column):
                raw = (text.as_py() or "").encode()
                low = raw.lower()
                if any(k in low for k in KEY_PARTS) or b"AKIA" in raw or _has_hex(np.frombuffer(raw, np.uint8))[0].size:
                    new = masked(raw, shipped.value, min_log10, min_length)
                    if new != raw:
                        changed[i] = new.decode()
            if changed:
                arrays = list(batch.columns)
                arrays[at] = pa.array([changed.get(i, x) for i, x in enumerate(column.to_pylist())], column.type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    arrays[k] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(arrays[k].to_pylist())], arrays[k].type)
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield batch

    return bounded_batches(docs).mapInArrow(tidy(run), docs.schema)
