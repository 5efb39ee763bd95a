"""Toxicity: a learned lexicon, matched with misspellings by automata, and weighed by its context.

1. Lexicon. Over a bounded sample of labelled documents, words and word stems are counted by label; those
   whose log odds of standing in a toxic document are high become terms.
2. Automata. The whole words make tries, each of so many terms that lie together in the alphabet. The
   Levenshtein automaton of each term is intersected with its trie: states are sets of (trie node, edits so
   far), made deterministic once on the driver, so one table look-up a character and trie finds every term
   within its distance; the nearest counts, then the strongest. All terms also run exactly, stems accepting
   any ending.
3. Context. A hit counts less where the window of words around it has quotation marks on both sides or a
   word of reporting, and no word that addresses the reader.
4. Score. A logistic model over the sums of hits. Each labelled document is described by a lexicon that was
   learned without its fold; the lexicon that scores is learned from all.

The sample has at most ``max_train_docs`` label rows (by a hash of doc_id; all where there are fewer), which
are broadcast; its counts are summed in the cluster and only the best ``max_terms`` terms and one short
feature row a document come to the driver. Scoring is row by row, without a shuffle.

Defined cases: null and empty texts score as texts without hits; without labels of both kinds every score
is the share of toxic rows seen (0 without any); repeated rows each give a row; an empty table gives an
empty result; other columns are ignored, and labels, lang, source and doc_id never enter a score.
"""

from __future__ import annotations

import copy
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import BLOCK_BYTES, arrow_slices, bounded_batches, cut, drop_cut, row_blocks, text_view, texts, tidy
from chronoweft.llm.language_id import held_out

MAX_TRAIN_DOCS = 40_000
MAX_TERMS = 800
FUZZY_TERMS_A_TRIE = 32
LEAST_DOCS = 3
LEAST_LOG_ODDS = 3.0
STRONG_LOG_ODDS = 4.5
STEM_LENGTHS = (4, 5, 6, 7)
WINDOW = 6
QUOTED_SHARE = 0.25
THRESHOLD = 0.3
LONGEST_WORD = 24

# Words of reporting and of address, in the languages at hand.
REPORTING = ("said", "says", "wrote", "called", "term", "word", "quote", "quoted", "citation", "écrit", "dit", "mot", "sagte", "schrieb", "wort", "zitat", "dijo", "escribió", "palabra", "cita")
ADDRESSING = ("you", "your", "you're", "u", "tu", "toi", "vous", "du", "dich", "dein", "ihr", "eres", "usted", "te")
QUOTES = "\"“”„«»‹›‘’"


def _word_points() -> np.ndarray:
    out = np.zeros(1 << 16, bool)
    out[[c for c in range(1 << 16) if not 0xD800 <= c < 0xE000 and chr(c).isalnum()]] = True
    out[[ord("@"), ord("$")]] = True
    return out


WORD_POINTS = _word_points()
QUOTE_POINTS = np.zeros(1 << 16, bool)
QUOTE_POINTS[[ord(c) for c in QUOTES]] = True


class Words:
    """The words of a block of texts: code points, where words begin and end, and whose they are."""

    def __init__(self, texts_: list[str]):
        low = [t.lower() for t in texts_]
        points = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.points = np.where(points < 1 << 16, points, 0)
        sizes = np.array([len(t) + 1 for t in low], np.int64)
        mark = np.zeros(len(self.points) + 2, np.int8)
        mark[1:-1] = WORD_POINTS[self.points]
        step = np.diff(mark)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.row_ends = np.cumsum(sizes)
        self.row = np.searchsorted(self.row_ends, self.starts, side="right")

    def text(self, i: int) -> str:
        return "".join(map(chr, self.points[self.starts[i] : self.ends[i]].tolist()))

    def distinct(self, longest: int) -> tuple[Words, np.ndarray, np.ndarray]:
        """Each of the words of at most ``longest`` characters once, the numbers of all these words, and
        which of the distinct ones each is."""
        n = self.ends - self.starts
        short = np.flatnonzero(n <= longest)
        width = -(-max(longest, 1) // 4) * 4
        chars = np.zeros((len(short), width), np.uint16)
        for k in range(longest):
            has = np.flatnonzero(n[short] > k)
            chars[has, k] = self.points[self.starts[short[has]] + k]
        key = np.zeros(len(short), np.uint64)
        for part in chars.view(np.uint64).T:
            key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        if not np.array_equal(chars[first][which], chars):  # two words of one hash
            first = which = np.arange(len(short))
        out = copy.copy(self)
        out.starts, out.ends, out.row = (x[short[first]] for x in (self.starts, self.ends, self.row))
        return out, short, which


class Automaton:
    """A deterministic automaton over character classes; state 0 is dead, 1 the start."""

    def __init__(self, alphabet: str):
        self.classes = np.zeros(1 << 16, np.uint16)
        for k, c in enumerate(sorted(set(alphabet)), 1):
            if ord(c) < 1 << 16:
                self.classes[ord(c)] = k
        self.width = int(self.classes.max()) + 1
        self.step = np.zeros((2, self.width), np.int32)
        self.accepts = np.full(2, -1, np.int32)
        self.costs = np.zeros(2, np.int32)
        self.open = np.zeros(2, bool)
        self.longest = 0

    def run(self, words: Words) -> np.ndarray:
        """The term that each word ends in, -1 for none."""
        return self.nearest(words)[0]

    def nearest(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The term that each word ends in, -1 for none, and its edits."""
        cost = np.zeros(len(words.starts), np.int32)
        out = np.full(len(words.starts), -1, np.int32)
        n = words.ends - words.starts
        live = np.arange(len(n))
        state = np.ones(len(n), np.int32)
        for k in range(self.longest + 1):
            over = n[live] == k
            if over.any():
                ended = self.accepts[state[over]]
                out[live[over]] = np.where(ended >= 0, ended, out[live[over]])
                cost[live[over]] = self.costs[state[over]]
            stays = ~over & (state != 0)
            held = stays & self.open[state]
            if held.any():  # a stem: any ending is accepted
                out[live[held]] = self.accepts[state[held]]
            live, state = live[stays], state[stays]
            if not len(live):
                break
            state = self.step[state, self.classes[words.points[words.starts[live] + k]]]
        return out, cost


def exact_automaton(terms: list[str]) -> Automaton:
    """A trie of the terms; a term that ends in ``*`` accepts any ending."""
    made = Automaton("".join(t.rstrip("*") for t in terms))
    nodes: list[dict[int, int]] = [{}, {}]
    accepts, opened = {}, set()
    for i, t in enumerate(terms):
        at = 1
        for c in t.rstrip("*"):
            k = int(made.classes[ord(c)]) if ord(c) < 1 << 16 else 0
            if k not in nodes[at]:
                nodes[at][k] = len(nodes)
                nodes.append({})
            at = nodes[at][k]
        if t.endswith("*"):
            opened.add(at)
            accepts.setdefault(at, i)
        else:
            accepts[at] = i
    made.step = np.zeros((len(nodes), made.width), np.int32)
    made.accepts = np.full(len(nodes), -1, np.int32)
    made.costs = np.zeros(len(nodes), np.int32)
    made.open = np.zeros(len(nodes), bool)
    for at, own in enumerate(nodes):
        for k, to in own.items():
            made.step[at, k] = to
    made.step[:, 0] = 0
    for at, i in accepts.items():
        made.accepts[at] = i
    made.open[list(opened)] = True
    made.longest = max((len(t) for t in terms), default=0)
    return made


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def fuzzy_automaton(terms: list[str]) -> Automaton:
    """Levenshtein automata of the terms intersected with their trie, determinised.

    A state is a set of (trie node, edits so far); a node knows the most edits that any term below it allows,
    so sets hold no pair that can't end in a match."""
    made = Automaton("".join(terms))
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    budget = [0]
    for i, t in enumerate(terms):
        at, e = 0, allowed_edits(t)
        budget[0] = max(budget[0], e)
        for c in t:
            k = int(made.classes[ord(c)])
            if k not in children[at]:
                children[at][k] = len(children)
                children.append({})
                budget.append(0)
            at = children[at][k]
            budget[at] = max(budget[at], e)
        ends[at] = i

    def closed(pairs: dict[int, int]) -> frozenset:
        """With the terms' characters that the word leaves out."""
        todo = list(pairs)
        while todo:
            node = todo.pop()
            for to in children[node].values():
                cost = pairs[node] + 1
                if cost <= budget[to] and cost < pairs.get(to, 99):
                    pairs[to] = cost
                    todo.append(to)
        return frozenset(pairs.items())

    start = closed({0: 0})
    number, states = {frozenset(): 0, start: 1}, [frozenset(), start]

    def after(state: frozenset, k: int) -> int:
        to: dict[int, int] = {}
        for node, cost in state:
            if k in children[node]:
                child = children[node][k]
                to[child] = min(to.get(child, 99), cost)
            if cost < budget[node]:
                to[node] = min(to.get(node, 99), cost + 1)  # a character too many
                for child in children[node].values():
                    if cost < budget[child]:
                        to[child] = min(to.get(child, 99), cost + 1)  # another character
        key = closed(to)
        if key not in number:
            number[key] = len(states)
            states.append(key)
        return number[key]

    step: list[list[int]] = [[0] * made.width]
    at = 1
    while at < len(states):
        row = [after(states[at], 0)] * made.width  # class 0 continues no node
        for k in {k for node, _ in states[at] for k in children[node]} - {0}:
            row[k] = after(states[at], k)
        step.append(row)
        at += 1
    made.step = np.array(step, np.int32)
    made.accepts = np.full(len(states), -1, np.int32)
    made.costs = np.zeros(len(states), np.int32)
    for i, own in enumerate(states):
        hits = [(cost, ends[node]) for node, cost in own if node in ends and cost <= allowed_edits(terms[ends[node]])]
        if hits:
            made.costs[i], made.accepts[i] = min(hits)
    made.open = np.zeros(len(states), bool)
    made.longest = max((len(t) + allowed_edits(t) for t in terms), default=0)
    return made


FEATURES = 7


class Lexicon:
    """Terms with weights, strongest first, and their automata."""

    def __init__(self, terms: list[tuple[str, float]]):
        self.terms = [t for t, _ in terms]
        self.weights = np.array([w for _, w in terms] or [0.0])
        self.exact = exact_automaton(self.terms)
        whole = sorted((t, i) for i, t in enumerate(self.terms) if not t.endswith("*") and allowed_edits(t))
        self.fuzzy: list[tuple[Automaton, np.ndarray]] = []
        for k in range(0, len(whole), FUZZY_TERMS_A_TRIE):
            ids = sorted(i for _, i in whole[k : k + FUZZY_TERMS_A_TRIE])
            self.fuzzy.append((fuzzy_automaton([self.terms[i] for i in ids]), np.array(ids)))
        cues = [*REPORTING, *ADDRESSING]
        self.cues = exact_automaton(cues)
        self.reporting = len(REPORTING)

    def misspelled(self, words: Words) -> np.ndarray:
        """The nearest whole-word term within its distance of each word, the strongest of these; -1 for none."""
        out = np.full(len(words.starts), -1)
        once, at, which = words.distinct(max((a.longest for a, _ in self.fuzzy), default=0))
        none = 99 * len(self.terms)
        best = np.full(len(once.starts), none)
        for automaton, ids in self.fuzzy:
            term, cost = automaton.nearest(once)
            best = np.minimum(best, np.where(term >= 0, cost * len(self.terms) + ids[term], none))
        if self.fuzzy:
            out[at] = np.where(best < none, best % len(self.terms), -1)[which]
        return out

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, terms, whether each is misspelled, and its share after its context."""
        exact = self.exact.run(words)
        found = np.where(exact >= 0, exact, self.misspelled(words))
        at = np.flatnonzero(found >= 0)
        if not len(at):
            return at, at, at.astype(bool), at.astype(float)
        cue = self.cues.run(words)
        quotes = np.concatenate([[0], np.cumsum(QUOTE_POINTS[words.points])])
        share = np.ones(len(at))
        for k, i in enumerate(at.tolist()):
            a, b = i, i
            while a > 0 and i - a < WINDOW and words.row[a - 1] == words.row[i]:
                a -= 1
            while b + 1 < len(cue) and b - i < WINDOW and words.row[b + 1] == words.row[i]:
                b += 1
            row = words.row[i]
            since = words.ends[a - 1] if a > 0 and words.row[a - 1] == row else words.row_ends[row - 1] if row else 0
            until = words.starts[b + 1] if b + 1 < len(cue) and words.row[b + 1] == row else words.row_ends[row] - 1
            left, right = quotes[words.starts[i]] - quotes[since], quotes[until] - quotes[words.ends[i]]
            near = cue[a : b + 1]
            reported = ((near >= 0) & (near < self.reporting)).any()
            addressed = (near >= self.reporting).any()
            if (left and right or reported) and not addressed:
                share[k] = QUOTED_SHARE
        return at, found[at], exact[at] < 0, share

    def features(self, texts_: list[str]) -> np.ndarray:
        words = Words(texts_)
        at, term, misspelled, share = self.hits(words)
        n = np.bincount(words.row, minlength=len(texts_))[: len(texts_)]
        out = np.zeros((len(texts_), FEATURES))
        out[:, 0] = 1
        row = words.row[at]
        weight = self.weights[term] * share
        strong = self.weights[term] >= STRONG_LOG_ODDS
        add = lambda mask, values: np.bincount(row[mask], values[mask], len(texts_))
        every = np.ones(len(at), bool)
        out[:, 1] = np.log1p(add(strong & ~misspelled, weight))
        out[:, 2] = np.log1p(add(~strong & ~misspelled, weight))
        out[:, 3] = np.log1p(add(misspelled, weight))
        out[:, 4] = np.log1p(add(every, weight) / np.maximum(n, 1) * 100)
        distinct = np.unique(row * len(self.weights) + term)
        firm = self.weights[distinct % len(self.weights)] >= STRONG_LOG_ODDS
        out[:, 5] = np.log1p(np.bincount(distinct[firm] // len(self.weights), minlength=len(texts_)))
        out[:, 6] = np.log1p(n) / 10
        return out


def fit(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(features.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -35, 35)))
        slope = features.T @ (p - labels) + penalty * w
        curve = (features * (p * (1 - p))[:, None]).T @ features + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def terms_of(text: str) -> set[str]:
    """The distinct words and stems of a text."""
    words = Words([text])
    found = {words.text(i) for i in range(len(words.starts)) if 3 <= words.ends[i] - words.starts[i] <= LONGEST_WORD}
    return found | {f"{w[:n]}*" for w in found for n in STEM_LENGTHS if len(w) > n}


def training_rows(docs: DataFrame, labels: DataFrame, max_train_docs: int) -> DataFrame:
    """text, toxic and fold (of FOLDS) of the sample's documents, as a table. Its label rows are broadcast: they
    are those with the least hashes of doc_id, ``max_train_docs`` at most."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rows = known.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("label_id"), "label_id", "toxic").limit(max_train_docs)
    rest = F.crc32(F.col("doc_id").cast("string")) % 4  # 0, 1 or 3: the remainder 2 is held out
    found = docs.where(~held_out()).select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("label_id"))
    return cut(found.select(F.coalesce("text", F.lit("")).alias("text"), "toxic", F.when(rest == 3, 2).otherwise(rest).cast("int").alias("fold")), "labelled")


FOLDS = 3


def count_terms(sample: DataFrame) -> DataFrame:
    """term, and its numbers of toxic and clean documents by fold (t0, c0, t1, ...), of the terms that
    LEAST_DOCS toxic documents have; the term '' counts all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_slices(batches):
            sums: Counter[tuple[str, int, bool]] = Counter()
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums.update((t, fold, toxic == 1) for t in terms_of(text))
                sums["", fold, toxic == 1] += 1
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.bool_()))] + [pa.array(list(sums.values()), pa.int64())], ["term", "fold", "toxic", "n"])

    counted = bounded_batches(sample).mapInArrow(tidy(count), "term string, fold int, toxic boolean, n long")
    of = lambda k, toxic: F.coalesce(F.sum(F.when((F.col("fold") == k) & (F.col("toxic") == toxic), F.col("n"))), F.lit(0)).alias(f"{'t' if toxic else 'c'}{k}")
    sums = counted.groupBy("term").agg(*(of(k, toxic) for k in range(FOLDS) for toxic in (True, False)))
    return cut(sums.where(f"{' + '.join(f't{k}' for k in range(FOLDS))} >= {LEAST_DOCS} OR term = ''"), "terms")


def best_terms(counted: DataFrame, folds: list[int], max_terms: int) -> list[tuple[str, float]]:
    """The terms with the highest log odds over some folds, strongest first."""
    total = lambda row, x: sum(row[f"{x}{k}"] for k in folds) if row else 0
    every = counted.where("term = ''").first()
    toxic, clean = (sum((F.col(f"{x}{k}") for k in folds), F.lit(0)) for x in "tc")
    odds = F.log((toxic + 0.5) / (total(every, "t") + 1)) - F.log((clean + 0.5) / (total(every, "c") + 1))
    scored = counted.where(F.col("term") != "").select("term", toxic.alias("toxic"), odds.alias("odds")).where((F.col("toxic") >= LEAST_DOCS) & (F.col("odds") >= LEAST_LOG_ODDS))
    return [(r["term"], r["odds"]) for r in scored.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(max_terms).collect()]


def learn(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, max_terms: int = MAX_TERMS) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the score's weights. Each document is described for the regression by a lexicon of the
    other folds, so all of them count for both."""
    spark = docs.sparkSession
    sample = training_rows(docs, labels, max_train_docs)
    counted = count_terms(sample)
    lexicons = [Lexicon(best_terms(counted, [j for j in range(FOLDS) if j != k], max_terms)) for k in range(FOLDS)]
    lexicon = Lexicon(best_terms(counted, list(range(FOLDS)), max_terms))
    shipped = spark.sparkContext.broadcast(lexicons)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(FOLDS):
                own = batch.filter(pc.equal(batch.column(2), k))
                _, offsets = text_view(own.column(0))
                for a, b in row_blocks(offsets, BLOCK_BYTES // 2):
                    rows = shipped.value[k].features(own.column(0).slice(a, b - a).to_pylist())
                    yield pa.RecordBatch.from_arrays([own.column(1).slice(a, b - a), pa.array(list(rows), pa.list_(pa.float64()))], ["toxic", "x"])

    got = bounded_batches(sample).mapInArrow(tidy(describe), "toxic int, x array<double>").collect()
    drop_cut(sample)
    drop_cut(counted)
    y = np.array([r["toxic"] == 1 for r in got], float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return lexicon, np.array([math.log(max(share, 1e-15) / max(1 - share, 1e-15))] + [0.0] * (FEATURES - 1))
    x = np.array([r["x"] for r in got])
    order = np.lexsort([*x.T, y])  # the rows come in any order, and sums of floats follow it
    return lexicon, fit(x[order], y[order])


def score(docs: DataFrame, labels: DataFrame | None = None, model: tuple[Lexicon, np.ndarray] | None = None, threshold: float = THRESHOLD, **how) -> DataFrame:
    """doc_id, held_out, score, predicted and n_hits of each document; the model is learned from ``labels``
    unless one is given."""
    if model is None:
        model = learn(docs, labels, **how)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = texts(docs, held_out().alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, w = shipped.value
        for batch in batches:
            _, offsets = text_view(batch.column(1))
            parts = [np.zeros(0)]
            for a, b in row_blocks(offsets, BLOCK_BYTES // 2):
                x = lexicon.features(batch.column(1).slice(a, b - a).to_pylist())
                parts.append(1 / (1 + np.exp(-np.clip(x @ w, -35, 35))))
            p = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
