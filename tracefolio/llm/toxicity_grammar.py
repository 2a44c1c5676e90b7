"""Toxicity by a weighted finite-state pattern grammar.

Transducers, with weights that add up along a path:

* *insult* and *threat*: word stems (a trie over the starts of words) to the classes I and T, with a weight each;
* *target*, *negation*, *reported speech*: whole words to the classes Y, N and R; sentence ends to a boundary;
* *negation*: an I or T within three words of N loses most of its weight;
* *report*: after R, an I or T counts for half, up to the boundary;
* *aim*: Y and I or T in one clause add a bonus; a threat without a target loses most of its weight.

The last three are composed into one machine (``compose``), which is determinised by construction: one state and weight for each
(state, class). It reads each clause that has an insult or threat; clauses without one are never read word by word. Matched
clauses, not words, are scored: a document's features are its clause weights' sum, the largest one, the number of matched
clauses and their density, and a logistic model turns them to a score.

Learning: the insult stems and their weights come from a bounded sample of labelled rows (SAMPLE of each label at most, the first
ones by a hash of doc_id, near copies counted once); threats, targets, negations and reporting words are fixed lists below. The logistic
model is fitted on the same sample and its intercept is set to the labels' true ratio. Labels of held-out rows are never read.

Texts are read whole, where they lie; no row is moved. Defined results: null and empty texts have no clause and get the score of
a document without matches; a very long text, or clause, is read as any other; of rows that share a doc_id the least text is learned from, and all are
scored; columns besides doc_id and text are ignored, whatever their names; with no labels, or labels of one kind, only the fixed threats match and fixed coefficients are
used; labels that are null, repeated (the larger one counts) or of unknown documents do no harm; every row gives a row.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from math import exp, lgamma, log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefolio.llm.common import doc_texts, local_rows, map_rows, settle
from tracefolio.llm.quality_forest import filter_rows

#: Labelled rows of each label that may be learned from, at most.
SAMPLE = 2048
#: A stem's length, the toxic documents that must have it, their share among all documents that have it, and how many stems as good as it chance may bring forth.
STEM, SUPPORT, PRECISION, BY_CHANCE = (4, 8), 4, 0.75, 0.5
LIMIT = 0.3

# Fixed word lists of the grammar (English, French, German, Spanish).
THREATS = ("kill", "hurt", "destroy", "shoot", "murder", "tuer", "frapper", "töten", "schlagen", "matar", "golpear")
TARGETS = frozenset("you your youre yourself u he she they them him her this that those vous toi tu ton te ihr du dich dir euch tú ti usted ustedes te".split())
NEGATIONS = frozenset("not no never isnt arent wasnt dont doesnt didnt wont cant without ne pas jamais sans nicht kein keine nie ohne sin nunca jamás".split())
REPORTS = frozenset("said says say wrote writes quoted quote reported according claimed called dit disait selon sagte laut schrieb dijo según escribió".split())

WORD = re.compile(r"[\w']+")
CLAUSE = re.compile(r"[.!?;\n]+(?:\s|$)|\n")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)


# --- machines --------------------------------------------------------------------------------------------------------


@dataclass
class Machine:
    """A deterministic weighted machine over classes: (state, class) to (state, factor on the symbol's own weight, weight added). State 0 starts."""

    arcs: dict[tuple[int, int], tuple[int, float, float]]
    states: int


def make(states: int, step) -> Machine:
    return Machine({(s, c): step(s, c) for s in range(states) for c in range(6)}, states)


def compose(a: Machine, b: Machine) -> Machine:
    """Both machines over the same symbols: states are pairs, factors multiply, weights add. Only pairs that are reached are kept."""
    names, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
    while todo:
        s = todo.pop()
        for c in range(6):
            (p, f, w), (q, g, v) = a.arcs[s[0], c], b.arcs[s[1], c]
            if (p, q) not in names:
                names[p, q] = len(names)
                todo.append((p, q))
            arcs[names[s], c] = (names[p, q], f * g, w + v)
    return Machine(arcs, len(names))


HARM = (INSULT, THREAT)
#: After a negation, three words are under it.
NEGATED = make(4, lambda s, c: (3 if c == NEGATION else max(0, s - 1), 0.2 if s and c in HARM else 1.0, 0.0))
REPORTED = make(2, lambda s, c: (1 if c == REPORT else s, 0.5 if s and c in HARM else 1.0, 0.0))
#: States: nothing, target, harm, both. The bonus comes once, when target and harm have met.
AIMED = make(4, lambda s, c: (3 if s == 3 or (s == 1 and c in HARM) or (s == 2 and c == TARGET) else 1 if c == TARGET else 2 if c in HARM else s, 1.0 if c != THREAT or s & 1 else 0.3, 0.3 if (s == 1 and c in HARM) or (s == 2 and c == TARGET) else 0.0))
GRAMMAR = compose(compose(NEGATED, REPORTED), AIMED)


class Trie:
    """Stems at the starts of words; the longest one that fits has the word."""

    def __init__(self, stems: dict[str, tuple[int, float]]):
        import ahocorasick

        self.stems = stems
        self.machine = ahocorasick.Automaton()
        for stem in stems:
            self.machine.add_word(stem, stem)
        if stems:
            self.machine.make_automaton()
        self.lengths = sorted({len(s) for s in stems}, reverse=True)

    def hits(self, lower: str) -> list[int]:
        """Where stems begin, at the starts of words."""
        if not self.stems:
            return []
        out = []
        for end, stem in self.machine.iter(lower):
            at = end - len(stem) + 1
            if not at or not (lower[at - 1].isalnum() or lower[at - 1] == "_"):
                out.append(at)
        return out

    def of(self, word: str) -> tuple[int, float] | None:
        for n in self.lengths:
            found = self.stems.get(word[:n])
            if found and len(word) >= n:
                return found
        return None


@dataclass
class Model:
    stems: dict[str, tuple[int, float]] = field(default_factory=lambda: {t: (THREAT, 1.5) for t in THREATS})
    coefficients: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.0, 0.5, 0.3, 0.1]))
    base: float = 0.05

    def grammar(self) -> "Grammar":
        return Grammar(self)


class Grammar:
    """A model made ready to read texts."""

    def __init__(self, model: Model):
        self.model, self.trie, self.arcs = model, Trie(model.stems), GRAMMAR.arcs

    def classify(self, word: str) -> tuple[int, float]:
        found = self.trie.of(word)
        if found:
            return found
        word = word.replace("'", "")
        return (TARGET if word in TARGETS else NEGATION if word in NEGATIONS else REPORT if word in REPORTS else OTHER), 0.0

    def clause(self, words: list[str]) -> float:
        state, total = 0, 0.0
        for w in words:
            c, weight = self.classify(w)
            state, factor, more = self.arcs[state, c]
            total += factor * weight + more
        return total

    def clauses(self, text: str) -> tuple[list[float], int]:
        """Weights of the clauses that have a hit, and the number of hits."""
        lower = text.lower()
        hits = sorted(set(self.trie.hits(lower)))
        out, done = [], 0
        for at in hits:
            if at < done:
                continue
            # the clause around the hit, however long: from the boundary before to the one after; no character is looked at twice
            start = max((m.end() for m in CLAUSE.finditer(lower, done, at)), default=done)
            m = CLAUSE.search(lower, at)
            stop = m.start() if m else len(lower)
            out.append(self.clause(WORD.findall(lower, start, stop)))
            done = max(stop, at + 1)
        return out, len(hits)

    def features(self, text: str) -> np.ndarray:
        weights, hits = self.clauses(text)
        if not weights:
            return np.array([1.0, 0, 0, 0, 0])
        return np.array([1.0, np.log1p(sum(weights)), min(max(weights), 8.0), np.log1p(len(weights)), 100 * hits / max(50, text.count(" ") + 1) ** 0.75])

    def score(self, text: str) -> float:
        x = self.features(text)
        if not x[1:].any():
            return self.model.base
        return float(1 / (1 + np.exp(-np.clip(x @ self.model.coefficients, -30, 30))))


# --- learning --------------------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def tail(k: int, n: int, p: float) -> float:
    """The chance of k or more hits in n draws."""
    logs = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p) for i in range(k, n + 1)]
    return min(1.0, sum(map(exp, logs)))


def stems_of(words: dict[str, int]) -> Counter:
    """How often words begin with each stem."""
    out: Counter = Counter()
    for w, n in words.items():
        for k in range(STEM[0], min(STEM[1], len(w)) + 1):
            out[w[:k]] += n
    return out


def learn_stems(seen: dict[str, tuple[int, int, int, int]], clean_rows: int, toxic_rows: int, ratio: float, tried: int | None = None) -> dict[str, tuple[int, float]]:
    """Starts of words that mark toxic documents, from counts of sampled documents: (clean, toxic, clean with it twice, toxic with it twice).

    Once is enough for one reading, twice is asked for by the other: common stems stray into clean documents once. Clean documents are
    weighted up to their share among all labelled rows (``ratio`` is the toxic ones'), for the sample may hold as many toxic as clean ones;
    and no more than BY_CHANCE of the ``tried`` stems may come out as good by chance. A stem is taken if no shorter one that was taken begins it.
    """
    weight = (1 - ratio) / ratio * toxic_rows / max(1, clean_rows)
    rate = toxic_rows / max(1, clean_rows + toxic_rows)
    out: dict[str, tuple[int, float]] = {}
    allowed = BY_CHANCE / max(1, tried or sum(s[1] >= SUPPORT for s in seen.values()))

    def marks(toxic: int, clean: int) -> bool:
        return toxic >= SUPPORT and toxic >= PRECISION * (toxic + clean * weight) and tail(toxic, toxic + clean, rate) < allowed

    for stem in sorted(seen, key=lambda s: (len(s), s)):
        c1, t1, c2, t2 = seen[stem]
        once, twice = marks(t1, c1), marks(t2, c2)
        if (once or twice) and not any(stem[:k] in out for k in range(STEM[0], len(stem))):
            c, t = (c1 * weight, t1) if once else (c2 * weight, t2)
            out[stem] = (INSULT, float(np.clip(np.log((t + 0.5) / (c + 0.5)), 0.5, 3.0)) * (1.0 if once else 0.5))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Newton's method; coefficients of features other than the first are kept from going below zero."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (y - p) - ridge * np.r_[0, b[1:]]
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.diag(np.r_[1e-6, np.ones(len(b) - 1)])
        b = b + np.linalg.solve(h, g)
        b[1:] = np.maximum(b[1:], 0)
    return b


def fit_model(stems: dict[str, tuple[int, float]], x: np.ndarray, y: np.ndarray, ratio: float) -> Model:
    """A model from features and labels of the sample; ratio: share of toxic rows among all labelled rows."""
    b = fit_logistic(x, y)
    share = y.mean()
    b[0] += np.log(ratio / (1 - ratio)) - np.log(share / (1 - share))
    empty = ~x[:, 1:].any(axis=1)
    t, c = y[empty].sum() * ratio / share, (1 - y[empty]).sum() * (1 - ratio) / (1 - share)
    return Model(stems, b, float(min(0.25, (t + 0.5 * ratio) / (t + c + 1))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labelled rows that are not held out. Stems and features of the sample reach the driver; texts and words do not."""
    from tracefolio.llm.bag_minhash import _signed, claim_words, shingles

    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {int(r["toxic"]): r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return Model()
    picked = [(r["doc_id"], int(r["toxic"])) for k in counts for r in known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    chosen = local_rows(spark, picked, "label_id long, toxic int")
    labelled = doc_texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    # of rows with one doc_id the least text counts, so no more rows than labels are learned from; for these a few tasks are enough
    rows = settle(labelled.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic"), "labelled").coalesce(16)

    def sign():
        claim_words()

        def work(cols: dict) -> list[tuple]:
            bags = [shingles(t) for t in cols["text"]]
            keys = iter(_signed([b[:2] for b in bags if len(b[0])]).tolist())
            return [(d, n, k, next(keys) if len(b[0]) else []) for d, n, k, b in zip(cols["doc_id"], cols["node"], cols["toxic"], bags)]

        return work

    rows = rows.withColumn("node", F.xxhash64("text"))
    got, buckets = {}, set()
    for r in sorted(map_rows(rows, "doc_id long, node long, toxic int, bands array<long>", sign).collect(), key=lambda r: (r["doc_id"], r["node"])):
        if buckets.isdisjoint(r["bands"]):  # else a near copy of an earlier one
            buckets.update(r["bands"])
            got[r["doc_id"], r["node"]] = r["toxic"]
    n_toxic = sum(got.values())
    if not 0 < n_toxic < len(got):
        return Model()

    def count():
        def work(cols: dict) -> list[tuple]:
            kept = ((k, t) for d, n, k, t in zip(cols["doc_id"], cols["node"], cols["toxic"], cols["text"]) if (d, n) in got)
            return [(stem, k, n > 1) for k, t in kept for stem, n in stems_of(Counter(WORD.findall(t.lower()))).items()]

        return work

    ratio = counts[1] / sum(counts.values())
    sums = map_rows(rows, "stem string, toxic int, twice boolean", count, batch=32).groupBy("stem").agg(
        F.count_if(F.col("toxic") == 0).alias("c1"), F.count_if(F.col("toxic") == 1).alias("t1"), F.count_if((F.col("toxic") == 0) & F.col("twice")).alias("c2"), F.count_if((F.col("toxic") == 1) & F.col("twice")).alias("t2")
    )
    sums = settle(sums.where(F.col("t1") >= SUPPORT), "stems")
    weighted = F.lit((1 - ratio) / ratio * n_toxic / (len(got) - n_toxic))
    precise = (F.col("t1") >= PRECISION * (F.col("t1") + F.col("c1") * weighted)) | (F.col("t2") >= PRECISION * (F.col("t2") + F.col("c2") * weighted))
    found = {r["stem"]: (r["c1"], r["t1"], r["c2"], r["t2"]) for r in sums.where(precise).collect()}
    stems = learn_stems(found, len(got) - n_toxic, n_toxic, ratio, sums.count()) | {t: (THREAT, 1.5) for t in THREATS}

    def measure():
        g = Model(stems).grammar()
        return lambda cols: [(d, n, k, [float(v) for v in g.features(t)]) for d, n, k, t in zip(cols["doc_id"], cols["node"], cols["toxic"], cols["text"])]

    x = {(r["doc_id"], r["node"]): (r["x"], r["toxic"]) for r in map_rows(rows, "doc_id long, node long, toxic int, x array<double>", measure).collect()}
    use = sorted(got)
    return fit_model(stems, np.array([x[k][0] for k in use]), np.array([x[k][1] for k in use], float), ratio)


def score_documents(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def start():
        g = model.grammar()
        return lambda cols: [(d, s, int(s >= limit)) for d, s in zip(cols["doc_id"], map(g.score, cols["text"]))]

    scored = map_rows(doc_texts(docs), "doc_id long, score double, predicted int", start)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_civil(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """The rows of ``docs`` whose score is under the limit, as they are."""

    def start():
        g = model.grammar()
        return lambda texts: [g.score(t) < limit for t in texts]

    return filter_rows(docs, start)
