"""Quality rules: rule statistics of a document, and an isolation forest over them.

Rules reject by fixed limits (too few words, too much repetition). What they keep is scored by an isolation forest: random
axis splits over the statistics of all labelled rows, dealt to the trees by a hash; anomalous documents are isolated early, so
their mean path is short. The threshold comes from all labelled rows, too: among the scores at which no more than ``clean_loss``
of the rows of good quality would go, the one that finds most of the bad ones.

Texts of labelled rows are moved once, to their doc_id; their statistics are written, and each tree is grown in a task from its rows. The trees
(of bounded depth) and the counts of BINS scores reach the driver; the forest, some ten thousand numbers, goes to the tasks, where every text is read whole, where it lies.

Defined results: a null text has no words and is rejected; labels that are null or of unknown documents are ignored; with
fewer than MINIMUM labelled rows, or labels of one kind only, no forest is fitted and the rules decide alone; every row
gives one row, repeated ones and null doc_ids too; of rows that share a doc_id the least text is learned from; very long texts are
read whole; an empty table gives no rows; other columns are ignored by ``quality_verdicts`` and kept by ``keep_documents``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefolio.llm.common import claim, doc_texts, map_rows, settle, small_batches

#: Labelled rows that a forest needs. Labels that go to every task, at most; beyond it they are joined by a shuffle.
MINIMUM, MOST_LABELS = 40, 2_000_000
#: Trees; rows that each has at least where there are so many (beyond it, each has its share of all rows); its depth; tasks that grow them.
TREES, LEAF_SAMPLE, DEPTH, SEED, TREE_TASKS = 100, 128, 7, 20, 32
#: The threshold lies on a bin's edge, or midway between two.
BINS = 1 << 16
CLEAN_LOSS = 0.002
MIN_WORDS, MAX_REPEAT = 50, 50

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: Repeated lines and repeated words count from this share on: below it they differ among good documents, and splits there would shorten every path.
USUAL = 0.3
STATS = ("word_length", "symbols", "upper", "marks", "bars", "distinct", "dup_lines", "repeat_words")  # the number of words has a limit of its own
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    code = ids[:n]
    for k in range(1, width):
        if int(code.max()) * len(seen) > 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(seen) + ids[k : k + n]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[starts + k] = True
    return int(covered.sum())


def text_stats(text: str) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """The five counts, and the statistics of STATS."""
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the six ASCII white spaces
    n = len(words)
    white = len(raw) - len(raw.translate(None, WHITE.encode()))
    word_chars = len(text) - white
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    upper, lower = (len(raw) - len(raw.translate(None, x)) for x in (UPPER, LOWER))
    m = max(n, 1)
    stats = [word_chars / m, n_symbols / max(word_chars, 1), upper / max(upper + lower, 1), raw.count(b"!") / m, raw.count(b"|") / m, len(set(words)) / m**0.8, max(0.0, dup / max(len(lines), 1) - USUAL), max(0.0, repeat / m - USUAL)]
    return (n, word_chars, n_symbols, dup, repeat), stats


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT * n_words


def mean_path(n: float) -> float:
    """The mean path length of a failed search among n points."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), split, left child, path length at the leaf. The right child follows the left one."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    length: np.ndarray
    size: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly, 0 to 1, of each row."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, left, length in zip(self.feature, self.split, self.left, self.length):
            at = np.zeros(len(x), np.int64)
            live = rows
            while len(live):
                f = feature[at[live]]
                inner = f >= 0
                live, f = live[inner], f[inner]
                here = at[live]
                at[live] = left[here] + (x[live, f] >= split[here])
            total += length[at]
        return 2.0 ** (-total / len(self.feature) / max(mean_path(self.size), 1e-9))


def mixed(z: np.ndarray) -> np.ndarray:
    """64 bits, mixed (splitmix64)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def marks(x: np.ndarray) -> np.ndarray:
    """64 bits of each row, by its statistics alone."""
    h = np.full(len(x), SEED, np.uint64)
    for column in np.ascontiguousarray(x, float).T:
        h = mixed((h ^ np.ascontiguousarray(column).view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))
    return h


def trees_of(h: np.ndarray, copies: float) -> np.ndarray:
    """(row, tree): every row goes to one tree, and to ``copies`` of them on average, so that trees of few rows are large enough."""
    more = (copies - 1) / (TREES - 1) * 2.0**64
    into = np.stack([mixed(h + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % (1 << 64))).astype(float) < more for t in range(TREES)], 1)
    into[np.arange(len(h)), (h % np.uint64(TREES)).astype(int)] = True
    return np.argwhere(into)


def copies_of(n: int) -> float:
    return min(float(TREES), max(1.0, TREES * LEAF_SAMPLE / max(n, 1)))


def grow_tree(x: np.ndarray, weight: np.ndarray, tree: int) -> list[list]:
    """A tree of all its rows: nodes [feature, split, left child, path length]. A row that is there ``weight`` times is a leaf of so many rows."""
    order = np.lexsort(x.T)
    x, weight = x[order], weight[order]
    rng = np.random.default_rng([SEED, tree])
    depth_limit = min(DEPTH, int(np.ceil(np.log2(max(int(weight.sum()), 2)))))
    nodes: list[list] = [[-1, 0.0, 0, 0.0]]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        k, rows, depth = todo.pop()
        part = x[rows]
        low, high = part.min(0), part.max(0)
        open_ = np.flatnonzero(high > low)
        if depth >= depth_limit or not len(open_):
            nodes[k][3] = depth + mean_path(int(weight[rows].sum()))
            continue
        f = int(rng.choice(open_))
        cut = rng.uniform(low[f], high[f])
        right = part[:, f] >= cut
        nodes[k][:3] = [f, cut, len(nodes)]
        todo += [(len(nodes), rows[~right], depth + 1), (len(nodes) + 1, rows[right], depth + 1)]
        nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
    return nodes


def forest_of(trees: list[list[list]], rows: int) -> Forest:
    """Trees, and the rows that went into all of them."""
    most = max(map(len, trees))
    flat = np.array([[*n, *[[-1, 0.0, 0, 0.0]] * (most - len(n))] for n in trees], float)
    return Forest(flat[..., 0].astype(int), flat[..., 1], flat[..., 2].astype(int), flat[..., 3], max(1, rows // len(trees)))


def grow(x: np.ndarray, weight: np.ndarray | None = None) -> Forest:
    """The forest of all rows, on one machine."""
    weight = np.ones(len(x), np.int64) if weight is None else weight
    pairs = trees_of(marks(x), copies_of(int(weight.sum())))
    rows = [pairs[pairs[:, 1] == t, 0] for t in range(TREES)]
    return forest_of([grow_tree(x[r], weight[r], t) for t, r in enumerate(rows) if len(r)], int(weight[pairs[:, 0]].sum()))


@dataclass
class Verdict:
    forest: Forest | None
    threshold: float


def marked(x: np.ndarray) -> np.ndarray:
    """63 bits by which rows of bad quality are chosen."""
    return (mixed(marks(x) ^ np.uint64(SEED)) >> np.uint64(1)).astype(np.int64)


def weights(good: np.ndarray, bad: np.ndarray, mark: np.ndarray, total: tuple[int, int, int]) -> np.ndarray:
    """How often each row is planted: the good rows say what is usual; a few bad ones among them keep splits open where bad rows lie. ``total``: good rows, bad rows, the least mark of a bad one."""
    n_good, n_bad, least = total
    share = max(1, n_good // 50) / n_bad
    return good + np.where((mark < share * 2.0**63) | (mark == least), bad, 0)


def enough(n_good: int, n_bad: int) -> bool:
    return n_good + n_bad >= MINIMUM and n_good > 0 and n_bad > 0


def bins(score: np.ndarray) -> np.ndarray:
    return np.minimum(score * BINS, BINS - 1).astype(np.int64)


def limit_of(good: dict[int, int], bad: dict[int, int], clean_loss: float) -> float:
    """The threshold from how many good and bad rows lie in each bin of the score."""
    may_go = int(sum(good.values()) * clean_loss)
    for k in sorted(good, reverse=True):
        may_go -= good[k]
        if may_go < 0:
            break
    beyond = min((b for b in bad if b > k), default=None)
    return (k + 1 if beyond is None else (k + 1 + beyond) / 2) / BINS


def fit(x: np.ndarray, good: np.ndarray, clean_loss: float = CLEAN_LOSS) -> Verdict:
    """A forest and a threshold from the statistics of labelled rows that the rules keep, on one machine; ``train`` gives the same by Spark."""
    if not enough(int(good.sum()), int((~good).sum())):
        return Verdict(None, 1.0)
    rows, back = np.unique(x, axis=0, return_inverse=True)
    n_good, n_bad = (np.bincount(back.ravel(), v).astype(np.int64) for v in (good, ~good))
    mark = marked(rows)
    weight = weights(n_good, n_bad, mark, (int(n_good.sum()), int(n_bad.sum()), int(mark[n_bad > 0].min())))
    forest = grow(rows[weight > 0], weight[weight > 0])
    at = bins(forest.score(x))
    counts = lambda chosen: dict(zip(*(v.tolist() for v in np.unique(at[chosen], return_counts=True))))
    return Verdict(forest, limit_of(counts(good), counts(~good), clean_loss))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality, stats, mark of every labelled document that the rules keep."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    if known.limit(MOST_LABELS + 1).count() <= MOST_LABELS:
        known = F.broadcast(known)
    labelled = doc_texts(docs).join(known, F.col("doc_id") == F.col("label_id"))
    # of rows with one doc_id the least text counts, however rows are dealt
    rows = labelled.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality")

    def start():
        claim("quality")

        def work(cols: dict) -> list[tuple]:
            out = []
            for doc_id, text, quality in zip(cols["doc_id"], cols["text"], cols["quality"]):
                counts, stats = text_stats(text)
                if not base_failed(counts[0], counts[4]):
                    out.append((doc_id, quality, [float(v) for v in stats]))
            mark = marked(np.array([r[2] for r in out], float).reshape(-1, len(STATS))).tolist()
            return [(*r, m) for r, m in zip(out, mark)]

        return work

    return map_rows(rows, "doc_id long, quality int, stats array<double>, mark long", start)


def labelled_stats(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels for ``fit``: every labelled row comes to the driver, so this is for tables that fit there."""
    got = sorted((r["doc_id"], r["quality"], r["stats"]) for r in labelled_rows(docs, labels).collect())
    return np.array([r[2] for r in got], float).reshape(-1, len(STATS)), np.array([r[1] == 1 for r in got], bool)


def train(docs: DataFrame, labels: DataFrame, clean_loss: float = CLEAN_LOSS) -> Verdict:
    """``fit`` over all labelled rows, by Spark: equal rows are pooled, each tree is grown where its rows are, scores are counted in bins. TREES trees and BINS counts reach the driver."""
    good = F.count_if(F.col("quality") == 1)
    pooled = settle(labelled_rows(docs, labels).groupBy("stats", "mark").agg(good.alias("good"), (F.count(F.lit(1)) - good).alias("bad")), "quality-stats")
    n_good, n_bad, least = pooled.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0)), F.min(F.when(F.col("bad") > 0, F.col("mark")))).first()
    if not enough(n_good, n_bad):
        return Verdict(None, 1.0)

    def matrix(cols: dict) -> np.ndarray:
        return np.array(cols["stats"], float).reshape(-1, len(STATS))

    def weighed(cols: dict) -> np.ndarray:
        return weights(np.array(cols["good"], np.int64), np.array(cols["bad"], np.int64), np.array(cols["mark"], np.int64), (n_good, n_bad, least))

    planted = map_rows(pooled, "stats array<double>, weight long", lambda: lambda c: [(s, w) for s, w in zip(c["stats"], weighed(c).tolist()) if w], batch=4096)
    copies = copies_of(planted.agg(F.sum("weight")).first()[0])

    def deal():
        def work(cols: dict) -> list[tuple]:
            weight = weighed(cols)
            at = np.flatnonzero(weight)
            return [(int(t), cols["stats"][at[r]], int(weight[at[r]])) for r, t in trees_of(marks(matrix(cols))[at], copies)]

        return work

    def plant(key, rows):
        import pandas as pd

        x, weight = np.array(rows["stats"].tolist(), float), rows["weight"].to_numpy(np.int64)
        return pd.DataFrame({"tree": [key[0]], "nodes": [grow_tree(x, weight, int(key[0]))], "n": [int(weight.sum())]})

    # from the pooled rows and not from the planted ones: a task with two Python steps holds two Python workers, and executors keep them
    dealt = map_rows(pooled, "tree int, stats array<double>, weight long", deal, batch=4096).repartition(TREE_TASKS, "tree")
    trees = sorted((r["tree"], r["nodes"], r["n"]) for r in dealt.groupBy("tree").applyInPandas(plant, "tree int, nodes array<array<double>>, n long").collect())
    forest = forest_of([nodes for _, nodes, _ in trees], sum(n for _, _, n in trees))

    def score():
        return lambda cols: list(zip(bins(forest.score(matrix(cols))).tolist(), cols["good"], cols["bad"]))

    counted = map_rows(pooled, "bin long, good long, bad long", score, batch=4096).groupBy("bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()
    return Verdict(forest, limit_of({r["bin"]: r["good"] for r in counted if r["good"]}, {r["bin"]: r["bad"] for r in counted if r["bad"]}, clean_loss))


def quality_verdicts(docs: DataFrame, labels: DataFrame, *, clean_loss: float = CLEAN_LOSS) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, anomaly."""
    return apply_verdict(docs, train(docs, labels, clean_loss))


def apply_verdict(docs: DataFrame, verdict: Verdict) -> DataFrame:
    def start():
        def work(cols: dict) -> list[tuple]:
            found = [text_stats(t) for t in cols["text"]]
            x = np.array([s for _, s in found], float).reshape(-1, len(STATS))
            score = verdict.forest.score(x) if verdict.forest else np.zeros(len(x))
            out = []
            for doc_id, (counts, _), a in zip(cols["doc_id"], found, score.tolist()):
                failed = base_failed(counts[0], counts[4])
                out.append((doc_id, *counts, failed, not failed and a <= verdict.threshold, a))
            return out

        return work

    return map_rows(doc_texts(docs), f"doc_id long, {COUNTS}, base_failed boolean, kept boolean, anomaly double", start, batch=1024)


def keep_documents(docs: DataFrame, labels: DataFrame, *, clean_loss: float = CLEAN_LOSS) -> DataFrame:
    """The rows of ``docs`` that the verdict keeps, as they are."""
    verdict = train(docs, labels, clean_loss)
    return filter_rows(docs, lambda: _keeper(verdict))


def _keeper(verdict: Verdict):
    def keep(texts: list[str]) -> list[bool]:
        found = [text_stats(t) for t in texts]
        x = np.array([s for _, s in found], float).reshape(-1, len(STATS))
        score = verdict.forest.score(x) if verdict.forest else np.zeros(len(x))
        return [not base_failed(c[0], c[4]) and a <= verdict.threshold for (c, _), a in zip(found, score.tolist())]

    return keep


def filter_rows(docs: DataFrame, start) -> DataFrame:
    """The rows whose text the function that ``start`` gives keeps; all columns, unchanged."""
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        claim("filter")
        keep = start()
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                yield part.filter(pa.array(keep([t or "" for t in part.column(at).to_pylist()]), pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
