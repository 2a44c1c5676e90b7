import random

import numpy as np
import pytest

from tracefolio.llm import bag_minhash as B


def brute(rows):
    """Classes by comparing all pairs of texts."""
    bags = [B.shingles(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = bags[i][2] == bags[j][2]
            if same or (len(bags[i][0]) and len(bags[j][0]) and B.similarity(bags[i][:2], bags[j][:2]) >= B.THRESHOLD):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 60), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def texts(seed, n):
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    out = []
    while len(out) < n:
        base = [word() for _ in range(random.choice([3, 8, 60, 150]))]
        if random.random() < 0.4:
            base += passage  # shared by many documents
        out.append(base)
        for _ in range(random.choice([0, 0, 1, 3])):
            copy = list(random.choice(out[-3:]))  # chains of copies
            for _ in range(random.randrange(0, max(1, len(copy) // 25) + 1)):
                copy[random.randrange(len(copy))] = word()
            out.append(copy)
    out += [["it"] * k for k in (5, 50, 52, 100)]
    return [(k, " ".join(t)) for k, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = texts(seed, 300)
    got = {r["doc_id"]: r["class_id"] for r in B.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_a_large_group_of_copies_and_edited_copies(spark):
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    rows = [(k, " ".join(base)) for k in range(300)]
    for k in range(300, 900):
        t = list(base)
        for _ in range(random.randrange(1, 4)):
            t[random.randrange(120)] = word()
        rows.append((k, " ".join(t)))
    rows += [(k, " ".join(word() for _ in range(80))) for k in range(900, 950)]
    got = {r["doc_id"]: r["class_id"] for r in B.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_signatures_are_unbiased_for_weights():
    rng = np.random.default_rng(0)
    off = []
    for _ in range(40):
        v = np.sort(rng.integers(0, 2**63, 30).astype(np.uint64))
        a = rng.integers(0, 20, 30)
        b = np.maximum(a + rng.integers(-5, 5, 30) * (rng.random(30) < 0.5), 0)
        one, two = (v[a > 0], a[a > 0]), (v[b > 0], b[b > 0])
        s = B.signatures([one, two], 512)
        off.append((s[0] == s[1]).mean() - B.similarity(one, two))
    assert abs(np.mean(off)) < 0.01


def test_signature_does_not_depend_on_company():
    bags = [B.shingles(t)[:2] for t in ("a b c d e f g h", "a", "x y z " * 40)]
    together = B.signatures(bags)
    for k, bag in enumerate(bags):
        assert (B.signatures([bag])[0] == together[k]).all()


def test_cross_links_are_exact():
    rng = np.random.default_rng(3)
    members = []
    base = np.sort(rng.integers(0, 2**63, 40).astype(np.uint64))
    for k in range(30):
        v = np.unique(np.concatenate([base[rng.random(40) < 0.9], rng.integers(0, 2**63, 3).astype(np.uint64)]))
        members.append((k, int(rng.integers(0, 5)), (v, rng.integers(1, 3, len(v)))))
    probes, homes = members[:12], members[5:]
    got = {(a, members[b][1]) for a, b in B.cross_links(probes, homes, 0.6)}
    assert got == {(i, other) for i, r, x in probes for _, other, y in homes if r != other and B.similarity(x, y) >= 0.6}


def shared(rows):
    """Similarities of all pairs of bags, as a matrix."""
    sets = [B.elements(b) for b in rows]
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = times[column] > 1
    keep, column = np.unique(column[use], return_inverse=True)
    x = np.zeros((len(sets), len(keep)), np.float32)
    x[np.repeat(np.arange(len(sets)), [len(s) for s in sets])[use], column] = 1
    common, size = x @ x.T, np.array([len(s) for s in sets])
    return common / (size[:, None] + size[None] - common)


def test_small_blocks_give_the_same_classes(spark, monkeypatch):
    """Every mixed group goes through the prefix filter and over several blocks."""
    monkeypatch.setattr(B, "BLOCK", 2)
    rows = texts(5, 300)
    got = {r["doc_id"]: r["class_id"] for r in B.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_a_passage_that_thousands_of_texts_share(spark):
    """5,000 different texts with one passage fill buckets together; pairs that are similar besides it are found, and no others."""
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(110)]
    rows = [passage + [word() for _ in range(random.choice([14, 20, 45]))] for _ in range(4900)]
    for k in range(100):
        copy = list(rows[k * 7])
        copy[-1 - k % 5] = word()
        rows.append(copy)
    rows = [(k, " ".join(t)) for k, t in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in B.near_duplicates(docs).collect()}
    near = (shared([B.shingles(t)[:2] for _, t in rows]) >= B.THRESHOLD - 1e-6) | np.eye(len(rows), dtype=bool)
    least = np.arange(len(rows))
    while ((new := np.array([least[n].min() for n in near])) != least).any():
        least = new
    assert [got[k] for k in range(len(rows))] == least.tolist()
    assert len(set(got.values())) > 1000


def test_prefixes_lose_no_link(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    rows = []
    for k in range(120):
        v = np.unique(np.concatenate([base[rng.random(60) < 0.93], rng.integers(0, 2**63, int(rng.integers(0, 14))).astype(np.uint64)]))
        rows.append((k, v, rng.integers(1, 3, len(v)) if k % 9 == 0 else np.ones(len(v), np.int64)))
    bags = spark.createDataFrame([(k, v.astype("<u8").tobytes(), c.astype("<u4").tobytes()) for k, v, c in rows], "node long, hashes binary, counts binary")
    nodes = spark.createDataFrame([(k, k, int(c.sum())) for k, _, c in rows], "node long, root long, n long")
    under = {}
    for r in B.prefixes(nodes, bags, 0.8).collect():
        under.setdefault(r["key"], set()).add(r["node"])
    met = {(a, b) for g in under.values() for a in g for b in g if a < b}
    near = {(i, j) for i, x, c in rows for j, y, d in rows if i < j and B.similarity((x, c), (y, d)) >= 0.8}
    assert near and near <= met


def test_one_of_each_keeps_the_least(spark):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (9, "h i j k l m n"), (None, "h i j k l m n"), (None, "only null ids here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in B.one_of_each(docs).collect()) == [(False, 3), (False, 9), (True, None)]
