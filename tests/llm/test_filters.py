"""Quality, toxicity, personal data, secrets."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracefolio.llm import pii_tagger, quality_forest, secret_ledger, toxicity_grammar

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
Q = quality_forest


@given(text=st.text(alphabet=" \t\n\x0b\x1fab#é|　", max_size=60))
@settings(max_examples=400, deadline=None)
def test_rule_counts(text):
    words = WORDS(text)
    n, chars, symbols, dup, repeat = quality_forest.text_stats(text)[0]
    assert n == len(words) and chars == sum(map(len, words)) and symbols == len(re.findall(r"[#*$%&|<>]", text))
    seen, want = set(), 0
    for line in text.split("\n"):
        if WORDS(line):
            want += line in seen
            seen.add(line)
    assert dup == want
    three = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + k for i in range(len(words) - 2) if three[tuple(words[i : i + 3])] > 1 for k in range(3)}
    assert repeat == len(marked)


def test_forest_finds_the_odd_one():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    f = quality_forest.grow(x)
    s = f.score(np.array([[0.0, 0, 0], [9.0, 9, 9]]))
    assert s[1] > 0.65 > s[0]
    # a path by hand
    tree = 0
    row, at, depth = x[7], 0, 0
    while f.feature[tree, at] >= 0:
        at = f.left[tree, at] + int(row[f.feature[tree, at]] >= f.split[tree, at])
        depth += 1
    assert f.length[tree, at] >= depth


def test_verdicts_against_brute_force(spark):
    """Sample, forest, threshold and verdicts made again from plain lists; path lengths by walking each tree."""
    sf, Q = "/root/testdata/sf0.01", quality_forest
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(rows[0][0], "another text of the same id"), (None, "no id " * 60)]
    got = {(r["doc_id"], r["n_words"], r["word_chars"]): r for r in Q.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    least = {}
    for d, t in rows:
        least[d] = min(least.get(d, t), t)
    known = {}
    for r in labels.collect():
        known[r["doc_id"]] = max(known.get(r["doc_id"], 0), r["quality"])
    sample = sorted((d, known[d], Q.text_stats(least[d])) for d in known if d in least)
    sample = [(q, s[1]) for _, q, s in sample if not Q.base_failed(s[0][0], s[0][4])]
    v = Q.fit(np.array([s for _, s in sample]), np.array([q == 1 for q, _ in sample]))
    for d, t in rows:
        counts, stats = Q.text_stats(t)
        total = 0.0
        for k in range(Q.TREES):
            at = 0
            while v.forest.feature[k, at] >= 0:
                at = v.forest.left[k, at] + int(stats[v.forest.feature[k, at]] >= v.forest.split[k, at])
            total += v.forest.length[k, at]
        anomaly = 2.0 ** (-total / Q.TREES / Q.mean_path(v.forest.size))
        r = got[d, counts[0], counts[1]]
        assert r["anomaly"] == pytest.approx(anomaly)
        assert r["kept"] == (not r["base_failed"] and r["anomaly"] <= v.threshold) and r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])


def test_repeated_lines_count():
    usual, much = Q.text_stats("a line here\nother line\n" + "\n".join(f"line {k}" for k in range(8)))[1], Q.text_stats("a line here\n" * 9 + "other")[1]
    k = Q.STATS.index("dup_lines")
    assert usual[k] == 0 and much[k] == pytest.approx(0.5)


def test_quality_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in quality_forest.quality_verdicts(docs, labels).collect()}
    q = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = [got[d] for d in q if q[d] == 1 and not got[d]["base_failed"]]
    bad = [got[d] for d in q if q[d] == 0]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(r["kept"] for r in bad) <= 0.1 * len(bad)
    kept = {r["doc_id"] for r in quality_forest.keep_documents(docs, labels).collect()}
    assert kept == {d for d, r in got.items() if r["kept"]}


G = toxicity_grammar


def test_composition_is_the_machines_one_after_the_other():
    import itertools

    ab = G.compose(G.NEGATED, G.REPORTED)
    for word in itertools.product(range(6), repeat=3):
        s = p = q = 0
        for c in word:
            (s, f, w), (p, f1, w1), (q, f2, w2) = ab.arcs[s, c], G.NEGATED.arcs[p, c], G.REPORTED.arcs[q, c]
            assert f == pytest.approx(f1 * f2) and w == pytest.approx(w1 + w2)


def test_grammar_reads_clauses():
    g = G.Model(stems={"idio": (G.INSULT, 2.0), "kill": (G.THREAT, 1.5)}).grammar()
    w = lambda t: sum(g.clauses(t)[0])
    assert w("you are an idiot") > w("what an idiot") > w("he said what an idiot") > w("not an idiot") > 0
    assert w("kill you") < w("you will be killed") and w("killing time") < 1
    assert g.clauses("An idiot. A fine day. Idiots!")[0] == g.clauses("An idiot. Idiots!")[0]
    assert w("a fine day") == 0 and w("overkill") == 0 and g.score("") == g.score("a fine day")


@pytest.mark.parametrize("n", [1, 300, 450, 5000])
def test_long_clauses_are_one(n):
    """Targets, reports and hits of a clause count however far they stand apart."""
    g = G.Model(stems={"idio": (G.INSULT, 2.0), "kill": (G.THREAT, 1.5)}).grammar()
    far = " word" * n
    for text in ("you {} an idiot", "he said {} what an idiot", "idiot {} you", "kill {} you {} idiot", "an idiot {} idiot {} idiots", "Fine. You said {} kill {} him. An idiot {}"):
        assert g.clauses(text.format(*[" word word word"] * 3)) == g.clauses(text.format(*[far + " word word"] * 3)), text


def test_no_hit_is_cut_in_two():
    g = G.Model(stems={"idio": (G.INSULT, 2.0)}).grammar()
    for n in range(1980, 2010):
        assert g.clauses("idiot" + " " * n + "idiot") == g.clauses("idiot idiot")


def plain_score(model, text):
    """A text's score from the rules as they are written in the module's text: no trie, no composed machine, all clauses read."""
    lower = text.lower()
    cuts = [0, *(x for m in G.CLAUSE.finditer(lower) for x in m.span()), len(lower)]
    weights, hits = [], 0
    for clause in (lower[a:b] for a, b in zip(cuts[::2], cuts[1::2])):
        under, reported, target, harm, aimed, total, mine = 0, False, False, False, False, 0.0, 0
        for word in G.WORD.findall(clause):
            stem = next((word[:n] for n in range(len(word), 0, -1) if word[:n] in model.stems), None)
            plain = word.replace("'", "")
            if stem:
                kind, weight = model.stems[stem]
                if kind == G.THREAT and not target:
                    weight *= 0.3
                total += weight * (0.2 if under else 1) * (0.5 if reported else 1)
                mine += 1
                harm = True
            target |= not stem and plain in G.TARGETS
            if harm and target and not aimed:
                aimed, total = True, total + 0.3
            negated = not stem and plain not in G.TARGETS and plain in G.NEGATIONS
            reported |= not stem and plain not in G.TARGETS and not negated and plain in G.REPORTS
            under = 3 if negated else max(0, under - 1)
        if mine:
            weights.append(total)
            hits += mine
    if not weights:
        return model.base
    x = [1.0, np.log1p(sum(weights)), min(max(weights), 8.0), np.log1p(len(weights)), 100 * hits / max(50, text.count(" ") + 1) ** 0.75]
    return 1 / (1 + np.exp(-np.clip(np.dot(x, model.coefficients), -30, 30)))


def test_scores_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = G.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    off = [d for r in G.score_documents(docs, model).collect() if abs(r["score"] - plain_score(model, texts[d := r["doc_id"]] or "")) > 1e-9]
    assert not off
    assert G.score_documents(docs, model).where("score >= 0.3").count() > 20


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in G.score_documents(docs, G.train(docs, labels)).collect()}
    rows = [(got[r["doc_id"]], r["toxic"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] for r, _ in rows)
    hit = sum(r["predicted"] == t for r, t in rows) / len(rows)
    found = sum(r["predicted"] for r, t in rows if t) / sum(t for _, t in rows)
    assert hit > 0.97 and found > 0.85 and all(0 <= r["score"] <= 1 for r, _ in rows)


P = pii_tagger


def plain_spans(text):
    """The base rules as written."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        s = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and s % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


@given(text=st.text(alphabet="ab@.+-_ 0123()\n%é", max_size=50))
@settings(max_examples=1000, deadline=None)
def test_base_spans(text):
    assert P.base_spans(text) == plain_spans(text)


def test_base_spans_are_linear():
    import time

    t = time.time()
    for text in ("a" * 400_000, "a@" * 200_000, "1" * 300_000, "1." * 200_000, "+1 " * 130_000, "a.b@c." * 80_000):
        P.base_spans(text)
    assert time.time() - t < 20


def test_gradient():
    rng = np.random.default_rng(1)
    t = P.Tagger.new(seed=1, hidden=3)
    t.w = [a.astype(np.float64) for a in t.w]
    x, y = rng.integers(1, P.CHARS, (4, 7)), rng.integers(0, P.TAGS, (4, 7))
    _, g = t.gradient(x, y)
    for k, at in ((0, None), (1, (1, 2)), (2, None), (3, (0, 5)), (4, (2, 3)), (5, (1,)), (6, (2, 4))):
        if at is None:
            at = tuple(np.argwhere(np.abs(g[k]) == np.abs(g[k]).max())[0])
        old = t.w[k][at]
        losses = []
        for d in (1e-2, -1e-2):
            t.w[k][at] = old + d
            losses.append(t.gradient(x, y)[0])
        t.w[k][at] = old
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(float(g[k][at]), rel=0.05, abs=2e-3)


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(2)
    s, tr = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    got = P.viterbi(s, np.array([4, 2]), tr)
    for r, n in ((0, 4), (1, 2)):
        best = max(itertools.product(range(3), repeat=n), key=lambda p: sum(s[r, k, c] for k, c in enumerate(p)) + sum(tr[a, b] for a, b in zip(p, p[1:])))
        assert tuple(got[r, :n]) == best


def test_tagger_learns_and_reconciles():
    rng = np.random.default_rng(5)
    words = ["thonre", "ering", "de", "la", "von", "and", "thing,", "er.", "ontion"]
    window = lambda: " ".join(rng.choice(words, 25))[: P.WINDOW]
    t = P.Tagger.new().train(*P.training_set([window() for _ in range(250)]))
    right = 0
    for k in range(60):
        kind = k % 4
        value = P.made_up(rng, kind)
        left = window() + " " + window() + " "
        text = left + value + " " + window()
        _, every = P.all_spans(t, [text])[0]
        right += any(kd == kind and a <= len(left) + 1 and b >= len(left) + len(value) - 1 for kd, a, b in every)
    assert right >= 48
    assert P.all_spans(t, ["plain words only " * 50])[0] == ([], [])
    # base spans stay, also where the tagger would say something else
    text = " ".join([window(), "me.you@mail.example.com", window(), "4111 1111 1111 1111"])
    base, every = P.all_spans(t, [text])[0]
    assert set(base) <= set(every) and len(base) == 2


@pytest.fixture(scope="module")
def tagger(spark):
    return P.train_tagger(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_added_spans_on_held_out_windows(spark, tagger):
    """New values in windows that training has not seen; spellings that it was trained on, and others."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id >= 1000 and doc_id < 1800").collect()]
    windows = [t[len(t) // 3 :][: P.WINDOW] for t in texts]
    odd, unseen = P.evaluate(tagger, windows, P.ODD), P.evaluate(tagger, windows, P.UNSEEN)
    assert all(precision >= 0.9 for precision, _ in [*odd.values(), *unseen.values()]), (odd, unseen)
    assert all(recall >= 0.7 for _, recall in odd.values()), odd
    assert np.mean([recall for _, recall in unseen.values()]) >= 0.5, unseen


@pytest.mark.parametrize("date", ["2024-01-15", "12/05/2023", "13/05/2023", "1.2.2023", "2024/1/5", "12/05/23", "2024-01-15 10"])
def test_dates_are_no_phones(date):
    assert not P.plausible(3, date)


@pytest.mark.parametrize("phone", ["555-123-4567", "(555) 123-4567", "0301 4567 8901", "555.010.2030", "12-34-5678"])
def test_phones_are_no_dates(phone):
    assert P.plausible(3, phone)


def test_nothing_is_added_to_prose_and_ids(tagger):
    for text in ("order 4111111111111112 of 12 items", "version 1.2.3.400 at noon", "we met at the dot. Com was not there", "1234567890123456 7654321", "look at it. The dot is at 12.30"):
        base, every = P.all_spans(tagger, [text])[0]
        assert every == base, (text, every)


def test_find_pii_against_brute_force(spark, tagger):
    """Each text by itself, with the base rules as written and one undivided pass over each region."""
    import hashlib

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(-1, "write to jo at mail dot example dot org or (020) 555-0182, host 10[.]0[.]0[.]7, card 4111.1111.1111.1111")]
    got = {r["doc_id"]: r for r in P.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), tagger).collect()}
    for d, t in rows:
        base = plain_spans(t)
        every = set(base)
        for a, b in P.regions(t):
            ids = P.char_ids(t[a:b])
            total, weight = np.zeros((len(ids), P.TAGS), np.float32), np.zeros(len(ids), np.float32)
            for k in range(0, max(1, len(ids) - P.WINDOW + P.STRIDE), P.STRIDE):
                x = np.zeros((1, P.WINDOW), np.int64)
                n = len(ids[k : k + P.WINDOW])
                x[0, :n] = ids[k : k + P.WINDOW]
                total[k : k + n] += tagger.scores(x)[0, :n] * P.EDGE[:n, None]
                weight[k : k + n] += P.EDGE[:n]
            tags = P.viterbi((total / weight[:, None])[None], np.array([len(ids)]), tagger.w[6])[0]
            for kind, x, y in P.tagged_spans(tags):
                x, y = P.snapped(kind, t, a + x, a + y)
                options = [(kind, x, y)]
                if kind:  # a number: all its groups may be a card, else it is what it was decoded as, else an address
                    u, v = x, y
                    while u and (m := re.search(r"[0-9][ ./_-]{0,2}$", t[:u])):
                        u = m.start()
                    while m := re.match(r"[ ./_-]{0,2}[0-9]", t[v:]):
                        v += m.end()
                    options = [(2, u, v), (kind, x, y), (1, u, v)]
                hit = next((o for o in options if P.plausible(o[0], t[o[1] : o[2]])), None)
                if hit and not any(hit[1] < q and p < hit[2] for _, p, q in base):
                    every.add(hit)
        r = got[d]
        assert r["base_sha256"] == hashlib.sha256(P.listed(base).encode()).hexdigest()
        assert r["spans"] == P.listed(sorted(every)) and [r[f"n_{k}"] for k in P.KINDS] == [sum(b[0] == i for b in base) for i in range(4)]
    assert "ip:64:78" in got[-1]["spans"] and "phone:43:57" in got[-1]["spans"]


def test_one_region_is_decoded_as_many(tagger):
    rng = np.random.default_rng(8)
    s = rng.normal(size=(3, 700, P.TAGS)).astype(np.float32)
    many = P.viterbi(s, np.array([700, 700, 700]), tagger.w[6])
    assert all((P.viterbi_one(s[k], tagger.w[6]) == many[k]).all() for k in range(3))


def test_long_regions_take_little_memory(tagger):
    """A million digits beside many short regions."""
    import tracemalloc

    texts = ["1 2" * 333_334] + ["call 555 now"] * 300
    tracemalloc.start()
    spans = P.all_spans(tagger, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(spans) == 301 and peak < 300e6


def test_mask():
    assert P.mask("a b@c.de, 1.2.3.4!", [(0, 2, 8), (1, 10, 17)]) == "a [EMAIL], [IP]!"
    assert P.mask("12345", [(2, 0, 4), (3, 2, 5)]) == "[CARD]"


L = secret_ledger


def plain_secrets(text):
    base = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m.group(2)) >= 6]
    base += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    base += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(base)


def test_secrets_against_re(spark):
    import hashlib
    import random

    random.seed(9)
    parts = ["token", "ToKen", "=", ":", " ", '"', "'", "abcdef", "password", "api_key", "apikey", "secret", "x", "é😀", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "fedcba98", "\n", "-----BEGIN RSA PRIVATE KEY-----", "gh", "p_", "Z" * 40]
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(1, 30))) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in L.digest(L.scan(docs)).collect():
        want = plain_secrets(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), texts[r["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(w[1] == k for w in want) for k in range(3)]
        assert {f"{k}:{a}:{b}" for a, _, k, b in want} <= set(r["spans"].split(","))


def test_ledger_is_incremental(spark, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    rows = [("a", 1, "token = abcdef1"), ("a", 2, "token = abcdef2"), ("b", 1, "token = abcdef1")]
    schema = "path string, version int, text string"
    first = L.scan(spark.createDataFrame(rows, schema), paths=("path", "version"), ledger=folder)
    assert first.count() == 3
    size = lambda: L.read_ledger(spark, f"{folder}/rule_version={L.rule_version(L.RULES)}").count()
    assert size() == 2
    again = L.scan(spark.createDataFrame([*rows, ("c", 1, "nothing"), ("d", 1, "token = abcdef2")], schema), paths=("path", "version"), ledger=folder)
    assert size() == 3
    got = {(r["path"], r["version"]): [f["kind"] for f in r["findings"]] for r in again.collect()}
    assert got[("d", 1)] == ["assign"] and got[("c", 1)] == [] and len(got) == 5
    L.scan(spark.createDataFrame(rows, schema), paths=("path",), ledger=folder, rules=L.BASE).count()
    assert size() == 3  # another rule version has rows of its own


def test_ledger_reads_no_blob_twice(spark, tmp_path):
    """Two runs that overlapped have written the same blobs; a run that was not ended does not count."""
    import shutil

    folder, here = f"file://{tmp_path}/ledger", tmp_path / "ledger" / f"rule_version={L.rule_version(L.RULES)}"
    rows = spark.createDataFrame([(1, "token = abcdef1"), (2, "x"), (3, "x")], "doc_id long, text string")
    assert L.scan(rows, ledger=folder).count() == 3
    (run,) = here.iterdir()
    shutil.copytree(run, here / "run=again")
    shutil.copytree(run, here / "run=broken")
    (here / "run=broken" / "_SUCCESS").unlink()
    assert L.scan(rows, ledger=folder).count() == 3 and L.read_ledger(spark, f"{folder}/{here.name}").count() == 2


def test_an_increment_costs_the_increment(spark, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    made = lambda *ks: spark.createDataFrame([(k, f"token = abcdef{k:04d}") for k in ks], "doc_id long, text string")
    rows = lambda: sorted(spark.read.parquet(p).count() for p in L.runs(spark, f"{folder}/rule_version={L.rule_version(L.RULES)}"))
    assert L.scan(made(*range(50)), ledger=folder).count() == 50 and rows() == [50]
    assert L.scan(made(3, 4, 90, 90), ledger=folder).count() == 4 and rows() == [1, 50]
    assert L.scan(made(*range(50)), ledger=folder).count() == 50 and rows() == [1, 50]  # nothing is unseen: no run
    assert L.scan(made(91, 92), ledger=folder).count() == 2 and rows() == [1, 2, 50]
    want = sorted((r["doc_id"], r["spans"]) for r in L.digest(L.scan(made(*range(50), 90, 91, 92))).collect())
    L.compact(spark, folder)
    assert rows() == [53]
    assert sorted((r["doc_id"], r["spans"]) for r in L.digest(L.scan(made(*range(50), 90, 91, 92), ledger=folder)).collect()) == want and rows() == [53]


def test_only_unseen_texts_are_moved(spark, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame([(k, f"token = abcdef{k:04d}" * 50) for k in range(400)], "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    L.scan(docs.where("doc_id < 395"), ledger=folder).count()
    seen = []
    scan_blobs = L.scan_blobs
    try:
        L.scan_blobs = lambda blobs, rules: seen.append(blobs.count()) or scan_blobs(blobs, rules)
        L.scan(docs, ledger=folder).count()
    finally:
        L.scan_blobs = scan_blobs
    assert seen == [5]


def test_spellings_of_the_docstring_are_found(spark, tagger):
    """Names that no training window has, within prose of documents that training has not seen."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id >= 2000 and doc_id < 2080 and length(text) > 300").collect()]
    prose = [P.TRIGGER.sub("", t)[:200] for t in texts]

    def share(value: str, kind: int) -> float:
        made = [(a.rstrip() + " " + value + " " + b.lstrip(), len(a.rstrip()) + 1) for a, b in zip(prose, prose[1:])]
        every = [e for _, e in P.all_spans(tagger, [t for t, _ in made])]
        return sum((kind, at, at + len(value)) in e for (_, at), e in zip(made, every)) / len(made)

    found = {v: share(v, k) for v, k in (("jo at mail dot org", 0), ("joan.smith at mail dot org", 0), ("anna.b [at] post [dot] net", 0), ("4111.1111.1111.1111", 2), ("10[.]0[.]0[.]7", 1))}
    assert all(x >= 0.6 for x in found.values()), found
    dates = [P.all_spans(tagger, [f"{a} on 12/05/2023 and 2024-01-15 {b}"])[0][1] for a, b in zip(prose, prose[1:])]
    assert not any(k == 3 for e in dates for k, *_ in e)


def test_forest_and_threshold_come_from_all_labelled_rows(spark):
    """Far more rows than the 4,096 that were once drawn; fitted by Spark as on one machine."""
    assert not hasattr(Q, "SAMPLE")
    rng, words = np.random.default_rng(5), [f"w{chr(97 + k % 26)}{'o' * (k % 7)}{k}" for k in range(400)]
    rows = []
    for i in range(6000):
        text = " ".join(rng.choice(words, 60 + i % 40))
        rows.append((i, text if i % 10 else text.upper() + " !" * 30 + " |" * (i % 60), int(i % 10 > 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    x, good = Q.labelled_stats(docs, labels)
    kept = [r[2] for r in rows for c in [Q.text_stats(r[1])[0]] if not Q.base_failed(c[0], c[4])]
    assert len(x) == len(kept) > 5500 and good.sum() == sum(kept) == 5400
    here, there = Q.fit(x, good), Q.train(docs, labels)
    assert np.array_equal(here.forest.split, there.forest.split) and here.forest.size == there.forest.size >= Q.LEAF_SAMPLE and here.threshold == there.threshold
    score = there.forest.score(x)
    assert (score[good] > there.threshold).mean() <= Q.CLEAN_LOSS and (score[~good] > there.threshold).mean() > 0.95
