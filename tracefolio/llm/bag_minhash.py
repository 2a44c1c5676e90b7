"""Near-duplicate detection by BagMinHash: weighted-Jaccard signatures of word-shingle multisets, banded and verified.

Signatures. A shingle with weight (count) w stands for a Poisson process over the strip [0, w) x time. The weight axis is cut
into dyadic blocks [0,1), [1,2), [2,4), [4,8) ...; each block of each shingle has a process of its own, of rate proportional
to the block's length, whose points fall on the block's units evenly. A block that w covers in part keeps the points on its
covered units only, so documents with different weights see the same points where their strips overlap. Each point belongs to
one of SLOTS slots; a slot's value is its earliest point, and two documents agree in a slot with the probability of their
weighted Jaccard similarity. Processes advance together and a process stops as soon as its time is past the document's
latest slot, so long documents need few points for each shingle.

Classes. Texts with the same words are one node. BANDS bands of ROWS slots make buckets; nodes are linked with a bucket's pivot,
not with each other, and a candidate pair counts only if its exact weighted Jaccard similarity is at least THRESHOLD. A bucket's
pivot is its node with the most company over all buckets: among edited copies of a text that is the text, or the copy nearest to it.
Three rounds find all links that matter for classes: (1) each node with the best pivot of all its buckets; (2) where a node and a
bucket's pivot are in different classes still, this pair; (3) what is left of buckets whose other members are in several classes
still. Their members outside of the bucket's main class meet the others in blocks of bounded size, where that comes to no more than one copy
of each member. A bucket with more strays than that (texts that share a long passage and little else fill one) is dealt anew by an exact
prefix filter (``prefixes``): every node stands under the rarest of its elements, so many that two nodes of enough similarity
share one of them. Nodes whose elements are mostly their own, and groups in which no two sizes and shares allow a link, drop out
before any pair is made; what is left meets in blocks likewise. Pairs within a class, of which
a group of copies has a square number, are never made. So no pair that shares a bucket and lies in different classes stays
unverified: no link is lost but those that no band holds (at similarity 0.8: (1 - 0.8^6)^28, 2 in 10,000).

Classes are contracted by hooking each root to its smallest neighbour and jumping pointers, as tables in the shared folder.
Links, components and signatures never reach the driver; only counts do.

Defined results: null and empty texts, and texts without words, are in a class with equal texts only; texts under five
words are one shingle; a very long text is read whole (its shingles are its own task's memory); equal rows are in one class; a null doc_id takes part and never names a class unless all in it are
null; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefolio.llm.common import claim, doc_texts, forget, map_rows, settle, small, small_batches

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 28, 6
SLOTS = BANDS * ROWS

WORDS = re.compile(r"\w+").findall
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """Word to 64 bits; emptied when full."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 250_000:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


_WORDS = WordHashes()


def claim_words() -> None:
    claim("words", _WORDS.clear)


def shingles(text: str, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the distinct shingles (ascending), their counts, and the node that texts with these words share."""
    words = WORDS(text.lower())
    if not words:
        node = int.from_bytes(hashlib.sha256(b"\x00" + text.encode()).digest()[:8], "little", signed=True)
        return np.empty(0, np.uint64), np.empty(0, np.int64), node
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    node = int.from_bytes(hashlib.sha256(h.tobytes()).digest()[:8], "little", signed=True)
    n = max(len(h) - width + 1, 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out = mix(out * GOLDEN + h[k : k + n])
    values, counts = np.unique(out, return_counts=True)
    return values, counts, node


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """One row of slot values for each bag (hashes, weights)."""
    docs = np.repeat(np.arange(len(bags)), [len(v) for v, _ in bags])
    values = np.concatenate([v for v, _ in bags]) if bags else np.empty(0, np.uint64)
    weights = np.concatenate([c for _, c in bags]) if bags else np.empty(0, np.int64)
    seeds, owner, length, limit = [values], [docs], [np.ones(len(values), np.int64)], [np.ones(len(values), np.int64)]
    low, block = 1, 1
    while len(weights) and (deep := weights > low).any():
        size = low  # the block [low, 2 low)
        seeds.append(mix(values[deep] + np.uint64(block * int(GOLDEN) & (1 << 64) - 1)))
        owner.append(docs[deep])
        length.append(np.full(deep.sum(), size))
        limit.append(np.minimum(weights[deep] - low, size))
        low, block = 2 * low, block + 1
    seed, own, size, cap = (np.concatenate(x) for x in (seeds, owner, length, limit))
    time = np.zeros(len(seed))
    rate = (slots * size).astype(float)
    first = np.full(len(bags) * slots, np.inf)
    who = np.zeros(len(bags) * slots, np.uint64)
    latest = np.full(len(bags), np.inf)
    number, step = 1, 1
    while len(seed):
        ks = np.arange(number, number + step, dtype=np.uint64)
        bits = mix(seed[:, None] + ks[None, :] * GOLDEN)
        more = mix(bits ^ GOLDEN)
        gaps = -np.log(((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate[:, None]
        t = time[:, None] + np.cumsum(gaps, axis=1)
        inside = ((more >> np.uint64(32)) % size[:, None].astype(np.uint64)).astype(np.int64) < cap[:, None]
        use = inside & (t < latest[own][:, None])
        at = (own[:, None] * slots + (more & np.uint64(0xFFFFFFFF)).astype(np.int64) % slots)[use]
        tt = t[use]
        np.minimum.at(first, at, tt)
        won = tt == first[at]
        who[at[won]] = bits[use][won]
        latest = first.reshape(len(bags), slots).max(axis=1)
        time = t[:, -1]
        live = time < latest[own]
        seed, own, size, cap, time, rate = (x[live] for x in (seed, own, size, cap, time, rate))
        number += step
        step = min(64, 2 * step) if number > 4 else 1
    return who.reshape(len(bags), slots)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key for each band of each row; the band's number is part of it."""
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, (len(signature), bands)).copy()
    for k in range(rows):
        out = mix(out + signature[:, k::rows][:, :bands])
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact weighted Jaccard similarity of two bags (ascending hashes, counts)."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (total - common)


def _signed(bags: list) -> np.ndarray:
    """Band keys of many bags, in slices of bounded size."""
    out, part, n = [], [], 0
    for bag in bags:
        part.append(bag)
        n += len(bag[0])
        if n > 200_000:
            out.append(band_keys(signatures(part)))
            part, n = [], 0
    if part:
        out.append(band_keys(signatures(part)))
    return np.concatenate(out) if out else np.empty((0, BANDS), np.int64)


def sign_documents(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (of the text itself), node, n_shingles, bands."""

    def start():
        claim_words()

        def work(cols: dict) -> list[tuple]:
            bags = [shingles(t) for t in cols["text"]]
            keys = iter(_signed([b[:2] for b in bags if len(b[0])]).tolist())
            return [(d, r, node, int(c.sum()), next(keys) if len(v) else []) for d, r, (v, c, node) in zip(cols["doc_id"], cols["row_key"], bags)]

        return work

    rows = doc_texts(docs).withColumn("row_key", F.xxhash64("text"))
    return map_rows(rows, "doc_id long, row_key long, node long, n_shingles long, bands array<long>", start, batch=512)


def compress(parents: DataFrame) -> DataFrame:
    """(node, parent), a forest, to (node, root) by pointer jumping."""
    now = settle(parents.select("node", "parent"), "jump")
    while True:
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("over"))
        new = settle(now.join(up, "parent", "left").select("node", F.coalesce("over", "parent").alias("parent"), F.col("over").isNotNull().alias("moved")), "jump")
        moved = new.where("moved").limit(1).count()
        forget(now)
        if not moved:
            return new.select("node", F.col("parent").alias("root"))
        now = new.drop("moved")
        now._settled_path = new._settled_path


def merge(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) after all edges (a, b) have been taken up."""
    while True:
        a = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        across = edges.join(a, "a").join(b, "b").where("ra != rb")
        hooks = settle(across.groupBy(F.greatest("ra", "rb").alias("node")).agg(F.min(F.least("ra", "rb")).alias("parent")), "hooks")
        if not hooks.limit(1).count():
            forget(hooks)
            return labels
        roots = compress(hooks)
        new = settle(labels.join(roots.select(F.col("node").alias("root"), F.col("root").alias("over")), "root", "left").select("node", F.coalesce("over", "root").alias("root")), "labels")
        forget(hooks)
        labels = new


def verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose bags are similar enough."""
    one = bags.select(F.col("node").alias("a"), F.col("hashes").alias("ha"), F.col("counts").alias("ca"))
    two = bags.select(F.col("node").alias("b"), F.col("hashes").alias("hb"), F.col("counts").alias("cb"))

    def start():
        def work(cols: dict) -> list[tuple]:
            return [(a, b) for a, b, ha, ca, hb, cb in zip(*(cols[k] for k in ("a", "b", "ha", "ca", "hb", "cb"))) if similarity(read_bag(ha, ca), read_bag(hb, cb)) >= threshold]

        return work

    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "ha", "ca", "hb", "cb")
    return map_rows(joined, "a long, b long", start, batch=64)


def near_duplicates(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, row_key, node, n_shingles, class_id (the least doc_id of the class, its representative), class_rows, class_texts (different ones), class_node."""
    classed = classes(docs, threshold=threshold)
    # written first, so that the join has an exchange on either side and large classes can be split
    per_text = classed.groupBy("class_node", "node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    names = settle(per_text.groupBy("class_node").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_rows"), F.count(F.lit(1)).alias("class_texts")), "names")
    return classed.join(names, "class_node")


def classes(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, row_key, node, n_shingles, class_node (one node of the class)."""
    signed = settle(sign_documents(docs), "signed")
    nodes = signed.where("size(bands) > 0").groupBy("node").agg(F.min("n_shingles").alias("n"), F.first("bands").alias("bands"))
    members = settle(nodes.select("node", "n", F.explode("bands").alias("bucket")), "buckets")
    # tables of one row a bucket are written before they are joined, so that a bucket which holds a tenth of the rows can be split in the join
    held = settle(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "held")
    shared = settle(members.join(held, "bucket"), "shared")
    forget(members, held)
    company = settle(shared.groupBy("node").agg(F.min("n").alias("n"), F.sum("held").alias("company")), "company")
    known = shared.select("bucket", "node").join(company, "node")
    pivots = settle(known.groupBy("bucket").agg(F.max(F.struct("company", "node", "n")).alias("p")), "pivots")
    placed = settle(known.join(pivots, "bucket").select("bucket", "node", "n", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.company").alias("pc")), "placed")
    forget(shared, pivots)

    bags = settle(_bags(docs, signed, small(company.select("node"), company.count())), "bags")
    labels = settle(company.select("node", F.col("node").alias("root")), "labels")
    fits = F.least("n", "pn") >= threshold * F.greatest("n", "pn")  # similar bags have similar sizes
    away = placed.where((F.col("node") != F.col("pivot")) & fits)

    # (1) the best pivot of each node
    best = away.groupBy("node").agg(F.max(F.struct("pc", "pivot")).alias("p"))
    tested = settle(best.select(F.col("node").alias("a"), F.col("p.pivot").alias("b")), "pairs")
    labels = merge(labels, settle(verified(tested, bags, threshold), "edges"))

    # (2) the pivots of all its buckets, where classes still differ
    la = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    lb = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    apart = away.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct().join(la, "a").join(lb, "b").where("ra != rb").select("a", "b")
    more = settle(apart.join(tested, ["a", "b"], "left_anti"), "pairs")
    labels = merge(labels, settle(verified(more, bags, threshold), "edges"))

    # (3) buckets whose members other than the pivot are in several classes
    others = placed.where("node != pivot").select(F.col("bucket").alias("key"), "node", "n").join(labels, "node")
    rest = mixed_groups(others)
    crowded = F.col("strays") * (F.col("blocks") - 1) > F.col("held")
    edges = _across(rest.where(~crowded), bags, threshold)
    if rest.where(crowded).limit(1).count():
        crowd = settle(rest.where(crowded).select("node", "root", "n").distinct(), "crowd")
        edges = edges.unionByName(_across(mixed_groups(prefixes(crowd, bags, threshold)), bags, threshold))
    labels = merge(labels, settle(edges.distinct(), "edges"))
    forget(placed, rest, bags)

    return signed.select("doc_id", "row_key", "node", "n_shingles").join(labels, "node", "left").withColumn("class_node", F.coalesce("root", "node")).drop("root")


#: Members, and their elements, that a block of a group has at most, or about.
BLOCK, BLOCK_ELEMENTS = 256, 500_000


def mixed_groups(members: DataFrame) -> DataFrame:
    """Members (key, node, n, root) of the groups that have several roots, each with the group's size, its main root, how many members have another one, and the number of its blocks."""
    per_root = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    groups = per_root.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.sum("m").alias("held"), F.sum("n").alias("elements"), F.max(F.struct("m", "root")).alias("main")).where("roots > 1")
    blocks = F.greatest(F.ceil(F.col("held") / BLOCK), F.ceil(F.col("elements") / BLOCK_ELEMENTS)).cast("int")
    # written first, so that a group which holds a tenth of the rows can be split in the join
    named = settle(groups.select("key", "held", F.col("main.root").alias("main"), (F.col("held") - F.col("main.m")).alias("strays"), blocks.alias("blocks")), "groups")
    return settle(members.join(named, "key"), "mixed")


def prefixes(nodes: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """(node, root, n) to (key, node, n, root): each node under its rarest elements.

    Elements are the numbered copies of shingles, n of a node; their order is by how many of ``nodes`` have them. Nodes x and y of similarity t share
    t n of x's n elements at least, so one of the first n - ceil(t n) + 1 of each is common to both. An element that one node alone has is no
    key, but has its place in the order. With c elements that others have, too, the smaller of two similar nodes has c (1 + t) >= 2 t n:
    groups without such a node are left out.
    """
    rows = bags.join(nodes.select("node"), "node").select("node", "hashes", "counts")

    def start():
        def work(cols: dict) -> list[tuple]:
            return [(node, e) for node, h, c in zip(cols["node"], cols["hashes"], cols["counts"]) for e in elements(read_bag(h, c)).view(np.int64).tolist()]

        return work

    listed = settle(map_rows(rows, "node long, element long", start, batch=8), "elements")
    common = settle(listed.groupBy("element").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "common")
    kept = listed.join(common, "element").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "element"))).alias("es"))
    least = F.ceil(threshold * F.col("n") - 1e-9)
    c = F.size("es")
    sized = kept.join(nodes, "node").where(c >= least).select("node", "root", "n", (c * (1 + threshold) >= 2 * threshold * F.col("n") - 1e-6).alias("lesser"), F.explode(F.slice("es", F.lit(1), (c + 1 - least).cast("int"))).alias("e"))
    keyed = settle(sized.select(F.col("e.element").alias("key"), "node", "n", "root", "lesser"), "prefixes")
    open_ = settle(keyed.groupBy("key").agg(F.bool_or("lesser").alias("any")).where("any").select("key"), "open")
    out = keyed.join(open_, "key").select("key", "node", "n", "root")
    forget(listed, common)
    return out


def read_bag(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(hashes, "<u8"), np.frombuffer(counts, "<u4").astype(np.int64)


def _across(rest: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Links across classes in mixed groups. Members are dealt to blocks, strays (those outside of the main class) to slices, too; every block meets every slice."""
    place = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), n).cast("int")
    many = rest.withColumns({"block": place(1, F.col("blocks")), "slices": F.ceil(F.col("strays") / (4 * BLOCK)).cast("int")}).withColumn("slice", place(2, F.col("slices")))
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    stray = F.col("root") != F.col("main")
    at_home = F.transform(up_to(F.col("slices")), lambda s: F.struct(F.col("block").alias("b"), s.alias("s"), F.lit(True).alias("home"), (stray & (s == F.col("slice"))).alias("probe")))
    abroad = F.transform(F.filter(up_to(F.col("blocks")), lambda b: stray & (b != F.col("block"))), lambda b: F.struct(b.alias("b"), F.col("slice").alias("s"), F.lit(False).alias("home"), F.lit(True).alias("probe")))
    spread = many.select("key", "node", "root", F.explode(F.concat(at_home, abroad)).alias("w"))
    keyed = spread.select(F.xxhash64("key", "w.b", "w.s").alias("run"), "w.home", "w.probe", "node", "root").join(bags, "node")
    parts = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # members at home come first, then the others pass by: a task holds one block and BLOCK strays
    rows = keyed.select("run", "home", "probe", "node", "root", "hashes", "counts").repartition(parts, "run").sortWithinPartitions("run", F.desc("home"))

    def links(batches):
        import pyarrow as pa

        run, homes, probes, size = None, [], [], 0

        def close():
            found = cross_links(probes, homes, threshold) if probes else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for key, home, probe, node, root, h, c in zip(*(part.column(k).to_pylist() for k in range(7))):
                    if probes and (key != run or not home and (len(probes) >= BLOCK or size > BLOCK_ELEMENTS)):
                        yield close()
                        probes, size = [], 0
                    if key != run:
                        run, homes, probes, size = key, [], [], 0
                    member = (node, root, read_bag(h, c))
                    if home:
                        homes.append(member)
                    if probe:
                        probes.append(member)
                        size += int(member[2][1].sum())
        if probes:
            yield close()

    return small_batches(rows).mapInArrow(links, "a long, b long")


def elements(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A bag as a set: the copies of a shingle are numbered."""
    values, counts = bag
    k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(np.repeat(values, counts) + k.astype(np.uint64) * GOLDEN)


Member = tuple[int, int, tuple[np.ndarray, np.ndarray]]


def cross_links(probes: list[Member], homes: list[Member], threshold: float) -> list[tuple[int, int]]:
    """Links between probes and homes (node, root, bag) of different roots, one for each probe and root at most."""
    sets = [elements(b) for _, _, b in probes + homes]
    sizes = np.array([len(x) for x in sets])
    n = len(probes)
    roots = np.array([r for _, r, _ in probes + homes])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    # elements that one member alone has are in no overlap
    use = times[column] > 1
    kept, column = np.unique(column[use], return_inverse=True)
    row = row[use]
    common = np.zeros((n, len(homes)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, len(kept), 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        x = np.zeros((len(sets), min(4096, len(kept) - at)), np.float32)
        x[row[lo:hi], column[lo:hi] - at] = 1
        common += x[:n] @ x[n:].T
    near = common >= threshold * (sizes[:n][:, None] + sizes[n:][None] - common) - 1e-6
    near &= roots[:n][:, None] != roots[n:][None]
    found = {}
    for i, j in zip(*np.nonzero(near)):
        found.setdefault((int(i), int(roots[n + j])), int(j))
    return [(probes[i][0], homes[j][0]) for (i, _), j in found.items()]


def _bags(docs: DataFrame, signed: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, hashes, counts of the nodes wanted, from one text of each."""
    owner = signed.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "row_key")).alias("o"))
    owner = settle(owner.select("node", F.col("o.d").alias("d"), F.col("o.row_key").alias("k")), "owners")
    rows = doc_texts(docs).withColumn("row_key", F.xxhash64("text"))
    hit = rows.join(small(owner, owner.count()), (F.coalesce("doc_id", F.lit(-(1 << 63))) == F.col("d")) & (F.col("row_key") == F.col("k"))).select("node", "text")

    def start():
        claim_words()

        def work(cols: dict) -> list[tuple]:
            out = []
            for node, text in zip(cols["node"], cols["text"]):
                v, c, _ = shingles(text)
                out.append((node, v.astype("<u8").tobytes(), c.astype("<u4").tobytes()))
            return out

        return work

    return map_rows(hit, "node long, hashes binary, counts binary", start).dropDuplicates(["node"])


def one_of_each(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with the least (doc_id, text) of each class; all columns, unchanged."""
    found = classes(docs, threshold=threshold)
    none = F.lit(-(1 << 63))
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.coalesce("doc_id", none).alias("d"), F.col("row_key").alias("k"))
    keep = found.groupBy("class_node").agg(F.min(order).alias("o")).select(F.col("o.d").alias("keep_d"), F.col("o.k").alias("keep_k"))
    keep = settle(keep, "keepers")
    # all columns in one, so that none can have the name of ours
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("doc_id", none).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"))
    kept = rows.join(small(keep, keep.count()), (F.col("d") == F.col("keep_d")) & (F.col("k") == F.col("keep_k")))
    if found.groupBy("doc_id", "row_key").count().where("count > 1").limit(1).count():  # the same row again: one of them stays
        kept = kept.dropDuplicates(["d", "k"])
    return kept.select("row.*")
