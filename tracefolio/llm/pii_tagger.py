"""Personal data: rules for four kinds, and a character-level bidirectional LSTM with a CRF that adds what the rules miss.

Base rules find emails, addresses, card and phone numbers; they are written so that each runs once over the text (the first two
start at an ``@`` or at a run of digits, never inside one).

The tagger is trained in numpy, in one task at the start of a query, on labelled spans: windows of a bounded sample of documents with the rules' spans
in them, and made-up spans of every kind written into windows of the sample, most of them in spellings that the rules don't take:
``jo at mail dot org``, ``10[.]0[.]0[.]7``, cards with dots or slashes, phones without a plus. It reads windows of WINDOW characters that
overlap by half; where windows overlap, their scores for each character and tag are averaged
(a window's middle counts more than its edges), and one Viterbi pass with the CRF's transitions decodes each whole region, so no
span is cut at a window's edge. Regions are the neighbourhoods (CONTEXT characters) of everything that a span of the four kinds has in any of
these spellings: digits, ``@``, a bracketed *at* or *dot*, the word *dot* (or its French, German or Spanish one), an *at* before a domain.

A decoded span is moved to the ends of its words and added if it meets no base span and its content is possible (``plausible``; for a number of another kind than was decoded, of that kind): once
spelled plainly, an email is one by the base pattern, an address has four numbers up to 255, a card passes Luhn, a phone has 7 to 15
digits in groups and is no date. Base spans stay. ``evaluate`` measures what is added.

Texts are read whole where they lie; no row is moved. Regions are decoded DECODE_CHARS characters at a time, a longer one by itself, so that
memory grows by some sixty bytes with each character of the longest region only. Defined results: a null text is an empty one; every row
gives a row, repeated ones too; a very long text is read whole; an empty table gives no rows and needs no training; other columns are ignored by
``find_pii`` and kept by ``mask_documents``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefolio.llm.common import claim, doc_texts, local_rows, map_rows, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Documents and windows that training may look at, at most.
SAMPLE_DOCS, SAMPLE_WINDOWS = 512, 512
WINDOW, STRIDE, CONTEXT = 96, 48, 32
HIDDEN, EPOCHS, BATCH, SEED = 20, 10, 32, 4
WRITTEN = 3
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind

# --- base rules ------------------------------------------------------------------------------------------------------

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TRIGGER = re.compile("[0-9@]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start."""
    if not TRIGGER.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = digits_of(m.group()) if m.end() - m.start() >= 13 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


# --- characters ------------------------------------------------------------------------------------------------------

PAD, SPACE, LETTER, OTHER, CHARS = 0, 96, 97, 98, 99


def char_ids(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    out = np.where((code >= 32) & (code < 127), code - 31, OTHER)
    out[(code >= 9) & (code < 14)] = SPACE
    out[(code >= 0xAA) & (code < 0x2000)] = LETTER
    return out


# --- the network -----------------------------------------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Tagger:
    """Input weights by character, recurrent weights, output weights and CRF transitions. Gates lie in the order i, f, o, g."""

    w: list[np.ndarray]

    @classmethod
    def new(cls, seed: int = SEED, hidden: int = HIDDEN) -> "Tagger":
        rng = np.random.default_rng(seed)
        r = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        w = []
        for _ in range(2):
            x = r(CHARS, 4 * hidden) * 3
            x[:, hidden : 2 * hidden] += 1
            w += [x, r(hidden, 4 * hidden)]
        return cls([*w, r(2 * hidden, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32)])

    @staticmethod
    def run(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, keep: bool):
        """States (steps, batch, hidden) over characters (steps, batch); with keep, also what the way back needs."""
        steps, n = x.shape
        h_size = wh.shape[0]
        h = np.zeros((n, h_size), np.float32)
        c = np.zeros_like(h)
        out = np.empty((steps, n, h_size), np.float32)
        kept = []
        given = wx[x] if keep else None  # a batch of training is small
        for t in range(steps):
            z = (given[t] if keep else wx[x[t]]) + h @ wh
            g = np.empty_like(z)
            g[:, : 3 * h_size] = sigmoid(z[:, : 3 * h_size])
            g[:, 3 * h_size :] = np.tanh(z[:, 3 * h_size :])
            i, f, o, u = (g[:, k * h_size : (k + 1) * h_size] for k in range(4))
            before, prior = c, h
            c = f * c + i * u
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                kept.append((g, before, tc, prior))
        return out, kept

    @staticmethod
    def back(x: np.ndarray, wh: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps, n = x.shape
        h_size = wh.shape[0]
        dz = np.empty((steps, n, 4 * h_size), np.float32)
        dh = np.zeros((n, h_size), np.float32)
        dc = np.zeros_like(dh)
        for t in range(steps - 1, -1, -1):
            g, before, tc, _ = kept[t]
            i, f, o, u = (g[:, k * h_size : (k + 1) * h_size] for k in range(4))
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1, out=dz[t])
            dh, dc = dz[t] @ wh.T, dc * f
        flat = dz.reshape(steps * n, -1)
        which = np.zeros((CHARS, steps * n), np.float32)
        which[x.ravel(), np.arange(steps * n)] = 1
        return which @ flat, np.concatenate([k[3] for k in kept]).T @ flat

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores (batch, steps, tags) of windows (batch, steps)."""
        wx1, wh1, wx2, wh2, wo, bo, _ = self.w
        xt = np.ascontiguousarray(x.T)
        one, _ = self.run(xt, wx1, wh1, False)
        two, _ = self.run(xt[::-1], wx2, wh2, False)
        return (np.concatenate([one, two[::-1]], axis=2) @ wo + bo).transpose(1, 0, 2)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss (minus the CRF's log-likelihood of tags y) over windows, and its gradient."""
        wx1, wh1, wx2, wh2, wo, bo, trans = self.w
        xt, yt = np.ascontiguousarray(x.T), y.T
        steps, n = xt.shape
        one, k1 = self.run(xt, wx1, wh1, True)
        two, k2 = self.run(xt[::-1], wx2, wh2, True)
        hidden = np.concatenate([one, two[::-1]], axis=2)
        e = (hidden @ wo + bo).astype(float)
        t = trans.astype(float)
        lse = lambda v, ax: (m := v.max(axis=ax, keepdims=True)).squeeze(ax) + np.log(np.exp(v - m).sum(axis=ax))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for s in range(1, steps):
            alpha[s] = lse(alpha[s - 1][:, :, None] + t[None], 1) + e[s]
        for s in range(steps - 2, -1, -1):
            beta[s] = lse(t[None] + (e[s + 1] + beta[s + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        cols = np.arange(n)
        gold = np.take_along_axis(e, yt[:, :, None], 2).sum((0, 2)) + t[yt[:-1], yt[1:]].sum(0)
        dt = np.exp(alpha[:-1, :, :, None] + t + (e + beta)[1:, :, None, :] - z[:, None, None]).sum((0, 1))
        np.add.at(dt, (yt[:-1], yt[1:]), -1)
        de = np.exp(alpha + beta - z[None, :, None])
        np.add.at(de, (np.arange(steps)[:, None], cols[None], yt), -1)
        de = (de / n).astype(np.float32)
        dwo = np.einsum("snh,snt->ht", hidden, de)
        dh = de @ wo.T
        h = wh1.shape[0]
        g1 = self.back(xt, wh1, k1, dh[:, :, :h])
        g2 = self.back(xt[::-1], wh2, k2, np.ascontiguousarray(dh[::-1, :, h:]))
        return float((z - gold).mean()), [*g1, *g2, dwo, de.sum((0, 1)), (dt / n).astype(np.float32)]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.01, seed: int = SEED) -> "Tagger":
        """Adam, the rate falling to a tenth."""
        rng = np.random.default_rng(seed)
        m, v = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w]
        step, total = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                part = order[at : at + batch]
                _, grads = self.gradient(x[part], y[part])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
                step += 1
                lr = rate * (1 - 0.9 * step / total)
                for k, g in enumerate(grads):
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def viterbi(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags of regions (batch, steps, tags), each of its own length."""
    n, steps, tags = scores.shape
    best = scores[:, 0].copy()
    back = np.zeros((steps, n, tags), np.int8)
    for s in range(1, steps):
        paths = best[:, :, None] + trans[None]
        back[s] = paths.argmax(1)
        new = paths.max(1) + scores[:, s]
        best = np.where((s < lengths)[:, None], new, best)
    out = np.zeros((n, steps), np.int8)
    tag = best.argmax(1)
    rows = np.arange(n)
    for s in range(steps - 1, -1, -1):
        inside = s < lengths
        out[inside, s] = tag[inside]
        if s:
            tag = np.where(inside, back[s, rows, tag], tag)
    return out


# --- training windows ------------------------------------------------------------------------------------------------


def with_luhn(digits: str) -> str:
    """The digits with the last one such that they pass Luhn."""
    return next(digits[:-1] + c for c in "0123456789" if luhn(digits[:-1] + c))


#: Spellings of each kind: the base rules' own, those that the tagger is trained on besides, and others that it is only tried on.
USUAL, ODD, UNSEEN = 0, 1, 2


def made_up(rng: np.random.Generator, kind: int, spelling: int = USUAL) -> str:
    """A value of the kind."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    pick = lambda *options: options[int(rng.integers(len(options)))]
    if kind == 0:
        # names as people have them, of syllables, and as machines make them, of any letters
        spoken = lambda: "".join(pick(*"bcdfghjklmnprstvw", "", "st", "ch", "th") + pick(*"aeiou") + pick("", "", "n", "r", "s", "l") for _ in range(int(rng.integers(1, 4))))
        name = pick(spoken(), spoken(), letters(rng.integers(2, 11))) + pick("", "", ".", "_", "-", "+") + pick(d(2), letters(3), spoken(), "", "")
        name = name.rstrip("._-+")
        host, top = pick("mail", "post", letters(5), spoken(), "example", "web") + pick("", "", d(1)), pick("example.com", "example.org", letters(4) + "." + letters(2), letters(3), "org", "com", "net", "de", "fr", "es", "co.uk").split(".")
        if spelling == USUAL:
            return name + pick("", ".") + "@" + ".".join([host, *top])
        at, dot = ((" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."), (" [at] ", "."), (" @ ", " . "), (" @ ", "."), (" AT ", " DOT "), (" at ", "."))[int(rng.integers(10))]
        if spelling == UNSEEN:
            at, dot = ((" {at} ", " {dot} "), (" arobase ", " point "), ("<at>", "<dot>"), (" at ", " (dot) "), ("(at)", "(dot)"))[int(rng.integers(5))]
        return name + at + dot.join([host, *top])
    if kind == 1:
        sep = (".", pick("[.]", " . ", " dot ", "[dot]", "(.)"), pick("(dot)", " [.] ", "{.}"))[spelling]
        return sep.join(str(int(v)) for v in rng.integers(1, 256, 4))
    if kind == 2:
        raw = with_luhn(pick("4", "5", "3", "2") + d(15))
        sep = (pick("", " ", "-"), pick(".", "/", "  ", "_"), pick(" - ", "--"))[spelling]
        if rng.random() < 0.2:
            raw = with_luhn("3" + pick("4", "7") + d(13))
            return sep.join((raw[:4], raw[4:10], raw[10:]))
        return sep.join(raw[k : k + 4] for k in range(0, 16, 4))
    a, b, c = d(3), d(3), d(4)
    if spelling == USUAL:
        return pick(f"+1 ({a}) {b}-{c}", f"+{d(2)} {a} {b}{c}", f"+1-{a}-{b}-{c}", f"+{d(2)} {d(2)} {c} {d(4)}", f"+1 {a}.{b}.{c}")
    if spelling == ODD:
        return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{d(2)} {c} {d(4)}", f"00{d(2)} {d(2)} {c} {d(4)}", f"0{d(3)}/{d(6)}", f"({a}){b}-{c}")
    return pick(f"({a}) {b} {c}", f"0{d(2)}-{c}-{d(4)}", f"0{d(4)} {d(5)}", f"00{d(2)} {d(3)} {d(3)} {d(3)}")


def distractor(rng: np.random.Generator) -> str:
    """What looks like one of the kinds and is none."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 8))))
    hexes = "".join(rng.choice(list("0123456789abcdef"), 40))
    options = (
        d(rng.integers(1, 6)), f'token = "{hexes}"', f"{d(1)}.{d(1)}", "CC BY-NC 4.0", f"v{d(1)}.{d(1)}.{d(1)}", f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}:{d(2)}", hexes[:24], f"${d(3)}.{d(2)}", f"@{hexes[:5]}", f"AKIA{d(16)}",
        f"{word()} at {word()}", f"the dot {word()}", f"{word()} at {word()}. {word()}", f"a dot and a {word()}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(1)},{d(3)},{d(3)}", f"{d(2)} - {d(2)}", f"{d(3)} {word()} {d(4)}", f"{word()} (at {word()})", f"{d(12)}",
    )
    return str(options[int(rng.integers(len(options)))])


def label(tags: np.ndarray, kind: int, a: int, b: int) -> None:
    tags[a:b] = 2 + 2 * kind
    tags[a] = 1 + 2 * kind


def training_set(windows: list[str], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tags. Each window comes once with the rules' spans, and WRITTEN times with something written into it."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []

    def add(text: str, spans: list[tuple[int, int, int]]) -> None:
        tags = np.zeros(max(WINDOW, len(text)), np.int64)
        for kind, a, b in spans:
            label(tags, kind, a, b)
        x = np.zeros(max(WINDOW, len(text)), np.int64)
        x[: len(text)] = char_ids(text)
        xs.append(x[:WINDOW])
        ys.append(tags[:WINDOW])

    for text in windows:
        spans = base_spans(text)
        bare = TRIGGER.sub("", text)
        rest = text
        for _, a, b in spans:
            rest = rest[:a] + "x" * (b - a) + rest[b:]
        if not re.search(r"@|\+[0-9]|[0-9][0-9 -]{8}|[0-9]\.[0-9]+\.[0-9]", rest):  # what is left holds nothing that may be a span cut off, or one that fails a check
            add(text, spans)
        for _ in range(WRITTEN):
            at = int(rng.integers(0, max(1, min(len(bare), WINDOW - 30))))
            while at > 0 and at < len(bare) and bare[at - 1].isalnum():
                at += 1
            left, right = bare[:at].rstrip() + (" " if at else ""), bare[at:]
            end = ("", "", "", ".", ",", "###", "!!", "$$$", "\n")[int(rng.integers(9))]
            if rng.random() < 0.3:
                add(left + distractor(rng) + end + " " + right, [])
            else:
                text, spans = left, []
                for _ in range(1 + (rng.random() < 0.5)):
                    kind = int(rng.integers(2 * len(KINDS))) % (len(KINDS) + 1) % len(KINDS)  # spelled-out emails take most learning: three of eight
                    value = made_up(rng, kind, ODD if rng.random() < 0.7 else USUAL)
                    spans.append((kind, len(text), len(text) + len(value)))
                    text += value + end + " " + right[: int(rng.integers(3, 20))].strip() + " "
                    end = ", "
                add(text + right, spans)
    return np.array(xs), np.array(ys)


def sample_windows(docs: DataFrame, most_docs: int = SAMPLE_DOCS, most: int = SAMPLE_WINDOWS) -> list[str]:
    """Windows around digits and ``@`` of the documents that come first by a hash of doc_id."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs).collect()
    if not ids:
        return []
    chosen = local_rows(docs.sparkSession, [(r[0],) for r in ids], "sample_id long")
    rows = doc_texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("sample_id")).select("doc_id", "text")

    def start():
        def work(cols: dict) -> list[tuple]:
            out = []
            for doc_id, text in zip(cols["doc_id"], cols["text"]):
                spots = [m.start() for m in TRIGGER.finditer(text)]
                chosen = spots[:: max(1, len(spots) // 4)][:4] or [len(text) // 2]
                for k, s in enumerate(chosen):
                    a = max(0, s - 20 - zlib.crc32(f"{doc_id}/{k}".encode()) % 40)
                    out.append((zlib.crc32(f"{k}/{doc_id}".encode()), text[a : a + WINDOW]))
            return out

        return work

    return [r[1] for r in map_rows(rows, "o long, w string", start).orderBy("o", "w").limit(most).collect()]


def evaluate(tagger: Tagger, windows: list[str], spelling: int, seed: int = 99) -> dict[str, tuple[float, float]]:
    """Precision and recall by kind, of whole spans: a made-up value or a distractor is written between two windows; spans by the rules alone don't count."""
    rng = np.random.default_rng(seed)
    texts, wanted = [], []
    for k, text in enumerate(windows):
        left, right = TRIGGER.sub("", text).rstrip() + " ", " " + TRIGGER.sub("", windows[k - 1])
        kind = int(rng.integers(len(KINDS) + 1))
        value = made_up(rng, kind, spelling) if kind < len(KINDS) else distractor(rng)
        texts.append(left + value + right)
        wanted.append([(kind, len(left), len(left) + len(value))] if kind < len(KINDS) else [])
    out = {}
    got = [sorted(set(every) - set(base)) for base, every in all_spans(tagger, texts)]
    want = [[w for w in ws if w not in base_spans(t)] for t, ws in zip(texts, wanted)]
    for k, name in enumerate(KINDS):
        found = [(i, s) for i, spans in enumerate(got) for s in spans if s[0] == k]
        due = [(i, s) for i, spans in enumerate(want) for s in spans if s[0] == k]
        hits = len(set(found) & set(due))
        out[name] = (hits / max(1, len(found)), hits / max(1, len(due)))
    return out


def train_tagger(docs: DataFrame) -> Tagger | None:
    """The tagger, trained in one task on the sample's windows: Spark gives a task one core, and several threads only wait for each other over matrices as small as these."""
    import io

    import pyarrow as pa

    windows = sample_windows(docs)
    if not windows:
        return None

    def fit(batches):
        for b in batches:
            for told in b.column(0).to_pylist():
                out = io.BytesIO()
                np.savez(out, *Tagger.new().train(*training_set(told)).w)
                yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["weights"])

    row = local_rows(docs.sparkSession, [(windows,)], "windows array<string>").coalesce(1).mapInArrow(fit, "weights binary").collect()[0]
    held = np.load(io.BytesIO(bytes(row["weights"])))
    return Tagger([held[f"arr_{k}"] for k in range(len(held.files))])


# --- finding ---------------------------------------------------------------------------------------------------------


#: Without one of these no text has a spelled-out address; looking for them costs little.
HINTS = ("dot", "punkt", "punto", "point", "at)", "at]", "at}", "at>", "arobase", "arroba", " at ")
SPELLED = re.compile(
    r"[\[({<]\s?(?:at|arobase|arroba|ät|dot|point|punkt|punto|\.)\s?[\])}>]|\b(?:dot|punkt|punto|arobase|arroba)\b|\s(?:at|ät)\s+[\w-]+(?:\.[a-z]{2}|\s+(?:dot|point|punkt|punto)\s)", re.I
)


def regions(text: str) -> list[tuple[int, int]]:
    """Neighbourhoods of whatever a span must have, joined where they meet."""
    spots = [m.span() for m in TRIGGER.finditer(text)]
    lower = text.lower()
    if any(h in lower for h in HINTS):
        spots = sorted(spots + [m.span() for m in SPELLED.finditer(text)])
    out: list[list[int]] = []
    for p, q in spots:
        a, b = max(0, p - CONTEXT), min(len(text), q + CONTEXT)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: A window's weight by place: its middle counts most.
EDGE = (np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)) / (WINDOW / 2)).astype(np.float32)


#: Characters whose scores are held at once, but for a longer region's.
DECODE_CHARS = 100_000


def decode(tagger: Tagger, parts: list[str], windows_at_once: int = 512) -> list[np.ndarray]:
    """Tags of each part, from averaged scores of overlapping windows and one Viterbi pass a part."""
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(parts)
    order = sorted(range(len(parts)), key=lambda k: len(parts[k]))  # parts of like length together: little is padded
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and stop - at < 1024 and (stop + 1 - at) * len(parts[order[stop]]) <= DECODE_CHARS:
            stop += 1
        group = order[at:stop]
        for k, tags in zip(group, _decoded(tagger, [parts[k] for k in group], windows_at_once)):
            out[k] = tags
        at = stop
    return out


def _decoded(tagger: Tagger, parts: list[str], windows_at_once: int) -> list[np.ndarray]:
    ids = [char_ids(p) for p in parts]
    lengths = np.array([len(x) for x in ids])
    total = np.zeros((len(parts), max(1, int(lengths.max())), TAGS), np.float32)
    weight = np.full(total.shape[:2], 1e-9, np.float32)
    where = [(k, a) for k, x in enumerate(ids) for a in range(0, max(1, len(x) - WINDOW + STRIDE), STRIDE)]
    for at in range(0, len(where), windows_at_once):
        chunk = where[at : at + windows_at_once]
        x = np.zeros((len(chunk), WINDOW), np.int64)
        for r, (k, a) in enumerate(chunk):
            piece = ids[k][a : a + WINDOW]
            x[r, : len(piece)] = piece
        for (k, a), s in zip(chunk, tagger.scores(x)):
            n = min(WINDOW, len(ids[k]) - a)
            total[k, a : a + n] += s[:n] * EDGE[:n, None]
            weight[k, a : a + n] += EDGE[:n]
    total /= weight[:, :, None]
    tags = viterbi(total, lengths, tagger.w[6]) if len(parts) > 1 else viterbi_one(total[0], tagger.w[6])[None]
    return [t[:n] for t, n in zip(tags, lengths)]


def viterbi_one(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """As ``viterbi``, for one region of any length."""
    columns, into = np.arange(scores.shape[1]), np.ascontiguousarray(trans)
    back = np.zeros(scores.shape, np.int8)
    best = scores[0].copy()
    for s in range(1, len(scores)):
        paths = best[:, None] + into
        back[s] = choice = paths.argmax(0)
        best = paths[choice, columns] + scores[s]
    out = np.zeros(len(scores), np.int8)
    tag = int(best.argmax())
    for s in range(len(scores) - 1, -1, -1):
        out[s] = tag
        tag = int(back[s, tag])
    return out


AT = re.compile(r"\s*[\[({<]\s*(?:at|arobase|arroba|ät)\s*[\])}>]\s*|\s+(?:at|arobase|arroba|ät)\s+|\s*@\s*", re.I)
DOT = re.compile(r"\s*[\[({<]\s*(?:dot|point|punkt|punto|\.)\s*[\])}>]\s*|\s+(?:dot|point|punkt|punto)\s+|\s*\.\s*", re.I)
PLAIN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


def plain(s: str) -> str:
    """An email or address as it is spelled plainly."""
    return DOT.sub(".", AT.sub("@", s))


#: Year, month, day in this order or the other way round, with or without a time behind.
DATE = re.compile(r"(?:[12][0-9]{3}([./-])(?:0?[1-9]|1[0-2])\1(?:[12][0-9]|3[01]|0?[1-9])|(?:(?:0?[1-9]|1[0-2])([./-])(?:[12][0-9]|3[01]|0?[1-9])|(?:[12][0-9]|3[01]|0?[1-9])([./-])(?:0?[1-9]|1[0-2]))(?:\2|\3)(?:[12][0-9])?[0-9]{2})(?![0-9]).*")


def plausible(kind: int, s: str) -> bool:
    if kind == 0:
        return bool(PLAIN_EMAIL.fullmatch(plain(s)))
    if kind == 1:
        parts = plain(s).split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)
    d = digits_of(s)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d) and bool(re.fullmatch(r"[0-9](?:[ ./_-]{0,2}[0-9])+", s))
    return 7 <= len(d) <= 15 and not DATE.fullmatch(s) and bool(re.fullmatch(r"[+(]?[0-9]+(?:[ )(./-]{1,3}[0-9]+){1,6}", s))


def snapped(kind: int, text: str, a: int, b: int) -> tuple[int, int]:
    """A span without blanks and marks at its ends, and with the rest of the words (for numbers: of the digits) that it begins and ends in."""
    inside = str.isalnum if kind == 0 else str.isdigit
    first = inside if kind < 3 else lambda c: c.isdigit() or c in "+("
    while a < b and not first(text[a]):
        a += 1
    while b > a and not inside(text[b - 1]):
        b -= 1
    if a < b:
        while a and (inside(text[a - 1]) or kind == 0 and text[a - 1] in LOCAL_CHARS):
            a -= 1
        while b < len(text) and inside(text[b]):
            b += 1
        if kind == 3 and a and text[a - 1] in "+(":
            a -= 1
    return a, b


def digit_run(text: str, a: int, b: int, most: int = 64) -> tuple[int, int]:
    """The span with the groups of digits that go on before and behind it, a mark or two between, within ``most`` characters."""
    left, right = re.search(r"(?:[0-9][ ./_-]{0,2})*$", text[max(0, a - most) : a]), re.match(r"(?:[ ./_-]{0,2}[0-9])*", text[b : b + most])
    return a - len(left.group()), b + right.end()


def tagged_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of a tag sequence."""
    out, k = [], 0
    live = np.flatnonzero(tags)
    while k < len(live):
        a = int(live[k])
        kind = (int(tags[a]) - 1) // 2
        b = a + 1
        while b < len(tags) and tags[b] == 2 + 2 * kind:
            b += 1
        out.append((kind, a, b))
        while k < len(live) and live[k] < b:
            k += 1
    return out


def all_spans(tagger: Tagger | None, texts: list[str]) -> list[tuple[list, list]]:
    """For each text its base spans, and all spans, both by kind, then start."""
    base = [base_spans(t) for t in texts]
    if tagger is None:
        return [(b, b) for b in base]
    places = [(k, a, b) for k, t in enumerate(texts) for a, b in regions(t)]
    every = [list(b) for b in base]
    spans_of: list[list[tuple[int, int]] | None] = [None] * len(texts)
    for (k, a, _), tags in zip(places, decode(tagger, [texts[k][a:b] for k, a, b in places])):
        found = tagged_spans(tags)
        if found and spans_of[k] is None:
            spans_of[k] = sorted((p, q) for _, p, q in base[k])
        for told, p, q in found:
            # digits that are not what they were taken for may be another number: the content decides
            x, y = snapped(told, texts[k], a + p, a + q)
            tried = [(told, x, y)]
            if told:
                u, v = digit_run(texts[k], x, y)
                tried = [(2, u, v), *tried, (1, u, v)]
            if (hit := next((t for t in tried if plausible(t[0], texts[k][t[1] : t[2]])), None)) and not meets(spans_of[k], *hit[1:]):
                every[k].append(hit)
    return [(b, sorted(set(e))) for b, e in zip(base, every)]


def meets(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Does a span of an ascending list share a character with a to b? (Base spans of different kinds may overlap, by less than 64 spans.)"""
    k = bisect_left(spans, (b, 0))
    return any(p < b and a < q for p, q in spans[max(0, k - 64) : k])


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans."""

    def start():
        def work(cols: dict) -> list[tuple]:
            out = []
            for doc_id, (base, every) in zip(cols["doc_id"], all_spans(tagger, cols["text"])):
                counts = [sum(k == j for k, _, _ in base) for j in range(len(KINDS))]
                out.append((doc_id, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            return out

        return work

    return map_rows(doc_texts(docs), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", start)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in brackets."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """``docs`` with personal data masked in ``text`` (null stays null) and ``n_chars`` counted anew; other columns as they are."""
    import pyarrow as pa

    names = docs.columns
    at = names.index("text")

    def run(batches):
        claim("pii")
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = part.column(at).to_pylist()
                new = [None if t is None else mask(t, s) if s else t for t, (_, s) in zip(texts, all_spans(tagger, [t or "" for t in texts]))]
                cols = list(part.columns)
                cols[at] = pa.array(new, cols[at].type)
                if "n_chars" in names:
                    j = names.index("n_chars")
                    cols[j] = pa.array([o if t is None else len(t) for t, o in zip(new, cols[j].to_pylist())], cols[j].type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return small_batches(docs).mapInArrow(run, docs.schema)
