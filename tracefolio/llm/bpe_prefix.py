"""Byte-level BPE by dynamic programming over prefixes.

Two tokens are *compatible* if the pair's own bytes encode to exactly these two. A sequence of tokens is the BPE encoding
of its bytes exactly if all neighbours are compatible, so a byte prefix has one encoding and one *last token*: the token t
whose remaining prefix ends in a token compatible with t. ``Prefix`` stores that last token for every prefix. Appending
bytes only extends the table (exactly, unlike encoding the appendix by itself), and an edit re-encodes from the edit on,
only until the table's entries agree with the old ones over a full token's length.

Compatibility is decided from the merges by undoing them: starting with a pair of tokens, no merge across the boundary
may have come before the merges that built both sides.

Texts are first cut by the pattern; each distinct piece is encoded once a worker (a memo bounded in pieces and in their length). Decoding joins the
tokens' bytes. Defined results: a null text is an empty one (no tokens); a very long text is encoded whole, piece by piece, and a very long piece
(a run of letters without end) costs time and memory in proportion to its bytes; every row gives one row, repeated ones too; no
row is moved between tasks, so skew in any column does not matter; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from struct import pack

import numpy as np
from pyspark.sql import DataFrame

from tracefolio.llm.common import KEPT_CHARS, claim, doc_texts, map_rows, tokenizer_path


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks, the pair of tokens each token is merged from, and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank_of = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.fits: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        #: the tokens that the encoding of their own bytes is; no other one is ever used
        self.usable = {t: r for t, r in ranks.items() if len(t) == 1 or self.merge(t) == [r]}
        self.longest_ending = [1] * 256
        for t in self.usable:
            self.longest_ending[t[-1]] = max(self.longest_ending[t[-1]], len(t))

    def merged_from(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of this token joins; None for a byte, or where its bytes are never merged to it."""
        if token not in self.parts:
            self.parts[token] = None
            raw = self.bytes_of[token]
            if len(raw) > 1:
                ids = self.merge(raw, token)
                self.parts[token] = (ids[0], ids[1]) if len(ids) == 2 else None
        return self.parts[token]

    def merge(self, raw: bytes, below: int | None = None) -> list[int]:
        """Plain BPE, used to build the tables only: the lowest rank is merged first, leftmost first; only ranks under ``below``."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, i = min((self.rank_of.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60 or below is not None and rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank_of[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        known = self.fits[left << 32 | right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        limit = 1 << 60
        rank_of, bytes_of = self.rank_of, self.bytes_of
        while True:
            # would left and right merge before the merge that was undone last?
            joined = rank_of.get(bytes_of[left] + bytes_of[right])
            if joined is not None and joined < limit:
                return False
            # undo the later of the two merges; on the left side the right half stays at the boundary, and the reverse
            if left > right:
                if (parts := self.merged_from(left)) is not None:
                    limit, left = left, parts[1]
                    continue
                if (parts := self.merged_from(right)) is None:
                    return True
                limit, right = right + 1, parts[0]
            else:
                if (parts := self.merged_from(right)) is not None:
                    limit, right = right + 1, parts[0]
                    continue
                if (parts := self.merged_from(left)) is None:
                    return True
                limit, left = left, parts[1]


class Prefix:
    """The last token of every prefix of some bytes."""

    def __init__(self, vocabulary: Vocabulary, raw: bytes = b""):
        self.vocabulary, self.raw = vocabulary, b""
        self.last: list[int] = []
        if raw:
            self.append(raw)

    def append(self, more: bytes) -> None:
        start = len(self.raw)
        raw = self.raw = self.raw + more
        v, last = self.vocabulary, self.last
        usable, fits, longest, compatible = v.usable.get, v.fits.get, v.longest_ending, v.compatible
        for end in range(start + 1, len(raw) + 1):
            for at in range(max(0, end - longest[raw[end - 1]]), end):
                token = usable(raw[at:end])
                if token is not None:
                    if not at:
                        break
                    known = fits(last[at - 1] << 32 | token)
                    if known or known is None and compatible(last[at - 1], token):
                        break
            else:
                raise ValueError("a byte has no token")
            last.append(token)

    def fork(self) -> "Prefix":
        """A copy that can be appended to by itself."""
        out = Prefix(self.vocabulary)
        out.raw, out.last = self.raw, self.last.copy()
        return out

    def _find(self, end: int) -> int:
        v, raw, last = self.vocabulary, self.raw, self.last
        rank_of, fits = v.usable, v.fits
        for at in range(max(0, end - v.longest_ending[raw[end - 1]]), end):
            token = rank_of.get(raw[at:end])
            if token is not None:
                if not at:
                    return token
                known = fits.get(last[at - 1] << 32 | token)
                if known or known is None and v.compatible(last[at - 1], token):
                    return token
        raise ValueError("a byte has no token")

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace raw[start:stop]; gives how many prefixes were computed again.

        After the edit, entries are computed until as many in a row as the longest token has bytes equal the old ones; from there on
        every choice looks back only on entries that agree, so the old entries hold.
        """
        old, tail = self.last, self.raw[stop:]
        self.raw, shift = self.raw[:start] + new + tail, len(new) - (stop - start)
        self.last, same, done = old[:start], 0, 0
        for end in range(start + 1, len(self.raw) + 1):
            token = self._find(end)
            self.last.append(token)
            done += 1
            same = same + 1 if end > start + len(new) and old[end - 1 - shift] == token else 0
            if same >= self.vocabulary.longest:
                self.last += old[end - shift :]
                break
        return done

    def ids(self) -> list[int]:
        out, at = [], len(self.raw)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]

    def packed(self) -> bytes:
        ids = self.ids()
        return pack(f"<{len(ids)}I", *ids)


class Memo(dict):
    """Piece to its packed ids; emptied when full. Pieces with the same first bytes share those bytes' table."""

    HEAD = 7

    def __init__(self, vocabulary: Vocabulary, most: int = 500_000):
        super().__init__()
        self.vocabulary, self.most = vocabulary, most
        self.heads: dict[bytes, Prefix] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
            self.heads.clear()
        raw = piece.encode()
        token = self.vocabulary.usable.get(raw)
        packed = pack("<I", token) if token is not None else self.table(raw).packed()
        if len(piece) <= KEPT_CHARS:
            self[piece] = packed
        return packed

    def table(self, raw: bytes) -> Prefix:
        head = raw[: self.HEAD]
        known = self.heads.get(head)
        if known is None:
            known = self.heads[head] = Prefix(self.vocabulary, head)
        if len(raw) == len(head):
            return known
        out = known.fork()
        out.append(raw[self.HEAD :])
        return out


class Encoder:
    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary = Vocabulary(read_ranks(path))
        self.pieces = regex.compile(pattern).findall
        self.memo = Memo(self.vocabulary)
        self.table = [self.vocabulary.bytes_of.get(i, b"") for i in range(max(self.vocabulary.bytes_of) + 1)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.pieces(text)))

    def empty(self) -> None:
        self.memo.clear()
        self.memo.heads.clear()

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    e = _ENCODERS[path, pattern]
    claim(path, e.empty)
    return e


def encode_decode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, *, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded as binary)."""
    import public_tokenizers

    path, cut = ranks or tokenizer_path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def start():
        enc = encoder(path, cut)

        def work(cols: dict) -> list[tuple]:
            out = []
            for doc_id, text in zip(cols["doc_id"], cols["text"]):
                ids = enc.encode(text)
                back = enc.decode(ids)
                row = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest())
                out.append((*row, ids, back) if keep_ids else row)
            return out

        return work

    return map_rows(doc_texts(docs), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * keep_ids, start)
