"""Byte-level BPE encoding and decoding by prefix dynamic programming (operator 6).

For each prefix of a byte string there is exactly one token that can end its encoding: the one
that is compatible with the token before it, where two tokens are compatible if encoding their
joined bytes gives the two again. Storing that last token for every prefix gives the encoding of
all prefixes at once, so text can be appended, cut and re-encoded near an edit exactly.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Pieces of up to so many characters that a Python worker remembers, and pairs of tokens; beyond it the memory starts anew.
REMEMBERED, SHORT = 250_000, 64


class Vocabulary:
    """Ranks of byte strings, as a tiktoken file states them."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        # By the last two bytes: the lengths of the tokens that end so, longest first.
        ends: dict[bytes, set[int]] = {}
        for t in self.ranks:
            if len(t) > 1:
                ends.setdefault(t[-2:], set()).add(len(t))
        self.lengths = {end: (*sorted(found, reverse=True), 1) for end, found in ends.items()}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._edges: dict[int, tuple[bool, list, list]] = {}

    def merged(self, data: bytes) -> tuple[list[bytes], list[bytes], list[bytes]]:
        """BPE by its definition: join the neighbours of least rank, the leftmost first, until none joins.

        Also the parts that stood first and those that stood last on the way.
        """
        parts = [data[i : i + 1] for i in range(len(data))]
        firsts, lasts = parts[:1], parts[-1:]
        while len(parts) > 1:
            found = [(self.ranks[ab], i) for i in range(len(parts) - 1) if (ab := parts[i] + parts[i + 1]) in self.ranks]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if i == 0:
                firsts.append(parts[0])
            if i == len(parts) - 1:
                lasts.append(parts[-1])
        return parts, firsts, lasts

    def edges(self, token: int) -> tuple[bool, list, list]:
        """Whether merging the token's bytes gives the token; its first and its last parts on the way,

        each with the rank at which the next replaces it.
        """
        if (found := self._edges.get(token)) is None:
            parts, firsts, lasts = self.merged(self.bytes_of[token])
            spans = [
                [(p, self.ranks[q] if q else 1 << 60) for p, q in zip(x, [*x[1:], b""], strict=True)] for x in (firsts, lasts)
            ]
            found = self._edges[token] = (len(parts) == 1, *spans)
        return found

    def reachable(self, token: int) -> bool:
        return self.edges(token)[0]

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge across the border comes before those inside ``a`` and ``b``.

        The parts that touch at the border are followed through both tokens' merges, in the order of ranks.
        """
        if (found := self._pairs.get((a, b))) is None:
            if len(self._pairs) > REMEMBERED:
                self._pairs.clear()
            rank_of, found = self.ranks.get, self.reachable(b)
            rights, lefts = self.edges(a)[2], self.edges(b)[1]
            i = j = 0
            while found:
                right, until = rights[i]
                left, until_b = lefts[j]
                rank = rank_of(right + left)
                if rank is not None and rank < until and rank <= until_b:
                    found = False
                    break
                # Of equal ranks the one further left merges first.
                if until <= until_b:
                    i += 1
                else:
                    j += 1
                if i == len(rights) or j == len(lefts):
                    break
            self._pairs[a, b] = found
        return found


class Prefixes:
    """The encodings of all prefixes of one piece: ``last[i]`` ends that of the first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        v, last = self.vocabulary, self.last
        start, self.data = len(self.data), self.data + more
        data, rank_of, lengths_of, pair_of, one = self.data, v.ranks.get, v.lengths.get, v._pairs.get, (1,)
        for end in range(start + 1, len(data) + 1):
            for length in lengths_of(data[end - 2 : end], one) if end > 1 else one:
                if length < end:
                    token = rank_of(data[end - length : end])
                    if token is None:
                        continue
                    before = last[end - length - 1]
                    fits = pair_of((before, token))
                    if fits is None:
                        fits = v.compatible(before, token)
                elif length == end:
                    token = rank_of(data[:end])
                    fits = token is not None and v.reachable(token)
                else:
                    continue
                if fits:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def cut(self, end: int) -> None:
        """Keep the first ``end`` bytes, whose encodings are known."""
        self.data = self.data[:end]
        del self.last[end:]

    def replace(self, begin: int, end: int, new: bytes) -> None:
        """Edit bytes ``begin:end``; prefixes before the edit are kept as they are."""
        rest = self.data[end:]
        self.cut(begin)
        self.append(new + rest)

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Encoder:
    """Whole texts: each match of ``pattern`` is encoded separately."""

    def __init__(self, path: str, pattern: str) -> None:
        self.vocabulary, self.find = Vocabulary(path), regex.compile(pattern).findall
        self._known: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces into memory, in byte order: each starts from the prefix that it shares with the one before.

        Ids are little-endian unsigned 32-bit integers. A piece that is a token whole stays whole.
        """
        ranks, known = self.vocabulary.ranks, self._known
        at = Prefixes(self.vocabulary)
        for data, piece in sorted((p.encode(), p) for p in pieces):
            token = ranks.get(data)
            if token is None:
                same, held = min(len(data), len(at.data)), at.data
                while data[:same] != held[:same]:
                    same -= 1
                at.cut(same)
                at.append(data[same:])
                known[piece] = b"".join([i.to_bytes(4, "little") for i in at.ids()])
            else:
                known[piece] = token.to_bytes(4, "little")

    def encode(self, texts: list[str]) -> list[bytes]:
        found = [self.find(t) for t in texts]
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        new = {x for pieces in found for x in pieces if x not in known}
        self.learn(list(new))
        out = [b"".join([known[x] for x in pieces]) for pieces in found]
        for x in new:
            if len(x) > SHORT:
                del known[x]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, memoryview(ids).cast("I"))) if ids else b""


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One for each vocabulary and Python worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids, decoded) for every row of ``docs``: ids as packed 32-bit integers, and their bytes again.

    Null text is empty and has no ids; a null id stays null; rows that repeat come back as often.
    ``path`` names the vocabulary file, which every executor has. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = enc.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(map(enc.decode, ids), pa.binary())], [id_col, "ids", "decoded"]
                )

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col("text")).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")
