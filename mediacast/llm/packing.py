"""Best-fit packing with bounded space (operator 1).

Each task keeps a fixed number of open bins. An integer serves as bitset: bit f is set if some open
bin has f places free, so the best fit for a piece of n tokens is the lowest set bit from n on.
When a new bin is needed and all are open, the fullest closes. At the end of a task the pieces of
its open bins are packed once more in decreasing length, which leaves about one bin unfilled.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import punctuation as PUNCTUATION
from unicodedata import is_normalized

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

WIDTH = 2048
OPEN_BINS = 256
#: Words of up to so many characters that a Python worker remembers; beyond it the memory starts anew.
REMEMBERED, SHORT = 250_000, 64


class Packer:
    """Online packer: ``add`` returns the bins that closed, as lists of pieces."""

    def __init__(self, width: int, open_bins: int) -> None:
        self.width, self.open_bins, self.count = width, open_bins, 0
        self.bits = 0
        self.by_free: dict[int, list[list]] = {}

    def _put(self, free: int, pieces: list) -> None:
        self.by_free.setdefault(free, []).append(pieces)
        self.bits |= 1 << free
        self.count += 1

    def _take(self, free: int) -> list:
        held = self.by_free[free]
        pieces = held.pop()
        if not held:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return pieces

    def add(self, piece, length: int) -> list[list]:
        closed = []
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            pieces = self._take(free)
        else:
            if self.count >= self.open_bins:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            free, pieces = self.width, []
        pieces.append((piece, length))
        if free == length:
            closed.append(pieces)
        else:
            self._put(free - length, pieces)
        return closed

    def finish(self) -> list[list]:
        """Empties the open bins, packing their pieces again with the longest first."""
        rest = sorted((p for held in self.by_free.values() for pieces in held for p in pieces), key=lambda p: -p[1])
        again = Packer(self.width, len(rest) + 1)
        out = [pieces for piece, length in rest for pieces in again.add(piece, length)]
        self.__init__(self.width, self.open_bins)
        return out + [pieces for held in again.by_free.values() for pieces in held]


class Words:
    """Ids of a text by a tokenizer whose pieces never span white space, remembered by word.

    Most words are letters and then ASCII punctuation, two pieces that the tokenizer's model can
    encode without its normalizer and pre-tokenizer. All others go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.to_units = {b: self.unit(b) for b in range(256)}

    @staticmethod
    def unit(byte: int) -> str:
        """The character that stands for a byte: itself if it prints in Latin-1, else the next of those from 256 on."""
        printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
        return chr(byte if byte in printing else 256 + byte - sum(x < byte for x in printing))

    def _model(self, piece: str) -> bytes:
        data = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.to_units)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(data)])

    def word(self, word: str) -> bytes:
        letters = word.rstrip(PUNCTUATION)
        rest = word[len(letters) :]
        if (not letters or letters.isalpha()) and not any(c in letters for c in "\u03a3\u0130") and is_normalized("NFC", letters):
            found = (self._model(letters.lower()) if letters else b"") + (self._model(rest) if rest else b"")
        else:
            found = self._plain(word)
        if len(word) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f") or any(s in text for s in self.special):
            # White space to Python but not to the tokenizer, or a special token's string: not to be cut up.
            return self._plain(text)
        known, word = self.known, self.word
        return b"".join([known.get(w) or word(w) for w in text.split()])

    def _plain(self, text: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])


_words: dict[str, Words] = {}


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 0, width: int = WIDTH, open_bins: int = OPEN_BINS, id_col: str = "doc_id"
) -> DataFrame:
    """Pieces (id_col, piece, start, length, ids, sequence_id, offset) of every row of ``docs``.

    A document is its text's ids, then ``end_id``; null text has only that. Documents of up to
    ``width`` ids stay whole, longer ones are cut into pieces of ``width``, the last of them perhaps
    shorter. ``ids`` holds packed 32-bit integers. Each task packs what it reads: no shuffle, and
    memory for ``open_bins`` bins. Repeated rows are packed each, a null id stays null. An empty
    table gives no rows. ``tokenizer`` names a file that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words.get(tokenizer) or _words.setdefault(tokenizer, Words(tokenizer))
        packer = Packer(width, open_bins)
        next_id = TaskContext.get().partitionId() << 40
        tail, step = end_id.to_bytes(4, "little"), 4 * width

        def rows(closed: list[list]) -> Iterator[tuple]:
            nonlocal next_id
            for pieces in closed:
                offset = 0
                for (key, k, ids), length in pieces:
                    yield key, k, k * width, length, ids, next_id, offset
                    offset += length
                next_id += 1

        def table(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

        kinds, ready = None, []
        for batch in batches:
            kinds = kinds or [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = (words.encode(text) if text else b"") + tail
                    for k in range(0, -(-len(ids) // step)):
                        piece = ids[k * step : (k + 1) * step]
                        ready += rows(packer.add((key, k, piece), len(piece) // 4))
                if len(ready) >= 512:
                    yield table(ready)
                    ready = []
        ready += rows(packer.finish())
        for at in range(0, len(ready), 1024):
            yield table(ready[at : at + 1024])

    names = [id_col, "piece", "start", "length", "ids", "sequence_id", "offset"]
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids binary, sequence_id long, offset long"
    return docs.select(F.col(id_col), F.col("text")).mapInArrow(run, schema)
