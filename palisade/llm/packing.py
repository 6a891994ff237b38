"""Packing of tokenized documents into training windows by the sum-of-squares rule.

A worker packs the documents of its partition as they come.  A document gives whole windows first; its rest goes to the
partially filled window whose choice makes the sum of the squared counts of windows per fill level smallest (a level
array of ``size`` counts holds the state).  At the partition's end the windows that are still open are closed without
padding: documents may be cut freely, so the smallest open windows fill up the largest, and the last few tokens
are cut at powers of two, where a window needs no padding.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

SIZE = 2048
END = 1
CACHE_WORDS = 400_000
BATCH_PIECES = 500  # of at most ``size`` ids each
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"[ \t\n\r]+")
_PLAIN = re.compile("[\x21-\x7e\xa1-\u024f]+").fullmatch


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: visible Latin-1 stands for itself, the rest follow 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Ids of a tokenizer that drops white space, as little-endian 32-bit bytes, word by word.

    The tokenizer never joins what white space parts, so a text's ids are those of its words.  Words that repeat are
    encoded once, and so are their parts (letters, digits, marks), which repeat more; a full memory is emptied.  Words
    outside plain Latin, and words that hold the string of a special token, go through the whole tokenizer: as it does by
    default, it reads that string as the special token.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = common.Memory(CACHE_WORDS)
        self.parts: dict[str, bytes] = {}
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        with open(path, encoding="utf-8") as f:
            written = json.load(f)
        split = written["pre_tokenizer"]["pretokenizers"][0]
        special = [t["content"] for t in written["added_tokens"]]
        if any(_SPACE.search(t) for t in special):
            raise ValueError("special tokens without white space are needed")
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)").search
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.letters = dict(enumerate(byte_letters()))

    @staticmethod
    def words(text: str) -> list[str]:
        # str.split() also splits at \x1c-\x1f, which are no white space to the tokenizer
        return _SPACE.split(text) if _ODD_SPACE.search(text) else text.split()

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            if len(self.parts) > CACHE_WORDS:
                self.parts.clear()
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            found = self.parts[part] = b"".join([self.packed[t.id] for t in self.tokenizer.model.tokenize(shown)])
        return found

    def word(self, w: str) -> bytes:
        if w.isascii() and w.isalpha():
            return self.part(w.lower())
        if _PLAIN(w) and not self.special(w):  # composed letters whose lower case is one step
            return b"".join(map(self.part, self.pattern.findall(w.lower())))
        ids = self.tokenizer.encode(w, add_special_tokens=False).ids
        return b"".join([self.packed[i] for i in ids])

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(self.known.fill(self.words(t), self.word)) for t in texts]


def encoder(path: str) -> WordEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return common.held(f"words {path}", lambda: WordEncoder(path))


class SumOfSquares:
    """Open windows by fill level.  ``place`` takes a piece's length and returns (window, offset)."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size)]
        self.windows = 0

    def new(self) -> int:
        self.windows += 1
        return self.windows - 1

    def place(self, length: int) -> tuple[int, int]:
        """The sum of squares changes by 2(c[level+length] - c[level]) + 2 where a window moves up a level,
        by 1 - 2 c[level] where it fills up, and by 2 c[length] + 1 for a new window."""
        c = self.counts
        top = self.size - length
        change = 2 * (c[length : self.size + 1] - c[: top + 1]) + 2
        change[top] = 1 - 2 * c[top]
        change[0] = 2 * c[length] + 1
        change[1:][c[1 : top + 1] == 0] = np.iinfo(np.int64).max
        level = top - int(change[::-1].argmin())  # of equals the fullest
        if level:
            window = self.open[level].pop()
            c[level] -= 1
        else:
            window = self.new()
        if level + length < self.size:
            self.open[level + length].append(window)
            c[level + length] += 1
        return window, level


def powers(n: int) -> list[int]:
    """Powers of two that add up to ``n``, largest first."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def pack_lengths(lengths: list[int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, window, offset) of documents with ``lengths`` tokens, without padding."""
    packer = SumOfSquares(size)
    pieces, held = [], {}
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= size:
            pieces.append((doc, start, size, packer.new(), 0))
            start += size
        if start < n:
            window, offset = packer.place(n - start)
            held.setdefault(window, []).append((doc, start, n - start, offset))
    open_ = [(level, w) for level in range(1, size) for w in packer.open[level]]
    left = {w for _, w in open_}
    pieces += [(d, s, n, w, o) for w, ps in held.items() if w not in left for d, s, n, o in ps]
    # close what is open: the largest stay, the smallest are cut up to fill them
    total = sum(level for level, _ in open_)
    goals = [size] * (total // size) + powers(total % size)
    stay = sorted(open_, reverse=True)
    flat = [list(held[w]) for _, w in stay]
    queue = [(d, s, n) for ps in flat[len(goals) :] for d, s, n, _ in ps]
    short = []  # windows to fill, once what does not fit the others is known
    for goal, ps in zip(goals, flat + [[]] * len(goals), strict=False):
        window, at = packer.new(), 0
        for d, s, n, _ in ps:
            take = min(n, goal - at)
            if take:
                pieces.append((d, s, take, window, at))
                at += take
            if take < n:
                queue.append((d, s + take, n - take))
        short.append((window, at, goal))
    for window, at, goal in short:
        while at < goal:
            d, s, n = queue.pop()
            take = min(n, goal - at)
            pieces.append((d, s, take, window, at))
            at += take
            if take < n:
                queue.append((d, s + take, n - take))
    return pieces


PIECE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [T.StructField("ids", T.BinaryType())]
)


def piece_batches(fields: T.StructType, name: pa.DataType, names: list, bodies: list[bytes], pieces: list, base: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``pieces`` in small batches: a group's ids are not copied all at once, neither here nor on the JVM's side."""
    for at in range(0, len(pieces), BATCH_PIECES):
        doc, start, length, window, offset = (list(x) for x in zip(*pieces[at : at + BATCH_PIECES], strict=True))
        cut = [memoryview(bodies[d])[4 * s : 4 * (s + n)] for d, s, n in zip(doc, start, length, strict=True)]
        columns = [
            pa.array([names[d] for d in doc], name),
            start,
            length,
            [zlib.crc32(c) for c in cut],
            [len(bodies[d]) // 4 for d in doc],
            [base + w for w in window],
            offset,
        ]
        if "ids" in fields.names[1:]:
            columns.append(pa.array([bytes(c) for c in cut], pa.binary()))
        yield pa.RecordBatch.from_pydict(dict(zip(fields.names, columns, strict=True)))


def pack(df: DataFrame, tokenizer: str, id_: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, ids: bool = True, group: int = 1 << 25) -> DataFrame:
    """Pieces of all documents of ``df`` in windows of at most ``size`` tokens.

    ``tokenizer`` is a tokenizer file whose words are parted by white space; every document ends with token ``end``.  A row
    per piece: ``id_``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, unless ``ids`` is
    false, ``ids`` (little-endian 32-bit).  A null or empty text has the one token ``end``; equal rows are packed each; an
    empty table gives an empty table.  ``group`` bounds the bytes of ids that a worker holds before it closes its
    windows.
    """
    fields = T.StructType([df.schema[id_], *[f for f in PIECE.fields if ids or f.name != "ids"]])

    from pyspark.sql.pandas.types import to_arrow_type

    NAME = to_arrow_type(df.schema[id_].dataType)
    last = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        base = TaskContext.get().partitionId() << 32
        names, bodies, held = [], [], 0
        for batch in common.batches_up_to(batches, 500):
            names += batch.column(id_).to_pylist()
            new = [b + last for b in encode(common.texts(batch.column(text)))]
            bodies += new
            held += sum(map(len, new))
            if held >= group:
                pieces = pack_lengths([len(b) // 4 for b in bodies], size)
                yield from piece_batches(fields, NAME, names, bodies, pieces, base)
                base += max(p[3] for p in pieces) + 1
                names, bodies, held = [], [], 0
        if names:
            yield from piece_batches(fields, NAME, names, bodies, pack_lengths([len(b) // 4 for b in bodies], size), base)

    return df.select(id_, text).mapInArrow(run, fields)


def digest(df: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's columns of ``pack``."""
    return pack(df, tokenizer, ids=False)
