"""Byte-level BPE by monoid tree reduction.

Encodings form a monoid: the encoding of a text is put together from those of its halves.  Only what lies near the seam can
change, so a join encodes a window around it anew and lets the window grow until the tokens outside provably
stay as they are.  Two trees use this:

* ``pieces``: the pre-tokenizer's matches of a text.  A match of the left half stands if the half goes on for as many
  characters as the pattern looks ahead; once a new match begins where one of the right half begins, all later ones agree.
* ``encode_piece``: the merges inside one match.  A sequence of tokens is the encoding of its bytes if every
  neighbouring pair is the encoding of its own bytes, so a window is wide enough when the pairs at its two rims are.
  Windows of a run in which every join moves all tokens would be as long as the run; once a match's windows add up to a
  quarter of its length, it is merged in one go with a heap, so that no match costs more than a small multiple of n log n.

Decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

LEAF_CHARS = 1 << 14
LEAF_BYTES = 24
HEAP_BYTES = 96  # shorter strings merge faster by looking through the ranks
LOOK_AHEAD = 3  # 'll needs two characters after the quote; a space run needs one
CACHE_PIECES = 600_000


class Bpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.rank.items()}
        self.pattern = regex.compile(pattern)
        self.known = common.Memory(CACHE_PIECES)
        self.shown = {i: str(i) for i in self.bytes_of}
        self.pairs: dict[tuple[int, int], bool] = {}

    # ------------------------------------------------------------ one match

    def merge(self, data: bytes) -> list[int]:
        """The merges in order of rank, leftmost first; for leaves and windows."""
        if len(data) > HEAP_BYTES:
            return self.merge_long(data)
        get, none = self.rank.get, 1 << 30
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], none)
        return [self.rank[p] for p in parts]

    def merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of (rank, place) and linked parts."""
        n, rank = len(data), self.rank.get
        end = list(range(1, n + 1))  # of the part that begins here; 0: no part begins here any more
        before = list(range(-1, n - 1))
        heap = [r * n + i for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        current = dict(map(reversed, map(divmod, heap, itertools.repeat(n))))  # place: rank of its pair
        while heap:
            r, i = divmod(pop(heap), n)
            if current.get(i) != r:
                continue
            middle = end[i]
            stop = end[i] = end[middle]
            end[middle] = 0
            current.pop(middle, None)
            if stop < n:
                before[stop] = i
                new = rank(data[i : end[stop]])
            else:
                new = None
            if new is None:
                del current[i]
            else:
                current[i] = new
                push(heap, new * n + i)
            left = before[i]
            if left >= 0:
                new = rank(data[left:stop])
                if new is None:
                    current.pop(left, None)
                else:
                    current[left] = new
                    push(heap, new * n + left)
        out, i = [], 0
        while i < n:
            out.append(self.rank[data[i : end[i]]])
            i = end[i]
        return out

    def stands(self, a: int, b: int) -> bool:
        """Whether the two tokens are the encoding of their bytes."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > CACHE_PIECES:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int], room: list[int]) -> list[int] | None:
        """Encoding of two encoded strings put together; None once the windows' bytes exceed ``room``."""
        if not left or not right or self.stands(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j]))
            if len(window) > HEAP_BYTES:
                room[0] -= len(window)
                if room[0] < 0:
                    return None
            middle = self.merge(window)
            if (i == 0 or self.stands(left[i - 1], middle[0])) and (j == len(right) or self.stands(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            width *= 2

    def encode_piece(self, data: bytes) -> list[int]:
        room = [len(data) // 4]
        found = self.reduce(data, room)
        return self.merge(data) if found is None else found

    def reduce(self, data: bytes, room: list[int]) -> list[int] | None:
        """Leaves hold a power of two bytes, so that the tokens of a run of one character end where its leaves end."""
        token = self.rank.get(data)
        if token is not None:
            return [token]
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = 1 << (len(data) - 1).bit_length() - 1
        left = self.reduce(data[:half], room)
        right = None if left is None else self.reduce(data[half:], room)
        return None if right is None else self.join(left, right, room)

    # ------------------------------------------------------------ a text

    def pieces(self, text: str) -> list[str]:
        """The pattern's matches; they cover the text."""
        if len(text) <= LEAF_CHARS:
            return self.pattern.findall(text)
        half = len(text) // 2
        left, right = self.pieces(text[:half]), self.pieces(text[half:])
        at = half
        while left and half - at < LOOK_AHEAD:  # the match before the window must have been free to look ahead
            at -= len(left.pop())
        ends, k = half, 0
        middle = []
        while at != ends:
            m = self.pattern.match(text, at)
            middle.append(m.group())
            at = m.end()
            while ends < at:
                ends += len(right[k])
                k += 1
        return left + middle + right[k:]

    def encode(self, text: str) -> list[int]:
        return list(itertools.chain.from_iterable(self.known.fill(self.pieces(text), self.tokens)))

    def tokens(self, piece: str) -> tuple[int, ...]:
        return tuple(self.encode_piece(piece.encode()))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the tokens, halves concatenated up the tree."""
        if len(ids) <= 1 << 16:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def loaded(path: str, pattern: str) -> Bpe:
    return common.held(f"pieces {path} {pattern}", lambda: Bpe(path, pattern))


def encode_column(df: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array<int>), the tokens of its texts; a null or empty text has none.

    An input column ``ids`` is replaced; equal texts have equal ids; an empty table gives an empty table.
    """
    schema = common.added(df.schema, [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ranks, pattern)
        for batch in common.batches_up_to(batches, 500):
            columns = {f.name: batch.column(f.name) for f in schema.fields if f.name != "ids"}
            ids = pa.array([bpe.encode(t) for t in common.texts(batch.column(text))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns | {"ids": ids})

    return df.mapInArrow(run, schema)


def decode_column(df: DataFrame, ranks: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (binary), the bytes of the tokens in ``ids``; a null list has none."""
    schema = common.added(df.schema, [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ranks, pattern)
        for batch in common.batches_up_to(batches, 500):
            columns = {f.name: batch.column(f.name) for f in schema.fields if f.name != "decoded"}
            back = pa.array([bpe.decode(x or []) for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_pydict(columns | {"decoded": back})

    return df.mapInArrow(run, schema)


def digest(df: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The contract's columns: ids and decoded bytes stay with the worker."""

    def row(bpe: Bpe, text: str) -> tuple[int, str, str]:
        ids = bpe.encode(text)
        sha = hashlib.sha256
        return len(ids), sha(" ".join(map(bpe.shown.__getitem__, ids)).encode()).hexdigest(), sha(bpe.decode(ids)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ranks, pattern)
        for batch in common.batches_up_to(batches, 500):
            n, ids, back = zip(*(row(bpe, t) for t in common.texts(batch.column("text"))), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([df.schema["doc_id"], *T._parse_datatype_string("n_tokens long, ids_sha256 string, decoded_sha256 string").fields])
    return df.select("doc_id", "text").mapInArrow(run, schema)
