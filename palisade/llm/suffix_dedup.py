"""Exact removal of repeated substrings with per-shard suffix arrays.

A *window* is a string of ``window`` bytes inside one document.  A window is repeated if the same bytes
start anywhere else in the corpus, in the same document included; every byte that a repeated window covers
is removed.  All decisions are made on the input texts.

1. Documents are gathered into shards of bounded size.  Each shard gets a suffix array: positions are sorted
   by their first eight bytes and refined by Larsson-Sadakane prefix doubling (only groups that still tie are
   sorted again) until none tie.  Kasai's recurrence gives the common prefixes of
   neighbours, and neighbours that share ``window`` bytes are repeats within the shard.
2. For repeats across shards, a shard's windows are gathered into *runs*: neighbouring windows whose smallest
   hashed ``gram``-byte string is the same.  Equal windows always have the same smallest gram, so only runs
   with the same gram can hold equal windows.  A shard sends the suffixes that begin at such grams, in the order of
   their hashed grams: an entry has the gram's hash and the hash of the run's bytes, or a mark where the shard has several
   runs of the gram.  The list is cut by binary search into ranges of the hash space, and a range's lists from
   all shards are merged by binary search.  Runs alike in both hashes are repeats as they are.
3. Runs that share the gram but differ in bytes (edges of a copied passage, lines with various surroundings) send the
   hashes of their windows, in the same sorted, range-cut form, and these are merged by binary search too.
4. The verdicts return to the shards, which cut the texts.

Nothing is gathered per document or per copy: a shard sends a gram and a window once however often it holds them, so a line
of a third of all documents is one entry a shard, and ranges split an even hash space.  The texts travel compressed, twice, to
meet the verdicts of their shard.  Shards and lists are written to the shared folder, so a lost executor costs its own tasks only.

The suffixes themselves don't travel: 200 bytes for each byte of text would.  Runs match by 128 bits of hashes and windows by 96;
two different windows among n that reach step 3 collide with chance n*n/2**97.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SEPARATOR = 0xFF  # never a byte of UTF-8
_ODD = 0x9E3779B97F4A7C15
_ODD_TOO = 0xC2B2AE3D27D4EB4F
_U = np.uint64


# ---------------------------------------------------------------- suffix arrays


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of ``text``.

    Larsson-Sadakane: a sorted prefix of h bytes becomes one of 2h by sorting each tied group by the rank of
    the suffix h places on.  It goes on until nothing ties, as Kasai's bound needs the full order.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).tobytes()
    first = np.ndarray((n,), ">u8", padded, 0, (1,)).astype(_U)
    order = np.argsort(first)
    key = first[order]
    begins = np.ones(n, bool)
    begins[1:] = key[1:] != key[:-1]
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0)) + 1  # 0: past the end
    slots = np.flatnonzero(_tied(begins))
    h = 8
    while len(slots) and h <= n + 8:
        at = order[slots]
        key = (rank[at] << 32) | rank[np.minimum(at + h, n)]
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[slots] = at
        begins = np.ones(len(key), bool)
        begins[1:] = key[1:] != key[:-1]
        rank[at] = slots[np.maximum.accumulate(np.where(begins, np.arange(len(key)), 0))] + 1
        slots = slots[_tied(begins)]
        h *= 2
    return order


def _tied(begins: np.ndarray) -> np.ndarray:
    tied = ~begins
    tied[:-1] |= ~begins[1:]
    return tied


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, lanes: int = 4096) -> np.ndarray:
    """Kasai: bytes that each suffix shares with the one before it in ``order``, counted up to ``most``.

    The text is walked in ``lanes`` stretches side by side: the prefix at i+1 is at least that at i less one.
    """
    n = len(text)
    before = np.full(n, n, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(most + 16, np.uint8)])
    words = np.ndarray((n + most + 8,), "<u8", padded.tobytes(), 0, (1,))
    out = np.zeros(n, np.int16 if most < 32767 else np.int64)
    step = -(-n // lanes) if n else 0
    start = np.arange(0, n, step) if n else np.zeros(0, np.int64)
    h = np.zeros(len(start), np.int64)
    for j in range(step):
        at = start + j
        at = at[at < n]
        prev, h = before[at], np.maximum(h[: len(at)] - 1, 0)
        go = np.flatnonzero((prev < n) & (h < most))
        h[prev >= n] = 0
        while len(go):
            a, b = at[go] + h[go], prev[go] + h[go]
            differ = words[a] ^ words[b]
            same = _low_zero_bytes(differ)
            same = np.minimum(same, n - np.maximum(a, b))
            h[go] += same
            go = go[(same == 8) & (h[go] < most)]
        np.minimum(h, most, out=h)
        out[at] = h
    return out


def _low_zero_bytes(x: np.ndarray) -> np.ndarray:
    """Equal bytes at the front of two little-endian words, from their difference."""
    low = x & (~x + _U(1))
    return np.where(x == 0, 8, np.bitwise_count(low - _U(1)) >> 3).astype(np.int64)


def repeated_starts(text: np.ndarray, window: int) -> np.ndarray:
    """True where a window starts that also starts at another place of ``text`` and holds no separator."""
    n = len(text)
    out = np.zeros(n, bool)
    if n <= window:
        return out
    order = suffix_order(text)
    shared = common_prefixes(text, order, window)
    pair = shared[order] >= window
    pair[0] = False
    out[order[pair]] = True
    out[order[np.flatnonzero(pair) - 1]] = True
    ends = np.concatenate([[0], np.cumsum(text == SEPARATOR)])
    whole = np.zeros(n, bool)
    whole[: n - window + 1] = ends[window:] == ends[: n - window + 1]
    return out & whole


# ---------------------------------------------------------------- runs


class Hashes:
    """Polynomial hashes of all substrings of one length; each byte has a fixed random value."""

    def __init__(self, text: np.ndarray, base: int = _ODD):
        n = len(text)
        value = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=_U) * _U(2) + _U(1)
        self.back = _powers(pow(base, -1, 2**64), n + 1)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(value[text] * _powers(base, n), out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - 1
        return self.of(slice(0, n - length + 1), slice(length, n + 1))


def _powers(base: int, n: int) -> np.ndarray:
    kept = common.held("powers")
    have = kept.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), _U(base))
        have[0] = 1
        kept[base] = have = np.cumprod(have, dtype=_U)
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(31))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(32)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def runs(text: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Hashes]:
    """First and past-the-last window of each run, its gram hash and the hash of its bytes."""
    none = np.zeros(0, np.int64)
    if len(text) < window:
        return none, none, none.astype(_U), none.astype(_U), Hashes(text)
    hashes = Hashes(text)
    smallest = sliding_min(hashes.all(gram), window - gram + 1)
    n = len(smallest)
    ends = np.concatenate([[0], np.cumsum(text == SEPARATOR)])
    whole = ends[window : window + n] == ends[:n]
    edge = np.ones(n, bool)
    edge[1:] = (smallest[1:] != smallest[:-1]) | ~whole[1:] | ~whole[:-1]
    edges = np.flatnonzero(edge)
    past = np.concatenate([edges[1:], [n]])
    keep = whole[edges]
    start, past = edges[keep], past[keep]
    body = np.maximum(hashes.of(start, past - 1 + window) + (past - start).astype(_U), _U(1))
    # the smallest of many hashes is a small one: mixed again, they fill the ranges evenly
    return start, past, _mix(smallest[start] + _U(_ODD)), body, hashes


# ---------------------------------------------------------------- sorted lists and their merging


def cut_ranges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Binary search for the bounds of 2**bits equal ranges of the hash space in a sorted list."""
    if not bits:
        return np.array([0, len(keys)])
    bounds = np.arange(1, 1 << bits, dtype=_U) << _U(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def merge_sorted(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted lists pairwise by binary search; also the place of each key in the lists put end to end."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    queue = [(x, np.arange(a, a + len(x))) for x, a in zip(lists, at, strict=False)]
    while len(queue) > 1:
        queue = [_merge_two(*queue[i : i + 2]) if i + 1 < len(queue) else queue[i] for i in range(0, len(queue), 2)]
    return queue[0] if queue else (np.zeros(0, _U), np.zeros(0, np.int64))


def _merge_two(left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
    (a, ia), (b, ib) = left, right
    to_a = np.arange(len(a)) + np.searchsorted(b, a, "left")
    to_b = np.arange(len(b)) + np.searchsorted(a, b, "right")
    keys, places = np.empty(len(a) + len(b), a.dtype), np.empty(len(a) + len(b), np.int64)
    keys[to_a], keys[to_b], places[to_a], places[to_b] = a, b, ia, ib
    return keys, places


def _neighbours(same_as_before: np.ndarray) -> np.ndarray:
    out = np.concatenate([[False], same_as_before])
    out[:-1] |= same_as_before
    return out


REPEATED, SENDS = 1, 2
SEVERAL = 0  # instead of a body: the shard has several


def entries(gram: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shard's sorted distinct grams, each with its one body or SEVERAL."""
    by = _sorted_distinct(gram, body)
    g, b = gram[by], body[by]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(g)]]))
    return g[first], np.where(count > 1, _U(SEVERAL), b[first])


def judge_runs(gram: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Flags of the shards' entries, sorted by gram hash: REPEATED as they are; SENDS its windows (where a gram has several
    bodies: the first of each body, and every shard with SEVERAL)."""
    out = np.zeros(len(gram), np.uint8)
    shared = np.flatnonzero(_neighbours(gram[1:] == gram[:-1])) if len(gram) else np.zeros(0, np.int64)
    if not len(shared):
        return out
    by = shared[np.lexsort((body[shared], gram[shared]))]
    g, b = gram[by], body[by]
    same_gram = g[1:] == g[:-1]
    same_body = same_gram & (b[1:] == b[:-1]) & (b[1:] != SEVERAL)
    out[by[_neighbours(same_body)]] |= REPEATED
    new_body = np.concatenate([[True], ~same_body])
    group = np.cumsum(np.concatenate([[True], ~same_gram])) - 1
    several = (np.bincount(group[new_body]) > 1)[group]
    out[by[new_body & several]] |= SENDS
    return out


def judge_windows(key: np.ndarray, more: np.ndarray) -> np.ndarray:
    """True for windows, sorted by ``key``, that another one equals in ``key`` and ``more``."""
    out = np.zeros(len(key), bool)
    shared = np.flatnonzero(_neighbours(key[1:] == key[:-1])) if len(key) else np.zeros(0, np.int64)
    by = shared[np.lexsort((more[shared], key[shared]))]
    if len(by):
        k, m = key[by], more[by]
        out[by[_neighbours((k[1:] == k[:-1]) & (m[1:] == m[:-1]))]] = True
    return out


def held_in(key: np.ndarray, more: np.ndarray, some: np.ndarray, some_more: np.ndarray) -> np.ndarray:
    """Whether each (key, more) is one of ``some``, which are sorted and distinct."""
    out = np.zeros(len(key), bool)
    if len(some):
        at = np.searchsorted(some, key)
        longest = int(np.unique(some, return_counts=True)[1].max())
        for k in range(longest):
            place = np.minimum(at + k, len(some) - 1)
            out |= (some[place] == key) & (some_more[place] == more)
    return out


# ---------------------------------------------------------------- the operator

_LIST = "shard long, slot int, keys binary, more binary"


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _joined(values: list[bytes]) -> np.ndarray:
    """Texts end to end, each followed by the separator."""
    return np.frombuffer(b"".join(x + b"\xff" for x in values), np.uint8)


def _shards(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    rows, size = [], 0
    for batch in batches:
        lengths = np.array([len(x) + 1 for x in common.text_bytes(batch.column(column))], np.int64)
        start = 0
        for i, length in enumerate(lengths.tolist()):
            if size and size + length > most:
                rows += [batch.slice(start, i - start)] if i > start else []
                yield pa.Table.from_batches(rows)
                rows, size, start = [], 0, i
            size += length
        if batch.num_rows > start:
            rows.append(batch.slice(start))
    if rows:
        yield pa.Table.from_batches(rows)


def _pieces(text: np.ndarray, window: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches whose windows are all windows of ``text``, each once: a long document is worked on in parts that overlap by
    one byte less than a window."""
    step = max(size, 4 * window)
    for at in range(0, max(1, len(text) - window + 1), step):
        yield at, text[at : at + step + window - 1]


def _sorted_distinct(keys: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    by = np.argsort(keys, kind="stable") if more is None else np.lexsort((more, keys))
    new = np.ones(len(by), bool)
    new[1:] = keys[by][1:] != keys[by][:-1]
    if more is not None:
        new[1:] |= more[by][1:] != more[by][:-1]
    return by[new]


def remove_repeats(
    df: DataFrame, text: str = "text", window: int = 200, gram: int = 64, shard_bytes: int = 1 << 20, range_bytes: int = 4 << 20
) -> DataFrame:
    """Every row of ``df`` with what is left of its text after all repeated windows are removed.

    Adds ``kept`` (binary, remaining bytes), ``kept_text`` (string: the removed runs drawn in to whole characters), ``n_bytes``, ``n_removed``,
    ``n_spans`` and ``removed`` (array of struct<start,end>, byte offsets of the maximal removed runs).  An input
    column with one of these names is replaced.  A null or empty text has nothing removed; texts shorter than
    ``window`` never match; equal rows are separate documents and remove each other's windows; an empty table
    gives an empty table.  Shards hold whole documents; a longer document makes a shard of its own and is worked on in
    overlapping pieces of a shard's size, whose repeats meet like those of different shards.
    """
    spark = df.sparkSession
    bits = max(2, min(20, int(np.ceil(np.log2(max(1, common.input_bytes(df)) / range_bytes)))))
    schema = df.schema

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, seq = TaskContext.get().partitionId(), 0
        for table in _shards(batches, text, shard_bytes):
            table = table.combine_chunks()
            data = _joined(common.text_bytes(table.column(text).combine_chunks()))
            shard = (partition << 28) | seq
            seq += 1
            own = np.zeros(len(data), bool)
            lists: list[tuple[int, bytes, bytes]] = []
            for at, piece in _pieces(data, window, shard_bytes):
                own[at : at + len(piece)] |= repeated_starts(piece, window)
                _, _, least, body, _ = runs(piece, window, gram)
                least, body = entries(least, body)
                cuts = cut_ranges(least, bits)
                for r in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(cuts[r], cuts[r + 1])
                    lists.append((r, least[part].tobytes(), body[part].tobytes()))
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": [shard] * (1 + len(lists)),
                    "slot": pa.array([-1, *(r for r, _, _ in lists)], pa.int32()),
                    "keys": pa.array([None, *(k for _, k, _ in lists)], pa.binary()),
                    "more": pa.array([None, *(m for _, _, m in lists)], pa.binary()),
                    "rows": pa.array([_pack(table), *[None] * len(lists)], pa.binary()),
                    "own": pa.array([_zip(np.packbits(own).tobytes()), *[None] * len(lists)], pa.binary()),
                }
            )

    first = common.write_table(df.mapInArrow(build, f"{_LIST}, rows binary, own binary"), "shards")
    shards = first.where("slot < 0").select("shard", "rows", "own")
    lists = first.where("slot >= 0").select("shard", "slot", "keys", "more")

    def meet_runs(group: pa.Table) -> pa.Table:
        shard = group.column("shard").to_pylist()
        keys = [np.frombuffer(x, _U) for x in group.column("keys").to_pylist()]
        more = np.concatenate([np.frombuffer(x, _U) for x in group.column("more").to_pylist()])
        merged, place = merge_sorted(keys)
        flags = np.zeros(len(merged), np.uint8)
        flags[place] = judge_runs(merged, more[place])
        ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        out = []
        for i, s in enumerate(shard):
            f = flags[ends[i] : ends[i + 1]]
            hit = np.flatnonzero(f)
            if len(hit):
                out.append((s, keys[i][hit].tobytes() + more[ends[i] : ends[i + 1]][hit].tobytes() + f[hit].tobytes()))
        return pa.table({"shard": pa.array([x[0] for x in out], pa.int64()), "verdict": pa.array([x[1] for x in out], pa.binary())})

    verdicts = common.write_table(lists.groupBy("slot").applyInArrow(meet_runs, "shard long, verdict binary"), "verdicts")

    def open_shard(group: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        table = _unpack(group.column("rows")[0].as_py())
        data = _joined(common.text_bytes(table.column(text).combine_chunks()))
        own = np.unpackbits(np.frombuffer(_unzip(group.column("own")[0].as_py()), np.uint8), count=len(data)).astype(bool)
        return table, data, own

    def judged(verdict: pa.Table, data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, Hashes]]]:
        """By piece: its place, its runs, their flags, and its bytes with their hashes."""
        parts = [(x, len(x) // 17) for x in verdict.column("verdict").to_pylist()]
        if not parts:
            return
        g, b = (np.concatenate([np.frombuffer(x, _U, n, o * n * 8) for x, n in parts]) for o in (0, 1))
        f = np.concatenate([np.frombuffer(x, np.uint8, n, 16 * n) for x, n in parts])
        # both hashes are uniform, so their sum names a run as well as the pair does; pieces' verdicts on one are the same
        # but for SENDS, which any piece may do
        several = np.unique(g[b == SEVERAL])
        key, inverse = np.unique(g * _U(3) + b, return_inverse=True)
        flag = np.zeros(len(key), np.uint8)
        np.bitwise_or.at(flag, inverse, f)
        for at, piece in _pieces(data, window, shard_bytes):
            start, past, least, body, hashes = runs(piece, window, gram)
            mine = least * _U(3) + body
            place = np.minimum(np.searchsorted(key, mine), len(key) - 1)
            flags = np.where(key[place] == mine, flag[place], 0)
            flags[np.isin(least, several)] |= SENDS
            yield at, start, past, flags, (piece, hashes)

    def spread(start: np.ndarray, past: np.ndarray, n: int) -> np.ndarray:
        return np.cumsum(np.bincount(start, minlength=n + 1)[:n] - np.bincount(past, minlength=n + 1)[:n]) > 0

    def sent(start: np.ndarray, past: np.ndarray, flags: np.ndarray, piece: tuple[np.ndarray, Hashes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of a piece's runs that send, with two hashes of each."""
        chosen = (flags & SENDS) > 0
        at = np.flatnonzero(spread(start[chosen], past[chosen], int(past.max(initial=0))))
        if not len(at):
            return at, np.zeros(0, _U), np.zeros(0, np.uint32)
        key, more = (h.of(at, at + window) for h in (piece[1], Hashes(piece[0], _ODD_TOO)))
        return at, key, (more >> _U(32)).astype(np.uint32)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            _, data, _ = open_shard(left)
            shard = left.column("shard")[0].as_py()
            for _, start, past, flags, piece in judged(right, data):
                _, key, more = sent(start, past, flags, piece)
                by = _sorted_distinct(key, more)
                key, more = key[by], more[by]
                cuts = cut_ranges(key, bits)
                for r in np.flatnonzero(np.diff(cuts)).tolist():
                    part = slice(cuts[r], cuts[r + 1])
                    out.append((shard, r, key[part].tobytes(), more[part].tobytes()))
        return pa.table(
            {
                "shard": pa.array([x[0] for x in out], pa.int64()),
                "slot": pa.array([x[1] for x in out], pa.int32()),
                "keys": pa.array([x[2] for x in out], pa.binary()),
                "more": pa.array([x[3] for x in out], pa.binary()),
            }
        )

    edges = shards.groupBy("shard").cogroup(verdicts.groupBy("shard")).applyInArrow(send, _LIST)

    def meet_windows(group: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, _U) for x in group.column("keys").to_pylist()]
        more = [np.frombuffer(x, np.uint32) for x in group.column("more").to_pylist()]
        merged, place = merge_sorted(keys)
        hit = np.zeros(len(merged), bool)
        hit[place] = judge_windows(merged, np.concatenate(more)[place])
        ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        found = [hit[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        out = [(s, k[h].tobytes() + m[h].tobytes()) for s, k, m, h in zip(group.column("shard").to_pylist(), keys, more, found, strict=True) if h.any()]
        return pa.table({"shard": pa.array([x[0] for x in out], pa.int64()), "window": pa.array([x[1] for x in out], pa.binary())})

    common.free_shuffles(spark)
    windows = common.write_table(edges.groupBy("slot").applyInArrow(meet_windows, "shard long, window binary"), "windows")
    common.free_shuffles(spark)
    back = verdicts.select("shard", "verdict", F.lit(None).cast("binary").alias("window")).unionByName(
        windows.select("shard", F.lit(None).cast("binary").alias("verdict"), "window")
    )
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    out_schema = common.added(
        schema,
        [
            T.StructField("kept", T.BinaryType()),
            T.StructField("kept_text", T.StringType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("n_spans", T.LongType()),
            T.StructField("removed", span),
        ],
    )
    new = {"kept", "kept_text", "n_bytes", "n_removed", "n_spans", "removed"}

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        table, data, repeated = open_shard(left)
        if right.num_rows:
            parts = [(x, len(x) // 12) for x in right.filter(right.column("window").is_valid()).column("window").to_pylist()]
            some = np.concatenate([np.zeros(0, _U), *(np.frombuffer(x, _U, n) for x, n in parts)])
            more = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32, n, 8 * n) for x, n in parts)])
            by = _sorted_distinct(some, more)
            some, more = some[by], more[by]
            for at, start, past, flags, piece in judged(right.filter(right.column("verdict").is_valid()), data):
                full = (flags & REPEATED) > 0
                n = int(past.max(initial=0))
                repeated[at : at + n] |= spread(start[full], past[full], n)
                if len(some):
                    place, key, second = sent(start, past, flags, piece)
                    repeated[at + place[held_in(key, second, some, more)]] = True
        cols: dict[str, list] = {k: [] for k in ("kept", "kept_text", "n_bytes", "n_removed", "n_spans", "removed")}
        at = 0
        for size in np.diff(np.concatenate([[-1], np.flatnonzero(data == SEPARATOR)])).tolist():
            body = data[at : at + size - 1].tobytes()
            spans = covered(np.flatnonzero(repeated[at : at + size - 1]), window)
            gaps = zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(body)], strict=True)
            cols["kept"].append(b"".join(body[a:b] for a, b in gaps))
            cols["kept_text"].append(whole_characters(body, spans))
            cols["n_bytes"].append(len(body))
            cols["n_removed"].append(sum(b - a for a, b in spans))
            cols["n_spans"].append(len(spans))
            cols["removed"].append([{"start": a, "end": b} for a, b in spans])
            at += size
        out = {f.name: table.column(f.name) for f in out_schema.fields if f.name not in new}
        types = {"kept": pa.binary(), "kept_text": pa.string(), "removed": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
        return pa.table(out | {k: pa.array(v, types.get(k, pa.int64())) for k, v in cols.items()})

    return shards.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(finish, out_schema)


def covered(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows at ``starts`` (ascending) cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window) + 1
    return list(zip(starts[np.concatenate([[0], cut])].tolist(), (starts[np.concatenate([cut - 1, [len(starts) - 1]])] + window).tolist(), strict=True))


def whole_characters(body: bytes, spans: list[tuple[int, int]]) -> str:
    """``body`` without ``spans``, each drawn in so that no character is cut."""
    out, at = [], 0
    for a, b in spans:
        while a < b and body[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
            b -= 1
        out.append(body[at:a])
        at = b
    return b"".join([*out, body[at:]]).decode("utf-8", "replace")


def _zip(x: bytes) -> bytes:
    import zstandard

    return zstandard.compress(x, 1)


def _unzip(x: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(x)


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns of ``remove_repeats``."""
    return remove_repeats(df.select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
