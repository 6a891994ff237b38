"""SimHash fingerprints and near-duplicate groups by pigeonhole blocks.

The 64 bits are split into ``b`` blocks.  Two fingerprints that differ in at most ``distance`` bits agree in at least
``b - distance`` whole blocks, so each choice of that many blocks is a join key and every close pair meets under
one of them.  ``b`` grows with the number of distinct fingerprints, so that a key has more values than there are
fingerprints and chance meetings stay few at any size; every choice is exact.

Equal fingerprints are one node from the start, however many documents have them.  Fingerprints that meet under a key
are compared by XOR and popcount.  A key's large group is searched breadth first (reached fingerprints leave the
search), and only a spanning forest leaves it, so a group of copies costs neither pairs of rows nor their square.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

SEED = 42
_CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of a text's word shingles: ASCII case folded, words split at ASCII space, repeats counted.

    A text of fewer words is one shingle; a text without words has fingerprint 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    first = [0, *ends[: n - 1]]
    last = ends[len(words) - n :]
    for at in range(0, n, _CHUNK):
        h = [digest(body[a : b - 1], SEED) for a, b in zip(first[at : at + _CHUNK], last[at : at + _CHUNK], strict=True)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int((np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))[2 * ones > n]).sum(dtype=np.uint64))


def fingerprints(df: DataFrame, keys: list[str], text: str = "text", shingle: int = 4) -> DataFrame:
    """``keys`` of ``df`` and ``fp`` (long, the fingerprint's bits)."""
    fields = [df.schema[k] for k in keys]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("fingerprints")
        for batch in common.batches_up_to(batches, 1000):
            fp = np.array([fingerprint(t, shingle) for t in common.text_bytes(batch.column(text))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(fp)], [*keys, "fp"])

    from pyspark.sql import types as T

    return df.select(*keys, text).mapInArrow(compute, T.StructType([*fields, T.StructField("fp", T.LongType())]))


def block_masks(n: int, distance: int) -> list[int]:
    """Key masks for ``n`` distinct fingerprints: the fewest whose keys have about four times as many values."""
    need = math.log2(max(n, 1)) + 2
    blocks = distance + 1
    while (64 // blocks) * (blocks - distance) < need and blocks < distance + 4:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(each, blocks - distance)]


_CELLS = 1 << 20  # comparisons at once


def spanning(n: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``n`` members: (member, first of its tree).

    ``near(rest, some)`` tells which of ``rest`` link to any of ``some``.  Breadth first: members that are reached leave the rest,
    and as many reached ones at once look for the rest as there is room to compare.
    """
    out: list[tuple[int, int]] = []
    rest = np.arange(n)
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        frontier = np.array([root])
        while len(frontier) and len(rest):
            k = max(1, _CELLS // len(rest))
            some, frontier = frontier[:k], frontier[k:]
            hit = near(rest, some)
            if hit.any():
                reached, rest = rest[hit], rest[~hit]
                frontier = np.concatenate([frontier, reached])
                out += zip(reached.tolist(), itertools.repeat(int(root)), strict=False)
    return out


def forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints: (member, smallest of its tree)."""
    fp = np.sort(fp)
    found = spanning(len(fp), lambda rest, some: (np.bitwise_count(fp[rest][None, :] ^ fp[some][:, None]) <= distance).any(axis=0))
    return [(int(fp[a]), int(fp[b])) for a, b in found]


def links(nodes: DataFrame, n: int, distance: int) -> DataFrame:
    """Edges (u, v) among the distinct fingerprints ``fp`` of ``nodes``, enough to connect every close pair."""
    masks = block_masks(n, distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    dealt = nodes.select("fp", F.explode(keys).alias("k")).select("k.mask", "k.key", "fp")
    dealt = dealt.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[np.ndarray] = []  # of the key that the last batch ended with
        last = None
        for batch in batches:
            mask, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = fp.astype(np.int64).view(np.uint64)
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            begin = np.concatenate([[0], cut])
            end = np.concatenate([cut, [len(fp)]])
            found: list[tuple[int, int]] = []
            if last is not None and (mask[0], key[0]) != last:
                found += forest(np.concatenate(open_), distance)
                open_ = []
            if len(begin) > 1:
                if open_:
                    found += forest(np.concatenate([*open_, fp[: end[0]]]), distance)
                    begin, end = begin[1:], end[1:]
                for a, b in zip(begin[:-1].tolist(), end[:-1].tolist(), strict=True):
                    if b - a == 2:
                        x, y = fp[a], fp[a + 1]
                        if np.bitwise_count(x ^ y) <= distance:
                            found.append((int(max(x, y)), int(min(x, y))))
                    elif b - a > 2:
                        found += forest(fp[a:b], distance)
                open_ = [fp[begin[-1] :]]
            else:
                open_.append(fp)
            last = (mask[-1], key[-1])
            if found:
                yield _edges(found)
        if open_ and (found := forest(np.concatenate(open_), distance)):
            yield _edges(found)

    return dealt.mapInArrow(meet, "u long, v long")


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])


KEYS = ["_h1", "_h2"]


def row_keys(df: DataFrame, id_: str, text: str) -> DataFrame:
    """``id_``, ``text`` and two hashes of both, which name a row but for equal rows."""
    return df.select(F.col(id_), F.col(text), F.xxhash64(id_, text).alias("_h1"), F.xxhash64(text, id_).alias("_h2"))


def near_groups(df: DataFrame, id_: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row per row of ``df``: ``id_``, ``fp`` (long), ``component_id``, the smallest id that links reach, the component's
    ``root`` and the row's KEYS.

    Rows whose fingerprints differ in at most ``distance`` bits are linked; links chain.  A null text is the empty
    text; texts without words have fingerprint 0 and are linked like any other.  Equal rows stay separate rows of one
    component; a component whose ids are all null has the id null; an empty table gives an empty table.
    """
    marked = common.write_table(fingerprints(row_keys(df, id_, text), [id_, *KEYS], text, shingle), "fingerprints")
    nodes = _nodes(marked, "fp", id_)
    return _named(marked, nodes, "fp", id_, lambda n: components(links(nodes.select("fp"), n, distance)))


def _nodes(marked: DataFrame, key: str, id_: str) -> DataFrame:
    """``key``, its smallest id and its number of rows."""
    return common.write_table(marked.groupBy(key).agg(F.min(id_).alias("least"), F.count("*").alias("n")), "nodes")


def _named(marked: DataFrame, nodes: DataFrame, key: str, id_: str, link: Callable[[int], DataFrame]) -> DataFrame:
    """Rows with the components of their nodes; ``link(number of nodes)`` gives those of the nodes that have links.

    The rows of a node and the nodes of a component may be many: sizes are counted first, and large ones are not gathered.
    """
    size = nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    linked = link(size["nodes"])
    roots = linked.withColumnRenamed("node", "_node")
    rooted = nodes.join(roots, F.col(key) == F.col("_node"), "left").select(key, "least", F.coalesce("root", key).alias("root"), F.col("n").alias("_n"))
    rooted = common.write_table(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = common.write_table(common.attach(rooted, least, "root", size["nodes"]).select(key, "component_id", "root", F.col("_n").alias("n")), "named")
    for done in (linked, nodes, rooted):
        common.drop_table(done)
    return common.attach(marked, named, key, size["rows"]).select(id_, key, "component_id", "root", *KEYS)


def hex16(column):
    """Sixteen lowercase hex digits of a long's bits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns of ``near_groups``."""
    return near_groups(df).select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- similarity of shingle sets

#: Smallest hashes of a key, and number of keys.  Two sets share a smallest hash with the chance of their Jaccard similarity, however
#: they came to differ and however many documents there are: at 0.8, all keys are missed with a chance of (1 - 0.8**6)**20 = 0.002.
MINIMA, BANDS = 6, 20


def _odd(seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed) | 1 for i in range(MINIMA * BANDS)], np.uint64)[:, None]


_SALT, _FACTOR = _odd(1), _odd(2)


def shingle_hashes(text: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """Keys (signed 64 bits) of a set of shingles; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(MINIMA * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[at : at + 1024] ^ _SALT) * _FACTOR).min(axis=1), out=least)
    raw, size = least.tobytes(), 8 * MINIMA
    return np.array([xxhash.xxh64_intdigest(raw[size * j : size * (j + 1)], j) for j in range(BANDS)], np.uint64).view(np.int64).tolist()


def alike(common_: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of ``a`` and ``b`` members, ``common_`` of them common, have a Jaccard similarity of 0.8 or more."""
    return 5 * common_ >= 4 * (a + b - common_)


def trees(node: list, sets: list[np.ndarray]) -> list[tuple]:
    """Spanning forest of the links among ``node``, by the exact similarity of their sets (sorted, distinct)."""
    if len(node) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [(node[1], node[0])] if alike(both, *map(len, sets)) else []
    size = np.array([len(x) for x in sets])
    start = np.cumsum(size) - size
    names, code = np.unique(np.concatenate(sets), return_inverse=True)
    code = code.astype(np.int32)
    marked = np.zeros(len(names), bool)

    def near(rest: np.ndarray, some: np.ndarray) -> np.ndarray:
        begin = np.cumsum(size[rest]) - size[rest]
        theirs = code[np.arange(size[rest].sum()) + np.repeat(start[rest] - begin, size[rest])]
        hit = np.zeros(len(rest), bool)
        for i in some:
            own = code[start[i] : start[i] + size[i]]
            marked[own] = True
            hit |= alike(np.add.reduceat(marked[theirs], begin, dtype=np.int64), size[rest], size[i])
            marked[own] = False
        return hit

    return [(node[a], node[b]) for a, b in spanning(len(node), near)]


def similar_groups(df: DataFrame, id_: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """``id_``, ``node``, ``component_id``, ``root`` and KEYS of every row; rows of shingle similarity 0.8 or more are linked.

    Equal sets of shingles are one node.  Keys of the smallest hashes bring candidates together, and the exact Jaccard similarity of
    the sets (of 32-bit hashes) decides.  Only nodes that meet others are dealt with their sets, and to one key of those that have
    the same nodes.  A node's name is a hash of 128 bits of its shingles' hashes.  Nulls, empty texts, equal rows and empty tables
    are treated as in ``near_groups``.
    """
    keyed = row_keys(df, id_, text)
    fields = [keyed.schema[c] for c in (id_, *KEYS)]
    from pyspark.sql import types as T

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("fingerprints")
        for batch in common.batches_up_to(batches, 1000):
            found = [shingle_hashes(t, shingle) for t in common.text_bytes(batch.column(text))]
            node = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in found], pa.binary())
            keys = pa.array(list(map(bands, found)), pa.list_(pa.int64()))
            sets = pa.array([np.unique((h >> np.uint64(32)).astype("<u4")).tobytes() for h in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (id_, *KEYS)), node, keys, sets], [id_, *KEYS, "node", "bands", "hashes"])

    schema = T.StructType([*fields, T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("hashes", T.BinaryType())])
    marked = common.write_table(keyed.mapInArrow(sign, schema), "shingles")
    met = marked.select("node", "bands").distinct().select(F.explode("bands").alias("key"), "node")
    members = F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
    chosen = met.groupBy("key").agg(*members).where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    places = met.join(chosen, "key").withColumnRenamed("node", "_node")
    sets = marked.groupBy("node").agg(F.first("hashes").alias("hashes"))
    dealt = places.join(sets, F.col("_node") == F.col("node")).select("key", "node", "hashes").repartition("key").sortWithinPartitions("key", "node")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, sets = None, [], []
        for batch in common.batches_up_to(batches, 1000):
            found: list[tuple[int, int]] = []
            for key, node, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "hashes")), strict=True):
                if key != last:
                    if len(nodes) > 1:
                        found += trees(nodes, sets)
                    last, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(np.frombuffer(raw, "<u4"))
            if found:
                yield _pairs(found)
        if len(nodes) > 1 and (found := trees(nodes, sets)):
            yield _pairs(found)

    rows = marked.select(id_, *KEYS, "node")
    return _named(rows, _nodes(rows, "node", id_), "node", id_, lambda n: components(dealt.mapInArrow(meet, "u binary, v binary")))


def _pairs(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["u", "v"])


def keep_first(df: DataFrame, groups: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each component of ``groups``: the one of smallest id, null ids last; of equal ids and of
    equal rows one.

    Equal rows are reduced to one first, within each task before any are shuffled; the texts are shuffled once, to meet
    the chosen rows' keys.
    """
    order = F.struct(F.col(id_).isNull(), F.col(id_), *KEYS)
    chosen = groups.groupBy("root").agg(F.min(order).alias("row")).select(*[F.col(f"row.{k}").alias(f"{k}_") for k in KEYS])
    keyed = df.withColumns({"_h1": F.xxhash64(id_, text), "_h2": F.xxhash64(text, id_)})
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy("_h1"))
    single = keyed.withColumn("_place", place).where("_place = 1")
    kept = single.join(chosen, (F.col("_h1") == F.col("_h1_")) & (F.col("_h2") == F.col("_h2_")), "left_semi")
    return kept.select(*df.columns)
