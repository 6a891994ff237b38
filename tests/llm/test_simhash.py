import random
import re
from collections import Counter

import numpy as np
import xxhash

from palisade.llm import simhash as S
from palisade.llm.components import components


def slow_fingerprint(text, k=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, d=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        r = find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))]


def texts(seed=1, n=150):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Ä", "ÉcOle", "X\x0by", "a\x1cb", " ", "日本"]
    out = []
    for _ in range(n):
        if out and r.random() < 0.5:
            w = r.choice(out).split(" ")
            w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
        else:
            out.append(" ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 4, 5, 40, 300]))))
    return out + ["", None, " \t\n", out[3], out[3].upper()]


def test_against_brute_force(spark):
    docs = texts()
    ids = [1000 - 3 * i for i in range(len(docs))]
    df = spark.createDataFrame(list(zip(ids, docs, docs)), "doc_id long, text string, fp string").repartition(3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.digest(df).collect()}
    fps = [slow_fingerprint(t) for t in docs]
    want = slow_components(ids, fps)
    assert got == {i: (f"{f:016x}", c) for i, f, c in zip(ids, fps, want)}
    kept = S.keep_first(df, S.near_groups(df)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want))


def test_every_close_pair_shares_a_key():
    r = random.Random(0)
    for n in (10, 10**5, 10**7, 10**10, 10**13):
        masks = S.block_masks(n, 4)
        for _ in range(200):
            x = r.getrandbits(64)
            y = x
            for b in r.sample(range(64), 4):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


def test_forest_spans_all_links():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 5, dtype=np.uint64)
    fp = np.unique(np.concatenate([base[:, None] ^ (np.uint64(1) << r.integers(0, 64, (5, 40), dtype=np.uint64)), base[:, None]], axis=None))
    edges = S.forest(fp, 4)
    assert len({a for a, _ in edges}) == len(edges)
    got = {}
    for a, b in edges:
        got[a] = b
    want = slow_components([int(x) for x in fp], [int(x) for x in fp])
    assert [got.get(int(x), int(x)) for x in fp] == want


def test_components_of_chains_and_stars(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(7000, 7000)]
    r.shuffle(edges)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(80)) and 7000 not in got


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.digest(empty).collect() == []
    rows = S.digest(spark.createDataFrame([(None, "a b"), (None, "a b"), (4, "c"), (4, "c"), (9, None)], "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in rows) == Counter({(None, None): 2, (4, 4): 2, (9, 9): 1})
    df = spark.createDataFrame([(4, "c"), (4, "c"), (None, "a"), (None, "a"), (5, "c"), (None, "c"), (4, "z z"), (6, "z z")], "doc_id long, text string")
    for groups in (S.near_groups(df), S.similar_groups(df)):
        kept = S.keep_first(df, groups).collect()
        assert sorted(((r.doc_id or 0), r.text) for r in kept) == [(0, "a"), (4, "c"), (4, "z z")]


def test_similar_groups_catch_near_copies(spark):
    r = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    base = [[r.choice(words) for _ in range(r.randrange(60, 400))] for _ in range(60)]
    docs, want = [], []
    for i, w in enumerate(base):
        docs.append(w), want.append(i)
        for share in (0.0, 0.005, 0.01):  # of the words changed: similarity above 0.9
            c = list(w)
            for _ in range(int(len(c) * share)):
                c[r.randrange(len(c))] = r.choice(words)
            docs.append(c), want.append(i)
        half = w[: len(w) // 2] + [r.choice(words) for _ in range(len(w) // 2)]  # similarity of a third
        docs.append(half), want.append(1000 + i)
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)] + [(900, None), (901, ""), (None, "x")], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in S.similar_groups(df).collect()}
    found = sum(got[i] == got[j] for i in range(len(docs)) for j in range(i) if want[i] == want[j])
    assert found >= 0.97 * sum(want[i] == want[j] for i in range(len(docs)) for j in range(i))
    assert not any(got[i] == got[j] for i in range(len(docs)) for j in range(i) if want[i] != want[j])
    assert got[900] == got[901] == 900
    assert S.similar_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def edited(r, w, kind, similarity):
    """A copy of the words with its tail cut off or new words appended, of about that shingle similarity and not below it."""
    m = len(w) - 4
    if kind == "truncated":
        return w[: -(-int(m * similarity * 1000) // 1000) + 5]
    return w + [f"n{r.randrange(3000)}" for _ in range(int(m * (1 / similarity - 1)))]


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b))
    return len(a & b) / len(a | b)


def edited_pairs(similarity, each=60):
    r = random.Random(21)
    base = [[f"w{r.randrange(3000)}" for _ in range(r.randrange(60, 400))] for _ in range(each)]
    return [(w, edited(r, w, kind, similarity)) for kind in ("truncated", "appended") for w in base]


def linked(spark, pairs):
    """Share of the pairs whose documents are in one component; every pair's words are its own."""
    docs = [(2 * i + j, " ".join(f"{x}p{i}" for x in w)) for i, pair in enumerate(pairs) for j, w in enumerate(pair)]
    got = {x.doc_id: x.component_id for x in S.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    return sum(got[2 * i] == got[2 * i + 1] for i in range(len(pairs))) / len(pairs)


def test_copies_cut_or_extended_share_a_key():
    for similarity in (0.8, 0.85, 0.9, 0.95):
        pairs = edited_pairs(similarity)
        assert all(similarity <= jaccard(*p) < similarity + 0.03 for p in pairs)
        keys = [[set(S.bands(S.shingle_hashes(" ".join(w).encode()))) for w in p] for p in pairs]
        assert sum(bool(a & b) for a, b in keys) >= 0.98 * len(pairs)
    assert S.bands(S.shingle_hashes(b" ")) == []


def test_copies_cut_or_extended_are_grouped(spark):
    for similarity in (0.9, 0.95):
        assert linked(spark, edited_pairs(similarity)) >= 0.93


def test_exact_similarity_decides(spark):
    for similarity in (0.8, 0.83, 0.87):
        assert linked(spark, edited_pairs(similarity)) >= 0.98
    below = [p for s in (0.75, 0.78) for p in edited_pairs(s) if jaccard(*p) < 0.8]
    assert len(below) > 200 and linked(spark, below) == 0


def test_trees_against_all_pairs():
    r = np.random.default_rng(8)
    base = [np.arange(1000 * i, 1000 * i + 200) for i in range(4)]
    sets = [np.unique(np.concatenate([b[: r.integers(150, 200)], r.integers(9000, 9100, r.integers(0, 40))])).astype("<u4") for b in base for _ in range(25)]
    node = [int(x) for x in r.permutation(len(sets)) - 50]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            a_, b_ = set(a.tolist()), set(b.tolist())
            if len(a_ & b_) / len(a_ | b_) >= 0.8:
                root = [root[j] if x == root[i] else x for x in root]
    found = dict(S.trees(node, sets))
    got = [found.get(n, n) for n in node]
    assert len(set(root)) > 3
    assert all((got[i] == got[j]) == (root[i] == root[j]) for i in range(len(sets)) for j in range(i))
