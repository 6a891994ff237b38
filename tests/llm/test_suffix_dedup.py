import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from palisade.llm import suffix_dedup as S


def brute(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in data for i in range(len(b) - window + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["ab", "the", "é", "über", "x", "lorem", "\n", "日本"]
    prose = lambda k: " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(k))
    shared = [prose(60) for _ in range(4)]
    docs = []
    for _ in range(n):
        parts = [prose(r.randrange(0, 60))]
        for _ in range(r.randrange(0, 3)):
            s = r.choice(shared)
            a = r.randrange(0, len(s) // 2)
            parts += [s[a : a + r.randrange(20, len(s))], prose(r.randrange(0, 20))]
        docs.append("".join(parts))
    docs += [docs[0], docs[0], "", None, "a" * 5000, "a" * 199, "a" * 200, "é" * 150, "xé" + "é" * 150]
    return docs


@pytest.mark.parametrize("shard", [1, 3000, 10_000_000])
@pytest.mark.parametrize("window,gram", [(200, 64), (40, 16)])
def test_matches_brute_force(spark, shard, window, gram):
    docs = corpus(window)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    rows = S.remove_repeats(df, window=window, gram=gram, shard_bytes=shard).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows}
    assert [got[i] for i in range(len(docs))] == brute(docs, window)
    for r in rows:
        assert (r.kept_text or "") in (docs[r.doc_id] or "") or r.n_spans
        assert "�" not in r.kept_text


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "doc_id long, text string, kept string, n_bytes int, slot int, shard int")
    out = S.remove_repeats(df)
    assert out.collect() == [] and out.columns.count("kept") == 1
    df = spark.createDataFrame([(1, "q" * 300, 5, None), (None, "q" * 300, 6, 7)], "doc_id long, text string, shard int, n_bytes int")
    assert {(r.doc_id, r.n_removed, r.shard) for r in S.remove_repeats(df).collect()} == {(1, 300, 5), (None, 300, 6)}


def test_suffix_order_and_prefixes():
    r = np.random.default_rng(3)
    text = r.integers(97, 99, 700).astype(np.uint8)
    text[300:500] = text[100:300]
    order = S.suffix_order(text)
    b = text.tobytes()
    assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    lcp = S.common_prefixes(text, order, 400, lanes=7)
    for a, c in zip(order, order[1:]):
        k = 0
        while k < 400 and c + k < len(b) and a + k < len(b) and b[a + k] == b[c + k]:
            k += 1
        assert lcp[c] == k


def test_merge_is_by_order():
    r = np.random.default_rng(1)
    lists = [np.sort(r.integers(0, 50, n).astype(np.uint64)) for n in (5, 0, 9, 3, 20)]
    keys, place = S.merge_sorted(lists)
    assert (np.concatenate(lists)[place] == keys).all() and (np.diff(keys.astype(int)) >= 0).all()


def test_common_lines_in_various_surroundings(spark):
    """A line of 109 bytes and one of 230 in nearly all documents: one entry a shard, and the right bytes go."""
    r = random.Random(17)
    line = "".join(r.choice("abcdefgh ") for _ in range(109))
    long_line = "".join(r.choice("abcdefgh ") for _ in range(230))
    body = lambda: "".join(r.choice("ijklmnop ") for _ in range(r.randrange(100, 300)))
    docs = [f"{body()}\n{line}\n{body()}" + (f"\n{long_line}\n{body()}" if i % 3 == 0 else "") for i in range(150)] + ["x" + long_line, long_line]
    data = S._joined([d.encode() for d in docs])
    _, _, least, bodies, _ = S.runs(data, 200, 64)
    gram, body_of = S.entries(least, bodies)
    assert len(gram) == len(set(gram.tolist())) and (np.diff(gram.astype(object)) > 0).all()
    _, count = np.unique(least, return_counts=True)
    assert count.max() > 100 and np.count_nonzero(body_of == S.SEVERAL) >= 1
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    for shard in (2000, 20_000):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(df, shard_bytes=shard).selectExpr("*", "sha2(kept, 256) kept_sha256").collect()}
        assert [got[i] for i in range(len(docs))] == brute(docs, 200)


def test_judgements():
    u = lambda *x: np.array(x, np.uint64)
    flags = S.judge_runs(u(1, 2, 2, 3, 3, 3, 4, 4, 5, 5), u(7, 8, 8, 5, 6, 6, S.SEVERAL, S.SEVERAL, S.SEVERAL, 9))
    assert flags.tolist() == [0, S.REPEATED, S.REPEATED, S.SENDS, S.REPEATED | S.SENDS, S.REPEATED, S.SENDS, S.SENDS, S.SENDS, S.SENDS]
    more = np.array([1, 2, 1, 5, 6, 9], np.uint32)
    assert S.judge_windows(u(3, 3, 3, 4, 4, 5), more).tolist() == [True, False, True, False, False, False]
    assert S.held_in(u(3, 3, 4, 9), np.array([2, 7, 5, 1], np.uint32), u(3, 3, 4), np.array([1, 2, 6], np.uint32)).tolist() == [True, False, False, False]
    assert S.judge_runs(u(), u()).tolist() == [] and S.judge_windows(u(), np.zeros(0, np.uint32)).tolist() == []


def test_ranges_are_even():
    r = np.random.default_rng(5)
    text = r.integers(97, 123, 400_000).astype(np.uint8)
    _, _, least, body, _ = S.runs(text, 200, 64)
    for keys in (least, body):
        sizes = np.diff(S.cut_ranges(np.sort(keys), 4))
        assert sizes.max() < 1.3 * sizes.mean()
