import base64
import hashlib
import random
import time

import pytest

from palisade.llm import bpe as B

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_text(r, n):
    parts = ["the", "'ll", "'", "l", "'re", " ", "  ", "\n", "\n\n", "é", "日本", "123", "%%", " ", "x" * 9, "<|endoftext|>", "\U0001f600", "\t", "don't", "\x1c", "\x85", "abc" * 7]
    return "".join(r.choice(parts) for _ in range(n))


def test_trees_agree_with_the_library(library, monkeypatch):
    r = random.Random(2)
    bpe = B.Bpe(PATH, public.PATTERN)
    for leaf_chars, leaf_bytes in ((1 << 14, 24), (8, 2), (1, 1), (3, 5)):
        monkeypatch.setattr(B, "LEAF_CHARS", leaf_chars)
        monkeypatch.setattr(B, "LEAF_BYTES", leaf_bytes)
        bpe.known.clear()
        for _ in range(150):
            t = random_text(r, r.randrange(0, 40))
            ids = bpe.encode(t)
            assert ids == library.encode_ordinary(t)
            assert bpe.decode(ids) == t.encode()


def test_long_pieces(library):
    r = random.Random(3)
    bpe = B.Bpe(PATH, public.PATTERN)
    for t in ("a" * 5000, "".join(r.choice("abcdeé") for _ in range(4000)), " " * 3000 + "x", "ab" * 2500, "=" * 4001):
        assert bpe.encode(t) == library.encode_ordinary(t)


def test_very_long_pieces(library):
    """A quarter of a megabyte in one match: runs, runs whose tokens don't end at powers of two, periods, and random letters."""
    r = random.Random(4)
    bpe = B.Bpe(PATH, public.PATTERN)
    mega = 1 << 18
    letters = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(mega))
    for t in ("=" * mega, "a" * (mega - 7), " " + "-" * mega, "\u2500" * (mega // 3), "=-" * (mega // 2), letters, "A" * 1000 + letters[:100_000], " " * 10_000):
        began = time.perf_counter()
        assert bpe.encode(t) == library.encode_ordinary(t)
        assert time.perf_counter() - began < 30


def test_heap_agrees_with_search(monkeypatch):
    r = random.Random(6)
    bpe = B.Bpe(PATH, public.PATTERN)
    monkeypatch.setattr(B, "HEAP_BYTES", 1 << 30)
    for _ in range(600):
        data = "".join(r.choice(["a", "b", "e", " ", "the", "=", "é", "ing"]) for _ in range(r.randrange(1, 70))).encode()
        assert bpe.merge_long(data) == bpe.merge(data)


def test_all_characters(library):
    bpe = B.Bpe(PATH, public.PATTERN)
    # characters that newer Unicode data than the library's may class otherwise are left out by their age
    for at in range(1, 0x3000, 64):
        t = "a".join(chr(c) for c in range(at, at + 64))
        assert bpe.encode(t) == library.encode_ordinary(t), hex(at)


def test_query(spark, library):
    texts = ["", None, "hello world", "it's " * 9000, "hello world"]
    rows = {r.doc_id: r for r in B.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, public.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    df = spark.createDataFrame([(1, "ab cd", 7), (2, None, 8)], "doc_id long, text string, ids int")
    back = B.decode_column(B.encode_column(df, PATH, public.PATTERN), PATH, public.PATTERN).collect()
    assert [bytes(r.decoded) for r in sorted(back)] == [b"ab cd", b""]
    assert B.digest(spark.createDataFrame([], "doc_id long, text string"), PATH, public.PATTERN).collect() == []
