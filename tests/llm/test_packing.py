import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from palisade.llm import packing as P

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


TOKENIZER = tokenizers.Tokenizer.from_file(PATH)


def reference_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def docs():
    r = random.Random(4)
    words = ["Hello", "it's", "we'll", "über", "ÀÉ", "é", "1234", "x=1;", "<|endoftext|>", "a<|endoftext|>b", "<|startoftext|>é", "<|EndOfText|>", "<|", "日本語", "a\x1cb", "a b", " ", "''", "'s", "ſ", "İ", "́"]
    out = ["".join(r.choice(words) + r.choice([" ", "  ", "\n", "\t", "", "\x0b", "\x1d"]) for _ in range(r.randrange(0, 60))) for _ in range(120)]
    return out + ["", None, "word " * 5000, "x" * 3000, out[0], out[0]]


def check(rows, texts, size):
    ids = {i: reference_ids(t) for i, t in enumerate(texts)}
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
    for i, want in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(want)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want)
    padding = 0
    for ps in by_window.values():
        at = 0
        for r in sorted(ps, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


@pytest.mark.parametrize("group", [1 << 25, 3000])
def test_pieces_cover_documents_and_windows(spark, group):
    texts = docs()
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(2)
    rows = P.pack(df, PATH, size=2048, group=group).collect()
    assert check(rows, texts, 2048) == 0


def test_lengths_property():
    r = random.Random(9)
    for size in (8, 64, 2048):
        for _ in range(30):
            lengths = [r.choice([1, 2, size - 1, size, size + 1, r.randrange(1, 3 * size)]) for _ in range(r.randrange(1, 80))]
            pieces = P.pack_lengths(lengths, size)
            fill = defaultdict(int)
            for _, _, n, w, o in sorted(pieces, key=lambda p: (p[3], p[4])):
                assert fill[w] == o
                fill[w] += n
            assert sum(fill.values()) == sum(lengths)
            assert all(v == size or v & (v - 1) == 0 for v in fill.values())


def test_placement_is_the_cheapest():
    r = random.Random(1)
    p = P.SumOfSquares(32)
    for _ in range(400):
        n = r.randrange(1, 32)
        before = p.counts.copy()

        def cost(level):
            c = before.copy()
            if level:
                c[level] -= 1
            if level + n < 32:
                c[level + n] += 1
            return int((c**2).sum())

        levels = [0] + [v for v in range(1, 33 - n) if before[v]]
        _, at = p.place(n)
        assert cost(at) == min(map(cost, levels))


def test_special_tokens_are_read_as_the_library_reads_them():
    encode = P.encoder(PATH).encode
    for t in ("<|endoftext|>", "a <|endoftext|> b", "x<|startoftext|>y<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext |>", "é<|endoftext|>é"):
        assert list(np.frombuffer(encode([t])[0], "<u4")) == reference_ids(t)[:-1]
    assert list(np.frombuffer(encode(["<|endoftext|>"])[0], "<u4")) == [49407]


def test_placement_decides_how_often_documents_are_cut():
    """Sum of squares cuts fewer documents than filling windows one after another; without padding either way."""
    r = random.Random(12)
    lengths = [min(2047, int(r.lognormvariate(5.5, 1))) + 1 for _ in range(4000)]
    pieces = len(P.pack_lengths(lengths, 2048))
    in_a_row = len(lengths) + sum(lengths) // 2048  # a cut at every window's end, but for lucky ends
    assert pieces - len(lengths) < 0.25 * (in_a_row - len(lengths))


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_rows_leave_in_small_batches():
    """A group's ids don't go to the JVM in one batch."""
    import pyarrow as pa
    from pyspark.sql import types as T

    bodies = [np.full(2048, i, "<u4").tobytes() for i in range(3 * P.BATCH_PIECES + 7)] + [b"\x01\0\0\0"]
    pieces = P.pack_lengths([len(b) // 4 for b in bodies])
    fields = T.StructType([T.StructField("doc_id", T.LongType()), *P.PIECE.fields])
    got = list(P.piece_batches(fields, pa.int64(), list(range(len(bodies))), bodies, pieces, 1 << 32))
    assert len(got) == 4 and max(b.nbytes for b in got) < P.BATCH_PIECES * (4 * 2048 + 100)
    rows = pa.Table.from_batches(got).to_pylist()
    assert [(r["doc_id"], r["start"], r["length"], r["sequence_id"] - (1 << 32), r["offset"]) for r in rows] == pieces
    assert all(r["ids"] == bodies[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])] and r["ids_crc32"] == zlib.crc32(r["ids"]) for r in rows)
