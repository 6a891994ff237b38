import random
import re
from collections import Counter

from palisade.llm import rules as R

SPACE = r"[\x20\x09-\x0D]"


def slow(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(windows)
    cover = {i + k for i, x in enumerate(windows) if c[x] > 1 for k in range(5)}
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(cover)


def texts():
    r = random.Random(8)
    out = []
    for _ in range(150):
        words = [r.choice(["a", "b", "über", "C#", "|", "日本", "X!", "\U0001f600"]) for _ in range(r.randrange(0, 40))]
        out.append("".join(w + r.choice([" ", "  ", "\n", "\t", "\x0b", "\n\n", " "]) for w in words))
    return out + ["", None, " ", "\n\n", "a " * 3000, "a b c d e", "a b c d e f", "a a a a a a", " lead", "x\x00y\x85z", "\x1c \x1d"]


def test_measurements_against_loops(spark):
    docs = texts()
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(docs)], "doc_id long, text string, n_words int")
    for r in R.digest(df).collect():
        want = slow(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, docs[r.doc_id]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_policies_and_ablation(spark):
    names = [n for n, _ in R.RULES]
    rows = [(i, b) for i, b in enumerate([0, 1, 2, 3, 4, 4, 8, 12, 32, 511])]
    led = spark.createDataFrame(rows, "doc_id long, failed_bits long")
    for policy in R.POLICIES:
        mask = R.mask(policy)
        kept = {r.doc_id for r in led.where(R.passes(policy)).collect()}
        assert kept == {i for i, b in rows if not b & mask}
        got = {r.rule: r for r in R.ablation(led, policy).collect()}
        assert set(got) == set(R.POLICIES[policy])
        for rule, r in got.items():
            bit = 1 << names.index(rule)
            assert r.n_failed == sum(bool(b & bit) for _, b in rows)
            assert r.n_only == sum(b & mask == bit for _, b in rows)
            assert r.n_kept_without == sum(not b & mask & ~bit for _, b in rows)
            assert r.n_kept == len(kept)


def test_very_long_text_and_clashing_columns(spark):
    r = random.Random(2)
    docs = [" ".join(f"w{r.randrange(400)}" for _ in range(120_000)), "x" * 2_000_000, "a b c d e\n" * 20_000]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(docs)], "doc_id long, text string, failed_bits int, _text int")
    for row in R.digest(df).collect():
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == slow(docs[row.doc_id])


def test_sole_bit(spark):
    docs = ["one two", "a plain text of more than ten words that has nothing wrong with it", "### " * 5]
    got = {r.doc_id: r for r in R.digest(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert (got[0].failed_bits, got[0].sole_bit, got[1].failed_bits, got[1].sole_bit) == (1, 1, 0, 0)
    assert got[2].failed_bits.bit_count() > 1 and got[2].sole_bit == 0


def test_native_and_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = R.digest(df)
    assert out.collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
