"""Quality rules as a bitmask ledger, with built-in functions only.

Each rule is evaluated once per document: its measurement is stored, and its failure sets a bit of ``failed_bits``.
Policies are versioned sets of rules, that is, masks; applying one, or asking what it would keep without one of its
rules, is bitwise arithmetic on the ledger and reads no text again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t-\r]+", -1), lambda w: w != "")


def window_text(words: Column, i: Column) -> Column:
    return F.concat_ws(" ", F.slice(words, i, WINDOW))


def repeated_words(words: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the text.

    Hashes of the windows tell texts without a repeat; only for the others are the windows themselves sorted, each
    compared with its neighbours, and the repeated ones' places put in order to count what they cover.
    """
    n = F.size(words)
    first = F.sequence(F.lit(1), n - (WINDOW - 1))

    def hashed(i: Column) -> Column:
        return F.xxhash64(*[F.element_at(words, (i + k).cast("int")) for k in range(WINDOW)])

    def covered(place: Column) -> Column:
        later = F.sequence(F.lit(2), F.size(place))
        overlap = F.aggregate(later, F.lit(0), lambda acc, j: acc + F.greatest(F.lit(0), F.lit(WINDOW) - (F.element_at(place, j) - F.element_at(place, j - 1))))
        return WINDOW * F.size(place) - F.when(F.size(place) > 1, overlap).otherwise(0)

    def count(windows: Column) -> Column:
        size = F.size(windows)
        same = lambda a, b: F.element_at(windows, a)["t"] == F.element_at(windows, b)["t"]
        hits = F.filter(F.sequence(F.lit(1), size), lambda k: F.when(k > 1, same(k, F.greatest(k - 1, F.lit(1)))).otherwise(False) | F.when(k < size, same(k, F.least(k + 1, size))).otherwise(False))
        return let(F.sort_array(F.transform(hits, lambda k: F.element_at(windows, k)["i"])), covered)

    exact = let(F.sort_array(F.transform(first, lambda i: F.struct(window_text(words, i).alias("t"), i.alias("i")))), count)
    twice = let(F.transform(first, hashed), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n <= WINDOW, 0).when(twice, exact).otherwise(0).cast("long")


#: name, failure of the measurements; the order gives the bit.  Base rules come first and are part of every policy.
RULES: list[tuple[str, Callable[[dict[str, Column]], Column]]] = [
    ("few_words", lambda m: m["n_words"] < 10),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    ("symbols", lambda m: 100 * m["n_symbols"] > 30 * m["n_words"]),
    ("shouting", lambda m: 100 * m["n_upper"] > 50 * m["n_letters"]),
    ("repeated_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    ("long_words", lambda m: m["word_chars"] > 40 * m["n_words"]),
    ("no_letters", lambda m: 2 * m["n_letters"] < m["word_chars"]),
    ("exclamations", lambda m: 100 * m["n_marks"] > 50 * m["n_words"]),
    ("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
]
BIT = {name: i for i, (name, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")

#: Versions stay as they were published; a new one gets a new name.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "shouting", "repeated_lines", "exclamations"),
    "v2": (*BASE, "symbols", "shouting", "repeated_lines", "exclamations", "long_words", "no_letters", "short_words"),
}
CURRENT = "v2"


def mask(policy: str) -> int:
    return sum(1 << BIT[r] for r in {*POLICIES[policy], *BASE})


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_marks")


def ledger(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_``, the measurements and ``failed_bits`` of every row.

    A null text has no words.  Words are parted by ASCII space; counts are of code points.  Equal rows are judged each;
    an empty table gives an empty table.  Other columns are not read, so their names cannot clash.
    """
    t = F.coalesce(F.col("_text"), F.lit(""))
    removed = lambda chars: F.char_length("_text") - F.char_length(F.translate("_text", chars, ""))

    def lines(of: Column) -> list[Column]:
        return [F.size(of).cast("long").alias("n_lines"), (F.size(of) - F.size(F.array_distinct(of))).cast("long").alias("n_dup_lines")]

    base = df.select(F.col(id_), F.col(text).alias("_text")).select(id_, t.alias("_text"))
    with_word = F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    upper = F.lower("_text")
    measured = base.select(
        id_,
        F.char_length(F.translate("_text", SPACE, "")).cast("long").alias("word_chars"),
        removed(SYMBOLS).cast("long").alias("n_symbols"),
        removed("!").cast("long").alias("n_marks"),
        (F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"\p{L}+", ""))).cast("long").alias("n_letters"),
        F.when(F.col("_text") == upper, 0).otherwise(F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        let(with_word, lambda x: F.struct(*lines(x))).alias("_l"),
        let(words_of(F.col("_text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("_w"),
    ).select(id_, "_w.n_words", "word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines", "n_letters", "n_upper", "n_marks")
    m = {name: F.col(name) for name in MEASURES}
    bits = F.lit(0).cast("long")
    for i, (_, failed) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(failed(m), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("failed_bits", bits)


def passes(policy: str, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(ledger_: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A row for each rule of ``policy``: documents it fails, fails alone, and that the policy keeps without it.

    The ledger is first counted by its bits: at most two to the number of rules rows, whatever the corpus.
    """
    counts = ledger_.groupBy("failed_bits").agg(F.count("*").alias("n"))
    whole = mask(policy)
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BIT[r]).cast("long").alias("bit")) for r in sorted(POLICIES[policy], key=BIT.get)])
    each = counts.select("n", F.col("failed_bits").bitwiseAND(F.lit(whole).cast("long")).alias("b"), F.explode(rules).alias("r"))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    return each.groupBy("r.rule").agg(
        count(F.col("b").bitwiseAND(F.col("r.bit")) != 0)("n_failed"),
        count(F.col("b") == F.col("r.bit"))("n_only"),
        count(F.col("b").bitwiseAND(F.bitwise_not("r.bit")) == 0)("n_kept_without"),
        count(F.col("b") == 0)("n_kept"),
    )


def stored_ledger(df: DataFrame) -> DataFrame:
    """The ledger of ``df``, written once; policies and ablations read it and no text."""
    return common.write_table(ledger(df), "ledger")


def digest(df: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The contract's columns of the stored ledger under ``policy``; ``sole_bit`` is the rule without which a failed row would be kept,
    0 if there is none."""
    counted = F.col("failed_bits").bitwiseAND(F.lit(mask(policy)).cast("long"))
    sole = F.when(F.bit_count(counted) == 1, counted).otherwise(0).cast("long")
    return stored_ledger(df).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), passes(policy).alias("kept"), "failed_bits", sole.alias("sole_bit")
    )


_LEDGER_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(t, '[ \\t-\\r]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS l FROM d),
g AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 5)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
m AS (SELECT d.doc_id, len(w.w)::BIGINT AS n_words,
             length(regexp_replace(t, '[ \\t-\\r]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
             (length(t) - length(regexp_replace(t, '\\pL+', '', 'g')))::BIGINT AS n_letters,
             (length(t) - length(regexp_replace(t, '\\p{Lu}+', '', 'g')))::BIGINT AS n_upper,
             (length(t) - length(replace(t, '!', '')))::BIGINT AS n_marks
      FROM d JOIN w USING (rid) LEFT JOIN c USING (rid)),
b AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (100 * n_symbols > 30 * n_words)::BIGINT
             + 8 * (100 * n_upper > 50 * n_letters)::BIGINT + 16 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
             + 32 * (word_chars > 40 * n_words)::BIGINT + 64 * (2 * n_letters < word_chars)::BIGINT
             + 128 * (100 * n_marks > 50 * n_words)::BIGINT + 256 * (word_chars < 2 * n_words)::BIGINT AS failed_bits FROM m)
"""
ORACLE_SQL = f"""{_LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits::BIGINT AS failed_bits,
       CASE WHEN bit_count(failed_bits) = 1 THEN failed_bits ELSE 0 END::BIGINT AS sole_bit
FROM b
"""
ABLATION_SQL = f"""{_LEDGER_SQL}
SELECT rule, count(*) FILTER (WHERE (failed_bits & bit) <> 0) AS n_failed, count(*) FILTER (WHERE failed_bits = bit) AS n_only,
       count(*) FILTER (WHERE (failed_bits & ~bit) = 0) AS n_kept_without, count(*) FILTER (WHERE failed_bits = 0) AS n_kept
FROM b CROSS JOIN (VALUES {", ".join(f"('{r}', {1 << i}::BIGINT)" for r, i in BIT.items())}) AS rules(rule, bit) GROUP BY rule
"""
