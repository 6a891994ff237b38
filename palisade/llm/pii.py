"""Personal data by weak supervision, with built-in functions only.

Regular expressions find base spans, which always stay, and wider ones find candidates: obfuscated addresses, national
phone numbers, card-like numbers, long addresses of machines.  Four labellers vote on each span: format checks, gazetteers
(domains, dialling codes, issuers, address ranges), cue words in front, and the surroundings of the token.  The votes are
counted by pattern, which bounds them whatever the corpus; expectation-maximisation on the counts estimates each
labeller's reliability, the posteriors train a logistic span classifier, and its score is applied as a column expression.

Patterns are written so that the matcher neither recurses nor backtracks over long runs: a match can only begin where
a run begins, or where the last match ended.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .rules import let

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "A-Za-z0-9._%+-"
#: The base patterns of the contract, in linear form.  A card has at least 16 digits, so shorter chains needn't match.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++(?: ?(?:\[at\]|\(at\)|\{{at\}}) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)|\{{dot\}}) ?[A-Za-z0-9-]++)++| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"(?<![0-9.+-])(?:(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|00[1-9][0-9]{0,2}(?:[ ./-][0-9]{2,7}){1,4}|0[1-9][0-9]{1,3}[ /-][0-9]{3,8})(?![0-9.-])",
}
_DIGIT = "[0-9]"
_GUARD = {
    "email": (lambda t: F.contains(t, F.lit("@")), lambda t: t.rlike(r"[\[({]at[\])}]| dot ")),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda t: t.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]")),
    "card": (lambda t: t.rlike(_DIGIT), lambda t: t.rlike(_DIGIT)),
    "phone": (lambda t: F.contains(t, F.lit("+")), lambda t: t.rlike(_DIGIT)),
}

# What the gazetteers and the context labeller know.
DOMAINS = "com org net edu gov io info biz de fr es uk it nl eu us ca ch at".split()
DIALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 81 82 86 91".split()
CUES = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel|adresse",
    "ip": "ip|host|server|address|login|client|adresse",
    "card": "card|visa|mastercard|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|sms|telefon|téléphone|teléfono",
}
AGAINST = "version|isbn|issn|doi|section|build|release|figure|invoice|order|ticket"


_CHUNK = 256


def running(values: Column, op: Callable[[Column, Column], Column], start: int) -> Column:
    """Running results of an associative ``op`` along an array of int, from ``start``.

    Arrays grow by copying, so stretches of _CHUNK values are worked out apart and then joined: a long array costs little more
    than its length.
    """
    grown = "struct<last:int,all:array<int>>"

    def scan(array: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
        """``step`` gives the next state and what is noted of it."""

        def one(acc: Column, x: Column) -> Column:
            last, noted = step(acc["last"], x)
            return F.struct(last.alias("last"), F.concat(acc["all"], F.array(noted)).alias("all")).cast(grown)

        return F.aggregate(array, F.struct(F.lit(start).alias("last"), F.array().cast("array<int>").alias("all")).cast(grown), one)

    def chunked(v: Column) -> Column:
        first = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(_CHUNK))
        return F.transform(first, lambda i: scan(F.slice(v, i, _CHUNK), lambda a, x: (op(a, x),) * 2))

    def joined(chunks: Column) -> Column:
        before = scan(chunks, lambda a, c: (op(a, c["last"]), a))["all"]
        return F.flatten(F.zip_with(chunks, before, lambda c, x: F.transform(c["all"], lambda y: op(x, y))))

    return let(let(values, chunked), joined)


def spans(text: Column, pattern: str, guard: Column) -> Column:
    """Matches of ``pattern`` in order: array of struct<m, s, e, before, after> in code points."""
    empty = F.array().cast("array<struct<m:string,s:int,e:int,before:string,after:string>>")

    def build(both: Column) -> Column:
        pieces, found = both["p"], both["m"]
        at = lambda x, i: F.element_at(x, i)
        numbers = F.sequence(F.lit(1), F.size(found))
        step = lambda i: F.char_length(at(pieces, i)) + F.when(i > 1, F.char_length(at(found, F.greatest(i - 1, F.lit(1))))).otherwise(0)

        def one(starts: Column, i: Column) -> Column:
            m, s = at(found, i), at(starts, i)
            return F.struct(m.alias("m"), s.alias("s"), (s + F.char_length(m)).alias("e"), F.right(at(pieces, i), F.lit(40)).alias("before"), F.left(at(pieces, i + 1), F.lit(2)).alias("after"))

        return let(running(F.transform(numbers, step), lambda a, b: a + b, 0), lambda starts: F.transform(numbers, lambda i: one(starts, i)))

    # pieces are split off only where there is a match
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    built = let(found, lambda m: F.when(F.size(m) > 0, let(F.struct(F.split(text, pattern, -1).alias("p"), m.alias("m")), build)).otherwise(empty))
    return F.when(guard, built).otherwise(empty)


def apart(base: Column, wide: Column) -> Column:
    """``base`` spans and those of ``wide`` that meet none of them.

    In order of their starts, a span meets one before it if that one's end lies behind its start, and one after it if that
    one's start lies before its end.
    """

    def judged(every: Column) -> Column:
        ends = running(F.transform(every, lambda u: F.when(u["x"]["base"], u["x"]["e"]).otherwise(-1)), F.greatest, -1)
        starts = F.reverse(running(F.reverse(F.transform(every, lambda u: F.when(u["x"]["base"], u["at"]).otherwise(_FAR))), F.least, _FAR))
        flags = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("e"), s.alias("s")))
        both = F.zip_with(every, flags, lambda u, f: F.struct(u["x"].alias("x"), (u["x"]["base"] | ((f["e"] <= u["at"]) & (f["s"] >= u["x"]["e"]))).alias("kept")))
        return F.transform(F.filter(both, lambda u: u["kept"]), lambda u: u["x"])

    ordered = F.sort_array(F.transform(F.concat(base, wide), lambda x: F.struct(x["s"].alias("at"), (~x["base"]).alias("w"), x.alias("x"))))
    return F.when(F.size(wide) > 0, let(ordered, judged)).otherwise(base)


_FAR = (1 << 31) - 1


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the checksum."""

    def value(acc: Column, i: Column) -> Column:
        v = F.substring(d, F.char_length(d) - i + 1, F.lit(1)).cast("int")
        twice = v * 2
        return acc + F.when(i % 2 == 1, v).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.char_length(d), F.lit(1))), F.lit(0), value) % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def sound(kind: str, m: Column) -> Column:
    """Whether a match of the base pattern counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    n = F.char_length(digits(m))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(m))).otherwise(False)
    return n.between(8, 15)


LABELLERS = ("format", "gazetteer", "context", "surroundings")


def votes(kind: str, x: Column, base: bool) -> list[Column]:
    """The labellers' votes for a span: 1, -1, or 0 for none."""
    m, before = x["m"], F.lower(x["before"])
    vote = lambda good, bad: F.when(good, 1).when(bad, -1).otherwise(0)
    never = F.lit(False)
    if base:
        form = F.lit(1)
    elif kind == "card":
        n = F.char_length(digits(m))
        valid = F.when(n.between(13, 19), luhn(digits(m))).otherwise(False)  # long runs of digits are no cards and aren't summed up
        form = vote(valid & (n <= 15), ~valid)
    else:
        form = F.lit(0)
    if kind == "email":
        known = vote(F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1)).isin(DOMAINS), never)
    elif kind == "ip":
        known = vote(m.rlike("^0*(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[0-2][0-9]|23[0-9])\\.") | m.contains(":"), m.rlike(r"^0+\."))
    elif kind == "card":
        known = vote(m.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), never)
    else:
        code = "|".join(sorted(DIALLING, key=lambda c: (-len(c), c)))
        known = vote(m.rlike(rf"^(?:\+|00)(?:{code})") | m.rlike(r"^\(?[2-9][0-9]{2}"), m.rlike(r"^\+0|^\(?[01][0-9]{2}[). -]+[0-9]{3}[ .-][0-9]{4}$"))
    cue = vote(before.rlike(rf"(?:{CUES[kind]})[^.\n]*$"), before.rlike(rf"(?:{AGAINST})[^.\n]*$"))
    around = vote(before.rlike(r"(?:^|[\s,;:(<\[|])$") & x["after"].rlike(r"^(?:$|[\s,;:)>\]|!?.])"), before.rlike(r"[0-9A-Za-z_/=-]$") | x["after"].rlike("^[0-9A-Za-z_/=]"))
    return [form, known, cue, around]


def _marked(kind: str, found: Column, base: bool) -> Column:
    number = KINDS.index(kind) + 1
    return F.transform(
        found,
        lambda x: F.struct(
            F.lit(number).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(base).alias("base"), *[v.cast("int").alias(f"v{i}") for i, v in enumerate(votes(kind, x, base), 1)]
        ),
    )


def _sound_only(kind: str, found: Column) -> Column:
    return F.filter(found, lambda x: sound(kind, x["m"]))


def candidates(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_`` and ``found``: all spans of a row with their kind (number in KINDS), place and votes; base ones flagged."""
    docs = df.select(F.col(id_), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    t = F.col("_text")
    for kind in KINDS:
        guard, wide_guard = (g(t) for g in _GUARD[kind])
        base = _sound_only(kind, spans(t, BASE[kind], guard))
        docs = docs.withColumn(f"_b_{kind}", _marked(kind, base, True)).withColumn(f"_w_{kind}", _marked(kind, spans(t, WIDE[kind], wide_guard), False))
    base, wide = (F.concat(*[F.col(f"_{p}_{k}") for k in KINDS]) for p in "bw")
    return docs.select(id_, base.alias("_base"), wide.alias("_wide")).select(id_, apart(F.col("_base"), F.col("_wide")).alias("found"))


# ---------------------------------------------------------------- the models, on counted vote patterns


@dataclass
class SpanModel:
    """Weights per kind: bias, then one a labeller; and the reliabilities they were trained on."""

    weights: list[list[float]]
    reliability: dict[int, list[list[list[float]]]]

    def score(self, x: Column) -> Column:
        pick = lambda j: F.element_at(F.array(*[F.lit(float(w[j])) for w in self.weights]), x["kind"])
        total = pick(0)
        for j in range(1, len(LABELLERS) + 1):
            total = total + pick(j) * x[f"v{j}"]
        return total


#: Belief about a labeller before any counts: chances of the votes -1, 0, 1 if the span is none, and if it is one; and its
#: weight as a share of the spans.
PRIOR = ((0.6, 0.3, 0.1), (0.1, 0.3, 0.6))
WEIGHT = 0.05
FAILED = 0.01  # chance of a span whose format check fails, as a checksum leaves little doubt


def fit(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> SpanModel:
    """From (kind, votes, count): EM per kind, then a logistic classifier on the posteriors.

    The counts start from the majority of the votes.  Spans whose format check fails are known to be none and stay so in every
    round; they and the others tell how far each labeller can be trusted.  PRIOR is a small part of every table, so kinds that are
    not there get weights too.
    """
    weights, reliability = [], {}
    n = len(LABELLERS)
    for kind in range(1, len(KINDS) + 1):
        own = [(v, c) for k, v, c in patterns if k == kind]
        q = [FAILED if v[0] < 0 else 0.9 if sum(v) > 0 else 0.1 for v, _ in own]
        spans_ = sum(c for _, c in own)
        table = [[[1 / 3] * 3 for _ in range(2)] for _ in range(n)]
        for _ in range(rounds if own else 0):
            prior = (1 + sum(p * c for p, (_, c) in zip(q, own, strict=True))) / (2 + sum(c for _, c in own))
            for j in range(n):
                for t in (0, 1):
                    mass = [0.1 + WEIGHT * spans_ * b for b in PRIOR[t]]
                    for p, (v, c) in zip(q, own, strict=True):
                        mass[v[j] + 1] += c * (p if t else 1 - p)
                    table[j][t] = [m / sum(mass) for m in mass]
            for i, (v, _) in enumerate(own):
                if v[0] < 0:
                    continue
                odds = math.log(prior / (1 - prior)) + sum(math.log(table[j][1][v[j] + 1] / table[j][0][v[j] + 1]) for j in range(n))
                q[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        reliability[kind] = table
        w = [-1.0] + [0.5] * n
        total = sum(c for _, c in own) or 1
        for step in range(400 if own else 0):
            g = [0.001 * x for x in w]
            for p, (v, c) in zip(q, own, strict=True):
                z = w[0] + sum(a * b for a, b in zip(w[1:], v, strict=True))
                e = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * c / total
                g = [g[0] + e, *(x + e * b for x, b in zip(g[1:], v, strict=True))]
            w = [x - 2.0 / (1 + step / 100) * d for x, d in zip(w, g, strict=True)]
        weights.append(w)
    return SpanModel(weights, reliability)


def train(found: DataFrame) -> SpanModel:
    """Fit on the counted vote patterns: at most 4 kinds times 3**4 rows reach the driver."""
    names = [f"v{i}" for i in range(1, len(LABELLERS) + 1)]
    each = found.select(F.explode("found").alias("x")).select("x.kind", *[f"x.{v}" for v in names])
    rows = each.groupBy("kind", *names).count().collect()
    return fit(sorted((r["kind"], tuple(r[v] for v in names), r["count"]) for r in rows))


def find(df: DataFrame, id_: str = "doc_id", text: str = "text", model: SpanModel | None = None) -> DataFrame:
    """``id_`` and ``pii``: array of struct<kind,s,e,base>, by kind and start, of base spans and those the classifier adds.

    A null or empty text has none; equal texts have equal spans; an empty table gives an empty table.  Only ``id_`` and
    ``text`` are read, so other columns cannot clash.
    """
    found = common.write_table(candidates(df, id_, text), "pii")
    model = model or train(found)
    kept = F.filter("found", lambda x: x["base"] | (model.score(x) > 0))
    return found.select(id_, F.sort_array(F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base")))).alias("pii"))


def listed(items: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(items, lambda x: F.concat_ws(":", F.element_at(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))))


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns of ``find``."""
    base = F.filter("pii", lambda x: x["base"])
    count = lambda i: F.size(F.filter("pii", lambda x: x["base"] & (x["kind"] == i))).cast("long")
    return find(df).select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS, 1)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans")
    )
