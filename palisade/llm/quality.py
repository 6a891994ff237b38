"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on each labelled document, for two questions: is it of low quality, is it toxic.  Given labels are one more labeller, with accuracies of their own.  Expectation-maximisation
(labellers independent given the truth, abstentions allowed) estimates every labeller's accuracy and the
posterior of each document; the posteriors, and they alone, train a logistic scorer over hashed word features and measured
structure.  The scorer reads whole texts and is all that is applied to the corpus.

All labelled rows count.  Their features are counted and stored where their texts lie; rates of slots, numbers of vote patterns (from which
alone expectation-maximisation works) and weights are summed on executors as whole numbers, so the order of rows doesn't matter.
The scorer is trained on blocks of rows, dealt by the hash of their id, and the blocks' weights are averaged by rows; the driver
gets sums of bounded size and no row.
"""

from __future__ import annotations

import math
import operator
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BITS = 18
PREFIXES = (4, 5, 6, 7)
LEAST_ROWS = 4
FORM_EPOCHS = 6
CLASS_SLOTS = 4  # of the class of insults, so that it is learned before its texts' other words are learned by heart
EDGE = "\"'`.,;:!?()[]{}<>|#*$%&_-–—«»“”„…"
_SYMBOLS = "#*$%&|<>"
CACHE_WORDS = 400_000
PIECE_WORDS = 1 << 16  # of a long text that are looked up at a time

# Words that insult, as a labeller knows them.
INSULTS = """
idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown clowns imbecile dumb
idioten dumm dummkopf abschaum arschloch trottel imbécile crétin connard salaud ordure abruti imbécil estúpido basura escoria
""".split()

_INSULTS = frozenset(INSULTS)

# ---------------------------------------------------------------- what is measured

STRUCTURE = ("symbols", "upper", "repeats", "bars", "marks", "same_lines", "few", "runs")


def structure(text: str, tokens: list[str]) -> list[float]:
    """Shares between 0 and 1 that describe a text's form; a text without words is ``few``."""
    n = len(tokens)
    if not n:
        return [0, 0, 0, 0, 0, 0, 1, 0]
    symbols = sum(map(text.count, _SYMBOLS))
    upper = sum(map(str.isupper, tokens))
    distinct = len(set(tokens))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    runs = sum(map(operator.eq, tokens, tokens[1:]))
    expected = min(n, 12 * n**0.5)  # distinct words that a text of this length has at least
    return [
        min(1.0, symbols / n / 2),
        upper / n,
        max(0.0, 1 - distinct / expected * 1.5),
        min(1.0, 4 * tokens.count("|") / n),
        min(1.0, text.count("!") / n),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        1.0 if n < 10 else 0.0,
        runs / n,
    ]


def word_slots(token: str) -> list[int]:
    """Hash slots of a token: the word, its beginnings, and the class of insults for their words."""
    w = token.lower().strip(EDGE)
    if not w:
        return []
    raw, digest, shift = w.encode(), xxhash.xxh32_intdigest, 32 - BITS
    out = [digest(b"w " + raw) >> shift]
    n = len(w)
    for k, head in _HEADS:
        if n < k:
            break
        out.append(digest(head + (raw[:k] if len(raw) == n else w[:k].encode())) >> shift)
    return out + _CLASS if w in _INSULTS else out


_HEADS = [(k, b"%d " % k) for k in PREFIXES]
_CLASS = [xxhash.xxh32_intdigest(b"class insult %d" % i) >> (32 - BITS) for i in range(CLASS_SLOTS)]


def slots_of(words: list[str], memory: dict[str, bytes]) -> np.ndarray:
    """Slots of all words, one after another; ``memory`` keeps them by word as 32-bit numbers."""
    if len(memory) > CACHE_WORDS:
        memory.clear()
    row = list(map(memory.get, words))
    if None in row:
        for i in [i for i, x in enumerate(row) if x is None]:
            w = words[i]
            x = memory.get(w)
            if x is None:
                x = memory[w] = array("i", word_slots(w)).tobytes()
            row[i] = x
    return np.frombuffer(b"".join(row), np.int32)


def _pieces(words: list[str]) -> Iterator[list[str]]:
    return (words[i : i + PIECE_WORDS] for i in range(0, len(words), PIECE_WORDS))


# ---------------------------------------------------------------- labellers and their accuracies


def quality_votes(s: list[float], n: int) -> list[int]:
    """Votes for low quality: 1, against it: -1, none: 0."""
    symbols, upper, repeats, bars, marks, same, few, runs = s
    # a text has one defect or another, so only the last speaks against: no defect at all
    bad = [symbols > 0.15, upper > 0.4 and n >= 10, repeats > 0.5 or runs > 0.3, bars > 0.3, marks > 0.3, same > 0.4]
    clean = max(symbols, bars, marks) < 0.05 and upper < 0.2 and repeats < 0.2 and runs < 0.1 and same < 0.2
    return [*map(int, bad), -1 if clean else 0]


def toxic_votes(hits: int, stems: float, n: int) -> list[int]:
    """Votes for toxicity from the fixed words, and from the share of stems that marked labelled rows."""
    return [1 if hits >= 2 or hits / max(n, 1) > 0.01 else -1 if hits == 0 and stems < 0.01 else 0, 1 if stems > 0.04 else -1 if stems < 0.015 else 0]


@dataclass
class Reliability:
    """Chances of each vote given the truth; ``table[j, truth, vote + 1]``."""

    prior: float
    table: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        j = np.arange(votes.shape[1])
        logs = np.log(self.table)
        score = [logs[j, t, votes + 1].sum(axis=1) + math.log(p) for t, p in ((0, 1 - self.prior), (1, self.prior))]
        return 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))


def expectation_maximisation(votes: np.ndarray, rounds: int = 40, rows: np.ndarray | None = None) -> Reliability:
    """Labeller reliabilities from votes in {-1, 0, 1} alone; the last labeller's votes, where given, and else the majority
    are the start.  ``rows``: how many rows vote like each (None: one)."""
    rows = np.ones(len(votes)) if rows is None else rows
    total = votes.sum(axis=1)
    q = np.where(votes[:, -1] != 0, np.where(votes[:, -1] > 0, 0.95, 0.05), np.where(total > 0, 0.9, np.where((votes > 0).any(axis=1), 0.5, 0.05)))
    for _ in range(rounds):
        table = np.empty((votes.shape[1], 2, 3))
        for t, w in enumerate(((1 - q) * rows, q * rows)):
            for v in (-1, 0, 1):
                table[:, t, v + 1] = ((votes == v) * w[:, None]).sum(axis=0) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        model = Reliability(float(np.clip((q * rows).sum() / rows.sum(), 0.005, 0.9)), table)
        q = model.posterior(votes)
    return model


# ---------------------------------------------------------------- the scorer


@dataclass
class Model:
    """Weights of the two heads (low quality, toxic); ``words`` by slot, applied to counts per 100 words."""

    words: np.ndarray
    structure: np.ndarray
    bias: np.ndarray
    reliability: list[Reliability] = field(default_factory=list)

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Applies a model; remembers the slots of words."""

    def __init__(self, model: Model):
        self.model = model
        self.memory: dict[str, bytes] = {}

    def score(self, text: str) -> tuple[float, float]:
        """Chances that a text is of low quality, and toxic."""
        tokens = text.split()
        total = np.zeros(2)
        for piece in _pieces(tokens):
            slots = slots_of(piece, self.memory)
            total += [w.take(slots).sum() for w in self.model.words]
        logit = self.model.structure @ np.array(structure(text, tokens)) + self.model.bias + total * (100 / max(1, len(tokens)))
        a, b = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return float(a), float(b)


@dataclass
class Example:
    """What the fit needs of a text: words, form, insults among the words, and its slots with their counts per 100 words."""

    size: int
    form: list[float]
    hits: int
    slots: np.ndarray
    values: np.ndarray


def example(text: str, memory: dict[str, bytes]) -> Example:
    words = text.split()
    size = max(1, len(words))
    found = [np.unique(slots_of(piece, memory), return_counts=True) for piece in _pieces(words)]
    if len(found) == 1:
        slots, counts = found[0]
    else:
        slots, inverse = np.unique(np.concatenate([np.zeros(0, np.int32), *(x for x, _ in found)]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([np.zeros(0), *(n for _, n in found)]), len(slots))
    at = int(slots.searchsorted(_CLASS[0]))
    hits = 0
    if at < len(slots) and slots[at] == _CLASS[0]:  # a text with insults has the slots of their class
        hits = sum(w.lower().strip(EDGE) in _INSULTS for w in words)
    return Example(size, structure(text, words), hits, slots, _values(counts, size))


def _values(counts: np.ndarray, size: int) -> np.ndarray:
    return counts.astype(np.float32) * np.float32(100 / size)


def _label(low: int | None, toxic: int | None) -> tuple[int, int]:
    """Given labels as votes."""
    return 0 if low is None else 1 if low == 0 else -1, 0 if toxic is None else 1 if toxic == 1 else -1


def train(examples: list[Example], given: list[tuple[int | None, int | None]], epochs: int = 26, rate: float = 0.8, decay: float = 1e-5) -> Model:
    """Fit on texts' features and their given labels ((1 good / 0 low), (1 toxic / 0 not); None: not given)."""
    n = len(examples)
    if not n:
        return Model(np.zeros((2, 1 << BITS)), np.zeros((2, len(STRUCTURE))), np.full(2, -2.0))
    size = np.array([e.size for e in examples])
    form = np.array([e.form for e in examples])
    slots, values = [e.slots for e in examples], [e.values for e in examples]
    low = np.array([0 if q is None else 1 if q == 0 else -1 for q, _ in given])
    tox = np.array([0 if t is None else 1 if t == 1 else -1 for _, t in given])
    stems = _marking_slots(slots, values, tox)
    share = [float(v[np.isin(s, stems)].sum()) / 100 for s, v in zip(slots, values, strict=True)]
    votes = [
        np.column_stack([np.array([quality_votes(list(f), k) for f, k in zip(form, size, strict=True)]).reshape(n, -1), low]),
        np.column_stack([np.array([toxic_votes(e.hits, s, e.size) for e, s in zip(examples, share, strict=True)]).reshape(n, -1), tox]),
    ]
    reliability = [expectation_maximisation(v) for v in votes]
    target = np.stack([r.posterior(v) for r, v in zip(reliability, votes, strict=True)])
    model = Model(np.zeros((2, 1 << BITS)), np.zeros((2, len(STRUCTURE))), np.full(2, -2.0), reliability)
    _fit(model, slots, values, form, target, epochs, rate, decay)
    return model


def _marking_slots(slots: list[np.ndarray], values: list[np.ndarray], tox: np.ndarray) -> np.ndarray:
    """Slots far more frequent in rows given as toxic than in the others, with support in several."""
    rate, seen = np.zeros((2, 1 << BITS)), np.zeros((2, 1 << BITS))
    for s, v, t in zip(slots, values, tox, strict=True):
        if t:
            k = int(t > 0)
            rate[k, s] += v
            seen[k, s] += 1
    return _marking(rate, seen, np.array([(tox < 0).sum(), (tox > 0).sum()]))


def _marking(rate: np.ndarray, seen: np.ndarray, rows: np.ndarray) -> np.ndarray:
    rows = np.maximum(rows, 1)
    rate = (rate + 0.05) / rows[:, None]
    return np.flatnonzero((rate[1] > 8 * rate[0]) & (seen[1] >= max(8, 0.01 * rows[1])))


def _fit(model: Model, slots: list, values: list, form: np.ndarray, target: np.ndarray, epochs: int, rate: float, decay: float, common_: np.ndarray | None = None) -> None:
    """Minibatch logistic regression with adaptive steps; rows in a fixed random order.

    Form is fitted first, so that words only explain what it leaves; slots of fewer than LEAST_ROWS rows would only be
    learned by heart and get no weight; ``common_`` are the others, where more rows than these count.
    """
    n = len(slots)
    if common_ is None:
        rows_with = np.zeros(1 << BITS, np.int32)
        for s in slots:
            rows_with[s] += 1
        common_ = rows_with >= LEAST_ROWS
    chosen = [common_[s] for s in slots]
    values = [v[k].astype(np.float64) for v, k in zip(values, chosen, strict=True)]
    slots = [s[k] for s, k in zip(slots, chosen, strict=True)]
    present = np.unique(np.concatenate(slots)) if n else np.zeros(0, np.int32)
    place = np.zeros(1 << BITS, np.int64)
    place[present] = np.arange(len(present))  # weights are worked on side by side
    slots = [place[s] for s in slots]
    words, lengths = model.words[:, present], np.array([len(s) for s in slots])
    r = np.random.default_rng(7)
    near = np.zeros(len(present), np.int64)
    square = [np.full(words.shape, 1e-3), np.full(model.structure.shape, 1e-3), np.full(2, 1e-3)]
    # few rows need more rounds for as many steps
    rounds = max(1, -(-64 * 40 // max(n, 1)))
    for epoch in range(epochs * rounds):
        order = r.permutation(n)
        for at in range(0, n, 64):
            batch = order[at : at + 64]
            learns = epoch >= FORM_EPOCHS * rounds
            if learns:
                slot = np.concatenate([slots[i] for i in batch])
                value = np.concatenate([values[i] for i in batch])
                row = np.repeat(np.arange(len(batch)), lengths[batch])
                used = np.flatnonzero(np.bincount(slot, minlength=len(present)))
                near[used] = np.arange(len(used))  # only the batch's own slots are worked on
                slot = near.take(slot)
            for h in (0, 1):
                z = form[batch] @ model.structure[h] + model.bias[h]
                if learns:  # before, words have no weights
                    weight = words[h].take(used)
                    z = np.bincount(row, value * weight.take(slot), len(batch)) + z
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[h, batch]) / len(batch)
                if learns:
                    g = np.bincount(slot, value * error.take(row), len(used)) + decay * weight
                    total = square[0][h].take(used) + g * g
                    square[0][h][used] = total
                    words[h][used] = weight - 0.2 * rate * g / np.sqrt(total)
                g = error @ form[batch] + decay * model.structure[h]
                square[1][h] += g * g
                model.structure[h] -= rate * g / np.sqrt(square[1][h])
                g = error.sum()
                square[2][h] += g * g
                model.bias[h] -= rate * g / np.sqrt(square[2][h])
    model.words[:, present] = words


# ---------------------------------------------------------------- the operator


_EXAMPLE = "_id {id}, _th long, _q int, _t int, _size int, _form array<double>, _hits int, _n int, _slots binary, _values binary"


def fit(documents: DataFrame, labels: DataFrame, sample: int | None = None, id_: str = "doc_id", text: str = "text", most: int = 1 << 23) -> Model:
    """Train on all labelled rows.

    Labels may be null and are then not given; a row with several labels counts once for each.  Without labelled rows, all rows are
    taken, and the heuristic labellers vote alone.  A caller who wants less may give a ``sample``: at most that many labelled rows, those
    of the smallest hash of their id, and of these as many as have at most ``most`` features in all, are then trained on by the driver.
    """
    given = labels.select(F.col(id_).alias("_id"), F.col("quality").cast("int").alias("_q"), F.col("toxic").cast("int").alias("_t")).where("_id is not null")
    docs = documents.select(F.col(id_).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    if sample is not None:
        chosen = given.orderBy(F.xxhash64("_id"), "_id", "_q", "_t").limit(sample)
        found = _examples(docs.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).drop("_doc"), sample, most)
        return train([e for e, _ in found], [g for _, g in found])
    features = _labelled_features(docs, given)
    n = features.count()
    if not n:
        common.drop_table(features)
        none = F.lit(None).cast("int")
        features = _features(docs.select(F.col("_doc").alias("_id"), "_text", none.alias("_q"), none.alias("_t")))
        n = features.count()
    model = _train_all(features, n) if n else train([], [])
    common.drop_table(features)
    return model


BLOCK = 4096  # rows that are trained on together
BLOCK_FEATURES = 1 << 23
_FEATURES = "_h long, _th long, _q int, _t int, _size int, _form array<double>, _hits int, _n int, _slots binary, _counts binary"
_PARTS = 1 << 20  # of a rate, and
_WEIGHTS = 1 << 24  # of a weight, in whole numbers


_COUNTED = "_th long, _size int, _form array<double>, _hits int, _n int, _slots binary, _counts binary"


def _features(rows: DataFrame) -> DataFrame:
    """Stored features of the rows (_id, _text, _q, _t): gaps between slots, counts of words."""
    hashed = rows.select(F.xxhash64("_id").alias("_h"), "_text", "_q", "_t")
    return _store(_counted(hashed))


def _labelled_features(docs: DataFrame, given: DataFrame) -> DataFrame:
    """Stored features of the texts (_doc, _text) for each of their labels (_id, _q, _t).

    Texts stay where they lie: those that a bitmap of hashed ids finds unlabelled are left out, the others' features are
    counted there, and these meet the labels, which also drops the few whose hash alone was marked.
    """
    kind = docs.schema["_doc"].dataType
    if given.schema["_id"].dataType != kind:
        given = given.withColumn("_id", F.col("_id").try_cast(kind))
    hashed = docs.where("_doc is not null").select("_doc", F.xxhash64("_doc").alias("_h"), "_text")
    counted = _counted(hashed, _bitmap(given.select(F.xxhash64("_id").alias("_h"))))
    # the same join at any size; labels may be as many as the texts
    features = _store(counted.hint("merge").join(given, F.col("_doc") == F.col("_id")))
    common.free_shuffles(docs.sparkSession)
    return features


def _store(rows: DataFrame) -> DataFrame:
    return common.write_table(rows.select(*T._parse_datatype_string(_FEATURES).names), "features")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """64-bit words, 8 to 16 bits a hash as far as 32 MB reach; a hash's first bits tell its place."""
    k = min(28, max(10, (8 * hashes.count()).bit_length()))
    place = hashes.select(F.shiftrightunsigned("_h", 64 - k).alias("p"))
    words = place.groupBy(F.shiftright("p", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, int(p & 63)))").alias("bits")).toArrow()
    out = np.zeros(1 << (k - 6), np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _marked(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    place = hashes.view(np.uint64) >> np.uint64(64 - (len(bitmap) * 64).bit_length() + 1)
    return (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _counted(rows: DataFrame, bitmap: np.ndarray | None = None) -> DataFrame:
    """``rows`` (_h, _text and more) with features in place of their texts; only those that ``bitmap`` marks, if there is one."""
    stay = [f for f in rows.schema.fields if f.name != "_text"]
    schema = T.StructType(stay + T._parse_datatype_string(_COUNTED).fields)
    sent = None if bitmap is None else rows.sparkSession.sparkContext.broadcast(bitmap)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = common.held("features")
        for batch in common.batches_up_to(batches, 1000):
            if sent is not None:
                batch = batch.filter(pa.array(_marked(batch.column("_h").to_numpy(), sent.value)))
            raw = common.texts(batch.column("_text"))
            made = [example(t, memory) for t in raw]
            th = np.array([xxhash.xxh64_intdigest(t.encode()) for t in raw], np.uint64).view(np.int64)
            gaps = [_least(np.diff(e.slots, prepend=0), np.uint16) for e in made]
            counts = [_least(np.rint(e.values * np.float64(e.size / 100)), np.uint8) for e in made]
            columns = [pa.array(th), pa.array([e.size for e in made], pa.int32()), pa.array([e.form for e in made], pa.list_(pa.float64())), pa.array([e.hits for e in made], pa.int32())]
            columns += [pa.array([len(e.slots) for e in made], pa.int32()), pa.array(gaps, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in stay), *columns], schema.names)

    return rows.mapInArrow(count, schema)


def _least(numbers: np.ndarray, narrow: type) -> bytes:
    """The numbers in a narrow type, or in 32 bits if one is too large."""
    return numbers.astype(narrow if not len(numbers) or numbers.max() <= np.iinfo(narrow).max else np.int32).tobytes()


def _read(raw: bytes, n: int, narrow: type) -> np.ndarray:
    return np.frombuffer(raw, narrow if len(raw) == n * np.dtype(narrow).itemsize else np.int32)


def _stored(batch: pa.RecordBatch) -> Iterator[tuple[Example, tuple[int, int]]]:
    """Features and label votes of stored rows."""
    columns = [batch.column(c).to_pylist() for c in ("_q", "_t", "_size", "_form", "_hits", "_n", "_slots", "_counts")]
    for q, t, size, form, hits, n, slots, counts in zip(*columns, strict=True):
        yield Example(size, form, hits, np.cumsum(_read(slots, n, np.uint16), dtype=np.int32), _values(_read(counts, n, np.uint8), size)), _label(q, t)


def _sums(rows: DataFrame, count, width: int, length: int) -> np.ndarray:
    """Whole-number arrays (width, length) that ``count(batches)`` gives by task, summed on executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("sums")
        total = count(batches)
        at = np.flatnonzero(total.any(axis=0))
        for i in range(0, len(at), 50_000):
            some = at[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(x[some], pa.int64()) for x in total)], ["at", *(f"x{i}" for i in range(width))])

    names = [f"x{i}" for i in range(width)]
    got = rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("at", *names))).groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros((width, length), np.int64)
    for i, c in enumerate(names):
        out[i, got.column("at").to_numpy()] = got.column(c).to_numpy()
    return out


_CODES = 3 ** (len(STRUCTURE) + 1)  # bounds the vote patterns of a question


def _code(votes: list[int]) -> int:
    code = 0
    for v in votes:
        code = 3 * code + v + 1
    return code


def _votes(e: Example, label: tuple[int, int], stems: np.ndarray) -> tuple[list[int], list[int]]:
    share = float(e.values[stems[e.slots]].sum()) / 100
    return [*quality_votes(e.form, e.size), label[0]], [*toxic_votes(e.hits, share, e.size), label[1]]


def _train_all(features: DataFrame, n: int, epochs: int = 26, rate: float = 0.8, decay: float = 1e-5) -> Model:
    """What ``train`` does, on stored rows of any number."""
    slots = 1 << BITS

    def rates(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((5, slots + 1), np.int64)  # rows; rates and rows of those given as not toxic, and as toxic; last the rows in all
        for batch in batches:
            for e, (_, tox) in _stored(batch):
                out[0, e.slots] += 1
                if tox:
                    k = 1 if tox < 0 else 3
                    out[k, e.slots] += np.rint(e.values * np.float64(_PARTS)).astype(np.int64)
                    out[k + 1, e.slots] += 1
                    out[k + 1, slots] += 1
        return out

    sums = _sums(features, rates, 5, slots + 1)
    common_ = sums[0, :slots] >= LEAST_ROWS
    stems = np.zeros(slots, bool)
    stems[_marking(sums[[1, 3], :slots] / _PARTS, sums[[2, 4], :slots], sums[[2, 4], slots])] = True

    def patterns(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((2, _CODES), np.int64)
        for batch in batches:
            for e, label in _stored(batch):
                for h, votes in enumerate(_votes(e, label, stems)):
                    out[h, _code(votes)] += 1
        return out

    reliability = []
    for rows, width in zip(_sums(features, patterns, 2, _CODES), (len(quality_votes([0.0] * len(STRUCTURE), 1)) + 1, 3), strict=True):
        codes = np.flatnonzero(rows)
        votes = codes[:, None] // 3 ** np.arange(width)[::-1] % 3 - 1
        reliability.append(expectation_maximisation(votes, rows=rows[codes]))
    blocks = -(-n // BLOCK)

    def weights(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((2, slots + len(STRUCTURE) + 1), np.int64)
        block, at, size = [], None, 0

        def add() -> None:
            if block:
                votes = [_votes(e, label, stems) for e, label in block]
                target = np.stack([r.posterior(np.array([v[h] for v in votes])) for h, r in enumerate(reliability)])
                model = Model(np.zeros((2, slots)), np.zeros((2, len(STRUCTURE))), np.full(2, -2.0))
                _fit(model, [e.slots for e, _ in block], [e.values for e, _ in block], np.array([e.form for e, _ in block]), target, epochs, rate, decay, common_)
                out[:] += np.rint(np.hstack([model.words, model.structure, model.bias[:, None]]) * (len(block) * _WEIGHTS)).astype(np.int64)

        for batch in batches:
            for which, (e, label) in zip(batch.column("_block").to_pylist(), _stored(batch), strict=True):
                if which != at or len(block) >= 2 * BLOCK or size + len(e.slots) > BLOCK_FEATURES:
                    add()
                    block, at, size = [], which, 0
                block.append((e, label))
                size += len(e.slots)
        add()
        return out

    dealt = features.withColumn("_block", F.pmod("_h", F.lit(blocks))).repartition(4 * blocks, "_block")
    order = ["_block", "_th", "_h", F.coalesce("_q", F.lit(-1)), F.coalesce("_t", F.lit(-1))]
    total = _sums(dealt.sortWithinPartitions(*order), weights, 2, slots + len(STRUCTURE) + 1) / (n * _WEIGHTS)
    return Model(total[:, :slots].copy(), total[:, slots:-1].copy(), total[:, -1].copy(), reliability)


def _examples(rows: DataFrame, sample: int, most: int) -> list[tuple[Example, tuple[int | None, int | None]]]:
    """Features of the first rows (_id, _text, _q, _t) in the order of their hashes, within the bounds."""
    schema = T._parse_datatype_string(_EXAMPLE.format(id=rows.schema["_id"].dataType.simpleString()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = common.held("examples")
        for batch in common.batches_up_to(batches, 200):
            raw = common.texts(batch.column("_text"))
            made = [example(t, memory) for t in raw]
            th = np.array([xxhash.xxh64_intdigest(t.encode()) for t in raw], np.uint64).view(np.int64)
            columns = [pa.array([e.size for e in made], pa.int32()), pa.array([e.form for e in made], pa.list_(pa.float64())), pa.array([e.hits for e in made], pa.int32())]
            columns += [pa.array([len(e.slots) for e in made], pa.int32()), pa.array([e.slots.tobytes() for e in made], pa.binary()), pa.array([e.values.tobytes() for e in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(th), batch.column("_q"), batch.column("_t"), *columns], schema.names)

    written = common.write_table(rows.select("_id", "_text", "_q", "_t").mapInArrow(count, schema), "examples")
    keys = [F.xxhash64("_id").alias("_h"), F.col("_th"), F.coalesce("_q", F.lit(-1)).alias("_k"), F.coalesce("_t", F.lit(-1)).alias("_l")]
    first = written.select(*keys, "_n").orderBy("_h", "_th", "_k", "_l").limit(sample).collect()
    total, last, taken = 0, None, 0
    for r in first:
        total += r["_n"]
        if total > most:
            break
        last, taken = r, taken + 1
    if last is None:
        return []
    end = F.struct(*[F.lit(last[c]).cast(t).alias(c) for c, t in (("_h", "long"), ("_th", "long"), ("_k", "int"), ("_l", "int"))])
    some = written.where(F.struct(*keys) <= end).limit(taken).collect()
    some.sort(key=lambda r: (r["_th"] % (1 << 64), str(r["_id"]), str(r["_q"]), str(r["_t"])))  # the order in which rows arrive must not matter
    common.drop_table(written)
    return [(Example(r["_size"], r["_form"], r["_hits"], np.frombuffer(r["_slots"], np.int32), np.frombuffer(r["_values"], np.float32)), (r["_q"], r["_t"])) for r in some]


_SCORES = [T.StructField("low_quality", T.DoubleType()), T.StructField("toxic_score", T.DoubleType()), T.StructField("kept", T.BooleanType())]


def classify(df: DataFrame, model: Model, text: str = "text", low_at: float = 0.4, toxic_at: float = 0.3) -> DataFrame:
    """``df`` with ``low_quality`` and ``toxic_score`` (chances) and ``kept`` (both below their thresholds).

    A null or empty text has no words and is judged by its form alone.  Equal texts get equal scores.  Input columns
    with these names are replaced; an empty table gives an empty table.
    """
    import pickle

    schema = common.added(df.schema, _SCORES)
    sent = df.sparkSession.sparkContext.broadcast(model)
    key = xxhash.xxh64_hexdigest(pickle.dumps((model.words, model.structure, model.bias)))
    new = {f.name for f in _SCORES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = common.held(f"scorer {key}", lambda: sent.value.scorer()).score
        for batch in common.batches_up_to(batches, 1000):
            both = np.array([score(t) for t in common.texts(batch.column(text))]).reshape(-1, 2)
            columns = {f.name: batch.column(f.name) for f in schema.fields if f.name not in new}
            columns |= {"low_quality": pa.array(both[:, 0]), "toxic_score": pa.array(both[:, 1]), "kept": pa.array((both[:, 0] < low_at) & (both[:, 1] < toxic_at))}
            yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's id, scores (three places) and verdict."""
    model = fit(documents, labels)
    scored = classify(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", F.round("low_quality", 3).alias("low_quality"), F.round("toxic_score", 3).alias("toxic_score"), "kept")
