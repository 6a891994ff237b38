"""Secret scans by grammar inference.

Regular expressions find base spans, which always stay.  Their values are labelled credentials, and all distinct ones count.
A probabilistic automaton per kind is merged from their prefix tree, whose nodes are only looked at where the automaton is
left: in each round all credentials are run through what there is of it, and what follows its states, and the nodes one
symbol beyond them, is counted on executors.  A node is merged into the first state whose futures are statistically alike
(Hoeffding's bound) or becomes a state.  The tree itself is never built, so the driver holds counts by state, however many
credentials there are.  Every token of every text that is as long as a kind's credentials
is then scored by its likelihood per character under the automaton, against the plain chances of characters in tokens; tokens
that an automaton explains as well as it does its own credentials, and better than as plain text, are spans too.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of fewer characters are dropped, and a run is matched from its start
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+")
MARK = "[SECRET]"
LEAST = 20  # credentials of a kind; fewer say too little about a format


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, number of the kind, credential), by start and then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), 0, m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(out)


# ---------------------------------------------------------------- automata


def symbol(c: str) -> str:
    """Class of a character: digit, letters to f and after it by case, or itself."""
    if "0" <= c <= "9":
        return "0"
    if "a" <= c <= "z":
        return "a" if c <= "f" else "g"
    if "A" <= c <= "Z":
        return "A" if c <= "F" else "G"
    return c


#: Characters in each class; a class's chance is shared out among them.
SIZES = {"0": 10, "a": 6, "g": 20, "A": 6, "G": 20}


_UNSEEN = 0.001


#: Classes by number; 0 is the end.  A code of a place is ``state * CLASSES``, and the node beyond it by class c has c more.
NAMES = "\0" + "0agAG" + "+/_.=-"
CLASSES = len(NAMES)
AHEAD = 12  # places ahead whose classes are compared, one by one; those of the next two also as a pair
MOST_STATES = 200  # of an automaton; nodes beyond join the state that they are most like
_PIECE = 100_000
_FUTURE = AHEAD * CLASSES
_WIDTH = _FUTURE + CLASSES * CLASSES
_CODES = bytes(NAMES.index(symbol(c)) if symbol(c) in NAMES else 0 for c in map(chr, range(256)))


def futures(to: list[dict[int, int]], values: Iterable[str]) -> dict[int, np.ndarray]:
    """How often each class comes at each place ahead, and each pair of classes next, by code of the places where ``values`` get."""
    table = [[row.get(c, -1) for c in range(CLASSES)] for row in to]
    sums: dict[int, np.ndarray] = {}
    pieces: list[bytes] = []
    places: list[int] = []
    offsets: list[int] = []
    size = 0

    def add() -> None:
        if not places:
            return
        symbols = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        codes, row = np.unique(np.array(places), return_inverse=True)
        ahead = symbols[np.array(offsets)[:, None] + np.arange(AHEAD)]
        single = np.bincount((row[:, None] * _FUTURE + np.arange(AHEAD) * CLASSES + ahead).ravel(), minlength=len(codes) * _FUTURE)
        pair = np.bincount(row * CLASSES**2 + ahead[:, 0] * CLASSES + ahead[:, 1], minlength=len(codes) * CLASSES**2)
        both = np.hstack([single.reshape(len(codes), -1), pair.reshape(len(codes), -1)])
        for c, counts in zip(codes.tolist(), both, strict=True):
            sums[c] = sums[c] + counts if c in sums else counts

    for value in values:
        run = value.encode("latin-1", "replace").translate(_CODES) + bytes(1)  # the end stands where a value has been left, too
        at = 0
        for i in range(0, len(run), _PIECE):
            piece = run[i : i + _PIECE]
            pieces.append(run[i : i + len(piece) + AHEAD].ljust(len(piece) + AHEAD, b"\0"))
            left = False
            for c in piece:
                places.append(at * CLASSES)
                after = table[at][c]
                if after < 0:
                    left = True
                    if c:
                        places.append(at * CLASSES + c)
                    break
                at = after
            offsets += range(size, size + len(places) - len(offsets))
            size += len(piece) + AHEAD
            if size > _PIECE:
                add()
                pieces, places, offsets, size = [], [], [], 0
            if left:
                break
    add()
    return sums


def _excess(x: np.ndarray, y: np.ndarray) -> float:
    """By how much the most different of two places' chances differ, as a multiple of the bound."""
    n1, n2 = int(x[:CLASSES].sum()), int(y[:CLASSES].sum())
    return float(np.abs(x / n1 - y / n2).max() / (_BOUND * (n1**-0.5 + n2**-0.5)))


_BOUND = math.sqrt(0.5 * math.log(2 * _WIDTH / 0.05))  # one chance in 20 is shared by all that is compared

Counts = dict[int, dict[int, np.ndarray]]


def infer(kinds: list[int], count: Callable[[dict[int, list[dict[int, int]]]], Counts]) -> dict[int, Automaton]:
    """Automata of all kinds at once; ``count`` gives the futures of all credentials by kind for the transitions so far.

    A round takes all nodes one symbol beyond the states, in the order of states and classes.
    """
    to: dict[int, list[dict[int, int]]] = {k: [{}] for k in kinds}
    done: dict[int, Automaton] = {}
    while len(done) < len(kinds):
        counts = count({k: t for k, t in to.items() if k not in done})
        for k in kinds:
            if k in done:
                continue
            places, rows = counts.get(k, {}), to[k]
            states = [places[q * CLASSES] for q in range(len(rows)) if q * CLASSES in places]
            nodes = sorted(c for c in places if c % CLASSES)
            if not nodes:
                done[k] = Automaton.of(rows, states)
                continue
            for node in nodes:
                alike = (i for i, s in enumerate(states) if _excess(s, places[node]) < 1)
                found = next(alike, None)
                if found is None and len(states) >= MOST_STATES:
                    found = min(range(len(states)), key=lambda i: _excess(states[i], places[node]))
                if found is None:
                    found = len(states)
                    rows.append({})
                    states.append(places[node])
                else:
                    states[found] = states[found] + places[node]
                rows[node // CLASSES][node % CLASSES] = found
    return done


@dataclass
class State:
    seen: int = 0
    final: int = 0
    to: dict[str, int] = field(default_factory=dict)
    count: Counter = field(default_factory=Counter)


class Automaton:
    """Probabilistic automaton; from credentials at hand, or ``of`` transitions and counted futures of its states."""

    def __init__(self, values: list[str]):
        self.states = infer([0], lambda to: {0: futures(to[0], values)})[0].states if values else [State()]
        self.marks = "".join(sorted({c for v in values for c in v if not c.isalnum()}))
        self.lengths = (min(map(len, values), default=0), max(map(len, values), default=0))
        # the least likely hundredth of the credentials sets the bar
        scores = sorted(self.score(v) for v in values)
        self.bar = scores[len(scores) // 100] if scores else math.inf

    @classmethod
    def of(cls, to: list[dict[int, int]], counts: list[np.ndarray]) -> Automaton:
        new = cls([])
        new.states = [
            State(int(n[:CLASSES].sum()), int(n[0]), {NAMES[c]: t for c, t in row.items()}, Counter({NAMES[c]: int(n[c]) for c in row}))
            for row, n in zip(to, counts, strict=True)
        ]
        return new

    def score(self, value: str) -> float:
        """Log likelihood per character; a transition never seen costs as one in a thousand of the state's visits, and stays there."""
        at, total = 0, 0.0
        for ch in value:
            c = symbol(ch)
            s = self.states[at]
            if c not in s.to:
                total += math.log(_UNSEEN / SIZES.get(c, 1))
                continue
            total += math.log(s.count[c] / s.seen / SIZES.get(c, 1))
            at = s.to[c]
        s = self.states[at]
        return (total + math.log((s.final + _UNSEEN) / (s.seen + _UNSEEN))) / max(1, len(value))


class Plain:
    """Chances of a token's characters, each after the one before it, as counted in texts; unseen ones share one count in all."""

    def __init__(self, pairs: dict[str, int]):
        self.pairs = pairs
        self.after: Counter = Counter()
        for p, n in pairs.items():
            self.after[p[0]] += n

    def score(self, value: str) -> float:
        """Log likelihood per character; a space stands before and after a token."""
        whole = f" {value} "
        chances = ((self.pairs.get(p, 0) + 1 / _CHARACTERS) / (self.after[p[0]] + 1) for p in map("".join, itertools.pairwise(whole)))
        return sum(map(math.log, chances)) / max(1, len(value))


_CHARACTERS = 69  # that a token can have, and its end


@dataclass
class Grammar:
    """Automata by number of kind, and the plain chances of characters in tokens.

    A kind's candidates are the runs of letters, digits and those marks that its credentials have, from the length of the shortest one on.
    """

    automata: dict[int, Automaton]
    plain: Plain

    def __post_init__(self) -> None:
        alike: dict[tuple[str, int], list[int]] = {}
        for k, a in sorted(self.automata.items()):
            alike.setdefault((a.marks, max(1, a.lengths[0])), []).append(k)
        self.runs = [(re.compile(f"[A-Za-z0-9{re.escape(marks)}]{{{least},}}"), least, kinds) for (marks, least), kinds in alike.items()]

    def kind(self, token: str, kinds: list[int] | None = None) -> tuple[float, int] | None:
        """Score and number of the kind whose automaton explains a token best and well enough."""
        scores = [(a.score(token), k, a.bar) for k, a in sorted(self.automata.items()) if kinds is None or k in kinds]
        good = [(score, -k) for score, k, bar in scores if score >= bar]
        if not good or max(good)[0] <= self.plain.score(token):
            return None
        return max(good)[0], -max(good)[1]


class Taken:
    """Stretches of a text that are taken, disjoint and in order, so that a search tells whether a span meets one."""

    def __init__(self, spans: list[tuple]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b, *_ in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect.bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b

    def add(self, a: int, b: int) -> None:
        """A span that meets none."""
        i = bisect.bisect_right(self.ends, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def learned_spans(text: str, base: list[tuple[int, int, int, str]], grammar: Grammar) -> list[tuple[int, int, int]]:
    """Candidates outside the base spans that the grammar knows; of overlapping ones the longest, then the likeliest.

    A run that isn't known may still be known without the marks around it (a sentence's full stop).
    """
    found = []
    for run, least, kinds in grammar.runs:
        for m in run.finditer(text):
            a, b = m.span()
            inner = a + len(m[0]) - len(m[0].lstrip(_MARKS)), b - len(m[0]) + len(m[0].rstrip(_MARKS))
            for x, y in {(a, b), inner}:
                if y - x >= least and (best := grammar.kind(text[x:y], kinds)):
                    found.append((x - y, -best[0], x, y, best[1]))
    out: list[tuple[int, int, int]] = []
    taken = Taken(base)
    for _, _, a, b, k in sorted(found):
        if not taken.meets(a, b):
            taken.add(a, b)
            out.append((a, b, k))
    return sorted(out)


_MARKS = "+/_.=-"


_CHUNK = 1 << 26  # characters of texts whose tokens a task counts before it hands them on
_CHUNK_TOKENS = 200_000


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Credentials (by number of kind) and tokens outside base spans (kind TOKENS), with the number of texts and, of the hashes of
    those texts, the least and the greatest (of more than one text in a chunk: the least and greatest of all)."""
    common.held("secrets")
    names = ["kind", "value", "n", "lo", "hi"]
    found: set[tuple[int, str]] = set()
    once: Counter = Counter()
    again: Counter = Counter()
    last: dict[str, int] = {}
    texts: set[int] = set()
    size = 0

    def chunk() -> pa.RecordBatch:
        values = [v for _, v in found] + list(once)
        many = [n > 1 for n in once.values()]
        n = [1] * len(found) + [c + again[t] for t, c in once.items()]
        lo = [0] * len(found) + [-(2**63) if m else last[t] for t, m in zip(once, many, strict=True)]
        hi = [0] * len(found) + [2**63 - 1 if m else last[t] for t, m in zip(once, many, strict=True)]
        kinds = [k for k, _ in found] + [TOKENS] * len(once)
        types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((kinds, values, n, lo, hi), types, strict=True)], names)

    for batch in common.batches_up_to(batches, 1000):
        for t in common.texts(batch.column(0)):
            base = base_spans(t)
            if base:
                found.update((k, v) for _, _, k, v in base)
                taken = Taken(base)
                tokens = {m[0] for m in TOKEN.finditer(t) if not taken.meets(*m.span())}
            else:
                tokens = set(TOKEN.findall(t))
            h = xxhash.xxh64_intdigest(t.encode()) - 2**63
            if h in texts:
                again.update(tokens)
            else:
                texts.add(h)
                once.update(tokens)
                last.update(dict.fromkeys(tokens, h))
            size += len(t)
            if size > _CHUNK or len(once) > _CHUNK_TOKENS:
                yield chunk()
                size = 0
                for held in (found, once, again, last, texts):
                    held.clear()
    yield chunk()


TOKENS = len(KINDS)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs: Counter = Counter()
    for batch in batches:
        for token, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for p in itertools.pairwise(f" {token} "):
                pairs["".join(p)] += n
    yield pa.RecordBatch.from_pydict({"pair": pa.array(list(pairs), pa.string()), "n": pa.array(list(pairs.values()), pa.int64())})


def fit(df: DataFrame, text: str = "text") -> Grammar:
    """Infer the automata from all distinct credentials of each kind, and the plain chances from the tokens outside base spans of all
    texts, each once a text; a token of one text alone, or of copies of it, may be a credential and isn't counted.

    A kind of fewer than LEAST credentials has no automaton.  The driver gets counts by state and pairs of characters.
    """
    same = df.select(text).mapInArrow(_values, "kind int, value string, n long, lo long, hi long")
    counted = same.groupBy("kind", "value").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = common.write_table(counted.where(f"kind < {TOKENS} or lo <> hi").drop("lo", "hi"), "tokens")
    credentials = common.write_table(found.where(F.col("kind") < TOKENS).select("kind", "value"), "credentials")
    about = [F.count("*").alias("n"), F.min(F.length("value")).alias("least"), F.max(F.length("value")).alias("most")]
    about += [F.max(F.instr("value", c) > 0).alias(f"mark{i}") for i, c in enumerate(_MARKS)]
    rows = {r["kind"]: r for r in credentials.groupBy("kind").agg(*about).collect() if r["n"] >= LEAST}
    automata = infer(sorted(rows), lambda to: _counts(credentials, to))
    for k, a in automata.items():
        a.marks = "".join(sorted(c for i, c in enumerate(_MARKS) if rows[k][f"mark{i}"]))
        a.lengths = (rows[k]["least"], rows[k]["most"])
    for k, bar in _bars(credentials, automata, {k: r["n"] for k, r in rows.items()}).items():
        automata[k].bar = bar  # the least likely hundredth of the credentials sets it
    common.drop_table(credentials)
    pairs: dict[str, int] = {}
    if automata:
        pairs = {r["pair"]: r["n"] for r in found.where(F.col("kind") == TOKENS).select("value", "n").mapInArrow(_pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    common.drop_table(found)
    return Grammar(automata, Plain(pairs))


def _counts(credentials: DataFrame, to: dict[int, list[dict[int, int]]]) -> Counts:
    """Futures of all credentials, summed by kind and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values: dict[int, list[str]] = {}
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values.setdefault(k, []).append(v)
            for k, some in values.items():
                if k not in to:
                    continue
                sums = futures(to[k], some)
                for code, counts in sums.items():
                    at = np.flatnonzero(counts)
                    columns = [pa.array(np.full(len(at), x), t) for x, t in ((k, pa.int32()), (code, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["kind", "place", "at", "n"])

    got = credentials.mapInArrow(run, "kind int, place int, at int, n long").groupBy("kind", "place", "at").agg(F.sum("n").alias("n")).toArrow()
    out: Counts = {}
    for k, place, at, n in zip(*(got.column(i).to_pylist() for i in range(4)), strict=True):
        places = out.setdefault(k, {})
        if place not in places:
            places[place] = np.zeros(_WIDTH, np.int64)
        places[place][at] = n
    return out


def _bars(credentials: DataFrame, automata: dict[int, Automaton], n: dict[int, int]) -> dict[int, float]:
    """Of each kind the score at which, in ascending order, a hundredth of the credentials lies below: found exactly, 16 bits at a time."""
    if not automata:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(0).to_pylist()
            pairs = [(k, -automata[k].score(v)) for k, v in zip(kinds, batch.column(1).to_pylist(), strict=True) if k in automata]
            cost = np.abs(np.array([c for _, c in pairs], np.float64))  # not negative, so its bits are in its order
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.int32()), pa.array(cost.view(np.int64))], ["kind", "cost"])

    costs = common.write_table(credentials.mapInArrow(run, "kind int, cost long"), "costs")
    left = {k: n[k] // 100 for k in automata}  # costs above the one that is sought
    head = dict.fromkeys(automata, 0)
    for shift in (48, 32, 16, 0):
        among = F.lit(False)
        for k, h in head.items():
            among |= (F.col("kind") == k) & ((F.shiftrightunsigned("cost", shift + 16) == h) if shift < 48 else F.lit(True))
        bins: dict[int, dict[int, int]] = {}
        for r in costs.where(among).groupBy("kind", F.shiftright("cost", shift).alias("bin")).count().collect():
            bins.setdefault(r["kind"], {})[r["bin"]] = r["count"]
        for k, some in bins.items():
            for b in sorted(some, reverse=True):
                if left[k] < some[b]:
                    head[k] = b
                    break
                left[k] -= some[b]
    common.drop_table(costs)
    return {k: -float(np.int64(h).view(np.float64)) for k, h in head.items()}


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("base", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))


def all_spans(text: str, grammar: Grammar) -> list[tuple[int, int, int, bool]]:
    base = base_spans(text)
    return sorted([(a, b, k, True) for a, b, k, _ in base] + [(a, b, k, False) for a, b, k in learned_spans(text, base, grammar)], key=lambda x: (x[0], x[2]))


def find(df: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """``df`` with ``secrets`` (array of struct<start,end,kind,base>, code points) and ``redacted``, the text with each run of
    overlapping spans replaced by MARK.

    A null text stays null and has none, an empty one too; equal texts have equal spans; input columns with these
    names are replaced; an empty table gives an empty table.
    """
    schema = common.added(df.schema, [T.StructField("secrets", _SPANS), T.StructField("redacted", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches_up_to(batches, 1000):
            raw = batch.column(text).to_pylist()
            spans = [all_spans(t or "", grammar) for t in raw]
            columns = {f.name: batch.column(f.name) for f in schema.fields if f.name not in ("secrets", "redacted")}
            columns["secrets"] = pa.array([[{"start": a, "end": b, "kind": KINDS[k], "base": x} for a, b, k, x in row] for row in spans], _ARROW)
            columns["redacted"] = pa.array([t if not s else redact(t, s) for t, s in zip(raw, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    out, at = [], 0
    for a, b, *_ in sorted(spans):
        if a >= at:
            out += [text[at:a], MARK]
        at = max(at, b)
    return "".join([*out, text[at:]])


_DIGEST = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns."""
    grammar = fit(df)

    def row(text: str) -> tuple:
        spans = all_spans(text, grammar)
        base = [x for x in spans if x[3]]
        joined = [",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k, _ in some) for some in (base, spans)]
        count = Counter(k for _, _, k, _ in base)
        return count[0], count[1], count[2], hashlib.sha256(joined[0].encode()).hexdigest(), joined[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches_up_to(batches, 1000):
            columns = list(zip(*map(row, common.texts(batch.column("text"))), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", *(x.split()[0] for x in _DIGEST.split(", "))])

    schema = T.StructType([df.schema["doc_id"], *T._parse_datatype_string(_DIGEST).fields])
    return df.select("doc_id", "text").mapInArrow(run, schema)
