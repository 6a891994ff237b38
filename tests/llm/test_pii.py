import hashlib
import random
import re
import time

from palisade.llm import pii as P


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def slow(text):
    t = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def texts():
    r = random.Random(3)
    parts = ["a@b.c", "x.y%z@d-e.com", "_d@e.f", "@", ".", "é", "\U0001f600", " ", "-", "4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "010.0.0.255", "+1 (555) 010-9999",
             "+49", "12", "5", "(", "tel ", "mail: ", "\n", "joe [at] host [dot] com", "555-123-4567", "378282246310005", "a" * 30, "+", "1111111111111117"]
    out = ["".join(r.choice(parts) for _ in range(r.randrange(0, 14))) for _ in range(400)]
    out += ["", None, "1" * 20000, "a" * 50000 + "@", "1.2.3.4.5.6.7.8", "1 " * 9000, "a@b.c_d@e.f", "a@b..c", "4" * 16 + " " + "4" * 16, "+" * 500 + "1 1"]
    return out


def test_base_against_loops(spark):
    docs = texts()
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(docs)], "doc_id long, text string, found string")
    for r in P.digest(df).collect():
        want = slow(docs[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (docs[r.doc_id], joined, r.spans)
        assert tuple(sum(k == x[0] for x in want) for k in P.KINDS) == (r.n_email, r.n_ip, r.n_card, r.n_phone)
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_classifier_adds_what_labellers_support(spark):
    docs = [f"please mail joe{i}@host.com or call +1 (555) 010-99{i:02d}, pay by card 4111 1111 1111 1111, from ip 10.0.0.{i} ok" for i in range(40)]
    docs += ["write by mail to ann [at] example [dot] org now", "call me by phone 555-123-4567 today", "order 1234567890123456 shipped", "so 4539578763621487 it, is"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r for r in P.digest(df).collect()}
    assert got[40].spans.startswith("email:") and got[41].spans.startswith("phone:") and got[42].spans == "" and got[43].spans == ""
    assert got[40].n_email == 0


def test_added_spans_on_planted_data(spark):
    """Spans that only the method can find, with decoys of like form: recall and precision of what it adds."""
    r = random.Random(14)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    word = lambda: pick("abcdefghij", r.randrange(3, 9))
    prose = lambda: " ".join(word() for _ in range(r.randrange(4, 12)))
    digits = lambda n: pick("0123456789", n)

    def amex():
        d = "37" + digits(12)
        return next(d + c for c in "0123456789" if luhn(d + c))

    good = [
        lambda: ("please write to", f"{word()} [at] {word()} [dot] org"),
        lambda: ("contact me by mail", f"{word()} at {word()} dot com"),
        lambda: ("call", f"0049 30 {pick('123456789', 7)}"),
        lambda: ("my phone is", f"{pick('23456789', 3)}-{pick('23456789', 3)}-{digits(4)}"),
        lambda: ("Telefon", f"0171 {pick('123456789', 7)}"),
        lambda: ("paid by card", amex()),
        lambda: ("from the server", ":".join(pick("0123456789abcdef", 4) for _ in range(8))),
    ]
    bad = [
        lambda: ("in section", f"{pick('01', 1)}{digits(2)}-{digits(3)}-{digits(4)}"),
        lambda: ("the invoice", next(d for d in iter(lambda: "1" + digits(14), None) if not luhn(d))),
        lambda: ("as version", f"x{digits(3)}-{digits(3)}-{digits(4)}y"),
    ]
    docs, want = [], []
    for i in range(600):
        cue, span = r.choice(good if r.random() < 0.5 else bad)() if i % 3 == 0 else ("", "")
        base = f" mail a{i}@b.com and phone +1 (555) 010-{digits(4)}" if i % 3 == 1 else ""
        docs.append(f"{prose()} {cue} {span} {prose()}{base}")
        want.append((docs[-1].index(span), len(span)) if cue in {"please write to", "contact me by mail", "call", "my phone is", "Telefon", "paid by card", "from the server"} else None)
    got = {x.doc_id: [s for s in x.pii if not s.base] for x in P.find(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    planted = [i for i, w in enumerate(want) if w]
    right = sum(any(s.s <= want[i][0] and s.e >= want[i][0] + want[i][1] for s in got[i]) for i in planted)
    added = sum(map(len, got.values()))
    assert len(planted) > 80 and right >= 0.9 * len(planted), (right, len(planted))
    assert right >= 0.9 * added, (right, added)


def test_very_long_texts(spark):
    """Thousands of spans in one text, base and added ones: places against loops, and no squared cost."""
    n = 9000
    docs = ["".join(f"from 10.0.{i % 256}.{i // 256} on " for i in range(n)), "".join(f"call 555-123-{i:04d} or a{i}@b.com " for i in range(n)), "7" * 8000]
    began = time.perf_counter()
    got = {r.doc_id: r for r in P.digest(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert time.perf_counter() - began < 90
    assert (got[0].n_ip, got[1].n_email) == (n, n)
    for i in range(3):
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in slow(docs[i]))
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    added = [x for x in got[1].spans.split(",") if x.startswith("phone")]
    assert added == [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"555-123-[0-9]{4}", docs[1])]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a@b.com", "x", 2, 3)], "doc_id long, text string, found string, _base int, pii int")
    assert P.digest(df).first().n_email == 1


def test_native_and_empty(spark):
    out = P.digest(spark.createDataFrame([], "doc_id long, text string"))
    assert out.collect() == []
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_em_finds_the_bad_labeller():
    r = random.Random(1)
    counts = {}
    for _ in range(4000):
        truth = r.random() < 0.6
        good = lambda p: 1 if (r.random() < p) == truth else -1
        v = (good(0.95), good(0.9), good(0.85), good(0.5))
        counts[v] = counts.get(v, 0) + 1
    model = P.fit([(1, v, c) for v, c in sorted(counts.items())])
    table = model.reliability[1]
    assert table[0][1][2] > 0.85 and abs(table[3][1][2] - 0.5) < 0.1
    assert abs(model.weights[0][4]) < 0.3 < model.weights[0][1]
