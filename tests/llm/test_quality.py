import random

import numpy as np

from palisade.llm import quality as Q

GOOD = [f"wort{i}" for i in range(300)] + ["and", "the", "of"]
BAD = ["idiot", "moron", "scum", "zork"]


def corpus(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = [r.choice(GOOD) for _ in range(r.randrange(30, 200))]
        quality, toxic = 1, 0
        if r.random() < 0.15:
            quality = 0
            words = [w + r.choice(["###", "$$$"]) for w in words] if r.random() < 0.5 else [w.upper() + "!!" for w in words]
        if r.random() < 0.15:
            toxic = 1
            for _ in range(max(4, len(words) // 20)):
                words[r.randrange(len(words))] = r.choice(BAD)
        rows.append((i, " ".join(words), quality, toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _, _ in rows], "doc_id long, text string, kept string").repartition(3)
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i % 2], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, labels)
    got = {r.doc_id: r for r in Q.classify(docs, model).collect()}
    held = [r for r in rows if r[0] % 2 == 0]
    assert sum((got[i].toxic_score >= 0.3) == bool(x) for i, _, _, x in held) / len(held) > 0.95
    assert sum((got[i].low_quality >= 0.4) != bool(q) for i, _, q, _ in held) / len(held) > 0.95
    assert isinstance(got[0].kept, bool)
    again = Q.fit(docs.repartition(5), labels)
    assert np.array_equal(model.words, again.words)


def test_labellers_alone(spark):
    rows = corpus(400, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.classify(docs, Q.fit(docs, none)).collect()}
    low = [got[i].low_quality for i, _, q, _ in rows if not q]
    good = [got[i].low_quality for i, _, q, _ in rows if q]
    assert np.median(low) > 0.5 > np.median(good)


def test_em_recovers_accuracies():
    r = np.random.default_rng(0)
    truth = r.random(5000) < 0.3
    votes = []
    for right, given in ((0.95, 1.0), (0.8, 0.6), (0.65, 0.9), (0.9, 0.7)):
        v = np.where(r.random(5000) < right, np.where(truth, 1, -1), np.where(truth, -1, 1))
        votes.append(np.where(r.random(5000) < given, v, 0))
    model = Q.expectation_maximisation(np.column_stack(votes))
    assert abs(model.prior - 0.3) < 0.05
    right = model.table[:, 1, 2] / (model.table[:, 1, 2] + model.table[:, 1, 0])
    assert np.allclose(right, [0.95, 0.8, 0.65, 0.9], atol=0.07)


def test_em_round_against_loops():
    r = random.Random(5)
    votes = [[r.choice((-1, 0, 1)) for _ in range(3)] for _ in range(200)]
    model = Q.expectation_maximisation(np.array(votes), rounds=3)
    q = []
    for v in votes:
        q.append(0.95 if v[2] > 0 else 0.05 if v[2] < 0 else 0.9 if sum(v) > 0 else 0.5 if 1 in v else 0.05)
    for _ in range(3):
        table = [[[0.5 + sum((p if t else 1 - p) for p, v in zip(q, votes) if v[j] == x) for x in (-1, 0, 1)] for t in (0, 1)] for j in range(3)]
        table = [[[c / sum(row) for c in row] for row in both] for both in table]
        prior = min(0.9, max(0.005, sum(q) / len(q)))
        after = []
        for v in votes:
            yes, no = prior, 1 - prior
            for j in range(3):
                yes, no = yes * table[j][1][v[j] + 1], no * table[j][0][v[j] + 1]
            after.append(yes / (yes + no))
        q = after
    assert abs(model.prior - prior) < 1e-9 and np.allclose(model.table, table)
    assert np.allclose(model.posterior(np.array(votes)), q)


def test_scorer_steps_against_loops():
    """Two epochs over 70 rows (two minibatches each) with plain dictionaries in place of arrays."""
    import math

    r = random.Random(6)
    rows = [Q.example(" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(r.randrange(5, 30))), {}) for _ in range(70)]
    target = np.array([[r.random() for _ in rows] for _ in range(2)])
    form = np.array([e.form for e in rows])
    model = Q.Model(np.zeros((2, 1 << Q.BITS)), np.zeros((2, len(Q.STRUCTURE))), np.full(2, -2.0))
    epochs, rate, decay = 8, 0.8, 1e-5
    rounds = -(-64 * 40 // len(rows))
    Q._fit(model, [e.slots for e in rows], [e.values for e in rows], form, target, epochs, rate, decay)
    order = np.random.default_rng(7)
    words, shape, bias = [{}, {}], [[0.0] * 8, [0.0] * 8], [-2.0, -2.0]
    sw, ss, sb = [{}, {}], [[1e-3] * 8, [1e-3] * 8], [1e-3, 1e-3]
    common = {s for e in rows for s in e.slots.tolist() if sum(s in f.slots for f in rows) >= Q.LEAST_ROWS}
    for epoch in range(epochs * rounds):
        p = order.permutation(len(rows)).tolist()
        for at in range(0, len(rows), 64):
            batch = p[at : at + 64]
            for h in (0, 1):
                error = []
                for i in batch:
                    z = bias[h] + sum(a * b for a, b in zip(shape[h], rows[i].form)) + sum(float(v) * words[h].get(s, 0.0) for s, v in zip(rows[i].slots.tolist(), rows[i].values) if s in common)
                    error.append((1 / (1 + math.exp(-z)) - target[h][i]) / len(batch))
                if epoch >= Q.FORM_EPOCHS * rounds:
                    g = {}
                    for i, e in zip(batch, error):
                        for s, v in zip(rows[i].slots.tolist(), rows[i].values):
                            if s in common:
                                g[s] = g.get(s, decay * words[h].get(s, 0.0)) + float(v) * e
                    for s, x in g.items():
                        sw[h][s] = sw[h].get(s, 1e-3) + x * x
                        words[h][s] = words[h].get(s, 0.0) - 0.2 * rate * x / math.sqrt(sw[h][s])
                for k in range(8):
                    x = sum(e * rows[i].form[k] for i, e in zip(batch, error)) + decay * shape[h][k]
                    ss[h][k] += x * x
                    shape[h][k] -= rate * x / math.sqrt(ss[h][k])
                x = sum(error)
                sb[h] += x * x
                bias[h] -= rate * x / math.sqrt(sb[h])
    for h in (0, 1):
        assert np.allclose(model.structure[h], shape[h], atol=1e-6) and abs(model.bias[h] - bias[h]) < 1e-6
        assert all(abs(model.words[h, s] - w) < 1e-6 for s, w in words[h].items())
        assert set(np.flatnonzero(model.words[h]).tolist()) <= set(words[h])


def test_sample_bounds(spark):
    rows = corpus(120, 3)
    docs = spark.createDataFrame([(i % 40, t) for i, t, _, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    joined = docs.selectExpr("doc_id _id", "text _text", "1 _q", "0 _t")
    assert len(Q._examples(joined, 50, 1 << 20)) == 50
    few = Q._examples(joined, 120, 2000)
    assert 0 < sum(len(e.slots) for e, _ in few) <= 2000 and len(few) < 120
    assert Q.fit(docs, labels, sample=10).words.shape == (2, 1 << Q.BITS)


def test_very_long_and_equal_texts(spark):
    model = Q.train([Q.example(t, {}) for _, t, _, _ in corpus(100, 9)], [(q, x) for _, _, q, x in corpus(100, 9)])
    long_ = "wort1 idiot " * 200_000
    df = spark.createDataFrame([(1, long_, 5), (2, long_, 6), (3, "wort1 idiot " * 200, 7)], "doc_id long, text string, toxic_score int")
    got = {r.doc_id: r for r in Q.classify(df, model).collect()}
    assert got[1].toxic_score == got[2].toxic_score and abs(got[1].toxic_score - got[3].toxic_score) < 0.05


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b c " * 30), (2, None), (None, ""), (2, "x\x00" * 10)], "doc_id long, text string")
    out = Q.digest(docs, labels).collect()
    assert len(out) == 4 and all(r.kept in (True, False) for r in out)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert Q.classify(empty, Q.train([], [])).collect() == []
    assert Q.digest(empty, labels).collect() == []


def test_stored_features(spark):
    texts = ["", "one", "wort1 idiot " * 300, " ".join(f"w{i}x" for i in range(3000)), "a b c"]
    rows = spark.createDataFrame([(i, t, None, i % 2) for i, t in enumerate(texts)], "_id long, _text string, _q int, _t int")
    want = {(e.size, e.hits, tuple(e.form), e.slots.tobytes(), e.values.tobytes()) for e in (Q.example(t, {}) for t in texts)}
    got = [e for b in Q._features(rows).toArrow().to_batches() for e, _ in Q._stored(b)]
    assert {(e.size, e.hits, tuple(e.form), e.slots.tobytes(), e.values.tobytes()) for e in got} == want


def test_all_labelled_rows_count(spark):
    """More rows than a sample had: accuracies as from all rows at once, weights as the blocks' average, whatever the order."""
    r = random.Random(13)
    texts = [" ".join(r.choice(GOOD[:40] + BAD) for _ in range(r.randrange(4, 20))) + r.choice(["", " ### $$$" * 4]) for _ in range(9000)]
    given = [(r.choice((0, 1, None)), int("idiot" in t)) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(given)], "doc_id long, quality int, toxic int")
    model = Q.fit(docs, labels)
    examples = [Q.example(t, {}) for t in texts]
    whole = Q.train(examples, given, epochs=0)
    for a, b in zip(model.reliability, whole.reliability, strict=True):
        assert np.allclose(a.table, b.table, atol=1e-9) and abs(a.prior - b.prior) < 1e-9
    stems = np.zeros(1 << Q.BITS, bool)
    stems[Q._marking_slots([e.slots for e in examples], [e.values for e in examples], np.array([1 if t else -1 for _, t in given]))] = True
    votes = [Q._votes(e, Q._label(*g), stems) for e, g in zip(examples, given, strict=True)]
    common_ = np.bincount(np.concatenate([e.slots for e in examples]), minlength=1 << Q.BITS) >= Q.LEAST_ROWS
    key = {x["doc_id"]: (x["b"], x["h"]) for x in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id), 3) b", "xxhash64(doc_id) h").collect()}
    th = [Q.xxhash.xxh64_intdigest(t.encode()) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: (key[i][0], th[i] - 2**64 * (th[i] >= 2**63), key[i][1]))
    words = 0
    for b in range(3):
        rows = [i for i in order if key[i][0] == b]
        target = np.stack([m.posterior(np.array([votes[i][h] for i in rows])) for h, m in enumerate(whole.reliability)])
        part = Q.Model(np.zeros((2, 1 << Q.BITS)), np.zeros((2, len(Q.STRUCTURE))), np.full(2, -2.0))
        some = [examples[i] for i in rows]
        Q._fit(part, [e.slots for e in some], [e.values for e in some], np.array([e.form for e in some]), target, 26, 0.8, 1e-5, common_)
        words = words + part.words * len(rows) / len(texts)
    assert np.allclose(model.words, words, atol=1e-6)
    assert np.array_equal(Q.fit(docs.repartition(3), labels).words, model.words)


def test_texts_stay_where_they_lie(spark, monkeypatch):
    """Features are counted below every exchange, and those of the rows that an inner join finds are stored."""
    plans = []

    def write(df, name, write_table=Q.common.write_table, **more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write_table(df, name, **more)

    monkeypatch.setattr(Q.common, "write_table", write)
    monkeypatch.setattr(Q, "_train_all", lambda features, n: [(r._size, r._q, r._t) for r in features.collect()])
    docs = spark.createDataFrame([(None if i == 7 else i, "wort " * (i + 1)) for i in range(3000)], "doc_id int, text string").repartition(3)
    given = [(5, 1, 0), (5, 0, None), (9, None, 1), (2999, 1, 1), (None, 1, 1), (7, 1, 1), (1 << 40, 1, 0)]
    found = Q.fit(docs, spark.createDataFrame(given, "doc_id long, quality int, toxic int"))
    assert {(6, 1, 0), (6, 0, None), (10, None, 1), (3000, 1, 1)} == set(found) and len(found) == 4
    assert plans[0].index("Exchange") < plans[0].index("MapInArrow")
