import random

import numpy as np
import pytest

import corpus_pipeline as C
from palisade.llm import common

public = pytest.importorskip("public_tokenizers")

INSULTS = ["idiot", "moron", "scum", "trash", "pathetic"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted(seed=5):
    """Documents and what is planted: toxic, junk, copies (near and exact) and a passage, with clean ones around."""
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("lo", "ra", "mi", "ten", "su", "ver", "qua", "dol") for b in ("rem", "tis", "na", "lor", "pe", "gum", "xi", "bat", "or", "um")]
    prose = lambda n: " ".join(r.choice(words) + (str(r.randrange(90)) if r.random() < 0.3 else "") for _ in range(n))
    docs, kinds = [], []

    def add(text, kind):
        docs.append(text)
        kinds.append(kind)

    passage = prose(70)
    for i in range(260):
        k = i % 13
        body = prose(r.randrange(60, 200))
        if k == 0:
            w = body.split()
            for _ in range(len(w) // 15):
                w[r.randrange(len(w))] = r.choice(INSULTS)
            add(" ".join(w), "toxic")
        elif k == 1:
            add(" ".join(w + r.choice(["###", "$$$", "%%%"]) for w in body.split()), "junk")
        elif k == 2 and i > 30:
            add(docs[3], "copy")
        elif k == 5 and i > 30:
            w = docs[4].split()
            w[r.randrange(len(w))] = "changed"
            add(" ".join(w), "near")
        elif k == 7:
            add(f"{body[:200]}\n{passage}\n{prose(40)}", "passage")
        elif k == 9:
            add(f'{body} token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}" end', "secret")
        else:
            add(body, "clean")
    labels = [(i, int(kinds[i] != "junk"), int(kinds[i] == "toxic")) for i in range(0, len(docs), 2)]
    return docs, kinds, labels, passage


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, kinds, labels, passage = planted()
    folder = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    out, df = [], spark.read.parquet(str(folder / "documents.parquet"))
    for name, stage in C.STAGES:
        df = common.write_table(stage(spark, df, str(folder)), name.replace(" ", "-"))
        out.append({"name": name, "columns": df.columns, "rows": df.collect()})
    return docs, kinds, passage, out, str(folder)


def test_stages_have_effect(stages):
    docs, kinds, passage, out, _ = stages
    quality, near, repeats, secret, packed = out
    assert all(s["columns"] == ["doc_id", "text", "lang", "source", "n_chars"] for s in out[:4])
    kept = {r.doc_id for r in quality["rows"]}
    assert not any(kinds[i] == "junk" for i in kept) and sum(kinds[i] == "toxic" for i in kept) <= 1
    good = [i for i, k in enumerate(kinds) if k not in ("junk", "toxic")]
    assert sum(i not in kept for i in good) <= 0.02 * len(good)
    after = {r.doc_id for r in near["rows"]}
    copies = [i for i, k in enumerate(kinds) if (k in ("copy", "near") or i in (3, 4)) and i in kept]
    assert after == kept - set(copies) | {3, 4}
    cut = {r.doc_id: r for r in repeats["rows"]}
    assert cut.keys() == after
    assert not [i for i, r in cut.items() if passage[100:-100] in r.text]
    assert not [i for i, r in cut.items() if r.n_chars != len(r.text)]
    assert not [i for i in after if kinds[i] in ("clean", "secret") and cut[i].text != docs[i]]
    final = {r.doc_id: r.text for r in secret["rows"]}
    assert not [i for i, t in final.items() if ("[SECRET]" in t and "token =" not in t) != (kinds[i] == "secret")]


def test_packing_holds_every_token(stages):
    from palisade.llm.packing import encoder

    *_, out, _ = stages
    encode = encoder(public.path("word_bpe_49k.json")).encode
    pieces = {}
    for r in out[4]["rows"]:
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(bytes(r.ids), "<u4")))
    for r in out[3]["rows"]:
        got = np.concatenate([ids for _, ids in sorted(pieces[r.doc_id], key=lambda p: p[0])])
        assert got.tobytes() == encode([r.text])[0] + b"\1\0\0\0"


def test_run_gives_the_last_stage(spark, stages):
    *_, out, folder = stages
    key = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    got = C.run(spark, folder).collect()
    assert sorted({(r.doc_id, r.doc_tokens) for r in got}) == sorted({(r.doc_id, r.doc_tokens) for r in out[4]["rows"]})
    assert len(key(got)) >= len({r.doc_id for r in got})


def test_odd_rows_pass_all_stages(spark, stages):
    *_, folder = stages
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (None, "x y", "en", "s", 3), (4, "w " * 3000, "en", "s", 6000), (4, "w " * 3000, "en", "s", 6000), (5, "é" * 300, "en", "s", 300)]
    df = spark.createDataFrame(rows, SCHEMA)
    for _, stage in C.STAGES[1:]:
        df = common.write_table(stage(spark, df, folder), "odd")
    assert df.count() >= 4
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in C.STAGES:
        empty = common.write_table(stage(spark, empty, folder), "none")
    assert empty.count() == 0
