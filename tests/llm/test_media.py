import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa

from palisade.llm import media as M


def test_digest_round_trip(spark):
    texts = ["", None, "a", "é" * 40, "x" * 64, "hello " * 5000, "x" * 64]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in M.digest(df).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = b + bytes(64 if not b else -len(b) % 64)
        out = io.BytesIO()
        w = wave.open(out, "wb")
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000)
        w.writeframes(p)
        w.close()
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
    assert rows[0][1:] == rows[1][1:] and rows[4][1:] == rows[6][1:]


def test_columns_hold_tensors_and_spans(spark):
    df = spark.createDataFrame([(1, "speech " * 900, 3), (2, None, 4)], "doc_id long, text string, media int")
    rows = {r.doc_id: r for r in M.audio_columns(df).collect()}
    table = pa.ipc.open_stream(bytes(rows[1].mel)).read_all()
    assert table.schema.field("mel").type.shape == [64, 20]
    assert table.column("start_s")[0].as_py() == 0 and table.num_rows > 1
    assert M.load(bytes(rows[1].media))[0].rstrip(b"\0") == b"speech " * 900
    assert rows[2].feature.startswith("frames=1;")
    assert M.audio_columns(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_resampling_against_direct_sum():
    r = np.random.default_rng(0)
    x = r.standard_normal(500).astype(np.float32)
    for source, target in ((8000, 4000), (8000, 6000), (4000, 8000), (8000, 5000)):
        from math import gcd

        g = gcd(source, target)
        up, down, taps = target // g, source // g, 8
        n = 2 * taps * max(up, down) + 1
        t = np.arange(n) - (n - 1) / 2
        cut = 1 / max(up, down)
        h = cut * np.sinc(cut * t) * np.hanning(n + 2)[1:-1]
        h *= up / h.sum()
        spaced = np.zeros(len(x) * up)
        spaced[::up] = x
        want = np.convolve(spaced, h)[(n - 1) // 2 :][: len(x) * up : down]
        got = M.resample(x, source, target, taps)
        assert len(got) == -(-len(x) * up // down)
        assert np.allclose(got[: len(want)], want, atol=1e-4)


def test_hysteresis_by_loop():
    r = np.random.default_rng(1)
    for _ in range(50):
        db = r.integers(-5, 6, 60).astype(float)
        on, spans, start = False, [], 0
        for i, v in enumerate(db):
            if not on and v >= 3:
                on, start = True, i
            elif on and v < -3:
                on = False
                spans.append((start, i))
        if on:
            spans.append((start, len(db)))
        assert M.hysteresis(db, 3, -3) == spans


def test_blocks_do_not_matter(monkeypatch):
    x = np.random.default_rng(2).standard_normal(40000).astype(np.float32)
    whole = M.log_mel(x, 4000, M.AudioParams())
    monkeypatch.setattr(M, "_BLOCK", 97)
    parts = M.log_mel(x, 4000, M.AudioParams())
    assert np.allclose(whole[0], parts[0], atol=1e-4) and np.allclose(whole[1], parts[1], atol=1e-4)


def test_digest_covers_the_stored_tensors(spark):
    df = spark.createDataFrame(list(enumerate(["speech " * 900, None, "a"])), "doc_id long, text string")
    stored = {r.doc_id: bytes(r.mel) for r in M.audio_columns(df).collect()}
    for r in M.digest(df).collect():
        n = pa.ipc.open_stream(stored[r.doc_id]).read_all().num_rows
        assert r.feature.endswith(f";tensors={n};tensors_crc32={zlib.crc32(stored[r.doc_id])}")


def test_very_long_text(spark):
    text = "long speech " * 250_000
    df = spark.createDataFrame([(1, text, 2)], "doc_id long, text string, feature int")
    r = M.digest(df).first()
    assert (r.n_bytes, r.payload_bytes) == (3_000_000, 3_000_000) and r.feature.startswith("frames=37499;")
    assert M.audio_columns(df).select("doc_id", "feature").first().feature == r.feature.split(";tensors=")[0]


def test_log_mel_against_loops():
    import cmath
    import math

    p = M.AudioParams()
    rate, size, hop = 4000, 100, 40
    x = np.random.default_rng(3).standard_normal(730).astype(np.float32)
    mel, db = M.log_mel(x, rate, p)
    padded = [float(v) for v in x] + [0.0] * 200
    frames = 1 + -(-(len(x) - size) // hop)
    assert mel.shape == (frames, p.n_mels) and db.shape == (frames,)
    top = 2595 * math.log10(1 + rate / 2 / 700)
    edges = [700 * (10 ** (top * k / (p.n_mels + 1) / 2595) - 1) for k in range(p.n_mels + 2)]
    for i in range(frames):
        frame = padded[i * hop : i * hop + size]
        assert abs(10 * math.log10(sum(v * v for v in frame) / size + 1e-9) - db[i]) < 1e-3
        shaped = [v * (0.5 - 0.5 * math.cos(2 * math.pi * n / (size - 1))) for n, v in enumerate(frame)]
        power = [abs(sum(v * cmath.exp(-2j * math.pi * k * n / p.n_fft) for n, v in enumerate(shaped))) ** 2 for k in range(p.n_fft // 2 + 1)]
        for m in range(p.n_mels):
            low, mid, high = edges[m : m + 3]
            energy = 0.0
            for k, v in enumerate(power):
                f = k * rate / p.n_fft
                energy += v * max(0.0, min((f - low) / (mid - low), (high - f) / (high - mid)))
            assert abs(math.log(energy + 1e-6) - mel[i, m]) < 5e-3
