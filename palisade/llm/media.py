"""Audio columns: bytes stored as 8-bit PCM, and features of what is read back.

Sounds are stored losslessly as mono 8-bit WAV.  Features: polyphase resampling (a windowed-sinc low pass whose taps are
dealt out over the phases, so only the kept samples are computed), log energies of a mel filterbank over overlapped
Hann frames, and segments found by hysteresis on the frame energy.  Log-mel frames go into fixed-shape
tensors of an Arrow extension type, with the time span of each.
"""

from __future__ import annotations

import functools
import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

UNIT = 64
_BLOCK = 2048  # frames at once


@dataclass(frozen=True)
class AudioParams:
    rate: int = 8000
    target_rate: int = 4000
    frame_s: float = 0.025
    hop_s: float = 0.010
    n_fft: int = 128
    n_mels: int = 20
    taps: int = 16
    on_db: float = -11.0
    off_db: float = -14.0
    tensor_frames: int = 64


# ---------------------------------------------------------------- storage


def payload(text: bytes) -> bytes:
    """``text`` with bytes 0 up to a positive multiple of UNIT."""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def store(data: bytes, rate: int) -> bytes:
    """A mono WAV file of 8-bit samples, one a byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 1, rate, 0, "NONE", "not compressed"))
        w.writeframes(data)
    return out.getvalue()


def load(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("mono 8-bit samples are stored")
        return r.readframes(r.getnframes()), r.getframerate()


# ---------------------------------------------------------------- features


@functools.lru_cache(8)
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """Low-pass taps by phase: row p weighs the inputs of the outputs that fall p/up after an input."""
    n = 2 * taps * max(up, down) + 1
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * t) * np.hanning(n + 2)[1:-1]
    h *= up / h.sum()
    width = -(-n // up)
    return np.stack([np.pad(h[p::up], (0, width - len(h[p::up])))[::-1] for p in range(up)]).astype(np.float32)


def resample(x: np.ndarray, source: int, target: int, taps: int) -> np.ndarray:
    """Polyphase resampling of ``x`` from ``source`` to ``target`` samples a second."""
    ratio = Fraction(target, source)
    up, down = ratio.numerator, ratio.denominator
    bank = _phases(up, down, taps)
    width = bank.shape[1]
    delay = (2 * taps * max(up, down)) // 2
    n = -(-len(x) * up // down)
    out = np.empty(n, np.float32)
    padded = np.concatenate([np.zeros(width, np.float32), x, np.zeros(width + delay, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    for first in range(up):
        # outputs first, first+up, ... share a phase; they stand down inputs apart
        place = first * down + delay
        phase, base = place % up, place // up
        count = len(out[first::up])
        for at in range(0, count, 1 << 16):
            k = min(1 << 16, count - at)
            begin = base + at * down + 1
            out[first + at * up : first + (at + k) * up : up] = windows[begin : begin + k * down : down] @ bank[phase]
    return out


@functools.lru_cache(8)
def mel_bank(rate: int, n_fft: int, n_mels: int) -> np.ndarray:
    """Triangles that overlap by half, evenly spaced in mel; (n_fft/2+1, n_mels)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, n_mels + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, n_fft // 2 + 1)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32)


def log_mel(x: np.ndarray, rate: int, p: AudioParams) -> tuple[np.ndarray, np.ndarray]:
    """(frames, n_mels) log energies and the energy in dB of each overlapped frame; a last frame is padded with zeros."""
    size, hop = round(p.frame_s * rate), round(p.hop_s * rate)
    frames = max(1, -(-max(0, len(x) - size) // hop) + 1)
    x = np.pad(x, (0, max(0, (frames - 1) * hop + size - len(x))))
    views = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    hann, bank = np.hanning(size).astype(np.float32), mel_bank(rate, p.n_fft, p.n_mels)
    mel, db = np.empty((frames, p.n_mels), np.float32), np.empty(frames, np.float32)
    for at in range(0, frames, _BLOCK):
        block = views[at : at + _BLOCK]
        spectrum = np.fft.rfft(block * hann, p.n_fft)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mel[at : at + _BLOCK] = np.log(power @ bank + np.float32(1e-6))
        db[at : at + _BLOCK] = 10 * np.log10(np.einsum("ij,ij->i", block, block) / size + 1e-9)
    return mel, db


def hysteresis(db: np.ndarray, on: float, off: float) -> list[tuple[int, int]]:
    """Frame spans that begin where ``db`` reaches ``on`` and last until it falls below ``off``."""
    event = np.where(db >= on, 1, np.where(db < off, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(db)), -1))
    active = (last >= 0) & (event[last] > 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], active.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


@dataclass
class Features:
    mel: np.ndarray
    spans: list[tuple[float, float]]  # seconds


def features(media: bytes, p: AudioParams) -> Features:
    """Features of a stored sound."""
    data, rate = load(media)
    x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    x = resample(x, rate, p.target_rate, p.taps)
    mel, db = log_mel(x, p.target_rate, p)
    return Features(mel, [(a * p.hop_s, (b - 1) * p.hop_s + p.frame_s) for a, b in hysteresis(db, p.on_db, p.off_db)])


def tensors(f: Features, p: AudioParams) -> bytes:
    """Arrow stream of fixed-shape tensors (tensor_frames, n_mels) with start and end seconds and frames filled."""
    n = len(f.mel)
    count = -(-n // p.tensor_frames)
    full = np.zeros((count * p.tensor_frames, p.n_mels), np.float32)
    full[:n] = f.mel
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(count, p.tensor_frames, p.n_mels))
    first = np.arange(count) * p.tensor_frames
    filled = np.minimum(p.tensor_frames, n - first)
    table = pa.table({"mel": column, "start_s": first * p.hop_s, "end_s": (first + filled - 1) * p.hop_s + p.frame_s, "frames": filled})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def stored(text: bytes, p: AudioParams) -> tuple[bytes, Features, bytes]:
    """The sound of a text, its features and its tensors, as they are stored."""
    media = store(payload(text), p.rate)
    f = features(media, p)
    return media, f, tensors(f, p)


def tensor_summary(mel: bytes, f: Features, p: AudioParams) -> str:
    """Number and hash of the stored tensors, once what is read back holds the frames and their time spans."""
    table = pa.ipc.open_stream(mel).read_all()
    frames, start, end = (table.column(c).to_numpy() for c in ("frames", "start_s", "end_s"))
    back = np.concatenate([c.to_numpy_ndarray() for c in table.column("mel").chunks]).reshape(-1, p.n_mels)
    first = np.arange(len(frames)) * p.tensor_frames
    whole = frames.sum() == len(f.mel) and np.array_equal(back[: len(f.mel)], f.mel) and not back[len(f.mel) :].any()
    if not whole or not np.allclose(start, first * p.hop_s) or not np.allclose(end - start, (frames - 1) * p.hop_s + p.frame_s):
        raise ValueError("stored tensors differ from the frames")
    return f"tensors={len(frames)};tensors_crc32={zlib.crc32(mel)}"


def summary(f: Features) -> str:
    """Frames, segments, seconds in segments, and each band's mean to two places."""
    mean = ",".join(f"{v:.2f}" for v in (f.mel.mean(axis=0, dtype=np.float64) + 0.0).tolist())
    return f"frames={len(f.mel)};segments={len(f.spans)};seconds={sum(b - a for a, b in f.spans):.3f};mel={mean}"


# ---------------------------------------------------------------- the operators

_SPAN = T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))


def audio_columns(df: DataFrame, text: str = "text", params: AudioParams | None = None) -> DataFrame:
    """``df`` with its texts as sounds: ``media`` (WAV bytes), ``mel`` (Arrow stream of fixed-shape tensors with time spans),
    ``segments`` (array of struct<start_s,end_s>) and ``feature`` (a summary).

    A null or empty text is 64 bytes 0.  Equal texts have equal columns.  Input columns with these names are
    replaced; an empty table gives an empty table.  Long sounds are framed in blocks.
    """
    p = params or AudioParams()
    more = [T.StructField("media", T.BinaryType()), T.StructField("mel", T.BinaryType()), T.StructField("segments", _SPAN), T.StructField("feature", T.StringType())]
    schema = common.added(df.schema, more)
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    new = {f.name for f in more}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches_up_to(batches, 100):
            media, found, mel = zip(*(stored(t, p) for t in common.text_bytes(batch.column(text))), strict=True)
            columns = {f.name: batch.column(f.name) for f in schema.fields if f.name not in new}
            columns |= {
                "media": pa.array(media, pa.binary()),
                "mel": pa.array(mel, pa.binary()),
                "segments": pa.array([[{"start_s": a, "end_s": b} for a, b in f.spans] for f in found], span),
                "feature": pa.array([summary(f) for f in found]),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)


_DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(df: DataFrame, params: AudioParams | None = None) -> DataFrame:
    """The contract's columns, of the stored bytes read back; ``feature`` ends with the number and hash of the tensors, which are built as in
    ``audio_columns`` and read back.  Media and tensors stay with the worker."""
    p = params or AudioParams()

    def row(text: bytes) -> tuple:
        media, f, mel = stored(text, p)
        back, _ = load(media)
        sha = hashlib.sha256
        return (len(text), len(back), sha(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), sha(media).hexdigest(), f"{summary(f)};{tensor_summary(mel, f, p)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches_up_to(batches, 1000):
            rows = [row(t) for t in common.text_bytes(batch.column("text"))]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", *(x.split()[0] for x in _DIGEST.split(", "))])

    schema = T.StructType([df.schema["doc_id"], *T._parse_datatype_string(_DIGEST).fields])
    return df.select("doc_id", "text").mapInArrow(run, schema)
