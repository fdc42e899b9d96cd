"""Media columns: audio and its features.

A payload is stored losslessly as one channel of unsigned 8-bit samples at RATE in a WAV file, one byte a sample, and
read back from the file's data chunk. Features of a recording:
- polyphase resampling by UP / DOWN: a windowed-sinc low pass, of which each output sample uses one phase's taps;
- log-mel filterbanks over overlapped frames (FRAME samples, HOP apart, Hann window, N_FFT points, MELS bands);
- segments by hysteresis on the frame energy: one starts where it rises over the high threshold and lasts until it
  falls under the low one; the thresholds are HIGH and LOW of the way from the recording's 0.1 quantile of energy to
  its 0.95 quantile. A recording without any change of energy is one segment.
Each segment gives one tensor of fixed shape (TIME, MELS), the mean log-mel of TIME equal parts of it, and its time
span in seconds. The tensors of a recording are one Arrow record batch (columns start, end, tensor: arrow.fixed_shape_
tensor) in an IPC stream, so any Arrow reader gets them as tensors. A recording without a segment has none.

store() makes the media column and audio_features() the column of tensors; digests() writes both as tables to the
shared folder and takes every value that it returns from what it reads back.

Frames are computed in pieces of fixed size, from the recording alone, so equal payloads have equal features whatever
the batch they are in. Null payloads count as empty; an empty recording has no frames and no segments. Repeated rows
give as many result rows; other columns are ignored. Memory is bounded by the longest recording's samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm._shared import written

RATE, UP, DOWN, TAPS = 8000, 3, 8, 8
FRAME, HOP, N_FFT, MELS, TIME = 256, 128, 256, 24, 4
HIGH, LOW = 0.6, 0.4
PIECE = 1 << 16
PAD = 64


def wav(payload: bytes) -> bytes:
    """payload as a WAV file of 8-bit samples; an odd number of bytes is followed by the format's pad byte."""
    body = payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + body


def samples(media: bytes) -> bytes:
    """The bytes of the data chunk of a WAV file of 8-bit samples."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _low_pass() -> np.ndarray:
    """Taps by phase: row p holds those that output samples of phase p use."""
    n = TAPS * max(UP, DOWN)
    t = np.arange(n) - (n - 1) / 2
    taps = np.sinc(t / max(UP, DOWN)) * np.hanning(n + 2)[1:-1]
    taps *= UP / taps.sum()
    width = -(-n // UP)
    return np.ascontiguousarray(np.resize(np.append(taps, np.zeros(width * UP - n)), (width, UP)).T[:, ::-1]).astype(np.float32)


def _mel() -> np.ndarray:
    to = lambda hz: 2595 * np.log10(1 + hz / 700)
    rate = RATE * UP / DOWN
    edges = 700 * (10 ** (np.linspace(to(60), to(rate / 2), MELS + 2) / 2595) - 1)
    hz = np.fft.rfftfreq(N_FFT, 1 / rate)
    rise = (hz[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - hz[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_PHASES, _BANK, _WINDOW = _low_pass(), _mel(), np.hanning(FRAME + 1)[:-1].astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """x at RATE * UP / DOWN: output k is the sum over the taps of phase k * DOWN mod UP."""
    n = len(x) * UP // DOWN
    width = _PHASES.shape[1]
    x = np.concatenate([np.zeros(width - 1, np.float32), x])
    view = np.lib.stride_tricks.sliding_window_view(x, width) if len(x) >= width else np.zeros((0, width), np.float32)
    out = np.empty(n, np.float32)
    for phase in range(UP):
        k = np.arange(phase, n, UP)
        if len(k):
            first = int(k[0]) * DOWN // UP
            rows = view[first::DOWN][: len(k)]
            p = int(k[0]) * DOWN % UP
            for a in range(0, len(rows), PIECE):
                out[phase + a * UP : phase + (a + len(rows[a : a + PIECE])) * UP : UP] = rows[a : a + PIECE] @ _PHASES[p]
    return out


def log_mel(x: np.ndarray) -> np.ndarray:
    """Log energies (frames, MELS); the last frame is filled with zeros."""
    if not len(x):
        return np.zeros((0, MELS), np.float32)
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.append(x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((n, MELS), np.float32)
    for a in range(0, n, 1024):
        f = np.fft.rfft(frames[a : a + 1024] * _WINDOW, N_FFT)
        out[a : a + 1024] = (f.real**2 + f.imag**2).astype(np.float32) @ _BANK
    return np.log(out + 1e-6)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans, end exclusive: from where energy rises over the high threshold back to where it rose over the low
    one, to where it falls under the low one."""
    if not len(energy):
        return []
    floor, top = np.quantile(energy, [0.1, 0.95])
    low, high = floor + LOW * (top - floor), floor + HIGH * (top - floor)
    over = np.concatenate([[False], energy >= low, [False]])
    starts, ends = np.flatnonzero(over[1:] & ~over[:-1]), np.flatnonzero(~over[1:] & over[:-1])
    loud = np.concatenate([[0], np.cumsum(energy >= high)])
    keep = loud[ends] > loud[starts]
    return list(zip(starts[keep].tolist(), ends[keep].tolist()))


def features(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time spans (segments, 2) in seconds, and tensors (segments, TIME, MELS)."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x))
    found = segments(mel.mean(1)) if len(mel) else []
    if not found:
        return np.zeros((0, 2), np.float32), np.zeros((0, TIME, MELS), np.float32)
    spans = np.array(found)
    total = np.concatenate([np.zeros((1, MELS)), np.cumsum(mel, 0, dtype=np.float64)])
    cuts = spans[:, :1] + (spans[:, 1:] - spans[:, :1]) * np.arange(TIME + 1) / TIME
    a = np.floor(cuts[:, :-1]).astype(int)
    b = np.maximum(np.ceil(cuts[:, 1:]).astype(int), a + 1)  # a part has one frame at least
    tensors = (total[b] - total[a]) / (b - a)[:, :, None]
    step = HOP * DOWN / UP / RATE
    return (spans * step).astype(np.float32), tensors.astype(np.float32)


def tensor_batch(spans: np.ndarray, tensors: np.ndarray) -> bytes:
    """An Arrow IPC stream of columns start, end and tensor."""
    kind = pa.fixed_shape_tensor(pa.float32(), (TIME, MELS))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.reshape(-1)), TIME * MELS)
    batch = pa.RecordBatch.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1]), pa.ExtensionArray.from_storage(kind, flat)], names=["start", "end", "tensor"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of text, and the same with zeros up to a positive multiple of PAD."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (max(1, -(-len(raw) // PAD)) * PAD - len(raw))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        yield from (whole.slice(i, 128) for i in range(0, whole.num_rows, 128))


def store(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """doc_id, n_bytes, media (WAV file) of each row's bytes; a text is stored as its UTF-8 bytes, padded()."""
    texts = rows.schema[payload].dataType.typeName() == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            found = [padded(x) if texts else (len(x or b""), x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([wav(x) for _, x in found], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), payload).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def audio_features(rows: DataFrame, media: str = "media", *also: str) -> DataFrame:
    """doc_id, n_segments, tensors (Arrow IPC stream) of each row's WAV file; columns of `also` stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            found = [features(samples(x)) if x else features(b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s, _ in found], pa.int64()), pa.array([tensor_batch(*x) for x in found], pa.binary()), *b.columns[2:]], names=["doc_id", "n_segments", "tensors", *also])

    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), media, *also)
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    return rows.mapInArrow(run, f"doc_id long, n_segments long, tensors binary{kinds}")


def described(tensors: bytes) -> str:
    """Shape and digest of a stored column value: all tensors and time spans, rounded."""
    t = pa.ipc.open_stream(tensors).read_all().combine_chunks()
    values = t["tensor"].combine_chunks().to_numpy_ndarray() if len(t) else np.zeros((0, TIME, MELS), np.float32)
    spans = np.stack([t["start"].to_numpy(), t["end"].to_numpy()], 1)
    digest = hashlib.sha256(np.rint(values * 64).astype(np.int32).tobytes() + np.rint(spans * 1000).astype(np.int64).tobytes()).hexdigest()[:16]
    return f"{len(t)}x{TIME}x{MELS}:{digest}"


def digests(docs: DataFrame) -> DataFrame:
    """Of each text as audio: sizes and digests of the payload read back and of the file, and of its features."""
    media = written(store(docs.select("doc_id", "text"), "text"), "media", "zstd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            files = b.column(1).to_pylist()
            back = [samples(x) for x in files]
            sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(2), pa.array(map(len, back), pa.int64()), sha(back), pa.array([zlib.crc32(x[-PAD:]) for x in back], pa.int64()), pa.array(map(len, files), pa.int64()), sha(files), b.column(3),
            ], names=[n for n, _ in _DIGESTS])

    found = media.select("doc_id", "media", "n_bytes", F.col("media").alias("file"))
    found = audio_features(found, "media", "n_bytes", "file")
    stored = written(found.select("doc_id", "file", "n_bytes", "tensors").mapInArrow(run, ", ".join(map(" ".join, _DIGESTS))), "audio-features", "zstd")

    def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(map(described, b.column(7).to_pylist()), pa.string())], names=[*(n for n, _ in _DIGESTS[:-1]), "feature"])

    return stored.mapInArrow(features_of, ", ".join(map(" ".join, _DIGESTS[:-1])) + ", feature string")


_DIGESTS = (("doc_id", "long"), ("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("tensors", "binary"))
