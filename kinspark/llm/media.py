"""Audio features of payloads kept in media columns.

The payload of a document is its UTF-8 bytes, padded, stored as the samples of an 8-bit mono WAV file. The
signal is resampled by a polyphase filter, turned into overlapped log-mel frames and cut into active spans by
an energy threshold with hysteresis. WAV bytes, frames and spans are written to the shared folder: groups of
documents as Arrow streams, in which frames are fixed-shape tensors (``arrow.fixed_shape_tensor``) of CHUNK
frames by MELS bands, each with its time span. Digests and features are made of what is read back from there.

Cases: null text counts as empty and gives one padded block of blanks; equal texts give equal values, since
each document is computed by itself in blocks of fixed size; of a very long text, no more is held than its
samples, two bytes a band and frame (a fifth of them) and its energies, the rest goes block by block; a
constant signal has no active span; repeated rows stay; an empty table gives an empty result; only the
named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinspark.llm._common import new_folder, text_or_empty
from kinspark.llm.bpe import in_groups

PAD_TO, PAD_BYTE = 192, b" "
RATE = 16_000
UP, DOWN = 1, 2
TAPS = 32
WINDOW, HOP, MELS = 200, 80, 16
BLOCK_FRAMES = 2048
#: Frames of one stored tensor, and about how many bytes one stored group of documents takes.
CHUNK, GROUP_BYTES = 16, 1 << 20
ON_DB, OFF_DB, SMOOTH = 1.0, -1.0, 5


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload and the number of bytes before padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    short = -len(raw) % PAD_TO if raw else PAD_TO
    return raw + PAD_BYTE * short, len(raw)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono PCM file with these samples."""
    padded = samples + b"\0" * (len(samples) % 2)
    return b"".join((b"RIFF", struct.pack("<I", 36 + len(padded)), b"WAVEfmt ", struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8), b"data", struct.pack("<I", len(samples)), padded))


def from_wav(data: bytes) -> tuple[bytes, int]:
    """Samples and rate of an 8-bit mono PCM file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (channels, bits) != (1, 8):
                raise ValueError("not 8-bit mono")
        elif kind == b"data":
            return data[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache
def low_pass(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc filter of the rate ``up`` times the input's; its length is a multiple of ``up``."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(up, down)
    kernel = np.sinc(t * cut) * np.hamming(n)
    return kernel / kernel.sum() * up


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS, start: int = 0, stop: int | None = None, level: float = 0.0, scale: float = 1.0) -> np.ndarray:
    """Samples ``start`` to ``stop`` of polyphase resampling of (x - level) / scale by up/down; zero beyond its ends.

    Output sample k takes the phase k * down % up of the filter. Samples of one phase come at one stride, so that
    each tap is a slice; only the input that the asked samples need is converted.
    """
    h = low_pass(up, down, taps)
    length = -(-len(x) * up // down)
    stop = length if stop is None else min(stop, length)
    y = np.zeros(max(0, stop - start))
    common = math.gcd(up, down)
    period, stride = up // common, down // common
    for first in range(start, min(start + period, stop)):
        phase, at, n = first * down % up, first * down // up, -(-(stop - first) // period)
        low, high = at - taps + 1, at + (n - 1) * stride + 1
        part = np.zeros(high - low)
        inner = x[max(low, 0) : high]
        part[max(0, -low) : max(0, -low) + len(inner)] = (inner.astype(np.float64) - level) / scale
        acc = np.zeros(n)
        for tap in range(taps):
            acc += h[phase + tap * up] * part[taps - 1 - tap : taps + (n - 1) * stride - tap : stride]
        y[first - start :: period] = acc
    return y


@lru_cache
def mel_bank(rate: float, size: int, bands: int) -> np.ndarray:
    """Triangular filters, (bins, bands)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(size, 1 / rate)[:, None]
    rise = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


@lru_cache
def _hann(n: int) -> np.ndarray:
    return np.hanning(n + 1)[:-1]


def log_mel(y: np.ndarray, rate: float) -> np.ndarray:
    """(frames, MELS) of overlapped windows that lie whole in ``y``."""
    view = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP]
    spectrum = np.fft.rfft(view * _hann(WINDOW), axis=1)
    return np.log10((spectrum.real**2 + spectrum.imag**2) @ mel_bank(rate, WINDOW, MELS) + 1e-10)


def log_mel_blocks(samples: bytes, rate: int) -> Iterator[np.ndarray]:
    """Frames of the resampled signal, at most BLOCK_FRAMES at a time; the last window is padded with zeros."""
    x = np.frombuffer(samples, np.uint8)
    level = float(x.mean()) if len(x) else 0.0
    length = -(-len(x) * UP // DOWN)
    frames = max(1, -(-max(0, length - WINDOW) // HOP) + 1)
    for first in range(0, frames, BLOCK_FRAMES):
        n = min(BLOCK_FRAMES, frames - first)
        y = resample(x, start=first * HOP, stop=(first + n - 1) * HOP + WINDOW, level=level, scale=128.0)
        yield log_mel(np.concatenate([y, np.zeros((n - 1) * HOP + WINDOW - len(y))]), rate * UP / DOWN)


def active_spans(energy_db: np.ndarray) -> list[tuple[int, int]]:
    """Spans of frames (end exclusive) that begin above mean + ON_DB and last until below mean + OFF_DB."""
    width = min(SMOOTH, len(energy_db))
    smooth = np.convolve(energy_db, np.full(width, 1 / width), "same")
    level = smooth - smooth.mean()
    state = np.where(level > ON_DB, 1, np.where(level < OFF_DB, -1, 0))
    known = np.flatnonzero(state)
    if not known.size:
        return []
    last = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = (last >= 0) & (state[np.maximum(last, 0)] > 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def features(samples: bytes, rate: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Log-mel frames in half precision, as they are stored, and active spans in frames."""
    frames, energies = [], []
    for block in log_mel_blocks(samples, rate):
        energies.append(10 * np.log10(np.power(10.0, block).sum(1)))
        frames.append(block.astype(np.float16))
    return np.concatenate(frames), active_spans(np.concatenate(energies))


def seconds(first: int, last: int, rate: int) -> tuple[float, float]:
    """The time span of frames ``first`` to ``last``, the latter exclusive."""
    new_rate = rate * UP / DOWN
    return first * HOP / new_rate, ((last - 1) * HOP + WINDOW) / new_rate


def summary(mel: np.ndarray, spans: list[tuple[float, float]]) -> str:
    """Frames, spans, active seconds, then mean and deviation of each band; spans in seconds."""
    total, squares = np.zeros(MELS), np.zeros(MELS)
    for at in range(0, len(mel), BLOCK_FRAMES):
        block = mel[at : at + BLOCK_FRAMES].astype(np.float64)
        total += block.sum(0)
        squares += (block**2).sum(0)
    mean = total / len(mel)
    numbers = [*mean, *np.sqrt(np.maximum(squares / len(mel) - mean**2, 0))]
    return f"{len(mel)};{len(spans)};{sum(b - a for a, b in spans):.3f};" + ",".join(f"{v:.3f}" for v in numbers)


TENSOR = pa.fixed_shape_tensor(pa.float16(), (CHUNK, MELS))
FRAMES = pa.schema({"doc": pa.int32(), "start_s": pa.float64(), "end_s": pa.float64(), "n_frames": pa.int32(), "mel": TENSOR})
SPANS = pa.list_(pa.struct({"start_s": pa.float64(), "end_s": pa.float64()}))


def _stream(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def store_group(ids: pa.Array, texts: list[str | None]) -> tuple[bytes, bytes]:
    """Two Arrow streams: a row a document (id, n_bytes, wav, rate, spans), and a row a tensor of frames with its time span."""
    media, rows, tensors = [], [], []
    for doc, text in enumerate(texts):
        payload, n_bytes = payload_of(text)
        wav = to_wav(payload)
        mel, spans = features(payload, RATE)
        media.append((n_bytes, wav, [dict(zip(("start_s", "end_s"), seconds(a, b, RATE), strict=True)) for a, b in spans]))
        for at in range(0, len(mel), CHUNK):
            n = min(CHUNK, len(mel) - at)
            rows.append((doc, *seconds(at, at + n, RATE), n))
        tensors += [mel, np.zeros((-len(mel) % CHUNK, MELS), np.float16)]
    flat = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(tensors).ravel()), CHUNK * MELS)
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FRAMES.types, strict=False)]
    kinds = {"n_bytes": pa.int64(), "wav": pa.large_binary(), "spans": SPANS}
    own = pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*media, strict=True), kinds.values(), strict=True))], names=["id", *kinds])
    return _stream(own), _stream(pa.RecordBatch.from_arrays([*columns, pa.ExtensionArray.from_storage(TENSOR, flat)], schema=FRAMES))


def read_group(media: bytes, frames: bytes) -> Iterator[tuple[pa.Scalar, int, bytes, np.ndarray, list[tuple[float, float]], list[tuple[float, float, int]]]]:
    """Of each document of a stored group: id, n_bytes, WAV bytes, frames, active spans, and the tensors' (start_s, end_s, n_frames)."""
    own, parts = pa.ipc.open_stream(media).read_all().combine_chunks(), pa.ipc.open_stream(frames).read_all().combine_chunks()
    if parts.schema.field("mel").type != TENSOR:
        raise ValueError("not tensors of this shape")
    mel = parts.column("mel").chunk(0).to_numpy_ndarray()
    doc, n = np.asarray(parts.column("doc")), np.asarray(parts.column("n_frames"))
    cuts = np.searchsorted(doc, np.arange(own.num_rows + 1))
    times = list(zip(parts.column("start_s").to_pylist(), parts.column("end_s").to_pylist(), n.tolist(), strict=True))
    for at in range(own.num_rows):
        a, b = cuts[at], cuts[at + 1]
        spans = [(s["start_s"], s["end_s"]) for s in own.column("spans")[at].as_py()]
        yield own.column("id")[at], own.column("n_bytes")[at].as_py(), own.column("wav")[at].as_py(), mel[a:b].reshape(-1, MELS)[: n[a:b].sum()], spans, times[a:b]


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write groups of documents below the shared folder and return the written table ``media, frames``. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_groups(batches, 1, GROUP_BYTES):
            made = [store_group(part.column(0).slice(at, 512), part.column(1).slice(at, 512).to_pylist()) for at in range(0, part.num_rows, 512)]
            for group in made:
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in group], names=["media", "frames"])

    spark, path = docs.sparkSession, new_folder(docs.sparkSession, "media")
    groups = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "media binary, frames binary")
    groups.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(groups.schema).parquet(path)


NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: sizes and digests of payload and stored form, and its feature string, from the stored groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for media, frames in zip(batch.column(0), batch.column(1), strict=True):
                ids, rows = [], []
                for doc_id, n_bytes, wav, mel, spans, _ in read_group(media.as_buffer(), frames.as_buffer()):
                    back, _ = from_wav(wav)
                    ids.append(doc_id.as_py())
                    rows.append((n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(wav), hashlib.sha256(wav).hexdigest(), summary(mel, spans)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["id", *NAMES])

    id_type, kind = to_arrow_type(docs.schema[id_col].dataType), docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store_media(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def media_frames(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a stored tensor: ``id_col, start_s, end_s, n_frames, active, mel``; mel is an Arrow stream of one
    fixed-shape tensor, active the shares of its frames' time that active spans cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for media, frames in zip(batch.column(0), batch.column(1), strict=True):
                for doc_id, _, _, mel, spans, times in read_group(media.as_buffer(), frames.as_buffer()):
                    ids, out, at = [doc_id.as_py()] * len(times), [], 0
                    for start, end, n in times:
                        padded = np.zeros((CHUNK, MELS), np.float16)
                        padded[:n] = mel[at : at + n]
                        at += n
                        storage = pa.FixedSizeListArray.from_arrays(pa.array(padded.ravel()), CHUNK * MELS)
                        covered = sum(max(0.0, min(end, b) - max(start, a)) for a, b in spans)
                        out.append((start, end, n, min(1.0, covered / (end - start)), _stream(pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(TENSOR, storage)], names=["mel"]))))
                    kinds = [pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["id", "start_s", "end_s", "n_frames", "active", "mel"])

    id_type, kind = to_arrow_type(docs.schema[id_col].dataType), docs.schema[id_col].dataType.simpleString()
    return store_media(docs, id_col, text_col).mapInArrow(run, f"id {kind}, start_s double, end_s double, n_frames int, active double, mel binary").withColumnRenamed("id", id_col)
