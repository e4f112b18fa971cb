"""Media columns for audio: WAV bytes in, fixed-shape log-mel tensors with time spans out.

Samples are 8-bit, one channel. A polyphase filter brings them to the analysis rate, overlapped frames give log-mel
energies, and hysteresis on the frame energy gives segments. Long recordings are worked through in blocks with the
context that filter and frames need, so memory does not grow with length and blocks do not show in the result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, table, tidied

RATE = 12_000
UP, DOWN = 2, 3
TAPS = 16  # of each phase
FRAME, HOP = 256, 128  # samples after resampling: 32 and 16 ms
MELS = 32
PATCH = 32  # frames of one tensor
UNIT = 192  # samples: HOP * DOWN / UP
BLOCK_UNITS = 4096
RISE, FALL = 3.0, 1.0  # dB over the median energy: a segment starts above the first and ends below the second
HEADER = 44
BATCH_BYTES = 4 << 20


def _little(n: Column) -> Column:
    digits = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*(F.substring(digits, at, 2) for at in (7, 5, 3, 1))))


def wav(text_col: str, rate: int = RATE) -> Column:
    """A WAV file of 8-bit samples that are the text's UTF-8 bytes, padded with spaces to a positive multiple of UNIT."""
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    n = F.octet_length(raw)
    size = F.greatest(F.ceil(n / UNIT), F.lit(1)) * UNIT
    pad = F.repeat(F.lit(" "), (size - n).cast("int")).cast("binary")
    fixed = struct.pack("<4sIHHIIHH4s", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data")
    return F.concat(F.lit(b"RIFF"), _little(size + HEADER - 8), F.lit(b"WAVE"), F.lit(fixed), _little(size), raw, pad)


def samples_of(media: bytes) -> memoryview:
    """The payload of a WAV file of 8-bit samples of one channel, without a copy."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if kind == b"fmt " and struct.unpack_from("<HHIIHH", media, at + 8)[::5] != (1, 8):
            raise ValueError("8-bit PCM is asked for")
        if kind == b"data":
            return memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache
def phases(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Windowed-sinc low-pass at the lower of both Nyquist rates, by phase: row p has the taps for outputs p modulo up."""
    n = up * taps
    t = (np.arange(n) - (n - 1) / 2) / max(up, down)
    h = np.sinc(t) * np.kaiser(n, 6.0)
    h *= up / h.sum()
    return np.ascontiguousarray(h.reshape(taps, up).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, n_out: int, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """n_out outputs; output m is over x[m*down//up : ... + taps] with the filter of phase m*down % up."""
    bank, y = phases(up, down, taps), np.empty(n_out, np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(x, taps)
    for p in range(up):
        count = -(-(n_out - p) // up)
        y[p::up] = windows[p * down // up :: down][:count] @ bank[p * down % up]
    return y


@lru_cache
def mel_bank(rate: float = RATE * UP / DOWN) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, for the bins of a FRAME-point transform."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    bins = np.arange(FRAME // 2 + 1) * rate / FRAME
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid))).T.astype(np.float32)


def log_mel(payload: memoryview, block_units: int = BLOCK_UNITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (log-mel rows, frame energies in dB): a frame around each multiple of UNIT samples, zeros beyond both ends."""
    raw = np.frombuffer(payload, np.uint8)
    window, bank = np.hanning(FRAME).astype(np.float32), mel_bank()
    ahead = TAPS // 2
    for at in range(0, len(raw), block_units * UNIT):
        units = min(block_units, (len(raw) - at) // UNIT)
        units += at + units * UNIT == len(raw)  # the last block has the frame around the end
        lo, hi = at - UNIT - ahead, at + units * UNIT + TAPS
        x = np.zeros(hi - lo, np.float32)
        a, b = max(lo, 0), min(hi, len(raw))
        x[a - lo : b - lo] = raw[a:b]
        x[a - lo : b - lo] -= 128
        x /= 128
        y = resample(x, (units + 1) * HOP)
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:units] * window
        spectrum = np.fft.rfft(frames, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        yield 10 * np.log10(power @ bank + 1e-6), 10 * np.log10(power[:, 3:].sum(axis=1) + 1e-6)  # without the constant part and what the window spreads of it


def segments(energy: np.ndarray, rise: float = RISE, fall: float = FALL) -> np.ndarray:
    """(first frame, past the last) of runs that start above the median plus rise and end below the median plus fall."""
    level = energy - np.median(energy)
    say = np.where(level > rise, 1, np.where(level < fall, -1, 0))
    last = np.maximum.accumulate(np.where(say != 0, np.arange(len(say)), -1))
    on = np.where(last >= 0, say[last], -1) > 0
    return np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8))).reshape(-1, 2)


def features(media: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(log-mel frames, segments) of a WAV file."""
    mel, energy = zip(*log_mel(samples_of(media)), strict=True)
    return np.concatenate(mel), segments(np.concatenate(energy))


_STORED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "frames int, starts array<double>, ends array<double>, segment_starts array<double>, segment_ends array<double>, tensors array<binary>"
)
_NAMES = [c.split()[0] for c in _STORED.split(", ")]
_KINDS = (*(pa.int64(),) * 3, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), *(pa.list_(pa.float64()),) * 4, pa.list_(pa.binary()))
TENSOR = pa.fixed_shape_tensor(pa.float16(), (PATCH, MELS))
SECONDS = UNIT / RATE  # of one frame


def to_tensors(mel: np.ndarray) -> pa.ExtensionArray:
    """Frames in patches of PATCH, the last one filled up with zeros, as an Array of fixed-shape tensors."""
    n = -(-len(mel) // PATCH)
    filled = np.zeros((n * PATCH, MELS), np.float16)
    filled[: len(mel)] = mel
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(filled.ravel()), PATCH * MELS))


def from_bytes(stored: pa.Array) -> pa.ExtensionArray:
    """Stored tensors (the bytes of each, little-endian) as an Array of fixed-shape tensors."""
    values = np.frombuffer(b"".join(stored.to_pylist()), "<f2")
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(values), PATCH * MELS))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each recording is, with its tensors, their time spans and its segments."""
    for batch in batches:
        out: list[tuple] = []
        size = 0
        for doc, n_bytes, value in zip(batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), batch["media"].cast(pa.large_binary()), strict=True):
            media = value.as_py()
            payload = samples_of(media)
            mel, spans = features(media)
            # frame i is around sample i*UNIT: a run of frames spans half a hop to either side
            at = np.arange(0, len(mel), PATCH)
            starts, ends = (at - 0.5) * SECONDS, (np.minimum(at + PATCH, len(mel)) - 0.5) * SECONDS
            tensors = [x.astype("<f2").tobytes() for x in to_tensors(mel).to_numpy_ndarray()]
            facts = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())
            out.append((doc, n_bytes, *facts, len(mel), starts, ends, *((spans - 0.5) * SECONDS).T, tensors))
            size += len(media)
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_NAMES)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names=_NAMES)


_DIGEST = _STORED[: _STORED.index("frames int")] + "feature string, frames long, segments long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The feature column from the tensors and spans that were read back."""
    for batch in batches:
        marks, spoken = [], batch["segment_starts"]
        for frames, tensors, *spans in zip(batch["frames"].to_pylist(), batch["tensors"], *(batch[c] for c in ("starts", "ends", "segment_starts", "segment_ends")), strict=True):
            mel = from_bytes(tensors.values).to_numpy_ndarray().reshape(-1, MELS)[:frames]
            # half a dB, so that the last bits of sums don't show
            digest = hashlib.sha256(np.rint(mel.astype(np.float32) * 2).astype("<i2").tobytes())
            for s in spans:
                digest.update(np.rint(s.values.to_numpy(zero_copy_only=False) / SECONDS * 2).astype("<i8").tobytes())
            mean = " ".join(f"{v:.1f}" for v in mel.mean(axis=0, dtype=np.float64)[:: MELS // 4] + 0.0)
            marks.append(f"{digest.hexdigest()[:32]} mel {mean}")
        plain = [batch[n] for n in _NAMES[:7]]
        yield pa.RecordBatch.from_arrays([*plain, pa.array(marks, pa.string()), batch["frames"].cast(pa.int64()), pa.array([len(s) for s in spoken], pa.int64())], names=[c.split()[0] for c in _DIGEST.split(", ")])


def store_audio(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written and read again: doc_id, n_bytes (unpadded), media (WAV bytes). Null text is empty; other columns are not read."""
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return materialise(df.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(raw).cast("long").alias("n_bytes"), wav(text_col).alias("media")), "media")


def store_tensors(media: DataFrame) -> DataFrame:
    """Written and read again: per recording what it is, and its log-mel frames as tensors with time spans, and its segments.

    A tensor is stored as the bytes of PATCH x MELS half-precision numbers; from_bytes() gives Arrow's fixed-shape type back.
    """
    return materialise(media.mapInArrow(tidied(_measure), _STORED), "tensors")


def describe_audio(stored: DataFrame) -> DataFrame:
    """Per row of store_tensors(): its facts and a digest of its features, from the tensors read back. Equal texts give equal values."""
    return stored.mapInArrow(_digests, _DIGEST)


def audio_tensors(stored: DataFrame) -> DataFrame:
    """store_tensors() -> a row for each tensor: doc_id, its number, time span, frames in use, whether a segment meets it, its bytes."""
    met = F.exists(F.sequence(F.lit(0), F.greatest(F.size("segment_starts") - 1, F.lit(0))), lambda i: (F.get("segment_starts", i) < F.col("end_s")) & (F.get("segment_ends", i) > F.col("start_s")))
    rows = stored.select("doc_id", "frames", "starts", "ends", "segment_starts", "segment_ends", F.posexplode("tensors").alias("number", "tensor"))
    spans = rows.select("*", F.get("starts", "number").alias("start_s"), F.get("ends", "number").alias("end_s"))
    used = F.least(F.col("frames") - F.col("number") * PATCH, F.lit(PATCH)).alias("frames")
    return spans.select("doc_id", "number", "start_s", "end_s", used, F.coalesce(met, F.lit(False)).alias("in_segment"), "tensor")


def as_tensor_table(rows: pa.Table) -> pa.Table:
    """An Arrow table of audio_tensors() rows with the tensor column in Arrow's fixed-shape tensor type."""
    at = rows.schema.get_field_index("tensor")
    return rows.set_column(at, "tensor", from_bytes(rows["tensor"].combine_chunks()))


def op2_audio_features(spark, sf_dir: str) -> DataFrame:
    """Every document as a WAV file, its log-mel tensors with spans, and a digest of them, each read back from what was stored."""
    return describe_audio(store_tensors(store_audio(table(spark, sf_dir, "documents"))))
