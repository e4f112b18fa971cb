import hashlib
import io
import wave
import zlib

import numpy as np

from tessera.llm import audio
from tessera.llm.audio import as_tensor_table, audio_tensors, describe_audio, features, log_mel, mel_bank, phases, resample, segments, store_audio, store_tensors

SCHEMA = "doc_id long, text string, media string, n_bytes string"
ROWS = [(1, "abc é", None, "x"), (2, None, None, None), (3, "", None, None), (4, "x" * 192, None, None), (5, "y" * 193, None, None), (5, "y" * 193, None, None), (None, "ab " * 40_000, None, None), (8, " " * 9000 + "~!" * 900 + " " * 9000, None, None)]


def test_round_trip(spark):
    stored = store_audio(spark.createDataFrame(ROWS, SCHEMA).repartition(3))
    got = sorted(describe_audio(store_tensors(stored)).collect(), key=str)
    media = {(r.doc_id, r.n_bytes): bytes(r.media) for r in stored.collect()}
    want = []
    for d, t, *_ in ROWS:
        raw = (t or "").encode()
        pay = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        m = media[d, len(raw)]
        with wave.open(io.BytesIO(m)) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(1 << 30)) == (1, 1, pay)
        want.append((d, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]), len(m), hashlib.sha256(m).hexdigest()))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        assert by.setdefault(r.payload_sha256, r.feature) == r.feature
    assert len(set(by.values())) == len(by)


def test_blocks_do_not_show():
    raw = memoryview(np.random.default_rng(1).integers(0, 256, 192 * 50, dtype=np.uint8).tobytes())
    whole, parts = list(log_mel(raw)), list(log_mel(raw, block_units=7))
    for k in (0, 1):
        assert np.allclose(np.concatenate([x[k] for x in whole]), np.concatenate([x[k] for x in parts]), atol=1e-3)


def test_resampling_keeps_a_tone():
    t = np.arange(6000) / 12000
    y = resample(np.sin(2 * np.pi * 440 * t).astype(np.float32), 3900)
    spectrum = np.abs(np.fft.rfft(y * np.hanning(len(y))))
    assert abs(spectrum.argmax() * 8000 / len(y) - 440) < 3 and 0.9 < np.abs(y[100:-100]).max() < 1.1


def test_hysteresis():
    e = np.array([0, 0, 5, 2, 2, 0, 2, 0, 0, 0, 0, 4.0, 0])
    assert segments(e).tolist() == [[2, 5], [11, 12]]


def test_tensors(spark):
    stored = store_audio(spark.createDataFrame(ROWS, SCHEMA))
    found = as_tensor_table(audio_tensors(store_tensors(stored)).where("doc_id = 8").orderBy("number").toArrow())
    mel, spans = features(bytes(stored.where("doc_id = 8").first().media))
    assert found.schema.field("tensor").type.shape == [audio.PATCH, audio.MELS] and found.num_rows == -(-len(mel) // audio.PATCH)
    values = np.concatenate([c.to_numpy_ndarray() for c in found["tensor"].chunks]).reshape(-1, audio.MELS)
    assert np.allclose(values[: len(mel)].astype(float), mel, atol=0.05) and not values[len(mel) :].any()
    assert found["frames"].to_pylist()[:-1] == [audio.PATCH] * (found.num_rows - 1) and sum(found["frames"].to_pylist()) == len(mel)
    assert abs(found["start_s"][1].as_py() - (audio.PATCH - 0.5) * 192 / 12000) < 1e-9
    inside = {n for lo, hi in spans for n in range(lo // audio.PATCH, (hi - 1) // audio.PATCH + 1)}
    assert {n for n, x in zip(found["number"].to_pylist(), found["in_segment"].to_pylist()) if x} == inside and inside


def test_features_against_plain_sums():
    """Resampling, frames, filterbank and segments once more, a sum at a time."""
    raw = np.random.default_rng(2).integers(0, 256, 192 * 6, dtype=np.uint8).tobytes()
    x = {i: (b - 128) / 128 for i, b in enumerate(raw)}
    up, down, taps = audio.UP, audio.DOWN, audio.TAPS
    n = up * taps
    t = (np.arange(n) - (n - 1) / 2) / max(up, down)
    h = np.sinc(t) * np.kaiser(n, 6.0)
    h = h * up / h.sum()
    # output m stands at m*down/up of the input; the impulse response is read backwards at every up-th tap
    y = lambda m: sum(h[::-1][up - 1 - (m * down % up) + up * k] * x.get(m * down // up + k - taps // 2, 0.0) for k in range(taps))
    frames = len(raw) // audio.UNIT + 1
    bank, window = mel_bank(), np.hanning(audio.FRAME)
    want = []
    for f in range(frames):
        s = np.array([y(m) for m in range((f - 1) * audio.HOP, (f + 1) * audio.HOP)]) * window
        power = np.array([abs(sum(s * np.exp(-2j * np.pi * k * np.arange(audio.FRAME) / audio.FRAME))) ** 2 for k in range(audio.FRAME // 2 + 1)])
        want.append(10 * np.log10(power @ bank + 1e-6))
    got = np.concatenate([m for m, _ in log_mel(memoryview(raw))])
    assert got.shape == (frames, audio.MELS) and np.allclose(got, np.array(want), atol=0.02)
    assert phases().shape == (up, taps)


def test_segments_against_a_state_at_a_time():
    e = np.cumsum(np.random.default_rng(3).normal(size=500))
    on, want, level = False, [], e - np.median(e)
    for i, v in enumerate(level):
        if not on and v > 3.0:
            on = True
            want.append([i, len(e)])
        elif on and v < 1.0:
            on = False
            want[-1][1] = i
    assert segments(e).tolist() == want


def test_empty(spark):
    assert describe_audio(store_tensors(store_audio(spark.createDataFrame([], SCHEMA)))).collect() == []
