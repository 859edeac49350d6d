import hashlib
import zlib

import numpy as np
import pyarrow as pa

from peakloom.llm import media
from tests.llm.data import frame, odd_documents


def test_round_trip(spark):
    got = {}
    for r in media.media_digests(frame(spark)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in odd_documents():
        raw = (t or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = next(x for x in got[i] if x.payload_sha256 == hashlib.sha256(padded).hexdigest())
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-32:]))
    assert got[16][0].feature == got[17][0].feature and got[12][0].media_sha256 == got[13][0].media_sha256


def test_stored_form_and_tensors(spark):
    rows = media.clips(frame(spark)).collect()
    by = {r.doc_id: r for r in rows}
    text = next(t for i, t, *_ in odd_documents() if i == 18).encode()
    assert media.from_wav(bytes(by[18].media))[: len(text)] == text
    assert all(len(r.tensor) == media.FRAMES * media.MELS and len(r.starts) == len(r.ends) >= 1 and all(a < b for a, b in zip(r.starts, r.ends)) for r in rows)
    streams = media.tensor_bytes(media.clips(frame(spark))).collect()
    tables = [pa.ipc.open_stream(bytes(r.stream)).read_all() for r in streams]
    assert sum(t.num_rows for t in tables) == len(odd_documents())
    assert tables[0].schema.field("tensor").type.shape == [media.FRAMES, media.MELS]
    assert all(np.isfinite(np.asarray(t.column("tensor").chunk(0).to_numpy_ndarray())).all() for t in tables)


def brute_resample(x, up, down):
    taps = media._taps(up, down)
    h = taps.T.ravel()
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    half = (taps.size - 1) // 2
    full = np.convolve(wide, h)
    n = -(-len(x) * up // down)
    return np.array([full[k * down + half] if k * down + half < len(full) else 0.0 for k in range(n)])


def test_polyphase_resampling():
    x = np.random.default_rng(1).normal(size=333)
    for up, down in ((1, 2), (2, 3), (3, 1), (3, 2), (1, 1)):
        assert np.allclose(media.resample(x, up, down), brute_resample(x, up, down))
    tone = np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)
    spectrum = np.abs(np.fft.rfft(media.resample(tone)))
    assert np.argmax(spectrum) == 440


def test_hysteresis():
    mel = np.repeat(np.array([0, 10, 5, 10, 0, 5, 0, 10, 3], dtype=float)[:, None], 4, axis=1)
    assert media.segments(mel) == [(1, 4), (7, 8)]
    assert media.segments(np.ones((5, 2))) == [(0, 5)]


def test_mel_peak_follows_the_tone():
    low, high = (media.log_mel(np.sin(2 * np.pi * f * np.arange(8000) / 8000), 8000).mean(axis=0).argmax() for f in (300, 3000))
    assert low < high


def test_empty(spark):
    assert media.media_digests(frame(spark, [])).collect() == []


def brute_feature(text):
    """The feature's parts from the text, by other means: a dense filter, a DFT matrix, loops."""
    x = (np.frombuffer(media.payload(text)[0], np.uint8).astype(float) - 128) / 128
    y = brute_resample(x, media.UP, media.DOWN)
    rate, size, hop = 16_000 * media.UP / media.DOWN, media.N_FFT, media.HOP
    starts = [0]
    while starts[-1] + size < len(y):
        starts.append(starts[-1] + hop)
    y = np.append(y, np.zeros(size))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))
    dft = np.exp(-2j * np.pi * np.outer(np.arange(size), np.arange(size // 2 + 1)) / size)
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = [700 * (10 ** (k * top / (media.MELS + 1) / 2595) - 1) for k in range(media.MELS + 2)]
    mel = []
    for s in starts:
        power = np.abs((y[s : s + size] * window) @ dft) ** 2
        row = []
        for a, b, c in zip(edges, edges[1:], edges[2:]):
            total = 0.0
            for k, p in enumerate(power):
                f = k * rate / size
                total += p * max(0.0, min((f - a) / (b - a), (c - f) / (c - b)))
            row.append(np.log(total + 1e-6))
        mel.append(row)
    energy = [sum(r) / len(r) for r in mel]
    low, high = min(energy), max(energy)
    spans, opened = [], None
    for k, e in enumerate(energy):
        e = (e - low) / (high - low) if high > low else 0
        if opened is None and e >= 0.6:
            opened = k
        elif opened is not None and e < 0.4:
            spans.append((opened, k))
            opened = None
    spans += [(opened, len(energy))] if opened is not None else []
    spans = spans or [(0, len(energy))]
    voiced = [mel[k] for a, b in spans for k in range(a, b)]
    n = len(voiced)
    pools = [(k * n // media.FRAMES, (k + 1) * n // media.FRAMES) for k in range(media.FRAMES)]
    tensor = [np.mean(voiced[min(a, n - 1) : max(b, a + 1)], axis=0) for a, b in pools]
    return [(a * hop / rate, b * hop / rate) for a, b in spans], np.mean(tensor, axis=0)


def test_features_by_other_means(spark):
    rows = [r for r in odd_documents() if r[0] is not None]
    got = {(r.doc_id, r.payload_sha256): r.feature for r in media.media_digests(frame(spark, rows)).collect()}
    for i, t, *_ in rows:
        spans, means = brute_feature(t)
        count, outer, crc, bands = got[i, hashlib.sha256(media.payload(t)[0]).hexdigest()].split(";")
        each = ",".join(f"{a:.3f}-{b:.3f}" for a, b in spans)
        assert (int(count), outer, crc) == (len(spans), f"{spans[0][0]:.3f}-{spans[-1][1]:.3f}", f"{zlib.crc32(each.encode()):08x}")
        assert np.allclose([float(v) for v in bands.split(",")], means, atol=0.06)


def test_stretches_make_no_difference(monkeypatch):
    data = np.random.default_rng(3).integers(0, 256, 50_000).astype(np.uint8)
    whole = media.resample((data.astype(np.float32) - 128) / 128)
    mel = media.log_mel(whole, 10_000)
    for stretch in (1, 7, 100):
        monkeypatch.setattr(media, "STRETCH", stretch)
        assert np.allclose(media.clip_mel(data, 10_000), mel, atol=1e-4)
    assert np.allclose(media.resample(data, first=100, stop=900), whole[100:900], atol=1e-6)


def test_rows_come_from_the_stored_streams(spark):
    rows = odd_documents()[:5]
    streams = media.tensor_bytes(media.clips(frame(spark, rows))).collect()
    tables = [pa.ipc.open_stream(bytes(r.stream)).read_all() for r in streams]
    assert all(t.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float16(), [media.FRAMES, media.MELS]) for t in tables)
    other = []
    for t in tables:
        starts = pa.array([[a + 1 for a in x] for x in t.column("starts").to_pylist()])
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, t.schema) as w:
            w.write_table(t.set_column(t.schema.get_field_index("starts"), "starts", starts))
        other.append((out.getvalue().to_pybytes(),))
    got = {r.doc_id: r.feature for r in media.digests(spark.createDataFrame(other, "stream binary")).collect()}
    was = {r.doc_id: r.feature for r in media.media_digests(frame(spark, rows)).collect()}
    assert all(got[k].split(";")[1] != was[k].split(";")[1] and got[k].split(";")[3] == was[k].split(";")[3] for k in was)
