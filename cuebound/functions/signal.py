"""Waveforms: decoding, log-mel features; numpy kernels inside Arrow functions."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Samples a second, samples of a frame and between frames, bands, seconds of a chunk.
RATE, FRAME, HOP, BANDS, CHUNK = 16000, 400, 160, 80, 30
SAMPLES, FRAMES = CHUNK * RATE, CHUNK * RATE // HOP


def wav_header(data: bytes) -> dict[str, int] | None:
    """channels, rate, bits, offset and bytes of a RIFF file's samples, from its first bytes; None for anything else."""
    if len(data) < 44 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(data):
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data" and form:
            return {"channels": form[1], "rate": form[2], "bits": form[5], "offset": at + 8, "bytes": size}
        at += 8 + size + size % 2
    return None


def read_wav(data: bytes) -> np.ndarray | None:
    """The first channel of a 16-bit file as float32: sample/32768 scaled to 32767, cut to a whole number and divided by 32768."""
    head = wav_header(data)
    if head is None or head["bits"] != 16 or not head["channels"]:
        return None
    whole = data[head["offset"] : head["offset"] + head["bytes"]]
    pcm = np.frombuffer(whole[: len(whole) // 2 * 2], "<i2")[:: head["channels"]]
    scaled = pcm.astype(np.float32) / np.float32(32768.0) * np.float32(32767.0)
    return scaled.astype(np.int16).astype(np.float32) / np.float32(32768.0)


def write_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """A mono 16-bit file of samples in [-1, 1]."""
    pcm = np.clip(np.round(np.asarray(samples) * 32767), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm


def fit_length(samples: np.ndarray, length: int = SAMPLES) -> np.ndarray:
    """samples cut, or filled up with zeros."""
    return np.pad(samples[:length], (0, max(0, length - len(samples))))


def mel_to_hz(mel: np.ndarray, htk: bool = False) -> np.ndarray:
    """Frequencies of mel values: linear up to 1000 Hz and logarithmic above, or by the HTK formula."""
    if htk:
        return 700.0 * (10.0 ** (mel / 2595.0) - 1.0)
    return np.where(mel < 15.0, mel * (200.0 / 3.0), 1000.0 * np.exp((mel - 15.0) * (np.log(6.4) / 27.0)))


def hz_to_mel(hz: float, htk: bool = False) -> float:
    """The inverse of mel_to_hz."""
    if htk:
        return float(2595.0 * np.log10(1.0 + hz / 700.0))
    return float(hz * 3.0 / 200.0 if hz < 1000.0 else 15.0 + np.log(hz / 1000.0) * 27.0 / np.log(6.4))


def mel_frequencies(count: int, low: float = 0.0, high: float = RATE / 2, htk: bool = False) -> np.ndarray:
    """count frequencies that are equally spaced in mel."""
    return mel_to_hz(np.linspace(hz_to_mel(low, htk), hz_to_mel(high, htk), count), htk)


def mel_filters(bands: int = BANDS, frame: int = FRAME, rate: int = RATE) -> np.ndarray:
    """Triangular filters (bands, frame / 2) of equal energy; the last frequency is left out."""
    edges = mel_frequencies(bands + 2, 0.0, rate / 2)
    bins = np.linspace(0.0, rate / 2, frame // 2 + 1)[None, :]
    left, middle, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    slopes = np.minimum((bins - left) / (middle - left), (right - bins) / (right - middle))
    return (np.maximum(slopes, 0.0) * (2.0 / (right - left)))[:, :-1].astype(np.float32)


_FILTERS: list[np.ndarray] = []


def log_mel(samples: np.ndarray) -> np.ndarray:
    """(bands, frames): log10 of mel energies of Hann frames (the last ones filled up with zeros), floored 8 below the largest, over 4, plus 1."""
    if not _FILTERS:
        _FILTERS.append(mel_filters())
    count = -(-len(samples) // HOP)
    padded = np.pad(np.asarray(samples, np.float32), (0, max(0, (count - 1) * HOP + FRAME - len(samples))))
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP][:count]
    window = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)).astype(np.float32)
    power = np.abs(np.fft.rfft(frames * window, axis=1)[:, :-1]) ** 2
    logs = np.log10(np.maximum(_FILTERS[0] @ power.T.astype(np.float32), 1e-10))
    return ((np.maximum(logs, logs.max() - 8.0) + 4.0) / 4.0).astype(np.float32)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def read_wav_udf(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """read_wav over Arrow batches; NULL for what is no 16-bit WAV."""
    for batch in contents:
        yield batch.map(lambda c: None if c is None else read_wav(bytes(c)))


def log_mel_features(df: DataFrame, key: str, wave: str, rows_at_a_time: int = 16) -> DataFrame:
    """(key, mel): log_mel of the first 30 seconds of each wave, one array per band; NULL for a NULL wave. Features are about a
    megabyte a row, so they are handed over a few rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_a_time):
                part = batch.slice(at, rows_at_a_time)
                mels = [None if not w.is_valid else list(log_mel(fit_length(np.asarray(w.values, np.float32)))) for w in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(mels, pa.list_(pa.list_(pa.float32())))], names=[key, "mel"])

    return df.select(key, wave).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, mel array<array<float>>")


WAV_INFO = T.StructType([T.StructField(n, T.LongType()) for n in ("channels", "rate", "bits", "bytes")])


@F.pandas_udf(WAV_INFO)
def wav_info_udf(heads: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """channels, rate, bits and bytes by the first bytes of files; NULLs for what is no WAV."""
    names = WAV_INFO.fieldNames()
    for batch in heads:
        found = [(wav_header(bytes(c)) if c is not None else None) or {} for c in batch]
        yield pd.DataFrame([[h.get(n) for n in names] for h in found], columns=names).astype("Int64")


@F.pandas_udf(T.DoubleType())
def compression_ratio_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Bytes of a text over those of its zlib form; NULL for NULL."""
    for batch in texts:
        yield batch.map(lambda t: None if t is None else len(t.encode()) / len(zlib.compress(t.encode()))).astype(float)
