"""Directory scans and audio files.

Files that can't be read, null contents too, become an error of their row; a file met twice is listed once; a folder
without audio gives no rows. Columns of the input stay beside those of the decoder, whose names it must not have.
"""

from __future__ import annotations

import io
import math
import os
import wave
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tokenloom.functions.names import AUDIO_SUFFIXES, file_name, is_audio, parent, stem
from tokenloom.sources.store import Store

RATE = 16_000


#: Files of one folder that a task lists by itself, and tasks that one folder is split into at most: each lists the whole folder.
LISTED, MOST_SLICES = 1000, 16


class _Part(InputPartition):
    """All below a folder, or every ``slices``-th of its own files by a hash of the name."""

    def __init__(self, path: str, slices: int = 0, own: int = 0):
        self.path, self.slices, self.own = path, slices, own


class _Walker(DataSourceReader):
    def __init__(self, root: str, with_root: bool, factory: str, listed: int):
        self.root, self.with_root, self.factory, self.listed = root, with_root, factory, listed

    def partitions(self) -> list[InputPartition]:
        """For each folder in the root (or the root, without one), its own files in slices and each folder in it."""
        store = Store(self.root, self.factory)
        if not list(store.entries()) and store.fs.get_file_info(store.root).type != fs.FileType.Directory:
            raise ValueError(f"there is no folder {self.root}")

        def split(path: str) -> tuple[list[InputPartition], list[str]]:
            entries = list(store.entries(path))
            files = sum(is_file for _, is_file in entries)
            slices = min(MOST_SLICES, -(-files // self.listed))
            below = [f"{path.rstrip('/')}/{n}" for n, is_file in entries if not is_file]
            return [_Part(path, slices, k) for k in range(slices)], below if path == store.root else [b for b in below if not os.path.islink(b)]

        own, tops = split(store.root)
        out = own if self.with_root or not tops else []
        for top in sorted(tops):
            files, below = split(top)
            out += files + [_Part(b) for b in sorted(below)]
        return out or [_Part(store.root, 1, 0)]

    def read(self, partition: _Part) -> Iterator[tuple[str]]:
        store, todo = Store(self.root, self.factory), [partition.path]
        local = isinstance(store.fs, fs.LocalFileSystem)
        while todo:
            folder = todo.pop()
            real = os.path.realpath(folder) if local else folder.rstrip("/")
            for name, is_file in store.entries(folder):
                whole = f"{folder.rstrip('/')}/{name}"
                if not is_file:
                    todo += [] if partition.slices or (local and os.path.islink(whole)) else [whole]
                elif os.path.splitext(name)[1].lower() in AUDIO_SUFFIXES and (not partition.slices or zlib.crc32(name.encode()) % partition.slices == partition.own):
                    yield (os.path.realpath(whole) if local and os.path.islink(whole) else f"{real.rstrip('/')}/{name}",)


class AudioWalk(DataSource):
    """``format("audiowalk")``: paths of audio files, hidden ones included; option withroot takes the root's own files too, and
    store names a factory of the store, and listed how many files of a folder make a task.
    """

    @classmethod
    def name(cls) -> str:
        return "audiowalk"

    def schema(self) -> str:
        return "path string"

    def reader(self, schema) -> DataSourceReader:
        return _Walker(self.options["path"], self.options.get("withroot", "false").lower() == "true", self.options.get("store", ""), int(self.options.get("listed", LISTED)))


def scan_directory(spark: SparkSession, root: str, with_root: bool = False, store: str = "") -> DataFrame:
    """file_id, audio_filepath of the audio files below a folder of a shared store, by folder, then name."""
    spark.dataSource.register(AudioWalk)
    found = spark.read.format("audiowalk").option("withroot", str(with_root)).option("store", store).load(root)
    return manifest_of(found)


def scan_store(spark: SparkSession, root: str) -> DataFrame:
    """The same through Spark's own listing, for object stores; names that begin with _ or . are not listed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    return manifest_of(found.where(is_audio(F.col("path"))))


def manifest_of(paths: DataFrame) -> DataFrame:
    path = F.col("path")
    return paths.orderBy(parent(path), file_name(path)).select(stem(path).alias("file_id"), path.alias("audio_filepath"))


def _samples(raw: bytes, width: int, channels: int) -> np.ndarray:
    """The first channel of PCM data, in -1..1."""
    if width == 1:
        return (np.frombuffer(raw, np.uint8)[::channels].astype(np.float32) - 128) / 128
    if width == 3:  # 24 bits: the three bytes become the upper ones of 32
        own = np.frombuffer(raw, np.uint8).reshape(-1, 3)[::channels]
        wide = np.zeros((len(own), 4), np.uint8)
        wide[:, 1:] = own
        return wide.view("<i4").ravel().astype(np.float32) / float(1 << 31)
    if width in (2, 4):
        return np.frombuffer(raw, np.int16 if width == 2 else np.int32)[::channels].astype(np.float32) / float(1 << (8 * width - 1))
    raise ValueError(f"samples of {width} bytes are not served")


def decode_wav(body: bytes) -> tuple[np.ndarray, int]:
    """(samples of the first channel in -1..1, rate) of PCM data."""
    with wave.open(io.BytesIO(body)) as w:
        raw = w.readframes(w.getnframes())
        return _samples(raw[: len(raw) // (w.getsampwidth() * w.getnchannels()) * w.getsampwidth() * w.getnchannels()], w.getsampwidth(), w.getnchannels()), w.getframerate()


class Polyphase:
    """Windowed-sinc resampling by a bank of filters, one for each place of an output between two inputs.

    Outputs repeat their places after ``up`` of them and ``down`` inputs, so the bank is made once for two rates. Inputs come
    in parts of any size; what is held is a part, the inputs that later outputs still reach, and the outputs of a part.
    """

    def __init__(self, rate: int, to: int, zeros: int = 16):
        g = math.gcd(rate, to)
        self.rate, self.to, self.up, self.down = rate, to, to // g, rate // g
        cutoff = min(1.0, to / rate)
        self.half = math.ceil(zeros / cutoff)
        places = (np.arange(self.up) * self.down % self.up) / self.up
        d = places[:, None] - np.arange(-self.half + 1, self.half + 1)
        self.bank = cutoff * np.sinc(cutoff * d) * (0.5 + 0.5 * np.cos(np.pi * np.clip(d / self.half, -1, 1)))

    def _made(self, held: np.ndarray, first: int, begin: int, end: int) -> np.ndarray:
        """Outputs begin..end from the inputs ``held``, of which the first is input ``first``; begin is a multiple of ``up``."""
        out, taps, at = np.empty(end - begin, np.float32), 2 * self.half, begin // self.up * self.down - self.half + 1 - first
        for p in range(min(self.up, end - begin)):
            n = len(range(p, end - begin, self.up))
            part = held[at + p * self.down // self.up :]
            rows = np.lib.stride_tricks.as_strided(part, (n, taps), (self.down * part.itemsize, part.itemsize), writeable=False)
            out[p :: self.up] = rows @ self.bank[p]
        return out

    def run(self, parts: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
        held, first, begin, seen = np.zeros(self.half), -self.half, 0, 0
        for x in parts:
            held, seen = np.concatenate([held, x]), seen + len(x)
            end = max(0, (seen - self.half) * self.up // self.down) // self.up * self.up
            if end > begin:
                yield self._made(held, first, begin, end)
                begin, keep = end, end // self.up * self.down - self.half
                held, first = held[keep - first :].copy(), keep
        end = -(-seen * self.to // self.rate)
        if end > begin:
            yield self._made(np.concatenate([held, np.zeros(2 * self.half + self.down)]), first, begin, end)


#: Frames of audio that are decoded and resampled at a time.
FRAMES = 1 << 18
_BANKS: dict[tuple[int, int, int], Polyphase] = {}


def _bank(rate: int, to: int, zeros: int) -> Polyphase:
    if (rate, to, zeros) not in _BANKS:
        if len(_BANKS) >= 16:
            _BANKS.clear()
        _BANKS[rate, to, zeros] = Polyphase(rate, to, zeros)
    return _BANKS[rate, to, zeros]


def resample(x: np.ndarray, rate: int, to: int = RATE, zeros: int = 16) -> np.ndarray:
    """Windowed-sinc resampling; the input itself at an equal rate."""
    if rate == to or not len(x):
        return x
    return np.concatenate(list(_bank(rate, to, zeros).run(x[at : at + FRAMES] for at in range(0, len(x), FRAMES))))


def decode_at(body: bytes, to: int = RATE, least: float = 0.0) -> tuple[np.ndarray, int, int]:
    """(samples of the first channel at the rate ``to``, samples there were, rate there was), a part of the file at a time.

    What is shorter than ``least`` seconds by its header is only counted; no sample of it is returned.
    """
    with wave.open(io.BytesIO(body)) as w:
        width, channels, rate, n = w.getsampwidth(), w.getnchannels(), w.getframerate(), 0

        def parts() -> Iterator[np.ndarray]:
            nonlocal n
            while raw := w.readframes(FRAMES):
                x = _samples(raw[: len(raw) // (width * channels) * width * channels], width, channels)
                n += len(x)
                yield x

        if w.getnframes() < least * rate:
            done = (x[:0] for x in parts())
            return np.concatenate([np.empty(0, np.float32), *done]), n, rate
        done = parts() if rate == to else _bank(rate, to, 16).run(parts())
        return np.concatenate([np.empty(0, np.float32), *done]), n, rate


def load_audio(df: DataFrame, content: str = "content", to: int = RATE) -> DataFrame:
    """Add wave, rate, n_samples, native_rate and error, from a binary column of WAV files."""
    more = "wave array<float>, rate int, n_samples int, native_rate int, error string"

    @F.pandas_udf(f"struct<{more.replace(' ', ':').replace(',:', ',')}>")
    def decode(bodies: pd.Series) -> pd.DataFrame:
        rows = []
        for b in bodies:
            try:
                x, n, rate = decode_at(bytes(b), to)
                rows.append((x.tolist(), to, n, rate, None))
            except Exception as e:  # a bad file is counted, not fatal
                rows.append((None, None, None, None, str(e)[:100] or type(e).__name__))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in more.split(", ")]).astype({"rate": "Int32", "n_samples": "Int32", "native_rate": "Int32"})

    return df.withColumn("_d", decode(F.col(content))).select(*df.columns, "_d.*")
