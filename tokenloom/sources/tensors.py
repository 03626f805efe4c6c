"""Model files of tensors (safetensors): a data source with a row for each tensor, and a sink.

A file is eight bytes that tell the size of a JSON header, the header (name, type, shape and place of each tensor), and the data.
Tasks read ranges of bytes of about ``maxbytes``, each a run of neighbouring tensors or a part of a larger one, so a model of any
size is read by many tasks and no task holds more than a range. With ``taskbytes``, a task reads ranges of so many bytes in all,
one after the other, and finds them in its file's header itself: the scan is planned from sizes alone, also of many small tensors.

A file that is cut short or whose header contradicts itself is an error, as is a folder without one; a scalar has an empty shape;
an empty tensor a row with no data; a name may stand in several files. In writes a null name, type, shape or data, an unknown
type and data of another size than the shape's fail; repeated names of one task fail too.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tokenloom.sources.store import Store

SCHEMA = "file string, name string, dtype string, shape array<bigint>, part int, n_bytes bigint, data binary"
MAX_BYTES, MOST_HEADER = 64 << 20, 100 << 20
#: Tensors of a file that a task writes, so that headers stay small.
MOST_TENSORS = 50_000
#: Bytes of an element of each type.
SIZES = {"BOOL": 1, "U8": 1, "I8": 1, "I16": 2, "U16": 2, "F16": 2, "BF16": 2, "I32": 4, "U32": 4, "F32": 4, "I64": 8, "U64": 8, "F64": 8}
#: Their numpy types; BF16 has none and is read as the upper half of a float.
_NUMPY = {"BOOL": "?", "U8": "<u1", "I8": "<i1", "I16": "<i2", "U16": "<u2", "F16": "<f2", "I32": "<i4", "U32": "<u4", "F32": "<f4", "I64": "<i8", "U64": "<u8", "F64": "<f8"}


def header(store: Store, name: str) -> tuple[int, list[tuple[str, str, list[int], int, int]]]:
    """(where the data begins, (tensor, type, shape, begin, end) in the order of the data)."""
    whole = store.size(name)
    with store.random(name) as f:
        size = int.from_bytes(f.read(8), "little") if whole >= 8 else -1
        if not 0 < size <= min(MOST_HEADER, whole - 8):
            raise ValueError(f"{name} is no file of tensors, or it is cut short")
        told = json.loads(f.read(size))
    rows = sorted(((n, t["dtype"], t["shape"], *t["data_offsets"]) for n, t in told.items() if n != "__metadata__"), key=lambda r: (r[3], r[4], r[0]))
    for n, dtype, shape, begin, end in rows:
        if dtype not in SIZES or end - begin != math.prod(shape) * SIZES[dtype] or begin < 0:
            raise ValueError(f"{name}: the tensor {n} contradicts its type or shape")
        if 8 + size + end > whole:
            raise ValueError(f"{name} is cut short")
    return 8 + size, rows


def array(dtype: str, shape: list[int], data: bytes) -> np.ndarray:
    if dtype == "BF16":
        return (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32).reshape(shape)
    return np.frombuffer(data, _NUMPY[dtype]).reshape(shape)


def load(folder: str, store: str = "") -> dict[str, np.ndarray]:
    """All tensors of a folder's files, for a scorer that holds its model."""
    home, out = Store(folder, store), {}
    for name in home.names(".safetensors"):
        base, rows = header(home, name)
        with home.random(name) as f:
            for n, dtype, shape, begin, end in rows:
                f.seek(base + begin)
                out[n] = array(dtype, shape, f.read(end - begin))
    return out


class _Range(InputPartition):
    """Tensors of a file, or parts of one: (name, type, shape, part, begin, end)."""

    def __init__(self, file: str, base: int, pieces: list[tuple]):
        self.file, self.base, self.pieces = file, base, pieces


class _Stretch(InputPartition):
    """The tensors, or parts of them, that begin at the places begin..end of a file's data; the last stretch has no end."""

    def __init__(self, file: str, begin: int, end: int | None):
        self.file, self.begin, self.end = file, begin, end


def _pieces(rows: list[tuple], most: int) -> Iterator[tuple]:
    """Tensors in parts of ``most`` bytes: (name, type, shape, part, begin, end)."""
    for name, dtype, shape, begin, end in rows:
        cuts = [*range(begin, end, most), end] if end > begin else [begin, end]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            yield name, dtype, shape, k, a, b


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.factory = options["path"], options.get("store", "")
        self.most, self.data = int(options.get("maxbytes", MAX_BYTES)), options.get("data", "true").lower() == "true"
        self.task = int(options.get("taskbytes", 0))

    def partitions(self) -> list[InputPartition]:
        store, out = Store(self.folder, self.factory), []
        files = store.names(".safetensors")
        if not files:
            raise ValueError(f"no .safetensors files in {self.folder}")
        if self.task:
            for file in files:
                begins = range(0, max(1, store.size(file)), self.task)
                out += [_Stretch(file, a, a + self.task if a != begins[-1] else None) for a in begins]
            return out
        for file in files:
            base, rows = header(store, file)
            held, size = [], 0
            for piece in _pieces(rows, self.most):
                n = piece[5] - piece[4]
                if held and size + n > self.most:
                    out.append(_Range(file, base, held))
                    held, size = [], 0
                held.append(piece)
                size += n
            if held:
                out.append(_Range(file, base, held))
        return out

    def read(self, partition: _Range | _Stretch) -> Iterator[tuple]:
        store = Store(self.folder, self.factory)
        if isinstance(partition, _Range):
            base, pieces = partition.base, partition.pieces
        else:
            base, rows = header(store, partition.file)
            pieces = (p for p in _pieces(rows, self.most) if partition.begin <= p[4] and (partition.end is None or p[4] < partition.end))
        with store.random(partition.file) as f:
            for name, dtype, shape, part, begin, end in pieces:
                body = None
                if self.data:
                    f.seek(base + begin)
                    body = f.read(end - begin)
                yield partition.file, name, dtype, shape, part, end - begin, body


class _Done(WriterCommitMessage):
    def __init__(self, task: int, files: list[str]):
        self.task, self.files = task, files  # none without rows


class _Writer(DataSourceWriter):
    """Each task writes a file, or several of ``mosttensors``: the data first, then the header and the data behind it, both as streams."""

    def __init__(self, options: dict, overwrite: bool):
        import uuid

        self.folder, self.factory, self.overwrite, self.id = options["path"], options.get("store", ""), overwrite, uuid.uuid4().hex
        self.most = int(options.get("mosttensors", MOST_TENSORS))

    def write(self, rows: Iterable) -> WriterCommitMessage:
        from pyspark import TaskContext

        task, store, names, files = TaskContext.get(), Store(self.folder, self.factory), set(), []
        store.make()
        own, out, told, at = f".{self.id}-{task.taskAttemptId()}", None, {}, 0

        def close() -> None:
            out.close()
            body = json.dumps(told).encode()
            body += b" " * (-len(body) % 8)
            files.append(f"{own}-{len(files)}.file.part")
            with store.writer(files[-1]) as whole, store.reader(f"{own}.data.part") as data:
                whole.write(len(body).to_bytes(8, "little") + body)
                while part := data.read(1 << 20):
                    whole.write(part)
            store.remove(f"{own}.data.part")

        for r in rows:
            name, dtype, shape, data = (r[c] for c in ("name", "dtype", "shape", "data"))
            if name is None or name in names or dtype not in SIZES or shape is None or data is None or len(data) != math.prod(shape) * SIZES[dtype]:
                raise ValueError(f"the tensor {name!r} can't be stored: its name is null or repeated, or its data contradicts its type or shape")
            if len(told) == self.most:
                close()
                out, told, at = None, {}, 0
            out = out or store.writer(f"{own}.data.part")
            out.write(bytes(data))
            names.add(name)
            told[name] = {"dtype": dtype, "shape": list(shape), "data_offsets": [at, at + len(data)]}
            at += len(data)
        if out is not None:
            close()
        return _Done(task.partitionId(), files)

    def commit(self, messages: list) -> None:
        store, done = Store(self.folder, self.factory), [f for m in sorted((m for m in messages if m), key=lambda m: m.task) for f in m.files]
        store.make()
        old = set(store.names(".safetensors"))
        if old and not self.overwrite:
            raise ValueError(f"{self.folder} has tensors already: overwrite them, or write into another folder")
        for k, file in enumerate(done, 1):
            store.move(file, name := f"model-{k:05d}-of-{len(done):05d}.safetensors")
            old.discard(name)
        for name in old:
            store.remove(name)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store = Store(self.folder, self.factory)
        for n in store.names(".part", hidden=True):
            if n.startswith(f".{self.id}-"):
                store.remove(n)


class Tensors(DataSource):
    """``format("tensors")`` of a folder of .safetensors files; options store, maxbytes (of a range), taskbytes (of a task that
    reads several), data (false: headers alone). Of writes: mosttensors of a file.
    """

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)


def read_tensors(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(Tensors)
    return spark.read.format("tensors").options(**{k: str(v) for k, v in options.items()}).load(folder)


def write_tensors(df: DataFrame, folder: str, mode: str = "append", **options) -> None:
    """Columns name, dtype, shape and data, one file for each task that has rows (several of very many tensors); a folder that has tensors is only overwritten."""
    df.sparkSession.dataSource.register(Tensors)
    df.select("name", "dtype", "shape", "data").write.format("tensors").mode(mode).options(**options).save(folder)
