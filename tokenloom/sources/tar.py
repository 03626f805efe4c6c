"""Token shards: a Python data source over tar files of records (key, tokens.npy, optional json), in any store.

Null tokens or keys, and keys that can't be stored, fail the write, or with the option ``quarantine`` go to a table of errors
beside the shards. Repeated keys are stored each, and ``load_last`` takes the last. A folder without shards is an error; writing
no rows writes no shard. Columns other than key, tokens, meta, status and error are not written.

A stream draws shards in lanes. For each epoch the shards are dealt anew to the lanes, each to one; a lane draws from its own,
with replacement or each once. What a lane draws follows from the seed, the lane and the number of the draw alone, so the
offset is one number for each lane, a restart draws the same, and a lane is one input partition. A stream into shards commits
them by batch: shards of a batch count once its marker is written, and a batch that is written again replaces them.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import sys
import tarfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from tokenloom.functions import batches as batches_of
from tokenloom.functions.names import segment_key
from tokenloom.sources.store import Store

SCHEMA = "key string, tokens array<smallint>, meta string, shard string, place int"
#: Of a stream: also the lane, the number of the draw in its lane, whether the record ends a lane, and what is wrong with a shard.
STREAMED = f"{SCHEMA}, lane int, draw bigint, ends boolean, error string"
MAX_RECORDS, MAX_BYTES = 10_000, 1 << 30
ERRORS = "key string, status string, error string, source string"
_ARROW = pa.schema([("key", pa.string()), ("tokens", pa.list_(pa.int16())), ("meta", pa.string()), ("shard", pa.string()), ("place", pa.int32())])
_BAD = (tarfile.TarError, EOFError, OSError, ValueError)


#: The header of an array as shards have it; others are left to numpy.
_PLAIN = re.compile(rb"\x93NUMPY\x01\x00..\{'descr': '<i2', 'fortran_order': False, 'shape': \(([0-9]{1,18}),\), \} *\n", re.S)


def _loaded(body: bytes) -> list[int]:
    m = _PLAIN.match(body)
    if m and m.end() == 10 + int.from_bytes(body[8:10], "little") and len(body) == m.end() + 2 * int(m[1]):
        return np.frombuffer(body, "<i2", offset=m.end()).tolist()
    return np.load(io.BytesIO(body), allow_pickle=False).astype(np.int16).ravel().tolist()


@lru_cache(4096)
def _head(n: int) -> bytes:
    """The header of an array of ``n`` tokens, which numpy takes longer to make than a short array's bytes."""
    buffer = io.BytesIO()
    np.lib.format.write_array_header_1_0(buffer, {"descr": "<i2", "fortran_order": False, "shape": (n,)})
    return buffer.getvalue()


def records(path: str, store: Store | None = None) -> Iterator[tuple[str, list[int], str | None, int]]:
    """(key, tokens, meta, place) of the records that have tokens; members of a record stand together. Read as a stream."""
    folder, _, name = path.rpartition("/")
    store = store or Store(folder or ".")
    key, tokens, meta, place = None, None, None, 0
    with store.reader(name) as body, tarfile.open(fileobj=body, mode="r|*") as tar:
        for m in tar:
            if not m.isfile():
                continue
            base, _, kind = m.name.partition(".")
            if base != key:
                if tokens is not None:
                    yield key, tokens, meta, place
                key, tokens, meta, place = base, None, None, place + 1
            body = tar.extractfile(m).read()
            if kind == "tokens.npy":
                tokens = _loaded(body)
            elif kind == "json":
                meta = body.decode()
    if tokens is not None:
        yield key, tokens, meta, place


def _done_name(batch: str) -> str:
    return f"{batch}.done"


def listed(store: Store) -> list[str]:
    """The shards of a folder; those of a stream's batch only once it is committed."""
    done = {n.removesuffix(".done") for n in store.names(".done")}
    return [n for n in store.names(".tar") if not (m := re.match(r"(stream-[0-9a-f]+-batch\d+)-", n)) or m[1] in done]


class _Shard(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Lane(InputPartition):
    """The draws of a lane from ``start`` on, as (number, shard), and whether the lane ends with them."""

    def __init__(self, lane: int, draws: list[tuple[int, str]], ends: bool):
        self.lane, self.draws, self.ends = lane, draws, ends


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.factory = options["path"], options.get("store", "")

    def partitions(self) -> list[InputPartition]:
        found = listed(Store(self.folder, self.factory))
        if not found:
            raise ValueError(f"no .tar shards in {self.folder}")
        return [_Shard(n) for n in found]

    def read(self, partition: _Shard) -> Iterator[pa.RecordBatch]:
        rows = []
        for key, tokens, meta, place in records(partition.name, Store(self.folder, self.factory)):
            rows.append({"key": key, "tokens": tokens, "meta": meta, "shard": partition.name, "place": place})
            if len(rows) == 1024:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class _Done(WriterCommitMessage):
    def __init__(self, task: int, files: list[str], errors: list[str]):
        self.task, self.files, self.errors = task, files, errors


def unfit_key(key: str | None) -> str | None:
    """What is wrong with a key. The first dot parts key and kind, so a key may hold none; it can't be empty or a path either."""
    if not key or "." in key or "/" in key:
        return f"the key {key!r} can't be stored: keys are not empty and hold neither dots nor slashes"
    return None


def _body(r: dict) -> tuple[list[tuple[str, bytes]], str | None]:
    """(kind, bytes) of a record's members, or what keeps it from being stored."""
    wrong = unfit_key(r["key"]) or ("there are no tokens" if r["tokens"] is None else None)
    if wrong:
        return [], wrong
    body = np.asarray(r["tokens"], "<i2").tobytes()
    return [("tokens.npy", _head(len(body) // 2) + body)] + ([("json", r["meta"].encode())] if r.get("meta") is not None else []), None


class _Rolled:
    """What batch and stream writers share: tasks roll shards, and tables of errors, under names of their own."""

    prefix = "."

    def __init__(self, options: dict):
        self.folder, self.factory, self.id = options["path"], options.get("store", ""), uuid.uuid4().hex
        self.most, self.bytes = int(options.get("maxrecords", MAX_RECORDS)), int(options.get("maxbytes", MAX_BYTES))
        self.quarantine = options.get("quarantine", "").lower() == "true"

    def store(self) -> Store:
        return Store(self.folder, self.factory)

    def write(self, rows: Iterable) -> WriterCommitMessage:
        from pyspark import TaskContext

        task, store = TaskContext.get(), self.store()
        store.make()
        own = f"{self.prefix}{self.id}-{task.taskAttemptId()}"
        files, errors, out, tar, n, size = [], [], None, None, 0, 0

        def close() -> None:
            if tar:
                tar.close()
                out.close()

        bad = None
        for r in rows:
            r = r.asDict()
            failed = r.get("status") not in (None, "ok") or r.get("error") is not None
            parts, wrong = ([], r.get("error")) if failed else _body(r)
            if failed or wrong:
                if not self.quarantine:
                    raise ValueError(wrong or f"a row of status {r['status']} can't be stored")
                if bad is None:
                    errors.append(f"{own}-errors.part")
                    bad = store.writer(errors[-1])
                status = r.get("status") if failed and r.get("status") not in (None, "ok") else "error_store"
                bad.write((json.dumps({"key": r["key"], "status": status, "error": wrong, "source": r.get("source")}) + "\n").encode())
                continue
            if tar is None or n >= self.most or size >= self.bytes:
                close()
                files.append(f"{own}-{len(files)}.part")
                out = store.writer(files[-1])
                tar, n, size = tarfile.open(fileobj=out, mode="w|"), 0, 0
            for kind, body in parts:
                info = tarfile.TarInfo(f"{r['key']}.{kind}")
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
                size += len(body)
            n += 1
        close()
        if bad is not None:
            bad.close()
        return _Done(task.partitionId(), files, errors)


class _Writer(_Rolled, DataSourceWriter):
    """Each task rolls its own shards, under names of this write's own; they get their last names when all tasks have succeeded.

    An append goes on numbering where the folder's shards end; an overwrite replaces shards of equal names and only then
    deletes the others.
    """

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options)
        self.overwrite, self.naming = overwrite, options.get("naming", "task")
        if self.naming not in ("task", "shard"):
            raise ValueError(f"shards are named by task or by shard, not by {self.naming}")

    def _names(self, messages: list, old_names: list[str]) -> Iterator[tuple[str, str]]:
        """(written, last name) of every shard, in the order of the tasks."""
        taken: dict[int, int] = {}
        for old in [] if self.overwrite else old_names:
            if m := re.fullmatch(r"(?:task(\d+)-)?shard-?(\d+)\.tar", old):
                task = int(m[1]) if m[1] and self.naming == "task" else 0
                taken[task] = max(taken.get(task, 0), int(m[2]) + 1)
        for done in sorted((m for m in messages if m), key=lambda m: m.task):
            task = done.task if self.naming == "task" else 0
            for f in done.files:
                k = taken.get(task, 0)
                taken[task] = k + 1
                yield f, f"task{task:03d}-shard{k:03d}.tar" if self.naming == "task" else f"shard-{k:03d}.tar"

    def _clear(self) -> None:
        store = self.store()
        for n in store.names(".part", hidden=True):
            if n.startswith(f".{self.id}-"):
                store.remove(n)

    def commit(self, messages: list) -> None:
        store, kept = self.store(), set()
        store.make()
        before = [*store.names(".tar"), *store.names(".errors.jsonl")]
        names = list(self._names(messages, before))
        names += [(e, f"{self.id}-{m.task:05d}.errors.jsonl") for m in messages if m for e in m.errors]
        for written, name in names:
            kept.add(name)
            store.move(written, name)
        if self.overwrite:
            for old in [n for n in before if n not in kept]:
                store.remove(old)
            for old in store.names(".done"):
                store.remove(old)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()


class _StreamWriter(_Rolled, DataSourceStreamWriter):
    """Shards named by stream and batch. A batch counts by its marker, which lists them and is written last.

    A batch that comes again, since the query ended between the sink's commit and its own, replaces what it had; what
    attempts before have left is cleared. Two streams may write into one folder under names of their own.
    """

    prefix = ".stream-"

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options)
        name = options.get("streamname", "")
        if not name:
            raise ValueError("a stream into shards needs a name that stays the same over restarts (streamname)")
        if self.quarantine:
            raise ValueError("a stream into shards has no table of errors: take bad records out before")
        self.stream = hashlib.blake2b(name.encode(), digest_size=6).hexdigest()
        self.prefix = f".stream-{self.stream}-"

    def commit(self, messages: list, batchId: int) -> None:
        store, batch = self.store(), f"stream-{self.stream}-batch{batchId:09d}"
        store.make()
        if store.exists(_done_name(batch)):
            store.remove(_done_name(batch))
        for old in store.names(".tar"):
            if old.startswith(f"{batch}-"):
                store.remove(old)
        names = []
        for done in sorted((m for m in messages if m), key=lambda m: m.task):
            for f in done.files:
                names.append(f"{batch}-shard{len(names):05d}.tar")
                store.move(f, names[-1])
        store.write(_done_name(batch), "\n".join(names).encode())
        self._clear()

    def _clear(self) -> None:
        store = self.store()
        for n in store.names(".part", hidden=True):
            if n.startswith(self.prefix):
                store.remove(n)

    def abort(self, messages: list, batchId: int) -> None:
        self._clear()


class Draws:
    """What the lanes of a stream draw: for each epoch the shards are dealt to the lanes by a hash of the seed and the epoch."""

    def __init__(self, shards: list[str], lanes: int, seed: int, once: bool, epochs: int):
        if not shards or lanes > len(shards):
            raise ValueError(f"{len(shards)} shards can't be dealt to {lanes} lanes")
        self.shards, self.lanes, self.seed, self.once, self.epochs = shards, lanes, seed, once, epochs
        self._dealt: tuple[int, list[str]] = (-1, [])

    def _hash(self, *of) -> int:
        return int.from_bytes(hashlib.blake2b(":".join(map(str, (self.seed, *of))).encode(), digest_size=8).digest(), "big")

    def each(self, lane: int) -> int:
        """Draws of a lane in an epoch: as many as it is dealt shards."""
        return len(range(lane, len(self.shards), self.lanes))

    def last(self, lane: int) -> int | None:
        """Draws of a lane in all, or none for an endless stream."""
        return self.each(lane) * self.epochs if self.epochs else None

    def own(self, lane: int, epoch: int) -> list[str]:
        if self._dealt[0] != epoch:
            self._dealt = epoch, sorted(self.shards, key=lambda s: (self._hash("deal", epoch, s), s))
        return self._dealt[1][lane :: self.lanes]

    def draw(self, lane: int, n: int) -> str:
        if self.lanes == 1 and not self.once:  # one lane has all shards in every epoch
            return self.shards[self._hash(n) % len(self.shards)]
        epoch, k = divmod(n, self.each(lane))
        own = self.own(lane, epoch)
        return own[k] if self.once else own[self._hash("draw", lane, n) % len(own)]


class _Draws(DataSourceStreamReader):
    """The lanes' draws as micro-batches; the offset holds the number of draws of each lane, and of what they are drawn."""

    def __init__(self, options: dict):
        self.folder, self.factory = options["path"], options.get("store", "")
        self.step, self.rows = int(options.get("shardspertrigger", 1)), options.get("badshards", "skip") == "rows"
        shards = listed(Store(self.folder, self.factory))
        if not shards:
            raise ValueError(f"no .tar shards in {self.folder}")
        self.draws = Draws(shards, int(options.get("lanes", 1)), int(options.get("seed", 101)), options.get("replacement", "true").lower() != "true", int(options.get("epochs", 0)))
        of = [shards, self.draws.seed, self.draws.once]
        self.of = hashlib.blake2b(json.dumps(of).encode(), digest_size=8).hexdigest()
        self.next: list[int] | None = None

    def _offset(self, at: list[int]) -> dict:
        return {"lanes": len(at), "of": self.of} | {f"lane{i}": n for i, n in enumerate(at)}

    def _at(self, offset: dict) -> list[int]:
        if offset["lanes"] != self.draws.lanes:
            raise ValueError(f"the stream was begun with {offset['lanes']} lanes and can't go on with {self.draws.lanes}")
        if offset["of"] != self.of:
            raise ValueError("the shards, the seed or the way to draw have changed since the stream was begun")
        return [offset[f"lane{i}"] for i in range(self.draws.lanes)]

    def initialOffset(self) -> dict:
        return self._offset([0] * self.draws.lanes)

    def latestOffset(self) -> dict:
        ends = [self.draws.last(i) for i in range(self.draws.lanes)]
        self.next = [n + self.step if e is None else min(e, n + self.step) for n, e in zip(self.next or [0] * len(ends), ends, strict=True)]
        return self._offset(self.next)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        begin, stop = self._at(start), self._at(end)
        self.next = list(map(max, self.next or stop, stop))  # a restart plans its last batch first
        return [
            _Lane(i, [(n, self.draws.draw(i, n)) for n in range(a, b)], b == self.draws.last(i))
            for i, (a, b) in enumerate(zip(begin, stop, strict=True)) if a < b
        ]

    def read(self, partition: _Lane) -> Iterator[tuple]:
        store, n = Store(self.folder, self.factory), 0
        for n, name in partition.draws:
            try:
                for key, tokens, meta, place in records(name, store):
                    yield key, tokens, meta, name, place, partition.lane, n, False, None
            except _BAD as e:  # a bad shard ends here; the stream goes on
                print(f"shard {name} is broken: {e}", file=sys.stderr)
                if self.rows:
                    yield None, None, None, name, None, partition.lane, n, False, str(e)[:100]
        if partition.ends and self.rows:
            yield None, None, None, None, None, partition.lane, n, True, None


class TokenTar(DataSource):
    """``format("tokentar")`` with a path in a store that driver and executors share; option store names a factory of it.

    Options of writes: maxrecords, maxbytes, naming (task: task000-shard000.tar; shard: shard-000.tar), quarantine (true:
    rows that can't be stored go to a table of errors). Of a stream to read: seed, lanes, shardspertrigger (of each lane),
    replacement, epochs (0: endless), badshards (skip, or rows: a row with the error, and one at the end of each lane).
    Of a stream to write: streamname.
    """

    @classmethod
    def name(cls) -> str:
        return "tokentar"

    def schema(self) -> str:
        return STREAMED if self.options.get("lanes") else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Draws(dict(self.options) | {"lanes": self.options.get("lanes") or "1"})

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(dict(self.options), overwrite)


def read_tokens(spark: SparkSession, folder: str, store: str = "") -> DataFrame:
    spark.dataSource.register(TokenTar)
    return spark.read.format("tokentar").option("store", store).load(folder)


def write_tokens(df: DataFrame, folder: str, mode: str = "overwrite", **options) -> None:
    """Columns key, tokens and, if wanted, meta (a JSON string); with ``quarantine`` also status and error."""
    df.sparkSession.dataSource.register(TokenTar)
    df.write.format("tokentar").mode(mode).options(**options).save(folder)


def read_errors(spark: SparkSession, folder: str) -> DataFrame:
    """(key, status, error, source) of the rows that writes with ``quarantine`` could not store."""
    found = spark.read.schema(ERRORS).option("pathGlobFilter", "*.errors.jsonl")
    return found.json(folder)


def token_meta(file_id, segment, tokens, path):
    """The JSON side-car of a record."""
    return F.to_json(F.struct(file_id.alias("file_id"), segment.alias("segment_id"), F.size(tokens).alias("token_count"), path.alias("audio_filepath")))


def load_last(spark: SparkSession, folder: str) -> DataFrame:
    """(key, tokens): of equal keys, the record of the last shard, and there the last, wins."""
    return read_tokens(spark, folder).groupBy("key").agg(F.max_by("tokens", F.struct("shard", "place")).alias("tokens"))


def stream_tokens(spark: SparkSession, folder: str, seed: int = 101, shards: int = 1, **options) -> DataFrame:
    """The endless stream of records of shards drawn with replacement, ``shards`` of them for each micro-batch and lane."""
    spark.dataSource.register(TokenTar)
    options = {"lanes": 1, "seed": seed, "shardspertrigger": shards} | options
    return spark.readStream.format("tokentar").option("path", folder).options(**{k: str(v) for k, v in options.items()}).load()


def token_records(df: DataFrame, file_id: str = "file_id", tokens: str = "tokens", path: str = "audio_filepath", segment: int = 0, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, tokens, meta) as shards store them: the key is the id's stem and the segment, meta the JSON side-car."""
    meta = token_meta(F.col(file_id), F.lit(segment), F.col(tokens), F.col(path))
    return df.select(segment_key(F.col(file_id), segment).alias("key"), F.col(tokens).cast("array<smallint>").alias("tokens"), meta.alias("meta"), *also)


#: The JSON side-car of a record.
META = "file_id string, segment_id int, token_count int, audio_filepath string"


def with_meta(df: DataFrame) -> DataFrame:
    """Records with their side-car as a struct; null where there is none or it is no JSON."""
    return df.withColumn("meta", F.from_json("meta", META))


#: What Spark doesn't read of a folder, as the beginning of a regular expression of names.
_SHOWN = r"(?!\.|_(?!.*=)|.*\._COPYING_$)"


def _places(spark: SparkSession, glob_path: str) -> list[tuple[str, str]]:
    """The folders that a path with wildcards finds files in, each with a regular expression of their names; both by Hadoop's rules."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for one in hadoop.GlobExpander.expand(glob_path):
        path = hadoop.Path(one)
        own = path.getFileSystem(conf)
        path = own.makeQualified(path)
        names = _SHOWN + hadoop.GlobPattern(path.getName()).compiled().pattern()
        found += [(f.getPath().toString(), names) for f in own.globStatus(path.getParent()) or [] if f.isDirectory()]
    return found


def _below(folder: str, names: str, store: str) -> Iterator[str]:
    """The files of a folder whose names match, and those directly in its folders whose names do."""
    own, match = Store(folder, store), re.compile(names, re.S).fullmatch
    for name, is_file in own.entries():
        if match(name):
            if is_file:
                yield f"{folder.rstrip('/')}/{name}"
            elif not store:
                yield from (f"{folder.rstrip('/')}/{name}/{n}" for n, f in own.entries(own.at(name)) if f and re.match(_SHOWN, n, re.S))


def broken_shards(spark: SparkSession, glob_path: str, store: str = "") -> DataFrame:
    """(path, error) of the tar files that can't be listed to their end; each is read as a stream.

    Spark finds the folders; a task lists all of a folder, and their files are dealt to as many tasks as a shuffle has. A path
    without files is an error. With a factory, ``glob_path`` is a folder of its store, and all its .tar files are read.
    """

    def listed(batches):
        for folders, names in batches_of.slices(batches):
            for place in zip(folders, names, strict=True):
                paths = _below(*place, store)
                while some := list(islice(paths, 1024)):
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["path"])

    def test(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for path in f["path"]:
                folder, _, name = path.rpartition("/")
                try:
                    with Store(folder, store).reader(name) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
                        for m in tar:
                            if m.isfile():
                                body, n = tar.extractfile(m), 0
                                while part := body.read(1 << 20):
                                    n += len(part)
                                if n != m.size:
                                    raise tarfile.ReadError("a member is cut short")
                except (tarfile.TarError, EOFError, OSError) as e:
                    rows.append((path, str(e)[:100]))
            yield pd.DataFrame(rows, columns=["path", "error"])

    places = [(glob_path, r"(?!\.).*\.tar")] if store else _places(spark, glob_path)
    if not store and not any(True for p in places for _ in _below(*p, store)):
        raise FileNotFoundError(f"there are no files {glob_path}")
    paths = spark.createDataFrame(places, "folder string, names string").mapInArrow(listed, "path string")
    return paths.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInPandas(test, "path string, error string")
