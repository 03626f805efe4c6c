"""Packing as a stream: token sequences in, full blocks out, the rest kept as state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tokenloom.operators.blocks import BLOCK
from tokenloom.sources import tar
from tokenloom.streaming.shuffle import BUFFER, keep_state, shuffle_buffer

OUT = "lane bigint, block_id bigint, tokens array<int>"
STATE = "done bigint, rest array<int>"


class Packer:
    """Blocks of one lane, cut from a buffer that is walked with an offset; what is left is ``rest``."""

    def __init__(self, bos: int, eos: int, size: int, done: int, rest: Iterable[int]):
        self.bos, self.eos, self.size, self.done = bos, eos, size, done
        self.parts, self.held = [np.asarray(list(rest), np.int64)], len(rest)

    def push(self, tokens: Iterable[int]) -> Iterator[tuple[int, list[int]]]:
        """(block_id, tokens) of the blocks that a sequence fills."""
        self.parts.append(np.concatenate([[self.bos], np.asarray(tokens, np.int64), [self.eos]]))
        self.held += len(self.parts[-1])
        if self.held < self.size:
            return
        whole, at = np.concatenate(self.parts), 0
        while self.held - at >= self.size:
            yield self.done, whole[at : at + self.size].tolist()
            self.done, at = self.done + 1, at + self.size
        self.parts, self.held = [whole[at:].copy()], self.held - at

    @property
    def rest(self) -> list[int]:
        return np.concatenate(self.parts).tolist()


def stream_pack(df: DataFrame, tokens: str, bos: int, eos: int, size: int, order: str, lanes: int | None = None) -> DataFrame:
    """Blocks of a streaming DataFrame. Sequences are dealt to lanes by a hash of ``order``, in its order within a batch.

    There are as many lanes as asked for, or as shuffle partitions; a stream must keep their number. A lane keeps fewer than
    ``size`` tokens, and what one micro-batch brings it is sorted in its task. Blocks span sequences and micro-batches. Null
    sequences give nothing; repeated ones are packed each; an empty one is its two marks.
    """
    lanes = lanes or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        packer = Packer(bos, eos, size, *(state.get if state.exists else (0, [])))
        whole = pd.concat(list(frames)).sort_values("o")
        rows = [(key[0], n, block) for t in whole["t"] for n, block in packer.push(t)]
        state.update((packer.done, packer.rest))
        yield pd.DataFrame(rows, columns=["lane", "block_id", "tokens"])

    lane = F.pmod(F.xxhash64(order), F.lit(lanes)).alias("lane")
    dealt = df.where(F.col(tokens).isNotNull()).select(lane, F.col(order).alias("o"), F.col(tokens).alias("t"))
    return dealt.groupBy("lane").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


class _Pack(StatefulProcessor):
    """Packs a lane's sequences in the order of their numbers; the row that ends a lane drops the rest."""

    def __init__(self, bos: int, eos: int, size: int):
        self.marks = bos, eos, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rest", "done bigint, number bigint, rest array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done, last, rest = self.state.get() if self.state.exists() else (0, -1, [])
        packer = Packer(*self.marks, done, list(rest))
        for f in rows:
            out = []
            for number, tokens, ends in zip(f["number"], f["tokens"], f["ends"], strict=True):
                if int(number) != last + 1:
                    raise RuntimeError(f"lane {key[0]} came out of order: let a micro-batch hold fewer shards")
                if ends:
                    packer = Packer(*self.marks, packer.done, [])
                else:
                    last = int(number)
                    out += [(int(key[0]), n, block) for n, block in packer.push(tokens)]
            yield pd.DataFrame(out, columns=["lane", "block_id", "tokens"])
        self.state.update((packer.done, last, packer.rest))

    def close(self) -> None:
        pass


def pack_lanes(df: DataFrame, bos: int, eos: int, size: int = BLOCK) -> DataFrame:
    """(lane, block_id, tokens): blocks of what leaves a shuffle buffer, each lane by itself and in its order.

    A lane's state is fewer than ``size`` tokens, and no more than a frame of records is held with them.
    """
    return keep_state(df).groupBy("lane").transformWithStateInPandas(_Pack(bos, eos, size), OUT, "append", "none")


def training_blocks(spark: SparkSession, folder: str, bos: int, eos: int, size: int = BLOCK, lanes: int = 1, seed: int = 101, buffer: int = BUFFER, **options) -> DataFrame:
    """The training stream: shards drawn in lanes, a shuffle buffer for each, and blocks of what leaves it.

    A lane stands for a worker: lanes share no shard of an epoch, have their own buffer and rest, and their number can't change
    over restarts. Draws, buffers and blocks follow from the seed alone. Options are those of the stream of shards: store,
    shardspertrigger, replacement, epochs. Broken shards are counted by the observation ``shards`` of each batch's progress.
    """
    rows = tar.stream_tokens(spark, folder, seed, **{"lanes": lanes, "badshards": "rows"} | options)
    seen = rows.observe("shards", F.count("tokens").alias("records"), F.count("error").alias("broken"))
    return pack_lanes(shuffle_buffer(seen, buffer, seed), bos, eos, size)


def write_blocks(blocks: DataFrame, folder: str, checkpoint: str, lanes: int | None = None, **options) -> StreamingQuery:
    """Start a query that writes blocks into shards, each exactly once over restarts from the checkpoint folder.

    Records are keyed by lane and block. The stream's name in the folder is its checkpoint's path. With ``lanes``, a stateful step
    has that many partitions at most: each costs every micro-batch a task with a state store, also without a lane.
    """
    spark, shuffled = blocks.sparkSession, "spark.sql.shuffle.partitions"
    spark.dataSource.register(tar.TokenTar)
    key = F.format_string("lane%04d-%012d", "lane", "block_id")
    rows = blocks.select(key.alias("key"), F.col("tokens").cast("array<smallint>").alias("tokens"))
    writer = rows.writeStream.format("tokentar").option("path", folder).option("streamname", checkpoint).option("checkpointLocation", checkpoint)
    before = spark.conf.get(shuffled)
    spark.conf.set(shuffled, min(int(before), lanes or int(before)))
    try:  # the query keeps the session's settings as they are at its start
        return writer.options(**{k: str(v) for k, v in options.items()}).start()
    finally:
        spark.conf.set(shuffled, before)


def read_blocks(spark: SparkSession, folder: str, store: str = "") -> DataFrame:
    """(lane, block_id, tokens) of a folder that a stream of blocks writes; only whole batches count."""
    key = F.col("key")
    lane, block = F.regexp_extract(key, r"^lane(\d+)-", 1).cast("bigint"), F.regexp_extract(key, r"-(\d+)$", 1).cast("bigint")
    return tar.read_tokens(spark, folder, store).select(lane.alias("lane"), block.alias("block_id"), "tokens")
