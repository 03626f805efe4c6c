"""A shuffle buffer as a stateful stream: each lane keeps a reservoir of records and emits a random one for each that comes.

Once the reservoir is full, a record takes the place of one that a hash of the seed, the lane and its number chooses, and that
one is emitted: so a record is emitted at most ``buffer`` places early, once, and what is emitted follows from what came alone, also
when a batch is run again. The row that ends a lane empties its reservoir, in the order of a hash, and is passed on behind it.

Records need the columns lane, draw, place and tokens of a stream of shards. They must come in the order of (draw, place) within a
lane, as the lane's one task reads them; a lane out of order, which only a sort that spilled could cause, fails its task.
Records without tokens (broken shards) are left out. An endless lane keeps up to ``buffer`` records for ever.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: records of the reservoir.
BUFFER = 1000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "lane int, number bigint, tokens array<smallint>, ends boolean"


def keep_state(df: DataFrame) -> DataFrame:
    """Stateful processors need the state store that holds lists and values side by side."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return df


def chance(*of) -> int:
    return int.from_bytes(hashlib.blake2b(":".join(map(str, of)).encode(), digest_size=8).digest(), "big")


class Reservoir:
    """The buffer of one lane: records, and how many have come and gone."""

    def __init__(self, seed: int, lane: int, size: int, held: list, come: int, gone: int):
        self.seed, self.lane, self.size, self.held, self.come, self.gone = seed, lane, size, held, come, gone

    def push(self, record) -> Iterator[tuple[int, object]]:
        """(number, record) of what is emitted for a record that comes."""
        if len(self.held) < self.size:
            self.held.append(record)
        else:
            k = chance(self.seed, self.lane, self.come) % (self.size + 1)
            out = record
            if k < self.size:
                out, self.held[k] = self.held[k], record
            yield self._number(), out
        self.come += 1

    def empty(self) -> Iterator[tuple[int, object]]:
        order = sorted(range(len(self.held)), key=lambda k: chance(self.seed, self.lane, "end", k))
        for k in order:
            yield self._number(), self.held[k]
        self.held = []

    def _number(self) -> int:
        self.gone += 1
        return self.gone - 1


class _Shuffle(StatefulProcessor):
    def __init__(self, size: int, seed: int):
        self.size, self.seed = size, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "tokens array<smallint>")
        self.count = handle.getValueState("count", "come bigint, gone bigint, draw bigint, place int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        come, gone, *last = self.count.get() if self.count.exists() else (0, 0, -1, -1)
        lane, last = int(key[0]), tuple(last)
        held = [list(h[0]) for h in self.held.get()] if self.held.exists() else []
        buffer = Reservoir(self.seed, lane, self.size, held, come, gone)
        for f in rows:
            out = []
            for draw, place, tokens, ends in zip(f["draw"], f["place"], f["tokens"], f["ends"], strict=True):
                if ends:
                    out += [(lane, n, t, False) for n, t in buffer.empty()] + [(lane, buffer.gone, None, True)]
                elif tokens is not None:
                    if (int(draw), int(place)) <= last:
                        raise RuntimeError(f"lane {lane} came out of order: let a micro-batch hold fewer shards")
                    last = int(draw), int(place)
                    out += [(lane, n, t, False) for n, t in buffer.push([int(x) for x in tokens])]
            yield pd.DataFrame(out, columns=["lane", "number", "tokens", "ends"])
        if buffer.held:
            self.held.put([(t,) for t in buffer.held])
        else:
            self.held.clear()
        self.count.update((buffer.come, buffer.gone, *last))

    def close(self) -> None:
        pass


def shuffle_buffer(df: DataFrame, size: int = BUFFER, seed: int = 101) -> DataFrame:
    """(lane, number, tokens, ends): the records of a streaming DataFrame by lane in the order they leave their reservoir."""
    rows = keep_state(df).select("lane", "draw", "place", "tokens", "ends")
    return rows.groupBy("lane").transformWithStateInPandas(_Shuffle(size, seed), OUT, "append", "none")
