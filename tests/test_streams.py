"""The training stream: lanes, shuffle buffers, and blocks written exactly once over restarts."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tokenloom.sources import tar
from tokenloom.streaming import pack, shuffle


def shards(spark, folder, n, each, length=3):
    df = spark.range(n).select(F.format_string("k%05d", "id").alias("key"), F.array_repeat(F.col("id").cast("smallint"), length).alias("tokens"))
    tar.write_tokens(df.coalesce(1), folder, maxrecords=each)


def finish(q):
    q.processAllAvailable()
    q.stop()
    q.awaitTermination()


def test_reservoir():
    """Each record once, at most the buffer's size early, with no more held than that; the same again from the same start."""
    for size, n in ((1, 50), (7, 400), (1000, 2500)):
        runs = []
        for parts in (1, 3):
            held, come, gone, out = [], 0, 0, []
            for p in range(parts):  # as from state, batch by batch
                r = shuffle.Reservoir(5, 2, size, held, come, gone)
                for x in range(n * p // parts, n * (p + 1) // parts):
                    out += r.push(x)
                    assert len(r.held) <= size
                held, come, gone = r.held, r.come, r.gone
            out += shuffle.Reservoir(5, 2, size, held, come, gone).empty()
            runs.append(out)
        assert runs[0] == runs[1] and [k for k, _ in out] == list(range(n)) and sorted(x for _, x in out) == list(range(n))
        assert all(k >= x - size for k, x in out)
        if size > 5:
            moved = sum(abs(k - x) for k, x in out) / n
            assert moved > size / 4 and [x for _, x in out] != sorted(x for _, x in out)
    other = shuffle.Reservoir(6, 2, 7, [], 0, 0)
    assert [x for i in range(400) for _, x in other.push(i)] != [x for _, x in runs[0]][:393]


def test_packer_against_plain():
    rng = random.Random(3)
    for _ in range(200):
        size, packer, flat, got = rng.randrange(1, 9), None, [], []
        done, rest = 0, []
        for _ in range(rng.randrange(12)):
            packer = pack.Packer(7, 8, size, done, rest)
            for _ in range(rng.randrange(4)):
                seq = [rng.randrange(5) for _ in range(rng.choice([0, 1, 3, 40]))]
                flat += [7, *seq, 8]
                got += packer.push(seq)
            done, rest = packer.done, packer.rest
            assert len(rest) < size
        assert got == [(k, flat[k * size : (k + 1) * size]) for k in range(len(flat) // size)]


def test_long_sequences_pack_linearly():
    import time

    began = time.process_time()
    assert sum(1 for _ in pack.Packer(1, 2, 16, 0, []).push(range(2_000_000))) == 2_000_002 // 16
    assert time.process_time() - began < 5


def test_draws():
    names = [f"s{k:02d}" for k in range(11)]
    for lanes in (1, 3, 11):
        d = tar.Draws(names, lanes, 9, True, 0)
        for epoch in range(4):
            own = [d.own(i, epoch) for i in range(lanes)]
            assert sorted(sum(own, [])) == names and [len(o) for o in own] == [d.each(i) for i in range(lanes)]
            for i in range(lanes):  # each of the lane's shards once an epoch
                assert sorted(d.draw(i, epoch * d.each(i) + k) for k in range(d.each(i))) == sorted(own[i])
        if lanes == 3:
            assert len({tuple(d.own(0, e)) for e in range(6)}) > 1
    again = tar.Draws(names, 2, 9, False, 0)
    drawn = [again.draw(0, n) for n in range(600)]
    assert drawn == [tar.Draws(names, 2, 9, False, 0).draw(0, n) for n in range(600)] and set(drawn) == set(names)
    for e in range(100):
        assert set(drawn[e * 6 : e * 6 + 6]) <= set(again.own(0, e)) and not set(again.own(0, e)) & set(again.own(1, e))
    assert max(Counter(drawn[:6 * 20]).values()) > 1  # with replacement
    with pytest.raises(ValueError, match="lanes"):
        tar.Draws(names, 12, 9, False, 0)


def test_blocks_once_over_restarts(spark, tmp_path):
    """A query is killed again and again, also behind the sink's commit but before its own, and each block is there once."""
    n, size, lanes = 120, 16, 3
    shards(spark, f"{tmp_path}/in", n, 8)

    def start():
        blocks = pack.training_blocks(spark, f"{tmp_path}/in", 200, 201, size, lanes=lanes, seed=4, buffer=11, replacement="false", epochs=2, shardspertrigger=1)
        return pack.write_blocks(blocks, f"{tmp_path}/out", f"{tmp_path}/c", maxrecords=5)

    def commits():
        folder = f"{tmp_path}/c/commits"
        return sorted(int(f) for f in os.listdir(folder) if f.isdigit()) if os.path.exists(folder) else []

    rng, turns, ended = random.Random(1), 0, False
    while not ended and turns < 12:
        q, wanted = start(), len(commits()) + rng.randrange(1, 4)
        for _ in range(600):
            ended = bool(q.lastProgress) and q.lastProgress["numInputRows"] == 0
            if ended or not q.isActive or len(commits()) >= wanted:
                break
            q.awaitTermination(0.05)
        q.stop()
        q.awaitTermination()
        turns += 1
        if commits() and turns % 2:  # as if the query had died between the sink's commit and its own
            for f in (f"{commits()[-1]}", f".{commits()[-1]}.crc"):
                if os.path.exists(f"{tmp_path}/c/commits/{f}"):
                    os.remove(f"{tmp_path}/c/commits/{f}")
    finish(start())
    got = pack.read_blocks(spark, f"{tmp_path}/out").collect()
    by = {(r.lane, r.block_id): list(r.tokens) for r in got}
    assert len(by) == len(got) and turns > 2
    whole = {}
    pack.write_blocks(pack.training_blocks(spark, f"{tmp_path}/in", 200, 201, size, lanes=lanes, seed=4, buffer=11, replacement="false", epochs=2, shardspertrigger=50), f"{tmp_path}/once", f"{tmp_path}/c2")
    for q in spark.streams.active:
        finish(q)
    for r in pack.read_blocks(spark, f"{tmp_path}/once").collect():
        whole[r.lane, r.block_id] = list(r.tokens)
    assert by == whole  # and the same blocks as without a restart, in other batches
    ids = Counter(t for block in by.values() for t in block if t < 200)
    assert max(ids.values()) <= 6 and sum(ids.values()) > 2 * 3 * n - lanes * size
    for lane in range(lanes):
        own = [by[lane, k] for k in range(sum(1 for x in by if x[0] == lane))]  # numbered without gaps
        flat = [t for b in own for t in b]
        assert flat[0] == 200 and all(flat[i] == 200 and flat[i + 4] == 201 and len({*flat[i + 1 : i + 4]}) == 1 for i in range(0, len(flat) - 5, 5))
    assert not [f for f in os.listdir(f"{tmp_path}/out") if f.endswith(".part")]


def test_changed_streams_are_refused(spark, tmp_path):
    shards(spark, f"{tmp_path}/in", 40, 5)

    checkpoint = f"{tmp_path}/c3"

    def kept(**options):
        options = {"lanes": 2, "seed": 1, "replacement": "false", "epochs": 3, "shardspertrigger": 1} | options
        rows = tar.stream_tokens(spark, f"{tmp_path}/in", **options)
        q = rows.select("key", "tokens").where("key IS NOT NULL").writeStream.format("tokentar").option("path", f"{tmp_path}/o").option("streamname", "a").option("checkpointLocation", checkpoint).start()
        finish(q)

    kept()
    for change, match in (({"lanes": 3}, "lanes"), ({"seed": 2}, "changed"), ({"replacement": "true"}, "changed")):
        with pytest.raises(Exception, match=match):
            kept(**change)
    shards(spark, f"{tmp_path}/in", 60, 5)
    with pytest.raises(Exception, match="changed"):
        kept()
    with pytest.raises(Exception, match="streamname"):
        finish(tar.stream_tokens(spark, f"{tmp_path}/in", epochs=1).select("key", "tokens").writeStream.format("tokentar").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c4").start())


def test_lanes_are_partitions(spark, tmp_path):
    """A lane is one input partition, its records come in order, no shuffle follows, and broken shards are counted."""
    shards(spark, f"{tmp_path}/in", 60, 5)
    with open(f"{tmp_path}/in/zz.tar", "wb") as f:
        f.write(b"no tar at all" * 90)
    seen = []

    def keep(df, _):
        seen.extend(tuple(r) for r in df.select("lane", F.spark_partition_id(), "draw", "place", "shard", "error", "ends").collect())

    rows = tar.stream_tokens(spark, f"{tmp_path}/in", lanes=4, replacement="false", epochs=2, badshards="rows", shards=2)
    q = rows.observe("o", F.count("error").alias("broken")).writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    broken = sum(p["observedMetrics"]["o"]["broken"] for p in q.recentProgress if "o" in p["observedMetrics"])
    q.stop()
    assert broken == 2 == sum(r[5] is not None for r in seen) and sum(r[6] for r in seen) == 4
    for lane in range(4):
        own = [r for r in seen if r[0] == lane and r[5] is None and not r[6]]
        assert len({r[1] for r in own}) == 1 and [(r[2], r[3]) for r in own] == sorted((r[2], r[3]) for r in own)
    for epoch in range(2):
        lanes = {}
        for r in seen:
            if not r[6] and r[2] // len([1 for k in range(r[0], 13, 4)]) == epoch:
                lanes.setdefault(r[0], set()).add(r[4])
        assert sum(map(len, lanes.values())) == len(set().union(*lanes.values())) == 13  # disjoint, and all of them


def test_buffer_of_a_stream(spark, tmp_path):
    """Records leave the buffer once each, at most its size early; an endless lane keeps what its buffer holds."""
    shards(spark, f"{tmp_path}/in", 300, 20, length=1)
    plain = tar.stream_tokens(spark, f"{tmp_path}/in", replacement="false", epochs=1, badshards="rows", shards=3)
    q = shuffle.shuffle_buffer(plain, 50, 8).writeStream.format("memory").queryName("left").option("checkpointLocation", f"{tmp_path}/c").start()
    finish(q)
    out = [r.tokens[0] for r in spark.table("left").where("NOT ends").orderBy("number").collect()]
    draws = tar.Draws(sorted(f for f in os.listdir(f"{tmp_path}/in") if f.endswith(".tar")), 1, 101, True, 1)
    come = [t[0] for k in range(15) for _, t, _, _ in tar.records(f"{tmp_path}/in/{draws.draw(0, k)}")]
    assert sorted(out) == sorted(come) == list(range(300)) and out != come
    at = {x: i for i, x in enumerate(come)}
    assert all(k >= at[x] - 50 for k, x in enumerate(out))
    assert spark.table("left").where("ends").count() == 1


def test_state_has_no_more_partitions_than_lanes(spark, tmp_path):
    """A micro-batch pays a task and a state store for each partition, so lanes bound them; the session's own number stays."""
    shards(spark, f"{tmp_path}/in", 60, 10, length=6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    blocks = pack.training_blocks(spark, f"{tmp_path}/in", 200, 201, 8, lanes=2, seed=4, buffer=5, replacement="false", epochs=1, shardspertrigger=5)
    q = pack.write_blocks(blocks, f"{tmp_path}/out", f"{tmp_path}/c", 2)
    q.processAllAvailable()
    told = [o["numShufflePartitions"] for p in q.recentProgress for o in p["stateOperators"]]
    q.stop()
    assert int(before) > 2 and set(told) == {2} and spark.conf.get("spark.sql.shuffle.partitions") == before
    assert sorted(r.tokens[1] for r in pack.read_blocks(spark, f"{tmp_path}/out").collect()) == list(range(60))
