"""Broken shards: files are found and tested in tasks, however many there are."""

import io
import os
import tarfile

import pytest

from tokenloom.plans import roundtrips
from tokenloom.sources import tar


def _shards(root, *names, broken=()):
    """Whole and broken files of the names, which are made with their folders."""
    for name in (*names, *broken):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f, tarfile.open(fileobj=f, mode="w") as t:
            info = tarfile.TarInfo("a.json")
            info.size = 600
            t.addfile(info, io.BytesIO(b" " * 600))
        if name in broken:
            os.truncate(f"{root}/{name}", 700)


def test_no_list_of_files_on_the_driver(spark, tmp_path):
    """The plan knows no files, and its tasks follow the shuffle, not one for each 32 files."""
    _shards(tmp_path, *(f"t/{k}.tar" for k in range(300)), broken=["t/x.tar", "t/y.tar"])
    found = tar.broken_shards(spark, f"{tmp_path}/t/*.tar")
    assert not found.inputFiles()
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r.path for r in found.collect()) == [f"file:{tmp_path}/t/x.tar", f"file:{tmp_path}/t/y.tar"]


def test_paths_with_wildcards(spark, tmp_path):
    """What a path finds is what Spark's reader of whole files finds."""
    _shards(tmp_path, broken=["a/1.tar", "a/2.tar", "a/_h.tar", "a/.h.tar", "a/_k=1.tar", "a/x.tar.gz", "b/3.tar", "b/1.tar", "b/c/4.tar", "b/c/d/5.tar", "s.tar/6", "s.tar/_7", "x [1]/8.tar", "x [1]/9.tar"])
    for glob in ("a/*.tar", "a/1.tar", "a", "a/", "*/*.tar", "{a,b}/[!2-9].tar", "{a/2,b/3}.tar", "?/{1,3}.tar", "*", "*.tar", "b/*", "x \\[1\\]/8.*", "x*/[89].tar"):
        want = spark.read.format("binaryFile").load(f"{tmp_path}/{glob}").select("path").collect()
        assert sorted(r.path for r in tar.broken_shards(spark, f"{tmp_path}/{glob}").collect()) == sorted(r.path for r in want), glob
    for glob in ("none/*.tar", "a/none.tar", "a/*.none"):
        with pytest.raises(FileNotFoundError, match="no files"):
            tar.broken_shards(spark, f"{tmp_path}/{glob}")


def test_files_of_the_query(spark, monkeypatch):
    """Files lie in many folders, and each is a whole tar of no more blocks than it needs."""
    seen = []
    monkeypatch.setattr(roundtrips, "_files_of", lambda *a: seen.append(a) or 0)
    monkeypatch.setattr(roundtrips.tar, "broken_shards", lambda s, p: s.createDataFrame([], "path string"))
    roundtrips.checked_shards(spark, "/root/testdata/sf0.01")
    df, _, content = seen[0]
    assert len({r.path.rpartition("/")[0] for r in df.select("path").collect()}) > 200
    body = content("x" * 600, False)
    assert len(body) == 512 + 1024 + 1024 and content("x", True) == content("x", False)[:515]
    with tarfile.open(fileobj=io.BytesIO(body), mode="r|*") as t:
        assert [(m.name, t.extractfile(m).read()) for m in t] == [("a.json", b"x" * 600 + b" and more")]
