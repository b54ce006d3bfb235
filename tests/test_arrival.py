"""Streams whose micro-batches must not depend on when or by which task a file was written."""

import os

from lotlens.plans import queries_maintenance as M
from lotlens.plans import registry

from .compare import assert_same, connect


def test_the_flush_does_not_depend_on_the_times_of_files(spark, sf_dir, monkeypatch):
    """Whatever is in the folder when a stream starts looks as if its last part had been written first."""
    read = M.G.read_stream

    def turned(spark, path, *args, **kwargs):
        folder = path.removeprefix("file://")
        names = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
        newest = max(os.path.getmtime(f"{folder}/{n}") for n in names)
        for k, n in enumerate(names):
            os.utime(f"{folder}/{n}", (newest - k, newest - k))
        return read(spark, path, *args, **kwargs)

    monkeypatch.setattr(M.G, "read_stream", turned)
    assert_same(registry.QUERIES["flush_stream"](spark, sf_dir), connect(sf_dir), registry.ORACLE["flush_stream"])


def test_the_flush_reads_files_that_look_old(spark, sf_dir, monkeypatch):
    """The clock is set back by a month between the parts."""
    read, seen = M.G.read_stream, []

    def turned(spark, path, *args, **kwargs):
        folder = path.removeprefix("file://")
        names = {n for n in os.listdir(folder) if n.startswith("part-")}
        for n in names.difference(*seen):
            at = os.path.getmtime(f"{folder}/{n}") - 30 * 86400 * len(seen)
            os.utime(f"{folder}/{n}", (at, at))
        seen.append(names)
        return read(spark, path, *args, **kwargs)

    monkeypatch.setattr(M.G, "read_stream", turned)
    assert_same(registry.QUERIES["flush_stream"](spark, sf_dir), connect(sf_dir), registry.ORACLE["flush_stream"])
    assert len(seen) == 4


def test_each_batch_arrives_whole_and_in_order(spark, tmp_path):
    rows, seen = spark.range(1000).repartition(7), []

    class Started:
        def awaitTermination(self):
            seen.append((spark.read.json(f"{tmp_path}/in").count(), len([n for n in os.listdir(tmp_path / "in") if n.startswith("part-")])))

    M.arrive(M.dealt(rows, 3, "id"), f"{tmp_path}/in", Started)
    assert [n for n, _ in seen] == sorted(n for n, _ in seen) and seen[-1] == (1000, 21)
