"""What the operators share: folders on a cluster, and the memory of workers."""

from types import SimpleNamespace

import pytest

from colonnade.llm import shared


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda name, default=None: folder)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(session("spark://host:7077"))
    assert shared.shared_dir(session("spark://host:7077", "hdfs://n/x/")) == "hdfs://n/x"
    assert shared.shared_dir(session("local[4]"))


def test_a_worker_forgets_other_operators():
    gone = []
    shared.remembers("one", lambda: gone.append("one"))
    shared.remembers("two", lambda: gone.append("two"))
    shared.working_on("one")
    assert "two" in gone and "one" not in gone
    del gone[:]
    shared.working_on("one")
    assert gone == []
    shared.working_on("two")
    assert "one" in gone and "two" not in gone
    del shared._forget["one"], shared._forget["two"]


def test_dropped_deletes_the_written_table_and_nothing_else(spark, tmp_path):
    import os

    from colonnade.llm.shared import dropped, shared_dir, written

    kept, gone, other = written(spark.range(3), "kept"), written(spark.range(3), "gone"), str(tmp_path / "other")
    spark.range(3).write.parquet(other)
    folder = os.path.dirname(gone.inputFiles()[0].removeprefix("file:").replace("///", "/"))
    assert os.path.isdir(folder) and folder.startswith(shared_dir(spark).removeprefix("file:"))
    dropped(gone)
    dropped(spark.read.parquet(other))
    assert not os.path.exists(folder) and kept.count() == 3 and spark.read.parquet(other).count() == 3


def test_written_leaves_no_shuffle_files_and_the_setting_as_it_was(spark):
    import os
    import time

    from colonnade.llm.shared import _CLEANUP, shuffles_dropped, written

    def files():
        folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
        return {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    before, was = files(), spark.conf.get(_CLEANUP, None)
    kept = written(spark.range(1000).groupBy("id").count(), "grouped")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and kept.count() == 1000
    assert spark.conf.get(_CLEANUP, None) == was
    with pytest.raises(ZeroDivisionError), shuffles_dropped(spark):
        assert spark.conf.get(_CLEANUP) == "true"
        raise ZeroDivisionError
    assert spark.conf.get(_CLEANUP, None) == was
