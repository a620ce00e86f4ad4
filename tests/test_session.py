"""The shared folder: required off local masters, emptied on request."""

import os
from types import SimpleNamespace

import pytest

from tremor import session


def _fake(master, conf=None, on_context=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: (conf or {}).get(k, d)),
                           sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: on_context))


def test_no_folder_is_an_error_on_a_cluster(monkeypatch):
    monkeypatch.delenv("TREMOR_SHARED_DIR", raising=False)
    for master in ("yarn", "spark://h:7077", "k8s://h", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(_fake(master))
    assert session.shared_dir(_fake("yarn", {"spark.checkpoint.dir": "hdfs:///x"})) == "hdfs:///x"
    assert session.shared_dir(_fake("yarn", on_context="hdfs:///y")) == "hdfs:///y"
    assert os.path.isdir(session.shared_dir(_fake("local[2]")))


def test_release_deletes_what_was_written(spark):
    session.release(spark)
    kept = session.materialize(spark.range(3).toDF("x"), "kept")
    path = kept.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path) and kept.count() == 3
    assert session.release(spark) == 1 and not os.path.exists(path)
    assert session.release(spark) == 0


def test_discard_deletes_the_tables_it_is_given(spark):
    a, b = (session.materialize(spark.range(3).toDF("x"), n) for n in ("one", "two"))
    session.discard(a, spark.range(1))
    session.discard(a)
    assert not os.path.exists(a._tremor_path.removeprefix("file:")) and b.count() == 3
    session.discard(b)


def test_brief_shuffles_end_with_their_block(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    with session.brief_shuffles(spark):
        assert spark.conf.get(key) == "true"
        df = spark.range(1000).repartition("id")
        assert df.count() == df.count() == len(df.collect()) == 1000
    assert spark.conf.get(key, None) == before
