"""Where intermediate tables go, and that they go away."""

from types import SimpleNamespace

import pytest

from tallyloom.llm.scratch import Scratch, shared_dir


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: default)
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: folder))
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_a_cluster_must_name_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://host"):
        assert shared_dir(session(master, "/shared")) == "/shared"
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
    assert shared_dir(session("local[4]")) == shared_dir(session("local"))


def test_dropped_tables_are_gone(spark):
    scratch = Scratch(spark, "t")
    kept, gone = (scratch.save(spark.range(5), name) for name in ("kept", "gone"))
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    scratch.drop(gone, spark.range(3))
    assert kept.count() == 5 and before == "false"
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(gone._scratch_path).count()
