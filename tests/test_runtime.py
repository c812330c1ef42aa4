"""Where checkpoints and scratch tables go."""

import os

import pytest

from slotvalue import runtime


class Context:
    def __init__(self, master):
        self.master, self.dir = master, None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


class Session:
    def __init__(self, master, setting=None):
        self.sparkContext = Context(master)
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}


def test_setting_comes_first():
    assert runtime.shared_dir(Session("yarn", "hdfs:///shared")) == "hdfs:///shared"


def test_local_session_gets_one_folder():
    session = Session("local[2]")
    assert runtime.shared_dir(session) == runtime.shared_dir(session)
    assert runtime.scratch_path(session, "a") != runtime.scratch_path(session, "a")


def test_cluster_without_setting_is_an_error():
    with pytest.raises(ValueError):
        runtime.shared_dir(Session("spark://host:7077"))


def test_checkpoint_keeps_rows(spark):
    assert sorted(r.id for r in runtime.checkpoint(spark.range(5)).collect()) == list(range(5))


def test_scratch_folders_can_be_dropped(spark):
    path = runtime.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    runtime.drop_scratch(spark)
    assert not os.path.exists(path.removeprefix("file://")) and runtime.drop_scratch(spark) == 0
