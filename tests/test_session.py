import os
import time

import pytest

from lodeweave import session


def test_stages_are_deleted(spark):
    folder = session.work_dir(spark).removeprefix("file://")
    kept = session.materialize(spark.range(3), "kept")
    before = set(os.listdir(folder))
    with session.stages(spark):
        assert session.materialize(spark.range(5), "gone").count() == 5
        assert set(os.listdir(folder)) - before
    assert set(os.listdir(folder)) == before and kept.count() == 3


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="share"):
        session.work_dir(Session)


def test_shuffle_files_of_a_stage_go_with_its_write_and_stages_can_be_discarded(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before = files()
    df = session.materialize(spark.range(1000).repartition(5), "gone")
    until = time.time() + 20
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before and df.count() == 1000
    path = df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert os.path.exists("/" + path.lstrip("/"))
    session.discard(df)
    assert not os.path.exists("/" + path.lstrip("/")) and not any("/gone-" in p for p in session._written)
