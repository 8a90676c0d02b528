import pytest

from pointlake.workspace import Workspace


class _Session:
    """Just the settings a workspace reads."""

    def __init__(self, master, **settings):
        self.conf = self
        self.settings = settings
        self.sparkContext = self
        self.master = master

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_the_configured_folder_is_used():
    work = Workspace(_Session("yarn", **{"spark.checkpoint.dir": "hdfs://shared/cp/"}))
    assert work.path.startswith("hdfs://shared/cp/work-")


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        Workspace(_Session("yarn"))


def test_tables_are_stored_and_deleted(spark):
    work = Workspace(spark)
    table = work.save(spark.range(10), "numbers")
    assert table.count() == 10 and len(table.inputFiles()) > 0
    assert table.inputFiles()[0].split("file://")[1].startswith(work.path)
    work.delete()
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        spark.read.parquet(f"{work.path}/000-numbers")
