"""The shared folder: read from the session, refused where a cluster has none."""

import pytest

from pixelmill import session


class _Conf:
    def get(self, key, default=None):
        return default


class _Context:
    def __init__(self, master):
        self.master, self.applicationId, self.dir = master, f"app-{master}", None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


class _Session:
    def __init__(self, master):
        self.conf, self.sparkContext = _Conf(), _Context(master)


def test_shared_dir_reads_setting(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_shared_dir_unset_local_reuses_one_folder():
    s = _Session("local[2]")
    assert session.shared_dir(s) == session.shared_dir(s)
    assert s.sparkContext.dir == session.shared_dir(s)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_shared_dir_unset_on_cluster_is_an_error(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(_Session(master))
