import pytest

from emberlog.session import REQUIRED_CONF, scratch_dir


class FakeContext:
    def __init__(self, master):
        self.master = master
        self.folder = None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    def __init__(self, master, **conf):
        self.sparkContext = FakeContext(master)
        self.settings = conf

        class Conf:
            @staticmethod
            def get(key, default=None):
                return conf.get(key, default)

        self.conf = Conf


def test_required_settings_are_in_force(spark):
    assert all(spark.conf.get(key) == value for key, value in REQUIRED_CONF.items())


def test_scratch_uses_the_shared_folder():
    session = FakeSession("yarn", **{"spark.checkpoint.dir": "hdfs://shared/tmp/"})
    first, second = scratch_dir(session, "store"), scratch_dir(session, "store")
    assert first.startswith("hdfs://shared/tmp/store-") and first != second


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        scratch_dir(FakeSession("yarn"), "store")


def test_local_runs_make_their_own():
    session = FakeSession("local[2]")
    assert scratch_dir(session, "store").startswith(session.sparkContext.folder)
