"""The scratch folder: shared on a cluster, own only on one machine."""

from types import SimpleNamespace

import pytest

from lodestone.session import shared_root


def session(master, **settings):
    conf = SimpleNamespace(get=lambda key, default=None: settings.get(key, default), set=settings.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_shared_root():
    assert shared_root(session("spark://x", **{"spark.checkpoint.dir": "hdfs://y/z/"})) == "hdfs://y/z"
    for master in ("spark://x", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            shared_root(session(master))
    own = session("local[4]")
    assert shared_root(own).startswith("file:///") and shared_root(own) == shared_root(own)
