import os
from types import SimpleNamespace

import pytest

from accountscope import session


def cluster(master, already=None, **conf):
    """As much of a session as decides where scratch tables lie."""
    option = SimpleNamespace(isDefined=lambda: already is not None, get=lambda: already)
    context = SimpleNamespace(master=master, applicationId="app", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: option)))
    hadoop = SimpleNamespace(hadoopConfiguration=lambda: {"fs.defaultFS": "file:///"})
    return SimpleNamespace(sparkContext=context, _jsc=hadoop, conf=SimpleNamespace(get=lambda k, *d: conf.get(k, *d)))


@pytest.mark.parametrize("named", ["file:///mnt/shared/", "/mnt/shared", "hdfs://name/shared"])
@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,4,10240]", "local[2]"])
def test_a_named_folder_is_taken_as_it_is(master, named):
    assert session.scratch_root(cluster(master, **{"spark.checkpoint.dir": named})) == named.rstrip("/")
    assert session.scratch_root(cluster(master, already=named)) == named.rstrip("/")


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,4,10240]"])
def test_without_a_named_folder_a_cluster_uses_the_warehouse(master):
    at = session.scratch_path(cluster(master, **{"spark.sql.warehouse.dir": "file:/mnt/warehouse"}), "table")
    assert at.startswith("file:/mnt/warehouse/_scratch/accountscope/app/table-")


@pytest.mark.parametrize("master", ["local", "local[*]", "local[4,2]"])
def test_a_local_master_uses_a_temporary_folder(master):
    assert os.path.isdir(session.scratch_root(cluster(master)))
