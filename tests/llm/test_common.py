"""Scratch folders and shared plumbing."""

from pathlib import Path
from types import SimpleNamespace

import pytest

from sparkpact.llm._common import Scratch, Seen, free_name, scratch_scope, shared_dir


def session(master, folder=None):
    context = SimpleNamespace(master=master, applicationId="app", getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder), sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    assert shared_dir(session("spark://host:7077", "hdfs://store/shared/")) == "hdfs://store/shared"
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
    for master in ("local", "local[4]", "local[*]", "local[4,2]"):
        assert shared_dir(session(master)).startswith("file:///")


def test_scratch_folders_go_with_their_scope(spark):
    outer = Scratch(spark, "outer")
    with scratch_scope():
        inner = Scratch(spark, "inner")
        kept = outer.write(inner.write(spark.range(5), "a").where("id > 1"), "b")
        folders = [Path(x.base.removeprefix("file://")) for x in (outer, inner)]
        assert all(f.exists() for f in folders)
    assert kept.count() == 3 and folders[0].exists() and not folders[1].exists()


def test_names_and_repeats():
    assert free_name(["a", "HEAD", "head_"], "head") == "head__" and free_name([], "head") == "head"
    seen = Seen(2)
    assert [seen.new(k) for k in (1, 1, 2, 1, 3, 1)] == [True, False, True, False, True, True]  # bounded: it forgets
