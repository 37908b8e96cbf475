"""Where lineage is cut."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from bookloom.operators.staging import stage


def frame(master: str, setting: str | None, current: str | None = None):
    chosen: list[str] = []
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: current, setCheckpointDir=chosen.append
    )
    conf = SimpleNamespace(get=lambda key, default: setting)
    session = SimpleNamespace(sparkContext=context, conf=conf)
    return SimpleNamespace(sparkSession=session, checkpoint=lambda eager: "cut"), chosen


def test_the_named_folder_is_used():
    stub, chosen = frame("spark://cluster", "/shared/checkpoints")
    assert stage(stub) == "cut" and chosen == ["/shared/checkpoints"]


def test_a_folder_already_set_stays():
    stub, chosen = frame("spark://cluster", None, current="/shared/other")
    assert stage(stub) == "cut" and chosen == []


def test_no_local_folder_on_a_cluster():
    stub, chosen = frame("spark://cluster", None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stage(stub)
    assert chosen == []


def test_a_local_session_gets_its_own():
    stub, chosen = frame("local[2]", None)
    assert stage(stub) == "cut" and len(chosen) == 1
