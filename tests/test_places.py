"""Launches looked up in traces of several files, where an index alone names none."""

from __future__ import annotations

import json

import pytest
from test_traces import BENCH, RUN, compilation, launch

from tracequarry.operators import kernels
from tracequarry.sources import trace


@pytest.fixture(scope="module")
def events(spark):
    files = {"/b": [compilation("h1", "add", 1), launch("h1", "add", 1, 0), launch("h2", "mul", 1, 1)], "/a": [launch("h1", "add", 1, 2), launch("h2", "mul", 1, 3, (BENCH, RUN)), launch("h1", "add", 1, 4, (RUN,)), compilation("h2", "mul", 1)]}
    rows = [(p, i, n, json.dumps(e)) for i, p in enumerate(sorted(files)) for n, e in enumerate(files[p])]
    return trace.events(spark.createDataFrame(rows, "path string, file_ord int, line_no long, raw string").repartition(3))


def test_places_name_files(events):
    assert [kernels.launch_place(events, "add", k) for k in range(3)] == [("/a", 0), ("/a", 2), ("/b", 1)]
    assert kernels.nth_launch(events, "add", 2) == 1 and kernels.best_tuned_place(events, "add") == ("/a", 2) and kernels.best_tuned_place(events, "none") is None
    with pytest.raises(ValueError, match="no kernel"):
        kernels.launch_place(events, "none", 0)


def test_a_launch_of_the_named_file(events):
    of = lambda *a: [(json.loads(r["launch"])["timestamp"], json.loads(r["compilation"])["payload"]["metadata"]["name"]) for r in kernels.launch_with_compilation(events, *a).collect()]
    assert of(1, "/b") == [("t0", "add")] and of(1, "/a") == [("t3", "mul")] and of(1) == [("t3", "mul")] and of(9) == []


def test_similar_names(events):
    assert kernels.similar_names(kernels.launches(events), "ad") == ["add"] and kernels.similar_names(kernels.launches(events), "zz") == []
