"""Artifacts that tools derive from stages."""

from __future__ import annotations

import subprocess

from tracequarry.plans.artifacts import Artifacts, derived, failures


def tools():
    """Made here, so that workers get them by value."""

    def upper(data):
        return data.decode().upper()

    def missing(data):
        raise RuntimeError("Cannot find the tool")

    def exits(data):
        raise subprocess.CalledProcessError(3, ["tool"])

    def unreadable(data):
        raise OSError("no file")

    def some(data):
        return None if data == b"skip" else b"\xff" + data

    return upper, missing, exits, unreadable, some


upper, missing, exits, unreadable, some = tools()


def files(spark):
    rows = [("h1", "k.cubin", "cuda", "cubin", b"elf"), ("h1", "k.ttir", "cuda", "ttir", b"module"), ("h2", "z.cubin", "cuda", "cubin", b"late"), ("h2", "a.cubin", "cuda", "cubin", b"skip"),
            ("h3", "n.cubin", "cuda", "cubin", None), ("h4", "k.ttir", "hip", "ttir", b"other")]
    return spark.createDataFrame(rows, "hash string, file string, backend string, stage string, content binary")


def test_choice_and_rounds():
    r = Artifacts()
    r.register("cuda", "json", "sass", "second", upper)
    r.register("cuda", "sass", "cubin", "first", upper)
    r.register("cuda", "nothing", "cubin", "none", upper)
    r.register("cuda", "sass", "cubin", "again", upper)
    r.register("hip", "amdgcn", "llir", "other", upper)
    assert [a.tool for a in r.replaced] == ["first"]
    assert r.applicable("cuda") == ([], [])
    assert [a.target for a in r.applicable("cuda", "SASS,odd")[0]] == ["sass"] and r.applicable("cuda", "SASS,odd")[1] == ["odd"]
    rounds, skipped = r.rounds("cuda", "all")
    assert [[a.target for a in x] for x in rounds] == [["sass"], ["json"]] and [a.target for a in skipped] == ["nothing"]
    r.register("cuda", "sass", "json", "circle", upper)
    assert r.rounds("cuda", "all")[0] == [] and len(r.rounds("cuda", "all")[1]) == 3


def test_chain_and_names(spark):
    r = Artifacts()
    r.register("cuda", "json", "sass", "second", upper)
    r.register("cuda", "sass", "cubin", "first", some)
    got = sorted((x["hash"], x["file"], x["stage"], bytes(x["content"]), x["error"]) for x in derived(files(spark).where("hash <> 'h1'"), r, "all").collect())
    assert got == []  # the least name of h2 is skipped by its tool, h3 has no content
    r.register("cuda", "sass", "cubin", "first", lambda data: data[::-1])
    got = sorted((x["hash"], x["file"], x["stage"], bytes(x["content"]), x["error"]) for x in derived(files(spark), r, "all").collect())
    assert got == [("h1", "k.json", "json", b"FLE", None), ("h1", "k.sass", "sass", b"fle", None), ("h2", "a.json", "json", b"PIKS", None), ("h2", "a.sass", "sass", b"piks", None)]
    assert derived(files(spark), r, "none").count() == derived(files(spark).limit(0), r, "all").count() == 0


def test_one_failing_artifact_degrades_alone(spark):
    for fails, kind, text in ((missing, "RuntimeError", "<error dumping derived artifact with tool: Cannot find the tool>"), (exits, "CalledProcessError", "<tool failed: Command '['tool']' returned non-zero exit status 3.>"), (unreadable, "OSError", "<error dumping derived artifact: no file>")):
        r = Artifacts()
        r.register("cuda", "sass", "cubin", "tool", fails)
        r.register("cuda", "ptx", "ttir", "fine", upper)
        r.register("cuda", "json", "sass", "after", upper)
        rows = derived(files(spark), r, "all")
        got = sorted((x["hash"], x["file"], bytes(x["content"]).decode(), x["error"]) for x in rows.collect())
        assert got == sorted([("h1", "k.ptx", "MODULE", None), ("h1", "k.sass", text, kind), ("h2", "a.sass", text, kind)])
        assert [tuple(x) for x in failures(rows).collect()] == [("cuda", "sass", kind, 2, text)]
