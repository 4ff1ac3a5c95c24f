"""Artifacts that tools derive from stages of a compilation, or from other artifacts.

Registrations say which stage comes from which. Those chosen run in rounds, each artifact once its
source is there, so that a chain of tools needs no order of registration. A tool that fails costs
its own artifact only: the row's ``error`` has the kind of failure and its content says what
happened, as it stands in a trace.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.config import BACKEND_STAGES, enabled
from tracequarry.operators.ordering import settled

#: What a trace says of an artifact that couldn't be made.
TOOL_FAILED = "<{tool} failed: {error}>"
DUMP_FAILED = "<error dumping derived artifact: {error}>"
DUMP_WITH_TOOL_FAILED = "<error dumping derived artifact with {tool}: {error}>"

#: Bytes of made contents that a task holds before it hands them on.
HELD = 8 << 20

RESULT = "hash string, file string, backend string, stage string, content binary, error string"


@dataclass(frozen=True)
class Artifact:
    """``derive`` takes the source's bytes and gives the artifact's text or bytes, None if the tool
    isn't there. It runs on executors."""

    backend: str
    target: str
    source: str
    tool: str
    derive: Callable[[bytes], str | bytes | None]


class Artifacts:
    """Registered artifacts, one for each backend and target; a later registration takes an earlier
    one's place and is told by ``replaced``."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], Artifact] = {}
        self.replaced: list[Artifact] = []

    def register(self, backend: str, target: str, source: str, tool: str, derive: Callable[[bytes], str | bytes | None]) -> None:
        if (backend, target) in self.known:
            self.replaced.append(self.known[backend, target])
        self.known[backend, target] = Artifact(backend, target, source, tool, derive)

    def applicable(self, backend: str, setting: str | None = None, default: str = "none") -> tuple[list[Artifact], list[str]]:
        """Artifacts of a backend that a comma list of targets names, whatever their case, in order
        of registration, and the names that the backend doesn't know."""
        own = [a for a in self.known.values() if a.backend == backend]
        wanted = enabled(setting, default)
        if wanted is None:
            return own, []
        return [a for a in own if a.target.lower() in wanted], sorted(wanted - {a.target.lower() for a in own})

    def rounds(self, backend: str, setting: str | None = None) -> tuple[list[list[Artifact]], list[Artifact]]:
        """Applicable artifacts in rounds: those whose source is a stage that compilers write come
        first, then those from what is there by then. What never gets a source, or whose source or
        target isn't a stage of the backend, comes second."""
        stages = {s[0] for s in BACKEND_STAGES.get(backend, ())}
        wanted, _ = self.applicable(backend, setting)
        skipped = [a for a in wanted if a.source not in stages or a.target not in stages]
        left = [a for a in wanted if a not in skipped]
        there, out = stages - {a.target for a in left}, []
        while ready := [a for a in left if a.source in there]:
            out.append(ready)
            left = [a for a in left if a not in ready]
            there |= {a.target for a in ready}
        return out, skipped + left


def failure(tool: str, error: Exception) -> str:
    if isinstance(error, subprocess.CalledProcessError):
        return TOOL_FAILED.format(tool=tool, error=error)
    if isinstance(error, (OSError, UnicodeDecodeError)):
        return DUMP_FAILED.format(error=error)
    return DUMP_WITH_TOOL_FAILED.format(tool=tool, error=error)


def _runner(chosen: list[Artifact]):
    schema = pa.schema([("hash", pa.string()), ("file", pa.string()), ("backend", pa.string()), ("stage", pa.string()), ("content", pa.binary()), ("error", pa.string())])
    by_source: dict[tuple[str, str], list[Artifact]] = {}
    for a in chosen:
        by_source.setdefault((a.backend, a.source), []).append(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in batch.to_pylist():
                for a in by_source[row["backend"], row["stage"]]:
                    error = None
                    try:
                        made = a.derive(row["content"])
                    except Exception as e:  # whatever an optional tool does, the rest of the trace stands
                        made, error = failure(a.tool, e), type(e).__name__
                    if made is None:
                        continue
                    content = made.encode(errors="replace") if isinstance(made, str) else made
                    out.append(row | {"stage": a.target, "content": content, "error": error})
                    size += len(content)
                    if size > HELD:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def stage_extension(backend: Column, stage: Column) -> Column:
    pairs = [F.lit(x) for b, stages in BACKEND_STAGES.items() for s in stages for x in (f"{b}/{s[0]}", s[1])]
    return F.create_map(*pairs)[F.concat_ws("/", backend, stage)]


def derived(files: DataFrame, registry: Artifacts, setting: str | None = None) -> DataFrame:
    """Artifacts of stage files (``hash``, ``file``, ``backend``, ``stage``, ``content`` in bytes):
    the same columns and ``error``, the failure's kind. ``file`` is the source's name with the
    target's extension. Several sources of a stage in one compilation: the least name counts. A tool
    that gives None makes no row; nothing is derived from a failed artifact or null content."""
    columns = ["hash", "file", "backend", "stage", "content"]
    out = files.sparkSession.createDataFrame([], RESULT)
    have = files.select(columns)
    plans = {b: registry.rounds(b, setting)[0] for b in {a.backend for a in registry.known.values()}}
    for n in range(max(map(len, plans.values()), default=0)):
        chosen = [a for rounds in plans.values() for ready in rounds[n : n + 1] for a in ready]
        keys = [f"{a.backend}/{a.source}" for a in chosen]
        sources = have.where(F.concat_ws("/", "backend", "stage").isin(keys) & F.col("content").isNotNull())
        # Contents may be large: the names are chosen first, and only chosen contents reach tools.
        names = sources.groupBy("hash", "backend", "stage").agg(F.min("file").alias("file"))
        sources = sources.join(names, ["hash", "file", "backend", "stage"], "left_semi").select(*columns, F.lit(None).cast("string").alias("error"))
        made = settled(sources.mapInArrow(_runner(chosen), RESULT))
        name = F.regexp_replace("file", r"\.[^.]*$", "")
        made = made.withColumn("file", F.concat(name, stage_extension(F.col("backend"), F.col("stage"))))
        out = out.unionByName(made)
        have = have.unionByName(made.where("error is null").select(columns))
    return out


def failures(rows: DataFrame) -> DataFrame:
    """Each kind of failure once (``backend``, ``stage``, ``error``) with its number and a message,
    that of the least hash: what to warn of, however many kernels have it."""
    return rows.where("error is not null").groupBy("backend", "stage", "error").agg(F.count("*").alias("n"), F.min_by(F.col("content").cast("string"), "hash").alias("message"))
