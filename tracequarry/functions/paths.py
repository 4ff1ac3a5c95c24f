"""File names, sources and line selections."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_extensions(name: Column) -> Column:
    """Without the outer compression suffix and then the format's own."""
    return F.regexp_replace(name, r"(\.bin\.ndjson|\.ndjson|\.clp)?(\.gz|\.zst)?$", "")


def file_identity(name: Column) -> Column:
    """Struct ``rank``, ``pid``, ``host`` of a trace file's name. Suffixes ``_host_H_``,
    ``_pid_P_`` and ``_rank_R_`` are peeled off from the right, so the same words inside a user
    name mean nothing. A missing part is null."""
    base = strip_extensions(name)
    host = F.regexp_extract(base, r"^(.*)_host_([A-Za-z0-9\-]+)_$", 2)
    rest = F.when(host != "", F.concat(F.regexp_extract(base, r"^(.*)_host_([A-Za-z0-9\-]+)_$", 1), F.lit("_"))).otherwise(base)
    pid = F.regexp_extract(rest, r"^(.*)_pid_(\d+)_$", 2)
    left = F.when(pid != "", F.concat(F.regexp_extract(rest, r"^(.*)_pid_(\d+)_$", 1), F.lit("_"))).otherwise(rest)
    rank = F.regexp_extract(left, r"^(.*)_rank_(\d+)_$", 2)
    return F.struct(F.expr("int(null)").alias("_")).withField("rank", rank.try_cast("int")).withField("pid", pid.try_cast("long")).withField("host", F.nullif(host, F.lit(""))).dropFields("_")


def source_kind(path: str) -> str:
    """``local_clp`` for a folder with an archive of that kind, ``local`` for other folders,
    ``local_file`` for files."""
    if os.path.isdir(path):
        return "local_clp" if any(x.endswith(".clp") for x in os.listdir(path)) else "local"
    if os.path.isfile(path):
        return "local_file"
    raise ValueError(f"no such file or folder: {path}")


@dataclass(frozen=True)
class RankChoice:
    """Which ranks to read: all, none (files without a rank), or one."""

    rank: int | None = None
    everything: bool = False
    none: bool = False

    @classmethod
    def of(cls, rank: str | int | None, everything: bool, local: bool = True) -> RankChoice:
        if rank is not None and everything:
            raise ValueError("a rank and all ranks exclude each other")
        if rank is None:
            return cls(everything=everything or local, rank=None if everything or local else 0)
        if str(rank) == "none":
            return cls(none=True)
        return cls(rank=int(rank))


def line_set(lines: str, total: int | None = None) -> set[int]:
    """``1,3,5-10,-5``: line numbers from 1; ``-5`` means the last five, for which ``total`` is
    needed."""
    out: set[int] = set()
    for part in (p.strip() for p in lines.split(",")):
        if not part:
            continue
        if part.startswith("-"):
            if total is None:
                raise ValueError("the last lines of a file of unknown length")
            n = int(part[1:])
            if n <= 0:
                raise ValueError(f"not a number of lines: {part}")
            out.update(range(max(1, total - n + 1), total + 1))
        elif "-" in part:
            a, b = (int(x) for x in part.split("-", 1))
            if a < 1 or b < a:
                raise ValueError(f"not a range of lines: {part}")
            out.update(range(a, b + 1))
        else:
            n = int(part)
            if n < 1:
                raise ValueError(f"not a line number: {part}")
            out.add(n)
    return out


def diff_path(path: str) -> str:
    """Where a trace's comparison goes: ``x.ndjson[.gz]`` to ``x_diff.ndjson[.gz]``."""
    for end in (".ndjson.gz", ".ndjson"):
        if path.endswith(end):
            return path[: -len(end)] + "_diff" + end
    return path + "_diff.ndjson"
