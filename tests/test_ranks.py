"""Sessions, rooflines and launch types by rank: several ranks together give what each gives alone."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_traces import BENCH, RUN, TTIR, compilation, launch

from tracequarry.config import CONFIG_FIELDS
from tracequarry.functions.canonical import canonical
from tracequarry.operators import autotune
from tracequarry.plans import merge
from tracequarry.sources import trace

KINDS = ((BENCH, RUN), (BENCH, RUN), (RUN,), ())


def arg(value):
    return {"type": "int", "value": value}


def events_of_rank(rank, seed):
    """Sessions at several places of a user's code, equal hashes on all ranks, arguments that stay,
    vary by configuration, and vary within one."""
    rng, rows = random.Random(seed), []
    for n in range(60):
        h = f"c{rng.randrange(6)}"
        place = {"line": rng.randrange(3), "name": "main", "filename": "app.py", "loc": ""}
        if rng.random() < 0.3:
            row = compilation(h, "mm", 1, (BENCH,), warps=2 << int(h[1]) % 3, ttir=TTIR, **({"maxnreg": 64} if h == "c1" else {}))
        else:
            row = launch(h, "mm", 1, n, rng.choice(KINDS), grid=(rng.randrange(1, 4),))
            row["extracted_args"] |= {"same": arg("k"), "warps": arg(int(h[1])), "within": arg(rng.randrange(3)), f"only_{h}": 1}
        row["stack"][0] = place
        rows.append(row)
    rows.append({"event_type": "autotune", "stack": [place, BENCH, RUN], "best_config": {"warps": rank}, "duration": 1.5, "cache_hit": False})
    return rows


def lines(spark, ranks):
    rows = [(f"/t/rank_{r}", 0, i, json.dumps(e), r) for r in ranks for i, e in enumerate(events_of_rank(r, 7 * (r or 0)))]
    df = spark.createDataFrame(rows, "path string, file_ord int, line_no long, raw string, rank int").repartition(3)
    return trace.events(df)


TABLES = ("compilations", "launches", "sessions", "winner_counts", "differences", "rooflines", "session_arguments", "session_differences")


def rows_of(merged, table):
    df = getattr(merged, table)
    return Counter(map(str, df.select(*[c for c in sorted(df.columns) if c != "v"]).collect()))


@pytest.fixture(scope="module")
def both(spark):
    return merge.merge(lines(spark, [0, 1]))


def test_ranks_together_equal_ranks_alone(spark, both):
    ranks = [merge.merge(lines(spark, [r])) for r in (0, 1)]
    for table in TABLES:
        alone = [rows_of(m, table) for m in ranks]
        assert rows_of(both, table) == alone[0] + alone[1] and alone[0] and alone[0] != alone[1], table


def test_one_roofline_a_launch(both):
    found = both.rooflines.groupBy("rank", "launch_index").count()
    assert found.where("count > 1").isEmpty() and found.count() == both.launches.join(both.compilations.where("not is_fake").select("rank", "hash"), ["rank", "hash"]).count()


def reference(events):
    """The sessions of one rank, event by event."""
    by_group, sessions, number = {}, defaultdict(list), 0
    compiled = defaultdict(dict)
    for e in events:
        place = (e["stack"][0]["line"], len(e["stack"]) > 1)
        if e["event_type"] == "compilation":
            h = e["payload"]["metadata"]["hash"]
            if place[1]:
                compiled[place[0]].setdefault(h, {k: str(v) for k, v in e["payload"]["metadata"].items() if k in CONFIG_FIELDS})
        elif e["event_type"] == "launch":
            e = dict(e, number=number)
            number += 1
            group = canonical({k: v for k, v in e.items() if k not in ("pid", "timestamp", "stream", "number")})
            by_group[group] = e
            if place[1]:
                sessions[place[0]].append(group)
    out = {}
    for place, groups in sessions.items():
        order = sorted(set(groups), key=lambda g: by_group[g]["number"])
        dist, arg_order = defaultdict(lambda: defaultdict(Counter)), {}
        for g in order:
            e = by_group[g]
            for k, v in e["extracted_args"].items():
                arg_order.setdefault(k)
                dist[e["compilation_metadata"]["hash"]][k][canonical(v)] += 1
        sames, varies = {}, []
        for k in arg_order:
            values = [d[k] for d in dist.values()]
            if any('"tensor"' in x for v in values for x in v):
                continue
            if all(len(v) == 1 for v in values) and len({x for v in values for x in v}) == 1:
                sames[k] = next(iter(values[0]))
            else:
                varies.append(k)
        for p in CONFIG_FIELDS:
            values = [compiled[place].get(h, {}).get(p) for h in dist]
            if any(v is not None for v in values):
                if len(set(values)) == 1:
                    sames[p] = values[0]
                else:
                    varies.append(p)
        out[json.dumps([list(arg_order), sames, sorted(varies)], sort_keys=True)] = {(h, k): sorted(c.items(), key=lambda x: -x[1]) for h, d in dist.items() for k, c in d.items()}
    return out


def test_argument_summary_against_event_by_event(both):
    for rank in (0, 1):
        got = both.session_arguments.where(F.col("rank") == rank).collect()
        want = reference(events_of_rank(rank, 7 * rank))
        named = {json.dumps([r["arg_order"], r["sames"], r["varies"]], sort_keys=True): r for r in got}
        assert named.keys() == want.keys() and len(want) == 3
        for k, r in named.items():
            found = {(x["hash"], x["arg"]): Counter({v["value"]: v["count"] for v in x["values"]}) for x in r["per_config"]}
            assert found == {key: Counter(dict(v)) for key, v in want[k].items() if v}
            assert all([v["count"] for v in x["values"]] == sorted((v["count"] for v in x["values"]), reverse=True) and x["unique_count"] == len(x["values"]) for x in r["per_config"])


def test_arguments_shared_and_varied(both):
    r = both.session_arguments.where("rank = 0").first()
    assert r["sames"]["same"] == canonical(arg("k")) and "num_stages" in {*r["varies"], *r["sames"]}
    assert {"within", "warps", "n"} <= set(r["varies"]) and "x" not in {*r["varies"], *r["sames"]}
    assert both.session_differences.where("rank = 0 and key = 'extracted_args.same.value' and kind = 'same'").count() == both.session_arguments.where("rank = 0").count()


def test_results_are_the_tuners_own(both):
    told = {r["rank"]: r["result"] for r in both.sessions.where("result is not null").collect()}
    assert told[1]["best_config"] == '{"warps":1}' and told[1]["duration"] == "1.5" and told[1]["cache_hit"] == "false"


def test_sessions_without_ranks(spark):
    rows = [(1, "s", True, "a", "g1", 1), (2, "s", True, "b", "g2", 2), (3, "s", False, "b", "g2", 3), (4, None, False, "c", "g3", 4), (0, "t", False, "b", "g2", 0)]
    df = spark.createDataFrame(rows, "ord long, session_id string, is_benchmark boolean, hash string, group_hash string, occurrence_id long")
    assert {r["ord"]: r["launch_type"] for r in autotune.launch_types(df).collect()} == {0: "cached_winner", 1: "benchmark", 2: "benchmark", 3: "winner", 4: None}
    comps = spark.createDataFrame([("s", "a", 0), ("s", "b", 0), ("s", "a", 5), ("s", None, 6), ("s", None, 7)], "session_id string, hash string, ord long")
    (c,) = autotune.session_configs(comps).collect()
    assert (c["hashes"], c["n_configs"]) == (["a", "b"], 4)
    s = autotune.analyses(comps, df).collect()
    assert [(r["session_id"], r["benchmark_ranges"], r["winner_ranges"], r["winner_hash"], r["cache_usage"]) for r in s] == [("s", "1-2", "3", "b", False)]
