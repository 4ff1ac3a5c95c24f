"""Functions and files that a function needs, over many files."""

from __future__ import annotations

from tracequarry.operators import callgraph

SOURCES = {
    "app.main": "from lib.api import run as go\nimport lib.tools\nimport numpy as np\nfrom torch import nn\n\ndef main():\n    go()\n    lib.tools.trim()\n    np.zeros(3)\n    helper()\n\ndef helper():\n    pass\n\ndef unused():\n    lib.tools.never()\n",
    "lib.api": "from lib.core import run\nfrom lib.tools import trim\n",
    "lib.core": "from lib.tools import trim\nimport app.main\n\ndef run():\n    trim()\n    app.main.helper()\n    inner()\n\ndef inner():\n    run()\n",
    "lib.tools": "import os\n\ndef trim():\n    os.getcwd()\n\ndef never():\n    pass\n",
    "lib.alone": "def f():\n    pass\n",
}


def catalogue(spark):
    rows = [(f"/src/{m.replace('.', '/')}.py", m, m.rpartition(".")[0], s) for m, s in SOURCES.items()]
    sources = spark.createDataFrame(rows, "file string, module string, package string, source string")
    return sources, sources.selectExpr("module", "file as path")


def test_functions_and_files_over_files(spark):
    sources, modules = catalogue(spark)
    edges, rows = callgraph.call_edges(sources), callgraph.import_rows(sources)
    found = callgraph.reached_functions(edges, rows, modules, spark.createDataFrame([("app.main.main",)], "node string"))
    got = {r["node"]: (r["steps"], r["module"]) for r in found.collect()}
    assert got == {
        "app.main.main": (0, "app.main"), "lib.api.run": (1, "lib.api"), "lib.core.run": (2, "lib.core"), "lib.tools.trim": (1, "lib.tools"), "numpy.zeros": (1, None), "app.main.helper": (1, "app.main"),
        "lib.core.inner": (3, "lib.core"), "os.getcwd": (2, None),
    }
    files = {r["path"]: (r["functions"], r["steps"]) for r in callgraph.reached_files(found).collect()}
    assert files == {"/src/app/main.py": (2, 0), "/src/lib/api.py": (1, 1), "/src/lib/core.py": (2, 2), "/src/lib/tools.py": (1, 1)}


def test_levels_end_on_cycles_and_flag_what_is_outside(spark):
    sources, modules = catalogue(spark)
    rows = callgraph.import_rows(sources)
    levels = callgraph.import_levels(rows, modules, spark.createDataFrame([("/src/lib/core.py",)], "node string"))
    assert {r["node"]: r["steps"] for r in levels.collect()} == {"/src/lib/core.py": 0, "/src/app/main.py": 1, "/src/lib/tools.py": 1, "/src/lib/api.py": 2}
    names = lambda out: {(r["module"], tuple(r["names"])) for r in out.collect()}
    assert names(callgraph.outside(rows, modules, levels)) == {("numpy", ("numpy",)), ("os", ("os",)), ("torch", ("nn",))}
    assert ("lib.api", ("run",)) in names(callgraph.outside(rows, modules, levels, ("lib",)))
    none = callgraph.import_levels(rows, modules, spark.createDataFrame([("/src/lib/core.py",)], "node string"), ("lib", "app"))
    assert [r["steps"] for r in none.collect()] == [0]
