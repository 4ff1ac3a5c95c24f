"""Call graphs and imports of Python sources."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window

from tracequarry.operators.ordering import closure


def calls(source: str, module: str) -> Iterator[tuple[str, str, int, int, str]]:
    """``caller``, ``callee``, line, column and type of every call, with names qualified by what
    the scopes around bind. Decorators are calls of type ``decorator``. Sources that don't parse
    have none."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return
    found: list[tuple[str, str, int, int, str]] = []

    def qualified(node: ast.expr, envs: list[dict[str, str]], scope: list[str]) -> str:
        parts: list[str] = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        if not isinstance(node, ast.Name):
            return "<dynamic>"
        if node.id == "self" and len(scope) > 1 and parts:
            return ".".join([*scope[:-1], *reversed(parts)])
        head = next((e[node.id] for e in reversed(envs) if node.id in e), node.id)
        return ".".join([head, *reversed(parts)])

    def bind(body: list[ast.stmt], env: dict[str, str], scope: list[str]) -> None:
        for s in body:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                env[s.name] = ".".join([*scope, s.name])
            elif isinstance(s, ast.Import):
                for n in s.names:
                    env[n.asname or n.name.split(".")[0]] = n.name if n.asname else n.name.split(".")[0]
            elif isinstance(s, ast.ImportFrom):
                for n in s.names:
                    env[n.asname or n.name] = f"{'.' * s.level}{s.module or ''}.{n.name}".lstrip(".")

    def walk(node: ast.AST, scope: list[str], envs: list[dict[str, str]]) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            for d in node.decorator_list:
                target = d.func if isinstance(d, ast.Call) else d
                found.append((".".join([*scope, node.name]), qualified(target, envs, scope), d.lineno, d.col_offset, "decorator"))
            env: dict[str, str] = {}
            inner = [*scope, node.name]
            if not isinstance(node, ast.ClassDef):
                bind(node.body, env, inner)
            for s in node.body:
                walk(s, inner, [*envs, env])
            return
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and isinstance(node.value, (ast.Name, ast.Attribute)):
            envs[-1][node.targets[0].id] = qualified(node.value, envs, scope)
        if isinstance(node, ast.Call):
            found.append((".".join(scope), qualified(node.func, envs, scope), node.lineno, node.col_offset, "regular"))
        if isinstance(node, ast.Lambda):
            walk(node.body, [*scope, f"<lambda>@{node.lineno}:{node.col_offset}"], envs)
            return
        for child in ast.iter_child_nodes(node):
            walk(child, scope, envs)

    top: dict[str, str] = {}
    bind(tree.body, top, [module])
    for s in tree.body:
        walk(s, [module], [top])
    yield from found


def imports(source: str, package: str = "") -> Iterator[tuple[str, str, str, str | None, int, int]]:
    """``kind`` (import or from), ``module`` (relative ones made absolute in ``package``),
    ``name``, ``alias``, level and line of everything imported."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for n in node.names:
                yield "import", n.name, n.name, n.asname, 0, node.lineno
        elif isinstance(node, ast.ImportFrom):
            module = node.module or ""
            if node.level:
                base = package.split(".")[: len(package.split(".")) - node.level + 1] if package else []
                module = ".".join([*base, *([module] if module else [])])
            for n in node.names:
                yield "from", module, n.name, n.asname, node.level, node.lineno


@udtf(returnType="caller string, callee string, line int, column int, call_type string")
class CallEdges:
    def eval(self, source: str, module: str):
        yield from calls(source or "", module or "")


@udtf(returnType="kind string, module string, name string, alias string, level int, line int")
class Imports:
    def eval(self, source: str, package: str):
        yield from imports(source or "", package or "")


def call_edges(sources: DataFrame) -> DataFrame:
    """Edges of sources (``file``, ``module``, ``source``)."""
    spark = sources.sparkSession
    spark.udtf.register("tracequarry_calls", CallEdges)
    return spark.sql("select s.file, c.* from {rows} s, lateral tracequarry_calls(s.source, s.module) c", rows=sources)


def import_rows(sources: DataFrame) -> DataFrame:
    """Imports of sources (``file``, ``package``, ``source``)."""
    spark = sources.sparkSession
    spark.udtf.register("tracequarry_imports", Imports)
    return spark.sql("select s.file, i.* from {rows} s, lateral tracequarry_imports(s.source, s.package) i", rows=sources)


def unique_edges(edges: DataFrame) -> DataFrame:
    """One edge for each caller and callee: the first place."""
    w = Window.partitionBy("caller", "callee").orderBy("file", "line", "column")
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dependents(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All functions that the roots (``node``; full names, or last parts of names) call, directly
    or not, other than the roots."""
    regular = edges.where("call_type = 'regular'")
    names = regular.select(F.col("caller").alias("node")).unionAll(regular.select("callee")).distinct()
    known_as = names.select("node", F.explode(F.array_distinct(F.array("node", F.element_at(F.split("node", r"\."), -1)))).alias("root"))
    own = known_as.join(roots.select(F.col("node").alias("root")), "root").select("node").distinct()
    reached = closure(regular.select(F.col("caller").alias("src"), F.col("callee").alias("dst")), own)
    return reached.where("steps > 0").select("node")


def merged_imports(rows: DataFrame) -> DataFrame:
    """Names imported from each module by kind, each once."""
    return rows.groupBy("kind", "module").agg(F.array_sort(F.collect_set("name")).alias("names"))


def resolve(rows: DataFrame, modules: DataFrame, externals: tuple[str, ...] = ()) -> DataFrame:
    """Add ``path`` of the imported module from a catalogue (``module``, ``path``) and whether it
    is ``external``: neither it nor the name within it is there, or its first part is one of
    ``externals``, whatever the catalogue has."""
    m = modules.select(F.col("module").alias("_m"), "path")
    deep = rows.withColumn("_full", F.concat_ws(".", "module", "name"))
    out = deep.join(m, F.col("_full") == F.col("_m"), "left").drop("_m").withColumnRenamed("path", "_deep")
    out = out.join(m, F.col("module") == F.col("_m"), "left").drop("_m")
    foreign = F.coalesce(F.substring_index("module", ".", 1).isin(list(externals)), F.lit(False))
    out = out.withColumn("path", F.when(~foreign, F.coalesce("_deep", "path"))).drop("_deep", "_full")
    return out.withColumn("external", F.col("path").isNull())


def import_levels(rows: DataFrame, modules: DataFrame, roots: DataFrame, externals: tuple[str, ...] = ()) -> DataFrame:
    """Files that roots (``node``, paths) import, directly or not, with the least number of ``steps``;
    roots have 0. Each step resolves only what the last one found; circular imports end."""
    edges = resolve(rows, modules, externals).where("not external")
    return closure(edges.select(F.col("file").alias("src"), F.col("path").alias("dst")).distinct(), roots)


def outside(rows: DataFrame, modules: DataFrame, files: DataFrame, externals: tuple[str, ...] = ()) -> DataFrame:
    """Modules outside the catalogue that files (``node``) import, with the names from each."""
    own = resolve(rows, modules, externals).where("external").join(files.select(F.col("node").alias("file")).distinct(), "file", "left_semi")
    return merged_imports(own)


def reached_functions(edges: DataFrame, rows: DataFrame, modules: DataFrame, roots: DataFrame) -> DataFrame:
    """Functions that roots (``node``, full names) call over all files: ``node``, least ``steps``,
    ``module`` and ``path`` of the file that has them (null outside the catalogue).

    ``edges`` are those of ``call_edges``, ``rows`` those of ``import_rows``. A name that a module
    only hands on, since it imports it from another, leads to that one in a step of its own. The
    longest module of the catalogue that begins a name has it."""
    calls = edges.where("call_type = 'regular'").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    own = rows.where("kind = 'from'").join(modules.select(F.col("path").alias("file"), F.col("module").alias("_in")), "file")
    handed = own.select(F.concat_ws(".", "_in", F.coalesce("alias", "name")).alias("src"), F.concat_ws(".", "module", "name").alias("dst"))
    found = closure(calls.unionAll(handed).where("src <> dst").distinct(), roots)
    parts = F.split("node", r"\.")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    places = found.select("node", F.posexplode(starts).alias("_n", "module")).join(modules, "module")
    places = places.groupBy("node").agg(F.max_by(F.struct("module", "path"), "_n").alias("_at"))
    return found.join(places, "node", "left").select("node", "steps", "_at.module", "_at.path")


def reached_files(functions: DataFrame) -> DataFrame:
    """Files of reached functions with the number of functions and the least number of steps."""
    return functions.where("path is not null").groupBy("path").agg(F.count("*").alias("functions"), F.min("steps").alias("steps"))
