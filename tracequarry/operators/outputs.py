"""Events as files: artifacts of a compilation, comparison events, consolidated outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.operators.ordering import first_wins


def finite(x: Column) -> Column:
    """Null for what JSON has no number for."""
    return F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), x)


def artifacts(compilations: DataFrame) -> DataFrame:
    """A row per artifact of each compilation (``hash``, ``name``, ``raw``): ``file`` and
    ``content``, and the Python source with a head that says where it comes from."""
    files = F.from_json(F.get_json_object("raw", "$.payload.file_content"), "map<string,string>")
    texts = compilations.select("hash", "name", F.explode(files).alias("key", "content"))
    texts = texts.select("hash", F.concat("name", F.lit("."), F.element_at(F.split("key", r"\."), -1)).alias("file"), "content")
    one = lambda k: F.get_json_object("raw", f"$.payload.python_source.{k}")
    head = F.concat(F.lit("# "), F.coalesce(one("file_path"), F.lit("?")), F.lit(":"), F.coalesce(one("start_line"), F.lit("?")), F.lit("-"), F.coalesce(one("end_line"), F.lit("?")), F.lit("\n"))
    source = F.coalesce(one("code"), one("content"))
    return texts.unionAll(compilations.where(source.isNotNull()).select("hash", F.concat("name", F.lit("_source.py")), F.concat(head, source)))


def write_artifacts(rows: DataFrame, folder: str) -> None:
    """Write artifacts (``hash``, ``file``, ``content``) below a folder in a store that all executors
    reach, each in its hash's folder. A file is written under another name and moved into place, so
    that a task that runs twice leaves one whole file."""

    def write(part) -> None:
        import uuid

        from tracequarry.sources.frames import store_of

        store, top = store_of(folder)
        for r in part:
            store.create_dir(f"{top}/{r['hash']}", recursive=True)
            own = f"{top}/{r['hash']}/.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as f:
                f.write(r["content"].encode())
            store.move(own, f"{top}/{r['hash']}/{r['file']}")

    rows.foreachPartition(write)


def comparison_events(pairs: DataFrame, kind: str = "compilation_diff") -> DataFrame:
    """``raw`` JSON events of compared pairs, with an id made from the pair."""
    rest = [c for c in pairs.columns if not c.startswith("raw")]
    ident = F.expr("uuid()") if not rest else F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest if c.startswith("idx")]), 256), 1, 32)
    body = [finite(F.col(c)).alias(c) if dict(pairs.dtypes)[c] in ("double", "float") else F.col(c) for c in rest]
    return pairs.select(F.to_json(F.struct(F.lit(kind).alias("event_type"), ident.alias("diff_id"), *body)).alias("raw"))


def consolidated(compilations: DataFrame, comparisons: DataFrame, order: str = "ord") -> DataFrame:
    """Compilations once per hash in order of first sight (those without a hash are left out),
    then comparison events: ``section``, ``ord``, ``raw``."""
    own = first_wins(compilations.where("coalesce(hash, '') <> ''"), "hash", order)
    a = own.select(F.lit(0).alias("section"), F.col(order).cast("string").alias("ord"), "raw")
    return a.unionAll(comparisons.select(F.lit(1), F.sha2("raw", 256), "raw"))


def pretty(raw: Column) -> Column:
    """Indented JSON with sorted keys."""
    return F.to_json(F.parse_json(raw), {"pretty": "true"})


def context(launches: DataFrame) -> DataFrame:
    """Launch and compilation together (``launch``, ``compilation``: JSON) as the arguments a
    call needs: ``kwargs`` and ``tensors``. A captured graph, which has only a note, is an
    error."""
    args = F.from_json(F.get_json_object("launch", "$.extracted_args"), "map<string,string>")
    kind = lambda x: F.get_json_object(x, "$.type")
    rows = launches.withColumn("_a", F.when(F.map_contains_key(args, F.lit("_note")), F.raise_error(F.lit("the launch was captured in a graph")).cast("map<string,string>")).otherwise(args))
    value = lambda x: F.when(kind(x) == "NoneType", F.lit(None).cast("string")).otherwise(F.coalesce(F.get_json_object(x, "$.value"), F.get_json_object(x, "$.repr")))
    scalar = F.map_filter("_a", lambda k, x: ~F.coalesce(kind(x).isin("tensor", "TensorDescriptor"), F.lit(False)))
    tensor = F.map_filter("_a", lambda k, x: F.coalesce(kind(x).isin("tensor", "TensorDescriptor"), F.lit(False)))
    grid = F.from_json(F.get_json_object("launch", "$.grid"), "array<bigint>")
    return rows.select("hash", "name", grid.alias("grid"), F.transform_values(scalar, lambda k, x: value(x)).alias("kwargs"), tensor.alias("tensors"), F.get_json_object("compilation", "$.payload.metadata").alias("compile"))
