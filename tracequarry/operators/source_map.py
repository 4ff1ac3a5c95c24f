"""Which source line each line of an intermediate representation comes from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window


@dataclass
class Location:
    """One definition ``#locN = loc(...)``: a place, another location under a name or none, or a
    call site."""

    ident: str
    place: tuple[str, int, int] | None = None
    of: str | None = None
    name: str | None = None
    callee: str | None = None
    caller: str | None = None


def _ident(text: str) -> str | None:
    """The number of ``#locN``, empty for ``#loc``; None for anything else."""
    text = text.strip()
    digits = text[4:]
    return digits if text.startswith("#loc") and (not digits or digits.isdigit()) else None


def read_definition(line: str) -> Location | None:
    """The location that a line defines, if it defines one."""
    left, equals, right = line.partition("=")
    ident, body = _ident(left), right.strip()
    if not equals or ident is None or not (body.startswith("loc(") and body.endswith(")")):
        return None
    body = body[4:-1].strip()
    if body.startswith('"'):
        text, _, rest = body[1:].partition('"')
        rest = rest.strip()
        if rest.startswith("(") and rest.endswith(")"):
            of = _ident(rest[1:-1])
            return None if of is None else Location(ident, of=of, name=text)
        numbers = rest.removeprefix(":").split(":")
        if text and len(numbers) == 2 and all(n.isdigit() for n in numbers):
            return Location(ident, place=(text, int(numbers[0]), int(numbers[1])))
        return None
    if body.startswith("callsite(") and body.endswith(")"):
        callee, at, caller = body[9:-1].partition(" at ")
        ends = _ident(callee), _ident(caller)
        return Location(ident, callee=ends[0], caller=ends[1]) if at and None not in ends else None
    of = _ident(body)
    return None if of is None else Location(ident, of=of)


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``; null without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def _use(text: Column) -> Column:
    """The number of the location that a line names at its end, ``0`` for a bare one; null if none."""
    tail = F.substring_index(F.rtrim(F.regexp_replace(text, r"\s+$", "")), "loc(#loc", -1)
    number = F.substring_index(tail, ")", 1)
    fits = text.contains("loc(#loc") & (tail == F.concat(number, F.lit(")"))) & ((number == "") | number.rlike("^[0-9]+$"))
    return F.when(fits, F.when(number == "", "0").otherwise(number))


def _place(text: Column) -> Column:
    """The place ``loc("file":line:column)`` that a line ends up naming, as a struct; null if none."""
    tail = F.when(text.contains('loc("'), F.substring_index(text, 'loc("', -1))
    numbers = F.split(F.substring_index(_after(tail, '":'), ")", 1), ":")
    line, column = (F.try_element_at(numbers, F.lit(i)).try_cast("int") for i in (1, 2))
    fits = (F.size(numbers) == 2) & line.isNotNull() & column.isNotNull()
    return F.when(fits, F.struct(F.substring_index(tail, '"', 1).alias("file"), line.alias("line"), column.alias("column")))


def _directive(text: Column, comment: str) -> Column:
    """The place of a ``.loc file line column`` directive, whose comment names the file; null if a
    line holds none."""
    code, said = F.trim(F.regexp_replace(F.substring_index(text, comment, 1), "\t", " ")), F.trim(_after(text, comment))
    words = F.split(F.trim(_after(code, ".loc ")), " +")
    number, line, column = (F.try_element_at(words, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    file = F.regexp_replace(said, r":[0-9]+:[0-9]+.*$", "")
    fits = number.isNotNull() & line.isNotNull() & column.isNotNull() & (F.length(file) < F.length(said)) & (file != "")
    return F.when(fits, F.struct(file.alias("file"), line.alias("line"), column.alias("column")))


def _sass_place(text: Column) -> Column:
    """File and line of a comment that names them; null if a line holds none."""
    said = _after(text, '//## File "')
    line = F.regexp_extract(_after(said, '", line '), "^[0-9]+", 0).try_cast("int")
    return F.when(line.isNotNull(), F.struct(F.substring_index(said, '"', 1).alias("file"), line.alias("line")))


def _marks(text: Column, what: str) -> Column:
    """Whether a comment marks where a function begins or ends."""
    before = F.when(text.contains(f"-- {what} function"), F.substring_index(text, f"-- {what} function", 1))
    return F.coalesce(before.contains("//") | before.contains(";"), F.lit(False))


def resolve_locations(ir: str) -> list[dict]:
    """All location definitions of a text with the place each stands for. The main one has an
    empty id; aliases take their target's place and callsites their callee's. Cycles resolve to
    nothing."""
    place: dict[str, tuple[str, int, int]] = {}
    alias: dict[str, str] = {}
    names: dict[str, str] = {}
    sites: dict[str, tuple[str, str]] = {}
    at: dict[str, int] = {}
    for n, line in enumerate(ir.split("\n"), 1):
        found = read_definition(line)
        if found is None or (found.place and not found.ident and "" in place):  # the first main location counts
            continue
        at[found.ident] = n
        if found.place:
            place[found.ident] = found.place
        elif found.of is not None:
            alias[found.ident] = found.of
            if found.name is not None:
                names[found.ident] = found.name
        else:
            sites[found.ident] = (found.callee, found.caller)

    def follow(start: str) -> tuple[str, int, int] | None:
        seen, now = set(), start
        while now not in place and now not in seen:
            seen.add(now)
            if now in alias:
                now = alias[now]
            elif now in sites:
                now = sites[now][0]
            else:
                return None
        return place.get(now)

    out = []
    for key in [*place, *(k for k in alias if k not in place), *(k for k in sites if k not in place and k not in alias)]:
        found = follow(key)
        if found:
            callee, caller = sites.get(key, (None, None)) if key not in place else (None, None)
            out.append({"loc_id": key, "file": found[0], "line": found[1], "column": found[2], "def_line": at[key], "alias_of": alias.get(key), "alias_name": names.get(key), "callee": callee, "caller": caller})
    return out


@udtf(returnType="loc_id string, file string, line int, column int, def_line int, alias_of string, alias_name string, callee string, caller string")
class ResolveLocations:
    def eval(self, ir: str):
        for r in resolve_locations(ir or ""):
            yield tuple(r.values())


def ir_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """A row per line of each text, numbered from 1."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(F.split(text, "\n", -1)).alias("_p", "text")).withColumn("ir_line", F.col("_p") + 1).drop("_p")


def definitions(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    df.sparkSession.udtf.register("tracequarry_locations", ResolveLocations)
    named = ", ".join(f"t.{k}" for k in keys)
    return df.sparkSession.sql(f"select {named}, l.* from {{rows}} t, lateral tracequarry_locations(t.{text}) l", rows=df)


def generic_map(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Source places of the lines of texts with location tables: lines that use a location at
    their end, or name a place themselves; and, as ``loc_def``, definitions without a place as
    lines. A bare use has the id ``0``, which no definition has."""
    lines = ir_lines(df.select(*keys, F.col(text).alias("text")))
    lines = lines.withColumn("loc_id", _use(F.col("text"))).withColumn("_here", _place(F.col("text")))
    defs = definitions(df.select(*keys, F.col(text).alias("text")), keys)
    used = lines.where("loc_id is not null").join(defs, [*keys, "loc_id"]).select(*keys, "ir_line", "file", "line", "column", F.lit("line").alias("kind"), "loc_id")
    direct = lines.where(F.col("loc_id").isNull() & F.col("_here").isNotNull() & ~F.ltrim("text").startswith("#loc"))
    direct = direct.select(*keys, "ir_line", "_here.file", "_here.line", "_here.column", F.lit("line").alias("kind"), F.lit(None).cast("string").alias("loc_id"))
    found = used.unionAll(direct)
    rest = defs.select(*keys, F.col("def_line").alias("ir_line"), "file", "line", "column", F.lit("loc_def").alias("kind"), "loc_id").join(found.select(*keys, "ir_line"), [*keys, "ir_line"], "left_anti")
    return found.unionAll(rest)


def assembly_map(df: DataFrame, keys: list[str], stage: str, others: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Places of the lines of the first function of an assembly text: a ``.loc`` holds for
    itself and the code lines behind it. A bare file name becomes the least full path of that
    name in ``others`` (``*keys``, ``file``)."""
    mark = "//" if stage == "ptx" else ";"
    lines = ir_lines(df.select(*keys, F.col(text).alias("text")))
    everything = Window.partitionBy(*keys)
    begin = F.min(F.when(_marks(F.col("text"), "Begin"), F.col("ir_line"))).over(everything)
    lines = lines.withColumn("_a", begin)
    lines = lines.withColumn("_b", F.min(F.when(_marks(F.col("text"), "End") & (F.col("ir_line") > F.col("_a")), F.col("ir_line"))).over(everything))
    lines = lines.where("ir_line > _a and ir_line <= _b")
    loc = _directive(F.col("text"), mark)
    here = loc.isNotNull()
    by = Window.partitionBy(*keys).orderBy("ir_line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("_l", F.last(loc, ignorenulls=True).over(by)).where("_l is not null")
    body = F.trim("text")
    lines = lines.where(here | ((body != "") & ~body.startswith(mark))).select(*keys, "ir_line", "_l.*")
    if others is not None:
        full = others.where(F.col("file").startswith("/")).groupBy(*keys, F.element_at(F.split("file", "/"), -1).alias("_base")).agg(F.min("file").alias("_full"))
        lines = lines.withColumn("_base", F.col("file")).join(full, [*keys, "_base"], "left").withColumn("file", F.coalesce("_full", "file")).drop("_full", "_base")
    return lines.select(*keys, "ir_line", "file", "line", "column")


def sass_map(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Places of machine instructions: the first ``File`` comment of a block of such comments
    holds for the instructions up to the next block. ``pc`` is the instruction's address."""
    lines = ir_lines(df.select(*keys, F.col(text).alias("text")))
    said = _sass_place(F.col("text"))
    is_loc = said.isNotNull()
    order = Window.partitionBy(*keys).orderBy("ir_line")
    lines = lines.withColumn("_loc", is_loc).withColumn("_new", is_loc & ~F.coalesce(F.lag(is_loc).over(order), F.lit(False)))
    lines = lines.withColumn("_block", F.sum(F.col("_new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.when(F.col("_new"), said)
    lines = lines.withColumn("_p", F.max(place).over(Window.partitionBy(*keys, "_block")))
    pc = F.conv(F.nullif(F.regexp_extract("text", r"/\*([0-9a-fA-F]+)\*/", 1), F.lit("")), 16, 10).cast("long")
    return lines.where(~F.col("_loc") & F.col("_p").isNotNull() & pc.isNotNull() & ~F.col("text").contains(".nv_debug_ptx_txt")).select(*keys, "ir_line", "_p.file", "_p.line", F.lit(0).alias("column"), pc.alias("pc"))


def link_stages(source: DataFrame, target: DataFrame, keys: list[str], by_column: bool = True) -> DataFrame:
    """Lines of ``target`` from the same source place as each line of ``source``, ascending.
    Machine code has no columns: leave ``by_column`` off."""
    on = [*keys, "file", "line", *(["column"] if by_column else [])]
    right = target.select(*on, F.col("ir_line").alias("_t")).distinct()
    return source.join(right, on).groupBy(*keys, "ir_line").agg(F.array_sort(F.collect_set("_t")).alias("target_lines"))


def by_python_line(maps: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of each stage that come from each source line."""
    lines = maps.where("coalesce(kind, 'line') <> 'loc_def'") if "kind" in maps.columns else maps
    return lines.groupBy(*keys, "file", "line", "stage").agg(F.array_sort(F.collect_set("ir_line")).alias("ir_lines"))


