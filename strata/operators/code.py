"""Operators over instructions: blocks, last definitions, constants, reflection and flags of methods.

An instruction has (method, pos, ..); pos orders a method's code. Windows are partitioned by method, whose
size is bounded by the platform's limit on code, so none grows with the number of apps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def basic_blocks(code: DataFrame, leader: Column) -> DataFrame:
    """code with `block`, from 0: a new one begins at a method's first instruction and wherever leader holds."""
    order = Window.partitionBy("method").orderBy("pos")
    starts = F.when(F.row_number().over(order) == 1, 0).otherwise(leader.cast("int"))
    return code.withColumn("_s", starts).withColumn("block", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_s")


def block_edges(blocks: DataFrame, ends: Column, target: Column | None = None) -> DataFrame:
    """(method, src, dst) between blocks: to the next one unless its last instruction ends the flow, and to
    the block of its jump target (a pos) if it has one; no target is given where nothing jumps."""
    target, jumping = (F.lit(None).cast("int"), False) if target is None else (target, True)
    last = blocks.groupBy("method", "block").agg(F.max_by(F.struct(ends.alias("ends"), target.alias("target")), "pos").alias("z"), F.min("pos").alias("start"))
    last = last.withColumn("_next", F.lead("block").over(Window.partitionBy("method").orderBy("block")))
    falls = last.where((F.col("_next") == F.col("block") + 1) & ~F.coalesce("z.ends", F.lit(False)) & F.col("method").isNotNull())
    falls = falls.select("method", F.col("block").alias("src"), F.col("_next").alias("dst"))
    if not jumping:
        return falls
    jumps = last.where("z.target is not null").select("method", F.col("block").alias("src"), F.col("z.target").alias("start"))
    heads = last.select("method", F.col("block").alias("dst"), "start")
    return falls.unionByName(jumps.join(heads, ["method", "start"]).select("method", "src", "dst")).distinct()


def exit_blocks(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(method, block): blocks that no edge leaves."""
    return blocks.select("method", "block").distinct().join(edges.select("method", F.col("src").alias("block")), ["method", "block"], "left_anti")


def last_definition(code: DataFrame, value: Column, defines: Column, register: str, used: str, scope: tuple = ("method",)) -> DataFrame:
    """code with `defined`: the value last put before it into the register that it uses, or null.

    defines says which rows put value into the column `register`; `used` is the register that a row reads.
    Definitions and uses are one stream by scope and register, so the as-of join is a window.
    """
    marks = [*code.columns]
    puts = code.where(defines).select(*scope, F.col(register).alias("_r"), "pos", value.alias("_v"), F.lit(True).alias("_put"), *(F.lit(None).cast(t).alias(f"_{c}") for c, t in code.dtypes))
    uses = code.select(*scope, F.col(used).alias("_r"), "pos", F.lit(None).cast(puts.schema["_v"].dataType).alias("_v"), F.lit(False).alias("_put"), *(F.col(c).alias(f"_{c}") for c in marks))
    before = Window.partitionBy(*scope, "_r").orderBy("pos", F.col("_put")).rowsBetween(Window.unboundedPreceding, -1)
    seen = puts.unionByName(uses).withColumn("_d", F.last(F.when(F.col("_put"), F.col("_v")), ignorenulls=True).over(before))
    return seen.where(~F.col("_put")).select(*(F.col(f"_{c}").alias(c) for c in marks), F.col("_d").alias("defined"))


def _agreed(rows: list[tuple]) -> list[tuple]:
    """(block, register, value) that hold on every way into the blocks of one method: see constants. rows are (block,
    dst) of an edge, or (block, null, register, value, known)."""
    own: dict = {}
    before: dict = {}
    after: dict = {}
    nodes = set()
    for block, dst, register, value, known in rows:
        nodes.add(block)
        if dst is None:
            own.setdefault(block, {})[register] = value if known else None
        else:
            nodes.add(dst)
            before.setdefault(dst, set()).add(block)
            after.setdefault(block, set()).add(dst)
    leaving: dict = {}  # what holds at the end of each block that is reached
    into: dict = {}
    todo = [b for b in nodes if b not in before]
    while todo:
        block = todo.pop()
        held = None
        for b in before.get(block, ()):
            if b in leaving:
                out = leaving[b]
                held = dict(out) if held is None else {r: v for r, v in held.items() if out.get(r) == v}
        into[block] = held or {}
        left = {r: v for r, v in (into[block] | own.get(block, {})).items() if v is not None}
        if block not in leaving or left != leaving[block]:
            leaving[block] = left
            todo.extend(after.get(block, ()))
    return [(b, r, v) for b, held in into.items() for r, v in held.items()]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The methods of rows (method, block, dst, register, value, known) in the order of method, one at a time."""
    schema = None
    method, rows, found = None, [], []

    def end() -> None:
        found.extend((method, *f) for f in _agreed(rows))

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    for b in batches:
        schema = pa.schema([b.schema.field(c) for c in ("method", "block", "register", "value")])
        for m, *row in zip(*(b.column(c).to_pylist() for c in ("method", "block", "dst", "register", "value", "known"))):
            if rows and m != method:
                end()
                rows = []
            method = m
            rows.append(row)
        if len(found) > 50_000:
            yield batch()
            found.clear()
    if rows:
        end()
    if found:
        yield batch()


def constants(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(method, block, register, value): registers that hold one and the same constant on every way into a block.

    blocks has (method, block, register, value, known): what a block last does to a register, known being
    false if that is no constant. A must-analysis: a block's state is what all predecessors that are reached
    agree on; states only lose entries after a block is first reached, so the loop ends. No way leaves a method, whose
    size the platform bounds, so methods are dealt and sorted by Spark once, and each is closed where it lies. They are
    dealt by a hash of their own: by `method` Spark would take the two tables as dealt already, though partitions of
    each may have been joined in other ways.
    """
    types = {c: blocks.schema[c].dataType for c in ("register", "value", "known")}
    ways = edges.select("method", F.col("src").alias("block"), "dst", *(F.lit(None).cast(t).alias(c) for c, t in types.items()))
    own = blocks.select("method", "block", F.lit(None).cast(edges.schema["dst"].dataType).alias("dst"), *types)
    every = own.unionByName(ways).where("method is not null").repartition(F.xxhash64("method")).sortWithinPartitions("method")
    return every.mapInArrow(_solved, StructType([StructField(c, blocks.schema[c].dataType) for c in ("method", "block", "register", "value")]))


def method_flag(code: DataFrame, condition: Column, name: str, keys: tuple = ("method",)) -> DataFrame:
    """code with a boolean: whether any instruction of its method meets the condition."""
    return code.withColumn(name, F.max(F.coalesce(condition, F.lit(False))).over(Window.partitionBy(*keys)))


def up_to_first(code: DataFrame, stop: Column, keys: tuple = ("method",)) -> DataFrame:
    """The instructions of each method up to and with the first that meets the condition."""
    order = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return code.withColumn("_stopped", F.max(F.coalesce(stop, F.lit(False)).cast("int")).over(order)).where(F.coalesce("_stopped", F.lit(0)) == 0).drop("_stopped")


def reflection_edges(code: DataFrame, methods: DataFrame, known: DataFrame) -> DataFrame:
    """(app_id, caller, callee, offset): calls by name that a block's own strings resolve.

    code (app_id, method, block, pos, kind, dst, src, value): kind const_string puts value into dst; class_for_name
    and get_method read the name in src and stand in dst for it; invoke calls what src stands for. All
    overloads of (class_name, method_name) in methods are called; edges in known (caller, callee) are left out.
    """
    scope = ("app_id", "method", "block")
    named = last_definition(code, F.col("value"), F.col("kind") == "const_string", "dst", "src", scope)
    fqn = F.concat(F.lit("L"), F.replace("defined", F.lit("."), F.lit("/")), F.lit(";"))
    order = Window.partitionBy(*scope).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    held = named.withColumn("_class", F.last(F.when(F.col("kind") == "class_for_name", fqn), ignorenulls=True).over(order))
    held = held.withColumn("_name", F.last(F.when(F.col("kind") == "get_method", F.col("defined")), ignorenulls=True).over(order))
    calls = held.where("kind = 'invoke' and _class is not null and _name is not null")
    hits = calls.select("app_id", F.col("method").alias("caller"), F.col("pos").alias("offset"), F.col("_class").alias("class_name"), F.col("_name").alias("method_name"))
    made = hits.join(methods.select("app_id", "class_name", "method_name", F.col("method_id").alias("callee")), ["app_id", "class_name", "method_name"])
    return made.select("app_id", "caller", "callee", "offset").distinct().join(known.select("app_id", "caller", "callee"), ["app_id", "caller", "callee"], "left_anti")
