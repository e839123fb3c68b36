"""Data flow over instructions, with access paths, sanitisers, contexts of calls and the way of each value.

A fact says that the value of a start is in a slot of a method, under a path of fields, from a position on, having
passed a set of sanitisers on every way (a bit mask, joined by bit_and, so it only loses bits). A start is a source's
result, or a parameter with a path: a method is analysed once for each such context, made when some call first passes
a value there, so a helper's clean and tainted callers stay apart. What a context gives back or sends to a sink is
composed with the facts of its callers. Every fact keeps the fact that it came from when it was first found, so the
shortest way of a value is read off by doubling those pointers.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from strata.catalogues import flows as labels
from strata.catalogues import taint as values
from strata.plans.keep import fixed, keep, small, written

#: Fields of a path that are told apart; what is below them counts as the last one's.
LONGEST = 3
#: Calls between a source and a sink.
DEPTH = 8
#: The labels of sanitisers, in the order of their bits.
SANITISERS = tuple(sorted({s[2] for s in values.SANITIZERS} | {label for n in values.NATIVES for _, label in n[4]}))
#: The fact before another.
_FACT = "struct<slot:string,path:string,since:int>"
_SHORT = re.compile(rf"((?:\.[^.]*){{1,{LONGEST}}})")
_KEY = ["app_id", "method", "start", "slot", "path", "since"]


def bits(names) -> int:
    """The mask of some labels of sanitisers."""
    return sum(1 << i for i, s in enumerate(SANITISERS) if s in names)


def covers() -> dict[str, int]:
    """The mask of the sanitisers that make a sink's label harmless, by label."""
    found: dict[str, int] = {}
    for _, _, label, harmless in values.SANITIZERS:
        for sink in harmless:
            found[sink] = found.get(sink, 0) | bits([label])
    return found


def _any(text: str, parts) -> Column:
    test = F.lit(False)
    for p in parts:
        test = test | F.contains(F.col(text), F.lit(p))
    return F.coalesce(test, F.lit(False))


#: What a row of acts() is: a step by its operation, a sanitiser's mark, a source's result, a sink's argument, a call.
COPY, PUT, GET, STAMP, SEED, SINK, CALL = range(7)
_OPS = ("copy", "put", "get")
_ACT = "struct<what:int,pos:int,at:int,src:string,dst:string,field:string,mask:bigint>"
_ACTS = ["what", "pos", "at", "src", "dst", "field", "mask"]


def _matched(code: DataFrame) -> DataFrame:
    """code with `_specs` (role, label, param, mask) and `_natives` (see taint.native_effects) of calls, as arrays, so that no
    row is doubled and nothing has to be grouped again. No summary of a native method is for all names."""
    spark = code.sparkSession
    specs: dict[str, list] = {}
    for role, rows in (("source", values.SOURCES), ("sink", values.SINKS), ("sanitizer", values.SANITIZERS)):
        for c, m, label, param in rows:
            clean = role == "sanitizer"
            specs.setdefault(c, []).append((m, role, label, None if clean else param, bits([label]) if clean else 0))
    natives: dict[str, list] = {}
    for c, m, gives, makes, cleans, sinks in values.NATIVES:
        natives.setdefault(m, []).append((c, list(gives), list(makes), [(i, bits([label])) for i, label in cleans], list(sinks)))
    by_class = fixed(spark, specs.items(), "_class string, _of_class array<struct<name:string,role:string,label:string,param:int,mask:bigint>>")
    by_name = fixed(spark, natives.items(), "_name string, _of_name array<struct<class:string,gives:array<int>,makes:array<string>,cleans:array<struct<arg:int,mask:bigint>>,sinks:array<struct<arg:int,label:string>>>>")
    known = (F.col("kind") == "invoke") & F.col("ref_class").isNotNull()
    both = code.join(by_class, F.when(known, F.col("ref_class")) == F.col("_class"), "left").join(by_name, F.when(known, F.col("ref_name")) == F.col("_name"), "left")
    return both.withColumns({
        "_specs": F.filter("_of_class", lambda s: (s["name"] == "*") | (s["name"] == F.col("ref_name"))),
        "_natives": F.filter("_of_name", lambda n: (n["class"] == "*") | (n["class"] == F.col("ref_class"))),
    }).drop("_class", "_of_class", "_name", "_of_name")


def acts(code: DataFrame, calls: bool = True) -> DataFrame:
    """What the instructions of code (see sources.smali) do to values, a row each: (app_id, method, what, pos, at, src, dst,
    field, mask), where registers have no versions yet and the registers of a call are one text.

    Everything is told by an instruction and the one after it, so that nothing is dealt after the reader's windows.
    """
    order = Window.partitionBy("app_id", "file", "method_no").orderBy("pos")
    after = F.lead("opcode").over(order)
    taken = code.withColumns({"_result": F.when(after.startswith("move-result"), F.lead("dst").over(order)), "_at": F.lead("pos").over(order)})
    taken = _matched(taken.select("app_id", "method", "pos", "opcode", "kind", "registers", "ref", "ref_class", "ref_name", "ref_desc", "_result", "_at").where(F.col("method").isNotNull()))
    call = F.col("kind") == "invoke"
    taken = taken.withColumns({
        "_this": F.when(F.col("opcode").startswith("invoke-static"), 0).otherwise(1),
        "_clean": F.coalesce(F.aggregate(F.filter("_specs", lambda s: s["role"] == "sanitizer"), F.lit(0).cast("long"), lambda m, s: m.bitwiseOR(s["mask"])), F.lit(0).cast("long")),
        "_builder": call & _any("ref", ("StringBuilder;->append", "StringBuffer;->append")),
        "_text": call & _any("ref", ("StringBuilder;->toString", "StringBuffer;->toString")),
        "_puts": call & _any("ref", labels.CONTAINER_WRITES), "_gets": call & _any("ref", labels.CONTAINER_READS),
    })
    none, zero, pos, result, code_of = F.lit(None).cast("string"), F.lit(0).cast("long"), F.col("pos"), F.col("_result"), F.col("opcode")

    def act(what: int, src: Column, dst: Column, field: Column = none, at: Column = pos, mask: Column = zero, place: Column = pos) -> Column:
        return F.struct(F.lit(what), place, at, src, dst, field, mask).cast(_ACT)

    argument = lambda i: F.get("registers", i)
    first, second, element = argument(F.lit(0)), argument(F.lit(1)), F.lit("[]")
    others = F.slice("registers", 2, 1000)
    taken_at = {"at": F.col("_at"), "mask": F.col("_clean")}
    told = result.isNotNull()
    plain = ~F.col("_builder") & ~F.col("_text")
    with_this = lambda i: F.get("registers", i + F.col("_this"))
    of_specs = lambda role, made: F.transform(F.filter("_specs", lambda s: s["role"] == role), made)
    of_natives = lambda name, made: F.flatten(F.transform("_natives", lambda n: F.transform(n[name], made)))
    groups = [
        F.when(code_of.startswith("move") & ~code_of.contains("result"), F.array(act(COPY, second, first))),
        F.when(code_of.startswith("iput"), F.array(act(PUT, first, second, F.col("ref_name")))),
        F.when(code_of.startswith("iget"), F.array(act(GET, second, first, F.col("ref_name")))),
        F.when(code_of.startswith("aput"), F.array(act(PUT, first, second, element))),
        F.when(code_of.startswith("aget"), F.array(act(GET, second, first, element))),
        F.when(code_of.isin("return", "return-object", "return-wide"), F.array(act(COPY, first, F.lit("return")))),
        F.when(F.col("_builder"), F.transform(others, lambda r: act(COPY, r, first))),
        F.when(F.col("_builder") & told, F.transform("registers", lambda r: act(COPY, r, result, **taken_at))),
        F.when(F.col("_text") & told, F.array(act(COPY, first, result, **taken_at))),
        F.when(plain & F.col("_puts"), F.transform(others, lambda r: act(PUT, r, first, element))),
        F.when(plain & F.col("_gets") & told, F.array(act(GET, first, result, element, **taken_at))),
        F.when(F.col("_natives").isNotNull() & told, of_natives("gives", lambda i: act(COPY, with_this(i), result, **taken_at))),
        F.when(F.col("_clean") != 0, F.transform(others, lambda r: act(STAMP, r, none, mask=F.col("_clean")))),
        F.when(F.col("_natives").isNotNull(), of_natives("cleans", lambda c: act(STAMP, with_this(c["arg"]), none, mask=c["mask"]))),
        F.when(F.col("_specs").isNotNull() & told, of_specs("source", lambda s: act(SEED, result, none, s["label"], F.col("_at"), place=F.col("_at")))),
        F.when(F.col("_natives").isNotNull() & told, of_natives("makes", lambda m: act(SEED, result, none, m, F.col("_at"), place=F.col("_at")))),
        F.when(F.col("_specs").isNotNull(), of_specs("sink", lambda s: act(SINK, with_this(s["param"]), none, s["label"]))),
        F.when(F.col("_natives").isNotNull(), of_natives("sinks", lambda s: act(SINK, with_this(s["arg"]), none, s["label"]))),
    ]
    if calls:
        callee = F.concat("ref_class", F.lit("->"), "ref_name", "ref_desc")
        groups.append(F.when(call & callee.isNotNull(), F.array(act(CALL, F.array_join("registers", " "), result, callee, F.col("_at")))))
    each = taken.select("app_id", "method", F.explode(F.flatten(F.array_compact(F.array(*groups)))).alias("a")).select("app_id", "method", "a.*")
    return each.where(f"src is not null and (what > {GET} or dst is not null)")


class _Method:
    """What the rows of acts() of one method do, by the slots that are read: a slot is a register and its version, which a
    sanitiser of the register ends; `return` is the method's result."""

    def __init__(self, rows: list[tuple]) -> None:
        marks: dict[tuple, int] = {}
        for what, pos, _, src, _, _, mask in rows:
            if what == STAMP:
                marks[src, pos] = marks.get((src, pos), 0) | mask
        ends: dict[str, list[int]] = {}
        for reg, pos in sorted(marks):
            ends.setdefault(reg, []).append(pos)

        def slot(reg: str, pos: int) -> str:
            return f"{reg}#{bisect_left(ends[reg], pos) if reg in ends else 0}"

        self.steps: dict[str, list[tuple]] = {}
        self.seeds: set[tuple] = set()
        self.sinks: dict[str, set[tuple]] = {}
        self.calls: list[tuple] = []
        for what, pos, at, src, dst, field, mask in rows:
            if what <= GET:
                self.steps.setdefault(slot(src, pos), []).append((pos, dst if dst == "return" else slot(dst, at), _OPS[what], field, at, mask))
            elif what == SEED:
                self.seeds.add((pos, slot(src, pos), field))
            elif what == SINK:
                self.sinks.setdefault(slot(src, pos), set()).add((pos, field))
            elif what == CALL:
                result = dst and slot(dst, at)
                given = [(f"p{i}", slot(r, pos)) for i, r in enumerate(src.split(" "))] if src else [(None, None)]
                self.calls += [(pos, field, param, s, result, at) for param, s in given]
        for (reg, pos), mask in marks.items():
            self.steps.setdefault(slot(reg, pos), []).append((pos, slot(reg, pos + 1), "copy", None, pos, mask))


def _in_classes(found: Callable[[int, dict[str, _Method]], Iterator[tuple]], schema: pa.Schema) -> Callable:
    """Over rows of acts() that are dealt and sorted by _dealt(): the rows that found(app_id, methods) gives for each class."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, {}, []
        before, name = None, None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        def end() -> None:
            out.extend(found(now[0], {m: _Method(r) for m, r in rows.items()}))

        for b in batches:
            for app, method, *act in zip(*(b.column(c).to_pylist() for c in ("app_id", "method", *_ACTS))):
                if method != before:
                    before, name = method, method.split("->", 1)[0]
                if (app, name) != now:
                    if rows:
                        end()
                    now, rows = (app, name), {}
                rows.setdefault(method, []).append(tuple(act))
            if len(out) > 50_000:
                yield batch()
                out.clear()
        if rows:
            end()
        if out:
            yield batch()

    return over


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of acts() by class, whose size the platform bounds; a class's methods come one after another."""
    return rows.repartition(F.xxhash64("app_id", F.substring_index("method", "->", 1))).sortWithinPartitions("app_id", "method")


def _mapped(rows: DataFrame, found: Callable, columns: str) -> DataFrame:
    """found for each class of acts(), as a table of the columns, of which app_id has the type that it has in rows."""
    schema = rows.sparkSession.createDataFrame([], columns).schema
    schema = StructType([StructField(f.name, rows.schema["app_id"].dataType if f.name == "app_id" else f.dataType) for f in schema])
    return _dealt(rows).mapInArrow(_in_classes(found, to_arrow_schema(schema)), schema)


def _told(app: int, methods: dict[str, _Method]) -> Iterator[tuple]:
    for name, m in methods.items():
        for read, each in m.steps.items():
            yield from ((app, name, "step", at, seen, read, write, op, field, mask) for seen, write, op, field, at, mask in each)
        yield from ((app, name, "seed", pos, pos, slot, None, None, label, 0) for pos, slot, label in m.seeds)
        yield from ((app, name, "sink", pos, pos, slot, None, None, label, 0) for slot, each in m.sinks.items() for pos, label in each)
        yield from ((app, name, "call", pos, at, slot, result, param, callee, 0) for pos, callee, param, slot, result, at in m.calls)


def _tables(rows: DataFrame, kept: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """The tables of steps() but acts, from rows of acts()."""
    every = kept(_mapped(rows, _told, "app_id long, method string, what string, pos int, seen int, read string, write string, op string, field string, mask long"))
    of = lambda what: every.where(F.col("what") == what)
    within = rows.select("app_id", F.col("method").alias("callee")).distinct()
    calls = of("call").select("app_id", "method", "pos", F.col("field").alias("callee"), F.col("op").alias("param"), F.col("read").alias("slot"), F.col("write").alias("result"), F.col("seen").alias("at"))
    return {
        "steps": of("step").drop("what").distinct(),
        "seeds": of("seed").select("app_id", "method", "pos", F.col("read").alias("slot"), F.col("field").alias("label")),
        "sinks": of("sink").select("app_id", "method", "pos", F.col("read").alias("slot"), F.col("field").alias("label")),
        "calls": calls.join(within, ["app_id", "callee"], "left_semi").select(*calls.columns),
    }


def steps(code: DataFrame) -> dict[str, DataFrame]:
    """What the instructions of code (see sources.smali) do to values, as tables by app_id and method:

    acts, see acts(), which is written once, and the others from it: steps (pos, seen, read, write, op, field, mask): op
    copy, put or get, of a field; seeds (pos, slot, label): a source's
    result; sinks (pos, slot, label); calls (pos, callee, param, slot, result, at): an argument of a call to a method
    of the app, the slot of its result and where that is taken. A slot is a register and its version, which a sanitiser
    of the register ends; `return` is the method's result.
    """
    rows = written(acts(code))
    return {"acts": rows, **_tables(rows)}


@contextmanager
def _without_constraints(spark: SparkSession) -> Iterator[None]:
    """Within it plans infer no constraints: Spark fails to rename those of a checkpoint that a union holds twice."""
    name = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def facts(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The least fixpoint over the tables of steps(): facts and the passages of calls.

    facts (app_id, method, start, slot, path, since, mask, round, from): start is `source|method|pos|label` or
    `param|path` of a context; round is the number of steps of the shortest way, from the fact before (a struct
    slot, path, since), null at a start. passages (app_id, method, start, pos, callee, callee_start, mask): a value of
    a start that is an argument of a call. Each round closes methods over what calls brought into them in the last one; it
    ends as positions rise along a method, paths are bounded and masks only lose bits.
    """
    with _without_constraints(tables["steps"].sparkSession):
        return _closed(tables)


def _after(op: str, field: str | None, path: str) -> str | None:
    """The path after an operation, `.f.g` for field f and then g, empty for the value itself; None if it ends there."""
    if op == "copy" or (op == "get" and path == ""):
        return path
    if field is None:
        return None
    if op == "put":
        return _SHORT.match(f".{field}{path}")[1]
    return path[len(field) + 1 :] if path == f".{field}" or path.startswith(f".{field}.") else None


def _reached(facts_: dict, steps_: dict) -> None:
    """Adds to facts_ of one method (start, slot, path, since) -> [mask, round, from] all that its steps lead to, a round of
    steps at a time; steps_ has (seen, write, op, field, pos, mask) by the slot that is read."""
    frontier = list(facts_)
    while frontier:
        found: dict = {}
        for fact in frontier:
            start, slot, path, since = fact
            mask, n, _ = facts_[fact]
            for seen, write, op, field, pos, adds in steps_.get(slot, ()):
                if seen <= since or (to := _after(op, field, path)) is None:
                    continue
                key, now = (start, write, to, pos), (mask | adds, n + 1, fact[1:])
                if key in found:
                    old = found[key]
                    now = (old[0] & now[0], min(old[1], now[1]), min(old[2], now[2]))
                found[key] = now
        frontier = []
        for key, (mask, n, before) in found.items():
            known = facts_.get(key)
            if known is None:
                facts_[key] = [mask, n, before]
            elif known[0] & mask != known[0]:
                known[0] &= mask
            else:
                continue
            frontier.append(key)


def _closing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The methods of rows of _within() in their order, one at a time."""
    schema, of, facts_, steps_ = None, None, {}, {}
    found: list[tuple] = []

    def end() -> None:
        _reached(facts_, steps_)
        for (start, slot, path, since), (mask, n, before) in facts_.items():
            found.append((*of, start, slot, path, since, mask, n, before and dict(zip(("slot", "path", "since"), before))))
        facts_.clear()
        steps_.clear()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    for b in batches:
        schema = pa.schema([b.schema.field(c) for c in (*_KEY, "mask", "round", "from")])
        for app, method, start, slot, path, since, mask, n, before, write, op in zip(*(b.column(c).to_pylist() for c in (*_KEY, "mask", "round", "from", "write", "op"))):
            if (app, method) != of:
                if facts_:
                    end()
                steps_.clear()
                of = app, method
            if op is None:
                facts_[start, slot, path, since] = [mask, n, before and (before["slot"], before["path"], before["since"])]
            else:
                steps_.setdefault(slot, []).append((since, write, op, path, n, mask))
        if len(found) > 50_000:
            yield batch()
            found.clear()
    if facts_:
        end()
    if found:
        yield batch()


def _within(facts_: DataFrame, steps_: DataFrame) -> DataFrame:
    """facts_ and all that steps_ lead to within their methods.

    Methods, whose size the platform bounds, are dealt and sorted by Spark and each is closed where it lies, so a round is one
    of calls, not of instructions. A row of a step has its slot, field, position read, mask and position in the columns of
    a fact. They are dealt by a hash of their own, see operators.code.constants.
    """
    methods = small(keep(facts_.select("app_id", "method").distinct()))
    own = facts_.select(*_KEY, "mask", "round", "from", F.lit(None).cast("string").alias("write"), F.lit(None).cast("string").alias("op"))
    to = steps_.join(methods, ["app_id", "method"], "left_semi").select(
        "app_id", "method", F.lit(None).cast("string").alias("start"), F.col("read").alias("slot"), F.col("field").alias("path"), F.col("seen").cast("int").alias("since"),
        "mask", F.col("pos").cast("int").alias("round"), F.lit(None).cast(_FACT).alias("from"), "write", "op",
    )
    every = own.unionByName(to).repartition(F.xxhash64("app_id", "method")).sortWithinPartitions("app_id", "method")
    return every.mapInArrow(_closing, StructType([StructField(c, facts_.schema[c].dataType) for c in (*_KEY, "mask", "round", "from")]))


def _closed(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    steps_, calls, seeds = (keep(tables[name]) for name in ("steps", "calls", "seeds"))
    source = F.concat_ws("|", F.lit("source"), "method", F.col("pos").cast("string"), "label")
    before, zero = F.lit(None).cast(_FACT), F.lit(0).cast("long")
    coming = seeds.select("app_id", "method", source.alias("start"), "slot", F.lit("").alias("path"), F.col("pos").cast("int").alias("since"), zero.alias("mask"), F.lit(0).alias("round"), before.alias("from")).distinct()
    known = delta = keep(_within(keep(coming), steps_))
    nothing = known.select("app_id", "method", "start", F.lit(0).alias("pos"), F.lit("").alias("callee"), F.lit("").alias("callee_start"), "mask").limit(0)
    if calls.isEmpty():
        return known, nothing
    sites = keep(calls.where("result is not null").select("app_id", "callee", "method", "result", "at").distinct())
    passages, returned = None, None
    key = ["app_id", "method", "start", "pos", "callee", "callee_start", "param", "path", "result", "at", "round", "from"]
    while not delta.isEmpty():
        here = F.struct("slot", "path", "since").alias("from")
        passing = delta.drop("from").join(calls, ["app_id", "method", "slot"]).where("pos > since")
        passing = keep(passing.select("app_id", "method", "start", "pos", "callee", F.concat_ws("|", "param", "path").alias("callee_start"), "param", "path", "mask", "result", "at", "round", here))
        given = keep(delta.where("slot = 'return'").select("app_id", F.col("method").alias("callee"), F.col("start").alias("callee_start"), F.col("path").alias("_path"), F.col("mask").alias("_mask")))
        entered = passing.select("app_id", F.col("callee").alias("method"), F.col("callee_start").alias("start"), F.concat("param", F.lit("#0")).alias("slot"), "path", F.lit(-1).alias("since"), zero.alias("mask"), F.lit(0).alias("round"), before.alias("from"))
        all_passed = passing if passages is None else passages.unionByName(passing)
        all_given = given if returned is None else returned.unionByName(given)
        back = passing.join(all_given, ["app_id", "callee", "callee_start"])
        if passages is not None:
            back = back.unionByName(passages.join(given, ["app_id", "callee", "callee_start"]))
        back = back.where("result is not null").select("app_id", "method", "start", F.col("result").alias("slot"), F.col("_path").alias("path"), F.col("at").cast("int").alias("since"), F.col("mask").bitwiseOR(F.col("_mask")).alias("mask"), (F.col("round") + 1).alias("round"), "from")
        arisen = given.where("callee_start like 'source|%'").join(sites, ["app_id", "callee"]).select(
            "app_id", "method", F.col("callee_start").alias("start"), F.col("result").alias("slot"), F.col("_path").alias("path"), F.col("at").cast("int").alias("since"), F.col("_mask").alias("mask"), F.lit(0).alias("round"), before.alias("from")
        )
        found = entered.unionByName(back).unionByName(arisen).groupBy(*_KEY).agg(F.bit_and("mask").alias("mask"), F.min(F.struct("round", "from")).alias("_w")).select(*_KEY, "mask", "_w.*")
        coming = keep(_unknown(found, known))
        if coming.isEmpty():
            delta = coming
        else:
            delta = keep(_unknown(_within(coming, steps_), known))
            known = keep(known.join(delta.select(*_KEY), _KEY, "left_anti").unionByName(delta))
        passages = keep(all_passed.groupBy(*key).agg(F.bit_and("mask").alias("mask")))
        returned = keep(all_given.groupBy("app_id", "callee", "callee_start", "_path").agg(F.bit_and("_mask").alias("_mask")))
    if passages is None:
        return known, nothing
    return known, keep(passages.groupBy("app_id", "method", "start", "pos", "callee", "callee_start").agg(F.bit_and("mask").alias("mask")))


def _unknown(found: DataFrame, known: DataFrame) -> DataFrame:
    """The facts of found that known lacks, or has with more bits, with the bits that both have."""
    old = known.select(*_KEY, F.col("mask").alias("_m"), F.col("round").alias("_r"), F.col("from").alias("_f"))
    return found.join(old, _KEY, "left").where("_m is null or (_m & mask) <> _m").select(
        *_KEY, F.when(F.col("_m").isNull(), F.col("mask")).otherwise(F.col("_m").bitwiseAND(F.col("mask"))).alias("mask"),
        F.coalesce("_r", "round").alias("round"), F.when(F.col("_m").isNull(), F.col("from")).otherwise(F.col("_f")).alias("from"),
    )


def _flows(depth: int) -> Callable[[int, dict[str, _Method]], Iterator[tuple]]:
    """The flows of a class that has no calls to or from others, see findings(): the least fixpoint of facts() and what its
    calls compose, in one place."""

    def flows(app: int, methods: dict[str, _Method]) -> Iterator[tuple]:
        if not any(m.seeds for m in methods.values()):
            return
        calls: dict[str, dict] = {name: {} for name in methods}
        sites: dict[str, set] = {}
        for name, m in methods.items():
            for pos, callee, param, slot, result, at in m.calls:
                if callee in methods:
                    if slot is not None:
                        calls[name].setdefault(slot, []).append((pos, callee, param, result, at))
                    if result is not None:
                        sites.setdefault(callee, set()).add((name, result, at))
        facts_: dict[str, dict] = {name: {} for name in methods}
        todo: list[tuple] = []
        passages: dict[tuple, dict] = {}  # what calls hand on, by callee and its start: caller, its start and place -> mask
        waiting: dict[tuple, dict] = {}  # where results of a callee's start go: caller, start, slot and position -> mask
        given: dict[tuple, dict] = {}  # results by callee and its start: path -> mask

        def add(method: str, fact: tuple, mask: int) -> None:
            old = facts_[method].get(fact)
            if old is None or old & mask != old:
                facts_[method][fact] = mask if old is None else old & mask
                todo.append((method, fact))

        for name, m in methods.items():
            for pos, slot, label in m.seeds:
                add(name, ((name, pos, label), slot, "", pos), 0)
        while todo:
            name, fact = todo.pop()
            (start, slot, path, since), mask, m = fact, facts_[name][fact], methods[name]
            for seen, write, op, field, pos, adds in m.steps.get(slot, ()):
                if seen > since and (to := _after(op, field, path)) is not None:
                    add(name, (start, write, to, pos), mask | adds)
            for pos, callee, param, result, at in calls[name].get(slot, ()):
                if pos > since:
                    inner = callee, (param, path)
                    handed = passages.setdefault(inner, {})
                    handed[name, start, pos] = handed.get((name, start, pos), mask) & mask
                    add(callee, ((param, path), f"{param}#0", path, -1), 0)
                    if result is not None:
                        back = waiting.setdefault(inner, {})
                        back[name, start, result, at] = own = back.get((name, start, result, at), mask) & mask
                        for returned, bits_ in list(given.get(inner, {}).items()):
                            add(name, (start, result, returned, at), own | bits_)
            if slot == "return":
                results = given.setdefault((name, start), {})
                results[path] = mask = results.get(path, mask) & mask
                for (caller, outer, result, at), bits_ in list(waiting.get((name, start), {}).items()):
                    add(caller, (outer, result, path, at), bits_ | mask)
                if len(start) == 3:  # a source's value goes to all that call the method
                    for caller, result, at in sites.get(name, ()):
                        add(caller, (start, result, path, at), mask)
        moving: dict[tuple, int] = {}
        for name, m in methods.items():
            for (start, slot, path, since), mask in facts_[name].items() if m.sinks else ():
                for pos, label in m.sinks.get(slot, ()):
                    if pos > since:
                        key = name, start, (name, pos, label)
                        moving[key] = moving.get(key, mask) & mask
        reached = {key: (mask, 0) for key, mask in moving.items()}
        for n in range(1, depth + 1):
            up: dict[tuple, int] = {}
            for (name, start, sink), mask in moving.items():
                for (caller, outer, _), bits_ in passages.get((name, start), {}).items():
                    key = caller, outer, sink
                    up[key] = up.get(key, bits_ | mask) & (bits_ | mask)
            moving = {}
            for key, mask in up.items():
                old, chain = reached.get(key, (None, n))
                if old is None or old & mask != old:
                    moving[key] = mask if old is None else old & mask
                    reached[key] = moving[key], chain
            if not moving:
                break
        best: dict[tuple, tuple] = {}
        for (_, start, sink), (mask, chain) in reached.items():
            if len(start) == 3:
                old = best.get((start, sink), (mask, chain))
                best[start, sink] = old[0] & mask, min(old[1], chain)
        yield from ((app, *start, *sink, chain, mask) for (start, sink), (mask, chain) in best.items())

    return flows


_FOUND = "app_id long, source_method string, source_pos int, source_label string, sink_method string, sink_pos int, sink_label string, chain int, mask long"


def findings(tables: dict[str, DataFrame], depth: int = DEPTH) -> DataFrame:
    """(app_id, source_method, source_pos, source_label, sink_method, sink_pos, sink_label, chain, mask, neutralisation):
    each source that reaches a sink, with the fewest calls between them and what every way has passed.

    neutralisation is full if one of the sanitisers makes the sink's label harmless, partial if there are others. Classes that
    call no other class of their app, and that none calls, are dealt and closed where they lie; the others take rounds
    of calls, see facts().
    """
    rows = tables["acts"]
    of, to = F.substring_index("method", "->", 1).alias("class"), F.substring_index("field", "->", 1).alias("to")
    outside = rows.where(f"what = {CALL}").select("app_id", of, to).where("class <> to")
    classes = rows.select("app_id", of).distinct()
    called = keep(outside.select("app_id", F.col("to").alias("class")).distinct().join(classes, ["app_id", "class"], "left_semi"))
    own = rows.where(F.expr(f"what <> {CALL} or substring_index(field, '->', 1) = substring_index(method, '->', 1)"))
    if called.isEmpty():
        best = _mapped(own, _flows(depth), _FOUND)
    else:
        callers = outside.join(small(called).withColumnRenamed("class", "to"), ["app_id", "to"], "left_semi").select("app_id", "class")
        linked = keep(called.union(callers).distinct())
        among = lambda df, how: df.withColumn("class", of).join(small(linked), ["app_id", "class"], how).select(*df.columns)
        best = _mapped(among(own, "left_anti"), _flows(depth), _FOUND).unionByName(_in_rounds(_tables(among(rows, "left_semi"), written), depth))
    harmless = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in covers().items() for x in p)), "sink_label"), F.lit(0))
    word = F.when(F.col("mask").bitwiseAND(harmless) != 0, "full").when(F.col("mask") != 0, "partial").otherwise("none")
    return best.withColumn("neutralisation", word)


def _in_rounds(tables: dict[str, DataFrame], depth: int) -> DataFrame:
    """The flows of findings() without neutralisation, by rounds of joins over the tables of steps()."""
    known, passages = facts(tables)
    sinks = tables["sinks"].select("app_id", "method", "slot", F.col("pos").alias("sink_pos"), F.col("label").alias("sink_label"))
    keys = ["app_id", "method", "start", "sink_method", "sink_pos", "sink_label"]
    hits = known.join(sinks, ["app_id", "method", "slot"]).where("sink_pos > since").select("app_id", "method", "start", F.col("method").alias("sink_method"), "sink_pos", "sink_label", "mask")
    moving = keep(hits.groupBy(*keys).agg(F.bit_and("mask").alias("mask")).withColumn("chain", F.lit(0)))
    reached = moving
    for n in range(1, depth + 1):
        below = moving.select("app_id", F.col("method").alias("callee"), F.col("start").alias("callee_start"), "sink_method", "sink_pos", "sink_label", F.col("mask").alias("_mask"))
        up = passages.join(below, ["app_id", "callee", "callee_start"]).groupBy(*keys).agg(F.bit_and(F.col("mask").bitwiseOR(F.col("_mask"))).alias("mask"))
        old = reached.select(*keys, F.col("mask").alias("_m"), F.col("chain").alias("_c"))
        moving = keep(up.join(old, keys, "left").where("_m is null or (_m & mask) <> _m").select(*keys, F.coalesce(F.col("_m").bitwiseAND(F.col("mask")), "mask").alias("mask"), F.coalesce("_c", F.lit(n)).alias("chain")))
        if moving.isEmpty():
            break
        reached = keep(reached.join(moving.select(*keys), keys, "left_anti").unionByName(moving))
    part = F.split("start", r"\|")
    found = reached.where("start like 'source|%'").select(
        "app_id", part[1].alias("source_method"), part[2].cast("int").alias("source_pos"), part[3].alias("source_label"), "sink_method", "sink_pos", "sink_label", "chain", "mask"
    )
    return found.groupBy("app_id", "source_method", "source_pos", "source_label", "sink_method", "sink_pos", "sink_label").agg(F.bit_and("mask").alias("mask"), F.min("chain").alias("chain"))


def ways(known: DataFrame, ends: DataFrame) -> DataFrame:
    """(end, step, slot, path, since): the shortest way of each fact of ends (app_id, method, start, slot, path, since,
    end), one row a step from the start, which is step 0.

    Pointers to the fact before are doubled, so a way of n steps takes log n joins; no array grows with it.
    """
    name = lambda f: F.struct("app_id", "method", "start", *(F.col(f"{f}{c}").alias(c) for c in ("slot", "path", "since")))
    back = keep(known.where("from is not null").select(name("").alias("fact"), name("from.").alias("before")))
    jumps = [back]
    longest = known.agg(F.max("round")).first()[0] or 0
    while 2 ** len(jumps) <= longest:
        last = jumps[-1]
        jumps.append(keep(last.join(last.select(F.col("fact").alias("before"), F.col("before").alias("then")), "before").select("fact", F.col("then").alias("before"))))
    found = keep(ends.select("end", name("").alias("fact"), F.lit(0).alias("back")))
    for k in range(len(jumps) - 1, -1, -1):
        more = found.join(jumps[k], "fact").select("end", F.col("before").alias("fact"), (F.col("back") + 2**k).alias("back"))
        found = keep(found.unionByName(more).distinct())
    length = F.max("back").over(Window.partitionBy("end"))
    return found.withColumn("step", length - F.col("back")).select("end", "step", "fact.slot", "fact.path", "fact.since")


def shortest_ways(known: DataFrame, sinks: DataFrame) -> DataFrame:
    """(method, source_pos, source_label, sink_pos, sink_label, step, slot, path, since): for each source and sink of a
    method one shortest way between them, a row a step; known has the facts, sinks (app_id, method, pos, slot, label)."""
    at = sinks.select("app_id", "method", "slot", F.col("pos").alias("sink_pos"), F.col("label").alias("sink_label"))
    met = known.where("start like 'source|%'").join(at, ["app_id", "method", "slot"]).where("sink_pos > since")
    end = F.struct("app_id", "method", "start", "sink_pos", "sink_label")
    first = met.groupBy(end.alias("end")).agg(F.min(F.struct("round", "slot", "path", "since")).alias("f"))
    ends = keep(first.select("end", "end.app_id", "end.method", "end.start", "f.slot", "f.path", "f.since"))
    part = F.split("end.start", r"\|")
    return ways(known, ends).select(
        "end.method", part[2].cast("int").alias("source_pos"), part[3].alias("source_label"), "end.sink_pos", "end.sink_label", F.col("step").cast("int"), "slot", "path", "since"
    )


def _ways_of(app: int, methods: dict[str, _Method]) -> Iterator[tuple]:
    """The rows of shortest_ways() of each method, with app_id."""
    for name, m in methods.items():
        if not m.seeds or not m.sinks:
            continue
        facts_ = {((pos, label), slot, "", pos): [0, 0, None] for pos, slot, label in m.seeds}
        _reached(facts_, m.steps)
        ends: dict[tuple, tuple] = {}
        for (start, slot, path, since), (_, n, _) in facts_.items():
            for pos, label in m.sinks.get(slot, ()):
                if pos > since:
                    key, now = (start, pos, label), (n, slot, path, since)
                    ends[key] = min(ends.get(key, now), now)
        for (start, pos, label), (_, *fact) in ends.items():
            way = [tuple(fact)]
            while (before := facts_[start, *way[-1]][2]) is not None:
                way.append(before)
            yield from ((app, name, *start, pos, label, step, *fact) for step, fact in enumerate(reversed(way)))


def ways_within(code: DataFrame) -> DataFrame:
    """The rows of shortest_ways() over the facts that code has without calls. A way is as short as its method, so it is read
    off where the method is closed, and no table of facts or of pointers is kept."""
    found = _mapped(acts(code, calls=False), _ways_of, "app_id long, method string, source_pos int, source_label string, sink_pos int, sink_label string, step int, slot string, path string, since int")
    return found.drop("app_id")
