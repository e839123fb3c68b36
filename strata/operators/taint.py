"""Data flow from sources to sinks as a least fixpoint over tables.

What an instruction does to tainted values is a row of `steps`: within a method, a value in one slot (a
register, a field of one, a call's argument, a result) goes to another. Summaries of methods, from
parameters to results and to sinks, come from closing the steps once per method; calls are then composed from
summaries, which keeps a helper's clean and tainted callers apart. All tables are joined on app and method.
Values are never overwritten by clean ones: facts only grow, in the order of the code.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strata.catalogues import flows as labels
from strata.catalogues import taint as values
from strata.plans.keep import fixed, keep, small

KEYS = ["app_id", "method"]


def intra_method(code: DataFrame) -> DataFrame:
    """(method, pos, register): sinks that a source's value reaches through moves within a method.

    code (method, pos, op, dst, src): op source puts a tainted value into dst, sink reads src, and move copies
    src to dst; anything else leaves values as they are. A semi-naive loop over (method, register, since):
    the least position from which on a register is tainted, which only falls.
    """
    moves = keep(code.where("op = 'move' and dst <> src").select("method", F.col("pos").alias("at"), F.col("dst").alias("to"), F.col("src").alias("register")))
    state = keep(code.where("op = 'source'").groupBy("method", F.col("dst").alias("register")).agg(F.min("pos").alias("since")))
    moving = state
    while not moving.isEmpty():
        copied = moving.join(moves, ["method", "register"]).where("at > since").groupBy("method", F.col("to").alias("register")).agg(F.min("at").alias("since"))
        known = state.select("method", "register", F.col("since").alias("_since"))
        moving = keep(copied.join(known, ["method", "register"], "left").where("_since is null or since < _since").drop("_since"))
        state = keep(state.unionByName(moving).groupBy("method", "register").agg(F.min("since").alias("since")))
    sinks = code.where("op = 'sink'").select("method", "pos", F.col("src").alias("register"))
    return sinks.join(state, ["method", "register"]).where("pos > since").select("method", "pos", "register")


def sanitised_state(flows: DataFrame, covers: DataFrame) -> DataFrame:
    """flows (.., sanitizers array, sink_label) with `neutralisation`: full if one of the sanitizers applied
    covers the sink's label, partial if some were applied and none does, none without any. flow_id tells the
    rows of flows apart."""
    own = covers.groupBy("sanitizer").agg(F.collect_set("sink_label").alias("labels"))
    each = flows.withColumn("_n", F.col("flow_id"))
    hit = each.select("_n", "sink_label", F.explode("sanitizers").alias("sanitizer")).join(small(keep(own)), "sanitizer", "left")
    state = hit.groupBy("_n").agg(F.max(F.coalesce(F.array_contains("labels", F.col("sink_label")), F.lit(False))).alias("_full"))
    word = F.when(F.col("_full"), "full").when(F.col("_full").isNotNull(), "partial").otherwise("none")
    return each.join(state, "_n", "left").withColumn("neutralisation", word).drop("_n", "_full")


def _reached(steps: dict, starts: list) -> dict:
    """(start, slot) -> since, of one method: steps has (pos, write) by the slot read, starts (start, slot, since)."""
    held: dict = {}
    todo = []
    for start, slot, since in starts:
        if (start, slot) not in held or since < held[start, slot]:
            held[start, slot] = since
            todo.append((start, slot))
    while todo:
        start, slot = todo.pop()
        since = held[start, slot]
        for pos, write in steps.get(slot, ()):
            if pos is None or pos > since:
                at = since if pos is None else pos
                if (start, write) not in held or at < held[start, write]:
                    held[start, write] = at
                    todo.append((start, write))
    return held


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The methods of rows (app_id, method, start, slot, since, write) in their order, one at a time; write is null in
    those of starts."""
    schema, now, steps, starts, found = None, None, {}, [], []

    def end() -> None:
        if starts:
            found.extend((*now, start, slot, since) for (start, slot), since in _reached(steps, starts).items())

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    for b in batches:
        schema = pa.schema([b.schema.field(c) for c in ("app_id", "method", "start", "slot", "since")])
        for app, method, start, slot, since, write in zip(*(b.column(c).to_pylist() for c in ("app_id", "method", "start", "slot", "since", "write"))):
            if (app, method) != now:
                end()
                now, steps, starts = (app, method), {}, []
            if write is None:
                starts.append((start, slot, since))
            else:
                steps.setdefault(slot, []).append((since, write))
        if len(found) > 50_000:
            yield batch()
            found.clear()
    end()
    if found:
        yield batch()


def closed(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """(app_id, method, start, slot, since): slots that each start's value is in, from which position on.

    steps (app_id, method, pos, read, write): the value of slot `read` goes to `write` at pos, if it was there
    before. starts (app_id, method, start, slot, since). With loops, `loop` steps (pos null) hold anywhere. No step
    leaves a method, whose size the platform bounds, so methods are dealt and sorted by Spark once, and each is closed
    where it lies, until nothing changes. They are dealt by a hash of their own, see code.constants.
    """
    none = F.lit(None).cast("string")
    moves = steps.where("read is not null and write is not null").select(*KEYS, none.alias("start"), F.col("read").alias("slot"), F.col("pos").cast("long").alias("since"), "write")
    begun = starts.select(*KEYS, "start", "slot", F.col("since").cast("long").alias("since"), none.alias("write"))
    every = moves.unionByName(begun).where("app_id is not null and method is not null").repartition(F.xxhash64(*KEYS)).sortWithinPartitions(*KEYS)
    return every.mapInArrow(_closed, StructType([StructField(f.name, f.dataType) for f in every.schema if f.name != "write"]))


def inter_method(steps: DataFrame, calls: DataFrame, seeds: DataFrame, sinks: DataFrame, depth: int = 8) -> DataFrame:
    """(app_id, source, label, method, sink_method, sink_pos, sink_label, chain): the fewest calls between a
    source's method and each sink it reaches, at most depth.

    steps: see closed; a method's parameters are slots p0, p1, .., its result the slot `return`.
    calls (app_id, method, pos, callee, args array<slot>, result slot). seeds (app_id, method, pos, slot, label,
    source). sinks (app_id, method, pos, slot, label).
    """
    entry = calls.select("app_id", F.col("callee").alias("method"), F.posexplode("args").alias("i", "_a")).select(*KEYS, F.concat(F.lit("p"), "i").alias("slot")).distinct()
    args = keep(calls.select(*KEYS, "pos", "callee", "result", F.posexplode("args").alias("i", "slot")).withColumn("param", F.concat(F.lit("p"), "i")))
    own = entry.select(*KEYS, F.concat(F.lit("in:"), "slot").alias("start"), "slot", F.lit(-1).cast("long").alias("since"))
    from_sources = seeds.select(*KEYS, F.concat(F.lit("src:"), "source", F.lit("|"), "label").alias("start"), "slot", F.col("pos").cast("long").alias("since"))
    extra, flows = None, None
    for _ in range(depth):  # results of calls whose result depends on an argument are steps of the caller
        all_steps = steps if extra is None else steps.unionByName(extra)
        flows = keep(closed(all_steps, own.unionByName(from_sources)))
        returns = flows.where("slot = 'return' and start like 'in:%'").select("app_id", F.col("method").alias("callee"), F.expr("substring(start, 4)").alias("param")).distinct()
        made = keep(args.join(returns, ["app_id", "callee", "param"]).where("result is not null").select(*KEYS, F.col("pos").cast("long"), F.col("slot").alias("read"), F.col("result").alias("write")).distinct())
        tainted = flows.where("slot = 'return' and start like 'src:%'").select("app_id", F.col("method").alias("callee"), "start").distinct()
        more = calls.join(tainted, ["app_id", "callee"]).where("result is not null").select(*KEYS, "start", F.col("result").alias("slot"), F.col("pos").cast("long").alias("since"))
        seeds_now = keep(from_sources.unionByName(more).groupBy(*KEYS, "start", "slot").agg(F.min("since").alias("since")))
        if extra is not None and made.count() == extra.count() and seeds_now.count() == from_sources.count():
            break
        extra, from_sources = made, seeds_now
    hits = flows.join(sinks.select(*KEYS, "slot", F.col("pos").alias("sink_pos"), F.col("label").alias("sink_label")), [*KEYS, "slot"]).where("sink_pos > since")
    reach = keep(hits.select(*KEYS, "start", F.col("method").alias("sink_method"), "sink_pos", "sink_label", F.lit(0).alias("chain")).distinct())
    at_sink = moving = reach
    passed = keep(flows.join(args.select(*KEYS, "slot", "callee", "param", F.col("pos").alias("call_pos")), [*KEYS, "slot"]).where("call_pos > since").select(*KEYS, "start", "callee", F.concat(F.lit("in:"), "param").alias("callee_start")).distinct())
    for n in range(1, depth + 1):
        below = moving.select("app_id", F.col("method").alias("callee"), F.col("start").alias("callee_start"), "sink_method", "sink_pos", "sink_label")
        up = passed.join(below, ["app_id", "callee", "callee_start"]).select(*KEYS, "start", "sink_method", "sink_pos", "sink_label").distinct()
        keys = [*KEYS, "start", "sink_method", "sink_pos", "sink_label"]
        moving = keep(up.join(at_sink.select(*keys), keys, "left_anti").withColumn("chain", F.lit(n)))
        if moving.isEmpty():
            break
        at_sink = at_sink.unionByName(moving)
    found = at_sink.where("start like 'src:%'").withColumn("_s", F.split(F.expr("substring(start, 5)"), r"\|"))
    return found.select("app_id", F.col("_s")[0].alias("source"), F.col("_s")[1].alias("label"), "method", "sink_method", "sink_pos", "sink_label", "chain")


def native_effects(calls: DataFrame, natives: DataFrame | None = None) -> DataFrame:
    """calls (class_name, method_name, ..) with every summary that fits: the union of exact and wildcard ones."""
    schema = "class string, name string, propagates array<int>, returns array<string>, cleans array<struct<arg:int,label:string>>, sinks array<struct<arg:int,label:string>>"
    table = natives if natives is not None else fixed(calls.sparkSession, values.NATIVES, schema)
    ways = F.array(F.struct(F.col("class_name").alias("c"), F.col("method_name").alias("m")), F.struct(F.lit("*").alias("c"), F.col("method_name").alias("m")), F.struct(F.col("class_name").alias("c"), F.lit("*").alias("m")), F.struct(F.lit("*").alias("c"), F.lit("*").alias("m")))
    each = calls.withColumn("_w", F.explode(ways))
    return each.join(table, (F.col("_w.c") == F.col("class")) & (F.col("_w.m") == F.col("name"))).drop("_w", "class", "name")


def first_flows(flows: DataFrame) -> DataFrame:
    """One flow for each (app_id, rule_id, class_name, method_name, sink_pos): the shortest chain, then the least source."""
    order = Window.partitionBy("app_id", "rule_id", "class_name", "method_name", "sink_pos").orderBy("chain", "source")
    return flows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def relabelled(sink_label: Column, source_label: Column) -> Column:
    """PII_LOG and PII_NETWORK for personal data that is logged or sent."""
    personal = source_label.isin(*labels.PERSONAL)
    return F.when(personal & (sink_label == "LOG"), "PII_LOG").when(personal & (sink_label == "NETWORK_OUT"), "PII_NETWORK").otherwise(sink_label)


def classified(flows: DataFrame) -> DataFrame:
    """flows (source_label, sink_label, chain, ..) as findings: the sink label made personal where it is, then
    rule_id, severity, confidence, category and cwe_id by the labels and the length of the chain. Where there is a column
    neutralisation, a flow that is harmless has low confidence, and one that other sanitisers touched medium."""
    source, sink, chain = F.col("source_label"), F.col("sink_label"), F.col("chain")
    pair = lambda rows: F.struct(source, sink).isin([F.struct(F.lit(a), F.lit(b)) for a, b in rows])
    severity = F.lit("MEDIUM")
    for label, of, word in reversed(labels.SEVERITIES):
        severity = F.when((sink == label) & (source.isin(*of) if of else F.lit(True)), word).otherwise(severity)
    near = F.when(chain <= 3, "HIGH").when(chain <= 8, "MEDIUM").otherwise("LOW")
    confidence = F.when(source.isin(*labels.NOISY_SOURCES), "LOW").when(pair(labels.CERTAIN_PAIRS) & (chain <= 5), "HIGH").otherwise(near)
    if "neutralisation" in flows.columns:
        confidence = F.when(F.col("neutralisation") == "full", "LOW").when(F.col("neutralisation") == "partial", "MEDIUM").otherwise(confidence)
    cwe = F.when(sink.isin("PII_LOG", "PII_NETWORK"), "CWE-359").otherwise(
        F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for a, b, c in labels.WEAKNESSES for x in (f"{a}>{b}", c))), F.concat(source, F.lit(">"), sink)), F.lit("CWE-200"))
    )
    named = flows.withColumn("sink_label", relabelled(sink, source))
    return named.withColumns({
        "rule_id": F.concat(F.lit("TAINT_"), source, F.lit("_TO_"), sink), "severity": severity, "confidence": confidence, "cwe_id": cwe,
        "category": F.when(sink.isin("PII_LOG", "PII_NETWORK"), "PRIVACY").otherwise("TAINT"),
    })


def matched(calls: DataFrame) -> DataFrame:
    """calls (class_name, method_name, ..) with (role, label, param) of each source, sink and sanitizer that they
    are; a method of * fits all of a class. A sanitizer has no param."""
    spark = calls.sparkSession
    rows = [("source", c, m, label, p) for c, m, label, p in values.SOURCES] + [("sink", c, m, label, p) for c, m, label, p in values.SINKS]
    rows += [("sanitizer", c, m, label, None) for c, m, label, _ in values.SANITIZERS]
    table = fixed(spark, rows, "role string, _class string, _name string, label string, param int")
    fits = (F.col("class_name") == F.col("_class")) & F.col("_name").isin("*", F.col("method_name"))
    return calls.join(table, fits).drop("_class", "_name")


def access_steps(code: DataFrame) -> DataFrame:
    """Steps (app_id, method, pos, read, write), see closed, of instructions (app_id, method, pos, op, dst, src, obj, field).

    move copies src to dst; iput and iget go through a field of the object in obj; add and get go through a
    container, all of whose elements are one slot.
    """
    slot = lambda c: F.concat(F.lit("v"), F.col(c))
    field, element = F.concat(slot("obj"), F.lit("."), "field"), F.concat(slot("obj"), F.lit("[]"))
    op = F.col("op")
    read = F.when(op.isin("move", "iput", "add"), slot("src")).when(op == "iget", field).when(op == "get", element)
    write = F.when(op.isin("move", "iget", "get"), slot("dst")).when(op == "iput", field).when(op == "add", element)
    return code.select("app_id", "method", F.col("pos").cast("long").alias("pos"), read.alias("read"), write.alias("write")).where("read is not null and read <> write")


def static_fields(code: DataFrame) -> DataFrame:
    """(app_id, field): static fields that a source's value gets into, through any methods of the app.

    code (app_id, method, pos, op, dst, src, field): source, move, sput and sget. Reads of a static field come in no
    order with its writes, so a field, once tainted, is at all of its reads. Each method is closed once, from its
    sources and from every field that it reads; what that gives are ways between the fields of an app, which alone are
    followed in rounds.
    """
    steps = access_steps(code.withColumn("obj", F.lit(0))).unionByName(
        code.where("op = 'sput'").select("app_id", "method", F.col("pos").cast("long").alias("pos"), F.concat(F.lit("v"), "src").alias("read"), F.concat(F.lit("s:"), "field").alias("write"))
    )
    start = F.when(F.col("op") == "source", F.lit("t")).otherwise(F.concat(F.lit("s:"), "field"))
    starts = code.where("op = 'source' or (op = 'sget' and field is not null)").select(*KEYS, start.alias("start"), F.concat(F.lit("v"), "dst").alias("slot"), F.col("pos").cast("long").alias("since"))
    ways = keep(closed(steps, starts).where("slot like 's:%'").select("app_id", "start", F.expr("substring(slot, 3)").alias("field")).distinct())
    between = ways.where("start like 's:%'").select("app_id", F.expr("substring(start, 3)").alias("_from"), F.col("field").alias("_to"))
    found = new = keep(ways.where("start = 't'").select("app_id", "field"))
    while not new.isEmpty():
        next_ = new.join(between, (new["app_id"] == between["app_id"]) & (new["field"] == between["_from"])).select(new["app_id"], F.col("_to").alias("field")).distinct()
        new = keep(next_.join(found, ["app_id", "field"], "left_anti"))
        found = keep(found.unionByName(new))
    return found
