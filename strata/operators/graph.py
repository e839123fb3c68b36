"""Graph operators over edge tables: reachability, paths, closures, components, dispatch, entry points.

Call graphs have cycles, so each is a semi-naive loop: only what the last round found is joined with the
edges, what is known is anti-joined away, and every round is kept so that plans stay short. Rounds are
bounded by the longest shortest path, rows by nodes (or pairs) reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.catalogues import android
from strata.plans.keep import keep


#: Steps of a loop that are planned together, where what they reach is small beside a round's own cost.
STEPS = 3


def reachable(seeds: DataFrame, edges: DataFrame, keys: tuple = ()) -> DataFrame:
    """(keys.., node, level) for all that seeds (keys.., node) reach by edges (keys.., src, dst), seeds at level 0.

    keys, such as app_id, stand on both sides; level is the fewest edges from any seed.
    """
    steps = keep(edges.select(*keys, "src", "dst").where("src is not null and dst is not null").distinct())
    frontier = keep(seeds.select(*keys, "node").where("node is not null").distinct().withColumn("level", F.lit(0)))
    found = frontier
    while not frontier.isEmpty():
        ahead, new = frontier, None
        for _ in range(STEPS):
            onward = ahead.select(*keys, F.col("node").alias("src"), "level").join(steps, [*keys, "src"])
            ahead = onward.groupBy(*keys, F.col("dst").alias("node")).agg((F.min("level") + 1).alias("level"))
            new = ahead if new is None else new.unionByName(ahead)
        least = new.groupBy(*keys, "node").agg(F.min("level").alias("level"))
        frontier = keep(least.join(found.select(*keys, "node"), [*keys, "node"], "left_anti"))
        found = found.unionByName(frontier)
    return found


def descendants(roots: DataFrame, edges: DataFrame, keys: tuple = ()) -> DataFrame:
    """(keys.., root, node, level): everything each root (keys.., node) reaches, itself at level 0."""
    pairs = roots.select(*keys, F.col("node").alias("root"), "node").where("node is not null").distinct()
    steps = edges.select(*keys, "src", "dst").where("src is not null and dst is not null").distinct()
    steps, frontier = keep(steps), keep(pairs.withColumn("level", F.lit(0)))
    found, level = frontier, 0
    while not frontier.isEmpty():
        level += 1
        ahead = frontier.select(*keys, "root", F.col("node").alias("src")).join(steps, [*keys, "src"]).select(*keys, "root", F.col("dst").alias("node")).distinct()
        frontier = keep(ahead.join(found.select(*keys, "root", "node"), [*keys, "root", "node"], "left_anti").withColumn("level", F.lit(level)))
        found = found.unionByName(frontier)
    return found


def shortest_paths(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, path): a shortest path from a seed to each node; of equals the least as an array."""
    steps = keep(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    frontier = keep(seeds.select("node").distinct().select("node", F.lit(0).alias("level"), F.array("node").alias("path")))
    found, level = frontier, 0
    while not frontier.isEmpty():
        level += 1
        ahead = frontier.select(F.col("node").alias("src"), "path").join(steps, "src").groupBy(F.col("dst").alias("node")).agg(F.min("path").alias("path"))
        new = ahead.join(found.select("node"), "node", "left_anti")
        frontier = keep(new.select("node", F.lit(level).alias("level"), F.concat("path", F.array("node")).alias("path")))
        found = found.unionByName(frontier)
    return found


def roots(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node): nodes that no edge ends in, of nodes or of the edges' ends; an edge to itself counts."""
    all_ = nodes.select("node") if nodes is not None else edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return all_.distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of strongly connected components of two nodes or more, named by their largest node.

    By colours: every node takes the largest node that reaches it; what reaches a colour's own node
    backwards within the colour is its component and leaves the graph.
    """
    left = keep(edges.select("src", "dst").where("src <> dst").distinct())
    out = None
    while True:
        while True:  # nodes without an edge in or out are components of their own
            trimmed = left
            for _ in range(STEPS):
                trimmed = trimmed.join(trimmed.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
                trimmed = trimmed.join(trimmed.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            trimmed, before = keep(trimmed), left.count()
            left = trimmed
            if trimmed.count() == before:
                break
        if left.isEmpty():
            break
        colour = keep(left.select(F.col("src").alias("n")).distinct().withColumn("colour", F.col("n")))
        moving = colour
        while not moving.isEmpty():
            ahead = moving
            for _ in range(STEPS):
                onward = ahead.join(left, F.col("n") == F.col("src")).select(F.col("dst").alias("n"), "colour")
                ahead = ahead.unionByName(onward).groupBy("n").agg(F.max("colour").alias("colour"))
            better = ahead.select(F.col("n").alias("m"), F.col("colour").alias("better"))
            moving = keep(better.join(colour, F.col("m") == F.col("n")).where("better > colour").select("n", F.col("better").alias("colour")))
            colour = keep(colour.unionByName(moving).groupBy("n").agg(F.max("colour").alias("colour")))
        of = lambda side: colour.select(F.col("n").alias(side), F.col("colour").alias("c"))
        same = left.join(of("src"), "src").join(of("dst"), ["dst", "c"]).select("c", F.col("dst").alias("src"), F.col("src").alias("dst"))
        core = colour.where("n = colour").select(F.col("colour").alias("c"), F.col("n").alias("node"))
        members = keep(reachable(core, same, ("c",)).select(F.col("node"), F.col("c").alias("component")))
        out = members if out is None else out.unionByName(members)
        gone = members.select("node")
        left = keep(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    if out is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    several = out.groupBy("component").count().where("count > 1").select("component")
    return out.join(several, "component", "left_semi").select("node", "component")


def starts_with_any(column: Column, prefixes: tuple) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | column.startswith(p)
    return out


def call_edges(calls: DataFrame) -> DataFrame:
    """(app_id, caller, callee, offset): one edge a pair, the last call site, of calls (.., caller_class, callee_class).

    Infrastructure classes call nothing of interest; framework classes keep calls into other code alone; app
    classes keep all their calls.
    """
    caller, callee = F.col("caller_class"), F.col("callee_class")
    infra = starts_with_any(caller, android.INFRA_PREFIXES + android.KOTLIN_INFRA_PREFIXES)
    frame = lambda c: starts_with_any(c, android.INFRA_PREFIXES + android.KOTLIN_INFRA_PREFIXES + android.FRAMEWORK_BULK_PREFIXES)
    kept = calls.where(~infra & (~frame(caller) | ~frame(callee)))
    return kept.groupBy("app_id", "caller", "callee").agg(F.max("offset").alias("offset"))


def class_edges(classes: DataFrame) -> DataFrame:
    """(app_id, src, dst, kind): from a superclass or interface to each class; a missing superclass is Object."""
    up = classes.select("app_id", F.coalesce("super_name", F.lit("Ljava/lang/Object;")).alias("src"), F.col("class_name").alias("dst"), F.lit("super").alias("kind"))
    face = classes.select("app_id", F.explode("interfaces").alias("src"), F.col("class_name").alias("dst"), F.lit("interface").alias("kind"))
    return up.where("src <> dst").unionByName(face)


def entry_points(methods: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(app_id, method_id): lifecycle methods of component subclasses and of classes with a callback
    interface, and lifecycle-named methods that nothing calls."""
    named = methods.where(F.col("method_name").isin(*android.LIFECYCLE_METHODS))
    up = class_edges(classes)
    tops = up.select("app_id", F.col("src").alias("node")).where(F.col("src").isin(*android.COMPONENT_BASES))
    components = reachable(tops, up.select("app_id", "src", "dst"), ("app_id",)).select("app_id", F.col("node").alias("class_name"))
    faces = up.where((F.col("kind") == "interface") & F.col("src").isin(*android.CALLBACK_INTERFACES)).select("app_id", F.col("dst").alias("class_name"))
    called = edges.select("app_id", F.col("callee").alias("method_id"))
    own = named.join(components.unionByName(faces).distinct(), ["app_id", "class_name"], "left_semi")
    free = named.join(called, ["app_id", "method_id"], "left_anti")
    return own.unionByName(free).select("app_id", "method_id").distinct()


def dispatch(receivers: DataFrame, class_links: DataFrame, methods: DataFrame, cap: int = 4) -> DataFrame:
    """(receiver, method_name, target): classes below a receiver that define the method; the `cap` nearest, then least.

    receivers (receiver, method_name); class_links (src, dst) from a class to its subclasses and
    implementers; methods (class_name, method_name).
    """
    below = descendants(receivers.select(F.col("receiver").alias("node")), class_links).where("level > 0")
    hits = receivers.distinct().join(below, F.col("receiver") == F.col("root")).join(methods.select(F.col("class_name").alias("node"), "method_name").distinct(), ["node", "method_name"])
    order = Window.partitionBy("receiver", "method_name").orderBy("level", "node")
    return hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).select("receiver", "method_name", F.col("node").alias("target"))
