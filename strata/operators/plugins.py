"""Detectors that users add: functions from a frame of instructions to one of findings, or row by row a method."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINDING = "method long, rule_id string, severity string, evidence string"


class Registry:
    """Named detectors. A frame detector gets all instructions and stays in Spark; a method detector gets the
    rows of one method at a time as pandas, whose size the platform bounds; a batch detector those of many whole methods
    in the order of method and pos, for work by column."""

    def __init__(self) -> None:
        self.frames: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.batches: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}
        self.methods: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}

    def frame(self, f: Callable) -> Callable:
        self.frames[f.__name__] = f
        return f

    def batch(self, f: Callable) -> Callable:
        self.batches[f.__name__] = f
        return f

    def method(self, f: Callable) -> Callable:
        self.methods[f.__name__] = f
        return f


def whole_methods(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in the order of method, cut anew so that no method is in two batches; a null is a method, too."""
    rest: list[pd.DataFrame] = []
    for rows in batches:
        if not len(rows):
            continue
        method = rows["method"]
        last = method.isna() if pd.isna(method.iloc[-1]) else method == method.iloc[-1]
        whole = rows[~last]
        before = rest[0]["method"].iloc[0] if rest else None
        ended = bool(rest) and not (method.iloc[0] == before or (pd.isna(method.iloc[0]) and pd.isna(before)))
        if ended or len(whole):
            yield pd.concat([*rest, whole], ignore_index=True)
            rest = []
        rest.append(rows[last])
    if rest:
        yield pd.concat(rest, ignore_index=True)


def _finding(rows: pd.DataFrame) -> pd.DataFrame:
    """rows with strings as objects whatever type pandas gives them."""
    return rows.astype({"rule_id": object, "severity": object, "evidence": object})


def _run_all(batches: tuple, methods: tuple) -> Callable:
    def of(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in whole_methods(rows):
            for f in batches:
                yield _finding(f(whole))
            for f in methods:
                yield from (_finding(f(one.reset_index(drop=True))) for _, one in whole.groupby("method", sort=False, dropna=False))

    return of


def run(registry: Registry, code: DataFrame) -> DataFrame:
    """The findings of every detector of the registry, duplicates kept."""
    found = [f(code) for f in registry.frames.values()]
    if registry.batches or registry.methods:
        dealt = code.repartition("method").sortWithinPartitions("method", "pos")
        found.append(dealt.mapInPandas(_run_all(tuple(registry.batches.values()), tuple(registry.methods.values())), FINDING))
    return reduce(DataFrame.unionByName, found) if found else code.sparkSession.createDataFrame([], FINDING)


def example_registry() -> Registry:
    """Two small detectors, one of frames and one of batches."""
    registry = Registry()

    @registry.frame
    def large_constants(code: DataFrame) -> DataFrame:
        rows = code.where("op = 3 and num >= 48")
        return rows.select("method", F.lit("PLUGIN_LARGE_CONSTANT").alias("rule_id"), F.lit("LOW").alias("severity"), F.concat(F.lit("constant "), F.col("num").cast("string")).alias("evidence"))

    @registry.batch
    def source_then_sink(rows: pd.DataFrame) -> pd.DataFrame:
        method, op = rows["method"], rows["op"]
        same = (method == method.shift(-1)) | (method.isna() & method.shift(-1, fill_value=0).isna())
        place = rows.groupby("method", sort=False, dropna=False).cumcount()
        near = (op == 0) & (op.shift(-1) == 1) & same
        return pd.DataFrame({"method": method[near], "rule_id": "PLUGIN_ADJACENT", "severity": "MEDIUM", "evidence": "at " + place[near].astype(str)})

    return registry
