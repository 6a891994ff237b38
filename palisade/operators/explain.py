"""What Spark does with a plan: a fingerprint of the physical plan, and the figures of its nodes after a run."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    """The physical plan before adaptive changes, without ids, paths and locations that differ from run to run."""
    text = df._jdf.queryExecution().sparkPlan().treeString()
    text = re.sub(r"#\d+L?|plan_id=\d+|\[id=#?\d+\]|@[0-9a-f]{4,}", "", text)
    return re.sub(r"(file|hdfs|viewfs|s3a?)://?[^\s,\]]+", "<path>", text)


def fingerprint(df: DataFrame) -> str:
    return "sha256:" + hashlib.sha256(plan_text(df).encode()).hexdigest()


@dataclass(frozen=True)
class Node:
    name: str
    metrics: dict[str, int]
    children: tuple[Node, ...] = field(default=())

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


def _node(plan) -> Node:
    name = plan.nodeName()
    inner = {"AdaptiveSparkPlan": "executedPlan", "ResultQueryStage": "plan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "TableCacheQueryStage": "plan"}.get(name)
    if inner:
        return _node(getattr(plan, inner)())
    metrics, it = {}, plan.metrics().iterator()
    while it.hasNext():
        pair = it.next()
        metrics[pair._1()] = int(pair._2().value())
    children = plan.children()
    return Node(name, metrics, tuple(_node(children.apply(i)) for i in range(children.size())))


def analyze(df: DataFrame) -> Node:
    """Run ``df`` to its end without keeping its rows; the executed plan with rows, bytes, times and spill of its nodes."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return _node(execution.executedPlan())
