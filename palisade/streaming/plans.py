"""Row-wise plans as streaming queries.

Operators that look at a row at a time (filters, projections, masks, grids, joins with static tables) lower to the same columns on a
streaming scan.  Sorts, limits, aggregates and guards need a whole table and are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.lower import Bindings, NotExecutable, lower
from ..plans import nodes
from ..plans.validate import ValidatedPlan

_WHOLE_TABLE = (nodes.Sort, nodes.Limit, nodes.Aggregate, nodes.MinGroupSize, nodes.SpatialJoin)


def lower_stream(plan: ValidatedPlan, bindings: Bindings) -> DataFrame:
    """The streaming DataFrame of a plan whose bound tables stream; a left join must have the stream on its left."""
    if other := sorted({o.operator_type for o in plan.operators if isinstance(o, _WHOLE_TABLE)}):
        raise NotExecutable(f"a stream has no {', '.join(other)}")
    return lower(plan, bindings)


def append_to(df: DataFrame, path: str, checkpoint: str, interval: str = "10 seconds"):
    """Start writing a streaming result to Parquet, each row once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=interval).start()


def drain_to(df: DataFrame, path: str, checkpoint: str) -> None:
    """Write what is there now and stop."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
