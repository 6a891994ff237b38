"""Plans as DataFrames: lowering, distance joins, lineage, pipeline families."""
