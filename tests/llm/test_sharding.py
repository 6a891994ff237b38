from collections import Counter

import pytest

from palisade.llm import common
from palisade.llm import sharding as S


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_round_trip_and_tiers(spark):
    data = [(i, f"text {i} " * (i % 50), None if i % 7 else "x", i) for i in range(3000)] + [(None, None, None, None), (5, "same", "x", 1), (5, "same", "x", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, path string, bytes int").repartition(4)
    root = common.shared_path(spark, "table")
    table = S.ShardedTable(spark, root, target=60_000, fan_in=3)
    for i in range(3):
        table.append(df.where(f"pmod(xxhash64(doc_id), 3) = {i}"), 100)
    before = table.manifest()
    assert len(before.shards) > 20 and table.versions() == [1, 2, 3]
    after = table.compact()
    assert len(after.shards) < len(before.shards) / 3
    assert max(s.bytes for s in after.shards) < 2 * table.target
    assert rows(table.read()) == rows(table.read(3)) == rows(df)
    assert table.vacuum() == 0 and table.versions() == [4]  # too young to be no other writer's
    assert table.vacuum(age_s=0) == len(before.shards) - len({s.path for s in before.shards} & {s.path for s in after.shards})
    assert rows(table.read()) == rows(df) and table.versions() == [4]
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != "60000"


def test_only_like_sizes_are_merged(spark):
    table = S.ShardedTable(spark, "file:/none", target=1000, fan_in=2, ratio=4)
    m = S.Manifest(1, "", (S.Shard("a", 900), S.Shard("b", 800), S.Shard("c", 10), S.Shard("d", 11), S.Shard("e", 300)))
    assert [[s.path for s in run] for run in table.due(m)] == [["c", "d"]]


def test_one_of_two_writers_wins(spark):
    root = common.shared_path(spark, "table")
    table = S.ShardedTable(spark, root)
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    first = table.append(df)
    with pytest.raises(S.VersionTaken):
        table._commit(S.Manifest(1, first.schema, ()))
    assert rows(table.read()) == rows(df)
    with pytest.raises(ValueError):
        table.append(df.withColumnRenamed("text", "other"))


def racing(table, method, other):
    """``table`` whose ``method`` is followed by ``other()`` once, so that another writer commits in between."""
    own = getattr(table, method)

    def run(*args, **kw):
        out = own(*args, **kw)
        setattr(table, method, own)
        other()
        return out

    setattr(table, method, run)
    return table


def test_a_slower_writer_commits_on_top(spark):
    root = common.shared_path(spark, "table")
    one, two = (spark.createDataFrame([(i, "a" * i)], "doc_id long, text string") for i in (1, 2))
    S.ShardedTable(spark, root).append(one)
    table = racing(S.ShardedTable(spark, root), "manifest", lambda: S.ShardedTable(spark, root).append(two))
    assert table.append(one).version == 3
    assert rows(table.read()) == rows(one.union(two).union(one))


def test_a_merge_of_gone_shards_is_dropped(spark):
    root = common.shared_path(spark, "table")
    df = spark.range(50).selectExpr("id doc_id", "repeat('x', 20) text").repartition(4)
    S.ShardedTable(spark, root, fan_in=2).append(df)
    table = racing(S.ShardedTable(spark, root, fan_in=2), "_write", lambda: S.ShardedTable(spark, root, fan_in=2).compact())
    done = table.compact()
    assert done.version == 2 and rows(table.read()) == rows(df)
    stray = {f"data/{d}/{n}" for d, _ in table._names("data") for n, _ in table._names(f"data/{d}") if n.endswith(".parquet")}
    assert stray == {s.path for v in (1, 2) for s in table.manifest(v).shards}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert S.digest(df, common.shared_path(spark, "table")).collect() == []
