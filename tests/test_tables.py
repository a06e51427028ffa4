"""A table of few row groups is dealt to all cores."""

from pyspark.sql import functions as F

from codeq.sources import tables
from codeq.sources.tables import SHARE_ROWS, dealt


def test_all_rows_once_in_more_tasks(spark, tmp_path):
    rows = 4 * SHARE_ROWS + 3
    spark.range(rows).select("id", F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("text")) \
        .coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    out = dealt(one)
    assert out.columns == one.columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, one.collect()))
    busy = out.groupBy(F.spark_partition_id()).count().count()
    assert busy == min(4, spark.sparkContext.defaultParallelism)


def test_small_empty_and_many_files_stay(spark, tmp_path):
    for name, rows, parts in (("small", SHARE_ROWS, 1), ("empty", 0, 1),
                              ("many", 50 * SHARE_ROWS, spark.sparkContext.defaultParallelism)):
        spark.range(0, rows, 1, parts).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        assert dealt(df) is df


def test_large_row_groups_are_shared_out_whatever_the_cores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    for i in range(9):
        spark.range(3000 * i, 3000 * i + 3000, 1, 1).write.parquet(str(tmp_path / f"p/n={i}"))
    whole = spark.read.parquet(str(tmp_path / "p")).select("id")
    with_index = tables.dealt(spark.read.parquet(str(tmp_path / "p")))
    held = with_index.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert held <= 6 * 500 and with_index.select("id").exceptAll(whole).count() == 0
    assert with_index.count() == whole.count()
