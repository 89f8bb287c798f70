import random
from math import inf, nan

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from pyspark.sql import Window
from pyspark.sql import functions as F
from quillspark.operators import dense


def plan(df):
    return df._jdf.queryExecution().toString()


def test_batch_makes_no_row_of_a_pair(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(600)], "vec_id long, embedding array<double>")
    text = plan(dense.nearest_blocks(rows, rows.filter("vec_id % 2 = 0"), 3)).split("== Physical Plan ==")[1]
    assert "Join" not in text and "Union" not in text and "CartesianProduct" not in text
    assert text.count("MapInArrow") == 1


def test_batch_of_odd_vectors_as_its_sql(spark, tmp_path):
    rng = random.Random(5)
    rows = [[rng.choice((-1.0, 0.0, 0.5, 1.0)) for _ in range(3)] for _ in range(300)] + [[0.5, 0.25, 1.0]] * 60
    for i, odd in {0: None, 20: [], 40: [1.0], 60: [None, 1.0, 0.5], 80: [nan, 0.0, 0.0], 100: [inf, 0.0, 1.0], 120: [1.0, 0.0, 0.0, 3.0], 1: None, 3: [0.5, None, 1.0], 5: [0.5], 7: [nan, 1.0, 1.0], 9: [1e30, -1e30, 0.0], 11: [None, None, None]}.items():
        rows[i] = odd
    ids = list(range(len(rows)))
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0] * len(ids), pa.int32())}), tmp_path / "embeddings.parquet")
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet'")
        want = con.sql(entry.oracle_sql()["knn_batch"]).fetchall()
    got = entry.queries()["knn_batch"](spark, str(tmp_path)).select("query_id", "vec_id", "place", "distance").collect()
    assert len(want) == 5 * len(ids[::20]) and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_blocks_batches_and_copies_agree_with_the_plain_way(spark):
    rng = random.Random(8)
    kinds = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(150)]
    rows = spark.createDataFrame([(f"v{i % 997:04}", kinds[i % 7 if i % 3 else i % 150]) for i in range(3000)], "vec_id string, embedding array<float>").cache()
    asked = rows.limit(90)
    pairs = rows.crossJoin(F.broadcast(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))).select("query_id", "vec_id", dense.squared_distance(F.col("embedding"), F.col("q")).alias("distance"))
    want = pairs.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).filter("place <= 4").orderBy("query_id", "place").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        for block in (7, 1000):
            assert dense.nearest_blocks(rows, asked, 4, block=block).orderBy("query_id", "place").collect() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
