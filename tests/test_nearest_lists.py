import random

import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from pyspark.sql import Window
from pyspark.sql import functions as F
from quillspark.operators import dense


def test_lists_are_searched_without_a_row_of_a_pair(spark):
    rng = random.Random(2)
    # Most rows share one list, and many are copies.
    rows = [(k, [rng.gauss(9 * (k % 4 if k % 5 == 0 else 0), 1), rng.gauss(0, 1)] if k % 3 else [0.25, 0.5]) for k in range(1200)] + [(2000, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").cache()
    asked, centre = df.filter("vec_id % 20 = 0"), dense.centroids(df, lists=9)
    found = dense.nearest_listed(df, asked, 6, centre, probes=2)
    text = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Join" not in text and text.count("MapInArrow") == 1

    own = dense.listed(df, centre).select("vec_id", "embedding", F.col("lists")[0].alias("list"))
    probes = dense.listed(asked, centre, 2).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.explode("lists").alias("list"))
    pairs = own.join(probes, "list").select("query_id", "vec_id", dense.squared_distance(F.col("embedding"), F.col("q")).alias("distance"))
    want = pairs.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).filter("place <= 6")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        assert found.orderBy("query_id", "place").collect() == want.orderBy("query_id", "place").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_rows_miss_no_neighbour(spark, tmp_path):
    pq.write_table(pa.table({"vec_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    assert [tuple(r) for r in entry.queries()["knn_lists"](spark, str(tmp_path)).collect()] == [(0, True)]
