from pyspark.sql import functions as F

from tidewright.operators import duration, series
from tidewright.sources import grids
from tidewright.streaming import daily


def test_days_of_a_stream_match_the_batch(spark, tmp_path):
    cells, levels = grids.synthetic(spark, 4, 6, 3)
    stamped = levels.select("gauge", F.timestamp_seconds(F.col("rec").cast("long") * 360).alias("t"), "level")
    stamped.repartitionByRange(3, "t").sortWithinPartitions("t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(stamped.schema).parquet(str(tmp_path / "in"))
    windows, thresholds = {"b": (-1.5, 0.0)}, [0.5]
    query = daily.run_daily(stream, cells, windows, thresholds, 6, daily.to_parquet(str(tmp_path / "out")), str(tmp_path / "ckpt"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    steps = duration.lit_steps(series.resample(levels, 6, 6), 6)
    want = duration.minutes(duration.usable(cells), steps, windows, thresholds, 6, by_day=True, plan="naive")
    days = {r["day_start"].day - 1 for r in got.select("day_start").distinct().collect()}
    assert days >= {0, 1}
    seen = {(r["cell_id"], r["day_start"].day - 1): (r["win_b"], r["ref_0p50"]) for r in got.collect()}
    for r in want.filter("day < 2").collect():
        assert seen[r["cell_id"], r["day"]] == (r["win_b"], r["ref_0p50"])


def test_held_keeps_the_last_level(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, None if i in (0, 2, 3) else float(i)) for i in range(6)], "gauge int, s long, level double")
    rows.select("gauge", F.timestamp_seconds("s").alias("t"), "level").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("gauge int, t timestamp, level double").parquet(str(tmp_path / "in"))
    query = daily.held(stream).writeStream.format("memory").queryName("held").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    assert [r["level"] for r in spark.table("held").orderBy("t").collect()] == [None, 1.0, 1.0, 1.0, 4.0, 5.0]
