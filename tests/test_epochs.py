import os

from pyspark.sql import functions as F

from tidewatch.sources.epochs import read_epochs, write_epochs
from tidewatch.streaming.run import stream_folder


def test_a_trigger_run_again_leaves_each_row_once(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    rows = spark.range(90).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), "id")).alias("a-name"))
    rows.repartition(3).write.parquet(source)
    stream = lambda: stream_folder(spark, source, rows.schema, 1)
    run = write_epochs(stream(), out, progress)
    run.awaitTermination()
    assert run.exception() is None
    first = read_epochs(spark, out, rows.schema)
    assert sorted(map(tuple, first.drop("epoch").collect())) == sorted(map(tuple, rows.collect()))
    assert first.select("epoch").distinct().count() == 3
    # Killed after the sink's list was written and before Spark noted the trigger as done.
    last = str(max(int(n) for n in os.listdir(f"{progress}/commits") if n.isdigit()))
    for name in (last, f".{last}.crc"):
        os.remove(f"{progress}/commits/{name}")
    files = sorted(os.listdir(f"{out}/rows"))
    run = write_epochs(stream(), out, progress)
    run.awaitTermination()
    assert run.exception() is None and os.path.exists(f"{progress}/commits/{last}")
    assert sorted(os.listdir(f"{out}/rows")) == files
    # A file of a task that never was part of a finished trigger is not read.
    spark.range(5).select("id", F.lit("x").alias("a-name")).coalesce(1).write.mode("append").parquet(f"{out}/rows")
    again = read_epochs(spark, out, rows.schema).drop("epoch")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))
