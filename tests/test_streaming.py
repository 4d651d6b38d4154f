"""The stream gives what the batch filters give."""

from flocktrace import schemas, streaming


def test_contacts_per_window(spark, tmp_path):
    rows = [(0, 1, 2, -80), (10, 2, 3, -70), (299, 1, 3, -95), (300, 1, 2, -60), (5000, 1, -1, 0), (90000, 4, 5, -60)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, schemas.SCANS).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schemas.SCANS).parquet(source)
    q = streaming.contacts_per_window(stream).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", out).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("windows").collect())
    assert got == [(0, 2, 2), (1, 1, 1), (300, 1, 1)]
