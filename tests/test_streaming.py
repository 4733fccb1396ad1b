from tessera.streaming import queries as Q


def test_stream_matches_table(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [(i, f"2024-01-01 00:{i % 30:02d}:00", "ab"[i % 2], float(i)) for i in range(60)]
    spark.createDataFrame(rows, "id long, ts string, kind string, value double").selectExpr("id", "CAST(ts AS TIMESTAMP) AS ts", "kind", "value").write.parquet(path)
    stream = Q.read_stream(spark, path)
    q = Q.find(stream, {"filter": {"value": {"$gte": 30}}, "controls": {"$select": ["id", "kind"]}}).writeStream.format("memory").queryName("tessera_found").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tessera_found").count() == 30
    grouped = Q.aggregate(stream, {"controls": {"$groupBy": ["kind"], "$select": ["kind", {"$fn": "sum", "$field": "value", "$as": "total"}]}}, time="ts", window="10 minutes")
    q = grouped.writeStream.outputMode("complete").format("memory").queryName("tessera_grouped").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("tessera_grouped")
    assert got.count() == 6 and got.agg({"total": "sum"}).first()[0] == sum(range(60))
