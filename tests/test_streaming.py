import datetime

from trialweave.operators.upsert import VersionedTable
from trialweave.streaming import registry


def test_upsert_stream_and_changes(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [("a", "h1", day, 1), ("a", "h1", day, 1), ("b", "h2", day, 2)]
    schema = "nct_id string, source_hash string, ts timestamp, v int"
    src = f"{tmp_path}/in"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    run = lambda: registry.upsert_stream(registry.new_versions(registry.read_studies(spark, src, schema, "parquet")), table, f"{tmp_path}/cp").awaitTermination()
    run()
    spark.createDataFrame([("a", "h3", day + datetime.timedelta(days=1), 9)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted((r.nct_id, r.source_hash) for r in table.read().collect()) == [("a", "h3"), ("b", "h2")]

    from trialweave.shipping import ship

    ship(spark)
    q = registry.changes(registry.read_studies(spark, src, schema, "parquet")).writeStream.format("memory").queryName("changes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(r["change"] for r in spark.table("changes").collect())
    assert got == ["changed", "new", "new", "unchanged"]
