import datetime

from pyspark.sql import functions as F

from scenelake.operators.workers import latest_heartbeat
from scenelake.plans.tables import AS_OF, open_catalog
from scenelake.streaming.heartbeat import heartbeat_table, liveness_stream
from scenelake.streaming.sync import scan_stream, sync_stream

SF = "/root/testdata/sf0.001"
BEAT = "event_id bigint, worker_id string, hostname string, last_seen_at timestamp, state string, stats map<string,string>"


def _beats(spark, rows):
    def at(second):
        return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)

    return spark.createDataFrame([(i, w, "h", at(s), state, None) for i, w, s, state in rows], BEAT)


def test_heartbeat_stream_equals_batch(spark, tmp_path):
    batches = [[(1, "a", 0, "idle"), (2, "b", 5, "idle")], [(3, "a", 9, "processing"), (4, "b", 1, "paused")]]
    source, table = str(tmp_path / "in"), {}

    def upsert(df, _):
        table.update({r["worker_id"]: r["state"] for r in df.collect()})

    for rows in batches:
        _beats(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(BEAT).parquet(source)
        (heartbeat_table(stream).writeStream.outputMode("update").foreachBatch(upsert)
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination())
    batch = latest_heartbeat(spark.read.schema(BEAT).parquet(source)).collect()
    assert table == {r["worker_id"]: r["state"] for r in batch} == {"a": "processing", "b": "idle"}


def test_silence_is_reported(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []

    def collect(df, _):
        seen.extend((r["worker_id"], r["status"]) for r in df.collect())

    for rows in ([(1, "a", 0, "idle"), (2, "b", 0, "idle")], [(3, "b", 200, "idle")], [(4, "b", 230, "idle")], [(5, "a", 240, "idle")]):
        _beats(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(BEAT).parquet(source)
        (liveness_stream(stream).writeStream.outputMode("update").foreachBatch(collect)
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination())
    assert seen.count(("a", "active")) == 2 and seen.count(("a", "stale")) == 1
    assert seen.index(("a", "stale")) > seen.index(("a", "active"))


def test_sync_stream_writes_each_document_once(spark, tmp_path):
    c = open_catalog(spark, SF)
    live = c.asset
    source, out, posted = (str(tmp_path / n) for n in ("in", "docs", "postings"))
    # One library has no policy yet.
    policies = [c.policy.where("library_slug <> 'src2'")]
    for part in (live.where("id % 3 = 0"), live.where("id % 3 <> 0")):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(live.schema).parquet(source)
        sync_stream(
            stream, lambda: c.scene, lambda: c.library, lambda: policies[-1], policies.append, out, posted,
            str(tmp_path / "ck"), AS_OF,
        ).awaitTermination()
    known = {r[0] for r in c.library.where("deleted_at is null").select("slug").collect()}
    done = [r for r in c.asset.where("status = 'completed'").collect() if r["library_id"] in known]
    scenes = {}
    for r in c.scene.select("id", "asset_id").collect():
        scenes.setdefault(r["asset_id"], []).append(f"scene_{r['id']}")
    closed = {r["library_slug"] for r in c.policy.where("active_index_name is null").collect()}
    wanted = sorted(
        name for r in done if r["library_id"] not in closed or r["library_id"] == "src2"
        for name in ([f"asset_{r['id']}"] if r["type"] == "image" else scenes.get(r["id"], []))
    )
    got = spark.read.parquet(out)
    assert sorted(r["id"] for r in got.select("id").collect()) == wanted
    assert got.where("library_slug = 'src2'").select("index_name").distinct().count() == 1
    words = spark.read.parquet(posted).groupBy("id").agg(F.sum("tf").alias("n"))
    assert words.join(got.select("id", "n_words"), "id").where("n <> n_words").isEmpty()
    assert got.where("n_words > 0").join(words, "id", "left_anti").isEmpty()


def test_scan_stream(spark, tmp_path):
    c = open_catalog(spark, SF)
    state = {"asset": c.asset}
    changes = []

    def publish(asset, diff, batch_id):
        target = str(tmp_path / f"asset-{batch_id}")
        asset.write.parquet(target)
        changes.append({r["change"]: r["count"] for r in diff.groupBy("change").count().collect()})
        state["asset"] = spark.read.schema(asset.schema).parquet(target)

    source = str(tmp_path / "in")
    c.source_file.coalesce(1).write.parquet(source)
    schema = c.source_file.schema
    scan_stream(spark.readStream.schema(schema).parquet(source), lambda: state["asset"], publish, str(tmp_path / "ck")).awaitTermination()
    c.source_file.coalesce(1).write.mode("append").parquet(source)
    scan_stream(spark.readStream.schema(schema).parquet(source), lambda: state["asset"], publish, str(tmp_path / "ck")).awaitTermination()
    assert changes[0]["new"] > 0 and set(changes[1]) == {"unchanged"}
