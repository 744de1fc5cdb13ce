import json

import pytest
from pyspark.sql import functions as F

from siftstone.operators import datasets
from siftstone.sources import documents, records, stores, vectors
from siftstone.streaming import jobs


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_documents_from_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \xff ok")
    (tmp_path / "sub/B.MD").write_text("# Title")
    (tmp_path / "blank.txt").write_text(" \n")
    (tmp_path / "c.pdf").write_bytes(b"one|two||")
    (tmp_path / "d.csv").write_text("x")
    path = f"file://{tmp_path}"
    assert documents.listed(spark, path).count() == 4
    assert rows(documents.loaded(spark, path), "title", "text") == [("B", "# Title"), ("a", "café  ok")]
    pages = documents.loaded(spark, path, pdf=lambda b: b.decode().split("|")).where("page_number IS NOT NULL")
    assert rows(pages, "title", "text", "page_number", "page_count") == [("c", "one", 1, 4), ("c", "two", 2, 4)]
    assert all("#page-" in r.object_name for r in pages.collect())
    page, total, more = documents.page_of_list(documents.listed(spark, path), 1, 2)
    assert (page.count(), total, more) == (2, 4, True)
    assert spark.range(1).select(documents.content_type(F.lit("x/y.MD"))).first()[0] == "text/markdown"


def test_json_records(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"id": "a", "n": 1}\n\n{"id": "a", "n": 2}\nbroken\n')
    assert rows(records.lenient(spark, str(good), "id string, n int", "id", "n"), "id", "n") == [("a", 2)]
    with pytest.raises(Exception, match=r"(?i)malformed|FAILED_READ"):
        records.strict(spark, str(good), "id string, n int").collect()
    said = spark.createDataFrame([('Sure! ```json\n{"a": {"b": "}"}} and {"c": 1}```',), ("none",), (None,), ('{bad {"x": 1}',)], "t string")
    assert [r[0] for r in said.select(records.first_object(F.col("t"))).collect()] == ['{"a": {"b": "}"}}', None, None, '{"x": 1}']
    settings = tmp_path / "markers.json"
    settings.write_text(json.dumps({"Iron Level": {"low": 5, "high": None, "aliases": ["fe"]}, "hb": {"label": "Hb", "bands": [{"low": 13, "gender": "male"}, {"low": 12, "gender": ["female"]}]}}))
    assert rows(records.markers(spark, str(settings)), "key", "label", "band_ord", "low", "genders") == [("hb", "Hb", 0, 13.0, ["male"]), ("hb", "Hb", 1, 12.0, ["female"]), ("iron_level", "Iron Level", 0, 5.0, [])]


def test_versions_and_registry(spark):
    log = spark.createDataFrame([("a", 1, "x", False), ("a", 2, "y", False), ("b", 1, "z", False), ("b", 2, None, True)], "name string, version_id long, payload string, deleted boolean")
    assert rows(stores.current(log), "name", "payload") == [("a", "y")]
    import hashlib

    change = spark.createDataFrame([("a", "new", False, hashlib.sha256(b"y").hexdigest()), ("a", "other", False, "stale"), ("c", "first", False, None)], "name string, payload string, deleted boolean, expected string")
    after, clash = stores.put(log, change)
    assert rows(stores.current(after), "name", "version_id", "payload") == [("a", 3, "new"), ("c", 1, "first")] and rows(clash, "payload") == [("other",)]
    assert rows(stores.current(stores.rolled_back(log, "a", 1)), "name", "version_id", "payload") == [("a", 3, "x")]
    old = spark.createDataFrame([(1, "t0", "done", None)], "id int, created_at string, status string, error string")
    new = spark.createDataFrame([(1, "t1", None, "e"), (2, "t1", "new", None)], "id int, created_at string, status string, error string")
    assert rows(stores.registered(old, new, "id"), "id", "created_at", "status", "error") == [(1, "t0", "done", "e"), (2, "t1", "new", None)]


def test_metrics_text(spark):
    samples = spark.createDataFrame([("n", {"b": "2", "a": "1"}, "counter", 1.0, 1), ("n", {"a": "1", "b": "2"}, "counter", 2.0, 2), ("g", {}, "gauge", 5.0, 1), ("g", {}, "gauge", 4.0, 2), ("h", {}, "histogram", 1.5, 1)], "name string, labels map<string,string>, kind string, value double, ts int")
    assert [r.line for r in stores.metrics_text(samples).collect()] == ["g 4.0", "h_count 1.0", "h_sum 1.5", 'n{a="1",b="2"} 3.0']


def test_archive(spark, tmp_path):
    results = spark.createDataFrame([(1, "2024-03-09T10:00:00Z")], "job long, completed_at string")
    stores.archive(results, str(tmp_path / "out"))
    assert list((tmp_path / "out").glob("y=2024/m=03/d=09/*.json"))
    assert stores.retained(results, "completed_at", F.lit("2024-03-20").cast("timestamp")).isEmpty()


def test_job_batches(spark):
    table = spark.createDataFrame([("a", "running", "w1", "2024-01-01 00:00:00", 1), ("b", "queued", None, None, 2), ("c", "queued", None, None, 1)], "job_id string, status string, worker_id string, lease string, created_at int").withColumn("lease_expires_at", F.to_timestamp("lease")).drop("lease")
    assert [r.job_id for r in jobs.claimable(table, 1).collect()] == ["c"]
    assert rows(jobs.expired(table, F.lit("2024-01-02").cast("timestamp")), "job_id", "status") == [("a", "queued")]
    reports = spark.createDataFrame([("a", "w1", "completed"), ("b", "w1", "failed"), ("x", "w1", "failed")], "job_id string, worker string, outcome string")
    done, clash = jobs.finished(table, reports)
    assert rows(done, "job_id", "status") == [("a", "completed"), ("b", "queued"), ("c", "queued")] and rows(clash, "job_id", "conflict") == [("b", "state"), ("x", "missing")]


def test_job_stream(spark, tmp_path):
    steps = [("a", 0, "queued"), ("a", 10, "running"), ("a", 20, "queued"), ("a", 30, "completed"), ("b", 5, "running"), ("c", 0, "queued"), ("c", 1, "running"), ("d", 0, "queued"), ("d", 2000, "failed")]
    events = spark.createDataFrame(steps, "job_id string, s long, status string").select("job_id", (F.lit(1704067200) + F.col("s")).cast("timestamp").alias("ts"), "status", F.lit(1.0).alias("value"))
    events.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def out(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return spark.table(name)

    got = out(jobs.lifecycle(read()), "life")
    assert rows(got.where("job_id IN ('a', 'b')"), "job_id", "status", "lawful") == [("a", "completed", False), ("a", "queued", True), ("a", "queued", True), ("a", "running", True), ("b", "running", False)]
    # After its last event the watermark passes the lease of the job that is still running.
    assert ("c", "queued", True) in rows(got.where("job_id = 'c' AND ts > timestamp'2024-01-01 00:00:30'"), "job_id", "status", "lawful")
    assert out(jobs.created_once(read()), "once").count() == 4
    assert rows(out(jobs.windowed(read()), "hours", "update"), "status", "n") == [("completed", 1), ("failed", 1), ("queued", 4), ("running", 3)]


def test_job_stream_remembers(spark, tmp_path):
    """A job that waits longer than a lease goes on as the same job; so does one whose lease ran out; a finished one stays finished."""
    steps = [[("w", 0, "queued"), ("l", 0, "queued"), ("l", 1, "running"), ("f", 0, "queued"), ("f", 1, "running"), ("f", 2, "completed")], [("x", 5000, "queued")], [("x", 5001, "running")], [("w", 6000, "running"), ("l", 6000, "running"), ("f", 6000, "queued")]]
    schema = "job_id string, ts timestamp, status string"
    at = lambda rows: spark.createDataFrame(rows, "job_id string, s long, status string").select("job_id", (F.lit(1704067200) + F.col("s")).cast("timestamp").alias("ts"), "status")
    where = str(tmp_path / "in")
    at(steps[0]).limit(0).write.parquet(where)
    q = None
    for i, rows in enumerate(steps):
        at(rows).coalesce(1).write.mode("append").parquet(where)
        q = jobs.lifecycle(spark.readStream.schema(schema).parquet(where)).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.awaitTermination()
    got = {(r.job_id, r.status, r.lawful) for r in spark.read.parquet(str(tmp_path / "out")).where("ts > timestamp'2024-01-01 01:00:00' OR job_id = 'l'").collect()}
    assert {("w", "running", True), ("l", "queued", True), ("l", "running", True), ("f", "queued", False)} <= got
    assert ("w", "running", False) not in got and ("f", "queued", True) not in got


def test_vectors(spark):
    points = spark.createDataFrame([("a", "t", [1.0, 0.0], "m"), ("b", None, [0.0, 1.0], "m")], "chunk_id string, text string, embedding array<double>, embedding_model string")
    assert vectors.size_of(spark, "points_of_test") == 0 and not vectors.dropped(spark, "points_of_test")
    assert vectors.ensured(spark, "points_of_test", points, 2).count() == vectors.ensured(spark, "points_of_test", points.limit(0), 2).count() == vectors.size_of(spark, "points_of_test") == 2
    with pytest.raises(Exception, match="2 dimensions, not 3"):
        vectors.checked(points, 3).collect()
    assert [r.chunk_id for r in vectors.payloads(points).collect()] == ["a"] and "embedding" not in vectors.payloads(points).columns
    assert vectors.dropped(spark, "points_of_test")


def test_profiles(spark):
    markers = [(f"m{i}", 1.0 * i, 3.0 * i, d) for i, d in enumerate(["low_is_bad", "high_is_bad", "outside_range"] * 4, 1)] + [("none", None, None, "context")]
    out = datasets.synthetic_profiles(spark.range(200).withColumnRenamed("id", "patient_id"), markers).collect()
    assert sorted(map(str, out)) == sorted(map(str, datasets.synthetic_profiles(spark.range(200).repartition(3).withColumnRenamed("id", "patient_id"), markers).collect()))
    bounds = {k: (lo, hi, d) for k, lo, hi, d in markers}
    for p in range(200):
        own = [r for r in out if r.patient_id == p]
        assert 5 <= len(own) <= 8 and 2 <= sum(r.abnormal for r in own) <= 4 and len({r.key for r in own}) == len(own)
        for r in own:
            lo, hi, d = bounds[r.key]
            assert (lo <= r.value <= hi) != r.abnormal and not (r.abnormal and (d == "low_is_bad") and r.value > hi) and not (r.abnormal and (d == "high_is_bad") and r.value < lo)


def _leased(spark, where, batches, lease_seconds=60, keep_seconds=3600):
    """The rows of jobs.leases after each of some batches of events, each read by a query that starts anew from the checkpoint."""
    schema = "job_id string, ts timestamp, event string, worker string"
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for events in batches:
            rows = spark.createDataFrame(events, "job_id string, s long, event string, worker string").select("job_id", (F.lit(1704067200) + F.col("s")).cast("timestamp").alias("ts"), "event", "worker")
            rows.coalesce(1).write.mode("append").parquet(f"{where}/in")
            found = jobs.leases(spark.readStream.schema(schema).parquet(f"{where}/in"), lease_seconds, "10 seconds", keep_seconds)
            q = found.writeStream.format("parquet").option("path", f"{where}/out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{where}/cp").start()
            q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    out = spark.read.parquet(f"{where}/out").select("job_id", "event", (F.col("ts").cast("long") - 1704067200).alias("s"), "status", "worker", (F.col("lease_until").cast("long") - 1704067200).alias("until"), "problem")
    by: dict = {}
    for r in sorted(out.collect(), key=lambda r: (r.job_id, r.s, r.event != "lease_expired", jobs.EVENTS.get(r.event, 9))):
        by.setdefault(r.job_id, []).append(tuple(r)[1:])
    return by


def test_leases_owners_and_ends(spark, tmp_path):
    far = [("z", 10_000, "create", None), ("z", 10_001, "claim", "w")]
    got = _leased(spark, str(tmp_path), [[
        ("new", 0, "create", None), ("new", 5, "create", None),
        ("run", 0, "create", None), ("run", 10, "claim", "w1"), ("run", 20, "claim", "w2"), ("run", 30, "heartbeat", "w2"), ("run", 40, "complete", "w2"), ("run", 50, "complete", "w1"), ("run", 55, "heartbeat", "w1"), ("run", 56, "fail", "w1"),
        ("none", 3, "heartbeat", "w1"),
        ("back", 0, "create", None), ("back", 1, "claim", "w1"), ("back", 2, "release", "w1"), ("back", 3, "claim", "w2"), ("back", 4, "fail", "w2"), ("back", 5, "dance", "w2"),
    ], far])
    assert got["new"] == [("create", 0, "queued", None, None, None), ("create", 5, "queued", None, None, "exists")]
    assert [r[0] + ":" + str(r[5]) for r in got["run"]] == ["create:None", "claim:None", "claim:state", "heartbeat:worker", "complete:worker", "complete:None", "heartbeat:state", "fail:state"]
    assert got["run"][1] == ("claim", 10, "running", "w1", 70, None) and got["run"][5][2:4] == ("completed", "w1")
    assert got["none"] == [("heartbeat", 3, None, None, None, "missing")]
    assert [(r[0], r[2], r[3], r[5]) for r in got["back"]] == [("create", "queued", None, None), ("claim", "running", "w1", None), ("release", "queued", None, None), ("claim", "running", "w2", None), ("fail", "failed", "w2", None), ("dance", "failed", "w2", "state")]


def test_heartbeats_extend_a_lease_over_restarts(spark, tmp_path):
    got = _leased(spark, str(tmp_path), [
        [("a", 0, "create", None), ("a", 1, "claim", "w1"), ("b", 0, "create", None), ("b", 1, "claim", "w1")],
        [("a", 41, "heartbeat", "w1")],
        [("a", 81, "heartbeat", "w1"), ("c", 82, "create", None)],
        [("c", 120, "claim", "w2")],
        [("c", 400, "heartbeat", "w2"), ("a", 401, "claim", "w3")],
        [("d", 9000, "create", None)],
        [("b", 9001, "complete", "w1"), ("a", 9002, "create", None)],
        [("d", 20_000, "claim", "w1")],
    ])
    assert got["b"] == [("create", 0, "queued", None, None, None), ("claim", 1, "running", "w1", 61, None), ("lease_expired", 61, "queued", None, None, None), ("complete", 9001, "queued", None, None, "state")]
    assert [(r[0], r[1], r[4]) for r in got["a"]] == [("create", 0, None), ("claim", 1, 61), ("heartbeat", 41, 101), ("heartbeat", 81, 141), ("lease_expired", 141, None), ("claim", 401, 461), ("lease_expired", 461, None), ("create", 9002, None)]
    assert [(r[0], r[1], r[2], r[5]) for r in got["c"]] == [("create", 82, "queued", None), ("claim", 120, "running", None), ("lease_expired", 180, "queued", None), ("heartbeat", 400, "queued", "state")]


def test_finished_jobs_are_forgotten_in_time(spark, tmp_path):
    got = _leased(spark, str(tmp_path), [[("a", 0, "create", None), ("a", 1, "claim", "w"), ("a", 2, "complete", "w"), ("q", 0, "create", None)], [("x", 3000, "create", None)], [("a", 3001, "create", None)], [("x", 9000, "claim", "w")], [("a", 9001, "create", None), ("q", 9002, "claim", "w")]])
    assert [(r[0], r[1], r[2], r[5]) for r in got["a"]][2:] == [("complete", 2, "completed", None), ("create", 3001, "completed", "exists"), ("create", 9001, "queued", None)]
    assert [(r[0], r[2], r[5]) for r in got["q"]] == [("create", "queued", None), ("claim", "running", None)]


def test_news_of_a_running_job_keeps_it_running(spark, tmp_path):
    steps = [("a", 0, "queued"), ("a", 1, "running"), ("a", 41, "running"), ("a", 81, "running"), ("a", 120, "completed"), ("b", 0, "queued"), ("b", 1, "running"), ("b", 100, "completed")]
    events = spark.createDataFrame(steps, "job_id string, s long, status string").select("job_id", (F.lit(1704067200) + F.col("s")).cast("timestamp").alias("ts"), "status")
    events.write.parquet(str(tmp_path / "in"))
    q = jobs.lifecycle(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("news").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = rows(spark.table("news"), "job_id", "status", "lawful")
    assert [r for r in got if r[0] == "a"] == [("a", "completed", True), ("a", "queued", True)] + [("a", "running", True)] * 3
    assert ("b", "completed", False) in got and got.count(("b", "queued", True)) == 2


def test_ingestion_follows_a_folder(spark, tmp_path):
    from siftstone.sources import tables
    from siftstone.streaming import ingestion

    folder, state = tmp_path / "in", str(tmp_path / "state")
    (folder / "sub").mkdir(parents=True)
    put = lambda name, text: (folder / name).write_text(text)
    texts = lambda: {(r.path.rsplit("/", 1)[1], r.text) for r in tables.table(spark, f"{state}/chunks").collect()}
    run = lambda **how: ingestion.ingest(spark, str(folder), state, **how)
    assert run() == {"read": 0, "gone": 0}
    put("a.txt", "first text")
    put("sub/b.txt", "long words here " * 40)
    put("c.txt", "")
    assert run() == {"read": 2, "gone": 0} and {n for n, _ in texts()} == {"a.txt", "b.txt"} and len(texts()) > 2
    before = texts()
    assert run() == {"read": 0, "gone": 0} and texts() == before
    put("sub/b.txt", "short now")
    (folder / "a.txt").unlink()
    put("d.txt", "new one")

    def die():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run(before_objects=die)
    assert run(block=2) == {"read": 2, "gone": 1} and texts() == {("b.txt", "short now"), ("d.txt", "new one")}
    put("d.txt", "")
    (folder / "sub/b.txt").unlink()
    assert run() == {"read": 0, "gone": 2} and texts() == set()


def test_one_huge_value_leaves_the_ranges_apart(spark):
    from siftstone.operators import scoring

    rows = spark.range(1000).select((F.col("id") % 200).cast("double").alias("v")).unionByName(spark.createDataFrame([(1e9,)], "v double"))
    low, high = scoring.graded(F.lit(0.0)), scoring.graded(F.lit(1e9))
    bins = rows.select(F.floor((scoring.graded(F.col("v")) - low) / (high - low) * scoring.BINS).alias("b")).distinct().count()
    found = scoring.latency_summary(rows, [], F.col("v")).first()
    assert bins > 150 and (found["p50"], found["p95"], found["max"]) == (100.0, 190.0, 1e9)
