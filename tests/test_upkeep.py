"""Tables changed in place: what goes, what stays, what others add meanwhile, what a lost driver leaves."""

from pyspark.sql import functions as F

from wayledger.operators import upkeep
from wayledger.sources import rewrite


def ids(spark, path):
    return sorted(r.id for r in spark.read.parquet(path).collect())


def test_only_touched_files_change_and_appended_rows_stay(spark, tmp_path):
    path = f"{tmp_path}/t"
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(path)
    before = {p.name for p in (tmp_path / "t").glob("*.parquet")}

    def with_a_writer(rows):
        spark.range(100, 103).coalesce(1).write.mode("append").parquet(path)  # another writer, in the middle
        return rows.filter("id <> 13")

    assert rewrite.change(spark, path, lambda t: t.filter("id = 13"), with_a_writer) == 1
    assert ids(spark, path) == sorted({*range(40), 100, 101, 102} - {13})
    assert len(before & {p.name for p in (tmp_path / "t").glob("*.parquet")}) == 3
    assert rewrite.change(spark, path, lambda t: t.filter("id = 13"), lambda t: t) == 0


def test_what_a_lost_driver_leaves_is_finished_or_undone(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(10).coalesce(1).write.parquet(path)
    old = [str(p) for p in (tmp_path / "t").glob("*.parquet")]
    half = f"{path}/{rewrite._HIDDEN}half"
    spark.range(5).write.parquet(f"{half}/rows")  # no list yet: nothing was deleted
    assert rewrite.recover(spark, path) == 0 and ids(spark, path) == list(range(10))
    done = f"{path}/{rewrite._HIDDEN}done"
    spark.range(9).coalesce(1).write.parquet(f"{done}/rows")
    spark.createDataFrame([(name,) for name in old], "value string").coalesce(1).write.text(f"{done}/old")
    assert rewrite.recover(spark, path) == 1 and ids(spark, path) == list(range(9))
    assert rewrite.recover(spark, path) == 0


def test_sweep_holds_and_erasure(spark, tmp_path):
    root = str(tmp_path / "tables")
    t = lambda text: F.to_timestamp(F.lit(text))
    reads = spark.createDataFrame(
        [(1, "p1", "i1"), (2, "p2", "i2"), (3, "p3", "i1"), (4, "p4", "i4")],
        "id long, plate_hmac string, plate_image_sha256 string").withColumns({
            "context_image_sha256": F.lit(None).cast("string"), "captured_at": t("2024-01-05 00:00:00"),
            "expires_at": F.when(F.col("id") <= 2, t("2024-02-01 00:00:00")).otherwise(t("2025-01-01 00:00:00"))})
    sessions = reads.select(F.col("id").cast("string").alias("session_id"), "plate_hmac", F.col("captured_at").alias("entered_at"), "expires_at")
    blobs = spark.createDataFrame([("i1",), ("i2",), ("i4",)], "sha256 string").withColumn("expires_at", t("2024-02-01 00:00:00"))
    hits = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "id long, read_id long")
    upkeep.store({"reads": reads, "sessions": sessions, "blobs": blobs, "hits": hits}, root)
    holds = spark.createDataFrame([("p2",)], "plate_hmac string").withColumn("hold_until", t("2024-12-01 00:00:00"))
    upkeep.apply_holds(spark, root, holds)
    upkeep.apply_sweep(spark, root, "2024-03-01 00:00:00")
    now = upkeep.stored(spark, root)
    column = lambda name, c: sorted(r[0] for r in now[name].select(c).collect())
    assert column("reads", "id") == [2, 3, 4] and column("sessions", "session_id") == ["2", "3", "4"]
    assert column("hits", "id") == [11, 12] and column("blobs", "sha256") == ["i1", "i2", "i4"]
    requests = spark.createDataFrame([(1, "p4", "pending", None, None, None), (2, "p3", "done", 5, 6, None)],
                                     "request_id long, plate_hmac string, status string, reads_deleted long, sessions_deleted long, executed_at timestamp")
    report = {r.request_id: (r.reads_deleted, r.sessions_deleted, r.status) for r in upkeep.apply_erasure(spark, root, requests, "2024-03-02 00:00:00").collect()}
    assert report == {1: (1, 1, "done"), 2: (5, 6, "done")}
    now = upkeep.stored(spark, root)
    assert column("reads", "id") == [2, 3] and column("blobs", "sha256") == ["i1", "i2"]
    # All that is left expires: the tables are empty, and still tables.
    upkeep.apply_sweep(spark, root, "2026-01-01 00:00:00")
    now = upkeep.stored(spark, root)
    assert column("reads", "id") == [] and column("hits", "id") == [] and column("blobs", "sha256") == []
