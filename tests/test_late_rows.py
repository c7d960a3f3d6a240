"""Late rows leave by their own output, state is evicted, and window batches are whole or absent."""

from __future__ import annotations

import datetime as dt

import pytest

from stratolab.streaming import online

SLOT = 1800
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(PROVIDER)


def at(slot, second=0):
    return dt.datetime.fromtimestamp(slot * SLOT + second, tz=dt.UTC).replace(tzinfo=None)


def runs(spark, tmp_path, schema, batches, build):
    """Each batch a run of the query; the rows put out, and the rows of state after each run."""
    held = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = build(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        writer = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    return spark.read.parquet(str(tmp_path / "out")).collect(), held


def test_rows_one_slot_late_count_and_rows_four_slots_late_leave(rocks, tmp_path):
    """The watermark is 30 minutes behind: a row one slot late still finds its slot open, one four slots late does not."""
    on_time = [[(at(10 + k), "a", 1.0), (at(10 + k, 60), "b", 2.0), (at(10 + k, 700), "b", 9.0)] for k in range(12)]
    on_time[3].append((at(12, 5), "a", 10.0))  # one slot late
    on_time[6].append((at(12, 7), "a", 100.0))  # four slots late
    rows, held = runs(rocks, tmp_path, "ts timestamp, stream string, value double", on_time, online.slots_and_late)
    closed = {(r.stream, r.slot_s // SLOT): (r.n, r.total) for r in rows if r.kind == "closed"}
    late = [(r.stream, r.slot_s // SLOT, r.n, r.total) for r in rows if r.kind == "late"]
    assert late == [("a", 12, 1, 100.0)]
    assert len(closed) == sum(r.kind == "closed" for r in rows) == 2 * 10
    assert closed["a", 12] == (2, 11.0) and all(closed[k] == ((1, 1.0) if k[0] == "a" else (1, 2.0)) for k in closed if k != ("a", 12))
    assert max(held[3:]) <= held[3] <= 12  # a handful of open slots, however long it runs


def test_versions_that_come_late_leave(rocks, tmp_path):
    batches = [[("s", at(20 + k), f"v{i}", f"p{k}{i}") for i in (2, 1)] for k in range(8)]
    batches[4].append(("s", at(23), "v9", "p39"))
    batches[6].append(("s", at(20), "v9", "p09"))
    rows, _ = runs(rocks, tmp_path, "satellite string, slot timestamp, name string, path string", batches, online.latest_and_late)
    closed = {r.slot_s // SLOT: r.path for r in rows if r.kind == "closed"}
    assert [(r.slot_s // SLOT, r.path) for r in rows if r.kind == "late"] == [(20, "p09")]
    assert closed == {20 + k: f"p{k}2" if k != 3 else "p39" for k in range(6)}


def test_a_batch_that_fails_before_its_commit_is_neither_doubled_nor_lost(spark, tmp_path, monkeypatch):
    root, check, source = (str(tmp_path / x) for x in ("store", "check", "in"))
    schema = "valid_time long, x int"

    def run(rows):
        if rows:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        query = online.incremental_windows(spark.readStream.schema(schema).parquet(source), root, check).trigger(availableNow=True).start()
        query.awaitTermination()

    def seen():
        return sorted(r.valid_time for r in online.committed(spark, root, schema).collect())

    run([(k * SLOT, 1) for k in range(50)] + [(0, 2)])
    assert seen() == [k * SLOT for k in range(50)]
    real = online.commit

    def broken(*args):
        raise RuntimeError("lost before the commit")

    monkeypatch.setattr(online, "commit", broken)
    with pytest.raises(Exception, match="lost before the commit"):
        run([(k * SLOT, 1) for k in range(40, 90)])
    assert seen() == [k * SLOT for k in range(50)]  # the rows are written, but no reader takes them
    monkeypatch.setattr(online, "commit", real)
    run([])
    assert seen() == [k * SLOT for k in range(90)]
    run([(k * SLOT, 1) for k in range(80, 100)])
    assert seen() == [k * SLOT for k in range(100)]
