import shutil

import pytest
from helpers import batch, good, requests
from pyspark.sql import functions as F

from emberlog import LogStore
from emberlog.sources.requests import request_files, stream_requests
from emberlog.streaming.ingest import start_ingest


def write_day(spark, folder, day):
    body = batch(*[good(timestamp=f"2026-01-{day:02}T00:00:{n % 60:02}Z") for n in range(50)])
    requests(spark, body).coalesce(1).write.mode("append").json(str(folder))


def run(spark, folder, store, checkpoint, **options):
    stream = stream_requests(spark, str(folder), "json", **options)
    query = start_ingest(stream, store, str(checkpoint), "files")
    query.awaitTermination()
    return query


def totals(store):
    return store.logs().count(), store.rollup().agg(F.sum("count")).first()[0]


def test_stream_commits_each_batch_once(spark, tmp_path):
    folder, store = tmp_path / "in", LogStore(spark, str(tmp_path / "store"))
    for day in (1, 2, 3):
        write_day(spark, folder, day)
    query = run(spark, folder, store, tmp_path / "ckpt", max_files_per_trigger=1)
    assert sum(p["numInputRows"] for p in query.recentProgress) == 3
    assert totals(store) == (150, 150)
    assert store.last_commit().batch_id == 2
    # Late files join a second already counted; a restart goes on where it stopped.
    write_day(spark, folder, 1)
    run(spark, folder, store, tmp_path / "ckpt")
    assert totals(store) == (200, 200)


def test_lost_acknowledgement_is_not_counted_twice(spark, tmp_path):
    folder, store, checkpoint = tmp_path / "in", LogStore(spark, str(tmp_path / "store")), tmp_path / "ckpt"
    for day in (1, 2):
        write_day(spark, folder, day)
        run(spark, folder, store, checkpoint)
    # The checkpoint forgets that its last micro-batch was done, so it runs again.
    for name in ("1", ".1.crc"):
        shutil.move(str(checkpoint / "commits" / name), str(tmp_path / f"forgotten{name}"))
    run(spark, folder, store, checkpoint)
    assert totals(store) == (100, 100)


def test_failed_batch_is_taken_up_again(spark, tmp_path, monkeypatch):
    folder, store, checkpoint = tmp_path / "in", LogStore(spark, str(tmp_path / "store")), tmp_path / "ckpt"
    write_day(spark, folder, 1)

    def refuse(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(LogStore, "commit", refuse)
        with pytest.raises(Exception, match="lost"):
            run(spark, folder, store, checkpoint)
    assert store.logs().count() == 0
    run(spark, folder, store, checkpoint)
    assert totals(store) == (50, 50)


def test_text_files_as_requests(spark, tmp_path):
    folder = tmp_path / "bodies"
    folder.mkdir()
    (folder / "a.json").write_text(batch(good(), good(level="x")))
    (folder / "b.json").write_text('{ "logs": [ not valid')
    frame = request_files(spark, str(folder))
    store = LogStore(spark, str(tmp_path / "store"))
    # Files written now arrive now; the entries are older.
    store.append(frame.withColumn("received_at", F.greatest("received_at", F.lit("2026-07-21").cast("timestamp"))))
    answers = {r["request_id"].rsplit("/", 1)[1]: (r["status"], r["accepted"]) for r in store.responses().collect()}
    assert answers == {"a.json": (200, 1), "b.json": (400, 0)}
