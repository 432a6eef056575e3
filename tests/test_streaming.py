from __future__ import annotations

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from basketlens import schema
from basketlens.operators.categories import category_aggregate
from basketlens.operators.sessions import session_aggregate
from basketlens.schema import EventLabels
from basketlens.sinks import write_events_csv
from basketlens.sources.events import read_events_csv
from basketlens.streaming import jobs

HEADER = ",".join(schema.EVENT_COLUMNS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def folder(tmp_path):
    """Two files; session s0 has events in both."""
    inbox = tmp_path / "in"
    inbox.mkdir()
    for f in range(2):
        write(inbox, f)
    return inbox


def write(inbox, f):
    start = dt.datetime(2019, 10, 1) + dt.timedelta(hours=f)
    kinds = ["view", "cart", "purchase"]
    lines = [
        f"{start + dt.timedelta(seconds=i)} UTC,{kinds[i % 3]},{i % 4},{i % 2},,acme,{i + 0.25},{i},s{0 if i < 3 else 10 * f + i}"
        for i in range(9)
    ]
    (inbox / f"{f}.csv").write_text("\n".join([HEADER, *lines]) + "\n")


def run(query):
    query.awaitTermination()


def test_new_files_are_added_once(spark, folder, tmp_path):
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for files in (2, 2, 3):
        if files == 3:
            write(folder, 2)
        run(jobs.stream_convert(spark, str(folder), target, checkpoint, types={}))
        stored = spark.read.parquet(target)
        assert stored.count() == 9 * files
    assert rows_of(stored) == rows_of(read_events_csv(spark, str(folder)))


def test_sessions_across_batches_and_runs(spark, folder, tmp_path):
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for files in (2, 3):
        if files == 3:
            write(folder, 2)
        run(jobs.stream_sessions(jobs.stream_events_csv(spark, str(folder), 1), target, checkpoint))
        expected = session_aggregate(read_events_csv(spark, str(folder)))
        assert rows_of(jobs.current_sessions(spark, target)) == rows_of(expected)
    assert len([f for f in os.listdir(target) if f.startswith("batches=")]) == 3
    # Two merges: the second deletes what the first stood for already.
    for _ in range(2):
        jobs.compact_sessions(spark, target)
        assert list(jobs.complete_batches(spark, target)) == [(0, 2)]
        assert rows_of(jobs.current_sessions(spark, target)) == rows_of(expected)
    write(folder, 3)
    run(jobs.stream_sessions(jobs.stream_events_csv(spark, str(folder), 1), target, checkpoint))
    expected = session_aggregate(read_events_csv(spark, str(folder)))
    assert rows_of(jobs.current_sessions(spark, target)) == rows_of(expected)
    jobs.compact_sessions(spark, target)
    assert list(jobs.complete_batches(spark, target)) == [(0, 3)]
    assert rows_of(jobs.current_sessions(spark, target)) == rows_of(expected)


def test_session_labels(spark, folder, tmp_path):
    target, labels = str(tmp_path / "out"), EventLabels(cart="purchase")
    run(jobs.stream_sessions(jobs.stream_events_csv(spark, str(folder)), target, str(tmp_path / "cp"), labels))
    assert rows_of(jobs.current_sessions(spark, target)) == rows_of(session_aggregate(read_events_csv(spark, str(folder)), labels))


def test_a_batch_is_seen_whole(spark, folder, tmp_path):
    """While a batch is written again, readers have the attempt before it."""
    target = str(tmp_path / "out")
    run(jobs.stream_category_partials(jobs.stream_events_csv(spark, str(folder), 1), target, str(tmp_path / "cp")))
    before = rows_of(jobs.current_categories(spark, target))
    begun = tmp_path / "out" / "batches=1-1" / "attempt=2"
    begun.mkdir()
    (begun / "part-0.parquet").write_bytes(b"half a file")
    assert rows_of(jobs.current_categories(spark, target)) == before
    with pytest.raises(FileNotFoundError):
        jobs.current_categories(spark, str(tmp_path / "nothing"))


def test_bad_rows_of_a_stream(spark, folder, tmp_path):
    (folder / "9.csv").write_text(f"{HEADER}\n2019-10-01 00:00:00 UTC,view,x\n")
    target = str(tmp_path / "out")
    run(jobs.stream_convert(spark, str(folder), target, str(tmp_path / "cp"), on_bad="drop"))
    assert spark.read.parquet(target).count() == 18
    with pytest.raises(Exception, match="MALFORMED"):
        run(jobs.stream_convert(spark, str(folder), str(tmp_path / "out2"), str(tmp_path / "cp2")))


def test_a_repeated_batch_changes_nothing(spark, folder, tmp_path):
    target = str(tmp_path / "out")
    for attempt in range(2):
        # A fresh checkpoint runs the same batch ids again.
        events = jobs.stream_events_csv(spark, str(folder), 1)
        run(jobs.stream_category_partials(events, target, str(tmp_path / f"cp{attempt}")))
    expected = category_aggregate(read_events_csv(spark, str(folder)))
    assert rows_of(jobs.current_categories(spark, target)) == rows_of(expected)


def test_stateful_categories(spark, folder, tmp_path):
    seen = []
    totals = jobs.stream_category_aggregate(jobs.stream_events_csv(spark, str(folder), 1))
    run(
        totals.writeStream.outputMode("update")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .foreachBatch(lambda batch, _id: seen.append({(r.category_id, r.event_type): tuple(r) for r in batch.collect()}))
        .trigger(availableNow=True)
        .start()
    )
    latest = {k: v for batch in seen for k, v in batch.items()}
    expected = category_aggregate(read_events_csv(spark, str(folder)))
    assert sorted(latest.values()) == rows_of(expected)


def events_file(inbox, name, rows):
    lines = [f"2019-10-{day:02} {hour:02}:00:00 UTC,{kind},{product},1,,acme,2.5,7,{session}" for day, hour, kind, product, session in rows]
    (inbox / name).write_text("\n".join([HEADER, *lines]) + "\n")


def test_closed_sessions(spark, tmp_path):
    """A session is written once it is closed; late events are dropped, open sessions wait, a pause makes a new session."""
    inbox, target, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    inbox.mkdir()

    def step():
        run(jobs.stream_closed_sessions(jobs.stream_events_csv(spark, str(inbox)), target, checkpoint, "6 hours", "2 hours"))
        return {(r.user_session, r.session_start.day, r.total_events, r.unique_products, r.total_spent) for r in spark.read.parquet(target).collect()}

    events_file(inbox, "0.csv", [(1, 0, "view", 1, "a"), (1, 5, "purchase", 1, "a"), (1, 9, "view", 2, "b"), (1, 10, "view", 3, "a"), (1, 11, "view", 4, "c")])
    assert step() == set()
    # The watermark comes to day 2, 10:00: a (last event at 10:00) and b are closed, a later a is another session.
    events_file(inbox, "1.csv", [(1, 12, "cart", 2, "b"), (2, 12, "view", 9, "a"), (2, 12, "view", 9, "d")])
    closed = {("a", 1, 3, 2, 2.5), ("b", 1, 2, 1, 0.0), ("c", 1, 1, 1, 0.0)}
    assert step() == closed
    # An event behind the watermark is dropped, whoever's it is; one that is just in time counts.
    events_file(inbox, "2.csv", [(1, 11, "purchase", 5, "c"), (2, 3, "view", 5, "e"), (2, 13, "view", 8, "d")])
    assert step() == closed
    events_file(inbox, "3.csv", [(4, 0, "view", 1, "z")])
    assert step() == closed | {("a", 2, 1, 1, 0.0), ("d", 2, 2, 2, 0.0)}
    # Nothing twice.
    assert step() == closed | {("a", 2, 1, 1, 0.0), ("d", 2, 2, 2, 0.0)}
    assert spark.read.parquet(target).count() == 5


def test_closed_sessions_equal_the_batch(spark, folder, tmp_path):
    expected = rows_of(session_aggregate(read_events_csv(spark, str(folder))))
    (folder / "9.csv").write_text(f"{HEADER}\n2019-12-01 00:00:00 UTC,view,1,1,,acme,1.0,1,last\n")
    target = str(tmp_path / "out")
    run(jobs.stream_closed_sessions(jobs.stream_events_csv(spark, str(folder)), target, str(tmp_path / "cp"), "12 hours", "1 hour"))
    assert rows_of(spark.read.parquet(target)) == expected


def test_open_sessions_lie_in_rocksdb(spark, folder, tmp_path):
    """state on the heap grows with the sessions of a first batch. Settings of the session stay as they were."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stream = jobs.stream_closed_sessions(jobs.stream_events_csv(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp"))
    run(stream)
    operators = [o for p in stream.recentProgress for o in p.stateOperators]
    assert operators and all(any(name.startswith("rocksdb") for name in o.customMetrics) for o in operators)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_compacted_sessions_are_shuffled_once(spark, folder, tmp_path):
    """one folder has a row per session and product, so its products are not made distinct again."""
    (folder / "n.csv").write_text(f"{HEADER}\n2019-10-01 00:00:00 UTC,view,,1,,acme,1.0,1,s0\n2019-10-01 00:00:01 UTC,view,7,1,,acme,1.0,1,\n")
    target = str(tmp_path / "out")
    run(jobs.stream_sessions(jobs.stream_events_csv(spark, str(folder), 1), target, str(tmp_path / "cp")))
    expected = rows_of(session_aggregate(read_events_csv(spark, str(folder))))
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert rows_of(jobs.current_sessions(spark, target)) == expected and exchanges(jobs.current_sessions(spark, target)) == 2
    jobs.compact_sessions(spark, target)
    assert rows_of(jobs.current_sessions(spark, target)) == expected and exchanges(jobs.current_sessions(spark, target)) == 1


def test_category_totals_are_exact(spark, folder, tmp_path):
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for files in (2, 3, 4):
        if files > 2:
            write(folder, files - 1)
        run(jobs.stream_category_totals(jobs.stream_events_csv(spark, str(folder), 1), target, checkpoint))
        expected = category_aggregate(read_events_csv(spark, str(folder)))
        assert rows_of(jobs.current_category_totals(spark, target)) == rows_of(expected)
    # The last totals and those before them are kept.
    assert len([f for f in os.listdir(target) if f.startswith("batches=") and os.listdir(os.path.join(target, f))]) <= 2


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    names = set()
    while found.hasNext():
        names.add(found.next().getName())
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_shuffle_files_go_with_their_batch(spark, folder, tmp_path):
    """they stayed until the driver happened to collect its garbage. The setting is that of the stream and the merge only."""
    target, name = str(tmp_path / "out"), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(name, None)
    run(jobs.stream_sessions(jobs.stream_events_csv(spark, str(folder), 1), target, str(tmp_path / "cp")))
    jobs.compact_sessions(spark, target)
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(name, None) == setting
    assert rows_of(jobs.current_sessions(spark, target)) == rows_of(session_aggregate(read_events_csv(spark, str(folder))))


def test_compressed_event_files(spark, folder, tmp_path):
    """A stream over compressed files gives the rows of the plain ones."""
    events = read_events_csv(spark, str(folder)).withColumn("month", F.lit("2019-10"))
    packed = str(tmp_path / "packed")
    write_events_csv(events, packed, partition_by=["month"], compression="gzip")
    assert all(f.name.endswith(".csv.gz") for f in (tmp_path / "packed" / "month=2019-10").iterdir() if f.name.startswith("part-"))
    target = str(tmp_path / "out")
    run(jobs.stream_sessions(jobs.stream_events_csv(spark, packed, 1, glob="*.csv.gz"), target, str(tmp_path / "cp")))
    assert rows_of(jobs.current_sessions(spark, target)) == rows_of(session_aggregate(read_events_csv(spark, str(folder))))
