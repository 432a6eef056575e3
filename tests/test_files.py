"""Files in, files out: policies, globs, delimiters, profiles, writes."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from basketlens import schema
from basketlens.operators import profile, summaries, typing
from basketlens.operators.categories import category_aggregate
from basketlens.operators.dictionary import build_dictionary, decode, distinct_values, encode
from basketlens.operators.sessions import session_aggregate
from basketlens.operators.summaries import price_summary
from basketlens.runtime import path_exists, shared_root, stage
from basketlens.sinks import convert_csv, materialize, write_events_csv, write_parquet
from basketlens.sources import events as source
from basketlens.sources import files
from basketlens.sources.tables import retail_events

HEADER = ",".join(schema.EVENT_COLUMNS)
GOOD = "2019-10-01 00:00:00 UTC,view,1,10,a.b,acme,1.25,7,s1"


@pytest.fixture
def dirty(tmp_path):
    lines = [
        HEADER.encode(),
        GOOD.encode(),
        b"2019-10-01 00:00:01 UTC,view,2,10",
        b"2019-10-01 00:00:02 UTC,view,3,10,a.b,acme,1.25,7,s1,extra",
        b"2019-10-01 00:00:03 UTC,view,oops,10,a.b,acme,1.25,7,s1",
        b"2019-10-01 00:00:04 UTC,view,5,10,a.\xff,acme,1.25,7,s1",
    ]
    path = tmp_path / "2019-Oct.csv"
    path.write_bytes(b"\n".join(lines) + b"\n")
    return str(path)


def test_drop_keeps_readable_rows(spark, dirty):
    kept = source.read_events_csv(spark, dirty, on_bad="drop")
    rows = kept.orderBy("product_id").collect()
    assert [r.product_id for r in rows] == [1, 5]
    assert rows[1].category_code == "a.�"
    assert kept.schema == schema.EVENTS


def test_bad_rows_do_not_depend_on_the_columns_read(spark, dirty):
    assert source.read_events_csv(spark, dirty, on_bad="drop").count() == 2
    assert source.read_events_csv(spark, dirty, on_bad="drop", columns=["event_type"]).count() == 2
    good, bad = source.split_quarantine(source.read_events_csv(spark, dirty, on_bad="quarantine"))
    assert (good.count(), bad.count()) == (2, 3)
    texts = sorted(r[0] for r in bad.select("_corrupt_record").collect())
    assert texts[1].endswith("extra") and "oops" in texts[2]


def test_quarantine_keeps_the_line(spark, tmp_path):
    path = tmp_path / "q.csv"
    late = 'yesterday,view,3,10,"a,b",acme,1.25,7,s1'
    path.write_text("\n".join([HEADER, GOOD, late, '2019-10-01 00:00:03 UTC,view,"x ""y""",10,,,,7,s1']) + "\n")
    events = source.read_events_csv(spark, str(path), on_bad="quarantine")
    good, bad = source.split_quarantine(events)
    assert good.count() == 1
    assert {r._corrupt_record for r in bad.collect()} == set(path.read_text().splitlines()[2:])
    assert bad.where("category_code = 'a,b'").count() == 1


def test_lenient_keeps_short_rows(spark, dirty):
    rows = {r.product_id: r for r in source.read_events_csv(spark, dirty, on_bad="lenient").collect()}
    assert set(rows) == {1, 2, None, 5}
    assert rows[2].price is None and rows[2].category_id == 10
    assert rows[None].user_session == "s1"


def test_headers_of_all_files_are_left_out(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text(f"{HEADER}\n{GOOD}\n{GOOD}\n")
    for policy in source.POLICIES:
        assert source.read_events_csv(spark, str(tmp_path), on_bad=policy).count() == 6


def test_fail_stops(spark, dirty):
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        source.read_events_csv(spark, dirty).collect()
    with pytest.raises(Exception, match="MALFORMED"):
        source.read_events_csv(spark, dirty, columns=["event_type"]).count()
    with pytest.raises(ValueError):
        source.read_events_csv(spark, dirty, on_bad="ignore")


def test_glob_and_missing(spark, dirty, tmp_path):
    (tmp_path / "notes.txt").write_text("not,an,event\n")
    (tmp_path / "2019-Nov.csv").write_text(f"{HEADER}\n{GOOD}\n")
    kept = source.read_events_csv(spark, str(tmp_path), glob="*.csv", on_bad="drop")
    assert kept.count() == 3
    tagged = source.with_source_tag(kept, r"([^/]+)\.csv$")
    assert {tuple(r) for r in tagged.groupBy("month").count().collect()} == {("2019-Oct", 2), ("2019-Nov", 1)}
    absent = str(tmp_path / "absent")
    assert source.read_events_csv(spark, [dirty, absent], on_bad="drop", missing="skip").count() == 2
    assert source.read_events_csv(spark, f"{tmp_path}/2019-*.csv", on_bad="drop", missing="skip").count() == 3
    assert source.read_events_csv(spark, [f"{tmp_path}/none-*.csv", dirty], on_bad="drop", missing="skip").count() == 2
    for policy in ("fail", "drop"):
        nothing = source.read_events_csv(spark, absent, missing="skip", on_bad=policy)
        assert nothing.count() == 0 and nothing.schema == schema.EVENTS
    assert source.read_events_parquet(spark, absent, missing="skip").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        source.read_events_csv(spark, absent)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_do_not_depend_on_the_zone(spark, zone):
    texts = ["2019-03-10 02:30:00 UTC", "2019-10-01", "yesterday", "2019-13-01 00:00:00 UTC", None]
    others = ["2019-03-10T02:30:00Z", "2019-03-10 02:30:00", "2019-03-10 04:30:00+02:00", "2019-03-09T21:00:00.000000-0530"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from basketlens.functions import columns as fn

    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        time = fn.parse_event_time("t")
        found = df.select(
            time.cast("string").alias("time"), fn.format_event_time(time).alias("text"), fn.month_of(time).alias("month"),
            fn.day_of(time).cast("string").alias("day"), fn.micros_of(time).alias("micros"),
        ).collect()
        same = spark.createDataFrame([(t,) for t in others], "t string").select(time.cast("string").alias("time")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(found[0]) == ("2019-03-10 02:30:00", texts[0], "2019-03", "2019-03-10 00:00:00", 1552185000000000)
    assert [r.time for r in found[1:]] == [None] * 4
    assert [r.time for r in same] == ["2019-03-10 02:30:00"] * 3 + ["2019-03-10 02:30:00"]


@pytest.mark.parametrize("delimiter", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, delimiter):
    path = tmp_path / "table.txt"
    rows = [["a", "b", "c"], ["1", '"x,;|y"', "2"], ["3", "z", "4"]]
    path.write_text("\n".join(delimiter.join(r) for r in rows) + "\n")
    found = files.detect_delimiter(spark, str(path)).collect()
    assert [(r.delimiter, r.n_fields, r.share) for r in found] == [(delimiter, 3, 1.0)]


def test_no_delimiter(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("one\ntwo\n")
    assert files.detect_delimiter(spark, str(path)).count() == 0


def test_lines_and_sizes(spark, dirty):
    assert files.count_lines(spark, dirty).first().n_lines == 6
    found = files.list_files(spark, os.path.dirname(dirty), glob="*.csv").first()
    assert found.bytes == os.path.getsize(dirty)


def test_types_fit_every_row(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,name,price\n1,x,1.5\n2,y,2\n3000000000,z,late\n")
    types = source.infer_types(spark, str(path))
    assert [f.dataType.simpleString() for f in types] == ["bigint", "string", "string"]


def test_profile(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;name\n1;x\n2;\n2;y\n")
    (tmp_path / "b.csv").write_text("id;name\n7;z\n")
    (tmp_path / "c.csv").write_text("k,v\n1,2\n")
    rows = profile.profile(spark, str(tmp_path), glob="*.csv").collect()
    found = {(os.path.basename(r.file), r.metric, r.column): r.value for r in rows}
    assert found["a.csv", "delimiter", None] == ";"
    assert found["a.csv", "lines", None] == "4"
    assert found["a.csv", "bytes", None] == str(os.path.getsize(tmp_path / "a.csv"))
    assert found["a.csv", "missing", "name"] == "1"
    assert found["a.csv", "distinct", "id"] == "2"
    assert found["a.csv", "row 1", "name"] == "x"
    assert found["a.csv", "row 3", "name"] == "y"
    assert found["b.csv", "type", "id"] == "int"
    assert found["b.csv", "missing", "name"] == "0"
    assert found["b.csv", "lines", None] == "2"
    assert found["c.csv", "delimiter", None] == ","
    assert len(rows) == len(found)


def test_profiles_scan_once(spark, sf_dir):
    events = retail_events(spark, sf_dir, ["event_type", "product_id", "price", "user_session"])
    for df in (profile.distinct_counts(events), profile.cardinality_profile(events), distinct_values([events], ["event_type", "user_session"])):
        assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_column_profiles(spark):
    df = spark.createDataFrame([("é", 1, 0.0), (None, None, -0.0), ("b", 300, None)], "s string, i int, f float")
    assert {tuple(r) for r in profile.missing_counts(df).collect()} == {("s", 1), ("i", 1), ("f", 1)}
    assert {tuple(r) for r in profile.distinct_counts(df).collect()} == {("s", 2), ("i", 2), ("f", 1)}
    assert {r["column"]: r["bytes"] for r in profile.column_footprint(df).collect()} == {"s": 3, "i": 8, "f": 8, "(total)": 19}
    assert profile.cardinality_profile(df).first().use_dictionary is False
    types = {r["column"]: r.suggested for r in typing.suggest_types(df).collect()}
    assert types == {"i": "smallint", "f": "float"}
    narrowed = typing.apply_types(df, typing.suggest_types(df))
    assert narrowed.schema["i"].dataType.simpleString() == "smallint"


def test_suggested_types_of_nothing(spark):
    empty = spark.createDataFrame([], "i bigint, f double")
    assert {r["column"]: r.suggested for r in typing.suggest_types(empty).collect()} == {"i": "bigint", "f": "double"}


def test_narrowing(spark):
    df = spark.createDataFrame([(1,), (300,), (None,)], "i int")
    assert [r.i for r in typing.narrow(df, {"i": "tinyint", "absent": "int"}).collect()] == [1, None, None]
    assert typing.narrowing_losses(df, {"i": "tinyint"}).first().n_lost == 1


def test_describe(spark):
    found = typing.describe(spark.createDataFrame([], schema.EVENTS)).orderBy("position").collect()
    assert [r["column"] for r in found] == schema.EVENT_COLUMNS


def test_dictionary_round_trip(spark):
    a = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "v string, n int")
    b = spark.createDataFrame([("c", 4), ("a", 5)], "v string, n int")
    codes = build_dictionary([a, b], ["v"])
    assert {(r.value, r.code) for r in codes.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    for limit in (0, 1 << 20):
        encoded = encode(a, codes, ["v"], broadcast_bytes=limit)
        assert {tuple(r) for r in encoded.collect()} == {(1, 1), (0, 2), (None, 3)}
        back = decode(encoded, codes, ["v"], broadcast_bytes=limit)
        assert {tuple(r) for r in back.collect()} == {("b", 1), ("a", 2), (None, 3)}


def test_csv_round_trip(spark, sf_dir, tmp_path):
    events = retail_events(spark, sf_dir)
    path = str(tmp_path / "events")
    write_events_csv(events, path)
    back = source.read_events_csv(spark, path)
    assert back.exceptAll(events).count() == 0 and events.exceptAll(back).count() == 0
    target = str(tmp_path / "typed")
    convert_csv(spark, path, target)
    typed = spark.read.parquet(target)
    assert typed.schema["price"].dataType.simpleString() == "float"
    assert typed.count() == events.count()


def test_conversion_loses_no_id(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text(f"{HEADER}\n{GOOD}\n{GOOD.replace(',1,', ',3000000000,', 1)}\n")
    convert_csv(spark, str(path), str(tmp_path / "typed"))
    typed = spark.read.parquet(str(tmp_path / "typed"))
    assert {r.product_id for r in typed.collect()} == {1, 3000000000}
    assert typed.schema["user_id"].dataType.simpleString() == "int"


def test_partitioned_csv_obeys_its_options(spark, sf_dir, tmp_path):
    events = retail_events(spark, sf_dir, [*schema.EVENT_COLUMNS, "month"]).limit(50)
    for _ in range(2):
        write_events_csv(events, str(tmp_path / "m"), partition_by=["month"], mode="overwrite", delimiter="|")
    assert source.read_events_csv(spark, str(tmp_path / "m"), delimiter="|").count() == 50


def test_partitioned_write(spark, sf_dir, tmp_path):
    events = retail_events(spark, sf_dir, [*schema.EVENT_COLUMNS, "month"])
    path = str(tmp_path / "monthly")
    write_parquet(events, path, partition_by=["month"])
    folders = [f for f in os.listdir(path) if f.startswith("month=")]
    assert len(folders) == events.select("month").distinct().count()
    one = spark.read.parquet(path).where(F.col("month") == "1996-03")
    assert "PartitionFilters: [isnotnull(month" in one._jdf.queryExecution().toString()


def test_materialize_builds_once(spark, tmp_path):
    path = str(tmp_path / "once")
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    assert materialize(spark, path, build).count() == 5
    assert materialize(spark, path, build).count() == 5
    assert len(built) == 1


def test_other_tables_are_left_alone(spark, tmp_path):
    path = tmp_path / "empty"
    path.mkdir()
    assert materialize(spark, str(path), lambda: spark.range(3)).count() == 3
    os.remove(path / "_SUCCESS")
    with pytest.raises(RuntimeError):
        materialize(spark, str(path), lambda: spark.range(1))
    assert spark.read.parquet(str(path)).count() == 3


def test_sums_of_small_and_odd_prices(spark):
    rows = [("s", 0.004), ("s", 0.004), ("t", float("inf")), ("t", 2.5), ("t", float("nan")), ("u", None)]
    events = spark.createDataFrame(rows, "user_session string, price double").selectExpr(
        "timestamp_ntz'2019-10-01 00:00:00' AS event_time", "'view' AS event_type", "1L AS product_id", "1L AS category_id", "price", "user_session"
    )
    found = {r.user_session: r for r in session_aggregate(events).collect()}
    assert (found["s"].avg_price_viewed, found["s"].max_price_viewed) == (0.004, 0.004)
    assert (found["t"].avg_price_viewed, found["t"].max_price_viewed) == (2.5, 2.5)
    assert found["u"].avg_price_viewed is None
    assert category_aggregate(events).first().total_sales == 2.508
    summary = price_summary(events, exact=True).first()
    assert (summary.min_price, summary.max_price, summary.median_price) == (0.004, 2.5, 0.004)
    assert summary.avg_price == pytest.approx(2.508 / 3)


def test_stage_goes_to_the_shared_folder(spark):
    stored = stage(spark.range(3), "probe")
    assert all(f.startswith("file:") and shared_root(spark).split(":")[-1] in f for f in stored.inputFiles())
    assert path_exists(spark, shared_root(spark))


@pytest.fixture
def several_lines(tmp_path):
    """A record over two lines, one with \\x01 in it, and a bad one of each kind over two lines."""
    records = [
        GOOD,
        '2019-10-01 00:00:01 UTC,view,2,10,"a\nb",acme,1.25,7,s2',
        "2019-10-01 00:00:02 UTC,view,3,10,a\x01b,acme,1.25,7,s3\x01x",
        'yesterday,view,4,10,"c\nd",acme,1.25,7,s4',
        '2019-10-01 00:00:04 UTC,view,oops,10,"e\nf",acme,1.25,7,s5',
        '2019-10-01 00:00:05 UTC,view,6,10,"g\nh",acme,1.25,7,s6,more',
        "yesterday\x01,view,7,10,x,acme,1.25,7,s7",
    ]
    (tmp_path / "odd name").mkdir()
    (tmp_path / "odd name" / "2019-Dec.csv").write_text("\n".join([HEADER, *records]) + "\n")
    (tmp_path / "odd name" / "2019-Nov.csv").write_text(f"{HEADER}\n{GOOD}\n")
    return str(tmp_path / "odd name"), records


def test_records_over_several_lines(spark, several_lines):
    folder, records = several_lines
    kept = source.read_events_csv(spark, folder, on_bad="drop").orderBy("product_id").collect()
    assert [(r.product_id, r.category_code, r.user_session) for r in kept] == [(1, "a.b", "s1")] * 2 + [(2, "a\nb", "s2"), (3, "a\x01b", "s3\x01x")]
    good, bad = source.split_quarantine(source.read_events_csv(spark, folder, on_bad="quarantine"))
    assert good.count() == 4
    assert {r._corrupt_record for r in bad.collect()} == set(records[3:])
    assert {r.product_id for r in bad.collect()} == {4, None, 6, 7}
    lenient = source.read_events_csv(spark, folder, on_bad="lenient").collect()
    assert sorted((r.product_id or 0, r.category_code) for r in lenient) == [(0, "e\nf"), (1, "a.b"), (1, "a.b"), (2, "a\nb"), (3, "a\x01b"), (4, "c\nd"), (7, "x")]
    with pytest.raises(Exception, match="MALFORMED"):
        source.read_events_csv(spark, folder).collect()
    tagged = source.with_source_tag(source.read_events_csv(spark, folder, on_bad="drop"), r"([^/]+)\.csv$")
    assert {tuple(r) for r in tagged.groupBy("month").count().collect()} == {("2019-Dec", 3), ("2019-Nov", 1)}
    assert source.read_events_csv(spark, folder, on_bad="drop", multiline=True).count() == 4


def test_scans_read_what_is_wanted(spark, dirty):
    """Without a verdict only the columns wanted are read; with one, all, for all policies in one scan of typed columns."""
    plan = lambda **k: source.read_events_csv(spark, dirty, columns=["event_type", "price"], **k)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string,price:double>" in plan(on_bad="trust")
    assert "ReadSchema: struct<event_time:string,event_type:string,price:double,_corrupt_record:string>" in plan(on_bad="lenient")
    for policy in ("fail", "drop"):
        text = plan(on_bad=policy)
        assert text.count("FileScan") == 1 and "from_csv" not in text and "product_id:bigint" in text


def test_trust_reads_without_a_verdict(spark, dirty):
    rows = source.read_events_csv(spark, dirty, on_bad="trust", columns=["product_id", "user_session"]).collect()
    assert [(r.product_id, r.user_session) for r in rows] == [(1, "s1"), (2, None), (3, "s1"), (None, "s1"), (5, "s1")]


def test_profiles_read_new_files_only(spark, tmp_path):
    """Counts are exact and sketches near over all files; what has been profiled is not read again, unless it changed."""
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    read = []

    def rows(paths):
        read.append(sorted(os.path.basename(p) for p in paths))
        return spark.read.schema("k long, s string").option("header", True).csv(paths)

    def step():
        states = files.file_states(spark, str(folder), "*.csv")
        n = profile.add_to_profile(rows, states, store)
        return n, {r.column: (r.n_rows, r.n_missing, r.n_distinct) for r in profile.stored_profile(spark, store, states).collect()}

    for k in range(3):
        (folder / f"{k}.csv").write_text("k,s\n" + "".join(f"{i},{'' if i % 5 == 0 else i % 100}\n" for i in range(k * 1000, k * 1000 + 2000)))
    n, found = step()
    assert n == 3 and found["k"][:2] == (6000, 0) and found["s"][:2] == (6000, 1200)
    assert abs(found["k"][2] - 4000) < 160 and abs(found["s"][2] - 80) <= 3
    assert step() == (0, found)
    (folder / "3.csv").write_text("k,s\n9000,x\n")
    (folder / "4.csv").write_text("k,s\n")
    n, found = step()
    assert n == 2 and found["k"][0] == 6001 and step()[0] == 0
    (folder / "3.csv").write_text("k,s\n9000,x\n9001,y\n9002,z\n")
    os.utime(folder / "3.csv", (2_000_000_000, 2_000_000_000))
    n, found = step()
    assert n == 1 and found["k"][0] == 6003
    last = {r.column: r.n_rows for r in profile.stored_profile(spark, store).collect()}
    assert last == {"k": 6003, "s": 6003}
    assert read == [["0.csv", "1.csv", "2.csv"], ["3.csv", "4.csv"], ["3.csv"]]


def test_profiles_of_files_sum_rows_as_they_are(spark, tmp_path):
    """a row is not laid out by column before it is summed."""
    spark.createDataFrame([(1, 0.0), (1, -0.0), (None, 2.0)], "k long, x double").coalesce(1).write.parquet(str(tmp_path / "t"))
    found = profile._file_columns(spark.read.parquet(str(tmp_path / "t")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Aggregate")
    rows = found.select("column", "n_rows", "n_missing", F.hll_sketch_estimate("sketch").alias("n")).collect()
    assert sorted(map(tuple, rows)) == [("k", 3, 1, 1), ("x", 3, 0, 2)]


def test_distinct_counts_of_all_types(spark):
    row = "1Y, 300S, 70000, 5000000000L, true, 0.0D, 1.5F, '1', DATE '2020-01-01', TIMESTAMP_NTZ '2020-01-01 00:00:00.000001', X'00', 1.10BD"
    other = "1Y, 300S, 70000, 5000000000L, true, -0.0D, 1.5F, '01', DATE '2020-01-01', TIMESTAMP_NTZ '2020-01-01 00:00:00.000002', X'0000', 1.2BD"
    nulls = ", ".join(["NULL"] * 12)
    df = spark.sql(f"SELECT * FROM VALUES ({row}), ({other}), ({nulls}), ({nulls}) AS t(a, b, c, d, e, f, g, h, i, j, k, l)")
    found = {r.column: r.n_distinct for r in profile.distinct_counts(df).collect()}
    assert found == dict(zip("abcdefghijkl", [1, 1, 1, 1, 1, 1, 1, 2, 1, 2, 2, 2], strict=True))


def test_price_sketches_merge(spark, sf_dir):
    """Sketches by month, united, give the whole table's median within the stated rank."""
    events = retail_events(spark, sf_dir, ["price", "month"])
    parts = stage(summaries.price_sketches(events, ["month"]), "sketches")
    assert parts.count() > 50
    found = summaries.merge_price_sketches(parts).first()
    exact = price_summary(events, exact=True).first()
    assert (found.min_price, found.avg_price, found.max_price) == (exact.min_price, exact.avg_price, exact.max_price)
    below, n = events.agg(F.count_if(F.col("price") < found.median_price), F.count("price")).first()
    assert abs(below / n - 0.5) < 0.01
    none = spark.createDataFrame([(None, "m"), (float("nan"), "m")], "price double, month string")
    assert summaries.merge_price_sketches(summaries.price_sketches(none, ["month"])).first().median_price is None


def test_a_folder_per_file(spark, tmp_path):
    """Every input file keeps its name, whatever its rows."""
    (tmp_path / "in").mkdir()
    for name, n in (("2019-Oct", 3), ("2019-Nov", 2)):
        (tmp_path / "in" / f"{name}.csv").write_text("\n".join([HEADER, *[GOOD] * n]) + "\n")
    convert_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"), per_file=True)
    assert {f for f in os.listdir(tmp_path / "out") if f.startswith("file=")} == {"file=2019-Oct", "file=2019-Nov"}
    counts = spark.read.parquet(str(tmp_path / "out")).groupBy("file").count().collect()
    assert {tuple(r) for r in counts} == {("2019-Oct", 3), ("2019-Nov", 2)}


def test_unreadable_files(spark, tmp_path):
    """A broken archive stops the read, or is passed over; the category job goes on with the others."""
    import gzip

    packed = gzip.compress("\n".join([HEADER, *[GOOD] * 20_000]).encode())
    (tmp_path / "a.csv.gz").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "b.csv").write_text("\n".join([HEADER, GOOD, GOOD]) + "\n")
    with pytest.raises(Exception):
        source.read_events_csv(spark, str(tmp_path), on_bad="lenient").count()
    kept = source.read_events_csv(spark, str(tmp_path), on_bad="drop", unreadable="skip")
    by_file = dict(tuple(r) for r in source.with_source_tag(kept, r"([^/]+?)\.csv", "file").groupBy("file").count().collect())
    assert by_file["b"] == 2 and by_file.get("a", 0) < 20_000
    with pytest.raises(ValueError):
        source.read_events_csv(spark, str(tmp_path), unreadable="maybe")


READABLE = ["", " ", "1", " 1 ", "+1", "-1", "\t1\n", "\x7f1", "\x851", "1 ", "١", "１", "﻿1", "1.5", ".5", "1.", ".", "-", "+", "--1", "1 2", "1_2", "00", "2147483648", "-9223372036854775809"]
READABLE += ["1e3", "1E+5", "1e", "1d", "1f", "1L", "0x1p3", "NaN", "+nan", "inf", "-Infinity", "+INF", "infinityx", "i", "t", "T", "true", "TRUE ", "\nyes", "on", "No", "f", "0", "10", "truey"]
READABLE += ["2019", "12345", "294247", "294248", "294999", "295000", "299999", " 300000", "+999999", "-299999", "-290308", "100000", "1000000", "2019-10", "+295000-01-01", "2019-10-01 00:00:00 UTC", "10:00", "T1:2", "now", "epoch"]


def test_texts_are_read_as_a_cast_reads_them(spark):
    rows = spark.createDataFrame([(v,) for v in READABLE] + [(None,)], "v string")
    for dtype in profile.TEXT_TYPES:
        cast, read = F.col("v").try_cast(dtype).cast("string"), profile.read_as(F.col("v"), dtype).cast("string")
        assert rows.where(~cast.eqNullSafe(read)).collect() == []
        assert not rows.where(read.isNotNull()).isEmpty()
