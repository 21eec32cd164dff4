"""Queries over whole inputs: what a prefix or a fixed subset of rows would lose."""

from __future__ import annotations

import duckdb
from conftest import SF
from pyspark.sql import functions as F

from leafmark import registry
from leafmark.streaming import jobs

QUERIES = registry.queries()


def test_labels_below_a_long_text(spark, tmp_path):
    long = "one line of prose\n" * 50
    rows = [(1, long), (2, long), (5, f"IFI Fatherhood\nGrade School\n{long}Email"), (11, long), (6, long), (12, "father\nfather")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    forms = {r["doc_id"]: (r["typed"], r["scanned"]) for r in QUERIES["form_detect_whole"](spark, str(tmp_path)).collect()}
    assert forms[5] == (True, True) and forms[11] == (False, False) and forms[1] == (True, True)
    # The share of overlay lines is that of all lines.
    overlay = {r["doc_id"]: r["overlay"] for r in QUERIES["nav_overlay_whole"](spark, str(tmp_path)).collect()}
    assert not overlay[6] and overlay[12]


def test_best_text_chooses_among_whole_texts(spark, tmp_path):
    strong, weak = ("we two read all of it again " * 2000).strip(), "we two read all of it again and again at his house"
    short, wordy = "one\n" * 6, "a b c d e f\n" * 6
    rows = [(28, short + strong), (40, wordy + weak), (27, wordy + weak), (39, strong), (76, "few words"), (88, None)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as source").write.parquet(str(tmp_path / "documents.parquet"))
    for name, columns in (("customer", "c_custkey long, c_nationkey long"), ("nation", "n_nationkey long, n_name string")):
        spark.createDataFrame([], columns).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r["doc_id"]: (r["source"], r["n"]) for r in QUERIES["best_text"](spark, str(tmp_path)).collect()}
    # A weak essay gives way to an extracted text with enough words, but not to the whole form.
    assert got == {
        28: ("a", len(strong)),
        40: ("b", len(wordy + weak)),
        27: ("a", len(weak)),
        39: ("c", len("Hana Ember\nHill 9th grade\n" + strong)),
        76: ("b", 9),
        88: ("none", 0),
    }


def test_best_text_of_odd_rows(spark, same, tmp_path):
    line, short = "we two read all of it again and again at his house", "one\n" * 6
    rows = [(28, short + line), (28, short + line), (28, "a b c d e f\n" * 9 + line), (28, line), (28, None), (27, None), (None, line), (-4, line), (0, ""), (1, " \n\t"), (12, "a\r\nb\rc")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as source").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name, columns in (("customer", "c_custkey long, c_nationkey long"), ("nation", "n_nationkey long, n_name string")):
        spark.createDataFrame([], columns).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.sql(f"create table {name} ({columns})")
    got = QUERIES["best_text"](spark, str(tmp_path))
    assert got.count() == len(rows)
    same(got, con.sql(registry.oracle_sql()["best_text"]))


def test_signals_of_every_page(spark, tmp_path):
    rows = [(1, 0, "assistant", "word " * 40 + "\nSchool: Hill"), (1, 1, "assistant", "word " * 40 + "7th grade"), (1, 2, "assistant", "Alva Brook")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["startpage_signals_pages"](spark, str(tmp_path)).orderBy("page_index").select("boilerplate", "name", "grade", "school").collect()
    assert [tuple(r) for r in got] == [(True, False, False, True), (False, False, True, False), (False, True, False, False)]


def test_every_batch_gets_its_reader(spark):
    d = SF.replace("0.001", "0.01")
    groups = spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 12 >= 1").groupBy((F.col("o_custkey") % 7).alias("school"), "o_orderpriority").count()
    batches = groups.agg(F.sum(F.ceil(F.col("count") / 30))).first()[0]
    assert 12 * groups.count() < batches
    for name in ("pair_readers", "pair_all_readers"):
        assert QUERIES[name](spark, d).count() > 12 * groups.count()


def test_created_readers_follow_the_rankings(spark, tmp_path):
    spark.createDataFrame([(k, f"n{k}") for k in range(60)], "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    ranks = [(1, k, 1, 1) for k in range(300)] * 2
    spark.createDataFrame(ranks, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = QUERIES["readers_merge_all"](spark, str(tmp_path)).groupBy("origin").count().collect()
    assert {r["origin"]: r["count"] for r in got} == {"known": 60, "created": 240}


def test_window_at_every_hour(spark, tmp_path):
    rows = spark.sql("select 1L as event_id, 1L as user_id, 'click' as event_type, timestamp '2024-01-02 05:30:00' as ts, 1.0 as value, '{}' as props")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    starts = sorted(r["window_start"][:16] for r in QUERIES["queue_window_hourly"](spark, str(tmp_path)).collect())
    assert len(starts) == 24 and (starts[0], starts[-1]) == ("2024-01-01 06:00", "2024-01-02 05:00")


def test_newest_jobs(spark):
    latest = spark.range(30).selectExpr("id as job_id", "timestamp_seconds(id) as created_at", "if(id % 2 = 0, 'queued', 'failed') as status").where("job_id <> 25")
    assert {r["status"]: r["n"] for r in jobs.newest_status(latest).collect()} == {"queued": 5, "failed": 5}
