"""What keeps the work of a row small and spread, whatever the bytes of the table."""

import gzip
import io
import random
import zlib
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from caseflow import fixed_values as V
from caseflow import functions as C
from caseflow.operators import contacts as K
from caseflow.operators.balances import read_settlements
from caseflow.operators.match import _name_keys
from caseflow.plans import load_queries
from caseflow.sources.io import file_digests
from caseflow.streaming import stream as T

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode="simple")
    return out.getvalue()


def run(spark, name):
    return next(q for q in load_queries().values() if q.name == name).run(spark, SF)


def test_names_are_taken_apart_on_all_tasks(spark):
    for name in ("name_forms", "name_like_cells"):
        assert run(spark, name).rdd.getNumPartitions() == 4


def test_a_name_is_taken_apart_once(spark):
    assert plan(run(spark, "name_forms")).count(V.NAME_SUFFIX) == 1


def test_a_label_is_stripped_once(spark):
    assert plan(run(spark, "stripped_labels")).count("demerit\\(s\\)") == 1


def test_a_date_shape_is_sought_once(spark):
    df = spark.createDataFrame([("1 Sep 26",)], "v string").select(C.parse_date("v").alias("d"))
    text = plan(df)
    assert text.count(V.DATE_YMD) == 1 and text.count(V.DATE_MDY) == 1


def test_dates_with_other_numbers_and_gaps(spark):
    rows = ["x 12Sep2026 3", "Sep  3rd,  26", "Sep__3 26", "1 Foo 2026 May 2 2027", "99/1/2/2026", "20260916\u0085", "2026.9/16", "3 -Sept. -,2026"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    got = [str(r.d) for r in df.select("i", C.parse_date("v").alias("d")).orderBy("i").collect()]
    assert got == ["2026-09-12", "2026-09-03", "2026-09-03", "2027-05-02", "2026-01-02", "2026-09-16", "2026-09-16", "2026-09-03"]


def test_a_name_of_two_words_has_the_keys_of_one_reading(spark):
    df = spark.createDataFrame([("An Doe",), ("Doe An",)], "v string")
    keys = [sorted(r.k) for r in df.select(_name_keys(C.name_parts("v")).alias("k")).collect()]
    assert len(keys[0]) == 9 and keys[0] == keys[1]


def test_settlement_rows_are_read_on_all_tasks(spark):
    rows = [("s", 1, ["Date Served", "Cadet Name", "Sanction Type", "Amount Served"]), ("s", 2, ["1 Sep 26", "An Doe", "Tour", "2"])]
    cells = spark.createDataFrame(rows, "sheet string, row_no bigint, cells array<string>").coalesce(1)
    got = read_settlements(cells)
    assert got.rdd.getNumPartitions() == 4 and [(r.cadet, r.units) for r in got.collect()] == [("An Doe", 2.0)]


def test_neighbouring_cases_share_a_state(spark, tmp_path):
    ids = [-257, -1, 0, 255, 256, 2**53 + 1, None]
    flags = [(False, True), (None, True), (True, False), (False, None), (False, True), (False, True), (False, True)]
    rows = [(c, "s", f[n], n, 10 * n + i) for i, (c, f) in enumerate(zip(ids, flags)) for n in (0, 1)]
    df = spark.createDataFrame(rows, "case_id bigint, step string, flag boolean, t bigint, seq bigint").select("case_id", "step", "flag", F.timestamp_seconds("t").alias("ts"), "seq")
    for n in (0, 1):
        df.where(F.col("seq").between(10 * n, 10 * n + 9)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = T.announce(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    assert "shiftright" in stream._jdf.queryExecution().analyzed().toString()
    got = {(r.case_id, r.step, r.seq) for r in T.run_to_table(stream, "near").collect()}
    assert got == {(ids[i], "s", 10 + i) for i in (0, 1, 4, 5, 6)}


def test_checksums_of_files_are_put_together_from_splits(spark, tmp_path):
    rng = random.Random(3)
    noise = bytes(rng.randrange(256) for _ in range(20_000))
    files = {
        "a.bin": noise, "b.bin": noise + b"\n", "c.bin": b"\n" * 5000, "d.bin": b"", "e.bin": b"\n", "f.bin": b"\xef\xbb\xbf" + noise, "g.bin": b"\xef\xbb\xbfx\n",
        "h.bin": b"no break " * 900, "i.bin": b"a\r\nb\r" * 1000, "j.bin.gz": gzip.compress(noise), "k.bin": bytes(7000), "l 1%20é.bin": noise[:3000],
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        got = {r.path: (r.size, r.checksum) for r in file_digests(spark, str(tmp_path), "*.*").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tasks > 50
    assert got == {name: (len(body), f"{zlib.crc32(body):08x}") for name, body in files.items() if body}


def test_only_columns_that_are_asked_for_are_taken_apart(spark, monkeypatch):
    cells = spark.createDataFrame(
        [("a", 0, ["Last", "", "First", None]), ("a", 1, [" ", "x", "n@b.example.com", "y"]), ("a", 2, ["p", "q", "r", "s"]), ("a", 3, ["late", "late", "late"]), ("b", 0, ["no", "one", "asks"])],
        "sheet string, row int, cells array<string>")
    wanted = spark.createDataFrame([("a", 0, 2), ("a", 2, 2), ("a", 3, 2), ("a", 0, 0), ("a", 7, 2), ("c", 0, 1)], "sheet string, col int, row int")
    seen, last = [], K.running_last
    monkeypatch.setattr(K, "running_last", lambda df, *a: (seen.append(df.where("side = 0").count()), last(df, *a))[1])
    for most in (K.SENT_COLUMNS, 0):
        monkeypatch.setattr(K, "SENT_COLUMNS", most)
        got = {(r.sheet, r.col, r.row): r.header for r in K._headers(cells, wanted).collect()}
        assert got == {("a", 0, 2): "last", ("a", 2, 2): "first", ("a", 3, 2): "", ("a", 0, 0): "", ("a", 7, 2): "", ("c", 0, 1): ""}
    assert seen == [2, 2]
