"""Operators against brute force, plain windows and literal cases."""

import itertools
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from caseflow.functions import dice, name_distance
from caseflow.operators import balances as B
from caseflow.operators import contacts as K
from caseflow.operators import digest as D
from caseflow.operators import match as M
from caseflow.operators import reconcile as X
from caseflow.operators import reports as R
from caseflow.operators import scale as S
from caseflow.sources import io
from caseflow.streaming import stream as T


def edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def mutate(rng, s, n):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[i] = rng.choice("abc")
        elif kind == 1:
            del s[i]
        else:
            s.insert(i, rng.choice("abc"))
    return "".join(s)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    seeds = ["".join(rng.choice("abc") for _ in range(n)) for n in (4, 6, 9, 24, 25, 26, 27, 28, 40, 41)]
    common = "x" * 14
    names = {mutate(rng, s, rng.randrange(4)) for s in seeds for _ in range(12)}
    names |= {common + mutate(rng, s, 1) for s in seeds[3:] for _ in range(6)}
    names = {n for n in names if len(n) >= 4} | {"Abcd", "abcd", "abc"}
    want = {(a, b) for a, b in itertools.combinations(sorted(names), 2)
            if a.lower() != b.lower() and min(len(a), len(b)) >= 4 and edits(a.lower(), b.lower()) <= 2}
    df = spark.createDataFrame([(n, 1) for n in names], "name string, n int")
    for hot in (1000, 3):
        got = {(r.a, r.b) for r in M.near_duplicate_names(df, hot_piece=hot).collect()}
        assert got == want


def test_name_pairs_equal_brute_force(spark):
    rng = random.Random(9)
    given, family = ["john", "joan", "jon", "amelia", "amelie", "al", "wu"], ["doe", "dow", "hernandez", "hernandes", "smith", "smyth", "li"]
    names = sorted({f"{mutate(rng, g, rng.randrange(2))} {mutate(rng, f, rng.randrange(3))}" for g in given for f in family}
                   | {"Doe, John A", "cher", "Cher", "john amelia doe", ""})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.name, r.candidate, r.dist) for r in M.name_pairs(df, df).collect()}
    both = df.crossJoin(df.withColumnRenamed("name", "candidate")).withColumn("dist", name_distance("name", "candidate"))
    assert got == {(r.name, r.candidate, r.dist) for r in both.where("dist <= 2").collect()}
    assert len(got) > len(names)


def test_candidate_similarities_are_computed_once_per_pair(spark):
    row = [("a", "smith late", "Smith_late.pdf", "x", "F10", "smith", "late")]
    df = spark.createDataFrame(row, "id string, fname string, filename string, sha1 string, form_type string, recipient_name string, reason string")
    fields = {"recipient_name": 3.0, "reason": 2.0}
    part = df.selectExpr(*[f"{c} AS P_{c}" for c in df.columns], *[f"split({c}, '') AS P_{c}_g" for c in ("fname", *fields)])
    it, ct = (part.toDF(*[c.replace("P_", p) for c in part.columns]) for p in ("i_", "c_"))
    plan = M._candidates(it, ct, fields, list(fields), 0.5, None, None, False)._jdf.queryExecution().optimizedPlan().toString()
    scoring = "\n".join(line for line in plan.split("\n") if "i_fname_g" in line)
    assert scoring.count("array_intersect") == 1 + len(fields)


def test_sides_of_similar_values_meet_each_other_only(spark, monkeypatch):
    rows = [("smith late", True, False), ("smith lato", True, False), ("smith latte", False, True), ("smith lat", True, True), ("smyth lat", True, True)]
    df = spark.createDataFrame(rows, "v string, i boolean, c boolean")
    both = df.alias("x").join(df.alias("y"), (F.col("x.i") & F.col("y.c"))).select(F.col("x.v").alias("a"), F.col("y.v").alias("b")).withColumn("d", dice("a", "b"))
    want = {(r.a, r.b): round(r.d, 9) for r in both.where("d >= 0.5").collect()}
    for few in (1_000_000, 0):
        monkeypatch.setattr(M, "FEW_MEMBERS", few)
        got = [(r.a, r.b, round(r.dice, 9)) for r in M.similar_values(df, 0.5).collect()]
        assert len(got) == len(want) and {(a, b): d for a, b, d in got} == want


def test_equally_near_boxes_tie_whatever_their_last_bit(spark):
    """0.1 + 0.2 and 0.3 are one distance: the smaller box wins, though its distance is the larger number."""
    words = spark.createDataFrame([(1, 1, "a", 0.0, 0.0)], "page int, word_no int, word string, cx double, cy double")
    boxes = spark.createDataFrame([(1, "wide", 0.3, 0.0, 0.9, 0.1), (1, "small", 0.1 + 0.2, 0.0, 0.5, 0.1)], "page int, box string, x0 double, y0 double, x1 double, y1 double")
    assert [r.box for r in M.assign_words(words, boxes, 0.4).collect()] == ["small"]


def test_keys_and_parts_of_names_are_not_sent_to_the_driver(spark):
    df = spark.createDataFrame([("John Doe", 1), ("Jon Doe", 2)], "name string, ord int")
    for got in (M.name_pairs(df, df), M.best_match(df, df)):
        assert "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()


def test_best_match_cases(spark):
    known = spark.createDataFrame([("John Doe", 1), ("Jane Smith", 2), ("Jon Dow", 3)], "name string, ord int")
    left = spark.createDataFrame([("Doe, John",), ("Jane Smyth",), ("Jan Doe",), ("Nobody Onfile",)], "name string")
    got = {r.name: (r.match, r.dist, r.ambiguous) for r in M.best_match(left, known).collect()}
    assert got["Doe, John"] == ("John Doe", 0, False) and got["Jane Smyth"] == ("Jane Smith", 1, False)
    assert "Nobody Onfile" not in got
    ruled = spark.createDataFrame([("jane smith", "JANE SMYTH")], "a string, b string")
    assert "Jane Smyth" not in {r.name for r in M.best_match(left, known, distinct_pairs=ruled).collect()}


def test_similar_values_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["john doe neg f10 late", "jane smith pos f10 service", "aaaa aaaa aaaa", "x", "xy", "kevin lee neg f174 uniform"]
    vals = sorted({mutate(rng, b, rng.randrange(5)) if len(b) > 5 else b for b in base for _ in range(8)})
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    brute = df.withColumnRenamed("v", "a").crossJoin(df.withColumnRenamed("v", "b")).withColumn("d", dice("a", "b"))
    for t in (0.3, 0.6, 0.85):
        got = {(r.a, r.b): round(r.dice, 9) for r in M.similar_values(df, t).collect()}
        assert got == {(r.a, r.b): round(r.d, 9) for r in brute.where(F.col("d") >= t).collect()}


def test_candidate_threshold():
    fields = {"recipient_name": 3.0, "date": 2.0, "class_year": 0.5}
    assert abs(M.candidate_threshold(fields, list(fields), 0.3) - 0.3) < 1e-6
    assert M.candidate_threshold(fields, ["recipient_name"], 0.3) < 0  # date and year alone reach 0.3


def test_running_total_and_last_equal_plain_windows(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.randrange(5), rng.choice([None, "x", "y"])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, v int, s string").withColumn("v", F.col("v").cast("bigint"))
    w = W.partitionBy("k").orderBy("i")
    bucket = F.floor(F.col("i") / 7)
    a = S.running_total(df, ["k"], [F.col("i")], bucket, F.col("v"), "t")
    b = df.withColumn("t", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)))
    assert sorted(map(tuple, a.select("k", "i", "t").collect())) == sorted(map(tuple, b.select("k", "i", "t").collect()))
    a = S.running_last(df, ["k"], [F.col("i")], bucket, F.col("s"), "p")
    b = df.withColumn("p", F.last("s", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    assert sorted(map(str, a.select("k", "i", "p").collect())) == sorted(map(str, b.select("k", "i", "p").collect()))


def test_capped_pick_equals_greedy(spark):
    rng = random.Random(2)
    rows = [("hot", i, i, rng.randrange(1, 60)) for i in range(80)] + [("small", i, 100 + i, 5) for i in range(3)] + [("big", 1, 200, 500)]
    df = spark.createDataFrame(rows, "party string, ord int, item int, size bigint")
    want = set()
    for party in ("hot", "small", "big"):
        used = n = 0
        for p, o, item, size in sorted(r for r in rows if r[0] == party):
            if n < 4 and used + size <= 100:
                want.add((p, item))
                used, n = used + size, n + 1
    got = {(r.party, r.item) for r in D.capped_pick(df, 4, 100, salts=3).collect()}
    assert got == want


def test_sheets_without_headings_are_skipped_by_name(spark):
    head = ["Date Served", "Cadet Name", "Sanction Type", "Amount Served"]
    line = ["2026-09-02", "Doe, John", "Tour", "1"]
    rows = [("good", 1, head), ("good", 2, line), ("low", 61, head), ("low", 62, line), ("low", 63, ["", " "]), ("bare", 1, line), (None, 1, head), (None, 2, line)]
    got = B.read_settlements(spark.createDataFrame(rows, "sheet string, row_no bigint, cells array<string>"))
    assert {(r.sheet, r.row_no, r.cadet, r.skip_reason) for r in got.collect()} == {
        ("good", 2, "Doe, John", None), ("low", 61, "", "no_headings: low"), ("low", 62, "", "no_headings: low"),
        ("bare", 1, "", "no_headings: bare"), (None, 2, "Doe, John", None)}
    assert {r.skip_reason: r.n for r in B.skip_counts(got).collect()} == {"no_headings: low": 2, "no_headings: bare": 1}


def test_settlement_log_case(spark):
    head = ["", "Date Served", "Cadet Name", "Sanction Type", "Amount Served", "Supervisor / Monitor", "Notes"]
    body = [("2026-09-02", "Doe, John", "Tour", "1"), ("46268", "John Doe", "tour", "1"), ("2026-09-03", "John Doe", "Confinement", "2"),
            ("2026-09-04", "", "Tour", "3"), ("2026-09-04", "John Doe", "Detail", "3"), ("2026-09-04", "John Doe", "Tour", "0"),
            ("2026-09-05", "Nobody Onfile", "Tour", "2"), ("", "", "", "")]
    rows = [("log", 5, head)] + [("log", 6 + i, ["", *r, "", ""]) for i, r in enumerate(body)]
    got = B.read_settlements(spark.createDataFrame(rows, "sheet string, row_no bigint, cells array<string>"))
    assert {r.skip_reason: r.n for r in B.skip_counts(got).collect()} == {"unnamed": 1, "unknown_type": 1, "bad_amount": 1}
    good = got.where("skip_reason is null")
    assert [str(r.settled_on) for r in good.orderBy("row_no").collect()] == ["2026-09-02", "2026-09-03", "2026-09-03", "2026-09-05"]
    parties = spark.createDataFrame([("doe john", "John A Doe", 1)], "key string, name string, ord int")
    who = M.resolve_parties(good.select(F.col("cadet").alias("name")), parties)
    settled = good.join(who.select(F.col("name").alias("cadet"), "key"), "cadet").select(F.col("key").alias("party"), F.col("cadet").alias("name"), "kind", "units")
    a = spark.createDataFrame([("doe john", "John A Doe", 1, "2027", True, "Neg", "2026-09-12", 2.0, 1.0), ("doe john", "John A Doe", 2, "", False, "Neg", "2026-09-14", 9.0, 9.0)],
                              "party string, name string, ord int, class_year string, counted boolean, pos_neg string, d string, tours double, confinements double")
    a = a.withColumn("date_iso", F.col("d").cast("date"))
    b = B.balances(a, settled)
    john = b.where("party = 'doe john'").first()
    assert (john.tours_served, john.tours_left, john.confinements_left, john.confinements_over, john.forms) == (2.0, 0.0, 0.0, 1.0, 2)
    assert [r.name for r in B.unmatched(b).collect()] == ["Nobody Onfile"]
    none = settled.where("false")
    at = lambda d: B.balances(a, none, d).first().tours_left
    assert (at(None), at("2026-09-13"), at("2026-09-12")) == (2.0, 2.0, 0.0)


def test_contact_extraction_case(spark):
    rows = [
        ["Cadet", "Email", "Class"], ["Doe, John A.", "jdoe@school.edu", "2028"], ["2028", "Amy", "Wu", "amy.wu@school.edu"],
        ["Jane Q Public <jane@p.com>"], ["", "", "someone.else@z.org"], ["Lee, Kevin", "kevin@a.com; KEVIN2@A.COM"], ["no email on this row"],
    ]
    df = spark.createDataFrame([("s", i, r) for i, r in enumerate(rows)], "sheet string, row int, cells array<string>")
    known = spark.createDataFrame([("John Doe",), ("Amy Wu",)], "name string")
    got = {r.email: (r.name, r.guessed) for r in K.extract(df, known).collect()}
    assert got == {
        "jdoe@school.edu": ("Doe, John A.", False), "amy.wu@school.edu": ("Amy Wu", False), "jane@p.com": ("Jane Q Public", False),
        "someone.else@z.org": ("Someone Else", True), "kevin@a.com": ("Lee, Kevin", False), "kevin2@a.com": ("Lee, Kevin", False),
    }
    assert K.rows_with_address(df).first()[0] == 5
    titled = spark.createDataFrame([("t", 0, ["Surname", "Given", "Mail"]), ("t", 1, ["Wu", "Amy", "a@b.co"])], "sheet string, row int, cells array<string>")
    assert K.extract(titled).first().name == "Amy Wu"


def test_manifest_problems(spark):
    m = spark.createDataFrame([("metadata/a.json", 1, "x"), ("metadata/b.json", 2, "y"), ("dump/c.pdf", 3, "z")], "path string, size int, checksum string")
    e = spark.createDataFrame([("metadata/a.json", 1, "other"), ("dump/c.pdf", 3, "z"), ("dump/c.pdf", 3, "z"), ("metadata/../up", 1, "q"), ("dump/sub/d.pdf", 1, "q"), ("manifest.json", 1, "m")],
                              "path string, size int, checksum string")
    got = {(r.path, r.problem) for r in X.verify_manifest(m, e).collect()}
    assert got == {("metadata/a.json", "checksum differs"), ("metadata/b.json", "missing"), ("dump/c.pdf", "listed twice"),
                   ("metadata/../up", "unexpected path"), ("dump/sub/d.pdf", "unexpected path")}


def test_connected_spellings_latest_wins(spark):
    rows = [("jon doe", "john doe", "John Doe", 1), ("john doe", "john a doe", "John A Doe", 2), ("amy wu", "ami wu", "Amy Wu", 3)]
    got = {r.name: r.spelling for r in M.connected_spellings(spark.createDataFrame(rows, "a string, b string, spelling string, ord int")).collect()}
    assert got["jon doe"] == got["john doe"] == got["john a doe"] == "John A Doe" and got["ami wu"] == "Amy Wu"


def test_announcements_stream_equals_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.choice(["s1", "s2"]), rng.random() < 0.5, 1700000000 + i, i) for i in range(120)]
    df = spark.createDataFrame(rows, "case_id bigint, step string, flag boolean, t bigint, seq bigint").select("case_id", "step", "flag", F.timestamp_seconds("t").alias("ts"), "seq")
    for n in range(3):  # three files, one per micro-batch
        df.where((F.col("seq") >= n * 40) & (F.col("seq") < (n + 1) * 40)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.case_id, r.step, r.seq) for r in T.run_to_table(T.announce(stream), "t1").collect()}
    want = {(r.case_id, r.step, r.seq) for r in T.announce_batch(df, F.to_date("ts")).collect()}
    assert got == want and want


def test_snapshot_held_while_reading(spark):
    df = spark.createDataFrame([(1, False), (2, True)], "case_id int, pending boolean")
    assert T.hold_while_reading(df).count() == 0
    assert T.hold_while_reading(df.where("not pending")).count() == 1


def test_spellings_of_a_long_chain_end_in_one(spark):
    rows = [(f"n{i:03d}", f"n{i + 1:03d}", f"N{i + 1:03d}", i) for i in range(90)]
    got = M.connected_spellings(spark.createDataFrame(rows, "a string, b string, spelling string, ord int")).collect()
    assert len({r.root for r in got}) == 1 and {r.spelling for r in got} == {"N090"}


def test_capped_pick_keeps_items_of_one_place(spark):
    rows = [("p", 1, "a", 5), ("p", 1, "b", 5), ("p", 2, "c", 5), ("p", 3, "d", 5)]
    got = D.capped_pick(spark.createDataFrame(rows, "party string, ord int, item string, size long"), max_files=2, max_bytes=100).collect()
    assert sorted(r["item"] for r in got) == ["a", "b"]


def test_delimited_width_counts_records_not_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_text('name,note,mail\nDoe,"x\ny, ""z""",b@x.edu\nRoe,plain\n')
    rows = io.read_delimited(spark, f"file://{tmp_path}/x.csv").orderBy("row").collect()
    assert [r.cells for r in rows] == [["name", "note", "mail"], ["Doe", 'x\ny, "z"', "b@x.edu"], ["Roe", "plain", ""]]


def test_one_giver_serves_one_newcomer(spark):
    log = "array<struct<at: timestamp, what: string>>"
    flags = ", ".join(f"{f} boolean, {f}_at timestamp" for f in ("reviewed", "logged", "archived", "rejected"))
    kind = f"case_id long, filename string, sha1 string, ord int, overrides map<string,string>, {flags}, notes string, history {log}"
    at = datetime(2024, 5, 1)
    off = [None] * 8

    def newcomer(i, sha, known=None, over=None):
        return (i, f"f{i}", sha, i, over or {}, *off, "own", None, known)

    new = spark.createDataFrame([newcomer(1, "h"), newcomer(2, "h"), newcomer(3, "k"), newcomer(4, "m", "m"), newcomer(5, "m", None, {"name": "x"}), newcomer(6, None)], kind + ", known_sha1 string")
    on = [True, at, None, None, False, None, True, at]
    catalog = spark.createDataFrame([
        (9, "x", "h", 5, {"name": "Doe"}, *on, "note", [(at, "read")], True), (10, "y", "m", 6, {}, *off, "left", None, True), (11, "z", "k", 7, {}, *off, "there", None, False), (12, "n", None, 8, {}, *off, "null", None, True)],
        kind + ", missing boolean")
    got = {r.case_id: r for r in X.inherit_renames(new, catalog, F.lit("2024-06-01")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 10, 11, 12} and [got[i].inherited_from for i in sorted(got)] == [9] + [None] * 8
    one = got[1]
    assert (one.overrides, one.reviewed, one.reviewed_at, one.logged, one.archived, one.rejected, one.notes) == ({"name": "Doe"}, True, at, None, False, True, "note")
    assert [h.what for h in one.history] == ["read", "Renamed from x"] and (got[2].notes, got[2].history, got[10].notes) == ("own", None, "left")


def test_bulk_patch_is_one_row(spark):
    patch = spark.createDataFrame([({},), ({},)], "set map<string,string>")
    with pytest.raises(ValueError):
        X.bulk_patch(spark.range(1).toDF("case_id"), spark.range(1).toDF("case_id"), patch, F.lit("2024-06-01"))


def test_running_sum_of_one_day_uses_all_ranges(spark):
    """Undated cases only: ranges split by file name, and sums continue across them."""
    from caseflow.operators import scale

    rows = spark.range(500).selectExpr("id", "cast(null AS date) AS date_iso", "lpad(cast((id * 7919) % 1000003 AS string), 8, '0') AS filename", "1 + id % 5 AS page_count")
    got = sorted((r.filename, r.start_page) for r in R.packet_index(rows).collect())
    sheets, at, want = -(-500 // 41), 1, []
    for r in sorted(rows.collect(), key=lambda r: r.filename):
        want.append((r.filename, at + sheets))
        at += r.page_count
    assert got == want
    parts = scale.in_ranges(rows, [F.col("date_iso"), F.col("filename")]).groupBy("__part").count().collect()
    assert len(parts) == 4 and max(p["count"] for p in parts) < 250


def test_pages_by_index(spark):
    from caseflow.operators.scale import PageIndex

    rows = spark.range(1003).selectExpr("id", "(id * 7919) % 1009 AS k")
    order = sorted((r.k, r.id) for r in rows.collect())
    index = PageIndex(rows, [F.col("k")], 7)
    for page, size in [(0, 10), (3, 143), (99, 10), (100, 10), (0, 2000), (500, 10), (1, 700)]:
        assert [(r.k, r.id) for r in index.page(page, size).collect()] == order[page * size : (page + 1) * size]
    assert PageIndex(rows.limit(0), [F.col("k")]).page(0, 5).collect() == []
    plan = index.page(50, 10)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*__part", plan)


def test_rounds_over_several_batches_are_counted_whole(spark, tmp_path):
    at = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, r)"
    for k in range(3):  # round 0 has 20 parties in two files, round 3 five, round 6 twenty in two files
        spark.range(k * 10, k * 10 + 10).selectExpr("id AS party", f"if({k} < 2, 0, 3) AS r").selectExpr("party", f"{at} AS round").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("party bigint, round timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    where = [f"{tmp_path}/{x}" for x in ("open", "sent", "held")]
    T.send_or_hold(rows, *where, 12).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    T.close_rounds(spark, "party bigint, round timestamp", *where, 12)
    assert spark.read.parquet(where[1]).select("party").count() == 10 and spark.read.parquet(where[2]).select("party").distinct().count() == 20


def test_candidate_reasons_and_eligibility(spark):
    """Reasons by hand, who may be a candidate, and the bonus for a copy that came back for the step its case was sent for."""
    from caseflow.operators import match as M

    items = spark.createDataFrame([
        (1, "a b one", "a.pdf", "h1", "F10", "ann lee", "late for drill", "new", "issuer_signed"), (2, "a b one", "a.pdf", "h2", "F10", "ann lee", "late for drill", "found", "issuer_signed"),
        (3, "a b one", "a.pdf", "h1", "F10", "ann lee", "late for drill", "returned", "issuer_signed"), (4, "x y two", "b.pdf", "h4", "F174", "ann lee", "late for drill", "returned", "issuer_signed"),
        (5, "q", "c.pdf", "h5", "F10", "", "", "found", None)],
        "id long, fname string, filename string, sha1 string, form_type string, recipient_name string, reason string, kind string, step string")
    cases = spark.createDataFrame([
        (10, "a b one", "c10", "h1", "F10", "ann lee", "late for drill", False, False, True), (11, "a b one", "c11", "h9", "F10", "ann lee", "late for drill", True, False, True),
        (12, "a b one", "c12", "h9", "F10", "ann lee", "late for drill", False, True, True), (13, "a b one", "c13", "h9", "F10", "ann lee", "late for drill", False, False, False),
        (14, "a b one", "c14", "h8", "F10", "ann lee", "zzzz qqqq", None, None, None)],
        "id long, fname string, filename string, sha1 string, form_type string, recipient_name string, reason string, missing boolean, archived boolean, analysed boolean")
    sent = spark.createDataFrame([(14, "issuer_signed"), (10, "recipient_signed")], "case_id long, step string")
    fields = {"recipient_name": 3.0, "reason": 2.0}
    got = {(r.item_id, r.case_id): (r.score, r.rank, list(r.why), r.identical) for r in M.document_candidates(items, cases, fields, sent=sent).collect()}
    assert set(k for k, _ in got) == {2, 3} and set(c for _, c in got) == {10, 14}
    assert got[2, 10] == (1.0, 1, ["same file name", "same recipient, reason"], False)
    assert got[2, 14] == (0.78, 2, ["same file name", "same recipient", "different reason"], False)
    assert got[3, 10] == (1.0, 1, ["identical to the copy on file"], True)
    assert got[3, 14] == (0.93, 2, ["same file name", "same recipient", "different reason", "was sent for Issuer signature"], False)


def test_similar_texts_of_any_size_and_place(spark):
    """All pairs by brute force; changed openings, cut ends, long texts, nulls."""
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdef gh") for _ in range(rng.randint(2, 60))) for _ in range(12)]
    left = [(i, t) for i, t in enumerate(base)] + [(20 + i, "zz " + t[3:]) for i, t in enumerate(base)] + [(40, base[0] * 30), (41, ""), (42, None), (43, "a")]
    right = [(100 + i, t[: len(t) - i]) for i, t in enumerate(base)] + [(120, base[1]), (121, ""), (122, None), (123, "a")]
    kind = "key long, s string"
    for t in (0.5, 0.8):
        got = {(r.left, r.right): r.dice for r in M.similar_texts(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), t).collect()}

        def dice_of(x, y):
            if not x or not y:
                return 0.0
            if x == y:
                return 1.0
            g = [[s[i : i + 2] for i in range(len(s) - 1)] for s in (x, y)]
            return 2 * sum(min(g[0].count(k), g[1].count(k)) for k in set(g[0])) / (len(g[0]) + len(g[1])) if g[0] and g[1] else 0.0

        want = {(a, b): dice_of(x, y) for a, x in left for b, y in right if dice_of(x, y) >= t}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_form_table_holds_file_parts_once(spark):
    """The kept table of cases has the two parts of the file name that are read, not all that was parsed."""
    from caseflow.plans.record_queries import form_cases

    kept = spark.read.parquet(*form_cases(spark, "/root/testdata/sf0.001").inputFiles())
    assert {"slots", "file_pos_neg", "file_reason"} <= set(kept.columns) and "fn" not in kept.columns
