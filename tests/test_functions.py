"""Literal cases for the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from caseflow import functions as C


def one(spark, rows, fn):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def pairs(spark, rows, fn):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    return [r["o"] for r in df.select("i", fn(F.col("a"), F.col("b")).alias("o")).orderBy("i").collect()]


def test_collapse_unicode_space(spark):
    assert one(spark, [" a   b\t\n", None, ""], C.collapse) == ["a b", "", ""]


def test_dates(spark):
    cases = {
        "12 Sep 26": "2026-09-12", "16SEP2026": "2026-09-16", "16-Sep-26": "2026-09-16", "09/20/2026": "2026-09-20",
        "9/2/26": "2026-09-02", "2026-09-16": "2026-09-16", "20260916": "2026-09-16",
        "September 16, 2026": "2026-09-16", "Sept 3 2026": "2026-09-03", "": None, "N/A": None, "31 Feb 26": None,
        "12_Sep_26": "2026-09-12", "2026-13-01": None, "1 Foo 2026": None, "30 Feb 2024 March 1, 2024": None,
    }
    got = one(spark, list(cases), C.parse_date)
    assert [None if d is None else d.isoformat() for d in got] == list(cases.values())


def test_single_name(spark):
    cases = {
        "C4C John Doe": "John Doe", "Cadet Jane Smith": "Jane Smith", "C/Capt Sarah Mitchell": "Sarah Mitchell",
        "C/2d Lt Amy Wu": "Amy Wu", "C3C Doe, John": "John Doe", "Coles, Cadet Mary": "Mary Coles",
        "Ccarter, Cadence": "Cadence Ccarter", "Doe, John, A, Jr": "John A Jr Doe",
    }
    assert one(spark, list(cases), C.single_name) == list(cases.values())


def test_split_names(spark):
    assert one(spark, ["Doe, John, Amy Wu", "C4C Doe, John A; Smith, Jane", "John Doe, Amy Wu", ""], C.split_names) == [
        ["John Doe", "Amy Wu"], ["John A Doe", "Jane Smith"], ["John Doe", "Amy Wu"], []]
    a, b = one(spark, ["C4C John Doe", "Doe John"], C.name_key)
    assert a == b == "doe john"


def test_sanction_count(spark):
    cases = {"": "0", "2": "2", "4. TOURS": "0", "4. TOURS 2": "2", "N/A": "0", "na": "0", "None": "0",
             "1. DEMERIT(S) 5": "5", "3 tours": "3", "2.0": "2"}
    assert one(spark, list(cases), C.sanction_count) == list(cases.values())
    assert one(spark, [""], lambda c: C.sanction_count(c, source=F.lit("ink"))) == [""]
    assert one(spark, [""], lambda c: C.sanction_count(c, scanned=F.lit(True))) == [""]
    assert one(spark, ["N/A", "3. LOSS OF PASS PRIV 1 weekend"], C.other_text) == ["", "1 weekend"]


def test_num(spark):
    assert one(spark, ["3 tours", "x", None, "-1.5e1z", ".5"], C.num) == [3.0, 0.0, 0.0, -15.0, 0.5]


def test_filename(spark):
    a, b, c = one(spark, ["John Doe_Neg_F10_UniformViolation.pdf", "scan0042.pdf", "Lee, Kevin_Positive_AF174_Late.pdf"],
                  C.parse_filename)
    assert (a.recipient, a.pos_neg, a.form_type, a.reason, a.valid, a.problems) == (
        "John Doe", "Neg", "F10", "Uniform Violation", True, [])
    assert b.pos_neg == "" and not b.valid and len(b.problems) == 3
    assert (c.pos_neg, c.form_type, c.valid) == ("Pos", "F174", True)
    (d,) = one(spark, ["Neg_John Doe_F10_Late.pdf"], C.parse_filename)
    assert not d.valid and d.problems == ["no recipient part"]


def test_name_distance(spark):
    same = [("Doe, John A.", s) for s in
            ["John Doe", "C2C John Doe", "john doe", "JOHN DOE JR", "Doe John", "John A Doe", "Mr. John (Jack) Doe"]]
    assert pairs(spark, same, C.name_distance) == [0] * 7
    assert pairs(spark, [("Jon Doe", "John Doe"), ("Jane Smith", "John Doe"), ("Al Bo", "Ed Bo"), ("Cher", "Cher"),
                         ("Cher", "Cher Bono"), ("", "John Doe")], C.name_distance) == [1, 3, 3, 0, 3, 3]


def test_first_last_display(spark):
    names = ["C2C Doe, John A.", "JANE O'BRIEN", "mary-jane watson", "Madonna", "", "Smith, Jr"]
    assert one(spark, names, C.first_name) == ["John", "Jane", "mary-jane", "Madonna", "", "Smith"]
    assert one(spark, names, C.last_name) == ["Doe", "O'brien", "watson", "Madonna", "", "Smith"]
    assert one(spark, names, C.display_name)[:4] == ["John A Doe", "Jane Obrien", "Mary-Jane Watson", "Madonna"]


def test_dice_and_filename_key(spark):
    assert one(spark, ["John Doe_Neg_F10_Late (2) signed.pdf", "John Doe_Neg_F10_Late.pdf"], C.filename_key) == [
        "john doe neg f10 late"] * 2
    got = pairs(spark, [("same", "same"), ("", ""), ("abcd", "wxyz"), ("aaaa", "aa"), ("a", "a"), ("a", "b")], C.dice)
    assert got == [1.0, 0.0, 0.0, pytest.approx(0.5), 1.0, 0.0]


def test_years_and_labels(spark):
    assert one(spark, ["Class of 2028", "'27", "C 29", "26", "x"], C.parse_class_year) == ["2028", "2027", "2029", "2026", "x"]
    assert one(spark, ["'27", "c28", "2029", "abc", "1999"], C.norm_year) == ["2027", "2028", "2029", None, None]
    d = spark.createDataFrame([(dt.date(2026, 9, 2),)], "d date")
    row = d.select(*[C.month_label("d", f).alias(f) for f in ("short", "iso", "name_year", "number", "name")],
                   C.display_date("d").alias("shown"), C.date_to_serial("d").alias("serial")).first()
    assert list(row) == ["Sep", "2026-09", "September 2026", "9", "September", "2 Sep 26", 46267]
    assert one(spark, ["46267", "46267.75", "0.5", "x"], C.serial_to_date) == [dt.date(2026, 9, 2)] * 2 + [None, None]


def test_emails_and_template(spark):
    assert one(spark, ["x 'A.B@x.edu', c@d.org."], C.emails_in) == [["'A.B@x.edu", "c@d.org"]]
    assert one(spark, ["a@b.co", "a@b", "a b@c.de"], C.is_email) == [True, False, False]
    assert one(spark, ["john.doe42@x.edu", "jd@x.edu"], C.name_from_address) == ["John Doe", ""]
    tmpl = "Hi {First_Name} {LASTNAME} ({name}) $1"
    assert one(spark, [r"Jo$e \D"], lambda c: C.fill_template(F.lit(tmpl), c, F.lit("J$"), F.lit("D"))) == [
        r"Hi J$ D (Jo$e \D) $1"]
    assert one(spark, ["Jane Doe", "Email", "555-1234", "doe"], C.name_likeness) == [4.5, 0.0, 0.0, 2.0]
