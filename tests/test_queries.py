"""Registered queries against their SQL on the smallest tables, and the entry contract."""

import os

import pytest

from caseflow.plans import load_queries
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
FAST = [
    "balances", "balances_before_cutoff", "oldest_first_allocation", "settlement_log", "overview_kpis", "month_histogram",
    "facet_counts", "party_index", "packet_index", "output_rows", "step_transitions", "catalog_diff", "patched_catalog",
    "collision_names", "near_duplicate_names", "widget_matches", "widget_contention", "word_boxes", "words_minus_printed", "parsed_dates",
    "parsed_filenames", "review_issues", "roster", "announcements_batch", "daily_counts_stream", "tsv_export", "document_candidates",
]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, name):
    assert compare(spark, connect(SF), load_queries()[name], SF) in ("", "both empty")


def test_entry_contract(spark):
    import importlib.util

    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(module.oracle_sql()) <= set(module.queries())
    assert module.entry(spark).count() > 0


def test_every_survey_row_has_a_query():
    want = {f"{g}{i}" for g, n in {"S": 12, "P": 18, "J": 18, "A": 20, "W": 9, "O": 5, "U": 5, "F": 34, "T": 7, "M": 7}.items() for i in range(1, n + 1)}
    have = {i.strip() for q in load_queries().values() for i in q.ids.split(",")}
    assert want <= have, sorted(want - have)


def test_words_of_documents_are_dealt_out_before_they_are_split(spark):
    """One shuffle of the texts by document; numbering and sums stay where the words are."""
    plan = load_queries()["words_minus_printed"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_history_of_an_order_of_many_lines(spark, tmp_path):
    """20 lines are 250 entries, of which the last 60 stay."""
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401
    import pyarrow.parquet as pq

    for f in os.listdir(SF):
        if f != "lineitem.parquet":
            os.symlink(f"{SF}/{f}", tmp_path / f)
    lines = pq.read_table(f"{SF}/lineitem.parquet")
    key = pq.read_table(f"{SF}/orders.parquet")["o_orderkey"][0].as_py()
    more = lines.slice(0, 20).set_column(lines.schema.get_field_index("l_orderkey"), lines.schema.field("l_orderkey"), pa.array([key] * 20, lines.schema.field("l_orderkey").type))
    pq.write_table(pa.concat_tables([lines.filter(pa.compute.not_equal(lines["l_orderkey"], key)), more]), tmp_path / "lineitem.parquet")
    q = load_queries()["history_trimmed"]
    assert {r.case_id: (r.entries, r.first) for r in q.run(spark, str(tmp_path)).collect()}[key] == (60, 191)
    assert compare(spark, connect(str(tmp_path)), q, str(tmp_path)) == ""
