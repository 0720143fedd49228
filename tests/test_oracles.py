"""A few registered queries against their DuckDB SQL on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
NAMES = ("normalize_page", "classify_prefix", "summarize_hidden", "posting_keywords", "list_history", "client_network", "word_jaccard", "to_score", "background_at", "repair_answers", "pick_answer", "reservations", "counter_ledger", "write_report", "cascade_delete", "render_messages", "score_documents")


def test_entry_imports_without_a_session():
    root = Path(__file__).resolve().parent.parent
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_oracle(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for table in "customer orders lineitem part events documents benchmark conversations".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    rows = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in rows.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, rows.fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_every_check_row_is_rendered(spark):
    import __spark_entry__ as entry
    from folioscope.plans.scoring import checks

    want = {(r.doc_id, r.check_id): f"{r.check_id} hat {r.score} Punkte ({r.score})" for r in checks(spark, SF).collect()}
    assert any(doc_id % 2 for doc_id, _ in want)
    assert {(r.doc_id, r.check_id): r.rendered for r in entry.queries()["render_text"](spark, SF).collect()} == want
