"""The registered queries: those with SQL against it, all of them for columns and rows."""

import pytest

from rastercat.llm import queries as llm
from tests.compare import DATA, spark_rows, sql_rows

COLUMNS = {
    "op1_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "n_added"],
    "op2_url_filter": ["page_id", "host", "path", "rule", "verdict", "score"],
    "op5_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_mix": ["doc_id", "size", "source_size", "target", "taken", "position"],
    "op9_licences": ["doc_id", "path", "own_licence", "own_score", "licence", "inherited_from"],
    "op10_quality": ["doc_id", "held_out", "score", "predicted"],
    "op13_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
}


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    got = spark_rows(llm.queries()[name](spark, DATA))
    columns, rows = sql_rows(llm.oracle_sql()[name])
    at = [got[0].index(c) for c in columns]
    assert sorted(tuple(r[k] for k in at) for r in got[1]) == rows


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_one_row_for_each_input_row(spark, name):
    out = llm.queries()[name](spark, DATA)
    table = "pages" if name == "op2_url_filter" else "documents"
    assert out.columns == COLUMNS[name]
    assert out.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


@pytest.mark.parametrize("name", ["op1_pii", "op8_mix"])
def test_native_operators_run_no_python(spark, name):
    plan = llm.queries()[name](spark, DATA)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
