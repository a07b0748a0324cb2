"""Every catalogue query against its SQL."""

import pytest

from rastercat import queries as catalogue
from tests.compare import DATA, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(catalogue.queries()[name](spark, DATA)) == sql_rows(catalogue.oracle_sql()[name])


def test_the_expected_replacements_of_the_stand_in(spark):
    plan = catalogue.j9_id_replace_plan(spark, "/root/testdata/sf0.01")
    assert (plan.filter("replaced").count(), plan.filter("not replaced").count()) == (135, 115)
