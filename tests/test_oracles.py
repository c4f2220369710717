"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ("dictionary_customer", "null_like_filter", "value_signatures", "long_values", "entity_metrics_pages", "valid_iban", "valid_national_insurance", "valid_birth_date", "mask_shape", "name_scores", "model_labels", "csv_customer", "masked_column_names")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).fetchdf()
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def rows(df):
        return sorted(tuple(round(float(v), 9) if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False))

    assert rows(got) == rows(want)


def test_every_query_is_described():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 35
