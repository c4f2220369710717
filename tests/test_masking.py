import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.operators.masking import column_key, decrypt, mask_table, masked_columns, original_name, preview, unmask_table

CELLS = ["alice@x.org", "", "  ", None, "é" * 500, "AES-like", "0012"]


@pytest.fixture(scope="module")
def masked(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("m") / "t")
    mask_table(spark.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "id int, `e mail` string"), ["e mail", "absent"], "pw").write.parquet(path)
    return spark.read.parquet(path)


def test_round_trip(spark, masked):
    assert masked.columns == ["id", "e mail [MASKED]"] and masked_columns(masked) == ["e mail [MASKED]"]
    assert [r[1] for r in unmask_table(masked, "pw").orderBy("id").collect()] == CELLS
    cells = [r[1] for r in masked.orderBy("id").collect()]
    assert cells[1:4] == CELLS[1:4] and all(c.startswith("AES::") and "\n" not in c and "+" not in c for i, c in enumerate(cells) if i not in (1, 2, 3))


def test_wrong_password(spark, masked):
    with pytest.raises(Exception, match="(?i)aes|tag|crypto"):
        unmask_table(masked, "other").collect()
    key = F.lit(bytearray(column_key("other", "e mail")))
    assert masked.filter("id = 0").select(decrypt(F.col("`e mail [MASKED]`"), key, strict=False)).first()[0] is None


def test_nonces_differ(spark):
    df = spark.createDataFrame([("a",), ("a",)], "c string")
    assert len({r[0] for r in mask_table(df, ["c"], "pw").collect()}) == 2


def test_plain_tables(spark):
    df = spark.createDataFrame([("x", "y")], "`a [MASKED]` string, b string")
    assert unmask_table(df, "pw").columns == ["a", "b"] and masked_columns(df) == [] and mask_table(df, [], "pw") is df
    assert original_name("a [MASKED] b") == "a [MASKED] b"


def test_key_is_not_in_the_plan(spark):
    plan = mask_table(spark.createDataFrame([("a",)], "c string"), ["c"], "pw")._jdf.queryExecution().toString()
    assert column_key("pw", "c").hex() not in plan.lower().replace(" ", "")


def test_preview(spark):
    rows = spark.createDataFrame([("alice@corp.com",), ("a",), (" ",), (None,)], "v string").select(preview(F.col("v"))).collect()
    assert [r[0] for r in rows] == ["al" + "●" * 12, "a" + "●" * 6, " ", None]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\0"), min_size=1, max_size=40), min_size=1, max_size=8))
def test_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    assert [r.c for r in unmask_table(mask_table(df, ["c"], "p"), "p").orderBy("i").collect()] == texts
