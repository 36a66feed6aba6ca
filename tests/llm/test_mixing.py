import duckdb
import pytest

from tesselon.llm import mixing
from tests.llm.conftest import SF


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)


def test_equals_sql(documents):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.mix_sql()})").fetchall()
    got = rows(mixing.mix(documents))
    assert len(got) == len(expected)
    for a, b in zip(got, sorted(expected, key=str), strict=True):
        assert a == pytest.approx(b)


def test_targets_fill_small_sources(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 5), ("c", 1)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got["c"] == 3 and got[None] == 15
    assert sum(got.values()) == pytest.approx(1016)


def test_sources_come_near_their_targets(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 9 as int)) AS text", "if(id % 10 = 0, 'x', if(id % 10 < 4, 'y', 'z')) AS source")
    got = mixing.mix(docs).groupBy("source_size", "target").agg({"taken": "sum"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] - r["target"]) <= 10
    assert sum(r["sum(taken)"] for r in got) <= sum(r["source_size"] for r in got)
    assert rows(mixing.mix(docs)) == rows(mixing.mix(docs.repartition(7)))


def test_awkward_rows(awkward, empty):
    got = mixing.mix(awkward)
    assert got.count() == awkward.count() and got.filter("taken > 3 * size OR taken < 0").count() == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(awkward.filter("text IS NULL OR text = ''")).filter("taken <> 0").count() == 0
    out = mixing.mixed(awkward)
    assert out.columns == awkward.columns and mixing.mixed(empty).count() == 0
