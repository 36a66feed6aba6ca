import duckdb
import pytest
from tesselon.llm import topk
from tests.llm.conftest import SF


def test_equals_sql(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    expected = sorted(con.execute(topk.top_k_sql()).fetchall())
    assert sorted(map(tuple, topk.top_k(vectors).collect())) == expected


def test_blocks_do_not_change_results(spark, monkeypatch):
    vectors = spark.range(400).selectExpr("id AS vec_id", "array(cast((id * 7) % 5 as double), 0d, cast((id * 3) % 4 as double)) AS embedding")
    whole = sorted(map(tuple, topk.top_k(vectors, every=20).collect()))
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, topk.top_k(vectors, every=20).collect())) == whole


def test_awkward_vectors(spark):
    rows = [(0, [1.0, float("nan")]), (50, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [1e30, 1e30]), (2, None), (None, [1.0]), (3, [0.5]), (4, []), (100, [-1e30, 3.0, None]), (150, [1e38, -0.001])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS v", "2 AS q", "3 AS score")
    got = sorted(map(tuple, topk.top_k(vectors).collect()))
    assert got[:4] == [(50, 1, 1, 2**63 - 1), (50, 2, 150, 2**63 - 1), (50, 3, 3, 32768), (50, 4, 4, 0)]
    assert {r[0] for r in got} == {50, 150} and topk.top_k(vectors.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 5])
def test_ties_go_to_the_smaller_id(spark, k):
    vectors = spark.createDataFrame([(i, [1.0]) for i in range(101)], "vec_id long, embedding array<double>")
    got = topk.top_k(vectors, k=k).filter("query_id = 50").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(k))


def test_repeated_candidates_leave_room_for_others(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)]
    rows += [(7, [9.0, 9.0])] * 20  # one row, repeated
    rows += [(8, [20.0, float(-i)]) for i in range(20)]  # one id, vectors whose scores for query 0 are equal
    rows[0] = (0, [1.0, 0.0])
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    expected = sorted(con.execute(topk.top_k_sql()).fetchall())
    assert [r[2] for r in expected[:2]] == [8, 7] and len(expected) == 10
    assert sorted(map(tuple, topk.top_k(vectors).collect())) == expected
