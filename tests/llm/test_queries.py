from collections import Counter
from pathlib import Path

import duckdb
import pytest

from kelpline.llm import queries as q

NAMES = sorted(q.oracle_sql())


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_every_problem_has_its_queries():
    have = set(q.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 9, 10)} | {"p8_ids"} <= have


@pytest.mark.parametrize("name", NAMES)
def test_query_and_sql_agree(spark, data, db, name):
    df, rel = q.queries()[name](spark, data), db.sql(q.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    got = Counter(tuple(str(r[c]) for c in order) for r in df.collect())
    at = [rel.columns.index(c) for c in order]
    assert got == Counter(tuple(str(r[i]) for i in at) for r in rel.fetchall())


def test_vectors_of_every_modality_are_clustered(spark, tmp_path):
    a, b, c = [1.0, 0.0, 0.2], [0.9, 0.1, 0.2], [0.0, 1.0, 0.0]
    rows = [(k, m, v) for n, m in enumerate(("text", "image", "audio", None)) for k, v in enumerate((a, b, c), 10 * n)]
    hist = spark.createDataFrame(rows, "chunk_id long, modality string, hist array<float>").selectExpr("*", "timestamp'2024-01-01' AS loaded_at")
    hist.write.parquet(str(tmp_path / "histograms.parquet"))
    hist.selectExpr("chunk_id AS id", "modality", "hist AS centroid").write.parquet(str(tmp_path / "codebook.parquet"))
    con = duckdb.connect()
    for name in ("histograms", "codebook"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}.parquet/*.parquet'")
    for name in ("p5_found", "p5_clusters"):
        got = q.queries()[name](spark, str(tmp_path)).select(*con.sql(q.oracle_sql()[name]).columns)
        assert sorted(map(tuple, got.collect())) == sorted(con.sql(q.oracle_sql()[name]).fetchall())
    assert q.queries()["p5_found"](spark, str(tmp_path)).where("key_a = 0 AND key_b = 1").count() == 2
