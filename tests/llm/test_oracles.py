"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from palimpsest.llm import queries

SF = "/root/testdata/sf0.001"


def _sql(name: str, **tables) -> list[tuple]:
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')") if t not in tables else con.register(t, tables[t])
    rows = con.sql(queries.oracle_sql()[name])
    at = [rows.columns.index(c) for c in sorted(rows.columns)]
    return sorted(tuple(r[i] for i in at) for r in rows.fetchall())


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_sql_agrees(spark, name):
    found = queries.queries()[name](spark, SF)
    assert sorted(map(tuple, found.select(*sorted(found.columns)).collect())) == _sql(name)


def test_links_and_components(spark, tmp_path):
    """Copies and near copies, a zero and a broken vector."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 32))
    near = base[:20] + 0.05 * rng.standard_normal((20, 32))
    rows = [*base, *near, *near[:5], np.zeros(32)]
    table = pd.DataFrame({"vec_id": range(len(rows)), "embedding": [[float(np.float32(x)) for x in r] for r in rows]})
    table.loc[len(table)] = [len(table), [float("nan")] * 32]
    table.to_parquet(tmp_path / "embeddings.parquet")
    for name in ("op6_embedding_dedup", "op9_exact_topk"):
        found = queries.queries()[name](spark, str(tmp_path))
        got = sorted(map(tuple, found.select(*sorted(found.columns)).collect()))
        assert got == _sql(name, embeddings=duckdb.read_parquet(str(tmp_path / "embeddings.parquet")).df())
