"""The queries of operators that SQL can express, against that SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from voxmere.llm import registry


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else value


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_source_mix", "op13_spelling_groups"])
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    result = con.execute(registry.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = lambda rows: sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])
    assert order(tuple(plain(r[c]) for c in columns) for r in found.collect()) == order(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
