"""Every registered query on the smallest tables, against its SQL where it has one."""

import math

import duckdb
import pytest

from songframe.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, sf_dir, sql, name):
    got = registry.QUERIES[name](spark, sf_dir)
    rows = got.collect()
    if name not in registry.ORACLES:
        assert rows
        return
    want = sql.sql(registry.ORACLES[name])
    assert sorted(want.columns) == sorted(got.columns)
    places = [want.columns.index(c) for c in got.columns]
    assert sorted([norm(v) for v in r] for r in rows) == sorted([norm(r[i]) for i in places] for r in want.fetchall())


def test_registers_of_lines_halfway(spark, tmp_path):
    """Lines as far from a chart's lowest as from its highest go where the SQL has them."""
    con = duckdb.connect()
    # geometric means: k p^2, k p q and k q^2 tenths of a hertz, a line each, twenty hours apart
    con.execute("CREATE TABLE m AS SELECT row_number() OVER (ORDER BY k, p, q) AS chart, [k * p * p, k * p * q, k * q * q] AS tenths FROM range(7, 60) a(k), range(4, 30) b(p), range(5, 31) c(q) WHERE p < q AND gcd(p, q) = 1 AND k * p * p >= 650 AND k * q * q <= 10000")
    con.execute("CREATE VIEW events AS SELECT chart * 3 + i AS event_id, TIMESTAMP '2024-01-01' + to_hours((i * 20)::INT) AS ts, chart AS user_id, 'view' AS event_type, tenths[i + 1] / 100.0 AS value, '{\"k\": 90}' AS props FROM m, range(3) r(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = registry.QUERIES["register_means"](spark, str(tmp_path))
    want = con.sql(registry.ORACLES["register_means"])
    rows = sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM want").fetchall())
    assert len(rows) > 1000 and sorted(tuple(r) for r in got.collect()) == rows


def test_contract(spark):
    import __spark_entry__ as entry

    queries = entry.queries()
    assert set(registry.QUERIES) <= set(queries)
    assert set(entry.oracle_sql()) <= set(queries)
    assert entry.entry(spark).count() == 8


def test_entry_without_text_operators(tmp_path):
    """The rest imports and works when the text operators and their pipeline are gone."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parent.parent
    shutil.copytree(root / "songframe", tmp_path / "songframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'style_profile' in q and not any(k.startswith('op1') for k in e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    work = code + """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
assert e.entry(spark).count() == 8
assert all(q[n](spark, "/root/testdata/sf0.001").count() for n in ("tokenize", "validate", "greedy_match"))
"""
    subprocess.run([sys.executable, "-c", work], cwd=tmp_path, check=True)
