"""Every query on the hard and the empty tables; against SQL where there is any."""

import duckdb
import pytest

from songframe.llm.queries import ORACLES, QUERIES

ROWS = {"op7_warc": "pages", "op10_url_filter": "pages", "op12_turn_repair": "(SELECT DISTINCT conv_id FROM conversations)"}


def norm(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", QUERIES)
def test_hard_tables(spark, hard_dir, name):
    got = QUERIES[name](spark, hard_dir)
    rows = got.collect()
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{hard_dir}/{t}.parquet'")
    if name == "op7_warc":  # its SQL says nothing on null keys
        con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{hard_dir}/pages.parquet' WHERE page_id IS NOT NULL")
        rows = [r for r in rows if r.page_id is not None]
    assert len(rows) == con.sql(f"SELECT count(*) FROM {ROWS.get(name, 'documents')}").fetchall()[0][0]
    if name in ORACLES:
        want = con.sql(ORACLES[name])
        places = [want.columns.index(c) for c in got.columns]
        drop = {"kept"} if name == "op8_exact_dedup" else set()  # whole rows that repeat may change places
        keep = [i for i, c in enumerate(got.columns) if c not in drop]
        a = sorted([norm(r[i]) for i in keep] for r in rows)
        b = sorted([norm(r[places[i]]) for i in keep] for r in want.fetchall())
        assert a == b


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0
