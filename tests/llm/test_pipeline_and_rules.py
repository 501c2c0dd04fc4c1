import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from songframe.llm import bpe, host_rules, mixing, quality, url_filter
from songframe.llm.common import table


def test_stages_one_by_one(spark, hard_dir, empty_dir):
    """Columns stay, rows shrink as they must, and nothing breaks on odd tables."""
    for folder in (hard_dir, empty_dir):
        docs = table(spark, folder, "documents")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns, name
            assert out.count() == 0 if folder == empty_dir else out.count() > 0
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_pipeline_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()
    docs = table(spark, folder, "documents")
    model = quality.train(docs, table(spark, folder, "labels"))
    scorer = quality.Scorer(model.shares(), float(model.bias[1] - model.bias[0]))
    rows = [r for r in rows if scorer.score(r[1]) >= 0.3]
    best = {}
    for i, t, s in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[bare] = min(best.get(bare, (-len(t), i, t, s)), (-len(t), i, t, s))
    rows = sorted((i, t, s) for _, i, t, s in best.values())
    shingles = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        shingles.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if shingles[a] == shingles[b] or shingles[a] and len(shingles[a] & shingles[b]) ** 2 >= 0.64 * len(shingles[a]) * len(shingles[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    rows = [r for k, r in enumerate(rows) if find(k) == k]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    taken = {i: (n, t) for i, n, t in con.sql(f"SELECT doc_id, size, taken FROM ({mixing.OP6_SQL})").fetchall()}
    own = bpe.load(*bpe.vocabulary_file())
    want = Counter()
    for i, t, _ in rows:
        n, total = taken[i]
        if n:
            want[i, len(own.encode(t)) // 4] += total // n
    got = Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect())
    assert +want == Counter({k: n for k, n in got.items() if k in want})


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i % 7), ["a", "b", "c", None][i % 4 if i % 3 else 0]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs)
    slim = docs.select(docs.doc_id.alias("id"), "source", mixing.size_of("text").alias("size"))
    want = {r.source: (r.target, r.source_size) for r in mixing.source_targets(slim.select("source", "size")).collect()}
    got = Counter()
    for r in out.collect():
        got[r.source] += len(r.text.split())
    assert max(Counter(r.doc_id for r in out.collect()).values()) <= 2
    for s, (target, size) in want.items():
        assert target <= 2 * size and abs(got[s] - target) < 0.08 * target
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)


def test_host_verdicts(spark):
    rows = [(i, "bad" if i < 50 else "good", i < 45 or 50 <= i < 60) for i in range(450)] + [(1000, "tiny", True)]
    verdicts = host_rules.host_verdicts(spark.createDataFrame(rows, "id long, host string, base_failed boolean"))
    got = {r.host: r for r in verdicts.collect()}
    assert len(got) == 3 and got["bad"].refused and not got["good"].refused
    assert got["tiny"].shrunk_rate < 1 and got["bad"].shrunk_rate < 0.9


@pytest.mark.parametrize("most", [1 << 19, 50])
def test_bloom_filter_has_no_false_negatives(spark, most):
    listed = spark.createDataFrame([(f"http://h{i}.org/p{i}",) for i in range(2000)] + [(None,), ("none",)], "url string")
    asked = spark.createDataFrame([(i, f"https://h{i}.org/p{i}/?utm_x=1") for i in range(4000)] + [(i, "ftp://H7.org/p7#a") for i in range(-3000, 0)], "page_id long, url string")
    got = url_filter.judge(asked, listed, rules=(), most=most).collect()
    assert all((r.verdict == "block") == (r.page_id < 2000) for r in got) and len(got) == 7000


def test_the_list_decides(spark):
    """Against the SQL for several lists; canonical forms meet, other spellings do not."""
    folder = "/root/testdata/sf0.01"
    pages = table(spark, folder, "pages")
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    whole, results = [r.url for r in pages.select("url").collect()], []
    for listed in (url_filter.LIST_FILE.read_text().split(), whole[::3], [u.replace("http", "HTTPS").split("#")[0] + "#x" for u in whole[1::2]], []):
        frame = spark.createDataFrame([(u,) for u in listed], "url string")
        got = {r.page_id: tuple(r) for r in url_filter.judge(pages, frame).collect()}
        want = duckdb.sql(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.sql(listed)})").fetchall()
        assert got == {r[0]: r for r in want}
        results.append(sum(r[4] == "block" and r[3] is None for r in want))
    duckdb.sql("DROP VIEW pages")
    assert results[3] == 0 and all(results[:3]) and len(set(results)) == 4


def test_mix_draws_rows_without_id_one_by_one(spark):
    rows = [(None if i % 50 else i, f"w{i} b c d", "a" if i % 3 else "b") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slim = docs.select(docs.doc_id.alias("id"), "source", mixing.size_of("text").alias("size"))
    want = {r.source: r.target for r in mixing.source_targets(slim.select("source", "size")).collect()}
    got = Counter()
    for r in mixing.mix(docs).collect():
        got[r.source] += len(r.text.split())
    assert all(abs(got[s] - target) < 0.05 * target for s, target in want.items()), (want, got)


@pytest.fixture(scope="module")
def varied_hosts(tmp_path_factory):
    """Forty hosts of which some fail nearly always, some hardly ever, some have one document."""
    rng = random.Random(12)
    rows = []
    for h in range(40):
        bad = rng.choice((0.02, 0.1, 0.9, 0.97))
        for _ in range(rng.choice((1, 5, 30, 90))):
            words = ["again"] * 30 if rng.random() < bad else [f"w{rng.randrange(9000)}" for _ in range(rng.randint(20, 60))]
            rows.append((len(rows), " ".join(words), f"host{h}" if h else None))
    folder = tmp_path_factory.mktemp("hosts")
    pq.write_table(pa.table(dict(zip(("doc_id", "text", "source"), map(list, zip(*rows, strict=True)), strict=True))), folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("bound", [10_000, 3])
def test_hosts_decide(spark, varied_hosts, bound):
    """Documents that pass alone go with their host, and the SQL says the same; also where
    hosts are too many to be broadcast."""
    rows = host_rules.judged(table(spark, varied_hosts, "documents"), bound=bound).collect()
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{varied_hosts}/documents.parquet'")
    want = {r[0]: r[-1] for r in duckdb.sql(f"SELECT doc_id, kept FROM ({host_rules.OP3_SQL})").fetchall()}
    assert {r.id: r.kept for r in rows} == want and len(rows) == len(want)
    own = [r for r in rows if not r.base_failed and not r.kept]
    assert len(own) > 10 and any(not r.kept for r in rows if r.shrunk_rate > 0.5)
    if bound == 3:
        return
    got = {r.doc_id: r.kept for r in host_rules.op3_host_rules(spark, varied_hosts).collect()}
    assert got == want


def test_hosts_that_differ_by_chance_alone_shrink_to_the_mean(spark):
    rng = random.Random(3)
    rows = [(i, f"h{i % 400}", rng.random() < 0.4) for i in range(2000)]
    got = host_rules.host_verdicts(spark.createDataFrame(rows, "id long, host string, base_failed boolean")).collect()
    assert not any(r.refused for r in got) and max(r.shrunk_rate for r in got) < 0.5


def test_many_sources_by_shuffle(spark):
    """The same targets and copies when only the hottest sources are broadcast."""
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 9), rng.choice(["hot", "hot", "hot", None, *[f"s{k}" for k in range(60)]])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slim = docs.select(docs.doc_id.alias("id"), "source", mixing.size_of("text").alias("size"))
    a, b = (sorted(map(tuple, mixing.with_copies(slim, bound=n).select("id", "size", "source_size", "target", "copies").collect())) for n in (10_000, 2))
    assert a == b and len(a) == 3000
    duckdb.sql("DROP VIEW IF EXISTS documents")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = {r[0]: r for r in con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.OP6_SQL})").fetchall()}
    for i, size, whole, target, copies in a:
        assert want[i][1:3] == (size, whole) and abs(want[i][3] - target) < 1e-6 * (1 + target) and want[i][4] == size * copies
    c, d = (Counter(map(tuple, mixing.mix(docs, bound=n).collect())) for n in (10_000, 2))
    assert c == d == Counter({r: a[r[0]][4] for r in rows if a[r[0]][4]})
