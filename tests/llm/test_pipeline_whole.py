"""The whole result of the pipeline against brute force: nothing missing, nothing else."""

import re
from collections import Counter

import duckdb

import corpus_pipeline
from songframe.llm import bpe, mixing, quality
from songframe.llm.common import table

SPACE = r"[\x20\x09-\x0D]"


def survivors(rows):
    """Rows (id, text, source) after exact and near dedup, all pairs compared."""
    best = {}
    for i, t, s in rows:
        bare = re.sub(SPACE, "", t)
        best[bare] = min(best.get(bare, (-len(t), i, t, s)), (-len(t), i, t, s))
    rows = sorted((i, t, s) for _, i, t, s in best.values())
    sets = []
    for _, t, _ in rows:
        w = [x for x in re.split(SPACE, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) if x]
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or sets[a] and len(sets[a] & sets[b]) ** 2 >= 0.64 * len(sets[a]) * len(sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [r for k, r in enumerate(rows) if find(k) == k]


def test_pipeline_gives_nothing_else(spark):
    folder = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()
    model = quality.train(table(spark, folder, "documents"), table(spark, folder, "labels"))
    scorer = quality.Scorer(model.shares(), float(model.bias[1] - model.bias[0]))
    wordless = {i for i, t, _ in rows if not re.sub(SPACE, "", t)}
    rows = survivors([r for r in rows if scorer.score(r[1]) >= 0.3])
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    taken = {i: (n, t) for i, n, t in con.sql(f"SELECT doc_id, size, taken FROM ({mixing.OP6_SQL})").fetchall()}
    own, want = bpe.load(*bpe.vocabulary_file()), Counter()
    for i, t, _ in rows:
        n, total = taken[i]
        if n:
            want[i, len(own.encode(t)) // 4] += total // n
    got = Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect() if r.doc_id not in wordless)
    assert +want == got
