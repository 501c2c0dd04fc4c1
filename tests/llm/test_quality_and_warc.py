import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq

from songframe.llm import quality, warc
from songframe.llm.common import table


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op5_quality(spark, folder).collect()}
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall())
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert sum(p == y for p, y in held) / len(held) > 0.95
    assert all(p == 1 for p, y in held if y == 1)


def test_scores_are_the_softmax_of_averages():
    texts = ["good words here", "BAD BAD BAD", "", "good here words words"]
    model = quality.Embeddings().fit(texts, [1, 0, 1, 1])
    scorer = quality.Scorer(model.shares(), float(model.bias[1] - model.bias[0]))
    for t in [*texts, "unseen zzz", "here here here"]:
        at = [b for w, n in quality.bag_of(t).items() for b in quality.features(w) * n]
        mean = model.vectors[at].mean(axis=0) if at else model.vectors[0] * 0
        assert abs(scorer.score(t) - model.softmax(model.layer @ mean + model.bias)[1]) < 1e-4


def test_no_labels(spark, hard_dir):
    docs = table(spark, hard_dir, "documents")
    model = quality.train(docs, table(spark, hard_dir, "labels").limit(0))
    assert quality.good_documents(docs, model).count() == docs.count()


def test_archive_rolls_and_is_the_same_again(spark, hard_dir, tmp_path):
    pages = table(spark, hard_dir, "pages")
    files = []
    for run in ("a", "b"):
        folder = f"file://{tmp_path}/{run}"
        manifest = warc.write_archive(warc.with_types(pages), folder, roll=150)
        files.append(sorted((r.file, r.records, r.sha1) for r in manifest.collect()))
        assert warc.read_archive(manifest, folder).count() == pages.count()
        assert not [p for p in (tmp_path / run).iterdir() if p.name.startswith("_temporary")]
    assert files[0] == files[1] and len(files[0]) > 5


def test_null_keys(spark, hard_dir):
    rows = warc.op7_warc(spark, hard_dir).where("page_id IS NULL").collect()
    assert [(r.record_type, r.refers_to) for r in rows] == [("revisit", 6)]
    payload = pq.read_table(f"{hard_dir}/pages.parquet").to_pylist()[-1]["html"]
    assert rows[0].payload_bytes == len(payload)


def test_revisits_by_marks(spark, hard_dir, tmp_path):
    """The same records whether the decision is broadcast or comes as rows of its own;
    what a killed worker left is removed."""
    pages = table(spark, hard_dir, "pages")
    files = []
    for bound in (1000, 0):
        folder = f"file://{tmp_path}/{bound}"
        (tmp_path / str(bound)).mkdir()
        (tmp_path / str(bound) / "_temporary-left").write_bytes(b"half")
        manifest = warc.write_archive(warc.with_types(pages, bound=bound), folder)
        rows = warc.read_archive(manifest, folder).collect()
        assert len(rows) == pages.count() and sum(r.record_type == "revisit" for r in rows) == 4
        files.append(sorted(map(str, rows)))
        assert not [p for p in (tmp_path / str(bound)).iterdir() if p.name.startswith("_temporary")]
    assert files[0] == files[1]


def test_training_against_a_plain_gradient():
    """One step on one document against derivatives taken numerically."""
    def loss(model, text, y):
        at = [b for w, n in quality.bag_of(text).items() for b in quality.features(w) * n]
        return -np.log(model.softmax(model.layer @ model.vectors[at].mean(axis=0) + model.bias)[y])

    rng = np.random.default_rng(1)
    text, y = "one two two three", 1
    before, after = quality.Embeddings(), quality.Embeddings()
    start = rng.normal(0, 0.1, before.vectors.shape)
    before.vectors, after.vectors = start.copy(), start.copy()
    after.fit([text], [y], epochs=1, rate=0.01)
    at = sorted({b for w in quality.bag_of(text) for b in quality.features(w)})
    n = sum(len(quality.features(w)) * k for w, k in quality.bag_of(text).items())
    step, eps = 0.01 * n / (n + quality.FEW), 1e-5
    for part in ("layer", "bias"):
        own, moved = getattr(before, part), getattr(after, part) - getattr(before, part)
        for i in np.ndindex(own.shape):
            own[i] += eps
            up = loss(before, text, y)
            own[i] -= 2 * eps
            slope = (up - loss(before, text, y)) / (2 * eps)
            own[i] += eps
            assert abs(moved[i] + step * (0.1 if part == "bias" else 1) * slope) < 1e-7
    # vectors move along the gradient, scaled so that the average moves by one whole step
    moved = after.vectors - before.vectors
    slopes = np.zeros_like(moved)
    for b in at:
        for d in range(moved.shape[1]):
            before.vectors[b, d] += eps
            up = loss(before, text, y)
            before.vectors[b, d] -= 2 * eps
            slopes[b, d] = (up - loss(before, text, y)) / (2 * eps)
            before.vectors[b, d] += eps
    a, b = moved[at].ravel(), -slopes[at].ravel()
    assert a @ b / np.sqrt((a @ a) * (b @ b)) > 1 - 1e-6 and not np.delete(moved, at, axis=0).any()
