import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from songframe.llm import bpe, files, token_index
from songframe.llm.common import shared_dir, table
from songframe.llm.words import Recent


def library(name):
    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.no_truncation()
    found.no_padding()
    return found


def odd_texts(n, seed):
    rng = random.Random(seed)
    letters = "abcXYZ éÉß'’s t.,!<|>_0159%-\n\t\u0301\u0130\u017f\u212a\u03a3\u03c2—…“”日本\x85\x1c😀²Ⅷ"
    for i in range(n):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 20)))
        yield text + "<|endoftext|>" + rng.choice(letters) + "it's" if i % 7 == 0 else text


def test_word_encoder_equals_the_library():
    own, want = token_index.encoder(public_tokenizers.path("word_bpe_49k.json"), "<u2"), library("word_bpe_49k.json")
    for text in odd_texts(20_000, 1):
        assert own.encode(text) == np.array(want.encode(text, add_special_tokens=False).ids, "<u2").tobytes(), ascii(text)


def test_byte_encoder_equals_the_library():
    own, want = bpe.load(*bpe.vocabulary_file()), library("byte_bpe_50k.json")
    for text in odd_texts(20_000, 2):
        ids = want.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == np.array(ids, "<u4").tobytes(), ascii(text)
        assert own.decode(np.array(ids, "<u4").tobytes()) == want.decode(ids, skip_special_tokens=False)


def test_byte_query(spark, hard_dir, docs):
    t = library("byte_bpe_50k.json")
    want = []
    for i, text in docs:
        ids = t.encode(text, add_special_tokens=False).ids
        want.append((i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op4_bpe(spark, hard_dir).collect()]
    assert sorted(got) == sorted(want)


def test_index_query(spark, hard_dir, docs):
    t = library("word_bpe_49k.json")
    want = []
    for i, text in docs:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        want.append((i or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = token_index.op2_token_index(spark, hard_dir).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id or 0 for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 5000])
def test_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(0, 1 << 63, n).astype(np.uint64)
    d = token_index.displacements(h1, h2)
    at = token_index.slots(h1, h2, d[token_index.groups_of(h2, n)], n)
    assert sorted(at.tolist()) == list(range(n))


def test_unknown_keys_and_ids(spark, hard_dir, tmp_path):
    folder = f"file://{tmp_path}"
    entries = token_index.write_shards(table(spark, hard_dir, "documents"), folder)
    index, buckets = token_index.build_index(entries, size=8)
    keys = spark.createDataFrame([(str(i), 5, 0) for i in range(500)], "id string, th long, nth long")
    assert token_index.look_up(keys, index, buckets).count() == 0
    found = token_index.read_ids(token_index.look_up(entries, index, buckets), folder, "<u2", keep=True).where("id = '107'").collect()
    assert [np.frombuffer(r.ids, "<u4").tolist()[-1] for r in found] == [1]


def test_documents_are_found_by_id_alone(spark, hard_dir, docs, tmp_path):
    """Also where rows of an id are spread over several shards."""
    folder, t = f"file://{tmp_path}", library("word_bpe_49k.json")
    many = [(7, f"text {i}") for i in range(300)] + [(None, f"none {i}") for i in range(200)] + [(i, f"own {i}") for i in range(8, 60)]
    frame = spark.createDataFrame(many, "doc_id long, text string")
    entries = token_index.by_id(token_index.write_shards(frame, folder)).cache()
    assert entries.select("shard").distinct().count() > 3
    assert sorted((r.id or "", r.nth) for r in entries.collect()) == sorted([("7", i) for i in range(300)] + [("", i) for i in range(200)] + [(str(i), 0) for i in range(8, 60)])
    index, buckets = token_index.build_index(entries, size=16)
    asked = spark.createDataFrame([(str(i), 0, 0) for i in range(100)], "id string, th long, nth long")
    found = token_index.read_ids(token_index.look_up(asked, index, buckets), folder, "<u2", keep=True).collect()
    assert sorted(int(r.id) for r in found) == list(range(7, 60))
    for r in found:
        if r.id != "7":
            assert np.frombuffer(r.ids, "<u4").tolist() == [*t.encode(f"own {r.id}", add_special_tokens=False).ids, 1]
    keys = token_index.keys_of(frame, chunk=7)
    assert keys.count() == len(many) == token_index.look_up(keys, index, buckets).count()


def test_memory_of_words_is_bounded_in_bytes():
    own, made = token_index.encoder(public_tokenizers.path("word_bpe_49k.json"), "<u2"), []
    want = library("word_bpe_49k.json")
    for i in range(50):
        word = f"{i}" + "aGk7+/" * 200
        assert own.encode(word) == np.array(want.encode(word, add_special_tokens=False).ids, "<u2").tobytes()
    assert max(map(len, (*own.of_word, *own.of_part))) <= 64
    recent = Recent(lambda w: made.append(w) or len(w), 3)
    assert [recent[w] for w in ("a", "b", "a", "c", "d", "a", "x" * 65, "x" * 65)] == [1, 1, 1, 1, 1, 1, 65, 65]
    assert made == ["a", "b", "c", "d", "x" * 65, "x" * 65] and len(recent) <= 3


def test_addresses_and_shared_folders():
    assert files.address("s3a://bucket/a") == "s3://bucket/a" and files.address("/tmp/a") == "file:///tmp/a" == files.address("file:/tmp/a")
    with pytest.raises(ValueError, match="wasb"):
        files.address("wasb://x/y")

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(ValueError, match="share"):
        shared_dir(Session)
