import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from songframe.llm import bpe, cross_tokens, token_counts

ODD = "abcXYZ  éÉß'’s t.,!<|>_0159%-\n\t́İſ▁▁  —“日本\x85\x1c\x00😀²Ⅷ﻿�"
EDGES = ["", " ", "  ", "\n", "a", " a", "a ", "▁", "a▁b", "<s>x</s> <unk> <0x41>", "\n\n a", "<|endoftext|>", "x" * 5000, "a " * 3000, "😀" * 300]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return EDGES + ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def byte_bpe():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_pre_tokens_add_up(pieces):
    own = token_counts.load(token_counts.vocabulary_file())
    texts = odd_texts(5000, 1)
    for text in texts:
        assert "".join(own.pre_tokens(text)) == (" " + text if text else "")
    got = token_counts.totals(token_counts.frequencies(texts, own), own)
    assert [got.get(i, 0) for i in range(len(texts))] == [len(x) for x in pieces.encode(texts)]


def test_counts_each_distinct_word_once(monkeypatch):
    own = token_counts.load(token_counts.vocabulary_file())
    asked = []
    counts = own.counts
    monkeypatch.setattr(own, "counts", lambda words: asked.extend(words) or counts(words))
    token_counts.totals(token_counts.frequencies(["a b a", "b a b\na"] * 50, own), own)
    assert sorted(asked) == ["\n", " a", " b", "a"]


def test_vocabularies_whose_pieces_reach_over_spaces_are_refused(monkeypatch):
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "id_to_piece", lambda self, i: "▁of▁the")
    with pytest.raises(ValueError):
        token_counts.Pieces(token_counts.vocabulary_file())


def test_count_query(spark, hard_dir, docs, pieces):
    want = [(i or 0, len(t.encode()), len(pieces.encode(t)), len(pieces.encode(t)) > 4096) for i, t in docs]
    got = [(r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op13_token_counts(spark, hard_dir).collect()]
    assert sorted(got) == sorted(want)


def both_tokenizations(text, byte_bpe, pieces):
    """(id, bytes) of the tokens of A and of B, by the libraries."""
    if not text:
        return [], []
    back = {c: i for i, c in enumerate(bpe.byte_letters())}
    a = [(i, bytes(back[c] for c in byte_bpe.id_to_token(i))) for i in byte_bpe.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()) for i in pieces.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def spans(tokens):
    ends = np.cumsum([len(x) for _, x in tokens]).tolist()
    return [(i, e - len(x), e) for (i, x), e in zip(tokens, ends)]


def brute_force(text, byte_bpe, pieces):
    """Links by comparing byte ranges, groups by common ends."""
    a, b = map(spans, both_tokenizations(text, byte_bpe, pieces))
    links, j = [], 0
    for i, s, e in a:
        while j < len(b) and b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            links.append((i, b[k][0]))
            k += 1
    cuts = sorted({e for *_, e in a} & {e for *_, e in b})
    groups, x, y = [], 0, 0
    for c in cuts:
        u, v = x, y
        while u < len(a) and a[u][2] <= c:
            u += 1
        while v < len(b) and b[v][2] <= c:
            v += 1
        groups.append(",".join(str(t[0]) for t in a[x:u]) + "|" + ",".join(str(t[0]) for t in b[y:v]))
        x, y = u, v
    return len(a), len(b), links, groups


def test_owner_arrays_equal_ranges(byte_bpe, pieces):
    own = cross_tokens.load(*bpe.vocabulary_file(), cross_tokens.piece_file())
    for text in odd_texts(3000, 2):
        a, b = own.encode(text)
        x, y, first = cross_tokens.align(own.a.lengths[a], own.b.lengths[b])
        n_a, n_b, links, groups = brute_force(text, byte_bpe, pieces)
        assert (len(a), len(b), list(zip(a[x].tolist(), b[y].tolist()))) == (n_a, n_b, links), ascii(text)
        assert own.groups_text(a, b, x[first], y[first]) == ";".join(groups), ascii(text)


def check_table(rows, docs, byte_bpe, pieces):
    found = [(i, brute_force(t, byte_bpe, pieces)) for i, t in docs]
    held = Counter(p for _, (_, _, links, _) in found for p in set(links))
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    want = []
    for i, (n_a, n_b, links, groups) in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        want.append((i or 0, n_a, n_b, len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), digest))
    assert sorted((r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows) == sorted(want)


def test_align_query(spark, hard_dir, docs, byte_bpe, pieces):
    check_table(cross_tokens.op11_cross_tokens(spark, hard_dir).collect(), docs, byte_bpe, pieces)


def test_pairs_beyond_the_broadcast(spark, hard_dir, docs, byte_bpe, pieces, monkeypatch):
    """Few pairs go by broadcast, all others by the shuffle."""
    monkeypatch.setattr("songframe.llm.keyed_sums.SHARE", 300)
    check_table(cross_tokens.op11_cross_tokens(spark, hard_dir).collect(), docs, byte_bpe, pieces)


def test_groups_are_kept_as_text(spark, hard_dir, docs, byte_bpe, pieces):
    got = sorted((r.id or 0, r.groups) for r in cross_tokens.cross_align(spark.read.parquet(f"{hard_dir}/documents.parquet")).collect())
    assert got == sorted((i or 0, ";".join(brute_force(t, byte_bpe, pieces)[3])) for i, t in docs)
