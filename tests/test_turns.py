"""Queries on turns of conversations cover whole texts and all neighbouring turns."""

import difflib
import re

import duckdb

from songframe.plans import registry


def turns_of(sf_dir):
    out = {}
    for conv, turn, text in duckdb.sql(f"SELECT conv_id, turn, text FROM '{sf_dir}/conversations.parquet' ORDER BY 1, 2").fetchall():
        out.setdefault(conv, []).append((turn, text))
    return out


def test_whole_turns_are_compared(spark, sf_dir):
    def plain(text):
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", text.lower())).strip()

    want = {}
    for conv, turns in turns_of(sf_dir).items():
        for (t, a), (u, b) in zip(turns, turns[1:], strict=False):
            if u == t + 1:
                want[conv, t] = round(difflib.SequenceMatcher(None, plain(a), plain(b), autojunk=False).ratio(), 5)
    got = {(r.conv_id, r.turn): round(r.ratio, 5) for r in registry.QUERIES["text_similarity"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-5 for k in want)


def test_every_turn_is_aligned_with_the_next(spark, sf_dir):
    rows = registry.QUERIES["align_words"](spark, sf_dir).collect()
    want = {(conv << 24) + n for conv, turns in turns_of(sf_dir).items() for n in range(1, len(turns))}
    got = {r.chart_id for r in rows}
    # a pair without any match has no rows
    assert got <= want and any(c % 2**24 > 1 for c in got)
    words = {(conv << 24) + n: turns[n][1].split() for conv, turns in turns_of(sf_dir).items() for n in range(1, len(turns))}
    keys = {(conv << 24) + n + 1: set(re.findall(r"[a-z0-9]+", text.lower())) for conv, turns in turns_of(sf_dir).items() for n, (_, text) in enumerate(turns)}
    plain = {c for c in want if any(re.fullmatch(r"[a-z0-9]+", w) and w in keys[c] for w in words[c])}
    assert plain <= got
