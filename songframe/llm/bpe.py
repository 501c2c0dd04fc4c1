"""Byte-level BPE, encoding and decoding.

A word is a doubly linked list of symbols. A priority queue holds the rank and
place of each pair that may merge; the least rank merges first, leftmost first,
and entries whose symbols have changed since are skipped. Decoding concatenates
vocabulary strings. What has been computed for a word is kept in a bounded
memory, as words recur; results do not depend on it.

Null text counts as empty and has no tokens. Added tokens of the vocabulary are
matched in the text before it is split, longest first, as the public library
does. Rows may repeat; an empty table gives an empty result; other columns are
never read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.llm.common import small_batches, table, text_of
from songframe.llm.words import Recent


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself where it is
    printable, else the next from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Bpe:
    def __init__(self, vocabulary: str, pattern: str):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        ids = model["vocab"]
        self.first = [ids[c] for c in letters]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes = {i: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for s, i in ids.items()}
        self.bytes |= {i: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for s, i in self.added.items()}
        self.words = regex.compile(pattern)
        self.split_added = regex.compile("|".join(sorted(map(regex.escape, self.added), key=len, reverse=True))) if self.added else None
        self.of_word = Recent(self.merge, 300_000)
        self.of_part = Recent(self._part, 300_000)

    def merge(self, word: str) -> bytes:
        """Ids of one word of the split, as little-endian unsigned 32-bit integers."""
        own = [self.first[b] for b in word.encode("utf-8")]
        n = len(own)
        if n > 1:
            merges = self.merges
            before, after = list(range(-1, n - 1)), [*range(1, n), -1]
            queue = []
            for i in range(n - 1):
                got = merges.get((own[i], own[i + 1]))
                if got:
                    queue.append((got[0], i, got[1], own[i], own[i + 1]))
            heapq.heapify(queue)
            while queue:
                _, i, new, a, b = heapq.heappop(queue)
                j = after[i]
                if own[i] != a or j < 0 or own[j] != b:
                    continue  # stale: one of the two has merged since
                own[i], own[j] = new, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    got = merges.get((new, own[k]))
                    if got:
                        heapq.heappush(queue, (got[0], i, got[1], new, own[k]))
                h = before[i]
                if h >= 0:
                    got = merges.get((own[h], new))
                    if got:
                        heapq.heappush(queue, (got[0], h, got[1], own[h], new))
            own = [x for x in own if x >= 0]
        return array("I", own).tobytes()

    def _part(self, part: str) -> bytes | None:
        """Of a space and what follows up to the next; None where that space may
        belong to a longer run of white space."""
        if part == "" or part[0].isspace() or part[-1].isspace():
            return b""
        return b"".join([self.of_word[w] for w in self.words.findall(" " + part)])

    def ordinary(self, text: str) -> bytes:
        """Where all spaces stand alone, each starts a word of the split, so that
        parts between them are encoded on their own; else the text is split whole."""
        first, *parts = text.split(" ")
        if not parts or not first or first[-1].isspace():
            return b"".join([self.of_word[w] for w in self.words.findall(text)])
        found = [self.of_part[p] for p in parts]
        if not all(found):
            return b"".join([self.of_word[w] for w in self.words.findall(text)])
        return b"".join([self.of_word[w] for w in self.words.findall(first)] + found)

    def encode(self, text: str) -> bytes:
        if not self.split_added or not self.split_added.search(text):
            return self.ordinary(text)
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += [self.ordinary(text[at : m.start()]), array("I", [self.added[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self.ordinary(text[at:])])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(vocabulary: str, pattern: str) -> Bpe:
    """One for each Python worker."""
    return Bpe(vocabulary, pattern)


def vocabulary_file() -> tuple[str, str]:
    """Place and split pattern of the public vocabulary; the default parameters."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None, keep: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every row; with keep also
    ids (binary) and decoded."""
    own = vocabulary_file() if vocabulary is None or pattern is None else None
    vocabulary, pattern = vocabulary or own[0], pattern or own[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(vocabulary, pattern)
        for x in batches:
            rows = []
            for t in x["t"]:
                ids = bpe.encode(t)
                back = bpe.decode(ids)
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest())
                rows.append((*row, ids, back) if keep else row)
            names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep else [])]
            yield pd.concat((x[["id"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)), axis=1)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), text_of(text).alias("t"))
    return rows.mapInPandas(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
