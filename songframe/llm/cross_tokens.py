"""Alignment of two tokenizations of the same text.

Both tokenizations are arrays of token lengths in bytes. Repeating each token's
number over its bytes gives the owner of every byte, for A and for B. Where the
pair of owners changes, a new pair of overlapping tokens begins: a link. Where both
owners change at once, both tokens end: a cut, and the tokens between two cuts are a
group. Of each pair of ids the corpus counts the documents that hold it linked.

A is a byte-level BPE, whose entries are decoded to bytes (a public library merges by the
ids, which are in the order of the merges); B is a vocabulary of
pieces, with a mark for the space and entries for single bytes. Strings of special
tokens are plain text to both. Both encode a space and the text.

Texts that are null or empty, or that A or B does not give back byte by byte (B has no
mark of its own for the space), have no tokens and no links. Rows may repeat, ids too,
each row is a document; an empty table gives an empty result; other columns are never
read. Memory is bounded by a batch of documents and one document's tokens.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.llm import bpe, keyed_sums
from songframe.llm.common import small_batches, staged, table, text_of
from songframe.llm.token_counts import SPACE_MARK, load as pieces_of, vocabulary_file as piece_file

#: A pair of ids as one number: A's id above so many bits of B's.
ID_BITS = 32


class Bytes:
    """Names in bytes of one of the two vocabularies."""

    def __init__(self, names: list[bytes]):
        self.names = names
        self.lengths = np.array([len(x) for x in names], np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.names.__getitem__, ids.tolist()))


class Tokenizers:
    def __init__(self, byte_vocabulary: str, pattern: str, piece_vocabulary: str):
        import tiktoken

        spec = bpe.load(byte_vocabulary, pattern)
        merged = [new for _, new in sorted(spec.merges.values())]
        if merged != sorted(merged):
            raise ValueError("ids of this vocabulary are not in the order of its merges")
        ranks = {name: i for i, name in spec.bytes.items() if i not in spec.added.values()}
        self.byte_library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a = Bytes([spec.bytes.get(i, b"") for i in range(max(spec.bytes) + 1)])
        self.pieces = pieces_of(piece_vocabulary).library
        ids = range(self.pieces.get_piece_size())
        self.b = Bytes([bytes([int(self.pieces.id_to_piece(i)[3:-1], 16)]) if self.pieces.is_byte(i) else self.pieces.id_to_piece(i).replace(SPACE_MARK, " ").encode() for i in ids])
        # Each id with the mark that may follow it in the text of groups.
        self.written = [f"{i}{mark}" for i in range(max(len(self.a.names), len(self.b.names))) for mark in ",|;"]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B; none where either does not give the text back."""
        if text:
            whole = " " + text
            a = np.array(self.byte_library.encode_ordinary(whole), np.int64)
            b = np.array(self.pieces.encode(text), np.int64)
            want = whole.encode("utf-8")
            if self.a.joined(a) == want and self.b.joined(b) == want:
                return a, b
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def groups_text(self, a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray) -> str:
        """a1,a2|b1;a3|b2,b3: ids of A and of B of each group, which begins at the tokens
        from_a and from_b."""
        if not len(from_a):
            return ""
        in_a, in_b = np.diff(from_a, append=len(a)), np.diff(from_b, append=len(b))
        marks_a, marks_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        marks_a[from_a + in_a - 1], marks_b[from_b + in_b - 1] = 1, 2
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(from_b, in_a)] = 3 * a + marks_a
        out[np.arange(len(b)) + np.repeat(from_a + in_a, in_b)] = 3 * b + marks_b
        return "".join(map(self.written.__getitem__, out.tolist()))[:-1]


@functools.lru_cache(maxsize=2)
def load(byte_vocabulary: str, pattern: str, piece_vocabulary: str) -> Tokenizers:
    """One for each Python worker."""
    return Tokenizers(byte_vocabulary, pattern, piece_vocabulary)


def align(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers of A and of B of all links in order, and the places among the links
    where a group begins. Lengths are positive and have the same sum."""
    owner_a = np.repeat(np.arange(len(a_lengths)), a_lengths)
    owner_b = np.repeat(np.arange(len(b_lengths)), b_lengths)
    if not len(owner_a):
        return owner_a, owner_b, owner_a
    new_a, new_b = owner_a[1:] != owner_a[:-1], owner_b[1:] != owner_b[:-1]
    starts = np.concatenate(([0], np.flatnonzero(new_a | new_b) + 1))
    cuts = np.concatenate(([0], np.flatnonzero(new_a & new_b) + 1))
    return owner_a[starts], owner_b[starts], np.searchsorted(starts, cuts)


def links(docs: DataFrame, key: str, text: str, vocabularies: tuple[str, str, str]) -> DataFrame:
    """row, id, n_a, n_b, n_groups, n_links, groups, and the distinct pairs of linked ids
    (keys, packed) with the number of links of each (times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = load(*vocabularies)
        for batch in batches:
            facts, groups, keys, times, ends = [], [], [], [], [0]
            for text in batch["t"]:
                a, b = both.encode(text.as_py())
                link_a, link_b, first = align(both.a.lengths[a], both.b.lengths[b])
                pairs, n = np.unique((a[link_a] << ID_BITS) | b[link_b], return_counts=True)
                facts.append((len(a), len(b), len(first), len(link_a)))
                groups.append(both.groups_text(a, b, link_a[first], link_b[first]))
                keys.append(pairs)
                times.append(n)
                ends.append(ends[-1] + len(pairs))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), pa.int64())) for x in (keys, times)]
            counts = [pa.array(x, pa.int64()) for x in zip(*facts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["id"], *counts, pa.array(groups, pa.string()), *lists], names)

    small_batches(docs.sparkSession)
    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "keys", "times"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), text_of(text).alias("t"))
    return rows.mapInArrow(run, "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups string, keys array<long>, times array<long>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """of (a packed pair), n (documents that hold it linked) and best: whether no other
    pair of its A id has a larger n. A ids are at most the vocabulary: a side to broadcast."""
    pairs = staged(keyed_sums.holders(rows), "pairs").withColumn("a", F.shiftright("of", ID_BITS))
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))
    return pairs.join(F.broadcast(most), "a").select("of", "n", (F.col("n") == F.col("most")).alias("best"), F.col("n").alias("held"))


def cross_align(docs: DataFrame, key: str = "doc_id", text: str = "text", byte_vocabulary: str | None = None, pattern: str | None = None, piece_vocabulary: str | None = None, keep_groups: bool = True) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best (links whose pair is the best of its A id),
    count_sum (documents that hold the pair, over all links) and groups of every row; groups_sha256 in
    place of groups without keep_groups, so that long strings are not stored."""
    own = bpe.vocabulary_file() if byte_vocabulary is None or pattern is None else (byte_vocabulary, pattern)
    rows = links(docs, key, text, (byte_vocabulary or own[0], pattern or own[1], piece_vocabulary or piece_file()))
    if not keep_groups:
        digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
        rows = rows.withColumn("groups_sha256", digest).drop("groups")
    rows = staged(rows, "links")
    said = staged(pair_counts(rows), "pair-counts")
    sums = {"n_best": F.when(F.col("best"), F.col("times")).otherwise(0), "count_sum": F.col("times") * F.col("held")}
    found = keyed_sums.with_sums(rows, said, sums)
    return found.select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups" if keep_groups else "groups_sha256")


def op11_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_align(table(spark, sf_dir, "documents"), keep_groups=False).withColumnRenamed("id", "doc_id")
