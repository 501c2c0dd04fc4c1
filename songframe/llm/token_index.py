"""Token ids in sharded binary files, under a minimal perfect hash index.

Documents are sorted by ranges of their id. A task encodes its range with a public
tokenizer (word by word, as words recur), appends the end id and writes the raw ids (unsigned little-endian,
two bytes where the vocabulary allows, else four) as one shard. The index is
dealt into buckets by a hash of the key. For each bucket of about BUCKET keys a
minimal perfect hash is built by hash and displace: keys fall into small groups;
the largest groups first, each looks for the displacement that sends its keys
to free slots, and groups of one take a free slot outright. A slot stores a
32-bit fingerprint of its key and where the ids are: shard, offset, count. A lookup
takes one displacement and one slot, and rejects keys whose fingerprint differs.

A key is a document's id and its number among the rows of that id in the order of the
files (by_id), so that a document is found by its id alone, as number 0; or else the id
with the hash of its text and the number among rows that are alike in both. Rows
that repeat, or have no id, have keys of their own either way. Null text counts as empty: its record is the end id alone. Documents
without id come first. An empty table gives an empty index and an empty result;
other columns are never read.
"""

from __future__ import annotations

import functools
import json
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from songframe.llm.bpe import byte_letters
from songframe.llm.common import new_path, partitions, small_batches, staged, table, text_of
from songframe.llm.files import NewFile, drop_leftovers, make_dir, opened
from songframe.llm.words import Recent

END = 1
BUCKET = 1024
#: Keys of a group, on average; displacements tried at a time.
GROUP, TRIES = 4, 256
#: Bytes that a lookup reads from a shard at a time.
READ_BYTES = 8 << 20
ENTRY = "id string, th long, nth long, shard int, at long, n long"


def vocabulary_file() -> str:
    """Place of the public vocabulary; the default parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: ASCII marks that the split never joins to a letter or digit before them, and
#: that no added token of the vocabulary ends with.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


class Encoder:
    """The library's ids of a text, put together from those of its words.

    The vocabulary's split never spans a space or a line end, nor the place
    between a letter or digit and ASCII marks, so that these parts can be encoded
    one by one; as words recur, the ids of recent ones are kept."""

    def __init__(self, vocabulary: str, kind: str):
        from tokenizers import Tokenizer

        self.own, self.code = Tokenizer.from_file(vocabulary), "H" if kind == "<u2" else "I"
        self.own.no_truncation()
        self.own.no_padding()
        self.model, self.letters = self.own.model, byte_letters()
        self.of_word, self.of_part = Recent(self._word, 350_000), Recent(self._part, 350_000)

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _part(self, part: str) -> bytes:
        small = "".join(map(str.lower, part))
        if part.isalpha() and small.isalpha() and unicodedata.is_normalized("NFC", part):  # one word of the split, so only the merges are left
            spelt = small if small.isascii() else "".join([self.letters[b] for b in small.encode("utf-8")])
            return self._packed([x.id for x in self.model.tokenize(spelt)])
        return self._packed(self.own.encode(part, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        bare = word.rstrip(MARKS)
        if bare and bare != word and bare.lower()[-1].isalnum():
            return self.of_part[bare] + self.of_part[word[len(bare) :]]
        return self.of_part[word]

    def encode(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        return b"".join([self.of_word[w] for w in words])


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str, kind: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(vocabulary, kind)


def id_type(vocabulary: str) -> str:
    """numpy type of an id in the files."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    most = max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"]), END])
    return "<u2" if most < 1 << 16 else "<u4"


def shard_name(shard: int) -> str:
    return f"ids-{shard:06d}.bin"


def write_shards(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Write the shards; a row of ENTRY for every document, as a table."""
    vocabulary = vocabulary or vocabulary_file()
    kind = id_type(vocabulary)
    make_dir(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, shard, at, last, nth = encoder(vocabulary, kind), TaskContext.get().partitionId(), 0, None, 0
        stop, file = np.array([end], kind).tobytes(), None
        try:
            for x in batches:
                rows = []
                for key_, th, text_ in zip(x["id"], x["th"], x["t"], strict=True):
                    ids = own.encode(text_) + stop
                    file = file or NewFile(folder, shard_name(shard))
                    file.write(ids)
                    nth = nth + 1 if (key_, th) == last else 0
                    last, n = (key_, th), len(ids) // len(stop)
                    rows.append((key_, th, nth, shard, at, n))
                    at += n
                yield pd.DataFrame(rows, columns=["id", "th", "nth", "shard", "at", "n"])
            if file is not None:
                file.commit()
                file = None
        finally:
            if file is not None:
                file.drop()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("k"), text_of(text).alias("t")).withColumn("th", F.xxhash64("t"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "k", "th").sortWithinPartitions("k", "th")
    entries = staged(rows.select(F.col("k").cast("string").alias("id"), "th", "t").mapInPandas(run, ENTRY), "entries")
    drop_leftovers(folder)
    return entries


def by_id(entries: DataFrame) -> DataFrame:
    """entries keyed by id alone: th is 0, and nth numbers the rows of an id in the order
    of the files. Equal ids lie side by side, so only the first id of a shard may go on
    from shards before it; a row for each shard comes to the driver."""
    own = Window.partitionBy("shard", "id").orderBy("at")
    rows = staged(entries.withColumn("local", F.row_number().over(own) - 1), "numbered")
    ends = rows.groupBy("shard").agg(F.min_by(F.struct("id"), "at").alias("first"), F.max_by(F.struct("id", "local"), "at").alias("last")).orderBy("shard")
    starts, before, last = [], 0, None
    for shard, (first,), (end, local) in ends.collect():
        offset = before if last == (first,) else 0
        starts.append((shard, first, offset))
        before, last = local + 1 + (offset if first == end else 0), (end,)
    starts = entries.sparkSession.createDataFrame(starts, "shard int, first string, offset long")
    goes_on = F.when(F.col("id").eqNullSafe(F.col("first")), F.col("offset")).otherwise(0)
    rows = rows.join(F.broadcast(starts), "shard").withColumns({"th": F.lit(0).cast("long"), "nth": F.col("local") + goes_on})
    return rows.select("id", "th", "nth", "shard", "at", "n")


def keys_of(ids: DataFrame, key: str = "doc_id", chunk: int = 1 << 16) -> DataFrame:
    """Keys (id, th, nth) of by_id() for every row of a table of ids, repeated ones too."""
    many = ids.groupBy(F.col(key).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("rows"))
    many = many.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(chunk).cast("long")))).repartition(partitions(ids.sparkSession), "id", "start")
    nth = F.explode(F.sequence("start", F.least(F.col("start") + chunk, "rows") - 1))
    return many.select("id", F.lit(0).cast("long").alias("th"), nth.alias("nth"))


# ------------------------------------------------------------------ the index


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(h1: np.ndarray, h2: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    """Slot of each key; displacements below zero name a slot outright."""
    found = mixed(h1 + (displacement.astype(np.uint64) + np.uint64(1)) * (h2 | np.uint64(1))) % np.uint64(n)
    return np.where(displacement < 0, -1 - displacement, found.astype(np.int64))


def groups_of(h2: np.ndarray, n: int) -> np.ndarray:
    return (mixed(h2) % np.uint64(max(1, n // GROUP))).astype(np.int64)


def fingerprint_of(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mixed(h1 ^ (h2 * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(32)).astype(np.uint32)


def displacements(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """One number for each group, so that slots() is one-to-one onto 0..n-1."""
    n = len(h1)
    group = groups_of(h2, n)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(max(1, n // GROUP) + 1))
    sizes = np.diff(bounds)
    taken, out = np.zeros(n, bool), np.zeros(len(sizes), np.int64)
    for g in np.argsort(-sizes, kind="stable"):
        own = order[bounds[g] : bounds[g + 1]]
        if len(own) <= 1:
            break
        start = 0
        while True:
            tries = np.arange(start, start + TRIES)
            at = slots(h1[own][None, :], h2[own][None, :], tries[:, None], n)
            lined = np.sort(at, axis=1)
            good = ~taken[at].any(axis=1) & (lined[:, 1:] != lined[:, :-1]).all(axis=1)
            if good.any():
                first = int(np.argmax(good))
                out[g] = start + first
                taken[at[first]] = True
                break
            start += TRIES
    single = np.flatnonzero(sizes == 1)
    out[single] = -1 - np.flatnonzero(~taken)[: len(single)]
    return out


INDEX = "bucket int, n int, displacement binary, fingerprint binary, shard binary, at binary, count binary"


def with_hashes(keys: DataFrame, buckets: int) -> DataFrame:
    """keys (id, th, nth) with two hashes and a bucket."""
    rows = keys.withColumn("h1", F.xxhash64("id", "th", "nth")).withColumn("h2", F.xxhash64(F.lit(1), "nth", "th", "id"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("h2"), F.lit(buckets)).cast("int"))


def _u64(x: pd.Series) -> np.ndarray:
    return x.to_numpy(np.int64).view(np.uint64)


def build_index(entries: DataFrame, size: int = BUCKET) -> tuple[DataFrame, int]:
    """A row of INDEX for each bucket, as a table, and the count of buckets."""
    buckets = max(1, -(-entries.count() // size))

    def build(x: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = _u64(x["h1"]), _u64(x["h2"])
        found = displacements(h1, h2)
        at = np.argsort(slots(h1, h2, found[groups_of(h2, len(x))], len(x)))
        columns = (fingerprint_of(h1, h2), x["shard"].to_numpy(np.int32), x["at"].to_numpy(np.int64), x["n"].to_numpy(np.int64))
        return pd.DataFrame([(x["bucket"].iloc[0], len(x), found.tobytes(), *(c[at].tobytes() for c in columns))], columns=["bucket", "n", "displacement", "fingerprint", "shard", "at", "count"])

    rows = with_hashes(entries, buckets).select("bucket", "h1", "h2", "shard", "at", "n")
    return staged(rows.groupBy("bucket").applyInPandas(build, INDEX), "index"), buckets


def look_up(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """id, th, nth, shard, at, n of the keys (id, th, nth) that the index knows.

    An unknown key passes with probability 2^-32."""

    def find(x: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if x.empty or own.empty:
            return x.iloc[:0][["id", "th", "nth"]].assign(shard=0, at=0, n=0)
        i = own.iloc[0]
        h1, h2, n = _u64(x["h1"]), _u64(x["h2"]), int(i["n"])
        at = slots(h1, h2, np.frombuffer(i["displacement"], np.int64)[groups_of(h2, n)], n)
        known = np.frombuffer(i["fingerprint"], np.uint32)[at] == fingerprint_of(h1, h2)
        out = x[["id", "th", "nth"]].assign(shard=np.frombuffer(i["shard"], np.int32)[at], at=np.frombuffer(i["at"], np.int64)[at], n=np.frombuffer(i["count"], np.int64)[at])
        return out[known]

    rows = with_hashes(keys.select("id", "th", "nth"), buckets)
    return rows.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, ENTRY)


def read_ids(found: DataFrame, folder: str, kind: str, keep: bool = False) -> DataFrame:
    """The rows of look_up() with crc, the CRC-32 of the ids as little-endian
    unsigned 32-bit integers; with keep also ids, as such bytes.

    Rows are dealt by shard and sorted by offset, so that a task reads forward."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width, shard, held, begin = np.dtype(kind).itemsize, None, b"", 0
        with_file = None
        try:
            for x in batches:
                crcs, ids = [], []
                for s, at, n in zip(x["shard"], x["at"], x["n"], strict=True):
                    if s != shard:
                        if with_file is not None:
                            with_file.__exit__(None, None, None)
                        with_file = opened(folder, shard_name(s))
                        file, shard, held, begin = with_file.__enter__(), s, b"", 0
                    lo, hi = at * width, (at + n) * width
                    if not begin <= lo <= hi <= begin + len(held):
                        file.seek(lo)
                        begin, held = lo, file.read(max(READ_BYTES, hi - lo))
                    own = np.frombuffer(held, kind, n, lo - begin).astype("<u4").tobytes()
                    crcs.append(zlib.crc32(own))
                    ids.append(own)
                x = x.assign(crc=np.array(crcs, np.int64))
                yield x.assign(ids=ids) if keep else x
        finally:
            if with_file is not None:
                with_file.__exit__(None, None, None)

    rows = found.repartition(partitions(found.sparkSession), "shard").sortWithinPartitions("shard", "at")
    return rows.mapInPandas(run, ENTRY + ", crc long" + ", ids binary" * keep)


def starts(entries: DataFrame) -> DataFrame:
    """(shard, before): ids in the shards before each; a row for each shard."""
    before, out = 0, []
    for r in entries.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect():
        out.append((r.shard, before))
        before += r.n
    return entries.sparkSession.createDataFrame(out, "shard int, before long")


def op2_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder, vocabulary = new_path(spark, "ids"), vocabulary_file()
    entries = staged(by_id(write_shards(docs, folder, vocabulary=vocabulary)), "by-id")
    index, buckets = build_index(entries)
    rows = read_ids(look_up(keys_of(docs), index, buckets), folder, id_type(vocabulary))
    rows = rows.join(F.broadcast(starts(entries)), "shard")
    return rows.select(F.col("id").cast("long").alias("doc_id"), (F.col("before") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
