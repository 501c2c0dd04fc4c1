r"""Token counts without token ids.

A text is cut into pre-tokens that no piece of the vocabulary can span: a run of
spaces with what follows up to the next space or line end, and each line end by
itself. So a text has as many tokens as its pre-tokens have together. Each document
becomes the frequencies of its distinct pre-tokens. The distinct pre-tokens of a batch of
documents have their pieces counted once, by the public library; counts and
frequencies meet in a join by the pre-token's place among the distinct ones, and
their products are summed by document.

The join stays within a batch, so that nothing is shuffled: a word costs less to count
again than to send to its one place in the corpus and back. Memory is bounded by one
batch of documents.

Null text counts as empty and has no tokens. Rows may repeat, ids too, each row is
counted; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.llm.common import small_batches, table, text_of

#: Tokens that a context of the model has room for.
LIMIT = 4096
#: The space as the vocabulary writes it.
SPACE_MARK = "▁"


class Pieces:
    """The public library for one vocabulary, and the cuts that its pieces allow."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        names = map(self.library.id_to_piece, range(self.library.get_piece_size()))
        if any(SPACE_MARK in x.lstrip(SPACE_MARK) or "\n" in x for x in names):
            raise ValueError("pieces of this vocabulary reach over spaces or lines, so that counts of pre-tokens do not add up")
        self.words = re.compile(f"[ {SPACE_MARK}]+[^ {SPACE_MARK}\n]*|\n|[^ {SPACE_MARK}\n]+")
        # A line end in front takes the space that the library adds, and reaches no further.
        self.stop = len(self.library.encode("\n"))

    def pre_tokens(self, text: str) -> list[str]:
        """All of a text's, in order; the library puts a space before a text."""
        return self.words.findall(" " + text) if text else []

    def counts(self, words: list[str]) -> list[int]:
        return [len(x) - self.stop for x in self.library.encode(["\n" + w for w in words], num_threads=1)]


@functools.lru_cache(maxsize=2)
def load(vocabulary: str) -> Pieces:
    """One for each Python worker."""
    return Pieces(vocabulary)


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def frequencies(texts: list[str], pieces: Pieces) -> pa.Table:
    """doc (place among the texts), word and times: the distinct pre-tokens of each text."""
    docs, words, times = [], [], []
    for doc, text in enumerate(texts):
        found = Counter(pieces.pre_tokens(text))
        docs += [doc] * len(found)
        words += found.keys()
        times += found.values()
    return pa.table({"doc": pa.array(docs, pa.int64()), "word": pa.array(words, pa.string()).dictionary_encode(), "times": pa.array(times, pa.int64())})


def totals(found: pa.Table, pieces: Pieces) -> dict[int, int]:
    """Tokens of each doc that has any: counts of the distinct words, joined and summed."""
    words = found["word"].combine_chunks()
    counts = pa.array(pieces.counts(words.dictionary.to_pylist()), pa.int64())
    found = found.append_column("tokens", pc.multiply(found["times"], pc.take(counts, words.indices)))
    sums = found.group_by("doc").aggregate([("tokens", "sum")])
    return dict(zip(sums["doc"].to_pylist(), sums["tokens_sum"].to_pylist(), strict=True))


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row."""
    vocabulary = vocabulary or vocabulary_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(vocabulary)
        for batch in batches:
            found = totals(frequencies(batch["t"].to_pylist(), pieces), pieces)
            n = pa.array([found.get(doc, 0) for doc in range(batch.num_rows)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["n_bytes"], n, pc.greater(n, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"), text_of(text).alias("t"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
