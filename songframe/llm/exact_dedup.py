"""Exact duplicates with a heavy-hitter split.

A frequent-items sketch (Misra-Gries counters, merged map-side) names digests
that may be frequent. Their groups are counted exactly; the verified winners, at
most TRACKED rows, are broadcast and settle their rows where they lie. All other
digests go through an ordinary shuffle, which then has no hot key.

Texts are equal when they are identical without ASCII white space. Of equal
texts the row with the most code points stays, then the smallest doc_id (nulls
last), then the first of fully repeated rows. Null text counts as empty; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.llm.common import SPACE, few_rows, small, staged, table, text_of

#: Digests that the sketch returns, and counters that it keeps.
TRACKED, COUNTERS = 512, 8192
#: A digest is frequent from this share of all rows on.
SHARE = 1 / 2000


def digest_of(text: str) -> Column:
    return F.sha2(F.regexp_replace(text_of(text), f"{SPACE}+", ""), 256)


def _stays() -> list[Column]:
    order = F.struct(-F.col("cp"), F.col("id").isNull(), F.col("id"), F.col("row"))
    return [F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best")]


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, digest, cp, keep_id, keep_cp, group_size, kept."""
    rows = staged(
        docs.select(F.col(key).alias("id"), digest_of(text).alias("digest"), F.char_length(text_of(text)).cast("long").alias("cp")).withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    named = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(digest, {TRACKED}, {COUNTERS})").alias("top")).first()
    least = max(2, int(named.n * SHARE))
    likely = few_rows(rows.sparkSession, "digest", [x["item"] for x in named.top or [] if x["count"] >= least])
    winners = rows.join(F.broadcast(likely), "digest").groupBy("digest").agg(*_stays()).where(F.col("group_size") >= least)
    winners = staged(winners, "heavy")
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    heavy = rows.join(F.broadcast(winners), "digest")
    both = heavy.unionByName(light.join(light.groupBy("digest").agg(*_stays()), "digest"))
    return both.select(
        "id", "digest", "cp",
        F.col("best.id").alias("keep_id"), (-F.col("best.col1")).alias("keep_cp"),
        "group_size", (F.col("row") == F.col("best.row")).alias("kept"),
    )


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that exact_groups() does not keep."""
    names = docs.columns
    gone = staged(exact_groups(docs, key, text).where(~F.col("kept")), "gone")
    gone = gone.withColumn("same", F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("cp") == F.col("keep_cp")))
    known = gone.agg(F.count_if("same").alias("same"), F.count_if(~F.col("same")).alias("other")).first()
    cols = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = {c: f"c{i}" for i, c in enumerate(names)}
    cols = cols.withColumn("d", digest_of(at[text])).withColumn("n", F.char_length(text_of(at[text])).cast("long"))

    def on(x: DataFrame) -> Column:
        return cols[at[key]].eqNullSafe(x["id"]) & (cols["d"] == x["digest"]) & (cols["n"] == x["cp"])

    other = gone.where(~F.col("same")).select("id", "digest", "cp").distinct()
    cols = cols.join(small(other, known.other), on(other), "left_anti")
    if known.same:  # repeated rows, alike in id and text: one of each stays
        again = gone.where("same").select("id", "digest", "cp").distinct()
        once = cols.join(small(again, known.same), on(again), "left_anti")
        one = cols.join(small(again, known.same), on(again), "left_semi").dropDuplicates([at[key], "d", "n"])
        cols = once.unionByName(one)
    return cols.select(*at.values()).toDF(*names)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS cp,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY cp DESC, doc_id NULLS LAST)
"""
