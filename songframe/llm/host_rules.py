"""Quality rules, and verdicts on hosts.

All counts of a text are made row by row from its own words and lines (nothing
is exploded or shuffled). Failures are then summed by host, the host's rate is
shrunk towards all hosts' with a beta prior fitted by moments, and hosts whose
shrunk rate passes a limit are refused; their verdict is joined back.

Null text has no words and fails. Null is a host of its own. Repeated rows are
judged alike, an empty table gives an empty result and other columns are never
read. Verdicts are broadcast if the count of hosts is within a bound; beyond it only
those of the hottest hosts are, and the other rows meet theirs by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.llm.common import GROUP_ROWS, SPACE, WORD, staged, table, text_of, with_group

FEWEST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: A host is refused if its shrunk rate of failing documents passes this.
MOST_FAILING = 0.5
#: Documents that the prior may stand for.
MOST_STRENGTH = 1e9


def let(value: Column, f) -> Column:
    """f(value), with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), f), 1)


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Words within n-word windows that occur twice or more in the text.

    Words are hashed once and a window is the hash of its words' hashes. A text in which
    all differ is done; otherwise the (hash, position) pairs are sorted, positions of
    equal neighbours kept, and their spans' union measured."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n))))

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), windows)

    def covered(at: Column) -> Column:
        steps = F.zip_with(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(n)))
        return F.aggregate(steps, F.lit(n), lambda a, x: a + x)

    def positions(h: Column) -> Column:
        pairs = F.array_sort(F.zip_with(h, F.sequence(F.lit(1), F.size(h)), lambda a, i: F.struct(a.alias("h"), i.alias("i"))))

        def equal(p: Column) -> Column:
            rest = F.size(p) - 1
            same = F.zip_with(F.slice(p, 1, rest), F.slice(p, 2, rest), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            return F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))

        return let(pairs, equal)

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(positions(h), covered)).otherwise(0)

    return F.when(F.size(words) > n, let(hashes, count)).otherwise(0)


def rule_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = F.col("t")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    words = F.filter(F.split(t, f"{SPACE}+"), lambda x: x != "")
    rows = docs.select(F.col(key).alias("id"), F.col(host).alias("host"), text_of(text).alias("t")).select(
        "id", "host",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r"))).alias("w"),
        (F.char_length(t) - F.regexp_count(t, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    n, r = F.col("w.n"), F.col("w.r")
    failed = (n < FEWEST_WORDS) | (100 * r > MOST_REPEATED * n)
    return rows.select("id", "host", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"), failed.alias("base_failed"))


def host_verdicts(rows: DataFrame, limit: float = MOST_FAILING) -> DataFrame:
    """host, n, shrunk_rate and refused, as a stored table.

    With m the share of all documents that fail and v the variance of the hosts' rates
    around it, both weighted by documents, a beta prior of mean m and strength a + b
    predicts v / (m (1 - m)) = H/N + (1 - H/N) / (a + b + 1) for H hosts of N documents:
    H/N is what chance alone spreads the rates of hosts that are all alike. Hosts that
    vary no more than that shrink to m wholly."""
    hosts = staged(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("bad")), "hosts")
    rate = F.col("bad") / F.col("n")
    got = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.sum(F.col("n") * rate * rate).alias("sq")).first()
    m, strength = got.bad / got.n if got.n else 0.0, MOST_STRENGTH
    if 0 < m < 1 and got.hosts < got.n:
        noise = got.hosts / got.n
        spread = ((got.sq / got.n - m * m) / (m * (1 - m)) - noise) / (1 - noise)
        strength = min(MOST_STRENGTH, max(0.0, 1 / spread - 1)) if spread > 0 else MOST_STRENGTH
    shrunk = (F.col("bad") + m * strength) / (F.col("n") + strength)
    return staged(hosts.select("host", "n", shrunk.alias("shrunk_rate"), (shrunk > limit).alias("refused")), "verdicts")


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", bound: int = GROUP_ROWS) -> DataFrame:
    """The columns of rule_counts(), shrunk_rate and kept, of every row."""
    rows = staged(rule_counts(docs, key, text, host), "rules")
    verdicts = host_verdicts(rows).withColumnRenamed("host", "own")
    return with_group(rows, verdicts, "host", "own", bound).withColumn("kept", ~(F.col("base_failed") | F.col("refused"))).drop("refused")


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, words[i:i + 7] AS win FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w WHERE len(words) >= 8)),
x AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, sum(least(coalesce(lead_i - i, 8), 8))::BIGINT AS n
      FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS lead_i FROM x) GROUP BY rid),
c AS (SELECT w.doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r ON w.rid = r.rid),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM f GROUP BY source),
p AS (SELECT sum(bad) / sum(n) AS m, sum(n * (bad / n) * (bad / n)) / sum(n) - (sum(bad) / sum(n)) * (sum(bad) / sum(n)) AS v, count(*) / sum(n) AS noise FROM h),
q AS (SELECT m, CASE WHEN m > 0 AND m < 1 AND noise < 1 THEN (v / (m * (1 - m)) - noise) / (1 - noise) END AS spread FROM p),
k AS (SELECT m, CASE WHEN spread > 0 THEN least(1e9, greatest(0, 1 / spread - 1)) ELSE 1e9 END AS strength FROM q),
v AS (SELECT source, (bad + m * strength) / (n + strength) > 0.5 AS refused FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR refused) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
