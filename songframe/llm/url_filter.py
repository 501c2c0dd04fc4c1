"""URL filters: rules by host and path, then a list of URLs behind a blocked Bloom
filter.

Rules are few and fixed, so they become one expression. A URL that no rule fits is
looked up in the list, a table of whole URLs in any spelling: both sides are brought to
canonical form first. The form hashes to one 64-bit block of the filter, which has
a block for every URLS_PER_BLOCK listed URLs; only URLs whose bits are all set, in
all some one in a hundred of those not listed, go to the exact join with the list, which
removes false positives. The filter is broadcast in shards of at most MOST_BLOCKS
blocks, a row meeting the shard of its own hash. Possible hits are counted by
canonical form before the exact join, so a URL in a third of all rows meets the list as
one row.

A null url, or one without "://", has an empty host and path: no rule fits it and it is
in no list, so it is allowed. Null and unreadable entries of the list are passed over.
Repeated rows are judged alike, empty tables and lists give empty results and no
hits, and other columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from songframe.llm.common import few_rows, staged, table, with_group

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The list that is taken where none is given; one URL a line.
LIST_FILE = Path(__file__).with_name("listed_urls.txt")
#: Query parameters that do not change the page.
TRACKING = "utm_[a-z]+|ref"
URLS_PER_BLOCK, BITS = 5, 4
#: Blocks of a shard of the filter: what is broadcast at once.
MOST_BLOCKS = 1 << 19


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """host and path without a last slash, and the query without tracking
    parameters; scheme and fragment go. Null where the URL has no host."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(f"^({TRACKING})(=|$)")))
    host = host_of(url)
    bare = F.concat(host, F.regexp_replace(path_of(url), "/+$", ""))
    return F.when(host != "", F.when(F.size(kept) > 0, F.concat(bare, F.lit("?"), F.concat_ws("&", kept))).otherwise(bare))


def rule_column(rules: Sequence[tuple[str, str, str]], host: Column, path: Column, value: Column | None = None) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = None, None
    for act, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, act) if verdict is None else verdict.when(fits, act)
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _bits(url: Column) -> Column:
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        mask = mask.bitwiseOR(F.expr(f"shiftleft(1L, cast(pmod(shiftright(bloom_hash, {6 * i}), 64) as int))"))
    return mask


def _placed(urls: DataFrame, blocks: int) -> DataFrame:
    hashed = urls.withColumn("bloom_hash", F.xxhash64("canon", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("canon"), F.lit(blocks)))
    return hashed.withColumn("bits", _bits(F.col("canon"))).drop("bloom_hash")


def bloom_filter(listed: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Blocks (block, mask) of the n URLs in column `canon`, and how many there can be."""
    blocks = max(1, n // URLS_PER_BLOCK)
    return _placed(listed, blocks).groupBy("block").agg(F.bit_or("bits").alias("mask")), blocks


def in_list(urls: DataFrame, listed: DataFrame, most: int = MOST_BLOCKS) -> DataFrame:
    """urls (with column `canon`) and a boolean `listed`."""
    listed = staged(listed.where(F.col("canon").isNotNull()).select("canon").distinct(), "listed")
    blooms, blocks = bloom_filter(listed, listed.count())
    blooms, shards = staged(blooms, "filter"), -(-blocks // most)
    probe, known = _placed(urls, blocks), F.col("canon").isNotNull()
    possible = None
    for shard in range(shards):
        own = F.pmod("block", F.lit(shards)) == shard
        part = probe.where(known & own).join(F.broadcast(blooms.where(own)), "block", "left")
        possible = part if possible is None else possible.unionByName(part)
    maybe = F.coalesce(F.col("mask").bitwiseAND(F.col("bits")) == F.col("bits"), F.lit(False))
    possible = possible.withColumn("maybe", maybe).drop("block", "bits", "mask")
    counts = possible.where("maybe").groupBy("canon").agg(F.count(F.lit(1)).alias("n"))
    exact = counts.join(listed.withColumn("listed", F.lit(True)).hint("shuffle_hash"), "canon", "left")
    exact = staged(exact.select(F.col("canon").alias("own"), "n", F.coalesce("listed", F.lit(False)).alias("listed")), "hits")
    hits = with_group(possible.where("maybe").drop("maybe"), exact, "canon", "own")
    sure = possible.where(~F.col("maybe")).drop("maybe").unionByName(urls.where(~known))
    return hits.unionByName(sure.withColumn("listed", F.lit(False)))


def judge(pages: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, most: int = MOST_BLOCKS) -> DataFrame:
    """key, host, path, rule and verdict of every row; listed has a column url."""
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = rule_column(rules, F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    # what a rule decides is not looked up
    rows = rows.withColumn("canon", F.when(F.col("ruled").isNull(), canonical(F.col("url")))).drop("url")
    method = F.when(F.col("listed"), "block").otherwise("allow")
    out = in_list(rows, listed.select(canonical(F.col("url")).alias("canon")), most)
    return out.select(F.col("id").alias(key), "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"))


def default_list(spark: SparkSession) -> DataFrame:
    """The list that ships with the package, a column url."""
    return few_rows(spark, "url", LIST_FILE.read_text().split())


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), default_list(spark))


def sql(listed: Sequence[str]) -> str:
    """The query as SQL, for a list of URLs."""
    rows = ", ".join("('" + u.replace("'", "''") + "')" for u in listed)
    return SQL.replace("VALUES LISTED", "VALUES " + rows) if rows else SQL.replace("VALUES LISTED", "SELECT NULL::VARCHAR WHERE FALSE")


SQL = r"""
WITH u AS (SELECT page_id, url, TRUE AS page FROM pages UNION ALL SELECT NULL, url, FALSE FROM (VALUES LISTED) AS l(url)),
p AS (SELECT *, translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path,
             list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)(=|$)'))) AS query FROM u),
c AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS canon FROM p),
r AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                     WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                     WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
                     WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                     WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM c WHERE page)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN EXISTS (SELECT 1 FROM c WHERE NOT c.page AND c.canon = r.canon) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
OP10_SQL = sql(LIST_FILE.read_text().split())
