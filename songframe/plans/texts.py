"""Queries on lyrics, names and other text, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from songframe.functions import arrow, text
from songframe.operators import lyrics, metrics
from songframe.plans import tables as T
from songframe.plans.book import Book
from songframe.sources import library

Q = Book()

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
DISPLAY = STRIP.format(x="regexp_replace(" + STRIP.format(x="word") + r""", '^[.,;:!?"“”()¿¡]+|[.,;:!?"“”()¿¡]+$', '', 'g')""")
KEY = "regexp_replace(strip_accents(lower({x})), '[^a-z0-9]', '', 'g')"
DEPTH = T.RAW_WORDS + """,
s AS (SELECT *, length(word) - length(replace(word, '(', '')) AS o, length(word) - length(replace(word, ')', '')) AS c FROM raw_words),
r AS (SELECT *, sum(o - c) OVER (PARTITION BY chart_id, line_index ORDER BY word_index) AS run FROM s),
d AS (SELECT *, run - least(0, min(run) OVER (PARTITION BY chart_id, line_index ORDER BY word_index)) AS depth FROM r),
b AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY chart_id, line_index ORDER BY word_index), 0) > 0 OR o > 0 OR c > 0 AS adlib FROM d)
"""
TOKENS = DEPTH + ", tokens AS (SELECT *, " + KEY.format(x="text") + " AS key FROM (SELECT chart_id, line_index, word_index, " + DISPLAY + " AS text, word_index = 0 AND line_index > 0 AS new_line, adlib FROM b) WHERE " + KEY.format(x="text") + " <> '')\n"


@Q.add("WITH " + DEPTH + "SELECT chart_id, line_index, word_index, depth::BIGINT AS depth, adlib FROM b")
def bracket_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lyrics.bracketed_words(T.lines(spark, sf_dir)).select("chart_id", "line_index", "word_index", "depth", "adlib")


@Q.add("WITH " + TOKENS + "SELECT chart_id, line_index, word_index, text, key, new_line, adlib FROM tokens")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lyrics.tokens(T.lines(spark, sf_dir))


@Q.add("WITH " + TOKENS + "SELECT DISTINCT text, key, regexp_replace(strip_accents(lower(text)), '[^a-z]', '', 'g') AS letters FROM tokens")
def word_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lyrics.tokens(T.lines(spark, sf_dir)).select("text", "key", text.letters_key(F.col("text")).alias("letters")).distinct()


@Q.add(
    "WITH " + TOKENS + """, v AS (SELECT DISTINCT regexp_replace(strip_accents(lower(w)), '[^a-z0-9]', '', 'g') AS key FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM benchmark))
SELECT chart_id, count(*) AS n FROM tokens WHERE key IN (SELECT key FROM v) GROUP BY chart_id"""
)
def vocab_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document that occur in the benchmark."""
    known = T.read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("w")).select(text.word_key(F.col("w")).alias("key")).distinct()
    return lyrics.tokens(T.lines(spark, sf_dir)).join(known, "key", "left_semi").groupBy("chart_id").agg(F.count(F.lit(1)).alias("n"))


@Q.add("SELECT url, substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) AS slug FROM pages")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "pages").select("url", text.slug(F.col("url")).alias("slug"))


@Q.add(r"SELECT page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '[^A-Za-z0-9 ._()''\-áéíóúñüÁÉÍÓÚÑÜ]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), 1, 80), ''), 'song') AS name, CASE WHEN lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '[^.](\.[^.]*)$', 1)) IN ('.mp3', '.ogg', '.wav', '.m4a', '.flac', '.opus') THEN 'input' || lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '[^.](\.[^.]*)$', 1)) ELSE 'input.mp3' END AS audio FROM pages")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "pages").select("page_id", text.path_part(F.col("url"), F.lit("song")).alias("name"), text.audio_name(F.col("url")).alias("audio"))


@Q.add(
    r"""WITH n AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' & ' || p_brand WHEN 1 THEN ' feat. ' || p_brand WHEN 2 THEN ' y ' || p_brand ELSE '' END AS artist FROM part),
s AS (SELECT p_partkey, list_filter(list_transform(string_split_regex(artist, '(?i)\s+y\s+|\s+e\s+|\s*&\s*|\s*,\s*|\s+feat\.?\s+|\s+ft\.?\s+|\s+con\s+|\s+vs\.?\s+|\s+with\s+|\s+\+\s+|\s+x\s+'), lambda x: trim(x)), lambda x: length(x) > 1) AS a FROM n)
SELECT p_partkey, len(a)::INT AS n, a[1] AS first, len(a) >= 2 AS several FROM s"""
)
def split_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(' & ', p_brand) WHEN 1 THEN concat(' feat. ', p_brand) WHEN 2 THEN concat(' y ', p_brand) ELSE '' END")
    rows = T.read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", tail).alias("artist"))
    names = text.artists(F.col("artist"))
    return rows.select("p_partkey", F.size(names).alias("n"), F.try_element_at(names, F.lit(1)).alias("first"), text.several_artists(F.col("artist")).alias("several"))


@Q.add(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN 'tagged' ELSE coalesce(nullif(s_name, ''), 'Untitled') END AS title,
       CASE WHEN s_suppkey % 3 = 0 THEN 'Band' ELSE 'Unknown' END AS artist FROM supplier"""
)
def title_artist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third file is named "Band - name", every third has a title tag."""
    third = F.col("s_suppkey") % 3
    stem = F.when(third == 0, F.concat(F.lit("Band - "), "s_name")).otherwise(F.col("s_name"))
    tag, none = F.when(third == 1, "tagged"), F.lit(None).cast("string")
    return T.read(spark, sf_dir, "supplier").select("s_suppkey", text.title_of(stem, none, tag).alias("title"), text.artist_of(stem, none, none).alias("artist"))


@Q.add("SELECT doc_id, lang AS code, CASE WHEN lang IN ('es', 'en') THEN lang ELSE 'other' END AS lang_group, CASE WHEN regexp_full_match(lang, '[a-z]{2}|auto') THEN lang ELSE 'es' END AS chosen, CASE WHEN lang IN ('en', 'fr') THEN lang ELSE 'auto' END AS allowed FROM documents")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("lang") == "en", " English").when(F.col("lang") == "fr", "FRENCH").when(F.col("lang") == "de", "deutsch").when(F.col("lang") == "es", "español").otherwise(F.col("lang"))
    code = text.language_code(name)
    return T.read(spark, sf_dir, "documents").select("doc_id", code.alias("code"), text.language_group(code).alias("lang_group"), text.chosen_language(F.col("lang")).alias("chosen"), text.one_of(F.col("lang"), ("en", "fr"), "auto").alias("allowed"))


@Q.add(r"SELECT p_partkey, regexp_replace(regexp_replace(printf('%.4f', p_retailprice / 8), '0+$', ''), '\.$', '') AS shown, p_retailprice / 8 AS value FROM part")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, an eighth, written shortly; and read back with a decimal comma."""
    value = F.col("p_retailprice") / 8
    return T.read(spark, sf_dir, "part").select("p_partkey", text.number_text(value).alias("shown"), text.number_of(F.replace(value.cast("string"), F.lit("."), F.lit(","))).alias("value"))


@Q.add(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS lyric FROM documents")
def lyric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "documents").select("doc_id", text.lyric_text(F.col("text")).alias("lyric"))


@Q.add(
    r"""WITH l AS (SELECT conv_id AS key, turn, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS text FROM conversations)
SELECT key, ((turn // 60) * 60 + turn % 60 + 0.5)::DOUBLE AS t, text FROM l WHERE text <> ''"""
)
def lrc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns, each on a line, as a timed lyric of their conversation, and read again."""
    turns = T.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"\s+", " ").alias("s"))
    stamp = F.format_string("[%02d:%02d.50] ", F.floor(F.col("turn") / 60).cast("int"), (F.col("turn") % 60).cast("int"))
    whole = turns.groupBy(F.col("conv_id").alias("key")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", F.concat(stamp, "s").alias("l"))))["l"], "\n").alias("text"))
    return library.timed_lyrics(whole).select("key", "t", "text")


@Q.add("SELECT n_nationkey AS key, lower(r_name) AS tag, n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def file_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = T.read(spark, sf_dir, "nation"), T.read(spark, sf_dir, "region")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return library.tags(rows.select(F.col("n_nationkey").alias("key"), F.concat(F.lit("no tag\nTAG:"), "r_name", F.lit("=old\n"), "r_name", F.lit(" = "), "n_name").alias("text")))


@Q.add(
    """WITH s AS (SELECT chart_id, n FROM (SELECT doc_id AS chart_id, len(list_filter(list_transform(string_split(substr(text, 1, 20000), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''))::INT AS n FROM documents)) SELECT * FROM s"""
)
def typed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed lyric has 20000 characters at most: that limit is the feature."""
    return T.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chart_id"), F.size(library.typed_lyrics("text")).alias("n"))


@Q.add("SELECT c_custkey, coalesce(try_cast(CASE WHEN c_custkey % 5 = 0 THEN 'N/A' ELSE c_acctbal::VARCHAR END AS DOUBLE), 0) AS seconds FROM customer")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("c_custkey") % 5 == 0, "N/A").otherwise(F.col("c_acctbal").cast("string"))
    return T.read(spark, sf_dir, "customer").select("c_custkey", value.alias("v")).select("c_custkey", library.seconds("v").alias("seconds"))


@Q.add(
    """WITH f AS (SELECT l_orderkey AS folder, CASE WHEN l_linenumber = 1 THEN 'song.mp3' WHEN l_linenumber = 7 THEN 'other.MP3' WHEN l_linenumber % 3 = 0 THEN 'x [MULTI].txt' ELSE repeat('a', (l_partkey % 9)::INT) || 'g.txt' END AS file FROM lineitem),
g AS (SELECT folder, count(*) FILTER (lower(file) LIKE '%.mp3') AS mp3s, min(file) FILTER (lower(file) LIKE '%.mp3') AS mp3, min(struct_pack(n := length(file), f := file)) FILTER (file LIKE '%.txt' AND file NOT LIKE '%[MULTI]%') AS gold, min(file) FILTER (file LIKE '%[MULTI]%') AS multi FROM f GROUP BY folder)
SELECT folder, mp3, gold.f AS gold, multi FROM g WHERE mp3s = 1 AND gold IS NOT NULL"""
)
def library_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as song folders, their lines as files."""
    n = F.col("l_linenumber")
    name = F.when(n == 1, F.lit("song.mp3")).when(n == 7, "other.MP3").when(n % 3 == 0, "x [MULTI].txt").otherwise(F.concat(F.expr("repeat('a', cast(l_partkey % 9 as int))"), F.lit("g.txt")))
    return library.songs(T.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("folder"), name.alias("file")))


@Q.add(
    """WITH s AS (SELECT p_partkey, p_brand AS artist, p_type AS title, p_size AS duration FROM part),
l AS (SELECT p_brand AS artist, p_type AS title, p_size AS seconds, min(p_name) AS text FROM part WHERE p_partkey % 3 = 0 GROUP BY p_brand, p_type, p_size)
SELECT p_partkey, coalesce(e.text, (SELECT arg_min(l.text, l.seconds) FROM l WHERE l.artist = s.artist AND l.title = s.title)) AS text FROM s LEFT JOIN l e ON e.artist = s.artist AND e.title = s.title AND e.seconds = s.duration"""
)
def lyric_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as songs; every third has a lyric, its name."""
    part = T.read(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_brand").alias("artist"), F.col("p_type").alias("title"), F.col("p_size").cast("double").alias("duration"))
    known = part.where("p_partkey % 3 = 0").select("artist", "title", "duration", F.col("p_name").alias("plain"), F.lit("").alias("synced"), F.lit(False).alias("instrumental"))
    return lyrics.look_up(part.drop("p_name"), known).select("p_partkey", "text")


@Q.add("SELECT doc_id, contains(string_split(upper(text), 'E' || chr(10))[1], 'APACHE') AS relative FROM (SELECT doc_id, text FROM documents)")
def relative_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test for relative beats, on documents whose licence lines stand for the header."""
    docs = T.read(spark, sf_dir, "documents")
    return docs.select("doc_id", text.relative_beats(F.replace(F.upper("text"), F.lit("APACHE"), F.lit("#RELATIVE"))).alias("relative"))


@Q.add(
    "WITH " + TOKENS.replace("FROM documents)", "FROM documents WHERE lang = 'es')", 1) + """,
w AS (SELECT DISTINCT text FROM tokens),
c AS (SELECT text, list_transform(range(1, length(text) + 1), lambda i: substr(text, i, 1)) AS c, list_transform(range(1, length(text) + 1), lambda i: contains('aeiouáéíóúüAEIOUÁÉÍÓÚÜ', substr(text, i, 1))) AS v FROM w),
-- a vowel that another one stands before, with others between: the cut is before what goes with it
n AS (SELECT *, list_filter(range(3, len(c) + 1), lambda i: v[i] AND NOT v[i - 1] AND list_contains(v[1:i - 2], TRUE)) AS nuclei FROM c),
k AS (SELECT *, list_transform(nuclei, lambda i: i - 1 - list_contains(['pr', 'br', 'tr', 'dr', 'cr', 'gr', 'fr', 'pl', 'bl', 'cl', 'gl', 'fl', 'll', 'rr', 'ch'], lower(c[i - 2] || c[i - 1]))::INT) AS cuts FROM n)
SELECT text, array_to_string(list_transform(c, lambda x, i: CASE WHEN list_contains(cuts, i) THEN '-' || x ELSE x END), '') AS parts FROM k"""
)
def syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spanish words and their syllables, of Spanish documents."""
    rows = T.lines(spark, sf_dir).join(T.read(spark, sf_dir, "documents").where("lang = 'es'").select(F.col("doc_id").alias("chart_id")), "chart_id")
    words = lyrics.tokens(rows).select("text").distinct()
    return words.select("text", F.array_join(arrow.syllables_of("text"), "-").alias("parts"))


@Q.add()
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of neighbouring turns of a conversation."""
    turns = T.read(spark, sf_dir, "conversations").select("conv_id", "turn", text.lyric_text(F.col("text")).alias("a"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(arrow.similarity_of("a", "b"), 6).alias("ratio"))


@Q.add()
def align_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every turn of a conversation as lyric, the words of the next one as
    heard; a pair of turns is a chart: conv_id, and the first one's place in the lower 24 bits."""
    turns = T.read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    turns = turns.withColumn("n", order)

    def chart(n: Column) -> Column:
        return (F.shiftleft(F.col("conv_id").cast("long"), 24) + n).alias("chart_id")

    heard = turns.where("n > 1").select(chart(F.col("n") - 1), F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("pos", "text"))
    heard = heard.withColumns({"start_s": F.col("pos") * 0.5, "end_s": F.col("pos") * 0.5 + 0.4})
    lines = turns.select(chart(F.col("n")), F.posexplode(F.split("text", "\n")).alias("line_index", "text"))
    return lyrics.with_lyrics(lines, heard, least=0.0)


@Q.add("WITH " + TOKENS + "SELECT chart_id, round(avg((regexp_replace(strip_accents(lower(text)), '[^a-z]', '', 'g') <> '')::INT), 6) AS share, avg((regexp_replace(strip_accents(lower(text)), '[^a-z]', '', 'g') <> '')::INT) >= 0.8 AS passes FROM tokens GROUP BY chart_id")
def romanizable(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.romanizable(lyrics.tokens(T.lines(spark, sf_dir)), text.letters_key(F.col("text")))
    return out.withColumn("share", F.round("share", 6))
