"""Tables derived from the base tables by integer arithmetic and hashes, with the same in SQL.

Both engines compute them alike, so that every operator can be compared over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.hashing import split_by_content, unit_score
from lectern.session import ship_package

NAMESPACE = "lectern-corpus:"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)  # some text functions run in Python workers
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def score_sql(expression: str) -> str:
    return f"(('0x' || substr(sha256(CAST({expression} AS VARCHAR)), 1, 4))::INT / 65535.0::DOUBLE)"


def bucket_sql(expression: str, digits: int = 8) -> str:
    return f"(('0x' || substr(sha256({expression}), 1, {digits}))::BIGINT)"


def ranges_sql(bucket: str, first: int, second: int) -> str:
    return f"CASE WHEN {bucket} < {first} THEN 'train' WHEN {bucket} < {second} THEN 'validation' ELSE 'test' END"


MANIFEST_SQL = f"manifest AS (SELECT doc_id, lang, source, n_chars, sha256(text) AS sha, {ranges_sql(bucket_sql(f"'{NAMESPACE}' || sha256(text)") + ' % 100', 70, 85)} AS split, {ranges_sql(bucket_sql('CAST(doc_id AS VARCHAR)') + ' % 100', 80, 90)} AS id_split FROM documents)"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their digest and two split rules."""
    from lectern.functions.hashing import split_by_id

    d = table(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256))
    return d.select("doc_id", "lang", "source", "n_chars", "sha", split_by_content("sha", NAMESPACE).alias("split"), split_by_id("doc_id").alias("id_split"))


SCORED_SQL = f"scored AS (SELECT doc_id, quality AS y, {score_sql('doc_id')} AS score, round({score_sql('doc_id')}, 2) AS tied FROM labels)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a reproducible score, and one rounded so that scores tie."""
    s = unit_score("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"), s.alias("score"), F.round(s, 2).alias("tied"))


BLOCKS_SQL = """base AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk FROM lineitem),
blocks AS (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY ln, pk, sk) - 1 AS INT) AS pos, pk, sk, CAST((pk * 7) % 900 AS DOUBLE) AS x0, CAST((pk * 13 + ln * 131) % 1300 AS DOUBLE) AS y0,
  CAST((pk * 7) % 900 + 40 + (sk * 37) % 560 AS DOUBLE) AS x1, CAST((pk * 13 + ln * 131) % 1300 + 20 + sk % 7 AS DOUBLE) AS y1 FROM base)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on pages of 1500 by 1400 pixels: one page an order."""
    from pyspark.sql import Window

    base = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk")).distinct()
    pos = (F.row_number().over(Window.partitionBy("page").orderBy("ln", "pk", "sk")) - 1).cast("int")
    return base.withColumn("pos", pos).selectExpr(
        "page", "pos", "pk", "sk", "cast((pk * 7) % 900 as double) as x0", "cast((pk * 13 + ln * 131) % 1300 as double) as y0",
        "cast((pk * 7) % 900 + 40 + (sk * 37) % 560 as double) as x1", "cast((pk * 13 + ln * 131) % 1300 + 20 + sk % 7 as double) as y1",
    )


REGIONS_SQL = """regions AS (SELECT o_orderkey AS page, CAST(k AS INT) AS pos, CAST((o_orderkey * 53 + k * 311) % 700 AS DOUBLE) AS x0, CAST((o_orderkey * 29 + k * 457) % 900 AS DOUBLE) AS y0,
  CAST((o_orderkey * 53 + k * 311) % 700 + 500 AS DOUBLE) AS x1, CAST((o_orderkey * 29 + k * 457) % 900 + 400 AS DOUBLE) AS y1 FROM orders, range(0, 3) t(k))"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three large boxes a page."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"))
    return o.selectExpr(
        "page", "pos", "cast((page * 53 + pos * 311) % 700 as double) as x0", "cast((page * 29 + pos * 457) % 900 as double) as y0",
        "cast((page * 53 + pos * 311) % 700 + 500 as double) as x1", "cast((page * 29 + pos * 457) % 900 + 400 as double) as y1",
    )


ORDERED_SQL = """ordered AS (SELECT l_orderkey AS grp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS ref,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey, l_quantity) AS pred FROM lineitem)"""


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order by number and by price."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey")
    ref = F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    pred = F.row_number().over(w.orderBy("l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), ref.alias("ref"), pred.alias("pred"))


EVENTS_SQL = "sparse AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_id % 3 <> 1 THEN value END AS value FROM events)"


def sparse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without every third value."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.when(F.col("event_id") % 3 != 1, F.col("value")).alias("value"))


GUESS_SQL = "guessed AS (SELECT doc_id, lang, CASE WHEN regexp_matches(text, '[äöüß]') THEN 'de' WHEN regexp_matches(text, '[ñóí]') THEN 'es' WHEN regexp_matches(text, '[èêç]') THEN 'fr' ELSE 'en' END AS guess, CASE WHEN regexp_matches(text, 'ß') THEN 'de' WHEN regexp_matches(text, 'ñ') THEN 'es' WHEN regexp_matches(text, 'ê') THEN 'fr' ELSE 'en' END AS second FROM documents)"


def guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' languages and two guesses by letters."""
    t = F.col("text")
    guess = F.when(t.rlike("[äöüß]"), "de").when(t.rlike("[ñóí]"), "es").when(t.rlike("[èêç]"), "fr").otherwise("en")
    second = F.when(t.rlike("ß"), "de").when(t.rlike("ñ"), "es").when(t.rlike("ê"), "fr").otherwise("en")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", guess.alias("guess"), second.alias("second"))


LINES_SQL = "cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents), lines AS (SELECT doc_id, CAST(pos AS INT) AS pos, line FROM cut WHERE length(line) > 0)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty lines of the documents."""
    cut = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return cut.where("length(line) > 0")


def noisy_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line, and the same without the letter e."""
    return lines(spark, sf_dir).select("doc_id", "pos", F.col("line").alias("ref"), F.replace("line", F.lit("e"), F.lit("")).alias("pred"))


CHUNKS_SQL = "chunks AS (SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS id, source AS title, lang AS section, text, [lang, CASE WHEN n_chars < 1000 THEN 'Short' ELSE 'Long' END] AS tags FROM documents)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as knowledge chunks."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("id"), F.col("source").alias("title"), F.col("lang").alias("section"), "text", F.array("lang", F.when(F.col("n_chars") < 1000, "Short").otherwise("Long")).alias("tags"))


CELLS_SQL = """tables AS (SELECT p_partkey AS t, CAST(2 + p_partkey % 4 AS INT) AS n_rows, CAST(2 + p_size % 3 AS INT) AS n_columns FROM part),
cells AS (SELECT t, CAST(i // n_columns AS INT) AS "row", CAST(i % n_columns AS INT) AS "column", CAST(1 + CASE WHEN (t + i) % 11 = 0 THEN 1 ELSE 0 END AS INT) AS row_span, 1 AS column_span FROM tables, range(0, 20) g(i) WHERE i < n_rows * n_columns AND (t * 7 + i) % 13 <> 0)"""


def grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tables and cells with deliberate overlaps and gaps."""
    tables = table(spark, sf_dir, "part").selectExpr("p_partkey as t", "cast(2 + p_partkey % 4 as int) as n_rows", "cast(2 + p_size % 3 as int) as n_columns")
    places = tables.select("t", "n_rows", "n_columns", F.explode(F.sequence(F.lit(0), F.col("n_rows") * F.col("n_columns") - 1)).alias("i"))
    cells = places.where("(t * 7 + i) % 13 <> 0").selectExpr("t", "cast(floor(i / n_columns) as int) as row", "i % n_columns as column", "1 + case when (t + i) % 11 = 0 then 1 else 0 end as row_span", "1 as column_span")
    return tables, cells
