"""Line deduplication: keep bitmaps per document for lines that repeat across documents. DataFrame functions only.

Each line of at least `min_chars` code points (stripped, ASCII lower-cased) becomes a 128-bit hash with its document and
position. Hashes are range-partitioned, sorted by document (largest first) and position, and streamed: the first document of
a hash keeps its lines; the others lose theirs if the hash occurs in `min_docs` documents. Hashes so frequent that one range
would be too large for one task are found exactly first (bucket counts, then counts inside heavy buckets; both combine
before the shuffle), decided by aggregation, and joined back by a broadcast whose row count has a proven bound.

What returns is one bitmap per document that loses lines: sparse 64-bit words in which a set bit marks a kept line; words
that keep everything are left out, and so are documents that lose nothing.

Nulls: a null or empty text is one empty line. A row with a null doc_id belongs to no document: its lines neither count nor
go. Repeated rows of a document count once and lose the same lines; rows that share a doc_id but not their text are parts of
one document, told apart by a hash of their text. Lines of very long texts are all looked at, an empty table gives no rows, and
columns other than the id and the text return as they are (names that begin with two underscores are kept for inner use).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factgraph.llm import common

MIN_CHARS, MIN_DOCS = 20, 3
BUCKETS = 1 << 16
#: A hash with more rows than total / HOT_PARTS (and at least HOT_LEAST) is hot, so at most HOT_PARTS hashes are; where there are
#: more ranges than a quarter of HOT_PARTS, four for each range, so that a hash that is not hot fits well into one.
HOT_PARTS, HOT_LEAST = 2000, 1000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _part(text: Column) -> Column:
    """32 bits that tell apart rows of one doc_id with different texts."""
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF))


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, at, h1, h2): at is the position in its high 32 bits, the row's part in its low ones."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("t"))
    rows = rows.select("doc", _part(F.col("t")).alias("part"), F.posexplode(_lines(F.col("t"))).alias("pos", "line"))
    rows = rows.where(F.length("line") >= min_chars).withColumn("key", F.trim(F.col("line"), F.lit(common.WHITE)))
    rows = rows.where(F.length("key") >= min_chars).withColumn("key", common.ascii_lower(F.col("key")))
    at = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("part"))
    return rows.select("doc", at.alias("at"), F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def hot_hashes(lines: DataFrame) -> DataFrame:
    """(h1, h2, keeper, n_docs) of each hash with more than total / HOT_PARTS rows: exact, at most HOT_PARTS rows."""
    bucket = F.pmod(F.col("h1"), F.lit(BUCKETS))
    counts = lines.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).cache()
    total = counts.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT_LEAST, total // max(HOT_PARTS, 4 * common.partitions(lines)))
    heavy = [r.b for r in counts.where(F.col("n") > limit).select("b").collect()]  # fewer buckets than hot hashes may be
    counts.unpersist()
    if not heavy:
        return lines.sparkSession.createDataFrame([], "h1 long, h2 long, keeper long, n_docs long")
    inside = lines.where(bucket.isin(heavy))
    hot = inside.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("h1", "h2")
    hot = inside.join(F.broadcast(hot), ["h1", "h2"])  # both broadcasts: at most HOT_PARTS rows, or four for each range
    return hot.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.max("doc").alias("keeper"), F.count("*").alias("n_docs"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, part, n_lost, words array<struct<word int, keep long>>) of the documents that lose lines."""
    lines = common.written(line_hashes(docs, id_col, text_col, min_chars), "lines")
    hot = F.broadcast(common.written(hot_hashes(lines), "hot"))
    cold = lines.join(hot, ["h1", "h2"], "left_anti").repartitionByRange(common.partitions(docs), "h1", "h2")
    cold = cold.sortWithinPartitions("h1", "h2", F.col("doc").desc(), "at")
    one = Window.partitionBy("h1", "h2")  # the ranges keep a hash together and in order: no further exchange or sort
    cold = cold.withColumn("rank", F.dense_rank().over(one.orderBy(F.col("doc").desc()))).withColumn("n_docs", F.max("rank").over(one))
    lost = cold.where((F.col("rank") > 1) & (F.col("n_docs") >= min_docs)).select("doc", "at")
    lost = lost.unionByName(lines.join(hot, ["h1", "h2"]).where((F.col("doc") < F.col("keeper")) & (F.col("n_docs") >= min_docs)).select("doc", "at"))
    pos = F.shiftright("at", 32).cast("int")
    bit = F.expr("shiftleft(1L, cast(shiftright(at, 32) % 64 as int))")
    words = lost.groupBy("doc", F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("part"), F.floor(pos / 64).cast("int").alias("word"))
    words = words.agg(F.bit_or(bit).alias("gone"))
    entry = F.struct("word", F.bitwise_not("gone").alias("keep"))
    return words.groupBy("doc", "part").agg(F.sum(F.bit_count("gone")).alias("n_lost"), F.array_sort(F.collect_list(entry)).alias("words")).withColumnRenamed("doc", "doc_id")


def kept_lines(text: Column, words: Column) -> Column:
    """The lines of text whose bit is set; a null bitmap keeps all."""
    dense = F.aggregate(
        words,
        F.array().cast("array<bigint>"),
        lambda done, w: F.concat(done, F.array_repeat(F.lit(-1).cast("long"), w["word"] - F.size(done)), F.array(w["keep"])),
    )

    def keep(bits: Column) -> Column:
        def kept(_: Column, i: Column) -> Column:
            word = F.coalesce(F.get(bits, F.floor(i / 64).cast("int")), F.lit(-1).cast("long"))
            return F.call_function("shiftright", word, i % 64).bitwiseAND(F.lit(1).cast("long")) == 1

        return F.filter(_lines(text), kept)

    return F.when(words.isNull(), _lines(text)).otherwise(F.flatten(F.transform(F.array(dense), keep)))


def with_kept_text(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str, out: str, n_lost: str) -> DataFrame:
    """docs with two more columns: the text that its bitmap keeps, and how many lines it loses."""
    bits = bitmaps.select(F.col("doc_id").alias("__doc"), F.col("part").alias("__part"), F.col("n_lost").alias("__n"), F.col("words").alias("__words"))
    joined = docs.join(bits, (F.col(id_col).cast("long") == F.col("__doc")) & (_part(F.col(text_col)) == F.col("__part")), "left")
    text = F.when(F.col("__words").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept_lines(F.col(text_col), F.col("__words")), "\n"))
    return joined.withColumns({out: text, n_lost: F.coalesce("__n", F.lit(0).cast("long"))}).drop("__doc", "__part", "__n", "__words")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without their repeated lines, with the columns of docs; n_chars follows the text."""
    cut = with_kept_text(docs, keep_bitmaps(docs), "doc_id", "text", "__text", "__lost")
    new = cut.withColumn("text", F.when(F.col("text").isNotNull(), F.col("__text")))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col("__lost") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return new.select(*docs.columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = with_kept_text(docs, keep_bitmaps(docs), "doc_id", "text", "kept", "n_dropped")
    return cut.select("doc_id", F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.*, r.keeper IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
