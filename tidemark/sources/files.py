"""Readers of files: records, paragraphs, candles. Schemas are given, never inferred from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.objects import record_messages

RECORD = "chosen string, rejected string, prompt string, response string, question string, problem string, query string, answer string, solution string, instruction string, input string, output string, teacher_response string, text string, content string, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>"

#: Formats of times in candle files, tried in turn.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm")


def discover(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("json", "jsonl", "txt", "gz")) -> DataFrame:
    """path, length, modificationTime of the data files below a folder; hidden files and caches are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(F.regexp_extract(name, r"\.([a-z]+)$", 1).isin(*suffixes) & ~name.startswith(".") & ~F.col("path").contains("/__pycache__/"))


def json_lines(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """One record a line; lines that are no JSON object are left out."""
    options = {"columnNameOfCorruptRecord": "_bad"}
    rows = spark.read.text(path).select(F.from_json("value", f"{schema}, _bad string", options).alias("x"))
    return rows.where(F.col("x._bad").isNull()).select("x.*").drop("_bad")


def json_examples(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """Records of a file that is a list, or an object with a list under examples or data."""
    whole = spark.read.text(path, wholetext=True)
    listed = f"array<struct<{', '.join(p.replace(' ', ':', 1) for p in schema.split(', '))}>>"
    boxed = F.from_json("value", f"struct<examples:{listed},data:{listed}>")
    items = F.coalesce(boxed["examples"], boxed["data"], F.from_json("value", listed))
    return whole.select(F.explode(items).alias("x")).select("x.*")


def paragraphs(spark: SparkSession, path: str, longer_than: int = 30) -> DataFrame:
    """text of each paragraph of the text files: parts between two or more line breaks, trimmed."""
    whole = spark.read.text(path, wholetext=True)
    parts = whole.select(F.explode(F.split("value", r"\n{2,}")).alias("text"))
    return parts.select(F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).where(F.length("text") > longer_than)


def _below(spark: SparkSession, root: str, suffix: str) -> DataFrameReader:
    """A reader of the files below root with that suffix, hidden ones and caches left out by Spark and the pattern."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}")


def _placed(rows: DataFrame, kind: int, *columns: Column | str) -> DataFrame:
    """rows with `at`, their place among all rows of all files: kind of file, path, block of the file, place in that.

    A task reads its blocks in order, so the running number of its rows is their order in a block.
    """
    meta = F.col("_metadata")
    at = F.struct(F.lit(kind).alias("kind"), meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select(at.alias("at"), *columns)


def record_texts(rows: DataFrame, longer_than: int = 20) -> DataFrame:
    """at, text: canonical texts of records (at, and the columns of RECORD), if longer than that."""
    from tidemark.operators.corpus import serialized

    types = {n: t for n, t in rows.dtypes if n != "at"}
    fields = {n: [f.name for f in rows.schema[n].dataType.elementType] for n, t in types.items() if t.startswith("array<struct")}
    text = F.array(serialized(record_messages(types, fields)))
    # a generator, as a filter would work the text out a second time
    return rows.select("at", F.explode(F.filter(text, lambda t: F.length(t) > longer_than)).alias("text"))


def load_all(spark: SparkSession, root: str, schema: str = RECORD, seed: int | None = None, most: int | None = None) -> DataFrame:
    """at, text of all JSON, JSONL and TXT files below a folder: records and paragraphs as canonical texts, each once.

    Files go by kind and then path, their parts in order; of equal texts the first stays. A JSON file is a
    list of records or has one under examples or data, files named master_index are left out; what is no
    record, or too short, is passed over. With a seed, texts are ordered by a hash of it and themselves,
    else by place; `most` keeps that many, which is for samples: an ordered limit.
    """
    from tidemark.functions.records import document_text

    if not _any(spark, root):
        return spark.createDataFrame([], "at struct<kind:int,file:string,block:bigint,row:bigint>, text string")
    record = f"struct<{', '.join(p.replace(' ', ':', 1) for p in schema.split(', '))}>"
    lists = _below(spark, root, "json").option("multiLine", "true").schema(f"{schema}, examples array<{record}>, data array<{record}>").json(root)
    named = ~F.lower(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).contains("master_index")
    own = F.struct(*[F.col(f.name) for f in lists.schema if f.name not in ("examples", "data")])
    json = _placed(lists.where(named), 0, F.explode(F.coalesce("examples", "data", F.array(own))).alias("x")).select("at", "x.*")
    lines = _placed(_below(spark, root, "jsonl").text(root), 1, F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("x"))
    lines = lines.where("x._bad IS NULL").select("at", "x.*").drop("_bad")
    whole = _placed(_below(spark, root, "txt").text(root, wholetext=True), 2, "value")
    parts = whole.select("at", F.posexplode(F.transform(F.split("value", r"\n{2,}"), document_text)).alias("part", "text"))
    texts = parts.where(F.length("text") > 30).select(F.col("at").withField("row", F.col("part").cast("long")).alias("at"), "text")
    found = record_texts(json).unionByName(record_texts(lines)).unionByName(texts)
    first = found.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min(F.struct("at", "text")).alias("x"))  # sorts by digest: texts begin alike
    once = first.select("x.at", "x.text")
    if most is not None or seed is not None:
        once = once.orderBy(*([F.xxhash64("text", F.lit(seed))] if seed is not None else []), "at")
    return once if most is None else once.limit(max(0, most))


def _any(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def parsed_time(text: Column) -> Column:
    """A time in any of the known formats, or seconds since 1970; without a zone it is UTC."""
    text = F.trim(text)
    tried = [F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS]
    epoch = F.when(text.rlike("^[0-9]{9,12}$"), F.timestamp_seconds(text.cast("long")))
    return F.coalesce(epoch, *tried)


def candles(spark: SparkSession, path: str) -> DataFrame:
    """ts, open, high, low, close, volume of candle files with or without a header; bad rows are left out."""
    schema = "time string, open string, high string, low string, close string, volume string"
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)
    numbers = [F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in ("open", "high", "low", "close")]
    rows = raw.select(parsed_time(F.regexp_replace("time", "^﻿", "")).alias("ts"), *numbers, F.coalesce(F.expr("try_cast(volume AS DOUBLE)"), F.lit(0.0)).cast("long").alias("volume"))
    return rows.dropna(subset=["ts", "open", "high", "low", "close"]).orderBy("ts")


def quotes(spark: SparkSession, path: str) -> DataFrame:
    """ts, bid, ask, last of tick files; a row without a positive quote is left out; last is the ask."""
    raw = spark.read.schema("time string, bid double, ask double").option("mode", "DROPMALFORMED").csv(path)
    rows = raw.select(parsed_time(F.col("time")).alias("ts"), "bid", "ask").where("bid > 0 OR ask > 0")
    return rows.withColumn("last", F.col("ask"))


def allowed(rows: DataFrame, filters: dict[str, set[str]]) -> DataFrame:
    """Rows of which every named column, as trimmed text, is in its set; null is in none."""
    for name, values in filters.items():
        rows = rows.where(F.trim(F.col(name).cast("string")).isin(*sorted(values)))
    return rows
