"""Readers: keyword lists, delimited tables, concordance JSON, TEI XML, texts of unknown encoding, folders of contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexloom.functions.text import lines

TOKEN = T.ArrayType(T.StructType([T.StructField("str", T.StringType())]))
CONCORDANCE = T.StructType([T.StructField(n, TOKEN) for n in ("Left", "Kwic", "Right")])
HEADER_WORDS = ("sõna", "sona", "word")


def keyword_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos (from 1), word: trimmed non-blank lines in order."""
    return docs.select(key, F.posexplode(lines(F.col(text))).alias("p", "word")).select(key, (F.col("p") + 1).cast("long").alias("pos"), "word")


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """file, pos (from 1), word of keyword files, in the order of their lines."""
    return numbered_lines(spark, path).select("file", F.col("line_no").alias("pos"), F.col("text").alias("word"))


def without_header(rows: DataFrame, pos: str, value: str, words: tuple[str, ...] = HEADER_WORDS, trim: bool = False) -> DataFrame:
    """Without the first row of a list if its cell is a header word."""
    cell = F.trim(F.col(value)) if trim else F.col(value)
    return rows.filter(~F.coalesce((F.col(pos) == 0) & F.lower(cell).isin(*words), F.lit(False)))


def read_delimited(spark: SparkSession, path: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """Just the named columns of a delimited file with header, as text; a missing one is an error."""
    df = spark.read.csv(path, sep=sep, header=True, multiLine=True, escape='"')
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return df.select(*columns)


def read_entries(spark: SparkSession, path: str, page: str = "page_number", sep: str = ";") -> DataFrame:
    """All columns as text without inference; rows without page are dropped."""
    return nonblank_page(spark.read.csv(path, sep=sep, header=True, inferSchema=False, nullValue=None, emptyValue="", escape='"'), page)


def nonblank_page(entries: DataFrame, page: str) -> DataFrame:
    return entries.withColumn(page, F.trim(page)).filter(F.col(page) != "")


def read_workbook(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Sheets as delimited files of one folder; sheet is the file's name without extension."""
    df = spark.read.csv(folder, **({"header": True, "multiLine": True, "escape": '"'} | options))
    return df.withColumn("sheet", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))


def read_concordance(spark: SparkSession, path: str) -> DataFrame:
    """Left, Kwic, Right as token arrays; absent ones are empty."""
    df = spark.read.schema(CONCORDANCE).json(path, multiLine=True)
    return df.select(*[F.coalesce(n, F.array().cast(TOKEN)).alias(n) for n in ("Left", "Kwic", "Right")])


def read_tei(spark: SparkSession, path: str, row_tag: str = "entry") -> DataFrame:
    """Elements of a TEI file; a damaged one keeps its text in _corrupt_record."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").option("ignoreSurroundingSpaces", True).option("columnNameOfCorruptRecord", "_corrupt_record").load(path)


#: Characters that windows-1252 has where ISO 8859-1 has control codes.
_C1 = [i for i in range(0x80, 0xA0) if bytes([i]).decode("cp1252", "ignore")]


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 if they are that, else as windows-1252."""
    latin = F.decode(content, "iso-8859-1")
    western = F.translate(latin, "".join(map(chr, _C1)), bytes(_C1).decode("cp1252"))
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(western)


def read_text_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("text"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), text: the trimmed non-blank lines of text files in order.

    Files are read in splits: lines are counted by split, and the counts of a file's splits before give each its first
    number, so neither a file nor its lines meet in one task.
    """
    m = lambda c: F.col(f"_metadata.{c}")
    rows = spark.read.text(path).select(m("file_path").alias("path"), m("file_name").alias("file"), m("file_block_start").alias("split"), F.trim("value").alias("text")).filter("text <> ''")
    rows = rows.withColumn("id", F.monotonically_increasing_id())  # rises by one within a split
    splits = rows.groupBy("path", "split").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("path", "split", (before - F.col("first") + 1).alias("shift"))
    return rows.join(splits, ["path", "split"]).select("file", (F.col("id") + F.col("shift")).alias("line_no"), "text")


def read_contexts(spark: SparkSession, folder: str, suffix: str = "_full_context_only.txt") -> DataFrame:
    """word, line_no (from 1), text: one file a keyword, its name before the suffix; non-blank trimmed lines."""
    word = F.regexp_replace("file", suffix.replace(".", r"\.") + "$", "")
    return numbered_lines(spark, folder).select(word.alias("word"), "line_no", "text")


def read_prompt_bank(spark: SparkSession, path: str) -> DataFrame:
    """Prompts of a CSV with quoted cells of many lines."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')
