"""A positional index of words: written once, extended by new documents, read by concordances, caps, samples and counts.

Postings (word in lower case, document, sentence, token) lie in BUCKETS folders by a hash of the word, in each by word and
document, so a lookup reads the folders of its words and, by the files' statistics, little else of them. A frequent
word's postings are dealt over several tasks by document, whatever its share. Documents' token counts lie beside them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import corpus

BUCKETS, SPLIT = 64, 8
#: Keywords up to which the folders to read are named in the plan; beyond, the join finds them.
NAMED = 1000


def _bucket(lc: Column) -> Column:
    return F.pmod(F.xxhash64(lc), F.lit(BUCKETS)).cast("int")


def extend(docs: DataFrame, folder: str, key: str = "doc_id", keep: list[str] | None = None, text: str = "text") -> None:
    """Add the documents that the index doesn't have yet; it is made if there is none. A null key or text adds nothing.

    A key is told to be indexed after its postings are written: a run that fails between the two leaves postings that the
    next one writes again, so readers only take postings of keys that are told with the same run.
    """
    spark, keep = docs.sparkSession, keep or []
    new = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, *keep, text)
    try:
        new = new.join(spark.read.parquet(f"{folder}/documents").select(key), key, "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    run = spark.sql("select uuid()").first()[0]
    rows = corpus.token_rows(new, [key, *keep], text).select(_bucket(F.col("lc")).alias("bucket"), "lc", key, *keep, "pos", "at", "token", F.lit(run).alias("run"))
    dealt = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64(key), F.lit(SPLIT))).sortWithinPartitions("bucket", "lc", key, "pos", "at")
    dealt.write.mode("append").partitionBy("bucket").parquet(f"{folder}/postings")
    told = spark.read.parquet(f"{folder}/postings").filter(F.col("run") == run).groupBy(key, *keep, "run").agg(F.count("*").alias("tokens"))
    empty = new.select(key, *keep).join(told.select(key), key, "left_anti").distinct().select(key, *keep, F.lit(run).alias("run"), F.lit(0).cast("long").alias("tokens"))
    told.unionByName(empty).write.mode("append").parquet(f"{folder}/documents")


def postings(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """All postings of the documents that the index tells of."""
    told = spark.read.parquet(f"{folder}/documents").select(key, "run")
    return spark.read.parquet(f"{folder}/postings").join(told, [key, "run"], "left_semi").drop("run")


def hits(spark: SparkSession, folder: str, keywords: DataFrame, key: str = "doc_id") -> DataFrame:
    """word, key, kept columns, pos, at, token of each keyword's postings: one join, however many keywords."""
    asked = keywords.select("word", F.lower("word").alias("lc")).filter("lc is not null").distinct().withColumn("bucket", _bucket(F.col("lc")))
    found = postings(spark, folder, key)
    few = asked.select("bucket", "lc").limit(NAMED + 1).collect()
    if len(few) <= NAMED:
        found = found.filter(F.col("bucket").isin(sorted({r["bucket"] for r in few})) & F.col("lc").isin(sorted({r["lc"] for r in few})))
        asked = F.broadcast(asked)
    return found.join(asked, ["bucket", "lc"]).drop("bucket", "lc")


def counts(spark: SparkSession, folder: str, by: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """lc, by..., n: what corpus.word_frequency, genre_density and hits_per_word take, read from the index alone."""
    return postings(spark, folder, key).groupBy(*(by or []), "lc").agg(F.count("*").alias("n"))


def concordance(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", window: int = 3) -> DataFrame:
    """key, pos, at, word, left_context, keyword, right_context of hits: only the texts of documents with hits are cut."""
    by_doc = found.groupBy(key).agg(F.collect_list(F.struct("pos", "at", "word", "token")).alias("hits"))
    s = docs.select(key, text).join(by_doc, key).select(key, T.sentences(F.col(text)).alias("s"), "hits")
    place = lambda h: h["pos"].cast("int")
    around = F.transform("hits", lambda h: F.struct(h["pos"].alias("pos"), h["at"].alias("at"), h["word"].alias("word"), h["token"].alias("token"), T.tokens(F.element_at("s", place(h) + 1)).alias("t"), F.slice("s", F.greatest(F.lit(1), place(h) - window + 1), F.least(F.lit(window), place(h))).alias("left"), F.slice("s", place(h) + 2, F.lit(window)).alias("right")))
    z = s.select(key, F.explode(around).alias("z")).select(key, "z.*")
    before, after = F.array_join(F.slice("t", F.lit(1), F.col("at").cast("int")), " "), F.array_join(F.slice("t", F.col("at").cast("int") + 2, F.size("t")), " ")
    left, right = F.trim(F.concat_ws(" ", F.array_join("left", " "), before)), F.trim(F.concat_ws(" ", after, F.array_join("right", " ")))
    return z.select(key, "pos", "at", "word", left.alias("left_context"), F.col("token").alias("keyword"), right.alias("right_context"))
