"""Corpus search and frequency: concordances, hit counts, frequencies by word and genre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import text as T

#: Keywords up to which a concordance looks for them in every sentence's tokens.
ASKED = 1000


def token_rows(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep..., pos (sentence, from 0), at (token, from 0), token, lc."""
    s = docs.select(*keep, F.posexplode(T.sentences(F.col(text))).alias("pos", "sent"))
    return s.select(*keep, F.col("pos").cast("long").alias("pos"), F.posexplode(T.tokens(F.col("sent"))).alias("at", "token")).withColumn("at", F.col("at").cast("long")).withColumn("lc", F.lower("token"))


def token_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep..., lc, n: occurrences of each lower-case token. What counts tokens takes these as well as token rows."""
    return token_rows(docs, keep, text).groupBy(*keep, "lc").agg(F.count("*").alias("n"))


def _occurrences(tokens: DataFrame) -> Column:
    """Of token rows or of token_counts."""
    return F.sum("n") if "n" in tokens.columns else F.count("*")


def frequent_words(tokens: DataFrame, least: int = 5, n: int = 20) -> DataFrame:
    """word: the n most frequent lower-case tokens of `least` letters or more, ties in order of the word."""
    count = tokens.filter(F.length("lc") >= least).groupBy(F.col("lc").alias("word")).agg(_occurrences(tokens).alias("n"))
    return count.orderBy(F.desc("n"), "word").limit(n).select("word")


def concordance(docs: DataFrame, keywords: DataFrame, key: str = "doc_id", text: str = "text", window: int = 3, lemma=None) -> DataFrame:
    """Hits of keywords with `window` sentences on both sides.

    A token is a hit if it or its lemma equals the keyword, as typed or both in lower case. lemma: a function of a token column (default: the token itself). Only sentences with a hit
    and the sentences around them leave a document's own array, so text is not shuffled; a list of more than
    ASKED keywords, which isn't searched token by token, lets all sentences through to the equi-join.
    Returns key, pos, at, word, left_context, keyword, right_context.
    """
    k = keywords.select("word", F.lower("word").alias("word_lc")).distinct()
    d = docs.select(key, T.sentences(F.col(text)).alias("s"))
    # tokens first, contexts only of the sentences that are left
    around = F.transform("s", lambda x, i: F.struct(i.alias("pos"), T.tokens(x).alias("t")))
    if k.limit(ASKED + 1).count() <= ASKED:
        asked = k.agg(F.collect_set("word_lc").alias("asked"))  # at most ASKED words
        low_tokens = lambda z: F.transform(z["t"], F.lower)
        hit = lambda z: F.arrays_overlap("asked", low_tokens(z))
        if lemma is not None:
            hit = lambda z: F.arrays_overlap("asked", low_tokens(z)) | F.arrays_overlap("asked", F.transform(z["t"], lambda w: F.lower(lemma(w))))
        d = d.crossJoin(F.broadcast(asked))
        around = F.filter(around, hit)
    lemma = lemma or (lambda c: c)
    around = F.transform(around, lambda z: F.struct(z["pos"].alias("pos"), z["t"].alias("t"), F.slice("s", F.greatest(F.lit(1), z["pos"] - window + 1), F.least(F.lit(window), z["pos"])).alias("left"), F.slice("s", z["pos"] + 2, F.lit(window)).alias("right")))
    d = d.select(key, F.explode(around).alias("z")).select(key, "z.*")
    d = d.select(key, "pos", "t", "left", "right", F.posexplode("t").alias("at", "token"))
    low = F.explode(F.array_distinct(F.array(F.lower("token"), F.lower(lemma(F.col("token"))))))
    # a match as typed is a match in lower case too, so one equi-join finds all four kinds
    hits = d.select("*", low.alias("word_lc")).join(k, "word_lc").drop("word_lc")
    before = F.array_join(F.slice("t", F.lit(1), F.col("at")), " ")
    after = F.array_join(F.slice("t", F.col("at") + 2, F.size("t")), " ")
    return hits.select(
        key,
        F.col("pos").cast("long").alias("pos"),
        F.col("at").cast("long").alias("at"),
        "word",
        F.trim(F.concat_ws(" ", F.array_join("left", " "), before)).alias("left_context"),
        F.col("token").alias("keyword"),
        F.trim(F.concat_ws(" ", after, F.array_join("right", " "))).alias("right_context"),
    )


def flatten_lines(lines: DataFrame, keep: list[str]) -> DataFrame:
    """Concordance lines of token structs as texts: keep..., left_context, keyword, right_context, full_context."""
    joined = lambda c: F.trim(F.array_join(F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<str:string>>")), lambda x: F.coalesce(x["str"], F.lit(""))), " "))
    flat = lines.select(*keep, joined("Left").alias("left_context"), joined("Kwic").alias("keyword"), joined("Right").alias("right_context"))
    return flat.withColumn("full_context", full_context())


def full_context() -> Column:
    return F.trim(F.concat(F.col("left_context"), F.lit(" "), F.col("keyword"), F.lit(" "), F.col("right_context")))


def numbered(hits: DataFrame, word: str, order: list[str]) -> DataFrame:
    """Adds id, 1, 2, ... within each word."""
    return hits.withColumn("id", F.row_number().over(Window.partitionBy(word).orderBy(*order)))


def capped(hits: DataFrame, word: str, order: list[str], most: int = 300_000) -> DataFrame:
    """At most `most` hits a word; Spark limits the groups before the shuffle."""
    return numbered(hits, word, order).filter(F.col("id") <= most)


def hits_per_word(keywords: DataFrame, hits: DataFrame) -> DataFrame:
    """word, hits, failed (no hit) of every keyword."""
    count = hits.groupBy("word").agg(_occurrences(hits).alias("hits"))
    n = F.coalesce("hits", F.lit(0)).cast("long")
    return keywords.join(count, "word", "left").select("word", n.alias("hits"), (n == 0).alias("failed"))


def hits_total(per_word: DataFrame) -> DataFrame:
    """One row: words, found, failed, hits, and both word lists in order."""
    listed = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.col("word")))), "|")
    return per_word.agg(
        F.count("*").alias("words"), F.count_if(~F.col("failed")).alias("found"), F.count_if("failed").alias("not_found"), F.sum("hits").alias("hits"),
        listed(~F.col("failed")).alias("found_words"), listed(F.col("failed")).alias("failed_words"),
    )


def word_frequency(tokens: DataFrame, keywords: DataFrame) -> DataFrame:
    """word, absolute, relative (per million tokens); an unseen word has 0 and 0."""
    total = tokens.agg(_occurrences(tokens).alias("total"))
    count = tokens.join(keywords.select(F.lower("word").alias("lc")).distinct(), "lc").groupBy("lc").agg(_occurrences(tokens).alias("absolute"))
    f = keywords.join(count, F.lower(keywords["word"]) == F.col("lc"), "left").crossJoin(F.broadcast(total))
    absolute = F.coalesce("absolute", F.lit(0)).cast("long")
    return f.select("word", absolute.alias("absolute"), F.coalesce(F.try_divide(absolute * 1e6, F.col("total")), F.lit(0.0)).alias("relative"))


def genre_density(tokens: DataFrame, keywords: DataFrame, genre: str) -> DataFrame:
    """word, genre, abs, rel of each genre that has the word.

    rel = 100 * (share of the word's hits in the genre) / (share of the genre in the corpus). A token
    without genre counts as `unknown`.
    """
    t = tokens.withColumn("genre", F.coalesce(F.nullif(F.col(genre), F.lit("")), F.lit("unknown")))
    size = t.groupBy("genre").agg(_occurrences(t).alias("n_genre"))
    total = size.agg(F.sum("n_genre").alias("n"))
    by = t.join(keywords.select("word").distinct(), F.col("lc") == F.lower("word")).groupBy("word", "genre").agg(_occurrences(t).alias("abs"))
    whole = by.groupBy("word").agg(F.sum("abs").alias("n_word"))
    d = by.join(whole, "word").join(size, "genre").crossJoin(F.broadcast(total))
    return d.select("word", "genre", "abs", (100.0 * (F.col("abs") / F.col("n_word")) / (F.col("n_genre") / F.col("n"))).alias("rel"))


def genre_pivot(density: DataFrame, genres: list[str]) -> DataFrame:
    """A row a word with <genre>_abs and <genre>_rel for the listed genres; ===NONE=== is called none."""
    named = density.withColumn("genre", F.when(F.col("genre") == "===NONE===", "none").otherwise(F.col("genre")))
    return named.groupBy("word").pivot("genre", genres).agg(F.first("abs").alias("abs"), F.first("rel").alias("rel"))


def genre_label(labels: Column) -> Column:
    """First label of an array: missing or empty array `unknown`, an item without name `tundmatu`."""
    return F.when(labels.isNull() | (F.size(labels) == 0), "unknown").otherwise(F.coalesce(F.element_at(labels, 1)["name"], F.lit("tundmatu")))


def prefixed_columns(df: DataFrame, prefixes: list[str]) -> DataFrame:
    """Columns that start with one of the prefixes, in the order of the prefixes; ===NONE=== in a name is none."""
    named = {c: c.replace("===NONE===", "none") for c in df.columns}
    return df.select(*[F.col(f"`{c}`").alias(n) for p in prefixes for c, n in named.items() if n.startswith(p)])
