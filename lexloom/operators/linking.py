"""Linking of words to historical dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import text as T


def exact_link(words: DataFrame, dictionary: DataFrame, word: str, entry: str, value: str, order: str, found: str = "link") -> DataFrame:
    """Adds the value of the first entry equal to the word, or the no-answer text."""
    first = dictionary.groupBy(F.col(entry).alias(word)).agg(F.min_by(value, order).alias(found))
    return words.join(first, word, "left").withColumn(found, F.coalesce(found, F.lit(T.NO_ANSWER)))


def fallback_lookup(words: DataFrame, first: DataFrame, second: DataFrame, word: str, key: str, value: str, order: str) -> DataFrame:
    """link, source: from the first source, else from the second, else the no-answer text."""
    pick = lambda d, n: d.groupBy(F.col(key).alias(word)).agg(F.min_by(value, order).alias(n))
    j = words.join(pick(first, "a"), word, "left").join(pick(second, "b"), word, "left")
    source = F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").otherwise("none")
    return j.withColumn("link", F.coalesce("a", "b", F.lit(T.NO_ANSWER))).withColumn("source", source).drop("a", "b")


def synonym_forms(dictionary: DataFrame, forms: str) -> DataFrame:
    """A row for each form of a comma-separated cell; rows with a null cell go."""
    part = F.filter(F.transform(F.split(F.col(forms), r",\s*"), lambda x: F.trim(x)), lambda x: x != "")
    return dictionary.filter(F.col(forms).isNotNull()).select("*", F.explode(part).alias("form"))


def dictionary_columns(words: DataFrame, forms: DataFrame, word: str, author: str, authors: list[str]) -> DataFrame:
    """One column for each dictionary: its first form equal to the word, null without one."""
    hit = words.join(forms.select(author, F.col("form").alias(word), "row_no"), word).groupBy(word).pivot(author, authors).agg(F.min("row_no"))
    return words.join(hit, word, "left")



#: Forms up to this length meet words by deletions, longer ones by segments.
DELETIONS_UPTO = 8


def _deletions(c: Column, most: int) -> Column:
    """All distinct strings left when up to `most` characters are taken out."""
    level, out = F.array(c), F.array(c)
    for _ in range(most):
        cut = F.transform(level, lambda x: F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))).otherwise(F.array().cast("array<string>")))
        level = F.array_distinct(F.flatten(cut))
        out = F.concat(out, level)
    return F.array_distinct(out)


def _segments(size: Column, most: int) -> Column:
    """(i, first, width) of most + 1 segments of about equal width of a string of this size; the longer ones last."""
    n = most + 1
    narrow, wide = F.floor(size / n), size % n
    return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.struct(i.alias("i"), (i * narrow + F.greatest(i - (n - wide), F.lit(0)) + 1).cast("int").alias("first"), (narrow + F.when(i >= n - wide, 1).otherwise(0)).cast("int").alias("width")))


def near_forms(words: DataFrame, forms: DataFrame, most: int) -> DataFrame:
    """word, form, distance: the pairs of words and forms within `most` edits, whatever they start with.

    Candidates come from equi-joins. A pair within `most` edits shares a string of `most` deletions from each,
    which keys short forms; of most + 1 segments of a form one stands unchanged in the word, shifted no further
    than the edits before and after it allow, which keys long ones. Forms longer than any word by more than
    `most` are left out before.
    """
    words = words.select("word").distinct().withColumn("size", F.length("word"))
    longest = words.agg(F.max("size")).first()[0] or 0
    forms = forms.select("form").distinct().withColumn("size", F.length("form")).filter(F.col("size") <= longest + most)
    pair = lambda j: j.withColumn("distance", F.levenshtein("word", "form", most)).filter("distance >= 0").select("word", "form", "distance")

    cut = lambda d, c: d.select(c, F.explode(_deletions(F.col(c), most)).alias("key"))
    short = cut(words.filter(F.col("size") <= DELETIONS_UPTO + most), "word").join(cut(forms.filter(F.col("size") <= DELETIONS_UPTO), "form"), "key")

    held = forms.filter(F.col("size") > DELETIONS_UPTO).select("form", "size", F.explode(_segments(F.col("size"), most)).alias("s"))
    held = held.select("form", "size", "s.i", F.substring("form", F.col("s.first"), F.col("s.width")).alias("key"))
    sizes = words.select("word", F.col("size").alias("own"), F.explode(F.sequence(F.col("size") - most, F.col("size") + most)).alias("size")).filter(F.col("size") > DELETIONS_UPTO)
    each = sizes.select("word", "own", "size", F.explode(_segments(F.col("size"), most)).alias("s")).withColumn("more", F.col("own") - F.col("size"))
    low, high = F.col("s.first") - F.floor((most - F.col("more")) / 2), F.col("s.first") + F.floor((most + F.col("more")) / 2)
    places = each.withColumns({"low": F.greatest(low, F.lit(1)), "high": F.least(high, F.col("own") - F.col("s.width") + 1)}).filter("low <= high")
    asked = places.select("word", "size", "s.i", "s.width", F.explode(F.sequence("low", "high")).alias("place")).select("word", "size", "i", F.substring("word", F.col("place").cast("int"), F.col("width")).alias("key"))
    return pair(short).unionByName(pair(asked.distinct().join(held, ["size", "i", "key"]))).distinct()


def nearest_form(words: DataFrame, forms: DataFrame, word: str, author: str, k: int = 1, most: int = 3) -> DataFrame:
    """word, author, form, distance, rank: the k nearest forms of each dictionary within `most` edits. Ties go to the smaller form."""
    own = forms.select(author, "form").filter("form is not null").distinct()
    d = near_forms(words.filter(F.col(word).isNotNull()).select(F.col(word).alias("word")), own, most).join(own, "form")
    rank = F.row_number().over(Window.partitionBy("word", author).orderBy("distance", "form"))
    return d.select(F.col("word").alias(word), author, "form", "distance", rank.alias("rank")).filter(F.col("rank") <= k)


def variant_lookup(words: DataFrame, dictionary: DataFrame, word: str, entry: str, value: str) -> DataFrame:
    """word, variant, pos, value: the case variants of each word that the dictionary has."""
    v = words.select(word, F.posexplode(T.case_variants(F.col(word))).alias("pos", "variant"))
    return v.join(dictionary.select(F.col(entry).alias("variant"), value), "variant").select(word, "variant", "pos", value)


def _inner(html: Column, pattern: str) -> Column:
    return F.when(html.rlike(pattern), T.squeezed(F.regexp_replace(F.regexp_extract(html, pattern, 1), r"<[^>]*>", " ")))


def section(html: Column, tags: list[str], message: str = T.NO_ANSWER) -> Column:
    """Text of the first element of the first kind that the page has, else the message. tags: e.g. article, div.entry."""
    found = []
    for t in tags:
        name, _, css = t.partition(".")
        attribute = rf"[^>]*class=\"{css}\"[^>]*" if css else r"(?:\s[^>]*)?"
        found.append(_inner(html, rf"(?s)<{name}{attribute}>(.*?)</{name}>"))
    return F.coalesce(*found, F.lit(message))


def items(html: Column, tag: str = "li") -> Column:
    """Texts of all elements of a kind in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1)), lambda x: T.squeezed(F.regexp_replace(x, r"<[^>]*>", " ")))


def lookup_digest(hits: DataFrame, word: str, order: str, variant: str, text: str, synonyms: str, most: int | None = None) -> DataFrame:
    """word, digest: a line for each variant found, with its synonyms if any; texts cut at `most` characters."""
    body = F.substring(text, 1, most) if most else F.col(text)
    extra = F.when(F.size(synonyms) > 0, F.concat(F.lit(" Sünonüümid: "), F.array_join(synonyms, ", "))).otherwise("")
    line = F.concat(F.lit("Variant '"), F.col(variant), F.lit("': "), body, extra)
    g = hits.select(word, order, line.alias("line")).groupBy(word).agg(F.sort_array(F.collect_list(F.struct(order, "line"))).alias("l"))
    return g.select(word, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("digest"))
