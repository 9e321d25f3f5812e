"""Checking quoted sentences against the texts they are said to come from."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import text as T
from lexloom.sources.scratch import written

FOUND, NOT_FOUND, FILE_NOT_FOUND = "FOUND", "NOT_FOUND", "FILE_NOT_FOUND"
#: Characters of sentences in an automaton (some 60 bytes each in a worker), and automata, each with a pass over the texts.
AUTOMATON_CHARS, SCANS = 1_000_000, 8


def forward_fill(rows: DataFrame, sheet: str, order: str, column: str) -> DataFrame:
    """Empty cells take the last filled one above them in their sheet."""
    w = Window.partitionBy(sheet).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(column, F.last(F.nullif(F.col(column), F.lit("")), ignorenulls=True).over(w))


def claim_sentences(claims: DataFrame, content: str = "content") -> DataFrame:
    """Adds pos (from 0), sentence: the bar-separated sentences, trimmed, without blank ones. Null content has none."""
    part = F.filter(F.transform(F.split(F.col(content), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return claims.select("*", F.posexplode(part).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


def verify(sentences: DataFrame, contexts: DataFrame, key: str, repair: bool = False) -> DataFrame:
    """Adds status. contexts: key, context (a row for each text line or document of the key).

    FOUND if the normalised sentence is inside one of its key's normalised contexts; FILE_NOT_FOUND if the
    key has none; a sentence that is empty once normalised is NOT_FOUND. With `repair` sentences get the
    contexts' repair of spaces before signs, too.

    Texts are read once and stay where they are: a task walks them with an automaton of all sentences asked
    for. Beyond AUTOMATON_CHARS characters of sentences there are several, each with a pass over the texts,
    and beyond SCANS of these candidates come from an equi-join on the key and a run of words.
    """
    norm = T.normalize_sentence(T.repaired(F.col("sentence")) if repair else F.col("sentence"))
    s = written(sentences.withColumn("norm", norm), "sentences")
    texts = contexts.filter(F.length(F.trim("context")) > 0).select(key, T.normalize_context(F.col("context")).alias("t"))
    asked = s.filter("norm <> ''").select(key, "norm").filter(F.col(key).isNotNull()).distinct()
    parts = _parts(asked)
    if parts <= SCANS:
        found = _scanned(texts, asked, key, parts)
    else:
        docs = texts.distinct().select(key, F.xxhash64("t").alias("doc"), "t")
        found = _found(asked, docs, [key]).select(key, "norm").unionByName(texts.select(key, F.lit(None).cast("string").alias("norm")))
    found = written(found.distinct(), "found")
    has = found.select(key).distinct().withColumn("has", F.lit(True))
    hit = found.filter("norm is not null").withColumn("hit", F.lit(True))
    out = s.join(has, key, "left").join(hit, [key, "norm"], "left")
    return out.withColumn("status", F.when(F.col("has").isNull(), FILE_NOT_FOUND).when(F.col("hit"), FOUND).otherwise(NOT_FOUND)).drop("has", "hit", "norm")


def _parts(asked: DataFrame) -> int:
    """Automata that the sentences asked for take."""
    chars = asked.agg(F.sum(F.length("norm"))).first()[0] or 0
    return max(1, -(-chars // AUTOMATON_CHARS))


_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(mark: str, norms: list[str]) -> ahocorasick.Automaton:
    """Built once in a worker; another one replaces it."""
    if mark not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for norm in norms:
            made.add_word(norm, norm)
        if norms:
            made.make_automaton()
        _built[mark] = made
    return _built[mark]


def _in_parts(asked: DataFrame, parts: int) -> Iterator[tuple[str, list]]:
    """A mark and the rows of each part of the sentences asked for, of AUTOMATON_CHARS characters or about as many."""
    for part in range(parts):
        some = asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("norm"), F.lit(parts)) == part)
        yield uuid.uuid4().hex, some.collect()


def _scanned(texts: DataFrame, asked: DataFrame, key: str, parts: int) -> DataFrame:
    """key, norm: the sentences asked for that a text of the key holds, and each key with texts beside a null; a task tells each once."""
    out = None
    for mark, rows in _in_parts(asked, parts):
        wanted: dict[str, set] = {}
        for r in rows:
            wanted.setdefault(r["norm"], set()).add(r[key])
        out = (lambda x: x if out is None else out.unionByName(x))(texts.mapInArrow(_walk(mark, wanted), f"`{key}` {dict(texts.dtypes)[key]}, norm string"))
    return out


def _walk(mark: str, wanted: dict[str, set]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, told = _automaton(mark, list(wanted)), set()
        for batch in batches:
            new = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (key, None) not in told:
                    told.add((key, None))
                    new.append((key, None))
                for _, norm in walk.iter(text) if wanted and key is not None else ():
                    if (key, norm) not in told and key in wanted[norm]:
                        told.add((key, norm))
                        new.append((key, norm))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in new], batch.column(0).type), pa.array([n for _, n in new], pa.string())], names=[batch.schema.names[0], "norm"])

    return run


def _walk_all(mark: str, norms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, least, schema = _automaton(mark, norms), {}, None
        for batch in batches:
            schema = pa.schema([("norm", pa.string()), (batch.schema.names[0], batch.column(0).type)])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for _, norm in walk.iter(text) if norms and text is not None and doc is not None else ():
                    if norm not in least or doc < least[norm]:
                        least[norm] = doc
        if least:
            yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.string()), pa.array(list(least.values()), schema.types[1])], schema=schema)

    return run


def _found(s: DataFrame, d: DataFrame, on: list[str], n: int = 3, gram: int = 4) -> DataFrame:
    """on..., norm, doc: the texts (on..., doc, t) that hold each sentence (on..., norm), both normalised.

    Candidates are found by an equi-join and then checked as substrings. A sentence's first and last word
    may be part of a longer word in a text, so its key is a run of up to n words between them; a sentence
    of one or two words is looked for by the first `gram` characters of its longest word in the distinct
    words of the texts. Texts give only the runs that some sentence asks for. A sentence without any word is
    not found.
    """
    words = lambda c: T.tokens(F.lower(c))
    s = s.withColumn("w", words(F.col("norm")))
    inner = F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0)))
    s = s.withColumn("kind", F.least(F.size(inner), F.lit(n))).withColumn("asked", F.array_join(F.slice(inner, 1, n), " "))
    dw = d.select(*on, "doc", words(F.col("t")).alias("w"))
    asked = s.filter("kind > 0").select(*on, "kind", "asked").distinct()
    found = None
    for k in range(1, n + 1):
        keys = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, F.lit(k)), " ")))  # noqa: B023
        rows = dw.filter(F.size("w") >= k).select(*on, "doc", F.explode(keys).alias("asked")).withColumn("kind", F.lit(k)).join(asked.filter(F.col("kind") == k), [*on, "kind", "asked"], "left_semi")
        found = rows if found is None else found.unionByName(rows)
    by_run = s.select(*on, "norm", "kind", "asked").join(found, [*on, "kind", "asked"]).select(*on, "norm", "doc")
    longest = F.reduce("w", F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    short = s.filter("kind = 0").select(*on, "norm", longest.alias("longest")).withColumn("part", F.substring("longest", 1, gram))
    own = dw.select(*on, "doc", F.explode(F.array_distinct("w")).alias("word"))
    known = own.select(*on, "word").distinct()
    starts = lambda m: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - m + 1), lambda i: F.substring("word", i, F.lit(m))))
    parts = None
    for m in range(1, gram + 1):
        rows = known.filter(F.length("word") >= m).select(*on, "word", F.explode(starts(m)).alias("part"))
        parts = rows if parts is None else parts.unionByName(rows)
    by_word = short.join(parts, [*on, "part"]).filter(F.contains("word", F.col("longest"))).select(*on, "norm", "word").distinct().join(own, [*on, "word"]).select(*on, "norm", "doc")
    return by_run.unionByName(by_word).distinct().join(d, [*on, "doc"]).filter(F.contains("t", F.col("norm"))).select(*on, "norm", "doc")


def verify_anywhere(sentences: DataFrame, docs: DataFrame, key: str, text: str = "text", repair: bool = False) -> DataFrame:
    """Adds status and doc (the smallest key of the documents that have it): sentences against all documents, by one walk over them as in `verify`."""
    norm = T.normalize_sentence(T.repaired(F.col("sentence")) if repair else F.col("sentence"))
    s = written(sentences.withColumn("norm", norm), "sentences")
    asked = s.filter("norm <> ''").select("norm").distinct()
    texts = docs.select(F.col(key).alias("doc"), T.normalize_context(F.col(text)).alias("t"))
    parts, found = _parts(asked), None
    if parts <= SCANS:
        for mark, rows in _in_parts(asked, parts):
            some = texts.mapInArrow(_walk_all(mark, [r["norm"] for r in rows]), f"norm string, doc {dict(texts.dtypes)['doc']}")
            found = some if found is None else found.unionByName(some)
    else:
        found = _found(asked, texts, [])
    out = s.join(found.groupBy("norm").agg(F.min("doc").alias("doc")), "norm", "left")
    return out.withColumn("status", F.when(F.col("doc").isNotNull(), FOUND).otherwise(NOT_FOUND)).drop("norm")


def results_by_row(verified: DataFrame, row: list[str]) -> DataFrame:
    """Sentences found and not found as bar-joined texts in their order, with both counts, a row for each claim."""
    text = lambda good: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(good, F.struct("pos", "sentence")))), lambda x: x["sentence"]), " | ")
    found = F.col("status") == FOUND
    return verified.groupBy(*row).agg(text(found).alias("found"), text(~found).alias("not_found"), F.count_if(found).alias("n_found"), F.count_if(~found).alias("n_not_found"))


def rows_with_found(results: DataFrame) -> DataFrame:
    return results.filter("n_found > 0")


def statistics(results: DataFrame, sheet: str, total: str = "TOTAL") -> DataFrame:
    """Per sheet and in total: rows, sentences, found, not found and both percentages, of the sums."""
    r = results.rollup(sheet).agg(F.count("*").alias("n_rows"), F.sum(F.col("n_found") + F.col("n_not_found")).alias("n_sentences"), F.sum("n_found").alias("n_found"), F.sum("n_not_found").alias("n_not_found"), F.grouping(sheet).alias("g"))
    percent = lambda c: F.round(F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("n_sentences")), F.lit(0.0)), 2)
    return r.select(F.when(F.col("g") == 1, total).otherwise(F.col(sheet)).alias(sheet), "n_rows", "n_sentences", "n_found", "n_not_found", percent("n_found").alias("found_percent"), percent("n_not_found").alias("not_found_percent"))
