"""Structured model replies as rows: labelled lines, key-value blocks, senses, labels, JSON fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T

# Markers, separators and keys of the reply format.
START, END = "--- STRUKTUREERITUD VASTUS ALGAB ---", "--- STRUKTUREERITUD VASTUS LÕPEB ---"
ITEM = "§§§"
CATEGORY, REASON, SYNONYMS = "Kasutus:", "Põhjendus:", "Sünonüümid:"
SENSES, SENSE_COUNT = "TÄHENDUSED", "TÄHENDUSTE-ARV"
LISTS = {"frequency": "SAGEDUSED", "examples": "NÄITED", "register": "REGISTRID", "register_reason": "REGISTRI-PÕHJENDUSED", "confidence": "REGISTRI-KINDLUS", "label": "MÄRGENDID", "label_reason": "MÄRGENDITE-PÕHJENDUSED"}
DEFAULTS = {"frequency": T.UNSPECIFIED, "examples": T.NOT_FOUND, "register": T.UNSPECIFIED, "register_reason": T.UNSPECIFIED, "confidence": T.RATHER_UNSURE, "label": T.NOT_APPLICABLE, "label_reason": T.NOT_APPLICABLE}
RECORD = {"word": "SÕNA", "meaning": "TÄHENDUS", "register": "TEKSTIREGISTER", "register_reason": "REGISTRI-PÕHJENDUS", "training_reason": "TREENINGANDMETE-PÕHJENDUS", "sense_count": "TÄHENDUSTE-ARV", "frequency": "SAGEDUS", "examples": "NÄITED", "label": "REGISTRIMÄRK", "label_reason": "MÄRGENDI-PÕHJENDUS"}
RECORD_DEFAULTS = {"register": T.UNSPECIFIED, "register_reason": T.UNSPECIFIED, "training_reason": T.UNSPECIFIED, "sense_count": T.UNSPECIFIED, "frequency": T.UNSPECIFIED, "examples": T.NOT_FOUND, "label": T.NOT_APPLICABLE, "label_reason": T.NOT_APPLICABLE}


def labelled_line(reply: Column, prefix: str, mode: str = "exact") -> Column:
    """Text after the prefix on the last line that starts with it, null if there is none.

    mode: "exact" (case counts, the prefix is taken out); "split" (case doesn't count, cut at the first
    colon); "mixed" (case doesn't count for finding, the prefix is taken out only as it is written).
    """
    of = lambda line: F.startswith(line if mode == "exact" else F.lower(line), F.lit(prefix if mode == "exact" else prefix.lower()))
    last = F.try_element_at(F.filter(F.split(reply, "\n"), of), F.lit(-1))
    if mode == "split":
        return F.trim(F.substring(last, F.locate(":", last) + 1, F.length(last)))
    return F.trim(F.replace(last, F.lit(prefix), F.lit("")))


def verdict(replies: DataFrame, reply: str, mode: str = "exact", no_reason: str = T.NO_INFORMATION) -> DataFrame:
    """Adds category, reason, synonyms with the defaults of an answer without them; a null reply is a failure."""
    r = F.col(reply)
    return replies.withColumns(
        {
            "category": F.when(r.isNull(), T.FAILURE).otherwise(T.default(labelled_line(r, CATEGORY, mode), T.UNDEFINED)),
            "reason": T.default(labelled_line(r, REASON, mode), no_reason),
            "synonyms": F.coalesce(labelled_line(r, SYNONYMS, mode), F.lit("")),
        }
    )


def structured_block(reply: Column) -> Column:
    """What stands between the first markers, else the whole reply."""
    pattern = rf"(?s)\Q{START}\E(.*?)\Q{END}\E"
    return F.when(reply.rlike(pattern), F.regexp_extract(reply, pattern, 1)).otherwise(reply)


def entries(block: Column) -> Column:
    """Array of (key, value) of the lines with a colon that don't start with http, in order."""
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit(":")) & ~F.startswith(x, F.lit("http")))
    cut = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("value"))
    return F.transform(lines, lambda x: cut(x))


def value_of(pairs: Column, key: str) -> Column:
    """Value of the last entry with the key, null without one."""
    return F.try_element_at(F.filter(pairs, lambda e: e["key"] == key), F.lit(-1))["value"]


def key_values(replies: DataFrame, keep: list[str], reply: str) -> DataFrame:
    """keep..., key, value: a row for each distinct key, its last value."""
    e = replies.select(*keep, F.posexplode(entries(structured_block(F.col(reply)))).alias("n", "e"))
    return e.groupBy(*keep, F.col("e.key").alias("key")).agg(F.max_by("e.value", "n").alias("value"))


def _items(value: Column, dense: bool, examples: bool, strip_prefix: bool) -> Column:
    raw = F.coalesce(F.split(value, ITEM), F.array().cast("array<string>"))
    if dense:
        raw = F.filter(raw, lambda x: F.trim(x) != "")

    def one(x: Column) -> Column:
        at = F.locate("-", x)
        cut = F.trim(F.substring(x, at + 1, F.length(x)))
        if examples:
            cut = F.replace(cut, F.lit("|"), F.lit(" | "))
        plain = F.trim(x)
        if examples and dense:
            plain = F.replace(plain, F.lit("|"), F.lit(" | "))
        return F.when(at > 0, cut).otherwise(plain)

    return F.transform(raw, lambda x: one(x)) if not strip_prefix else F.transform(raw, lambda x: F.trim(F.regexp_replace(x, r"^[^-]*?\s-\s", "")))


def senses(replies: DataFrame, keep: list[str], reply: str, dense: bool = False, mode: str = "first_hyphen") -> DataFrame:
    """A row for each listed sense: keep..., sense_no, sense, sense_count, sense_count_number and the lists by position.

    An item loses what stands before its first hyphen (mode "first_hyphen"), or only a sense name set off by
    spaces ("strip_sense_prefix"). A list that is too short gives its default. `dense`: blank items are
    dropped from every list first, so later ones move up. A reply without senses gives one row of defaults.
    """
    r = replies.select(*keep, entries(structured_block(F.col(reply))).alias("pairs"))
    lists = {n: _items(value_of(F.col("pairs"), k), dense, n == "examples", mode == "strip_sense_prefix").alias(n) for n, k in LISTS.items()}
    named = F.filter(F.transform(F.split(F.coalesce(value_of(F.col("pairs"), SENSES), F.lit("")), ITEM), lambda x: F.trim(x)), lambda x: x != "")
    r = r.select(*keep, named.alias("all_senses"), value_of(F.col("pairs"), SENSE_COUNT).alias("told"), *lists.values())
    r = r.select("*", F.posexplode_outer("all_senses").alias("p", "sense"))
    at = lambda n: F.coalesce(F.try_element_at(F.col(n), F.col("p") + 1), F.lit(DEFAULTS[n])).alias(n)
    count = F.coalesce("told", F.size("all_senses").cast("string"))
    return r.select(*keep, F.coalesce(F.col("p") + 1, F.lit(0)).alias("sense_no"), F.coalesce("sense", F.lit(T.NOT_FOUND)).alias("sense"), count.alias("sense_count"), count.try_cast("int").alias("sense_count_number"), *[at(n) for n in LISTS])


#: What the row of a reply that couldn't be read says.
PARSE_ERROR = {"sense_no": 1, "sense": "parsimise viga", "sense_count": "0", "sense_count_number": 0} | {n: DEFAULTS[n] for n in LISTS}


def with_parse_errors(sense_rows: DataFrame, replies: DataFrame, keep: list[str], damaged: Column) -> DataFrame:
    """Rows of senses() without those of damaged replies (a condition on replies), which get one error row each.

    A null condition says undamaged. keep: the columns that tell replies apart.
    """
    bad = replies.filter(F.coalesce(damaged, F.lit(False))).select(*keep).distinct()
    kinds = dict(sense_rows.dtypes)
    rows = bad.select(*keep, *[F.lit(v).cast(kinds[n]).alias(n) for n, v in PARSE_ERROR.items()])
    return sense_rows.join(bad, keep, "left_anti").unionByName(rows)


def labels(sense_rows: DataFrame) -> DataFrame:
    """A row for each comma-separated label; a sense without label keeps one row."""
    none = F.lit(T.NOT_APPLICABLE)
    split = F.filter(F.transform(F.split("label", ","), lambda x: F.trim(x)), lambda x: x != "")
    some = F.when((F.col("label") != none) & (F.size(split) > 0), split)
    reason = F.when(some.isNull(), none).when(F.col("label_reason") == none, T.NOT_FOUND).otherwise(F.col("label_reason"))
    return sense_rows.withColumn("label_reason", reason).withColumn("label", F.explode(F.coalesce(some, F.array(none))))


def meaning_record(replies: DataFrame, keep: list[str], reply: str, word: str, meaning: str) -> DataFrame:
    """One row a reply with fixed keys; parsed word and meaning go before the given ones."""
    r = replies.select(*keep, F.col(word).alias("_w"), F.col(meaning).alias("_m"), entries(structured_block(F.col(reply))).alias("pairs"))
    got = {n: value_of(F.col("pairs"), k) for n, k in RECORD.items()}
    got["examples"] = F.replace(got["examples"], F.lit("|"), F.lit(" | "))
    out = {"word": F.coalesce(got["word"], "_w"), "meaning": F.coalesce(got["meaning"], "_m")} | {n: F.coalesce(got[n], F.lit(d)) for n, d in RECORD_DEFAULTS.items()}
    return r.select(*keep, *[c.alias(n) for n, c in out.items()])


def analysis_stats(rows: DataFrame, word: str, sense: str) -> DataFrame:
    """One row: words, processed words, unprocessed, rows, rows per word."""
    done = F.count_distinct(F.when(F.col(sense) != T.NOT_PROCESSED, F.col(word)))
    words = F.count_distinct(word)
    return rows.agg(words.alias("words"), done.alias("processed"), (words - done).alias("unprocessed"), F.count("*").alias("n_rows"), F.round(F.try_divide(F.count("*"), words), 6).alias("rows_per_word"))


def json_objects(rows: DataFrame, keep: list[str], text: str, schema: str) -> DataFrame:
    """keep..., n, o: the flat {...} fragments that parse under the schema, first as they are, then without line ends."""
    parts = rows.select(*keep, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"\{[^{}]*\}"), F.lit(0))).alias("n", "part"))
    parsed = F.coalesce(F.try_parse_json("part"), F.try_parse_json(F.replace("part", F.lit("\n"), F.lit(" "))))
    good = parts.filter(parsed.isNotNull())
    return good.select(*keep, "n", F.from_json(F.replace("part", F.lit("\n"), F.lit(" ")), schema).alias("o"))


def fenced_json(reply: Column, schema: str) -> Column:
    """The first json block of a reply, or the whole reply, parsed; null if it isn't JSON."""
    pattern = r"(?s)```json\s*(.*?)```"
    body = F.when(reply.rlike(pattern), F.regexp_extract(reply, pattern, 1)).otherwise(reply)
    return F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, schema))


def last_block(blocks: Column, kind: str) -> Column:
    """Text of the last block of a kind."""
    return F.try_element_at(F.filter(blocks, lambda b: b["type"] == kind), F.lit(-1))["text"]


def semicolon_answer(line: Column) -> Column:
    """Modern word, three dictionary forms, explanation (with any further semicolons)."""
    p = F.split(line, ";", 5)
    names = ("modern", "form_1", "form_2", "form_3", "explanation")
    return F.struct(*[F.trim(F.try_element_at(p, F.lit(i + 1))).alias(n) for i, n in enumerate(names)])


LINK = r"^\s*(?:[0-9]+[.)]\s*|[-•]\s*)?\**\s*(?:[Ss]õna\s+)?[\"'„“]?([^\"'„“”*]+?)[\"'“”]?\**\s+esineb\s+(?:vanas\s+)?sõnaraamatus\s+(?:kui|kujul)\s+[\"'„“]?([^\"'„“”]+?)[\"'“”]?\.?\s*$"
SOURCE = r"/([^/]+)/\.?\s*Allikas:\s*([^,]+),\s*(?:lk\s*)?([0-9]+),\s*(?:rida\s*)?([0-9]+)"


def link_sentence(line: Column) -> Column:
    """word, form, old_form, author, page, row of an answer line; reason says why a line doesn't fit."""
    clean = F.replace(line, F.lit("*"), F.lit(""))
    part = lambda p, i: F.nullif(F.trim(F.regexp_extract(clean, p, i)), F.lit(""))
    form = part(LINK, 2)
    reason = F.when(part(LINK, 1).isNull() & part(SOURCE, 1).isNull(), "no match")
    return F.struct(part(LINK, 1).alias("word"), F.when(form != T.NO_ANSWER, form).alias("form"), part(SOURCE, 1).alias("old_form"), part(SOURCE, 2).alias("author"), part(SOURCE, 3).cast("int").alias("page"), part(SOURCE, 4).cast("int").alias("row"), reason.alias("reason"))
