"""Scalar text functions as column expressions; no Python runs in the tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation, characters not allowed in file names, default answers.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
UNSAFE = r'[<>:"/\\|?*]'
UNSPECIFIED, NOT_FOUND, NOT_APPLICABLE = "ei määratletud", "ei leitud", "ei-kohaldu"
RATHER_UNSURE, UNDEFINED, NO_INFORMATION, FAILURE = "pigem ebakindel", "Määramata", "Pole infot", "Viga"
NO_REASON, NOT_PROCESSED, NO_ANSWER = "Põhjendus puudub", "töötlemata", "Ei leitud"
# Grammar patterns, in the order in which they are looked for.
GRAMMAR = (
    r"Acc\.\s*[a-z]",
    r"acc\.\s*[a-z]",
    r"g\.\s*[a-z]",
    r"ac\.\s*[a-z]",
    r"g\.\s*[a-z],\s*acc\.\s*[a-z]",
    r"\b\d+,\d+\b",
)
# Usage labels by abbreviation.
LABELS = {"r.": "reval", "d.": "dorpat", "P.": "pärnu", "H.": "harjumaa"}

# The white space characters of Unicode, with the four separators of ASCII.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def squeezed(c: Column) -> Column:
    """White space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def normalize_string(c: Column) -> Column:
    """Without ASCII punctuation, lower case, white space squeezed."""
    return squeezed(F.lower(F.translate(c, PUNCTUATION, "")))


def normalize_sentence(c: Column) -> Column:
    """Trimmed, lower case, without trailing .,!?;: and with white space squeezed."""
    return squeezed(F.regexp_replace(F.lower(stripped(c)), r"[.,!?;:]+\z", ""))


def repaired(c: Column) -> Column:
    """Spaces before commas and full stops, and after apostrophes, taken out."""
    for was, now in ((" ,", ","), ("' ", "'"), (" .", ".")):
        c = F.replace(c, F.lit(was), F.lit(now))
    return c


def normalize_context(c: Column) -> Column:
    """Without sentence and paragraph tags, with spaces before signs repaired, squeezed, lower case; in that order."""
    for tag in ("<p>", "</p>", "<s>", "</s>"):
        c = F.replace(c, F.lit(tag), F.lit(""))
    return F.lower(squeezed(repaired(c)))


def null_to_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def clean_field(c: Column) -> Column:
    return F.trim(null_to_empty(c))


def has_inner_space(c: Column) -> Column:
    return F.contains(F.trim(c), F.lit(" "))


def bounded_removal(c: Column, words: Column) -> Column:
    """Every word of the array taken out of c wherever it stands between word boundaries."""
    quote = lambda w: F.concat(F.lit(r"\b\Q"), w, F.lit(r"\E\b"))
    return F.aggregate(words, c, lambda text, w: F.regexp_replace(text, quote(w), F.lit("")))


def migrate_grammar(fields: list[str], target: str, patterns=GRAMMAR) -> dict[str, Column]:
    """New values of `fields` and `target`: what the patterns find in the fields moves to the target.

    Fields and patterns go in the given order; a later pattern sees the reduced text. Removal is bounded by
    word ends while finding is not, so a find that continues into a word is copied and stays.
    """
    out: dict[str, Column] = {}
    moved = F.coalesce(F.col(target), F.lit(""))
    for field in fields:
        text = F.coalesce(F.col(field), F.lit(""))
        found_any = F.lit(False)
        for pattern in patterns:
            found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
            found_any = found_any | (F.size(found) > 0)
            moved = F.trim(F.concat_ws(" ", F.array_compact(F.array(F.nullif(moved, F.lit("")), F.nullif(F.array_join(found, " "), F.lit(""))))))
            text = bounded_removal(text, found)
        tidy = F.regexp_replace(F.regexp_replace(squeezed(text), r"\s*\.\s*$", "."), r"\s*,\s*$", ",")
        out[field] = F.when(found_any, tidy).otherwise(F.coalesce(F.col(field), F.lit("")))
    return out | {target: moved}


def strip_fence(c: Column) -> Column:
    """Without the code fence around a reply."""
    c = F.regexp_replace(F.trim(c), "^```(xml)?", "")
    return F.trim(F.regexp_replace(c, "```$", ""))


def sanitize_name(c: Column, most: int = 100) -> Column:
    return F.substring(F.regexp_replace(c, UNSAFE, "_"), 1, most)


def safe_keyword(c: Column) -> Column:
    return F.translate(c, "/\\", "__")


def run_name(stem: Column, prompt: Column, label: Column, repeat: Column) -> Column:
    return F.concat_ws("_", stem, prompt, label, repeat.cast("string"))


def parse_run_name(name: Column, page_prefix: str = "page") -> Column:
    """Struct of page, prompt, provider, model, run and a reject reason (null if the name fits)."""
    parts = F.split(F.regexp_replace(name, r"\.xml$", ""), "_")
    n = F.size(parts)
    last = F.element_at(parts, -1)
    reason = (
        F.when(n < 5, "too few parts")
        .when(~F.startswith(F.element_at(parts, 1), F.lit(page_prefix)), "no page")
        .when(~last.rlike("^[0-9]+$"), "no run number")
    )
    good = reason.isNull()
    model = F.array_join(F.slice(parts, F.lit(4), F.greatest(n - 4, F.lit(0))), "_")
    return F.struct(
        F.when(good, F.element_at(parts, 1)).alias("page"),
        F.when(good, F.try_element_at(parts, F.lit(2))).alias("prompt"),
        F.when(good, F.try_element_at(parts, F.lit(3))).alias("provider"),
        F.when(good, model).alias("model"),
        F.when(good, last.try_cast("int")).alias("run"),
        reason.alias("reason"),
    )


CHUNK_NAME = r"^page([0-9]+)_column([0-9]+)_chunk([0-9]+)_(.+?)(?:\.xml)?$"


def chunk_key(name: Column) -> Column:
    """Struct of page, column, chunk (numbers) and variant; null members where the name doesn't fit."""
    part = lambda i: F.regexp_extract(name, CHUNK_NAME, i)
    number = lambda i: F.nullif(part(i), F.lit("")).cast("int")
    return F.struct(number(1).alias("page"), number(2).alias("column"), number(3).alias("chunk"), F.nullif(part(4), F.lit("")).alias("variant"))


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def render_prompt(template: Column, values: dict[str, Column]) -> Column:
    """{name} replaced by each value; a placeholder without value is an error."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def unfilled(prompt: Column) -> Column:
    """Whether a {placeholder} is left."""
    return prompt.rlike(r"\{[a-z_]+\}")


def case_variants(c: Column) -> Column:
    """The word, capitalised and in lower case; distinct, first seen first."""
    capital = F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))
    return F.array_distinct(F.array(c, capital, F.lower(c)))


def flatten_newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(" "))


def xml_id(headword: Column) -> Column:
    return F.replace(F.lower(headword), F.lit(" "), F.lit("_"))


def default(c: Column, value: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(value))


def sentences(c: Column) -> Column:
    """Sentences of a text: cut after . ! ? and at line ends, trimmed, without blank ones."""
    lines = F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\n"), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def tokens(c: Column) -> Column:
    """Words and numbers as typed."""
    return F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def lines(c: Column) -> Column:
    """Trimmed lines without blank ones."""
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
