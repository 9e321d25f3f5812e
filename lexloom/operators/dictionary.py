"""Dictionary rules: page lines, entry ids, senses, ditto forms, labels, windows over a length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import text as T


def page_lines(docs: DataFrame, page: str = "doc_id", text: str = "text") -> DataFrame:
    """page, seq (from 0), line: the non-blank trimmed lines of each text. Null text has none."""
    return docs.select(F.col(page).alias("page"), F.posexplode(T.lines(F.col(text))).alias("seq", "line")).withColumn("seq", F.col("seq").cast("long"))


def headword_report(entries: DataFrame, headword: str, first: int = 5) -> DataFrame:
    """Per page: entries, headwords with a space inside, and the first of these joined by a bar.

    The first ones are picked by a rank per page, so no task gathers all violations of a page.
    """
    bad = F.coalesce(T.has_inner_space(F.col(headword)), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("page").orderBy("seq"))
    head = entries.filter(bad).withColumn("n", rank).filter(F.col("n") <= first)
    head = head.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", headword))), lambda x: x[headword]), "|").alias("first_five"))
    return entries.groupBy("page").agg(F.count("*").alias("entries"), F.count_if(bad).alias("violations")).join(head, "page", "left")


def entry_ids(entries: DataFrame, page: str, seq: str, headword: str) -> DataFrame:
    """Adds xml_id: the headword's id, with _1, _2, ... where a page repeats it."""
    w = Window.partitionBy(page, "base")
    e = entries.withColumn("base", T.xml_id(F.col(headword)))
    number = F.row_number().over(w.orderBy(seq))
    return e.withColumn("xml_id", F.when(F.count("*").over(w) > 1, F.concat("base", F.lit("_"), number.cast("string"))).otherwise(F.col("base"))).drop("base")


def manor_id(base: Column, is_manor: Column) -> Column:
    return F.when(is_manor, F.concat(base, F.lit("_m"))).otherwise(base)


def split_senses(entries: DataFrame, entry_id: str, body: str) -> DataFrame:
    """A row for each equivalent: a semicolon starts a sense, a comma an equivalent; blank ones are dropped."""
    part = lambda c, sign: F.filter(F.transform(F.split(c, sign), lambda x: F.trim(x)), lambda x: x != "")
    s = entries.select("*", F.posexplode(part(F.col(body), ";")).alias("p", "sense"))
    s = s.withColumn("sense_no", F.col("p") + 1).withColumn("sense_id", F.concat(F.col(entry_id), F.lit(".s"), F.col("sense_no").cast("string"))).drop("p")
    s = s.select("*", F.posexplode(part(F.col("sense"), ",")).alias("q", "equivalent"))
    return s.withColumn("equivalent_no", F.col("q") + 1).drop("q")


def ditto_expand(forms: DataFrame, page: str, seq: str, form: str) -> DataFrame:
    """A form that starts with a dash gets the stem of the main entry before it on its page."""
    dash = F.substring(form, 1, 1).isin("—", "–", "-")
    w = Window.partitionBy(page).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stem = F.last(F.when(~dash, F.col(form)), ignorenulls=True).over(w)
    return forms.withColumn(form, F.when(dash, F.concat_ws(" ", stem, F.trim(F.substring(form, 2, 1 << 30)))).otherwise(F.col(form)))


def label_codes(usages: DataFrame, abbreviation: str, codes: dict[str, str] | None = None) -> DataFrame:
    """Adds code, null where the exact abbreviation is unknown. The code list is a fixed, small table."""
    items = (T.LABELS if codes is None else codes).items()
    table = usages.sparkSession.createDataFrame(list(items), f"{abbreviation} string, code string")
    return usages.join(F.broadcast(table), abbreviation, "left")


def _bounds(i: Column, length: Column, parts: int, ratio: float) -> tuple[Column, Column]:
    """From and to of window i (from 0): int(part * ratio) overlaps, half of it above, the rest below, ends clamped."""
    part = length / F.lit(float(parts))
    overlap = F.floor(part * F.lit(ratio))
    above = F.floor(overlap / 2)
    low = F.when(i == 0, F.lit(0)).otherwise(F.floor(F.greatest(F.lit(0.0), i * part - above)))
    high = F.when(i == parts - 1, length).otherwise(F.floor(F.least(length.cast("double"), i * part + part + overlap - above)))
    return low.cast("long"), high.cast("long")


def overlap_chunks(docs: DataFrame, text: str, parts: int, ratio: float) -> DataFrame:
    """Adds chunk (from 0), from, to and piece: overlapping windows of each text; empty ones are dropped."""
    d = docs.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("i"))
    low, high = _bounds(F.col("i"), F.length(text).cast("long"), parts, ratio)
    d = d.withColumns({"chunk": F.col("i").cast("long"), "from": low, "to": high}).filter(F.col("from") < F.col("to"))
    return d.withColumn("piece", F.substring(F.col(text), F.col("from").cast("int") + 1, (F.col("to") - F.col("from")).cast("int"))).drop("i")


def chunk_boxes(pages: DataFrame, parts: int = 4, ratio: float = 0.1, width: str = "width", height: str = "height") -> DataFrame:
    """Two columns a page, each in overlapping chunks: column, chunk (from 1), x0, y0, x1, y1."""
    p = pages.crossJoin(F.broadcast(pages.sparkSession.createDataFrame([(c, k) for c in (1, 2) for k in range(1, parts + 1)], "column int, chunk int")))
    middle = F.floor(F.col(width) / 2)
    low, high = _bounds(F.col("chunk") - 1, F.col(height).cast("long"), parts, ratio)
    x0, x1 = F.when(F.col("column") == 1, F.lit(0)).otherwise(middle), F.when(F.col("column") == 1, middle).otherwise(F.col(width))
    return p.withColumns({"x0": x0.cast("long"), "y0": low, "x1": x1.cast("long"), "y1": high}).filter("y0 < y1")
