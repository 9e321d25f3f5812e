"""Dictionary XML as text rows: unwrapping, joining, merging and flattening of fragments, markup measures."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import similarity as M
from lexloom.functions import text as T

WRAPPERS = ("entries", "root", "div")


def unwrap_fragment(fragments: DataFrame, column: str) -> DataFrame:
    """Adds content and well_formed: the children of a wrapper element, any other element as it is, damaged text with a line end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, good = [], []
            for x in batch.column(batch.schema.get_field_index(column)).to_pylist():
                try:
                    root = ET.fromstring(x or "")
                    inner = "".join(ET.tostring(c, encoding="unicode").strip() for c in root) if root.tag in WRAPPERS else ET.tostring(root, encoding="unicode").strip()
                    content.append(inner)
                    good.append(True)
                except ET.ParseError:
                    content.append((x or "") + "\n")
                    good.append(False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(content, pa.string()), pa.array(good, pa.bool_())], names=[*batch.schema.names, "content", "well_formed"])

    from pyspark.sql.types import BooleanType, StringType, StructType

    schema = StructType([*fragments.schema.fields]).add("content", StringType()).add("well_formed", BooleanType())
    return fragments.mapInArrow(run, schema)


def ordered_chunks(chunks: DataFrame, key: list[str], column: str = "column", chunk: str = "chunk", text: str = "content") -> DataFrame:
    """key..., parts: the chunks of a run in reading order (column, then chunk, as numbers). A page has few chunks."""
    return chunks.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct(column, chunk, text))), lambda x: x[text]).alias("parts"))


def concat_fragments(chunks: DataFrame, key: list[str], sign: str = "\n", **names) -> DataFrame:
    return ordered_chunks(chunks, key, **names).select(*key, F.array_join("parts", sign).alias("content"))


def numbered_chunks(chunks: DataFrame, key: list[str], **names) -> DataFrame:
    """key..., request: the chunks as numbered blocks."""
    block = lambda x, i: F.concat(F.lit("--- CHUNK "), (i + 1).cast("string"), F.lit(" ---\n"), x, F.lit("\n\n"))
    return ordered_chunks(chunks, key, **names).select(*key, F.array_join(F.transform("parts", block), "").alias("request"))


def assemble_page(columns: DataFrame, page: str = "page", column: str = "column", content: str = "content", good: str = "well_formed") -> DataFrame:
    """page, xml, skipped: the page element around its well-formed columns in order; pages without one are left out."""
    g = columns.groupBy(page).agg(F.sort_array(F.collect_list(F.when(F.col(good) & (F.col(content) != ""), F.struct(column, content)))).alias("c"), F.count_if(~F.col(good)).alias("skipped"))
    head = F.concat(F.lit('<div type="page" n="'), F.col(page).cast("string"), F.lit('" corresp="#p'), F.col(page).cast("string"), F.lit('">'))
    return g.filter(F.size("c") > 0).select(page, F.concat(head, F.array_join(F.transform("c", lambda x: x[content]), ""), F.lit("</div>")).alias("xml"), "skipped")


def merge_split_entries(parts: DataFrame, page: str, xml_id: str, order: str, child: str) -> DataFrame:
    """page, xml_id, children: the children of an entry's parts in order, each distinct one once."""
    first = parts.groupBy(page, xml_id, child).agg(F.min(order).alias(order))
    return first.groupBy(page, xml_id).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, child))), lambda x: x[child]).alias("children"))


def dedupe_entries(entries: DataFrame, page: str, xml_id: str, order: str, content: str) -> DataFrame:
    """Of identical entries of a page the first."""
    w = Window.partitionBy(page, xml_id, F.sha2(content, 256)).orderBy(order)
    return entries.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


TEI = """entry_path string, parent_path string, id string, element string, position int, type string, corresp string, text string"""


def flatten_tei(pages: DataFrame, page: str, xml: str) -> DataFrame:
    """page and TEI: a row for each entry, form, sense, cit, usg, gram and metamark, with the path of its entry.

    Nested entries have the path of the entry around them as parent, at any depth. Text is in document
    order, white space squeezed. A damaged page gives one row with element `damaged`.
    """
    names = ["page", *[x.split()[0] for x in TEI.split(",")]]
    xml_id = "{http://www.w3.org/XML/1998/namespace}id"

    def rows(number, source):
        try:
            root = ET.fromstring(source)
        except ET.ParseError:
            return [(number, None, None, None, "damaged", 0, None, None, None)]
        out, todo, n = [], [(root, None)], 0
        while todo:
            node, entry = todo.pop()
            tag = node.tag.rpartition("}")[2]
            text = " ".join("".join(node.itertext()).split())
            if tag == "entry":
                n += 1
                path = f"{entry}/{n}" if entry else str(n)
                out.append((number, path, entry, node.get(xml_id), tag, len(out), node.get("type"), node.get("corresp"), text))
                entry = path
            elif tag in ("form", "sense", "cit", "usg", "gram", "metamark"):
                out.append((number, entry, None, node.get(xml_id), tag, len(out), node.get("type") or node.get("function"), node.get("corresp") or node.get("value"), text))
            todo += [(c, entry) for c in reversed(node)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [batch_type for batch_type in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())]
        for batch in batches:
            got = [r for number, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in rows(number, source or "")]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], names=names)

    return pages.select(F.col(page).cast("long"), xml).mapInArrow(run, "page long, " + TEI)


def usage_counts(flat: DataFrame) -> DataFrame:
    """element, kind, n: entries by usage label, forms by type, metamarks by function."""
    kind = F.when(F.col("element") == "usg", F.coalesce("corresp", "text")).otherwise(F.col("type"))
    return flat.filter(F.col("element").isin("usg", "form", "metamark")).groupBy("element", kind.alias("kind")).agg(F.count("*").alias("n"))


def entries_flat(results: DataFrame, page: str, entries: str, fields: list[str]) -> DataFrame:
    """page, seq (from 0) and the fields of the entries of page results; null fields are empty."""
    e = results.select(page, F.posexplode(entries).alias("seq", "e"))
    return e.select(page, F.col("seq").cast("long").alias("seq"), *[T.null_to_empty(F.col(f"e.{f}")).alias(f) for f in fields])


TAG = r"<([a-zA-Z][a-zA-Z0-9]*)"
#: An opening tag to its end, and an attribute of what follows its name.
OPENING = r"<[a-zA-Z](?:[^>\"']++|\"[^\"]*\"|'[^']*')*+"
ATTRIBUTE = r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?"


def tag_sequence(markup: Column) -> Column:
    """Names of the opening tags in order, in lower case: the structure of tolerant markup."""
    return F.transform(F.regexp_extract_all(markup, F.lit(TAG), F.lit(1)), lambda x: F.lower(x))


def tag_attribute_sequence(markup: Column) -> Column:
    """Opening tags in order, each followed by @name=value of its attributes, by name; a bare attribute has an empty value."""

    def attribute(x: Column) -> Column:
        value = F.regexp_extract(x, ATTRIBUTE, 2)
        quoted = F.substring(value, 1, 1).isin('"', "'")
        return F.struct(F.lower(F.regexp_extract(x, ATTRIBUTE, 1)).alias("name"), F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value).alias("value"))

    def tag(x: Column) -> Column:
        found = F.regexp_extract_all(F.regexp_replace(x, r"^<[^\s/>]+", ""), F.lit(ATTRIBUTE), F.lit(0))
        more = F.transform(F.sort_array(F.transform(found, attribute)), lambda a: F.concat(F.lit("@"), a["name"], F.lit("="), a["value"]))
        return F.concat(F.array(F.lower(F.regexp_extract(x, TAG, 1))), more)

    return F.flatten(F.transform(F.regexp_extract_all(markup, F.lit(OPENING), F.lit(0)), tag))


def content_text(markup: Column) -> Column:
    """Text between the tags, white space squeezed."""
    return T.squeezed(F.regexp_replace(markup, r"<[^>]*>", " "))


def structure_sequence(pages: DataFrame, key: list[str], xml: str) -> DataFrame:
    """key..., tags, tags_attrs, content of XML texts in document order; null for damaged ones.

    tags_attrs has @name=value of each attribute, by name, after its tag.
    """
    from pyspark.sql.types import ArrayType, StringType, StructType

    def one(source):
        try:
            nodes = list(ET.fromstring(source or "").iter())
        except ET.ParseError:
            return None, None, None
        tags = [n.tag for n in nodes]
        more = [x for n in nodes for x in (n.tag, *(f"@{k}={n.attrib[k]}" for k in sorted(n.attrib)))]
        return tags, more, " ".join(" ".join(nodes[0].itertext()).split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(x) for x in batch.column(len(key)).to_pylist()]
            a, b, c = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], pa.array(a, pa.list_(pa.string())), pa.array(b, pa.list_(pa.string())), pa.array(c, pa.string())], names=[*key, "tags", "tags_attrs", "content"])

    chosen = pages.select(*key, xml)
    schema = StructType(chosen.schema.fields[: len(key)]).add("tags", ArrayType(StringType())).add("tags_attrs", ArrayType(StringType())).add("content", StringType())
    return chosen.mapInArrow(run, schema)


def similarity_table(runs: DataFrame, truth: DataFrame) -> DataFrame:
    """Scores of each run against its page's ground truth.

    runs: name, tags, tags_attrs, content; truth: page and the same. Names that don't parse and pages
    without ground truth keep a row with the reason and null scores. Pairs are dealt by name, so that the
    runs of one page spread.
    """
    r = runs.select("name", T.parse_run_name(F.col("name")).alias("k"), "tags", "tags_attrs", "content").select("name", "k.*", "tags", "tags_attrs", "content")
    g = truth.select("page", F.col("tags").alias("g_tags"), F.col("tags_attrs").alias("g_attrs"), F.col("content").alias("g_content"))
    j = r.join(g, "page", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("g_content").isNull(), "no ground truth")))
    j = j.repartition(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name")
    score = lambda a, b: F.round(M.sequence_similarity(a, b), 6)
    return j.select("name", "page", "prompt", "provider", "model", "run", "reason", score("tags_attrs", "g_attrs").alias("structure_attrs"), score("tags", "g_tags").alias("structure_tags"), F.round(_text_similarity("content", "g_content"), 6).alias("content_score"))


def _text_similarity(a: str, b: str) -> Column:
    return M.sequence_similarity(F.col(a), F.col(b))


def similarity_summary(table: DataFrame, by: list[str]) -> DataFrame:
    names = ("structure_attrs", "structure_tags", "content_score")
    return table.filter("reason is null").groupBy(*by).agg(F.count("*").alias("runs"), *[F.round(F.avg(n), 6).alias(f"{n}_mean") for n in names], *[F.round(F.stddev(n), 6).alias(f"{n}_sd") for n in names])
