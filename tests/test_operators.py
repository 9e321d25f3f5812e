"""What SQL can't say, and sources and sinks, on invented rows."""

import difflib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import similarity as M
from lexloom.functions import text as T
from lexloom.operators import alignment, corpus, replies, runs, tei
from lexloom.sources import readers, sinks
from lexloom.streaming import replies as streams


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_readers(spark, tmp_path):
    (tmp_path / "k.txt").write_text("  maja \n\n auto\n")
    assert rows(readers.read_keywords(spark, str(tmp_path / "k.txt")), "pos", "word") == [(1, "maja"), (2, "auto")]
    (tmp_path / "w.csv").write_text("﻿sõna\tmeel\tmuu\nmaja\thoone\tx\n", encoding="utf-8")
    assert rows(readers.read_delimited(spark, str(tmp_path / "w.csv"), ["sõna", "meel"]), "sõna", "meel") == [("maja", "hoone")]
    with pytest.raises(ValueError, match="pole"):
        readers.read_delimited(spark, str(tmp_path / "w.csv"), ["pole"])
    (tmp_path / "book").mkdir()
    (tmp_path / "book/a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "book/b.csv").write_text("x,y\n3,4\n")
    assert rows(readers.read_workbook(spark, str(tmp_path / "book")), "sheet", "x") == [("a", "1"), ("b", "3")]
    (tmp_path / "c.json").write_text('[{"Left": [{"str": "üks"}, {}], "Kwic": [{"str": "maja"}]}, {}]')
    flat = corpus.flatten_lines(readers.read_concordance(spark, str(tmp_path / "c.json")), [])
    assert rows(flat, "left_context", "full_context") == [("", ""), ("üks", "üks maja")]
    (tmp_path / "enc").mkdir()
    (tmp_path / "enc/u.txt").write_bytes("õun".encode())
    (tmp_path / "enc/w.txt").write_bytes("õun".encode("cp1252"))
    assert {r.text for r in readers.read_text_any_encoding(spark, str(tmp_path / "enc")).collect()} == {"õun"}
    (tmp_path / "ctx").mkdir()
    (tmp_path / "ctx/maja_full_context_only.txt").write_text("suur maja\n\n väike maja \n")
    assert rows(readers.read_contexts(spark, str(tmp_path / "ctx")), "word", "line_no", "text") == [("maja", 1, "suur maja"), ("maja", 2, "väike maja")]
    (tmp_path / "e.csv").write_text("head;page_number\na; 1 \nb;\nc;  \n")
    assert rows(readers.read_entries(spark, str(tmp_path / "e.csv")), "head", "page_number") == [("a", "1")]
    (tmp_path / "p.csv").write_text('Nimi,Prompt\nüks,"mitu\nrida ""nii"""\n')
    assert rows(runs.prompt_lookup(readers.read_prompt_bank(spark, str(tmp_path / "p.csv")), "Nimi", "üks", "Prompt"), "Prompt") == [('mitu\nrida "nii"',)]


def test_sinks(spark, tmp_path):
    hits = spark.createDataFrame([("a/b", "x a/b y"), ("c", "c")], "word string, full_context string")
    sinks.write_concordances(hits, str(tmp_path / "out"))
    assert rows(spark.read.text(str(tmp_path / "out/text")), "value", "keyword_folder") == [("c", "c"), ("x a/b y", "a_b")]
    sinks.write_delimited(hits, str(tmp_path / "d"), "semicolon_quoted")
    assert rows(spark.read.csv(str(tmp_path / "d"), sep=";", header=True), "word") == [("a/b",), ("c",)]
    new = spark.createDataFrame([(1, 5, "new"), (2, 1, "two")], "page int, ts int, v string")
    old = spark.createDataFrame([(1, 3, "old"), (3, 1, "three")], "page int, ts int, v string")
    assert rows(sinks.upsert_latest(old, new, ["page"], [F.desc("ts")]), "page", "v") == [(1, "new"), (2, "two"), (3, "three")]


@pytest.mark.parametrize("compact", [1, 2, 20])
def test_streams_equal_batches(spark, tmp_path, monkeypatch, compact):
    monkeypatch.setattr(streams, "COMPACT", compact)
    df = spark.createDataFrame([(i, i % 3, f"Kasutus: k{i}") for i in range(30)], "id long, page long, reply string").withColumn("ts", F.timestamp_seconds(F.col("id") + 10**9))
    for part in (df.filter("id < 15"), df.filter("id >= 15"), df.filter("id = 3")):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        streams.append(streams.parsed_replies(stream, "id", "ts", "reply"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        streams.upsert_pages(stream, str(tmp_path / "pages"), str(tmp_path / "cp2"), ["page"], ["id"]).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "id", "category") == sorted(((i, f"k{i}") for i in range(30)), key=str)
    assert rows(streams.latest_pages(spark, str(tmp_path / "pages"), df.schema, ["page"], ["id"]), "page", "id") == [(0, 27), (1, 28), (2, 29)]
    (tmp_path / "nothing").mkdir()
    none = spark.readStream.schema(df.schema).parquet(str(tmp_path / "nothing"))
    streams.upsert_pages(none, str(tmp_path / "none"), str(tmp_path / "cp3"), ["page"], ["id"]).awaitTermination()
    assert streams.latest_pages(spark, str(tmp_path / "none"), df.schema, ["page"], ["id"]).count() == 0


TEI = '<div type="page"><entry xml:id="a"><form type="lemma"><orth>a</orth></form><sense><cit><quote>A in <placeName>H</placeName></quote></cit><entry xml:id="a_b"><form type="compound"/></entry></sense><usg corresp="#reval">r.</usg></entry></div>'


def test_tei(spark):
    flat = tei.flatten_tei(spark.createDataFrame([(1, TEI), (2, "<entry>katki")], "page long, xml string"), "page", "xml")
    got = {(r.element, r.entry_path, r.parent_path, r.text) for r in flat.collect()}
    assert ("entry", "1/2", "1", "") in got and ("cit", "1", None, "A in H") in got and ("damaged", None, None, None) in got
    assert ("usg", "#reval", 1) in rows(tei.usage_counts(flat), "element", "kind", "n")
    seq = tei.structure_sequence(spark.createDataFrame([(1, '<a y="2" x="1"><b/>t </a>'), (2, "<a>")], "id int, xml string"), ["id"], "xml")
    assert rows(seq, "tags", "tags_attrs", "content") == [(None, None, None), (["a", "b"], ["a", "@x=1", "@y=2", "b"], "t")]


def test_fragments(spark):
    f = spark.createDataFrame([("<root><a/>x<b/></root>",), ("<entry>y</entry>",), ("<katki",), (None,)], "x string")
    assert rows(tei.unwrap_fragment(f, "x"), "content", "well_formed") == sorted([("<a />x<b />", True), ("<entry>y</entry>", True), ("<katki\n", False), ("\n", False)], key=str)


@settings(max_examples=60, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_ratios(a, b):
    def slow(x, y):
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, c in enumerate(x):
            for j, d in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if c == d else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    assert M.lcs(a, b) == slow(a, b)
    assert M.plain_ratio(a, b) == M.plain_ratio(b, a) and M.plain_ratio(a, a) == 100
    assert M.plain_partial_ratio(a, a + b) == 100 or not a
    assert 0 <= M.plain_token_set_ratio(a, b) <= 100


def test_similarity_functions(spark):
    p = spark.createDataFrame([("kass", "kask"), ("", ""), (None, "x")], "a string, b string")
    assert rows(p.select(M.ratio(F.col("a"), F.col("b")).alias("r")), "r") == [(100,), (75,), (None,)]
    assert p.limit(1).select(M.sequence_similarity(F.col("a"), F.col("b"))).first()[0] == difflib.SequenceMatcher(None, "kass", "kask").ratio()
    assert rows(p.filter("a is not null").select(M.cer(F.col("a"), F.col("b")).alias("r")), "r") == [(0.0,), (0.25,)]


def test_alignments_agree_on_the_diagonal(spark):
    words = ["aed", "bussid", "cirkus", "dünaamika", "eesel", "fagott"]
    t = spark.createDataFrame([(1, i, w, f"saksa {w}") for i, w in enumerate(words)], "page long, seq long, headword string, equivalent string")
    one = alignment.align_sequential(t, t, "headword", "equivalent").select("gt_seq", "llm_seq", "kind", "score")
    two = alignment.align_static(t, t, "headword", "equivalent").select("gt_seq", "llm_seq", "kind", "score")
    assert rows(one, *one.columns) == rows(two, *two.columns) == [(i, i, "primary_exact", 300.0) for i in range(6)]
    m = alignment.page_field_metrics(t, t, two.withColumn("page", F.lit(1)), ["headword"]).first()
    assert (m.matched, m.cer) == (6, 0.0)
    gone = alignment.align_sequential(t, t.filter("seq < 0"), "headword", "equivalent")
    assert {r.llm_seq for r in gone.collect()} == {None}
    lost = alignment.page_field_metrics(t, t.filter("seq < 0"), gone.select("page", "gt_seq", "llm_seq"), ["headword"]).first()
    assert lost.llm_count == 0 and math.isnan(lost.cer)


def test_window_moves_with_matches(spark):
    t = spark.createDataFrame([(1, i, f"sõna{chr(97 + i)}", "") for i in range(20)], "page long, seq long, headword string, equivalent string")
    m = t.filter("seq >= 5").withColumn("seq", F.col("seq") - 5)
    got = {r.gt_seq: r.llm_seq for r in alignment.align_sequential(t, m, "headword", "equivalent").collect()}
    assert got[5] == 0 and got[19] == 14


def test_sense_rows_and_labels(spark):
    r = spark.createDataFrame([(1, "TÄHENDUSED: a§§§b\nMÄRGENDID: a-x, y§§§b-ei-kohaldu\n"), (2, "midagi")], "id int, reply string")
    s = replies.senses(r, ["id"], "reply")
    assert rows(replies.labels(s), "id", "sense_no", "label") == [(1, 1, "x"), (1, 1, "y"), (1, 2, "ei-kohaldu"), (2, 0, "ei-kohaldu")]


def test_prompt_and_grammar(spark):
    d = spark.createDataFrame([("tere Acc. obb, 14,11 .", "", "x")], "e string, decl string, w string")
    p = d.select(T.render_prompt(F.lit("{word}? {muu}"), {"word": F.col("w")}).alias("p")).withColumn("u", T.unfilled(F.col("p"))).first()
    assert (p.p, p.u) == ("x? {muu}", True)
    g = d.select(*[c.alias(n) for n, c in T.migrate_grammar(["e"], "decl").items()]).first()
    assert g.decl == "Acc. o 14,11" and g.e == "tere Acc. obb,."  # bounded removal leaves the word


def test_planned_runs(spark):
    n = runs.next_run_number(spark.createDataFrame([("a", 1), ("a", 3), ("b", 1), ("b", 2)], "j string, run int"), ["j"])
    assert rows(runs.planned_runs(n, 2), "j", "run") == [("a", 2), ("a", 3), ("b", 3), ("b", 4)]


def test_column_choices(spark):
    assert alignment.columns_to_load(["a", "b", "c"], ["c", None], ["a", "x", "c"]) == ["a", "c"]
    d = spark.createDataFrame([(1, 2, 3)], ["===NONE===_abs", "blogs_abs", "x"])
    assert corpus.prefixed_columns(d, ["blogs", "none"]).columns == ["blogs_abs", "none_abs"]


def test_labels_by_name(spark):
    d = spark.createDataFrame([([],), (None,), ([(None,)],), ([("blogs",), ("x",)],)], "l array<struct<name:string>>")
    assert [r.g for r in d.select(corpus.genre_label(F.col("l")).alias("g")).collect()] == ["unknown", "unknown", "tundmatu", "blogs"]


def test_read_tei(spark, tmp_path):
    """Entries of a TEI page as rows: text, attributes, repeated children; a page without entries gives none."""
    from lexloom.sources import readers

    page = """<?xml version="1.0"?><TEI><text><div type="page" n="7">
    <entry xml:id="kass" n="1"><form><orth> kass </orth></form><sense><cit>cat</cit></sense><sense><cit>tomcat</cit></sense></entry>
    <entry xml:id="koer" n="2"><form><orth>koer</orth></form><sense><cit>dog</cit></sense><note>vt kass</note></entry>
    </div></text></TEI>"""
    (tmp_path / "page.xml").write_text(page, encoding="utf-8")
    rows = {r["form"]["orth"]: r for r in readers.read_tei(spark, str(tmp_path / "page.xml")).collect()}
    assert set(rows) == {"kass", "koer"}
    assert [s["cit"] for s in rows["kass"]["sense"]] == ["cat", "tomcat"] and rows["kass"]["note"] is None
    assert rows["koer"]["note"] == "vt kass" and rows["koer"]["_n"] == 2


def test_distance_against_the_table():
    import random

    from lexloom.functions.similarity import plain_distance

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abõ") for _ in range(rng.randrange(90))) for _ in range(2))
        assert plain_distance(a, b) == table(a, b)


def test_nearest_over_blocks(spark, monkeypatch):
    """Blocks and shards give what all pairs give, ties to the smaller chunk; null vectors and other lengths don't meet."""
    from lexloom.operators import retrieval

    monkeypatch.setattr(retrieval, "BLOCK", 3)
    monkeypatch.setattr(retrieval, "SHARD", 4)
    chunks = [(i, [float(i % 7), float(i % 3)], i % 2) for i in range(30)] + [(90, None, 0), (91, [1.0], 0), (92, [1.0, 2.0], None)]
    queries = [(100 + i, [float(i % 5), 1.0], i % 2) for i in range(8)] + [(200, None, 1)]
    q, c = spark.createDataFrame(queries, "query_id long, q array<double>, label int"), spark.createDataFrame(chunks, "chunk_id long, v array<double>, label int")
    for on in (None, ["label"]):
        want = []
        for i, v, g in queries[:-1]:
            near = sorted((round(sum((x - y) ** 2 for x, y in zip(v, w, strict=True)), 6), j) for j, w, h in chunks if w and len(w) == 2 and (not on or g == h))[:5]
            want += [(i, j, d, n) for n, (d, j) in enumerate(near, 1)]
        got = retrieval.nearest(q if on else q.drop("label"), c if on else c.drop("label"), 5, on).select("query_id", "chunk_id", "distance", "rank").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_concordance_of_a_long_list(spark, monkeypatch):
    from lexloom.operators import corpus

    docs = spark.createDataFrame([(1, "Üks kass. Kaks koera! Kolm hiirt? Neli kassi. Viis."), (2, None), (3, "")], "doc_id long, text string")
    words = spark.createDataFrame([("kass",), ("KOERA",), ("kolm",), ("puudu",)], "word string")
    one = sorted(map(tuple, corpus.concordance(docs, words, window=1).collect()))
    monkeypatch.setattr(corpus, "ASKED", 1)
    assert sorted(map(tuple, corpus.concordance(docs, words, window=1).collect())) == one
    assert [(r[1], r[3], r[4], r[5], r[6]) for r in one] == [(0, "kass", "Üks", "kass", "Kaks koera!"), (1, "KOERA", "Üks kass. Kaks", "koera", "Kolm hiirt?"), (2, "kolm", "Kaks koera!", "Kolm", "hiirt Neli kassi.")]
