"""Queries of alignment and evaluation, dictionary XML, joins and linking, streams.

Two editions of the same pages stand in for ground truth and model output: the documents' lines with
their first word as headword, reduced to ASCII (DuckDB counts bytes in an edit distance), and the same
without every seventh line and with some letters changed. The equivalent is the rest of the line.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import similarity as M
from lexloom.functions import text as T
from lexloom.operators import alignment, dictionary, linking, tei
from lexloom.plans import fragments as S
from lexloom.plans.collection import Queries, Tables
from lexloom.sources.scratch import scratch_folder, written
from lexloom.streaming import replies as streams

Q = Queries()

_EDITIONS = f"""{S.ENTRIES}, raw as (select page, seq, {S.tokens(S.ascii_only('line'))} as t from lines),
gt as (select page, row_number() over (partition by page order by seq) - 1 as seq, t[1] as headword, array_to_string(t[2:], ' ') as equivalent from raw where len(t) > 0),
llm as (select page, row_number() over (partition by page order by seq) - 1 as seq, case when seq % 3 = 0 then replace(headword, 'o', 'c') else headword end as headword, equivalent from gt where seq % 7 <> 6 and page % 50 <> 49)"""


def _truth(t: Tables) -> DataFrame:
    """Numbers come from a text's own lines, without a shuffle; only where an id stands twice are the lines of its texts numbered together."""
    d = t.documents.select("doc_id", "text")
    words = lambda line: F.filter(F.split(F.regexp_replace(line, "[^ -~]+", ""), "[^A-Za-z0-9]+"), lambda x: x != "")  # noqa: E731  T.tokens of what is ASCII
    rows = lambda lines: F.filter(F.transform(lines, words), lambda w: F.size(w) > 0)
    if d.groupBy("doc_id").count().filter("count > 1").isEmpty():
        e = d.select(F.col("doc_id").alias("page"), F.posexplode(rows(T.lines(F.col("text")))).alias("seq", "t")).withColumn("seq", F.col("seq").cast("long"))
    else:
        e = dictionary.page_lines(d).select("page", "seq", F.explode(rows(F.array("line"))).alias("t"))
        e = e.withColumn("seq", (F.row_number().over(Window.partitionBy("page").orderBy("seq")) - 1).cast("long"))
    return e.select("page", "seq", F.element_at("t", 1).alias("headword"), F.array_join(F.slice("t", F.lit(2), F.size("t")), " ").alias("equivalent"))


def _of_truth(truth: DataFrame) -> DataFrame:
    """Rows are numbered from 0 without gaps, so a row's new number is its old one less the sevenths before it."""
    head = F.when(F.col("seq") % 3 == 0, F.replace("headword", F.lit("o"), F.lit("c"))).otherwise(F.col("headword"))
    return truth.filter("seq % 7 <> 6 and page % 50 <> 49").select("page", (F.col("seq") - F.floor(F.col("seq") / 7)).alias("seq"), head.alias("headword"), "equivalent")


def _model(t: Tables) -> DataFrame:
    return _of_truth(_truth(t))


def _editions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Both editions; the texts are cut up once, and the second is read out of the first."""
    truth = written(_truth(t), "truth")
    return truth, _of_truth(truth)


_BAND = f"""gn as materialized (select *, {S.norm('headword')} as k, {S.norm('equivalent')} as s from gt), mn as materialized (select *, {S.norm('headword')} as k, {S.norm('equivalent')} as s from llm),
band as (select g.page, g.seq as gt_seq, m.seq as llm_seq, abs(g.seq - m.seq) as dist, g.headword as gh, m.headword as mh, g.equivalent as ge, m.equivalent as me, g.k as gk, m.k as mk, g.s as gs, m.s as ms from gn g join mn m on g.page = m.page and abs(g.seq - m.seq) <= 10)"""


def _er(a: str, b: str) -> str:
    return f"case when {a} = '' and {b} = '' then cast(100 as double) else cast(100 as double) * (1 - cast(levenshtein({a}, {b}) as double) / greatest(length({a}), length({b}))) end"


_MATCH = f"""heads as (select *, {_er('gk', 'mk')} as h from band where gk <> ''),
scored as (select *, case when gk = mk or h >= 30 then {_er('gs', 'ms')} else 0 end as s, greatest(h, 0) as f from heads),
kinds as (select *, (gs = '' and ms = '') or (gs <> '' and ms <> '' and s >= 30) as passes, gs <> '' and ms <> '' as both_ from scored),
matched as (select page, gt_seq, llm_seq, dist, gh, mh, ge, me, case when gk = mk and passes then 'primary_exact' when h >= 30 and passes then 'primary_fuzzy' when both_ and s >= 30 and f >= 85 then 'fallback' end as kind,
case when gk = mk and passes then cast(300 as double) - dist when h >= 30 and passes then h + (case when both_ and s > 0 then s else h end) - dist * cast(0.1 as double) when both_ and s >= 30 and f >= 85 then cast(100 as double) + s + f - dist * cast(0.2 as double) end as score from kinds where gk <> ''),
best as (select * from (select *, row_number() over (partition by page, gt_seq order by score desc, dist, kind = 'fallback', llm_seq) as n from matched where kind is not null) where n = 1)"""

_edit_ratio = partial(M.plain_edit_ratio, least=alignment.SECOND)
_PLAIN = {"head_ratio": _edit_ratio, "second_ratio": _edit_ratio, "part_ratio": _edit_ratio}


def _best(t: Tables) -> DataFrame:
    return alignment.align_static(*_editions(t), "headword", "equivalent", **_PLAIN)


@Q.add(f"with {_EDITIONS}, {_BAND} select page, gt_seq, llm_seq, dist from band")
def band_candidates(t: Tables) -> DataFrame:
    return alignment.band_candidates(*_editions(t)).select("page", "gt_seq", "llm_seq", "dist")


@Q.add(f"with {_EDITIONS}, {_BAND}, {_MATCH} select page, gt_seq, llm_seq, kind, round(score, 6) as score from matched where kind is not null")
def fuzzy_candidates(t: Tables) -> DataFrame:
    return alignment.scored_candidates(*_editions(t), "headword", "equivalent", **_PLAIN).select("page", "gt_seq", "llm_seq", "kind", F.round("score", 6).alias("score"))


@Q.add(f"with {_EDITIONS}, {_BAND}, {_MATCH} select page, gt_seq, llm_seq, kind, round(score, 6) as score from best")
def align_static(t: Tables) -> DataFrame:
    return _best(t).select("page", "gt_seq", "llm_seq", "kind", F.round("score", 6).alias("score"))


@Q.add(f"with {_EDITIONS}, {_BAND}, {_MATCH} select kind, count(*) as n, count(*) filter (where dist = 0) as straight from best group by 1")
def best_match(t: Tables) -> DataFrame:
    return _best(t).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("dist") == 0).alias("straight"))


@Q.add()
def align_sequential(t: Tables) -> DataFrame:
    return alignment.align_sequential(*_editions(t), "headword", "equivalent")


@Q.add()
def match_score(t: Tables) -> DataFrame:
    return alignment.align_static(*_editions(t), "headword", "equivalent").select("page", "gt_seq", "llm_seq", "kind", "score")


@Q.add(f"with {_EDITIONS}, {_BAND}, {_MATCH} select page, seq, headword from llm where not exists (select 1 from best where best.page = llm.page and best.llm_seq = llm.seq)")
def unmatched_model(t: Tables) -> DataFrame:
    truth, model = _editions(t)
    best = alignment.align_static(truth, model, "headword", "equivalent", **_PLAIN)
    return alignment.unmatched(model, best, "llm_seq").select("page", "seq", "headword")


@Q.add(f"with {_EDITIONS}, {_BAND}, {_MATCH} select page, seq, headword from gt where not exists (select 1 from best where best.page = gt.page and best.gt_seq = gt.seq)")
def unmatched_truth(t: Tables) -> DataFrame:
    truth, model = _editions(t)
    best = alignment.align_static(truth, model, "headword", "equivalent", **_PLAIN)
    return alignment.unmatched(truth, best, "gt_seq").select("page", "seq", "headword")


def _cer(a: str, b: str) -> str:
    return f"case when {S.norm(a)} = '' and {S.norm(b)} = '' then cast(0 as double) when {S.norm(a)} = '' or {S.norm(b)} = '' then cast(1 as double) else cast(levenshtein({S.norm(a)}, {S.norm(b)}) as double) / length({S.norm(a)}) end"


@Q.add(f"with {_EDITIONS} select page, seq, round({_cer('m.headword', 'g.headword')}, 6) as cer from gt g join llm m using (page, seq)")
def cer_pairs(t: Tables) -> DataFrame:
    truth, model = _editions(t)
    g, m = truth.select("page", "seq", F.col("headword").alias("g")), model.select("page", "seq", F.col("headword").alias("m"))
    return g.join(m, ["page", "seq"]).select("page", "seq", F.round(M.cer(F.col("m"), F.col("g")), 6).alias("cer"))


_METRICS = f"""{_EDITIONS}, {_BAND}, {_MATCH}, pairs as (select page, 'headword' as field, gh as g, mh as m from best union all select page, 'equivalent', ge, me from best),
done as (select page, field, count(*) as matched, cast(sum(length({S.norm('g')})) as bigint) as chars, case when sum(length({S.norm('g')})) > 0 then sum({_cer('m', 'g')} * length({S.norm('g')})) / sum(length({S.norm('g')})) end as cer from pairs group by 1, 2),
fields as (select unnest(['headword', 'equivalent']) as field), gc as (select page, count(*) as n from gt group by 1), mc as (select page, count(*) as n from llm group by 1),
metrics as (select coalesce(gc.page, mc.page) as page, fields.field as field, coalesce(gc.n, 0) as gt_count, coalesce(mc.n, 0) as llm_count, coalesce(matched, 0) as matched, coalesce(chars, 0) as chars, round(coalesce(cer, 'nan'), 6) as cer from gc full join mc using (page) cross join fields left join done d on d.page = coalesce(gc.page, mc.page) and d.field = fields.field)"""


def _metrics(t: Tables) -> DataFrame:
    truth, model = _editions(t)
    best = alignment.align_static(truth, model, "headword", "equivalent", errors=True, **_PLAIN)
    return alignment.page_field_errors(truth, model, best, {"headword": "key", "equivalent": "second"}).withColumn("cer", F.round("cer", 6))


@Q.add(f"with {_METRICS} select * from metrics")
def page_field_cer(t: Tables) -> DataFrame:
    return _metrics(t)


@Q.add(f"with {_METRICS} select field, count(*) as pages, cast(sum(chars) as bigint) as chars, round(sum(case when chars > 0 then cer * chars else 0 end) / sum(chars), 4) as cer from metrics group by 1")
def weighted_cer(t: Tables) -> DataFrame:
    value = F.when(F.col("chars") > 0, F.col("cer")).otherwise(0.0)
    return _metrics(t).groupBy("field").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.round(alignment.weighted_mean(value, F.col("chars")), 4).alias("cer"))


@Q.add(f"with {_METRICS}, n as (select *, row_number() over (partition by field order by page) - 1 as pos from metrics) select page, field, pos, case when isnan(cer) then cer else least(cer, 2.0) end as value, case when pos % 10 = 0 then cast(page as varchar) else '' end as tick from n")
def chart_series(t: Tables) -> DataFrame:
    return alignment.chart_series(_metrics(t))


@Q.add(f"with {_EDITIONS}, g as (select page, count(*) as n from gt group by 1), m as (select page, count(*) as n from llm group by 1) select page, coalesce(g.n, 0) as gt_count, coalesce(m.n, 0) as llm_count, case when m.n is null then 'truth' when g.n is null then 'model' else 'both' end as side from g full join m using (page)")
def page_coverage(t: Tables) -> DataFrame:
    return alignment.page_coverage(*_editions(t))


@Q.add(f"with {_EDITIONS} select page, seq, headword, equivalent from gt where page not in (select page from llm)")
def unaligned_gt(t: Tables) -> DataFrame:
    return alignment.unaligned(*_editions(t))


@Q.add("select doc_id, exists (select 1 from labels l where l.doc_id = d.doc_id) as has_truth from documents d")
def has_ground_truth(t: Tables) -> DataFrame:
    known = t.labels.select("doc_id").distinct().withColumn("has_truth", F.lit(True))
    return t.documents.select("doc_id").join(known, "doc_id", "left").withColumn("has_truth", F.coalesce("has_truth", F.lit(False)))


@Q.add("""with r as (select doc_id // 5 as word, doc_id % 5 // 2 as sense, quality, case when doc_id % 2 = 0 then toxic end as register_ok, toxic as label_ok from labels), p as (select word, sense, max(quality) as sense_ok, max(register_ok) as register_ok from r group by 1, 2)
select * from (select count(*) as senses, round(avg(cast(sense_ok as double)), 6) as sense_ok, round(avg(cast(register_ok as double)), 6) as register_ok from p), (select count(label_ok) as labels, round(avg(cast(label_ok as double)), 6) as label_ok from r)""")
def judgement_rollup(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    rows = t.labels.select(F.floor(d / 5).alias("word"), F.floor(d % 5 / 2).alias("sense"), F.col("quality").alias("sense_ok"), F.when(d % 2 == 0, F.col("toxic")).alias("register_ok"), F.col("toxic").alias("label_ok"))
    return alignment.judgements(rows, "word", "sense", ["sense_ok", "register_ok"], "label_ok")


@Q.add("""with a as (select doc_id, 'a' as model, lang as answer from documents union all select doc_id, 'b', case when doc_id % 3 = 0 then source else lang end from documents union all select doc_id, 'c', case when doc_id % 4 = 0 then null else lang end from documents)
select x.model as model_a, y.model as model_b, count(*) as items, round(avg(case when x.answer is not distinct from y.answer then cast(1 as double) else 0 end), 6) as share from a x join a y on x.doc_id = y.doc_id and x.model < y.model group by 1, 2""")
def model_agreement(t: Tables) -> DataFrame:
    d = t.documents
    a = d.select("doc_id", F.lit("a").alias("model"), F.col("lang").alias("answer"))
    b = d.select("doc_id", F.lit("b").alias("model"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.col("lang")).alias("answer"))
    c = d.select("doc_id", F.lit("c").alias("model"), F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("answer"))
    return alignment.agreement(a.unionByName(b).unionByName(c), "doc_id", "model", "answer")


def _word_pairs(t: Tables) -> DataFrame:
    truth, model = _editions(t)
    return truth.join(model.select("page", "seq", F.col("headword").alias("h2"), F.col("equivalent").alias("e2")), ["page", "seq"])


@Q.add()
def fuzz_ratio(t: Tables) -> DataFrame:
    return _word_pairs(t).select("page", "seq", M.ratio(F.col("headword"), F.col("h2")).alias("ratio"))


@Q.add()
def token_set_ratio(t: Tables) -> DataFrame:
    return _word_pairs(t).select("page", "seq", M.token_set_ratio(F.lower("equivalent"), F.lower("e2")).alias("ratio"))


@Q.add()
def partial_ratio(t: Tables) -> DataFrame:
    return _word_pairs(t).select("page", "seq", M.partial_ratio(F.lower("headword"), F.lower("e2")).alias("ratio"))


# --- markup

_TAGS = "list_transform(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda x: lower(x))"


@Q.add(f"select page_id, array_to_string({_TAGS}, ' ') as tags, len({_TAGS}) as n from pages")
def tag_sequence(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tei.tag_sequence(F.col("html")).alias("t")).select("page_id", F.array_join("t", " ").alias("tags"), F.size("t").cast("long").alias("n"))


@Q.add("select page_id, " + S.squeezed("regexp_replace(html, '<[^>]*>', ' ', 'g')") + " as content from pages")
def content_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tei.content_text(F.col("html")).alias("content"))


def _run_rows(t: Tables) -> DataFrame:
    html = F.col("html")
    name = F.concat(F.lit("page"), F.floor(F.col("page_id") / 5).cast("string"), F.lit("_p1_prov_m"), (F.col("page_id") % 5).cast("string"), F.lit("_1.xml"))
    return t.pages.select(name.alias("name"), "page_id", tei.tag_sequence(html).alias("tags"), tei.tag_attribute_sequence(html).alias("tags_attrs"), tei.content_text(html).alias("content"))


@Q.add()
def similarity_table(t: Tables) -> DataFrame:
    r = _run_rows(t)
    truth = r.filter("page_id % 5 = 0").select(T.parse_run_name(F.col("name"))["page"].alias("page"), "tags", "tags_attrs", "content")
    return tei.similarity_table(r.drop("page_id"), truth)


@Q.add()
def similarity_summary(t: Tables) -> DataFrame:
    return tei.similarity_summary(similarity_table(t), ["prompt", "provider", "model"])


@Q.add()
def sequence_similarity(t: Tables) -> DataFrame:
    w = _word_pairs(t)
    return w.select("page", "seq", F.round(M.sequence_similarity(F.split("headword", ""), F.split("h2", "")), 6).alias("ratio"))


# --- fragments: a document's lines are chunks of a page's columns


@Q.add("""select doc_id, case when doc_id % 4 < 2 then '<entry>' || lang || '</entry><entry>' || source || '</entry>' when doc_id % 4 = 2 then '<entry>' || lang || '</entry>' else '<entry>katki' || chr(10) end as content, doc_id % 4 <> 3 as well_formed from documents""")
def unwrap_fragment(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    inner = F.concat(F.lit("<entry>"), "lang", F.lit("</entry><entry>"), "source", F.lit("</entry>"))
    xml = F.when(d % 4 == 0, F.concat(F.lit("<root>"), inner, F.lit("</root>"))).when(d % 4 == 1, F.concat(F.lit('<div type="x">'), inner, F.lit("</div>"))).when(d % 4 == 2, F.concat(F.lit("<entry>"), "lang", F.lit("</entry>"))).otherwise("<entry>katki")
    return tei.unwrap_fragment(t.documents.select("doc_id", xml.alias("xml")), "xml").select("doc_id", "content", "well_formed")


_CHUNKS = f"{S.ENTRIES}, chunks as (select page, seq % 2 + 1 as \"column\", seq // 2 + 1 as chunk, line as content from lines)"


def _chunks(t: Tables) -> DataFrame:
    return dictionary.page_lines(t.documents).select("page", (F.col("seq") % 2 + 1).alias("column"), (F.floor(F.col("seq") / 2) + 1).alias("chunk"), F.col("line").alias("content"))


@Q.add(f"with {_CHUNKS} select page, string_agg(content, '|' order by \"column\", chunk) as parts, count(*) as n from chunks group by 1")
def ordered_chunks(t: Tables) -> DataFrame:
    return tei.ordered_chunks(_chunks(t), ["page"]).select("page", F.array_join("parts", "|").alias("parts"), F.size("parts").cast("long").alias("n"))


@Q.add(f"with {_CHUNKS} select page, string_agg(content, chr(10) order by \"column\", chunk) as content from chunks group by 1")
def concat_fragments(t: Tables) -> DataFrame:
    return tei.concat_fragments(_chunks(t), ["page"])


@Q.add(f"with {_CHUNKS}, n as (select *, row_number() over (partition by page order by \"column\", chunk) as i from chunks) select page, string_agg('--- CHUNK ' || i || ' ---' || chr(10) || content || chr(10) || chr(10), '' order by i) as request from n group by 1")
def numbered_chunks(t: Tables) -> DataFrame:
    return tei.numbered_chunks(_chunks(t), ["page"])


@Q.add(f"""with {_CHUNKS}, c as (select page, "column", string_agg(content, chr(10) order by chunk) as content, page % 7 = 0 and "column" = 2 as bad from chunks group by 1, 2)
select page, '<div type="page" n="' || page || '" corresp="#p' || page || '">' || string_agg(content, '' order by "column") filter (where not bad) || '</div>' as xml, count(*) filter (where bad) as skipped from c group by 1 having count(*) filter (where not bad) > 0""")
def assemble_page(t: Tables) -> DataFrame:
    c = tei.concat_fragments(_chunks(t), ["page", "column"]).withColumn("well_formed", ~((F.col("page") % 7 == 0) & (F.col("column") == 2)))
    return tei.assemble_page(c)


_PARTS = f"{S.ENTRIES}, parts as (select page, 'e' || seq % 3 as xml_id, seq, lower({S.tokens('line')}[1]) as child from lines where len({S.tokens('line')}) > 0)"


def _parts(t: Tables) -> DataFrame:
    child = F.lower(F.try_element_at(T.tokens(F.col("line")), F.lit(1)))
    return dictionary.page_lines(t.documents).select("page", F.concat(F.lit("e"), (F.col("seq") % 3).cast("string")).alias("xml_id"), "seq", child.alias("child")).filter("child is not null")


@Q.add(f"with {_PARTS}, f as (select page, xml_id, child, min(seq) as seq from parts group by 1, 2, 3) select page, xml_id, string_agg(child, '|' order by seq) as children from f group by 1, 2")
def merge_split_entries(t: Tables) -> DataFrame:
    return tei.merge_split_entries(_parts(t), "page", "xml_id", "seq", "child").withColumn("children", F.array_join("children", "|"))


@Q.add(f"with {_PARTS} select page, xml_id, min(seq) as seq, child from parts group by 1, 2, 4")
def dedupe_entries(t: Tables) -> DataFrame:
    return tei.dedupe_entries(_parts(t), "page", "xml_id", "seq", "child")


@Q.add(f"with {_EDITIONS} select page, seq, coalesce(case when seq % 5 <> 0 then headword end, '') as headword, equivalent from gt")
def entries_flat(t: Tables) -> DataFrame:
    head = F.when(F.col("seq") % 5 != 0, F.col("headword"))
    pages = _truth(t).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("seq", head.alias("headword"), "equivalent"))).alias("entries"))
    return tei.entries_flat(pages, "page", "entries", ["headword", "equivalent"])


# --- linking: words are the first words of benchmark items, dictionaries the editions

_WORDS = f"words as (select item_id, lower({S.tokens(S.ascii_only('text'))}[1 + item_id % 2]) as word from benchmark)"


def _words(t: Tables) -> DataFrame:
    w = T.tokens(F.regexp_replace("text", "[^ -~]", ""))
    return t.benchmark.select("item_id", F.lower(F.try_element_at(w, (F.col("item_id") % 2 + 1).cast("int"))).alias("word"))


_DICT = "dict as (select page, seq, page * 100000 + seq as ord, lower(headword) as entry, equivalent from gt)"


def _dict(t: Tables) -> DataFrame:
    return _truth(t).select("page", "seq", (F.col("page") * 100000 + F.col("seq")).alias("ord"), F.lower("headword").alias("entry"), "equivalent")


@Q.add(f"with {_EDITIONS}, {_DICT}, {_WORDS}, f as (select entry, arg_min(equivalent, ord) as link from dict group by 1) select item_id, word, coalesce(link, 'Ei leitud') as link from words left join f on entry = word")
def dict_lookup(t: Tables) -> DataFrame:
    return linking.exact_link(_words(t), _dict(t), "word", "entry", "equivalent", "ord")


@Q.add(f"""with {_EDITIONS}, {_DICT}, {_WORDS}, a as (select entry, arg_min(equivalent, ord) as l from dict where page % 2 = 0 group by 1), b as (select entry, arg_min(equivalent, ord) as l from dict where page % 2 = 1 group by 1)
select item_id, word, coalesce(a.l, b.l, 'Ei leitud') as link, case when a.l is not null then 'first' when b.l is not null then 'second' else 'none' end as source from words left join a on a.entry = word left join b on b.entry = word""")
def fallback_lookup(t: Tables) -> DataFrame:
    d = _dict(t)
    return linking.fallback_lookup(_words(t), d.filter("page % 2 = 0"), d.filter("page % 2 = 1"), "word", "entry", "equivalent", "ord")


_FORMS = "dforms as (select page % 3 as author, page * 100000 + seq as row_no, case when seq % 4 = 3 then null else lower(headword) || ', ' || lower(equivalent) || ',' end as forms from gt), forms as (select author, row_no, trim(unnest(string_split(forms, ','))) as form from dforms where forms is not null)"


def _forms(t: Tables) -> DataFrame:
    forms = F.when(F.col("seq") % 4 != 3, F.concat(F.lower("headword"), F.lit(", "), F.lower("equivalent"), F.lit(",")))
    d = _truth(t).select((F.col("page") % 3).alias("author"), (F.col("page") * 100000 + F.col("seq")).alias("row_no"), forms.alias("forms"))
    return linking.synonym_forms(d, "forms").select("author", "row_no", "form")


@Q.add(f"with {_EDITIONS}, {_FORMS} select * from forms where form <> ''")
def synonym_forms(t: Tables) -> DataFrame:
    return _forms(t)


@Q.add(f"with {_EDITIONS}, {_FORMS}, {_WORDS} select item_id, word, min(case when author = 0 then row_no end) as \"0\", min(case when author = 1 then row_no end) as \"1\", min(case when author = 2 then row_no end) as \"2\" from words left join forms on form = word group by 1, 2")
def dict_three_way(t: Tables) -> DataFrame:
    return linking.dictionary_columns(_words(t), _forms(t), "word", "author", [0, 1, 2])


@Q.add(f"""with {_EDITIONS}, {_FORMS}, {_WORDS}, w as (select distinct word from words where word is not null), f as (select distinct author, form from forms where form <> ''),
d as (select word, author, form, levenshtein(word, form) as distance from w join f on abs(length(word) - length(form)) <= 3)
select * from (select word, author, form, distance, row_number() over (partition by word, author order by distance, form) as rank from d where distance <= 3) where rank <= 2""")
def nearest_form(t: Tables) -> DataFrame:
    n = linking.nearest_form(_words(t).filter("word is not null"), _forms(t), "word", "author", k=2)
    return n.withColumn("distance", F.col("distance").cast("long")).withColumn("rank", F.col("rank").cast("long"))


_VARIANTS = f"""{_EDITIONS}, v0 as (select word, unnest([word, upper(word[1]) || lower(word[2:]), lower(word)]) as variant, unnest([0, 1, 2]) as i from (select distinct {S.tokens(S.ascii_only('text'))}[1] as word from benchmark) where word is not null),
v1 as (select word, variant, min(i) as i from v0 group by 1, 2), v as (select word, variant, cast(row_number() over (partition by word order by i) - 1 as int) as pos from v1),
hits as (select word, variant, pos, headword || ' ' || equivalent as hit from v join (select distinct headword, equivalent from gt) on headword = variant)"""


def _variant_hits(t: Tables) -> DataFrame:
    words = t.benchmark.select(F.try_element_at(T.tokens(F.regexp_replace("text", "[^ -~]", "")), F.lit(1)).alias("word")).filter("word is not null").distinct()
    d = _truth(t).select(F.col("headword").alias("entry"), F.concat("headword", F.lit(" "), "equivalent").alias("hit")).distinct()
    return linking.variant_lookup(words, d, "word", "entry", "hit")


@Q.add(f"with {_VARIANTS} select * from hits")
def variant_lookup(t: Tables) -> DataFrame:
    return _variant_hits(t)


@Q.add(f"""with {_VARIANTS}, one as (select word, variant, pos, min(hit) as hit, count(*) as n from hits group by 1, 2, 3)
select word, string_agg('Variant ''' || variant || ''': ' || hit[1:10] || case when n > 1 then ' Sünonüümid: n' || n || ', x' else '' end, chr(10) order by pos) as digest from one group by 1""")
def lookup_digest(t: Tables) -> DataFrame:
    one = _variant_hits(t).groupBy("word", "variant", "pos").agg(F.min("hit").alias("hit"), F.count("*").alias("n"))
    synonyms = F.when(F.col("n") > 1, F.array(F.concat(F.lit("n"), F.col("n").cast("string")), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return linking.lookup_digest(one.withColumn("synonyms", synonyms), "word", "pos", "variant", "hit", "synonyms", 10)


_SECTION = S.squeezed("regexp_replace(regexp_extract(html, '(?s)<{0}(?:\\s[^>]*)?>(.*?)</{0}>', 1), '<[^>]*>', ' ', 'g')")


@Q.add(
    "select page_id, coalesce(case when regexp_matches(html, '(?s)<main(?:\\s[^>]*)?>(.*?)</main>') then '-' end, case when regexp_matches(html, '(?s)<div[^>]*class=\"ad\"[^>]*>(.*?)</div>') and page_id % 2 = 0 then "
    + S.squeezed("regexp_replace(regexp_extract(html, '(?s)<div[^>]*class=\"ad\"[^>]*>(.*?)</div>', 1), '<[^>]*>', ' ', 'g')")
    + " end, case when regexp_matches(html, '(?s)<footer(?:\\s[^>]*)?>(.*?)</footer>') then " + _SECTION.replace("{0}", "footer") + " end, 'Ei leitud') as section, array_to_string(list_transform(regexp_extract_all(html, '(?s)<li(?:\\s[^>]*)?>(.*?)</li>', 1), lambda x: "
    + S.squeezed("regexp_replace(x, '<[^>]*>', ' ', 'g')") + "), '|') as items from pages"
)
def html_sections(t: Tables) -> DataFrame:
    html = F.col("html")
    section = F.when(F.col("page_id") % 2 == 0, linking.section(html, ["main", "div.ad", "footer"])).otherwise(linking.section(html, ["main", "footer"]))
    return t.pages.select("page_id", section.alias("section"), F.array_join(linking.items(html), "|").alias("items"))


# --- streams: the events arrive as files


def _event_stream(t: Tables) -> DataFrame:
    """events.parquet, a file or a folder of files, as a file stream of its folder."""
    return t.spark.readStream.schema(t.events.schema).option("recursiveFileLookup", True).parquet(f"{t.sf_dir}/events.parquet*")


def _reply_stream(t: Tables) -> DataFrame:
    reply = F.concat(F.lit("Kasutus: "), "event_type", F.lit("\nPõhjendus: "), F.coalesce("props", F.lit("")))
    return _event_stream(t).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value", reply.alias("reply"))


@Q.add("select event_id, event_type as category, coalesce(props, 'Pole infot') as reason from events")
def stream_replies(t: Tables) -> DataFrame:
    folder = scratch_folder(t.spark, "stream-replies")
    streams.append(streams.parsed_replies(_reply_stream(t), "event_id", "ts", "reply", late="1000 days"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("event_id", "category", "reason")


@Q.add("select event_type, count(*) as n, round(sum(value), 4) as value from events group by 1")
def stream_append(t: Tables) -> DataFrame:
    folder = scratch_folder(t.spark, "stream-append")
    streams.append(_event_stream(t).select("event_id", "event_type", "value"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@Q.add("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def stream_latest_page(t: Tables) -> DataFrame:
    folder = scratch_folder(t.spark, "stream-pages")
    rows = _event_stream(t).select("user_id", "event_id", "event_type", "ts")
    streams.upsert_pages(rows, f"{folder}/out", f"{folder}/checkpoint", ["user_id"], ["ts", "event_id"]).awaitTermination()
    return streams.latest_pages(t.spark, f"{folder}/out", rows.schema, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@Q.add("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def stream_latest_state(t: Tables) -> DataFrame:
    folder = scratch_folder(t.spark, "stream-state")
    rows = _event_stream(t).select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    changed = streams.changed_pages(rows, ["user_id"], ["ts", "event_id"], "ts", late="1000 days", keep=1000 * 86_400_000)
    streams.upsert_pages(changed, f"{folder}/out", f"{folder}/checkpoint", ["user_id"], ["ts", "event_id"], changes=True).awaitTermination()
    return streams.latest_pages(t.spark, f"{folder}/out", rows.schema, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


QUERIES, ORACLES = Q.queries, Q.oracles
