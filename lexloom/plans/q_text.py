"""Queries of the scalar functions and of the sources and sinks that a table can show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.functions import text as T
from lexloom.operators import dictionary
from lexloom.plans import fragments as S
from lexloom.plans.collection import Queries, Tables
from lexloom.sources import readers, sinks

Q = Queries()


@Q.add(f"select doc_id, unnest(range(1, len(l) + 1)) as pos, unnest(l) as word from (select doc_id, {S.lines()} as l from documents)")
def keywords_clean(t: Tables) -> DataFrame:
    return readers.keyword_lines(t.documents, "doc_id", "text")


@Q.add("""with r as (select c_custkey as list, unnest([case c_custkey % 4 when 0 then 'word' when 1 then 'Sona' when 2 then 'sõna' else c_name end, c_mktsegment]) as v, unnest([0, 1]) as pos from customer)
select list, pos, v as word from r where not (pos = 0 and lower(v) in ('sõna', 'sona', 'word'))""")
def header_sniff(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 4
    first = F.when(k == 0, "word").when(k == 1, "Sona").when(k == 2, "sõna").otherwise(F.col("c_name"))
    rows = t.customer.select(F.col("c_custkey").alias("list"), F.posexplode(F.array(first, F.col("c_mktsegment"))).alias("pos", "word"))
    return readers.without_header(rows, "pos", "word")


@Q.add("select doc_id, trim(source) as page, lang as headword from (select doc_id, lang, case when doc_id % 7 = 0 then '   ' when doc_id % 11 = 0 then null else '  ' || source || ' ' end as source from documents) where source is not null and trim(source) <> ''")
def entries_nonblank_page(t: Tables) -> DataFrame:
    page = F.when(F.col("doc_id") % 7 == 0, "   ").when(F.col("doc_id") % 11 == 0, None).otherwise(F.concat(F.lit("  "), F.col("source"), F.lit(" ")))
    return readers.nonblank_page(t.documents.select("doc_id", page.alias("page"), F.col("lang").alias("headword")), "page")


@Q.add("select c_custkey, translate(c_name || '/' || c_mktsegment || '\\x', '/\\', '__') as safe from customer")
def safe_keyword(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", T.safe_keyword(F.concat("c_name", F.lit("/"), "c_mktsegment", F.lit("\\x"))).alias("safe"))


@Q.add("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def latest_per_key(t: Tables) -> DataFrame:
    e = t.events
    return sinks.latest(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@Q.add("""select p_partkey, substr(regexp_replace(repeat(p_name || ':' || p_type || '?"<', 4), '[<>:"/\\\\|?*]', '_', 'g'), 1, 100) as safe from part""")
def sanitize_name(t: Tables) -> DataFrame:
    name = F.repeat(F.concat("p_name", F.lit(":"), "p_type", F.lit('?"<')), 4)
    return t.part.select("p_partkey", T.sanitize_name(name).alias("safe"))


# White space as other editors leave it: no-break and em spaces, a tab after the end sign.


@Q.add(f"select doc_id, {S.norm("replace(replace(text, '. ', '.' || chr(8195)), ', ', ',' || chr(160))")} as norm from documents")
def norm_text(t: Tables) -> DataFrame:
    text = F.replace(F.replace("text", F.lit(". "), F.lit(".\u2003")), F.lit(", "), F.lit(",\xa0"))
    return t.documents.select("doc_id", T.normalize_string(text).alias("norm"))


@Q.add(f"with {S.SENTENCES} select doc_id, pos, {S.norm_sentence("replace(sent, ', ', ',' || chr(160)) || chr(9)")} as norm from sents")
def norm_sentence(t: Tables) -> DataFrame:
    sent = F.concat(F.replace("sent", F.lit(", "), F.lit(",\xa0")), F.lit("\t"))
    return t.documents.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sent")).select("doc_id", F.col("pos").cast("long").alias("pos"), T.normalize_sentence(sent).alias("norm"))


@Q.add(
    "select doc_id, lower("
    + S.squeezed("replace(replace(replace(replace(replace(replace(replace('<p><s>' || replace(text, ',', ' ,') || ' .</s></p>', '<p>', ''), '</p>', ''), '<s>', ''), '</s>', ''), ' ,', ','), ''' ', ''''), ' .', '.')")
    + ") as norm from documents"
)
def norm_context(t: Tables) -> DataFrame:
    tagged = F.concat(F.lit("<p><s>"), F.replace("text", F.lit(","), F.lit(" ,")), F.lit(" .</s></p>"))
    return t.documents.select("doc_id", T.normalize_context(tagged).alias("norm"))


@Q.add("select c_custkey, trim(coalesce(case when c_custkey % 5 = 0 then null else '  ' || c_name || ' ' end, '')) as headword, trim(coalesce(c_mktsegment, '')) as segment, trim(coalesce(cast(c_acctbal as varchar), '')) <> '' as filled from customer")
def clean_fields(t: Tables) -> DataFrame:
    head = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("  "), "c_name", F.lit(" ")))
    return t.customer.select("c_custkey", T.clean_field(head).alias("headword"), T.clean_field(F.col("c_mktsegment")).alias("segment"), (T.clean_field(F.col("c_acctbal")) != "").alias("filled"))


@Q.add(f"with {S.ENTRIES} select page, count(*) as entries, count(*) filter (where contains(trim(line), ' ')) as violations, list_aggregate(list(line order by seq) filter (where contains(trim(line), ' '))[1:5], 'string_agg', '|') as first_five from lines group by 1")
def headword_violations(t: Tables) -> DataFrame:
    return dictionary.headword_report(dictionary.page_lines(t.documents), "line")


_G = {"a": "case when doc_id % 3 = 0 then 'wort g. a end' when doc_id % 3 = 1 then 'wort Acc. o, 14,11 x .' else 'plain ' || lang end", "d": "case when doc_id % 2 = 0 then 'old' else '' end"}


@Q.add(f"""with e as (select doc_id, {_G['a']} as f, {_G['d']} as d from documents)
select doc_id, case doc_id % 3 when 0 then 'wort end' when 1 then 'wort , x.' else f end as equivalent,
trim(d || ' ' || case doc_id % 3 when 0 then 'g. a' when 1 then 'Acc. o 14,11' else '' end) as declension from e""")
def grammar_migration(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    field = F.when(k == 0, "wort g. a end").when(k == 1, "wort Acc. o, 14,11 x .").otherwise(F.concat(F.lit("plain "), "lang"))
    e = t.documents.select("doc_id", field.alias("equivalent"), F.when(F.col("doc_id") % 2 == 0, "old").otherwise("").alias("declension"))
    return e.select("doc_id", *[c.alias(n) for n, c in T.migrate_grammar(["equivalent"], "declension").items()])


@Q.add("""with r as (select conv_id, turn, case turn % 3 when 0 then '```xml' || chr(10) || text || chr(10) || '```' when 1 then '  ```' || text || '```  ' else text end as reply from conversations)
select conv_id, turn, trim(regexp_replace(regexp_replace(trim(reply), '^```(xml)?', ''), '```$', '')) as reply from r""")
def strip_fence(t: Tables) -> DataFrame:
    k, nl = F.col("turn") % 3, F.lit("\n")
    reply = F.when(k == 0, F.concat(F.lit("```xml"), nl, "text", nl, F.lit("```"))).when(k == 1, F.concat(F.lit("  ```"), "text", F.lit("```  "))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", T.strip_fence(reply).alias("reply"))


_NAME = "case doc_id % 5 when 4 then 'x' || doc_id || '_p' when 3 then 'page1_p_q_m_last.xml' else 'page' || doc_id || '_' || lang || '_prov_' || source || case when doc_id % 2 = 0 then '_big' else '' end || '_' || doc_id % 4 || '.xml' end"


@Q.add(f"""with n as (select doc_id, {_NAME} as name from documents), p as (select *, string_split(regexp_replace(name, '\\.xml$', ''), '_') as a from n),
r as (select *, case when len(a) < 5 then 'too few parts' when not starts_with(a[1], 'page') then 'no page' when not regexp_full_match(a[-1], '[0-9]+') then 'no run number' end as reason from p)
select doc_id, case when reason is null then a[1] end as page, case when reason is null then a[2] end as prompt, case when reason is null then a[3] end as provider,
case when reason is null then array_to_string(a[4:len(a) - 1], '_') end as model, case when reason is null then cast(a[-1] as int) end as run, reason from r""")
def parse_run_name(t: Tables) -> DataFrame:
    d, k = F.col("doc_id"), F.col("doc_id") % 5
    composed = F.concat(T.run_name(F.concat(F.lit("page"), d.cast("string")), F.col("lang"), F.concat(F.lit("prov_"), "source", F.when(d % 2 == 0, "_big").otherwise("")), d % 4), F.lit(".xml"))
    name = F.when(k == 4, F.concat(F.lit("x"), d.cast("string"), F.lit("_p"))).when(k == 3, "page1_p_q_m_last.xml").otherwise(composed)
    return t.documents.select("doc_id", T.parse_run_name(name).alias("r")).select("doc_id", "r.*")


@Q.add("""with n as (select doc_id, case when doc_id % 6 = 5 then 'other' else 'page' || doc_id || '_column' || doc_id % 2 + 1 || '_chunk' || doc_id % 4 || '_' || lang || '_' || source || '.xml' end as name from documents),
m as (select *, '^page([0-9]+)_column([0-9]+)_chunk([0-9]+)_(.+?)(?:\\.xml)?$' as p from n)
select doc_id, cast(nullif(regexp_extract(name, '^page([0-9]+)_column([0-9]+)_chunk([0-9]+)_(.+?)(?:\\.xml)?$', 1), '') as int) as page, cast(nullif(regexp_extract(name, '^page([0-9]+)_column([0-9]+)_chunk([0-9]+)_(.+?)(?:\\.xml)?$', 2), '') as int) as "column",
cast(nullif(regexp_extract(name, '^page([0-9]+)_column([0-9]+)_chunk([0-9]+)_(.+?)(?:\\.xml)?$', 3), '') as int) as chunk, nullif(regexp_extract(name, '^page([0-9]+)_column([0-9]+)_chunk([0-9]+)_(.+?)(?:\\.xml)?$', 4), '') as variant from m""")
def chunk_key(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    name = F.when(d % 6 == 5, "other").otherwise(F.concat(F.lit("page"), d.cast("string"), F.lit("_column"), (d % 2 + 1).cast("string"), F.lit("_chunk"), (d % 4).cast("string"), F.lit("_"), "lang", F.lit("_"), "source", F.lit(".xml")))
    return t.documents.select("doc_id", T.chunk_key(name).alias("k")).select("doc_id", "k.*")


@Q.add("select doc_id, greatest(1, length(text) // 4) as tokens from documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@Q.add("select conv_id, turn, replace(replace('Sõna {word}: {chunks} ({word})', '{word}', role), '{chunks}', text) as prompt, regexp_matches(replace(replace('Sõna {word}: {chunks} ({word})', '{word}', role), '{chunks}', text), '\\{[a-z_]+\\}') as unfilled from conversations")
def render_prompt(t: Tables) -> DataFrame:
    prompt = T.render_prompt(F.lit("Sõna {word}: {chunks} ({word})"), {"word": F.col("role"), "chunks": F.col("text")})
    return t.conversations.select("conv_id", "turn", prompt.alias("prompt")).withColumn("unfilled", T.unfilled(F.col("prompt")))


@Q.add("""with v as (select c_custkey, [c_name, upper(c_name[1]) || lower(c_name[2:]), lower(c_name)] as a from (select c_custkey, case when c_custkey % 2 = 0 then c_name else lower(c_name) end as c_name from customer)),
x as (select c_custkey, unnest(range(0, 3)) as i, unnest(a) as variant from v)
select c_custkey, variant, cast(row_number() over (partition by c_custkey order by min(i)) as int) as pos from x group by 1, 2""")
def case_variants(t: Tables) -> DataFrame:
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.lower("c_name"))
    return t.customer.select("c_custkey", F.posexplode(T.case_variants(name)).alias("pos", "variant")).select("c_custkey", "variant", (F.col("pos") + 1).alias("pos"))


@Q.add("select doc_id, replace(text, chr(10), ' ') as flat from documents")
def flatten_newlines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.flatten_newlines(F.col("text")).alias("flat"))


@Q.add(f"""with {S.ENTRIES}, h as (select page, seq, replace(lower({S.tokens("line")}[1]), ' ', '_') as id from lines where len({S.tokens("line")}) > 0)
select page, seq, case when count(*) over (partition by page, id) > 1 then id || '_' || row_number() over (partition by page, id order by seq) else id end as xml_id from h""")
def entry_ids(t: Tables) -> DataFrame:
    heads = dictionary.page_lines(t.documents).withColumn("headword", F.try_element_at(T.tokens(F.col("line")), F.lit(1))).filter("headword is not null")
    return dictionary.entry_ids(heads, "page", "seq", "headword").select("page", "seq", "xml_id")


@Q.add(f"""with {S.ENTRIES}, s as (select page, seq, unnest(range(1, len(a) + 1)) as sense_no, unnest(a) as sense from (select page, seq, list_filter(list_transform(string_split(replace(line, '. ', '; '), ';'), lambda x: trim(x, ' ')), lambda x: x <> '') as a from lines))
select page, seq, 'e' || page || '.' || seq || '.s' || sense_no as sense_id, sense_no, unnest(range(1, len(b) + 1)) as equivalent_no, unnest(b) as equivalent from (select *, list_filter(list_transform(string_split(sense, ','), lambda x: trim(x, ' ')), lambda x: x <> '') as b from s)""")
def split_senses(t: Tables) -> DataFrame:
    e = dictionary.page_lines(t.documents).withColumn("body", F.replace("line", F.lit(". "), F.lit("; ")))
    e = e.withColumn("id", F.concat(F.lit("e"), F.col("page").cast("string"), F.lit("."), F.col("seq").cast("string")))
    return dictionary.split_senses(e, "id", "body").select("page", "seq", "sense_id", F.col("sense_no").cast("long").alias("sense_no"), F.col("equivalent_no").cast("long").alias("equivalent_no"), "equivalent")


@Q.add(f"""with {S.ENTRIES}, f as (select page, seq, case when seq % 3 = 1 then '— ' || {S.tokens("line")}[-1] else {S.tokens("line")}[1] end as form from lines where len({S.tokens("line")}) > 0)
select page, seq, case when starts_with(form, '—') then last_value(case when not starts_with(form, '—') then form end ignore nulls) over (partition by page order by seq rows unbounded preceding) || ' ' || trim(substr(form, 2)) else form end as form from f""")
def ditto_expand(t: Tables) -> DataFrame:
    words = T.tokens(F.col("line"))
    form = F.when(F.col("seq") % 3 == 1, F.concat(F.lit("— "), F.element_at(words, -1))).otherwise(F.element_at(words, 1))
    f = dictionary.page_lines(t.documents).filter(F.size(words) > 0).withColumn("form", form)
    return dictionary.ditto_expand(f, "page", "seq", "form").select("page", "seq", "form")


@Q.add("""with u as (select doc_id, case doc_id % 6 when 0 then 'r.' when 1 then 'd.' when 2 then 'P.' when 3 then 'H.' when 4 then 'R.' end as abbreviation from documents)
select doc_id, abbreviation, case abbreviation when 'r.' then 'reval' when 'd.' then 'dorpat' when 'P.' then 'pärnu' when 'H.' then 'harjumaa' end as code from u""")
def label_codes(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 6
    u = t.documents.select("doc_id", F.when(k == 0, "r.").when(k == 1, "d.").when(k == 2, "P.").when(k == 3, "H.").when(k == 4, "R.").alias("abbreviation"))
    return dictionary.label_codes(u, "abbreviation")


@Q.add("""with p as (select doc_id, text, length(text) as n, unnest(range(0, 4)) as i from documents),
q as (select *, n / cast(4 as double) as part, cast(floor(n / cast(4 as double) * cast(0.1 as double)) as bigint) as o from p),
b as (select *, case when i = 0 then 0 else cast(floor(greatest(0, i * part - o // 2)) as bigint) end as lo, case when i = 3 then n else cast(floor(least(n, i * part + part + o - o // 2)) as bigint) end as hi from q)
select doc_id, i as chunk, lo as "from", hi as "to", substr(text, lo + 1, hi - lo) as piece from b where lo < hi""")
def overlap_chunks(t: Tables) -> DataFrame:
    return dictionary.overlap_chunks(t.documents, "text", 4, 0.1).select("doc_id", "chunk", "from", "to", "piece")


@Q.add("""with b as (select p_partkey, 600 + p_partkey % 50 as w, 900 + p_partkey % 70 as h from part), c as (select *, unnest([1, 1, 1, 1, 2, 2, 2, 2]) as "column", unnest([1, 2, 3, 4, 1, 2, 3, 4]) as chunk from b),
d as (select *, h / cast(4 as double) as part, cast(floor(h / cast(4 as double) * cast(0.1 as double)) as bigint) as o from c)
select p_partkey, "column", chunk, case when "column" = 1 then 0 else w // 2 end as x0, case when chunk = 1 then 0 else cast(floor(greatest(0, (chunk - 1) * part - o // 2)) as bigint) end as y0, case when "column" = 1 then w // 2 else w end as x1,
case when chunk = 4 then h else cast(floor(least(h, chunk * part + o - o // 2)) as bigint) end as y1 from d""")
def chunk_boxes(t: Tables) -> DataFrame:
    pages = t.part.select("p_partkey", (F.lit(600) + F.col("p_partkey") % 50).alias("width"), (F.lit(900) + F.col("p_partkey") % 70).alias("height"))
    return dictionary.chunk_boxes(pages, 4, 0.1).select("p_partkey", "column", "chunk", "x0", "y0", "x1", "y1")


QUERIES, ORACLES = Q.queries, Q.oracles
