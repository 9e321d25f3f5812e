"""Queries of reply parsing; replies are built from the documents table with every kind of defect on some rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import replies
from lexloom.plans.collection import Queries, Tables

Q = Queries()

_VERDICT = "r as (select doc_id, case doc_id % 5 when 0 then 'Kasutus: ' || lang || chr(10) || 'Põhjendus: a:b ' || source when 1 then 'kasutus: x' || chr(10) || 'Kasutus: ' || source || ' ' when 2 then 'midagi' || chr(10) || 'PÕHJENDUS: ' || lang when 3 then 'Sünonüümid: ' || lang || ', ' || source || chr(10) || 'Kasutus:' else null end as reply from documents)"


def _verdict_replies(t: Tables) -> DataFrame:
    k, nl = F.col("doc_id") % 5, F.lit("\n")
    reply = (
        F.when(k == 0, F.concat(F.lit("Kasutus: "), "lang", nl, F.lit("Põhjendus: a:b "), "source"))
        .when(k == 1, F.concat(F.lit("kasutus: x"), nl, F.lit("Kasutus: "), "source", F.lit(" ")))
        .when(k == 2, F.concat(F.lit("midagi"), nl, F.lit("PÕHJENDUS: "), "lang"))
        .when(k == 3, F.concat(F.lit("Sünonüümid: "), "lang", F.lit(", "), "source", nl, F.lit("Kasutus:")))
    )
    return t.documents.select("doc_id", reply.alias("reply"))


def _line(prefix: str, mode: str) -> str:
    test = f"starts_with(x, '{prefix}')" if mode == "exact" else f"starts_with(lower(x), '{prefix.lower()}')"
    last = f"list_filter(string_split(reply, chr(10)), lambda x: {test})[-1]"
    return f"trim(substr({last}, strpos({last}, ':') + 1))" if mode == "split" else f"trim(replace({last}, '{prefix}', ''))"


@Q.add("with " + _VERDICT + " select doc_id, mode, category, reason, synonyms from (" + " union all ".join(
    f"select doc_id, '{m}' as mode, case when reply is null then 'Viga' else coalesce(nullif({_line('Kasutus:', m)}, ''), 'Määramata') end as category, coalesce(nullif({_line('Põhjendus:', m)}, ''), 'Pole infot') as reason, coalesce({_line('Sünonüümid:', m)}, '') as synonyms from r" for m in ("exact", "split", "mixed")) + ")")
def labelled_lines(t: Tables) -> DataFrame:
    r, out = _verdict_replies(t), None
    for m in ("exact", "split", "mixed"):
        v = replies.verdict(r, "reply", m).select("doc_id", F.lit(m).alias("mode"), "category", "reason", "synonyms")
        out = v if out is None else out.unionByName(v)
    return out


_S, _E = replies.START, replies.END
_BLOCK = f"""r as (select doc_id, lang, source, 'sissejuhatus' || chr(10) || case when doc_id % 6 = 0 then '' else '{_S}' || chr(10) end || 'TÄHENDUSED: ' || case when doc_id % 7 = 0 then '' else lang || '§§§ §§§' || source || case when doc_id % 2 = 0 then '§§§kolmas' else '' end end || chr(10)
|| case when doc_id % 5 = 0 then '' else 'TÄHENDUSTE-ARV: ' || doc_id % 4 || chr(10) end || 'http://viide: ei loe' || chr(10) || 'SAGEDUSED: a-sage§§§b-harv - x' || chr(10) || 'NÄITED: s-üks|kaks§§§§§§kolm|neli' || chr(10) || 'REGISTRID: tähendus-neutraalne§§§formaalne' || chr(10)
|| 'MÄRGENDID: a-kõnekeelne, ' || lang || '§§§ei-kohaldu§§§x-' || chr(10) || case when doc_id % 3 = 0 then 'MÄRGENDITE-PÕHJENDUSED: a-sest: on§§§b' || chr(10) else '' end || 'SAGEDUSED: a-' || source || '§§§b-harv' || chr(10) || case when doc_id % 6 in (0, 1) then '' else '{_E}' || chr(10) end || 'LÕPP: jah' as reply from documents),
b as (select *, case when contains(reply, '{_S}') and contains(substr(reply, strpos(reply, '{_S}')), '{_E}') then string_split(string_split(reply, '{_S}')[2], '{_E}')[1] else reply end as block from r),
p as (select *, list_transform(list_filter(list_transform(string_split(block, chr(10)), lambda x: trim(x)), lambda x: contains(x, ':') and not starts_with(x, 'http')), lambda x: [trim(string_split(x, ':')[1]), trim(substr(x, strpos(x, ':') + 1))]) as pairs from b)"""


def _block_replies(t: Tables) -> DataFrame:
    d, nl = F.col("doc_id"), F.lit("\n")
    lit = F.lit
    reply = F.concat(
        lit("sissejuhatus\n"), F.when(d % 6 == 0, "").otherwise(_S + "\n"), lit("TÄHENDUSED: "),
        F.when(d % 7 == 0, "").otherwise(F.concat("lang", lit("§§§ §§§"), "source", F.when(d % 2 == 0, "§§§kolmas").otherwise(""))), nl,
        F.when(d % 5 == 0, "").otherwise(F.concat(lit("TÄHENDUSTE-ARV: "), (d % 4).cast("string"), nl)), lit("http://viide: ei loe\nSAGEDUSED: a-sage§§§b-harv - x\nNÄITED: s-üks|kaks§§§§§§kolm|neli\nREGISTRID: tähendus-neutraalne§§§formaalne\nMÄRGENDID: a-kõnekeelne, "),
        "lang", lit("§§§ei-kohaldu§§§x-\n"), F.when(d % 3 == 0, "MÄRGENDITE-PÕHJENDUSED: a-sest: on§§§b\n").otherwise(""), lit("SAGEDUSED: a-"), "source", lit("§§§b-harv\n"),
        F.when((d % 6).isin(0, 1), "").otherwise(_E + "\n"), lit("LÕPP: jah"),
    )
    return t.documents.select("doc_id", reply.alias("reply"))


@Q.add(f"with {_BLOCK} select doc_id, block from b")
def structured_block(t: Tables) -> DataFrame:
    return _block_replies(t).select("doc_id", replies.structured_block(F.col("reply")).alias("block"))


@Q.add(f"with {_BLOCK}, e as (select doc_id, unnest(range(0, len(pairs))) as n, unnest(pairs) as kv from p) select doc_id, kv[1] as key, arg_max(kv[2], n) as value from e group by 1, 2")
def kv_map(t: Tables) -> DataFrame:
    return replies.key_values(_block_replies(t), ["doc_id"], "reply")


def _v(key: str) -> str:
    return f"list_filter(pairs, lambda e: e[1] = '{key}')[-1][2]"


def _items(key: str, dense: bool, examples: bool) -> str:
    raw = f"coalesce(string_split({_v(key)}, '§§§'), [])"
    if dense:
        raw = f"list_filter({raw}, lambda x: trim(x) <> '')"
    cut, plain = "trim(substr(x, strpos(x, '-') + 1))", "trim(x)"
    if examples:
        cut = f"replace({cut}, '|', ' | ')"
        plain = f"replace({plain}, '|', ' | ')" if dense else plain
    return f"list_transform({raw}, lambda x: case when strpos(x, '-') > 0 then {cut} else {plain} end)"


def _senses(dense: bool) -> str:
    lists = ", ".join(f"{_items(k, dense, n == 'examples')} as l_{n}" for n, k in replies.LISTS.items())
    at = ", ".join(f"coalesce(l_{n}[i], '{replies.DEFAULTS[n]}') as {n}" for n in replies.LISTS)
    return f"""{_BLOCK}, q as (select doc_id, list_filter(list_transform(string_split(coalesce({_v('TÄHENDUSED')}, ''), '§§§'), lambda x: trim(x)), lambda x: x <> '') as s, {_v('TÄHENDUSTE-ARV')} as told, {lists} from p),
u as (select *, unnest(case when len(s) = 0 then [0] else range(1, len(s) + 1) end) as i from q),
senses as (select doc_id, cast(i as int) as sense_no, coalesce(s[i], 'ei leitud') as sense, coalesce(told, cast(len(s) as varchar)) as sense_count, try_cast(coalesce(told, cast(len(s) as varchar)) as int) as sense_count_number, {at} from u)"""


@Q.add(f"with {_senses(False)} select * from senses")
def sense_explode(t: Tables) -> DataFrame:
    return replies.senses(_block_replies(t), ["doc_id"], "reply")


@Q.add(f"with {_senses(True)} select * from senses")
def sense_explode_dense(t: Tables) -> DataFrame:
    return replies.senses(_block_replies(t), ["doc_id"], "reply", dense=True)


_BROKEN = "doc_id % 4 = 3"


@Q.add(f"with {_senses(False)} select * from senses where not ({_BROKEN}) union all select doc_id, 1, 'parsimise viga', '0', 0, " + ", ".join(f"'{replies.PARSE_ERROR[n]}'" for n in replies.LISTS) + f" from documents where {_BROKEN}")
def parse_error_rows(t: Tables) -> DataFrame:
    r = _block_replies(t)
    return replies.with_parse_errors(replies.senses(r, ["doc_id"], "reply"), r, ["doc_id"], F.expr(_BROKEN))


_LABELS = f"""{_senses(False)}, sp as (select *, case when label <> 'ei-kohaldu' then list_filter(list_transform(string_split(label, ','), lambda x: trim(x)), lambda x: x <> '') else [] end as a from senses),
labels as (select doc_id, sense_no, sense, unnest(case when len(a) = 0 then ['ei-kohaldu'] else a end) as label, case when len(a) = 0 then 'ei-kohaldu' when label_reason = 'ei-kohaldu' then 'ei leitud' else label_reason end as label_reason from sp)"""


@Q.add(f"with {_LABELS} select * from labels")
def label_explode(t: Tables) -> DataFrame:
    return replies.labels(replies.senses(_block_replies(t), ["doc_id"], "reply")).select("doc_id", "sense_no", "sense", "label", "label_reason")


@Q.add("""with r as (select doc_id, case when doc_id % 4 = 0 then 'SÕNA: ' || source || chr(10) else '' end || 'TEKSTIREGISTER: ' || lang || chr(10) || 'NÄITED: a|b' || chr(10) || case when doc_id % 3 = 0 then 'REGISTRIMÄRK: kõnek' || chr(10) || 'SAGEDUS: 1: 2' else '' end as reply, lang as w, source as m from documents),
p as (select *, list_transform(list_filter(list_transform(string_split(reply, chr(10)), lambda x: trim(x)), lambda x: contains(x, ':')), lambda x: [trim(string_split(x, ':')[1]), trim(substr(x, strpos(x, ':') + 1))]) as pairs from r)
select doc_id, coalesce(""" + _v("SÕNA") + ", w) as word, coalesce(" + _v("TÄHENDUS") + ", m) as meaning, " + ", ".join("coalesce(" + (f"replace({_v(replies.RECORD[n])}, '|', ' | ')" if n == "examples" else _v(replies.RECORD[n])) + f", '{d}') as {n}" for n, d in replies.RECORD_DEFAULTS.items()) + " from p")  # fmt: skip
def meaning_record(t: Tables) -> DataFrame:
    d, nl = F.col("doc_id"), F.lit("\n")
    reply = F.concat(F.when(d % 4 == 0, F.concat(F.lit("SÕNA: "), "source", nl)).otherwise(""), F.lit("TEKSTIREGISTER: "), "lang", F.lit("\nNÄITED: a|b\n"), F.when(d % 3 == 0, "REGISTRIMÄRK: kõnek\nSAGEDUS: 1: 2").otherwise(""))
    return replies.meaning_record(t.documents.select("doc_id", reply.alias("reply"), F.col("lang").alias("w"), F.col("source").alias("m")), ["doc_id"], "reply", "w", "m")


@Q.add("with r as (select source as word, case when doc_id % 9 = 0 or source = 'src1' then 'töötlemata' else lang end as sense from documents) select count(distinct word) as words, count(distinct case when sense <> 'töötlemata' then word end) as processed, count(distinct word) - count(distinct case when sense <> 'töötlemata' then word end) as unprocessed, count(*) as n_rows, round(cast(count(*) as double) / count(distinct word), 6) as rows_per_word from r")
def analysis_stats(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("source").alias("word"), F.when((F.col("doc_id") % 9 == 0) | (F.col("source") == "src1"), T.NOT_PROCESSED).otherwise(F.col("lang")).alias("sense"))
    return replies.analysis_stats(rows, "word", "sense")


@Q.add("select event_id, cast(0 as int) as n, try_cast(json_extract_string(props, '$.k') as bigint) as k from events where props is not null union all select event_id, cast(1 as int), event_id from events where event_id % 2 = 0 and props is not null")
def json_objects(t: Tables) -> DataFrame:
    i = F.col("event_id")
    text = F.concat(F.lit("vastus "), "props", F.when(i % 2 == 0, F.concat(F.lit(' ja {"k":\n '), i.cast("string"), F.lit("}"))).otherwise(" {katki "), F.lit(" {vigane: } lõpp"))
    return replies.json_objects(t.events.select("event_id", text.alias("x")), ["event_id"], "x", "k long").select("event_id", "n", "o.k")


@Q.add("select event_id, case when event_id % 3 < 2 then try_cast(json_extract_string(props, '$.k') as bigint) end as k from events")
def fenced_json(t: Tables) -> DataFrame:
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("siin:\n```json\n"), "props", F.lit("\n```\nvalmis"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("pole json")
    return t.events.select("event_id", replies.fenced_json(reply, "k long").alias("o")).select("event_id", "o.k")


@Q.add("select conv_id, arg_max(case when role = 'user' then text end, turn) filter (where role = 'user') as thinking, arg_max(text, turn) filter (where role = 'assistant') as answer from conversations group by 1")
def content_blocks(t: Tables) -> DataFrame:
    kind = F.when(F.col("role") == "user", "thinking").when(F.col("role") == "assistant", "text").otherwise("other")
    b = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", kind.alias("type"), "text"))).alias("blocks"))
    return b.select("conv_id", replies.last_block(F.col("blocks"), "thinking").alias("thinking"), replies.last_block(F.col("blocks"), "text").alias("answer"))


@Q.add("with r as (select doc_id, lang || '; a' || doc_id || ' ;b;' || case when doc_id % 2 = 0 then 'c; selgitus; jätk' else '' end as line from documents), p as (select doc_id, string_split(line, ';') as p from r) select doc_id, trim(p[1]) as modern, trim(p[2]) as form_1, trim(p[3]) as form_2, trim(p[4]) as form_3, case when len(p) >= 5 then trim(array_to_string(p[5:], ';')) end as explanation from p")
def semicolon_answer(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    line = F.concat("lang", F.lit("; a"), d.cast("string"), F.lit(" ;b;"), F.when(d % 2 == 0, "c; selgitus; jätk").otherwise(""))
    return t.documents.select("doc_id", replies.semicolon_answer(line).alias("a")).select("doc_id", "a.*")


@Q.add("""select doc_id, case doc_id % 4 when 0 then lang when 1 then source end as word, case when doc_id % 4 = 0 then 'v' || source end as form, case when doc_id % 4 = 2 then lang end as old_form, case when doc_id % 4 = 2 then 'Autor' end as author,
case when doc_id % 4 = 2 then cast(doc_id as int) end as page, case when doc_id % 4 = 2 then 7 end as "row", case when doc_id % 4 = 3 then 'no match' end as reason from documents""")
def link_sentence(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    line = (
        F.when(d % 4 == 0, F.concat(d.cast("string"), F.lit('. **Sõna "'), "lang", F.lit('"** esineb sõnaraamatus kujul "v'), "source", F.lit('".')))
        .when(d % 4 == 1, F.concat(F.lit('- "'), "source", F.lit('" esineb sõnaraamatus kui "Ei leitud"')))
        .when(d % 4 == 2, F.concat(F.lit("vaste /"), "lang", F.lit("/. Allikas: Autor, "), d.cast("string"), F.lit(", 7")))
        .otherwise("muu rida")
    )
    return t.documents.select("doc_id", replies.link_sentence(line).alias("l")).select("doc_id", "l.*")


QUERIES, ORACLES = Q.queries, Q.oracles
