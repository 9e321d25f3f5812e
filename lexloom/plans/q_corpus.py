"""Queries of corpus search, frequency, verification, retrieval and run planning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import corpus, index, retrieval, runs, verification
from lexloom.plans import fragments as S
from lexloom.plans.collection import Queries, Tables
from lexloom.sources.scratch import scratch_folder, written

Q = Queries()


def _tokens(t: Tables) -> DataFrame:
    return corpus.token_rows(t.documents, ["doc_id", "source", "lang"])


def _counts(t: Tables) -> DataFrame:
    """Token counts by source: the texts are read once for all that is counted."""
    return written(corpus.token_counts(t.documents, ["source"]), "token-counts")


def _keywords(t: Tables) -> DataFrame:
    return written(corpus.frequent_words(_tokens(t)), "keywords")


def _hits(t: Tables) -> DataFrame:
    return corpus.concordance(t.documents, _keywords(t))


_HITS = f"""{S.TOKENS}, {S.KEYWORDS},
hits as (select h.doc_id, h.pos, h."at", k.word, trim(array_to_string(list_filter([array_to_string(s[greatest(1, pos - 2):pos], ' '), array_to_string(t[1:at], ' ')], lambda x: x is not null), ' ')) as left_context, h.token as keyword,
trim(array_to_string([array_to_string(t["at" + 2:], ' '), array_to_string(s[pos + 2:pos + 4], ' ')], ' ')) as right_context
from (select doc_id, pos, s, t, unnest(range(0, len(t))) as at, unnest(t) as token from (select doc_id, pos, s, {S.tokens('sent')} as t from sents)) h join keywords k on lower(h.token) = k.word)"""
_HITS = _HITS.replace("s[greatest(1, pos - 2):pos]", "case when pos = 0 then [] else s[greatest(1, pos - 2):pos] end").replace('t[1:at]', 'case when "at" = 0 then [] else t[1:"at"] end')


@Q.add(f"with {_HITS} select * from hits")
def concordance(t: Tables) -> DataFrame:
    return _hits(t)


@Q.add(f"""with {_HITS} select doc_id, pos, "at", word, row_number() over (partition by word order by doc_id, pos, "at") as id, trim(left_context || ' ' || keyword || ' ' || right_context) as full_context from hits""")
def kwic_flat(t: Tables) -> DataFrame:
    h = corpus.numbered(_hits(t), "word", ["doc_id", "pos", "at"])
    return h.select("doc_id", "pos", "at", "word", F.col("id").cast("long").alias("id"), corpus.full_context().alias("full_context"))


@Q.add(f"with {_HITS} select word, count(*) as n, count(distinct trim(left_context || ' ' || keyword || ' ' || right_context)) as contexts, cast(sum(length(trim(left_context || ' ' || keyword || ' ' || right_context))) as bigint) as chars from hits group by 1")
def full_context(t: Tables) -> DataFrame:
    h = _hits(t).select("word", corpus.full_context().alias("c"))
    return h.groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("c").alias("contexts"), F.sum(F.length("c")).alias("chars"))


def _index(t: Tables) -> str:
    """An index written for some documents and extended by the others."""
    folder = scratch_folder(t.spark, "index")
    index.extend(t.documents.filter("doc_id % 2 = 0"), folder, keep=["source"])
    index.extend(t.documents, folder, keep=["source"])
    return folder


@Q.add(f"with {_HITS} select * from hits")
def indexed_concordance(t: Tables) -> DataFrame:
    folder = _index(t)
    words = corpus.frequent_words(index.counts(t.spark, folder))
    return index.concordance(t.documents, index.hits(t.spark, folder, words))


_WANTED = "wanted as (select word from keywords union all select 'zzmissing' || i from range(3) t(i))"


def _wanted(t: Tables, keywords: DataFrame) -> DataFrame:
    return keywords.unionByName(t.spark.range(3).select(F.concat(F.lit("zzmissing"), F.col("id").cast("string")).alias("word")))


def _hit_counts(t: Tables) -> DataFrame:
    long = corpus.token_rows(t.documents, []).filter(F.length("lc") >= 5)  # no shorter word is asked for
    counts = written(long.groupBy("lc").agg(F.count("*").alias("n")), "hit-counts")
    return corpus.hits_per_word(_wanted(t, corpus.frequent_words(counts)), counts.select(F.col("lc").alias("word"), "n"))


@Q.add(f"with {S.TOKENS}, {S.KEYWORDS}, {_WANTED}, c as (select lc, count(*) as n from lower_toks group by 1) select word, coalesce(n, 0) as hits, n is null as failed from wanted left join c on c.lc = word")
def hits_per_word(t: Tables) -> DataFrame:
    return _hit_counts(t)


@Q.add(f"""with {S.TOKENS}, {S.KEYWORDS}, {_WANTED}, c as (select lc, count(*) as n from lower_toks group by 1), p as (select word, coalesce(n, 0) as hits, n is null as failed from wanted left join c on c.lc = word)
select count(*) as words, count(*) filter (where not failed) as found, count(*) filter (where failed) as not_found, cast(sum(hits) as bigint) as hits, string_agg(word, '|' order by word) filter (where not failed) as found_words, string_agg(word, '|' order by word) filter (where failed) as failed_words from p""")
def hits_summary(t: Tables) -> DataFrame:
    return corpus.hits_total(_hit_counts(t))


@Q.add(f"with {S.TOKENS}, {S.KEYWORDS}, {_WANTED}, c as (select source, lc, count(*) as n from lower_toks group by 1, 2), size as (select source, count(*) as total from lower_toks group by 1) select word, source, n, round(n * cast(1000000 as double) / total, 6) as relative from wanted join c on lc = word join size using (source)")
def indexed_counts(t: Tables) -> DataFrame:
    folder = _index(t)
    words = _wanted(t, corpus.frequent_words(index.counts(t.spark, folder)))
    size = t.spark.read.parquet(f"{folder}/documents").groupBy("source").agg(F.sum("tokens").alias("total"))
    n = index.hits(t.spark, folder, words).groupBy("word", "source").agg(F.count("*").alias("n"))
    return n.join(size, "source").select("word", "source", "n", F.round(F.col("n") * 1e6 / F.col("total"), 6).alias("relative"))


def _ranked_sql(n: int) -> str:
    return f'with {S.TOKENS}, {S.KEYWORDS} select * from (select word, doc_id, pos, "at", row_number() over (partition by word order by doc_id, pos, "at") as id from lower_toks join keywords on lc = word) where id <= {n}'


def _ranked(t: Tables, n: int) -> DataFrame:
    hits = _tokens(t).join(_keywords(t), F.col("lc") == F.col("word")).select("word", "doc_id", "pos", "at")
    return corpus.capped(hits, "word", ["doc_id", "pos", "at"], n).withColumn("id", F.col("id").cast("long"))


@Q.add(_ranked_sql(300_000))
def capped_hits(t: Tables) -> DataFrame:
    return _ranked(t, 300_000)


@Q.add(_ranked_sql(3))
def sample_hits(t: Tables) -> DataFrame:
    return _ranked(t, 3)


@Q.add(f"with {S.TOKENS}, {S.KEYWORDS}, {_WANTED}, c as (select lc, count(*) as n from lower_toks group by 1), n as (select count(*) as total from lower_toks) select word, coalesce(n, 0) as absolute, round(coalesce(n, 0) * cast(1000000 as double) / total, 6) as relative from n, wanted left join c on c.lc = word")
def word_frequency(t: Tables) -> DataFrame:
    counts = _counts(t)
    return corpus.word_frequency(counts, _wanted(t, corpus.frequent_words(counts))).withColumn("relative", F.round("relative", 6))


_DENSITY = f"""{S.TOKENS}, {S.KEYWORDS}, g as (select *, case when source = 'src0' then 'unknown' else source end as genre from lower_toks), size as (select genre, count(*) as n_genre from g group by 1),
by_genre as (select word, genre, count(*) as abs from g join keywords on lc = word group by 1, 2), whole as (select word, sum(abs) as n_word from by_genre group by 1),
density as (select word, genre, abs, round(cast(100 as double) * (cast(abs as double) / n_word) / (cast(n_genre as double) / (select sum(n_genre) from size)), 6) as rel from by_genre join whole using (word) join size using (genre))"""


def _density(t: Tables) -> DataFrame:
    counts = _counts(t).withColumn("g", F.when(F.col("source") != "src0", F.col("source")))
    return corpus.genre_density(counts, corpus.frequent_words(counts), "g").withColumn("rel", F.round("rel", 6))


@Q.add(f"with {_DENSITY} select word, genre, abs, rel from density")
def genre_density(t: Tables) -> DataFrame:
    return _density(t)


@Q.add(f"with {_DENSITY} select word, " + ", ".join(f"max(case when genre = '{g}' then abs end) as {g}_abs, max(case when genre = '{g}' then rel end) as {g}_rel" for g in ("unknown", "src1", "src2", "src3")) + " from density group by 1")
def genre_pivot(t: Tables) -> DataFrame:
    return corpus.genre_pivot(_density(t), ["unknown", "src1", "src2", "src3"])


@Q.add("select doc_id, case when doc_id % 3 = 0 then 'unknown' when doc_id % 3 = 1 then 'tundmatu' else source end as genre from documents")
def genre_label(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    labels = F.when(k == 0, F.array().cast("array<struct<name:string>>")).otherwise(F.array(F.struct(F.when(k == 2, F.col("source")).alias("name"))))
    return t.documents.select("doc_id", corpus.genre_label(labels).alias("genre"))


# --- quoted sentences: benchmark items are sheets of claims, documents of one source are a keyword's contexts

_CLAIMS = """claims as (select item_id % 3 as sheet, item_id as row_no, case when item_id % 4 = 0 then 'src' || (item_id // 4) % 25 end as keyword, array_to_string(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1|', 'g'), '|'), '|') as content from benchmark),
filled as (select sheet, row_no, last_value(keyword ignore nulls) over (partition by sheet order by row_no rows unbounded preceding) as keyword, content from claims)"""


def _claims(t: Tables) -> DataFrame:
    content = F.regexp_replace("text", r"([.!?])\s+", "$1|")
    keyword = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("src"), (F.floor(F.col("item_id") / 4) % 25).cast("string")))
    return t.benchmark.select((F.col("item_id") % 3).alias("sheet"), F.col("item_id").alias("row_no"), keyword.alias("keyword"), content.alias("content"))


def _filled(t: Tables) -> DataFrame:
    return verification.forward_fill(_claims(t), "sheet", "row_no", "keyword")


@Q.add(f"with {_CLAIMS} select * from filled")
def forward_fill(t: Tables) -> DataFrame:
    return _filled(t)


_CTX = "replace(replace(replace(text, ' ,', ','), ''' ', ''''), ' .', '.')"
_VERIFIED = f"""{_CLAIMS}, cs as (select sheet, row_no, keyword, unnest(range(0, len(a))) as pos, unnest(a) as sentence from (select *, list_filter(list_transform(string_split(content, '|'), lambda x: trim(x)), lambda x: x <> '') as a from filled)),
ctx as (select source as keyword, lower({S.squeezed(_CTX)}) as t from documents), v as (select *, {S.norm_sentence('sentence')} as norm from cs),
verified as (select sheet, row_no, keyword, pos, sentence, case when keyword is null or keyword not in (select keyword from ctx) then 'FILE_NOT_FOUND' when norm <> '' and exists (select 1 from ctx where ctx.keyword = v.keyword and contains(ctx.t, v.norm)) then 'FOUND' else 'NOT_FOUND' end as status from v)"""


def _verified(t: Tables) -> DataFrame:
    contexts = t.documents.select(F.col("source").alias("keyword"), F.col("text").alias("context"))
    return verification.verify(verification.claim_sentences(_filled(t)), contexts, "keyword").select("sheet", "row_no", "keyword", "pos", "sentence", "status")


@Q.add(f"with {_VERIFIED} select * from verified")
def verify_sentences(t: Tables) -> DataFrame:
    return _verified(t)


@Q.add(f"""with s as (select distinct trim(unnest(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1|', 'g'), '|'))) as sentence from benchmark), v as (select sentence, {S.norm_sentence('sentence')} as norm from s where sentence <> ''),
ctx as (select doc_id, lower({S.squeezed(_CTX)}) as t from documents), f as (select norm, min(doc_id) as doc from (select distinct norm from v where norm <> '') n join ctx on contains(t, norm) group by 1)
select sentence, doc, case when doc is null then 'NOT_FOUND' else 'FOUND' end as status from v left join f using (norm)""")
def verify_anywhere(t: Tables) -> DataFrame:
    s = verification.claim_sentences(_claims(t)).select("sentence").distinct()
    return verification.verify_anywhere(s, t.documents, "doc_id").select("sentence", "doc", "status")


_RESULTS = f"""{_VERIFIED}, results as (select sheet, row_no, coalesce(string_agg(sentence, ' | ' order by pos) filter (where status = 'FOUND'), '') as found, coalesce(string_agg(sentence, ' | ' order by pos) filter (where status <> 'FOUND'), '') as not_found,
count(*) filter (where status = 'FOUND') as n_found, count(*) filter (where status <> 'FOUND') as n_not_found from verified group by 1, 2)"""


def _results(t: Tables) -> DataFrame:
    return verification.results_by_row(_verified(t), ["sheet", "row_no"])


@Q.add(f"with {_RESULTS} select * from results")
def sentence_results(t: Tables) -> DataFrame:
    return _results(t)


@Q.add(f"with {_RESULTS} select * from results where n_found > 0")
def rows_with_found(t: Tables) -> DataFrame:
    return verification.rows_with_found(_results(t))


@Q.add(f"""with {_RESULTS}, r as (select case when grouping(sheet) = 1 then 'TOTAL' else cast(sheet as varchar) end as sheet, count(*) as n_rows, cast(sum(n_found + n_not_found) as bigint) as n_sentences, cast(sum(n_found) as bigint) as n_found, cast(sum(n_not_found) as bigint) as n_not_found from results group by rollup(sheet))
select *, round(case when n_sentences = 0 then 0 else n_found * cast(100 as double) / n_sentences end, 2) as found_percent, round(case when n_sentences = 0 then 0 else n_not_found * cast(100 as double) / n_sentences end, 2) as not_found_percent from r""")
def verification_stats(t: Tables) -> DataFrame:
    return verification.statistics(_results(t).withColumn("sheet", F.col("sheet").cast("string")), "sheet")


# --- retrieval


@Q.add(f"with l as (select source, unnest({S.lines()}) as line from documents) select source, count(*) as n_lines, greatest(1, cast(sum(length(line)) + count(*) - 1 as bigint) // 4) as tokens, greatest(1, cast(sum(length(line)) + count(*) - 1 as bigint) // 4) < 30000 as fits from l group by 1")
def budget_gate(t: Tables) -> DataFrame:
    return retrieval.budget_gate(t.documents.select("source", F.explode(T.lines(F.col("text"))).alias("line")), "source", "line", 30_000)


_DIST = "round(list_sum(list_transform(list_zip(v, q), lambda p: (cast(p[1] as double) - cast(p[2] as double)) * (cast(p[1] as double) - cast(p[2] as double)))), 6)"


def _knn_sql(k: int, on: str, label: str) -> str:
    return f"""with q as (select vec_id as query_id, embedding as q, label from embeddings where vec_id % 100 = 0), d as (select {label}query_id, vec_id as chunk_id, {_DIST} as distance from q join (select vec_id, embedding as v, label from embeddings) c on {on})
select * from (select *, row_number() over (partition by query_id order by distance, chunk_id) as rank from d) where rank <= {k}"""


def _vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.embeddings
    return e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label"), e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), "label")


@Q.add(_knn_sql(10, "true", ""))
def knn_l2_topk(t: Tables) -> DataFrame:
    q, c = _vectors(t)
    return retrieval.nearest(q.drop("label"), c.drop("label"), 10).withColumn("rank", F.col("rank").cast("long"))


@Q.add(_knn_sql(10, "q.label = c.label", "q.label, "))
def knn_within_group(t: Tables) -> DataFrame:
    q, c = _vectors(t)
    return retrieval.nearest(q, c, 10, ["label"]).withColumn("rank", F.col("rank").cast("long"))


@Q.add(f"select doc_id, array_to_string({S.lines()}, chr(10)) as full_text, array_to_string(list_reverse({S.lines()}), chr(10) || '---' || chr(10)) as retrieved from documents where len({S.lines()}) > 0")
def assemble_context(t: Tables) -> DataFrame:
    parts = t.documents.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("n", "line")).withColumn("back", -F.col("n"))
    full = retrieval.assemble(parts, "doc_id", "n", "line", False).withColumnRenamed("context", "full_text")
    return full.join(retrieval.assemble(parts, "doc_id", "back", "line", True).withColumnRenamed("context", "retrieved"), "doc_id")


@Q.add("select vec_id from embeddings where label % 2 = 1")
def missing_embeddings(t: Tables) -> DataFrame:
    e = t.embeddings
    return retrieval.missing_embeddings(e, e.filter("label % 2 = 0"), "vec_id").select("vec_id")


@Q.add(f"""with {S.TOKENS}, {S.KEYWORDS}, {_WANTED}, c as (select lc as word, min(doc_id) as d from lower_toks group by 1) select word, coalesce(cast(d as varchar), '') as context, case when d is null then 1 end as sense_no, case when d is null then 'töötlemata' end as sense, case when d is null then 0 end as sense_count, case when d is null then 'kontekstifail puudub' end as frequency, case when d is null then 'ei saadaval' end as examples, case when d is null then 'ei määratletud' end as register,
case when d is null then 'ei saadaval' end as register_reason, case when d is null then 'ei saadaval' end as training_reason, case when d is null then 'ei kohaldu' end as label, case when d is null then 'ei saadaval' end as label_reason from wanted left join c using (word)""")
def missing_context_rows(t: Tables) -> DataFrame:
    contexts = _tokens(t).groupBy(F.col("lc").alias("word")).agg(F.min("doc_id").cast("string").alias("context"))
    return retrieval.with_missing_rows(_wanted(t, _keywords(t)), contexts)


# --- runs

_JOBS = "jobs as (select 'page' || page_id as page, prompt, model, repeat, 'page' || page_id || '_' || prompt || '_' || model || '_' || repeat || '.xml' as name from pages, (select unnest(['p1', 'p2']) as prompt), (select n_name as model from nation), (select unnest(range(1, 4)) as repeat))"


def _jobs(t: Tables) -> DataFrame:
    prompts = t.spark.createDataFrame([("p1",), ("p2",)], "prompt string")
    return runs.job_matrix(t.pages.select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("page")), prompts, t.nation.select(F.col("n_name").alias("model")), 3).withColumn("repeat", F.col("repeat").cast("long"))


@Q.add(f"with {_JOBS} select * from jobs")
def job_matrix(t: Tables) -> DataFrame:
    return _jobs(t)


@Q.add("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)")
def pending_jobs(t: Tables) -> DataFrame:
    return runs.pending(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@Q.add("select c_mktsegment, count(*) as total, count(*) filter (where c_custkey in (select o_custkey from orders)) as done, count(*) filter (where c_custkey not in (select o_custkey from orders where o_custkey is not null)) as pending from customer group by 1")
def run_progress(t: Tables) -> DataFrame:
    return runs.progress(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], ["c_mktsegment"])


_RUNS = "r as (select distinct l_orderkey as job, cast(l_linenumber as bigint) as run from lineitem where l_quantity > 10)"


@Q.add(f"with {_RUNS}, n as (select job, run, row_number() over (partition by job order by run) as n from r) select job, coalesce(min(case when run <> n then n end), max(n) + 1) as next from n group by 1")
def next_run_number(t: Tables) -> DataFrame:
    r = t.lineitem.filter("l_quantity > 10").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").cast("long").alias("run"))
    return runs.next_run_number(r, ["job"])


@Q.add("select 'out_' || event_id || '.xml' as output_name, cast(user_id as varchar) as image, 'p' || user_id % 3 as prompt, event_type as model, 'v' || event_id % 2 as variant, cast(event_id % 5 as int) as repeat, event_id * 3 as input_tokens, event_id * 2 as output_tokens, value as cost from events")
def usage_rows(t: Tables) -> DataFrame:
    e, i, u = t.events, F.col("event_id"), F.col("user_id")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    rows = e.select(F.concat(text("out_", i), F.lit(".xml")).alias("output_name"), u.alias("image"), text("p", u % 3).alias("prompt"), F.col("event_type").alias("model"), text("v", i % 2).alias("variant"), (i % 5).alias("repeat"), (i * 3).alias("input_tokens"), (i * 2).alias("output_tokens"), F.col("value").alias("cost"), "props")
    return runs.ledger(rows)


@Q.add("select event_type, count(*) as attempts, count(*) filter (where value >= 20 and event_id % 10 <> 0) as succeeded, count(*) filter (where event_id % 10 = 0) as errors, count(*) filter (where value < 20 and event_id % 10 <> 0) as failed from events group by 1")
def run_summary(t: Tables) -> DataFrame:
    return runs.run_summary(t.events, ["event_type"], F.col("value") >= 20, F.col("event_id") % 10 == 0)


@Q.add("select event_type as model, 'p' || user_id % 3 as prompt, count(*) as runs, round(sum(value), 4) as cost, grouping_id(event_type, 'p' || user_id % 3) as level from events group by rollup(event_type, 'p' || user_id % 3)")
def cost_rollup(t: Tables) -> DataFrame:
    e = t.events.select(F.col("event_type").alias("model"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("prompt"), F.col("value").alias("cost"))
    return runs.cost_rollup(e, ["model", "prompt"]).withColumn("cost", F.round("cost", 4))


QUERIES, ORACLES = Q.queries, Q.oracles
