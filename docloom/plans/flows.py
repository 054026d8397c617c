"""More queries of the catalogue: texts and states, streams, runs and budgets, upkeep, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import dates
from docloom.functions import status as st
from docloom.functions import text as tx
from docloom.operators import access, analytics, checks, chunks, consolidate, graph, legal, search, upkeep, versions
from docloom.plans.catalog import _GAP, ORACLES, QUERIES, c, query, table
from docloom.plans.reading import _SECTIONS, links_of, sections_of, units_of
from docloom.session import spread
from docloom.streaming import events as ev

__all__ = ["ORACLES", "QUERIES"]

# ---- texts: parts name what they say


def part_of(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "part")).withColumn("k", c("p_partkey").cast("string"))


def said(*parts) -> F.Column:
    return F.concat(*(p if isinstance(p, F.Column) else F.lit(p) for p in parts))


@query("select p_partkey, (p_partkey % 9999 + 1) || '/2023/ND-CP' || case when p_partkey % 2 = 0 then ',' || (p_partkey % 9999 + 2) || '/QD-BCA' else '' end as numbers from part")
def doc_numbers_fold(spark, sf):
    text = said("Theo Nghị định số ", (c("p_partkey") % 9999 + 1).cast("string"), " / 2023/NĐ–CP ngày 1/2/2023", F.when(c("p_partkey") % 2 == 0, said(" và ", (c("p_partkey") % 9999 + 2).cast("string"), "/QĐ-BCA")).otherwise(""), ".")
    return part_of(spark, sf).select("p_partkey", F.array_join(tx.doc_numbers(text), ",").alias("numbers"))


@query("select p_partkey, lower(p_name) || '|' || lower(p_type) as phrases from part")
def quoted_phrases(spark, sf):
    return part_of(spark, sf).select("p_partkey", F.array_join(tx.quoted_phrases(said('tìm "', c("p_name"), '" hay «', c("p_type"), "» và x")), "|").alias("phrases"))


@query("select p_partkey, 'phong_chay_chua_chay ' || array_to_string(list_filter(list_distinct_in_order, lambda x: x <> ''), ' ') as terms from (select p_partkey, list_filter(string_split(p_name, ' '), lambda x, i: list_position(string_split(p_name, ' '), x) = i) as list_distinct_in_order from part)")
def keyword_terms(spark, sf):
    number = (c("p_partkey") % 9999 + 1).cast("string")
    return part_of(spark, sf).select("p_partkey", F.array_join(tx.keyword_terms(said("Phòng cháy chữa cháy của ", c("p_name"), " theo ", number, "/2023/NĐ-CP là gì?")), " ").alias("terms"))


@query("select p_partkey, lower(p_name) || ',' || lower(p_type) as rows from part")
def table_row_identities(spark, sf):
    text = said("# x\n\n| Name | N |\n|---|:--:|\n| **", c("p_name"), "** | 1 |\n|  | `", c("p_type"), "` |\n\nend | of")
    return part_of(spark, sf).select("p_partkey", F.array_join(tx.row_identities(text), ",").alias("rows"))


@query("select p_partkey, p_name || ' and part and [[other|o]]' as body from part")
def scrub_links(spark, sf):
    return part_of(spark, sf).select("p_partkey", tx.drop_wikilinks(said("[[a/part|", c("p_name"), "]] and [[a/part]] and [[other|o]]"), "a/part").alias("body"))


@query("select p_partkey, p_name || ' is ' || p_type || ' now' as bare, '# CHƯƠNG I' || chr(10) || '## Mục 2. ' || p_name || chr(10) || '### Điều ' || p_partkey || '. ' || p_type || chr(10) || 'khác' as marked from part")
def markup_and_headings(spark, sf):
    text = said("## **", c("p_name"), "** is <i>", c("p_type"), "</i><sup>1</sup> _now_")
    lines = said("CHƯƠNG I\nMục 2. ", c("p_name"), "\nĐiều ", c("k"), ". ", c("p_type"), "\nkhác")
    return part_of(spark, sf).select("p_partkey", tx.strip_markup(text).alias("bare"), tx.mark_headings(lines).alias("marked"))


@query("select p_partkey, case p_partkey % 4 when 3 then null else p_partkey end as k from part")
def loose_json(spark, sf):
    body = said('{"k": ', c("k"), "}")
    m = c("p_partkey") % 4
    answer = F.when(m == 0, said("```json\n", body, "\n```")).when(m == 1, body).when(m == 2, said(body, " and then")).otherwise("no answer")
    return part_of(spark, sf).select("p_partkey", F.try_variant_get(tx.loose_json(answer), "$.k", "long").alias("k"))


@query("select p_partkey, 'n1=' || p_name || ';b=' || p_type as notes, 'x [^n1]' || chr(10) || '[^n1]: ' || p_name || chr(10) || '[^b]: ' || p_type || chr(10) || chr(10) || '[^s1]: new ' || p_partkey || chr(10) as body from part")
def footnote_citations(spark, sf):
    text = said("x [^n1]\n[^n1]: ", c("p_name"), " \n[^b]: ", c("p_type"))
    note = lambda i, t: F.struct(F.lit(i).cast("string").alias("id"), t.cast("string").alias("text"))
    notes = F.array(note("n1", F.lit("old")), note(None, said(" new ", c("k"))), note("z", F.lit("")))
    listed = F.array_join(F.transform(tx.footnotes(text), lambda x: F.concat_ws("=", x["id"], x["text"])), ";")
    return part_of(spark, sf).select("p_partkey", listed.alias("notes"), F.replace(tx.with_footnotes(text, notes), F.lit(" \n"), F.lit("\n")).alias("body"))


@query(r"""select doc_id, md5(case when length(text) > 500 then substring(text, 1, 499) || '…' else text end) as clipped, case when length(text) <= 8 then '***' else substring(text, 1, 4) || '…' || right(text, 2) end as shown, md5(regexp_replace(text, '(?i)(license|creative)', '**\1**', 'g')) as marked from documents where text is not null""")
def clip_redact_highlight(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(tx.clip(c("text"))).alias("clipped"), tx.redact(c("text")).alias("shown"), F.md5(tx.highlight(c("text"), ["creative", "license"])).alias("marked"))


@query("select p_partkey, 'a ![' || p_type || '](image://' || p_partkey || ') b ' as body from part")
def image_markers(spark, sf):
    images = F.array(F.struct(F.lit("one").alias("name"), c("k").alias("id"), c("p_type").alias("alt")))
    return part_of(spark, sf).select("p_partkey", tx.place_images(F.lit("a <!--img:one--> b <!--img:two-->"), images).alias("body"))


@query("select p_partkey, case when p_partkey % 4 = 0 then '3,5,6,7,12' when p_partkey % 4 = 1 then '' else (p_partkey % 9)::VARCHAR || ',' || (p_partkey % 9 + 1) end as pages from part")
def page_ranges(spark, sf):
    m = c("p_partkey") % 9
    asked = F.when(c("p_partkey") % 4 == 0, "5-7, 12,3,6").when(c("p_partkey") % 4 == 1, "x,9-2").otherwise(said(m.cast("string"), "-", (m + 1).cast("string"), ",", m.cast("string")))
    return part_of(spark, sf).select("p_partkey", F.array_join(tx.page_range(asked).cast("array<string>"), ",").alias("pages"))


@query("""select o_orderkey, case when o_orderkey % 5 = 4 then null else strftime(o_orderdate, '%Y-%m-%d') end as day, case o_orderkey % 3 when 0 then '2020-01-31' when 1 then strftime(o_orderdate, '%Y-%m-%d') end as effective from orders""")
def legal_dates(spark, sf):
    y, m, d = (F.date_format("o_orderdate", x) for x in ("yyyy", "M", "d"))
    k = c("o_orderkey") % 5
    text = F.when(k == 0, said("ký ", y, "-", m, "-", d)).when(k == 1, said("Hà Nội, ngày ", d, " tháng ", m, " năm ", y)).when(k == 2, said(d, "/", m, "/", y)).when(k == 3, said(d, ".", m, ".", y)).otherwise("31/2/2020")
    j = c("o_orderkey") % 3
    effect = F.when(j == 0, "có hiệu lực từ ngày ký").when(j == 1, said("Có hiệu lực từ ngày 1/1/1990; có hiệu lực thi hành kể từ ngày ", d, " tháng ", m, " năm ", y)).otherwise("không")
    return table(spark, sf, "orders").select("o_orderkey", dates.iso_date(text).alias("day"), dates.effective_date(effect, F.lit("2020-01-31")).alias("effective"))


@query("""select o_orderkey, case when o_orderkey % 11 = 0 then 'bi_thay_the' when o_orderkey % 7 = 0 or o_orderdate < timestamp '1993-01-01' then 'het_hieu_luc' when o_orderkey % 5 = 0 then 'khong_xac_dinh' when o_orderdate > timestamp '1996-06-30' then 'chua_co_hieu_luc' else 'con_hieu_luc' end as validity from orders""")
def validity_states(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    since = F.when(c("o_orderkey") % 5 != 0, day)
    expiry = F.when(day < "1993-01-01", "1996-06-29").otherwise("1996-06-30")
    return table(spark, sf, "orders").select("o_orderkey", dates.validity(F.lit(None).cast("string"), since, expiry, c("o_orderkey") % 11 == 0, c("o_orderkey") % 7 == 0, F.lit("1996-06-30")).alias("validity"))


@query("""select event_id, case event_type when 'error' then case when event_id % 2 = 0 then 'denied' else 'error' end else 'ok' end as status, greatest(5, floor(0.3::DOUBLE * (event_id % 101) + 0.7::DOUBLE * (event_id * 7 % 101))::INT) as progress from events""")
def call_status_progress(spark, sf):
    reply = F.when(c("event_type") != "error", "3 results").when(c("event_id") % 2 == 0, "Permission DENIED: error").otherwise("Error: none")
    return table(spark, sf, "events").select("event_id", st.call_status(reply).alias("status"), st.progress(c("event_id") % 101, c("event_id") * 7 % 101).alias("progress"))


@query("""select c_custkey, case when c_nationkey % 4 = 0 then 'all' when c_nationkey % 4 = 1 then 'own_dept' when c_nationkey % 4 = 2 then 'own' else 'none' end as level from customer""")
def permission_levels(spark, sf):
    k = c("c_nationkey") % 4
    names = [F.array(*map(F.lit, x)) for x in (["doc:edit:own", "doc:edit:all"], ["doc:edit:own", "doc:edit:own_dept"], ["doc:edit:own", "doc:read:all"], ["doc:read:all"])]
    granted = F.when(k == 0, names[0]).when(k == 1, names[1]).when(k == 2, names[2]).otherwise(names[3])
    return table(spark, sf, "customer").select("c_custkey", access.permission_level(granted, "doc", "edit").alias("level"))


@query("""select p_partkey from part where p_type in ('ECONOMY', 'PROMO') or p_partkey in (3, 5) or p_name like 'cold%' or p_partkey % 10 = 0""")
def knowledge_scopes(spark, sf):
    types = F.when(c("p_partkey") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array("p_type"))
    keep = access.allowed(c("p_partkey"), c("p_type"), [3, 5], ["ECONOMY"]) | access.overlaps(types, ["PROMO"]) | F.like("p_name", F.lit(access.escape_like("cold") + "%"))
    return table(spark, sf, "part").where(keep).select("p_partkey")


# ---- streams: the event log as files that arrive


def events_stream(spark, sf) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", c("ts").cast("timestamp"))


@query("select strftime(ts::DATE, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_daily(spark, sf):
    return ev.drained(ev.daily_counts(events_stream(spark, sf)), "complete", "daily").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with g as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 3 hour then 0 else 1 end as fresh from events))
select user_id, epoch_us(min(ts)) as begins, count(*) as n from g group by user_id, s""")
def stream_sessions(spark, sf):
    return ev.drained(ev.sessions(events_stream(spark, sf), "3 hours"), "complete", "sessions").select("user_id", F.unix_micros("start").alias("begins"), "n")


@query("select event_id, epoch_us(ts) as at from events")
def stream_once(spark, sf):
    twice = events_stream(spark, sf).select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    return ev.drained(ev.once(twice), "append", "once").select("event_id", F.unix_micros("ts").alias("at"))


@query("""with recursive k(user_id, ts) as (select user_id, min(ts) from events group by 1 union all select k.user_id, min(e.ts) from k join events e on e.user_id = k.user_id and e.ts >= k.ts + interval 6 hour group by k.user_id, k.ts)
select user_id, epoch_us(ts) as at from k""")
def stream_debounced(spark, sf):
    return ev.drained(ev.debounced(events_stream(spark, sf), 6 * 3600), "append", "debounced").select("user_id", F.unix_micros("ts").alias("at"))


@query("""with e as (select user_id as s, event_id % 2 as b, case event_type when 'error' then 'error' when 'view' then 'ready' when 'click' then 'running' else 'pending' end as state, ts, event_id % 97 = 0 as v from events),
m as (select s, arg_max(state, ts) filter (where b = 0) as cs, arg_max(state, ts) filter (where b = 1) as ps, bool_or(v) as v from e group by 1),
n as (select *, coalesce(cs, 'pending') as x, coalesce(ps, 'pending') as y from m)
select s as source_id, cs as chunks, ps as pages, case when x = 'pending' and y <> 'pending' then case when y in ('ready', 'error') then y else 'processing' end
 when v or y = 'pending' then case when x in ('ready', 'error') then x else 'processing' end when x = y then case when y in ('ready', 'error') then y else 'processing' end
 when x in ('ready', 'error') and y in ('ready', 'error') then 'partial' when y = 'ready' then 'ready' else 'processing' end as status from n""")
def stream_branch_status(spark, sf):
    t = c("event_type")
    state = F.when(t == "error", "error").when(t == "view", "ready").when(t == "click", "running").otherwise("pending")
    moves = events_stream(spark, sf).select(c("user_id").alias("source_id"), F.when(c("event_id") % 2 == 0, "chunk").otherwise("page").alias("branch"), state.alias("status"), "ts", (c("event_id") % 97 == 0).alias("verbatim"))
    return ev.drained(ev.branch_statuses(moves), "complete", "branches").select("source_id", "chunks", "pages", "status")


@query("select user_id as source_id, event_id from events qualify event_id // 100 = max(event_id // 100) over (partition by user_id)")
def latest_attempts(spark, sf):
    return ev.latest_attempts(table(spark, sf, "events").select(c("user_id").alias("source_id"), F.floor(c("event_id") / 100).alias("attempt"), "event_id")).select("source_id", "event_id")


# ---- runs, budgets and ranks


@query("""with t as (select conv_id, turn, text, turn - row_number() over (partition by conv_id order by turn) as run from conversations where text is not null and turn % 3 <> 1)
select conv_id, min(turn) as first, max(turn) as last, md5(string_agg(text, chr(10) || chr(10) order by turn)) as body, max(length(text)) as score from t group by conv_id, run""")
def chunk_islands(spark, sf):
    hits = table(spark, sf, "conversations").where("text is not null and turn % 3 != 1").select("conv_id", "turn", "text", F.length("text").cast("long").alias("score"))
    return checks.islands(hits, "conv_id", "turn", "text", "score").select("conv_id", "first", "last", F.md5("text").alias("body"), "score")


_LINES = "z as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as i, l_quantity::BIGINT as size, l_linenumber % 2 as tier from lineitem)"


def lines_of(spark, sf) -> DataFrame:
    i = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return table(spark, sf, "lineitem").select(c("l_orderkey").alias("doc_id"), i.cast("long").alias("idx"), c("l_quantity").cast("long").alias("size"), (c("l_linenumber") % 2).alias("tier"))


@query(f"""with recursive {_LINES}, o as (select *, row_number() over (partition by k order by tier, i) as r from z),
g(k, r, i, free, taken) as (select k, r, i, case when size <= 80 then 80 - size else 80 end, size <= 80 from o where r = 1 union all select o.k, o.r, o.i, case when o.size <= g.free then g.free - o.size else g.free end, o.size <= g.free from g join o on o.k = g.k and o.r = g.r + 1)
select k as doc_id, i as idx, taken from g""")
def greedy_budget(spark, sf):
    return consolidate.greedy_fill(lines_of(spark, sf), 80).select("doc_id", "idx", "taken")


@query(f"""with recursive {_LINES}, g(k, i, used, batch) as (select k, i, size, 0 from z where i = 1 union all select z.k, z.i, case when g.used > 0 and g.used + z.size > 60 then z.size else g.used + z.size end, case when g.used > 0 and g.used + z.size > 60 then g.batch + 1 else g.batch end from g join z on z.k = g.k and z.i = g.i + 1)
select k as doc_id, i as idx, batch from g""")
def order_batches(spark, sf):
    return consolidate.in_order_batches(lines_of(spark, sf), "doc_id", "size", "idx", 60).select("doc_id", "idx", "batch")


@query(f"""with {_SECTIONS}, m as (select s.doc_id, s.idx, coalesce(bool_or(pos >= a and pos < b), false) as hit, coalesce(bool_or(least(abs(pos - a), abs(pos - b)) < 5000), false) as near from s left join h using (doc_id) group by 1, 2)
select doc_id, idx, case when hit then 'A' when near or coalesce(lag(hit) over w, false) or coalesce(lead(hit) over w, false) then 'B' else 'C' end as tier from m window w as (partition by doc_id order by idx)""")
def section_tiers(spark, sf):
    return consolidate.section_tiers(*sections_of(spark, sf)).select("doc_id", "idx", "tier")


_ACT = "(select p_partkey, p_partkey || case when p_partkey % 3 = 0 then '/2023/nđ-cp' when p_partkey % 3 = 1 then ' /2023/NĐ–CP-x' else '1/2023/NĐ-CP' end as number, (p_partkey % 2 + 1)::VARCHAR as unit from part)"


@query(f"select p_partkey as unit_id, 0 as step from {_ACT} where p_partkey = 12 and unit = '1'")
def legal_route_exact(spark, sf):
    k = c("p_partkey")
    number = said(c("k"), F.when(k % 3 == 0, "/2023/nđ-cp").when(k % 3 == 1, " /2023/NĐ–CP-x").otherwise("1/2023/NĐ-CP"))
    units = part_of(spark, sf).select(k.alias("unit_id"), number.alias("doc_number"), (k % 2 + 1).cast("string").alias("unit_number"))
    return search.route(units, "12/2023/ND-CP", "1").select("unit_id", "step")


@query("""with w as (select doc_id, length(text)::DOUBLE as prior, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}_]+') as ws from documents),
x as (select doc_id, prior, ws, list_distinct(ws) as ds, ['the', 'and'] as q from w),
s as (select doc_id, prior, case when len(ds) = 0 then 0.0 else round(0.5 * len(list_intersect(q, ds)) / 2.0::DOUBLE + 0.2 * len(list_intersect(q, ds)) / len(list_distinct(list_concat(q, ds)))::DOUBLE + case when contains(array_to_string(ws, ' '), 'the and') then 0.3 else 0.0 end, 4) end::DOUBLE as own from x),
b as (select doc_id, 0.6 * own + 0.4 * prior / (select max(prior) from s) as score from s)
select doc_id, round(score, 4) as score from b where round(score, 4) >= 0.2""".replace("\\\\", "\\"))
def rerank_prior_threshold(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text", F.length("text").cast("double").alias("prior"))
    kept = search.pass_threshold(search.local_rerank(rows, "the and", prior="prior"))
    return kept.select("doc_id", c("rerank_score").alias("score"))


@query("""with r as (select o_orderkey as k, case when o_orderkey % 3 = 0 then 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') else 'page-' || o_custkey end as s, 'nobody' as t from orders)
select k, case when k % 3 = 0 or c_custkey % 2 = 0 then c_custkey end as source_page, null::BIGINT as target_page from r join orders on o_orderkey = k left join customer on c_custkey = o_custkey""")
def concept_pages(spark, sf):
    pages = table(spark, sf, "customer").select(c("c_custkey").alias("page"), F.when(c("c_custkey") % 2 == 0, said("page-", c("c_custkey").cast("string"))).otherwise(said("x", c("c_custkey").cast("string"))).alias("slug"), c("c_name").alias("title"))
    name = F.when(c("o_orderkey") % 3 == 0, said(" customer#", F.lpad(c("o_custkey").cast("string"), 9, "0"))).otherwise(said("Page-", c("o_custkey").cast("string")))
    found = graph.resolve_concepts(table(spark, sf, "orders").select(c("o_orderkey").alias("k"), name.alias("source"), F.lit("nobody").alias("target")), pages)
    return found.select("k", "source_page", "target_page")


@query(f"""with k as (select ('2024-01-' || lpad((conv_id % 5 + 1)::VARCHAR, 2, '0'))::DATE as day, {_GAP} as gap_key, conv_id from conversations where role = 'user'),
n as (select day, gap_key, count(*) as n, row_number() over (partition by day order by count(*) desc, gap_key) as r from k where gap_key <> '' group by 1, 2)
select gap_key as "text", sum(n)::BIGINT as "count", (select count(distinct conv_id) from k where k.gap_key = n.gap_key and (k.day, k.gap_key) in (select (day, gap_key) from n where r <= 100)) as n_requesters from n where r <= 100 group by gap_key""")
def gap_merge(spark, sf):
    asked = table(spark, sf, "conversations").where("role = 'user'")
    daily = analytics.gap_metric(asked, F.date_add(F.lit("2024-01-01").cast("date"), (c("conv_id") % 5).cast("int")), "text", "conv_id", "conv_id")
    return analytics.merge_gaps(daily).select("text", "count", c("n_requesters").cast("long").alias("n_requesters"))


@query("select doc_id, md5(case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then '[' || lang || ']' || chr(10) || chr(10) else '[' || lang || ' — ' || source || ']' || chr(10) || chr(10) end || text) as input from documents where text is not null and lang <> '' and source <> ''")
def embed_inputs(spark, sf):
    k = c("doc_id") % 3
    rows = table(spark, sf, "documents").where("text is not null and lang <> '' and source <> ''")
    return rows.select("doc_id", F.md5(chunks.embed_input(F.when(k == 0, "").otherwise(c("lang")), F.when(k == 2, c("source")).otherwise(""), c("text"))).alias("input"))


# ---- relations of acts that are resolved


@query("select p_partkey as k, relation, case when relation = 'sua_doi' and p_partkey + 1 in (select p_partkey from part) then (p_partkey + 1) * 10 + case when p_partkey % 2 = 0 then 0 else 3 end end as target_unit from part, (values ('can_cu'), ('sua_doi'), ('bai_bo')) as r(relation)")
def legal_relink(spark, sf):
    return legal.relink(links_of(spark, sf), units_of(spark, sf)).select("k", "relation", "target_unit")


@query("select (p_partkey + 2) || '/2019/NĐ-CP' as target_number, '' as replaced_by, p_partkey || '/2020/NĐ-CP' as repealed_by from part")
def legal_lifecycle(spark, sf):
    cycles = legal.lifecycle(links_of(spark, sf))
    return cycles.select("target_number", F.array_join("replaced_by", ",").alias("replaced_by"), F.array_join("repealed_by", ",").alias("repealed_by"))


# ---- versions


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def cascade_delete(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    left = versions.delete_with_children("o_orderkey", orders.where("o_orderstatus = 'F'"), lines=lines)
    return left["lines"].select(c("o_orderkey").alias("l_orderkey"), "l_linenumber", "l_partkey")


@query("select vec_id, label as model_spec, case when vec_id % 3 = 0 then 'made' else 'kept' end as origin from embeddings where label % 2 = 0")
def model_switch(spark, sf):
    old = table(spark, sf, "embeddings").select("vec_id", F.when(c("label") % 2 == 0, "new").otherwise("old").alias("model_spec"), "label", F.lit("kept").alias("origin"))
    made = old.where("vec_id % 3 = 0").withColumn("origin", F.lit("made"))
    return versions.switch_model(old, made, "new", ["vec_id"]).select("vec_id", c("label").alias("model_spec"), "origin")


@query("""select o_orderkey, case when o_orderkey % 4 = 0 then 'rows_lost' when o_orderkey % 4 = 1 then 'shrunk' end as refusal, case when o_orderkey % 4 in (2, 3) then 'merged' else 'appended' end as kept from orders""")
def rewrite_guards(spark, sf):
    k = c("o_orderkey") % 4
    old = F.when(k == 0, said("|a|b|\n|-|-|\n|one|1|\n|two|2|\n|", c("o_orderpriority"), "|3|")).otherwise(F.repeat(F.lit("word "), 120))
    new = F.when(k == 0, "|a|b|\n|-|-|\n|one|1|\n|two|2|\n|other|3| and more text here").when(k == 1, F.repeat(F.lit("word "), 40)).otherwise(F.repeat(F.lit("word "), 130))
    merged = checks.merge_or_append(old, new, F.lit("added"))
    return table(spark, sf, "orders").select("o_orderkey", checks.rewrite_guard(old, new).alias("refusal"), F.when(merged == new, "merged").otherwise("appended").alias("kept"))


# ---- upkeep: orders are sources, customers pages

_STATES = """x as (select o_orderkey as source_id, case o_orderkey % 5 when 0 then 'error' when 1 then 'partial' when 2 then 'plan_ready' when 3 then 'ready' else 'error' end as status, case o_orderkey % 3 when 0 then 'error' when 1 then 'ready' else 'pending' end as cs,
 case o_orderkey % 4 when 0 then 'error' when 1 then 'ready' when 2 then null else 'pending' end as ws, case when o_orderkey % 6 = 0 then 'verify' else 'map' end as phase, o_orderkey % 7 <> 0 as txt, o_orderkey % 8 = 0 as verbatim, (o_orderkey % 9 // 2)::INT as n, o_orderkey % 2 = 0 as adm, case o_orderkey % 10 when 0 then 'wiki' when 1 then 'all' end as asked from orders)"""


@query(f"""with {_STATES}, y as (select *, cs = 'error' as cf, coalesce(ws, 'pending') = 'error' or status = 'plan_ready' as wf from x),
w as (select *, coalesce(asked, case when not txt or (cs = 'pending' and coalesce(ws, 'pending') = 'pending') or not (cf or wf) then 'all' when cf and wf then 'both' when cf then 'chunk' else 'wiki' end) as want from y),
r as (select *, case when status = 'ready' then 'status' when n >= 3 and not adm then 'too_many' when want <> 'all' and not txt then 'no_text' end as refusal from w),
b as (select *, case when refusal is null then case when want in ('wiki', 'both') and verbatim then 'chunk' else want end end as branch from r)
select source_id, refusal, branch, case when branch in ('wiki', 'both') then case when phase = 'verify' then 'refine' else 'map' end end as start from b""")
def retry_plans(spark, sf):
    k = c("o_orderkey")
    pick = lambda m, *names: F.element_at(F.array(*(F.lit(n).cast("string") for n in names)), (k % m + 1).cast("int"))
    sources = table(spark, sf, "orders").select(
        k.alias("source_id"), pick(5, "error", "partial", "plan_ready", "ready", "error").alias("status"), pick(3, "error", "ready", "pending").alias("chunk_status"), pick(4, "error", "ready", None, "pending").alias("wiki_status"),
        F.when(k % 6 == 0, "verify").otherwise("map").alias("phase"), (k % 7 != 0).alias("has_text"), (k % 8 == 0).alias("verbatim"), F.floor(k % 9 / 2).cast("int").alias("recoveries"), (k % 2 == 0).alias("by_admin"),
        F.when(k % 10 == 0, "wiki").when(k % 10 == 1, "all").alias("asked"),
    )
    return upkeep.retry_plan(sources).select("source_id", "refusal", "branch", "start")


@query("""with s as (select o_orderkey, o_orderdate from orders where o_orderstatus in ('F', 'P') and o_orderkey % 3 in (0, 1) and o_orderkey % 5 <> 0), a as (select 'chunks' as work, o_orderkey as source_id from s order by o_orderdate, o_orderkey limit 500),
b as (select 'metadata', o_orderkey from orders where o_orderkey % 5 <> 0 and o_orderkey not in (select l_orderkey from lineitem where l_linenumber = 1) order by o_orderdate desc, o_orderkey limit 500) select * from a union all select * from b""")
def backfills(spark, sf):
    k = c("o_orderkey")
    status = F.when(c("o_orderstatus") == "F", "ready").when(c("o_orderstatus") == "P", "partial").otherwise("pending")
    chunk = F.when(k % 3 == 0, "pending").when(k % 3 == 1, "error").otherwise("ready")
    sources = table(spark, sf, "orders").select(k.alias("source_id"), status.alias("status"), chunk.alias("chunk_status"), F.when(k % 5 != 0, "x").otherwise(" ").alias("text"), c("o_orderdate").alias("created_at"))
    done = table(spark, sf, "lineitem").where("l_linenumber = 1").select(c("l_orderkey").alias("source_id"))
    work = lambda df, name: df.select(F.lit(name).alias("work"), "source_id")
    return work(upkeep.chunk_backfill(sources), "chunks").unionByName(work(upkeep.metadata_backfill(sources, done), "metadata"))


_KNOWN = "p as (select 'p' || o_orderkey as slug, o_orderpriority || ' ' || o_orderkey as title, o_orderstatus as status, o_orderdate as changed from orders where o_orderkey > 0)"


@query(f"""with {_KNOWN}, a as (select 'contradiction' as part, slug, title, 'against ' || slug || ' more' as note from p where slug like '%77'), b as (select 'recent', slug, title, strftime(changed, '%Y-%m-%d %H:%M') from p order by changed desc, slug limit 10),
d as (select 'seed', slug, title, null from p where status = 'P' order by title, slug limit 20) select * from a union all select * from b union all select * from d""")
def hot_briefing(spark, sf):
    slug = F.when(c("o_orderkey") == 0, "_hot").otherwise(said("p", c("o_orderkey").cast("string")))
    content = F.when(c("o_orderkey") % 100 == 77, said("text\n> [!contradiction] against ", slug, "\n> more\n\nend")).otherwise("text")
    pages = table(spark, sf, "orders").select(slug.alias("slug"), said(c("o_orderpriority"), " ", c("o_orderkey").cast("string")).alias("title"), F.when(c("o_orderstatus") == "P", "seed").otherwise("mature").alias("status"), c("o_orderdate").alias("updated_at"), content.alias("content"))
    return upkeep.briefing(pages)


@query(f"with {_KNOWN} select case when status = 'P' then 'other' else status end as page_type, slug, '- [[' || slug || '|' || title || ']]' || case when status = 'F' then ' — done' else '' end as line, (select count(*) from p) > 2000 as cut from p order by changed desc, slug limit 2000")
def index_pages(spark, sf):
    slug = F.when(c("o_orderkey") == 0, "_index").otherwise(said("p", c("o_orderkey").cast("string")))
    pages = table(spark, sf, "orders").select(slug.alias("slug"), said(c("o_orderpriority"), " ", c("o_orderkey").cast("string")).alias("title"), F.when(c("o_orderstatus") != "P", c("o_orderstatus")).alias("page_type"), F.when(c("o_orderstatus") == "F", "done").alias("summary"), c("o_orderdate").alias("updated_at"))
    return upkeep.index_lines(pages)


@query("""with e as (select o_custkey as scope, string_agg('## [' || strftime(o_orderdate, '%Y-%m-%d %H:%M') || '] order ' || o_orderkey, chr(10) || chr(10) order by o_orderdate, o_orderkey::VARCHAR) as t from orders where o_orderkey % 5 = 0 group by 1), l as (select c_custkey as scope from customer where c_custkey % 2 = 0)
select coalesce(l.scope, e.scope) as scope, case when t is null then 'Log' || chr(10) else case when l.scope is null then '# Wiki Log' else 'Log' end || chr(10) || chr(10) || t || chr(10) end as content, case when l.scope is null then 1 when t is null then 4 else 5 end as version from l full join e on l.scope = e.scope""")
def log_pages(spark, sf):
    logs = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(c("c_custkey").alias("scope"), F.lit("Log\n").alias("content"), F.lit(4).alias("version"))
    entries = table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(c("o_custkey").alias("scope"), c("o_orderdate").alias("at"), said(" order ", c("o_orderkey").cast("string")).alias("entry"))
    return upkeep.append_log(logs, entries)


@query(r"""with c as (select o_orderkey as claim_id, o_custkey % 50 as doc_id, case o_orderkey % 3 when 0 then 'The ' || p_name || '''s maker' when 1 then upper(p_name) else p_name || 'x' end as subject, p_name as own, o_orderkey % 400 as o, case when o_orderkey % 2 = 0 then 3000 end as len from orders join part on p_partkey = o_custkey)
select p.item, claim_id, c.doc_id, md5(coalesce(substring(d.text, o + 1, least(coalesce(len, 200), 2000)), '')) as excerpt from c join (select lower(p_name) as name, min(p_partkey) as item from part group by 1) p on c.claim_id % 3 <> 2 and p.name = lower(c.own) left join documents d on d.doc_id = c.doc_id""")
def evidence_excerpts(spark, sf):
    k = c("o_orderkey")
    subject = F.when(k % 3 == 0, said("The ", c("p_name"), "'s maker")).when(k % 3 == 1, F.upper("p_name")).otherwise(said(c("p_name"), "x"))
    claims = table(spark, sf, "orders").join(table(spark, sf, "part"), c("p_partkey") == c("o_custkey")).select(k.alias("claim_id"), (c("o_custkey") % 50).alias("doc_id"), subject.alias("subject"), (k % 400).alias("offset"), F.when(k % 2 == 0, 3000).alias("length"))
    items = table(spark, sf, "part").groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("item"))
    return consolidate.assemble_evidence(items, claims, table(spark, sf, "documents"), "doc_id", "text").select("item", "claim_id", "doc_id", F.md5("excerpt").alias("excerpt"))


@query("""with i as (select p_partkey % 40 as doc_id, p_partkey as image, 0 as n, 'image_caption' as kind, '[image_caption | Trang ' || case when p_partkey % 3 = 0 then 1 else p_size end || ']: ' || p_name as chunk from part
 union all select p_partkey % 40, p_partkey, 1, 'image_ocr', case when p_partkey % 4 = 0 then '[image_ocr] ' || p_type else '[image_ocr | Trang ' || case when p_partkey % 3 = 0 then 1 else p_size end || ']: ' || p_type end from part where p_partkey % 2 = 0)
select doc_id, (80000 + row_number() over (partition by doc_id order by image, n) - 1)::INT as chunk_index, image, kind, chunk from i""")
def image_chunks(spark, sf):
    k = c("p_partkey")
    images = table(spark, sf, "part").select((k % 40).alias("doc_id"), k.alias("idx"), k.alias("image"), F.when(k % 3 != 0, c("p_size")).alias("page"), c("p_name").alias("caption"), F.when(k % 4 == 0, said("[image_ocr] ", c("p_type"))).when(k % 2 == 0, c("p_type")).otherwise(" ").alias("ocr"))
    return chunks.image_chunks(images, "doc_id")


@query("""select p_partkey, case when p_partkey % 3 = 0 then 'page' when p_partkey % 3 = 1 then '> [!warning] **Cảnh báo trích dẫn: x' else '> [!warning] **Cảnh báo trích dẫn: Phát hiện nội dung chưa xác minh (2 khẳng định)**' || chr(10) || '> Các nội dung sau chưa tìm thấy căn cứ trực tiếp trong tài liệu nguồn:' || chr(10) || '> - ' || p_name || ' b' || chr(10) || '> - ' || repeat('x', 117) || '…' || chr(10) || chr(10) || 'page' end as body from part""")
def warning_blocks(spark, sf):
    m = c("p_partkey") % 3
    claims = F.when(m == 0, F.array().cast("array<string>")).otherwise(F.array(said(" ", c("p_name"), "\nb"), F.repeat(F.lit("x"), 130)))
    return table(spark, sf, "part").select("p_partkey", consolidate.with_warning(F.when(m == 1, consolidate.WARNING + ": x").otherwise("page"), claims).alias("body"))
