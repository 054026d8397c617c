"""Queries of the unified search, over all questions of the conversations at once, and of edits that are committed together."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import analytics, chunks, editing, search, textindex, unified
from docloom.operators.vectorindex import VectorIndex
from docloom.plans.catalog import _ALIKE, _LOG, _WEEK, c, log_of, query, table
from docloom.plans.flows import events_stream
from docloom.session import shared_dir, staged
from docloom.streaming import attempts
from docloom.streaming import events as ev

#: The languages that a question may see, by its conversation's number; null is no limit.
_SCOPES = [None, ["en", "de"], ["fr", "es", "en"], ["xx"]]


def _asked(spark, sf):
    """A row for each question: terms are its first six longer words, the phrase its first two words."""
    said = table(spark, sf, "conversations").where("role = 'user'").withColumn("ws", tx.tokens(c("text")))
    scopes = F.array(*(F.lit(None).cast("array<string>") if s is None else F.array(*map(F.lit, s)) for s in _SCOPES))
    vectors = table(spark, sf, "embeddings").select(c("vec_id").alias("v"), "embedding")
    asked = said.select(
        (c("conv_id") * 100 + c("turn")).alias("query"), c("text").alias("query_text"), F.slice(F.array_distinct(F.filter("ws", lambda w: F.length(w) >= 4)), 1, 6).alias("terms"),
        F.when(F.size("ws") >= 2, F.array(F.slice("ws", 1, 2))).otherwise(F.array().cast("array<array<string>>")).alias("phrases"), F.get(scopes, (c("conv_id") % 4).cast("int")).alias("scopes"), ((c("conv_id") * 5 + c("turn")) % 500).alias("v"),
    )
    return asked.join(vectors, "v", "left").drop("v")


def _corpora(spark, sf, words=True):
    """Even documents as pages, grouped by source, and odd ones as sources of their own; without ``words`` no index of these is made."""
    docs = table(spark, sf, "documents")
    vectors = table(spark, sf, "embeddings").select(c("vec_id").alias("key"), "embedding")
    out = []
    for name, rest in (("page", 0), ("source", 1)):
        own = docs.where(c("doc_id") % 2 == rest)
        rows = own.select(c("doc_id").alias("key"), F.when(F.lit(rest == 0), c("source")).otherwise(c("doc_id").cast("string")).alias("group"), c("lang").alias("scope"), "text")
        index = VectorIndex.build(vectors.join(rows.select("key", "scope"), "key"), "key", tag="scope")
        out.append(unified.Corpus(name, rows, textindex.index_of(own, f"{sf}/documents/{name}") if words else None, index))
    return out


_WORDS = "regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}_]+')"
_SEARCH = f"""with s as (select conv_id * 100 + turn as query, text as query_text, (conv_id * 5 + turn) % 500 as v, {_WORDS} as ws,
  case conv_id % 4 when 0 then null when 1 then ['en', 'de'] when 2 then ['fr', 'es', 'en'] else ['xx'] end as scopes from conversations where role = 'user'),
q as (select s.*, embedding as qv, list_filter(ws, lambda w: length(w) >= 4) as longer from s left join embeddings on vec_id = v),
qt as (select distinct query, unnest(array_to_string(list_transform(list_slice(list_filter(longer, lambda w, i: list_position(longer, w) = i), 1, 6), lambda w: w), ' ').string_split(' ')) as token from q where len(longer) > 0),
qn as (select query, count(*) as n from qt group by query),
d as (select doc_id as key, case doc_id % 2 when 0 then 'page' else 'source' end as corpus, case doc_id % 2 when 0 then source else doc_id::VARCHAR end as grp, lang as scope, {_WORDS} as ws from documents),
dt as (select key, token, count(*) as tf from (select key, unnest(ws) as token from d) group by all),
h as (select query, key, count(*) as hits, sum(tf) as tf from qt join dt using (token) group by all),
p as (select query, ws[1] || ' ' || ws[2] as pair from q where len(ws) >= 2),
dp as (select distinct key, unnest(list_transform(list_zip(ws[:-2], ws[2:]), lambda z: z[1] || ' ' || z[2])) as pair from d where len(ws) >= 2),
n as (select query, key from p join dp using (pair)),
l as (select coalesce(h.query, n.query) as query, coalesce(h.key, n.key) as key, coalesce(hits, 0) as hits, coalesce(tf, 0) as tf, n.key is not null as needle from h full join n on h.query = n.query and h.key = n.key),
la as (select l.query, l.key, d.corpus, d.grp, needle, row_number() over (partition by l.query, d.corpus order by needle desc, hits = coalesce(qn.n, -1) and hits > 0 desc, hits desc, tf desc, l.key) as rank
  from l join d using (key) join q on q.query = l.query left join qn on qn.query = l.query where q.scopes is null or list_contains(q.scopes, d.scope) qualify rank <= 50),
cs as (select q.query, d.key, d.corpus, d.grp, q.scopes, d.scope, list_cosine_similarity(q.qv::DOUBLE[], e.embedding::DOUBLE[]) as s from q, embeddings e join d on d.key = e.vec_id where q.qv is not null),
va as (select query, key, corpus, grp, s, row_number() over (partition by query, corpus order by round(s, 12) desc, key) as rank from cs where scopes is null or list_contains(scopes, scope) qualify rank <= 50),
u as (select query, corpus, grp, key, rank, null::DOUBLE as s, true as lexical, needle as exact from la union all select query, corpus, grp, key, rank, s, false, false from va),
f as (select query, corpus, grp, key, sum(1.0::DOUBLE / (60 + rank)) as rrf, max(s) as similarity, bool_or(lexical) as lexical, bool_or(exact) as exact from u group by all having max(s) >= 0.35 or bool_or(lexical)),
g as (select query, corpus, grp, key, rrf, similarity, bool_or(lexical) over w as lexical, bool_or(exact) over w as exact from f window w as (partition by query, corpus, grp) qualify row_number() over (partition by query, corpus, grp order by round(rrf, 12) desc, key) = 1),
t as (select * from g qualify row_number() over (partition by query order by exact desc, round(rrf, 12) desc, corpus, key) <= 20),
x as (select t.*, list_distinct(q.ws) as qd, list_distinct(d.ws) as dd, contains(' ' || array_to_string(d.ws, ' ') || ' ', ' ' || array_to_string(q.ws, ' ') || ' ') as whole from t join q using (query) join d on d.key = t.key),
y as (select *, case when len(qd) > 0 and len(dd) > 0 then round(0.5 * len(list_intersect(qd, dd)) / len(qd)::DOUBLE + 0.2 * len(list_intersect(qd, dd)) / (len(qd) + len(dd) - len(list_intersect(qd, dd)))::DOUBLE + case when whole then 0.3 else 0 end, 4) else 0 end as local from x),
z as (select *, round(0.6 * local + 0.4 * rrf / max(rrf) over (partition by query), 4) as score from y),
k as (select *, max(score) over (partition by query) as most from z),
r as (select *, row_number() over (partition by query order by exact desc, score desc, round(rrf, 12) desc, corpus, key) as rank from k
  where exact or score >= case when most >= 0.2 then 0.2 when most >= 0.15 then 0.15 else -1e9 end)
"""


@query(_SEARCH + """select query, rank, corpus, grp as "group", key, round(rrf, 9) as rrf, round(similarity, 6) as similarity, lexical, exact, round(score, 4) as score from r where rank <= 10""")
def unified_search(spark, sf):
    answer = unified.search_all(_asked(spark, sf), _corpora(spark, sf), diverse=False)  # its SQL ends with the threshold
    if answer.failed:
        raise RuntimeError("; ".join(answer.failed))  # a query of the catalogue is whole or not there
    found = answer.ranked
    return found.select("query", c("rank").cast("long").alias("rank"), "corpus", "group", "key", F.round("rrf", 9).alias("rrf"), F.round("similarity", 6).alias("similarity"), "lexical", "exact", "score")


@query(_SEARCH + """, o as (select query, corpus, key, s, row_number() over (partition by query, corpus order by round(s, 12) desc, key) as near from cs where scopes is not null and not list_contains(scopes, scope) qualify near <= 5)
select query, row_number() over (partition by query order by round(s, 12) desc, corpus, key) as rank, corpus, key, round(s, 6) as similarity from o qualify rank <= 5""")
def unified_hints(spark, sf):
    """What the questions would find outside their scopes, in all corpora or not at all."""
    found = unified.out_of_scope(_asked(spark, sf), _corpora(spark, sf, words=False))
    return found.select("query", c("rank").cast("long").alias("rank"), "corpus", "key", F.round("similarity", 6).alias("similarity"))


_PARTS = """with e as (select p_partkey as k, 'p' || p_partkey as slug, p_size % 5 = 0 as edited, p_size % 5 = 0 and p_size % 10 <> 0 as good from part),
l as (select slug, 'p' || (k * 7 % 1999 + 1) as to_slug from e where not good union select slug, 'p' || (k * 3 % 1999 + 1) from e where good union select slug, 'hub' from e where good),
b as (select to_slug as slug, count(*) as n from l where to_slug <> slug group by to_slug)
"""


@query(_PARTS + """select slug, 1 + good::INT as version, case when good then 'updated' when edited then 'conflict' end as outcome, coalesce(n, 0) as n_backlinks, 1 + good::BIGINT as n_revisions from e left join b using (slug)""")
def page_edits(spark, sf):
    """Parts become pages in one commit; a second one changes a fifth of them, half of which name a version that is not theirs."""
    store = editing.wiki(spark, f"{shared_dir(spark)}/docloom/{spark.sparkContext.applicationId}/wiki-{uuid.uuid4().hex}", 8)
    parts = table(spark, sf, "part").select("*", c("p_partkey").alias("k"), F.concat(F.lit("p"), c("p_partkey")).alias("slug"))
    link = lambda by: F.concat(F.lit(" [[p"), c("k") * by % 1999 + 1, F.lit("]]"))
    said = lambda content, version, at: [c("p_name").alias("title"), content.alias("content"), c("p_type").alias("page_type"), version.cast("int").alias("base_version"), F.lit("a").alias("author"), F.lit(at).cast("timestamp").alias("at")]
    editing.apply_edits(store, parts.select("slug", *said(F.concat("p_name", link(7)), F.lit(None), "2024-01-01")))
    second = parts.where("p_size % 5 = 0").select("slug", *said(F.concat("p_type", link(3), F.lit(" [[hub]]")), F.when(c("p_size") % 10 == 0, 7).otherwise(1), "2024-01-02"))
    found, version = editing.apply_edits(store, second)
    revisions = store.read("revisions", version).groupBy("slug").agg(F.count("*").alias("n_revisions"))
    pages = store.read("pages", version).join(found.select("slug", "outcome"), "slug", "left").join(store.read("backlinks", version), "slug", "left").join(revisions, "slug")
    return pages.select("slug", "version", "outcome", F.coalesce("n", F.lit(0)).alias("n_backlinks"), "n_revisions")


@query("""with e as (select user_id as task, (1 + event_id // 1000)::INT as attempt, case event_id % 4 when 2 then 'failed' when 3 then 'done' else 'started' end as outcome, ts from events),
o as (select *, row_number() over (partition by task order by ts, attempt, outcome <> 'started') as r from e),
m as (select *, max(attempt) over w as newest, count(*) filter (where outcome <> 'started') over (partition by task, attempt order by r rows between unbounded preceding and 1 preceding) as ended from o window w as (partition by task order by r)),
v as (select *, attempt < newest or ended > 0 as stale from m),
f as (select *, sum((not stale and outcome = 'failed')::INT) over (partition by task order by r) as failures from v)
select task, case when stale then 'stale' when outcome = 'done' then 'done' when failures < 3 then 'retry' else 'dead' end as kind, attempt, failures::INT as failures, outcome as reason, epoch_us(ts) // 1000 as at_ms,
  case when not stale and outcome = 'failed' and failures < 3 then 60 * 2 ** (failures - 1) end::BIGINT as wait from f where stale or outcome <> 'started'""")
def stream_attempts(spark, sf):
    """Events as what attempts say: stale ones, retries with their waits, and dead letters."""
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        attempts.with_timers(spark)
        said = events_stream(spark, sf)
        outcome = F.when(c("event_id") % 4 == 2, "failed").when(c("event_id") % 4 == 3, "done").otherwise("started")
        stream = said.select(c("user_id").alias("task"), (1 + F.floor(c("event_id") / 1000)).cast("int").alias("attempt"), outcome.alias("outcome"), "ts")
        found = ev.drained(attempts.outcomes(stream, minutes=10**6), "append", "attempts")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    return found.select("task", "kind", "attempt", "failures", "reason", F.unix_millis("at").alias("at_ms"), (F.unix_timestamp("due") - F.unix_timestamp("at")).alias("wait"))


@query(f"""with recursive {_ALIKE}, d as (select distinct least(a, b) as a, greatest(a, b) as b from (select a, b from s where s >= 0.38 and s < 0.45 qualify row_number() over (partition by a order by s desc, b) <= 3)),
l as (select a, b from s where s >= 0.45), e as (select a, b from l union select a, b from d where (a + b) % 3 <> 0 union select b, a from d where (a + b) % 3 <> 0),
w(n, m) as (select vec_id, vec_id from embeddings union select w.n, e.b from w join e on e.a = w.m), k as (select n, min(m) as cluster from w group by n),
x as (select distinct ka.cluster from d join k ka on ka.n = d.a join k kb on kb.n = d.b where (d.a + d.b) % 3 = 0 and ka.cluster = kb.cluster),
v(n, m) as (select vec_id, vec_id from embeddings union select v.n, l.b from v join l on l.a = v.m), o as (select n, min(m) as own from v group by n)
select k.n as vec_id, case when x.cluster is null then k.cluster else o.own end as cluster, x.cluster is not null as contested from k join o using (n) left join x on x.cluster = k.cluster""")
def ambiguous_concepts(spark, sf):
    """Doubtful pairs, judged by the sum of their ids, join their classes unless that joins what is judged to differ."""
    index = VectorIndex.build(table(spark, sf, "embeddings"))
    pairs = search.doubtful_pairs(index, 0.38, 0.45)
    same = search.judged(pairs, table(spark, sf, "embeddings").withColumn("text", c("vec_id").cast("string")), lambda a, b: [(int(x) + int(y)) % 3 != 0 for x, y in zip(a, b)])
    return search.resolve_ambiguous(index, same, 0.45).select(c("id").alias("vec_id"), "cluster", "contested")


_MARKED = "html"
for _level in range(6, 0, -1):
    _MARKED = f"regexp_replace({_MARKED}, '(?i)<h{_level}[^>]*>', chr(10) || '{'#' * _level} ', 'g')"


@query(rf"""with t as (select page_id, chr(10) || {_MARKED} || chr(10) || '## last' as t from pages),
l as (select page_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i, length(t) as size from t),
o as (select *, coalesce(sum(length(line) + 1) over (partition by page_id order by i rows between unbounded preceding and 1 preceding), 0) as place from l),
h as (select *, row_number() over (partition by page_id order by i) - 1 as idx, length(regexp_extract(line, '^(#+)[ 	]+[^ 	
]', 1)) as level from o where regexp_matches(line, '^#{{1,6}}[ 	]+[^ 	
]'))
select page_id, idx::INT as idx, level::INT as level, md5(trim(regexp_extract(line, '^#+[ 	]+(.+)$', 1), ' ' || chr(9) || chr(13))) as title, place::BIGINT as start_at, coalesce(lead(place) over (partition by page_id order by idx), size)::BIGINT as end_at,
  (select max(g.idx) from h g where g.page_id = h.page_id and g.idx < h.idx and g.level < h.level)::INT as parent from h""")
def page_outline(spark, sf):
    """Headings with levels, titles, places and parents."""
    marked = c("html")
    for level in range(6, 0, -1):
        marked = F.regexp_replace(marked, f"(?i)<h{level}[^>]*>", "\n" + "#" * level + " ")
    found = chunks.outline(table(spark, sf, "pages").select("page_id", F.concat(F.lit("\n"), marked, F.lit("\n## last")).alias("t")), "page_id", "t")
    return found.select("page_id", "idx", "level", F.md5(F.trim("title")).alias("title"), c("start").cast("long").alias("start_at"), c("end").cast("long").alias("end_at"), "parent")


@query(f"with {_LOG} select day, users, true as near from {_WEEK}")
def wau_from_days(spark, sf):
    """Weekly users from the stored rows of days; near: whether the estimate by sketches alone is within 3 % of the exact number."""
    daily = staged(analytics.daily_users(log_of(spark, sf)), "days")
    return analytics.users_of_days(daily).select("day", "users", (F.abs(c("estimate") - c("users")) <= 0.03 * c("users") + 1).alias("near"))
