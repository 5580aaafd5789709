"""The registered queries of the notice engine, each with its SQL where SQL can express it."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import html, text, urls
from tidewater.operators import dedup, evaluate, events, filters, health, reply, state
from tidewater.plans import monitor
from tidewater.plans import runs as run_log
from tidewater.plans.views import ARTICLES_SQL, NOTICES_SQL, PAGE_URL_SQL, REVIEWED_SQL, RUNS_SQL, VISITS_SQL, articles, notices, reviewed, source_runs, visits
from tidewater.sources import files, key_files, page_stream, scan, sinks, snapshots
from tidewater.sources.files import read_table
from tidewater.storage import cut, fresh_path
from tidewater.streaming import keyed

TODAY = "2026-07-10"
KEYWORDS, EXCLUDED = ["the.*of", "ción", "keit"], ["idiot", "licen[sc]e"]
_ENTRIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        _ENTRIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_ENTRIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


today = lambda: F.lit(TODAY).cast("date")
long = lambda c: c.cast("long")
_PASS_SQL = "regexp_matches(title || ' ' || summary, '(?i)(?:the.*of)|(?:ción)|(?:keit)') AND NOT regexp_matches(title || ' ' || summary, '(?i)(?:idiot)|(?:licen[sc]e)')"


@query("funnel_by_source", f"WITH {ARTICLES_SQL} SELECT source, count(*) AS total, count(*) FILTER (WHERE {_PASS_SQL}) AS keyword_passed, count(*) FILTER (WHERE status = 'pushed') AS pushed FROM articles GROUP BY source")
def funnel_by_source(spark, sf):
    rows = articles(spark, sf).withColumn("ok", filters.keyword_pass(F.col("title"), F.col("summary"), KEYWORDS, EXCLUDED))
    return rows.groupBy("source").agg(F.count("*").alias("total"), F.count_if("ok").alias("keyword_passed"), F.count_if(F.col("status") == "pushed").alias("pushed"))


@query("keyword_filter", f"WITH {ARTICLES_SQL} SELECT id, source FROM articles WHERE {_PASS_SQL}")
def keyword_filter(spark, sf):
    return articles(spark, sf).where(filters.keyword_pass(F.col("title"), F.col("summary"), KEYWORDS, EXCLUDED)).select("id", "source")


_T = filters.GateTerms()
_has = lambda c, terms: "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"
_GATE_SQL = f"""CASE WHEN {_has('title', _T.result)} THEN 'result' WHEN NOT {_has('title', _T.opportunity)} AND NOT ({_has('source', _T.target_sources)} AND {_has('title', _T.competition)}) THEN 'no_action'
  WHEN NOT {_has('title', _T.award)} THEN 'not_award' WHEN coalesce(CAST(nullif(regexp_extract(title, '(?:^|[^0-9])(20[0-9][0-9])', 1), '') AS INTEGER) <
  year(coalesce(CASE WHEN regexp_matches(replace(publish_date, '/', '-'), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN try_cast(replace(publish_date, '/', '-') AS DATE) END, DATE '{TODAY}')), false) THEN 'stale_year'
  WHEN NOT {_has('source', _T.target_sources)} AND NOT {_has('title', _T.industry)} THEN 'off_industry' ELSE 'pass' END"""


@query("title_gate_reasons", f"WITH {NOTICES_SQL} SELECT id, {_GATE_SQL} AS reason FROM notices")
def title_gate_reasons(spark, sf):
    reason = filters.gate_reason(F.col("title"), F.col("source"), F.col("publish_date"), today())
    return notices(spark, sf).select("id", F.coalesce(reason, F.lit("pass")).alias("reason"))


@query("gate_reason_counts", f"WITH {NOTICES_SQL} SELECT reason, count(*) AS n FROM (SELECT {_GATE_SQL} AS reason FROM notices) GROUP BY reason")
def gate_reason_counts(spark, sf):
    return title_gate_reasons(spark, sf).groupBy("reason").agg(F.count("*").alias("n"))


@query("status_counts", f"WITH {ARTICLES_SQL} SELECT status, count(*) AS n, max(id) AS last_id FROM articles GROUP BY status")
def status_counts(spark, sf):
    return articles(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


@query("last_run", "WITH " + RUNS_SQL + " SELECT id, source, status FROM runs WHERE id = (SELECT max(id) FROM runs)")
def last_run(spark, sf):
    runs = source_runs(spark, sf)
    last = runs.agg(F.max("id").alias("m"))
    return runs.join(F.broadcast(last), F.col("id") == F.col("m")).select("id", "source", "status")


@query("run_funnel", f"WITH {ARTICLES_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE status <> 'discovered') AS screened, count(*) FILTER (WHERE status IN ('ready_to_push', 'push_failed', 'pushed')) AS confirmed, count(*) FILTER (WHERE status = 'pushed') AS pushed FROM articles")
def run_funnel(spark, sf):
    s = F.col("status")
    return articles(spark, sf).agg(F.count("*").alias("total"), F.count_if(s != "discovered").alias("screened"), F.count_if(s.isin("ready_to_push", "push_failed", "pushed")).alias("confirmed"), F.count_if(s == "pushed").alias("pushed"))


_CANON_SQL = "'http://' || lower(source) || '.example.com/n/' || (id % 400) || '?a=' || (id % 3) || '&b=2'"


@query("title_normalize_keys", f"WITH {ARTICLES_SQL}, k AS (SELECT id, source, publish_date, regexp_replace(lower(title), '\\s+', '', 'g') AS normalized_title, {_CANON_SQL} AS canonical_url FROM articles) SELECT id, normalized_title, sha256(trim(source) || '|' || normalized_title || '|' || canonical_url || '|' || publish_date) AS dedup_key FROM k")
def title_normalize_keys(spark, sf):
    rows = articles(spark, sf).withColumn("normalized_title", text.normalize_title(F.col("title"))).withColumn("c", urls.canonical_url("url"))
    return rows.select("id", "normalized_title", state.fingerprint(F.col("source"), F.col("normalized_title"), F.col("c"), F.col("publish_date")).alias("dedup_key"))


@query("url_canonical", f"WITH {ARTICLES_SQL} SELECT id, {_CANON_SQL} AS canonical_url FROM articles")
def url_canonical(spark, sf):
    return articles(spark, sf).select("id", urls.canonical_url("url").alias("canonical_url"))


@query("url_canonical_native", f"WITH {ARTICLES_SQL} SELECT id, {_CANON_SQL} AS canonical_url FROM articles")
def url_canonical_native(spark, sf):
    return articles(spark, sf).select("id", urls.canonical_url_native(F.col("url")).alias("canonical_url"))


@query("page_url_canonical", f"SELECT page_id, {PAGE_URL_SQL} AS canonical_url FROM pages")
def page_url_canonical(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", urls.canonical_url("url").alias("canonical_url"))


@query("page_hosts", "SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def page_hosts(spark, sf):
    return read_table(spark, sf, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("domain_rules", "SELECT page_id, h = 'a.example.com' OR h = 'example.com' OR h LIKE '%.example.com' AS wide, h = 'thth.example.com' OR h LIKE '%.thth.example.com' OR h LIKE '%.org' OR h = 'org' AS narrow FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h FROM pages)")
def domain_rules(spark, sf):
    h = urls.host(F.col("url"))
    return read_table(spark, sf, "pages").select("page_id", urls.domain_allowed_wide(h, F.lit("a.example.com"), []).alias("wide"), urls.domain_allowed_strict(h, F.lit("thth.example.com"), ["org"]).alias("narrow"))


@query("page_plan", "SELECT 'src' || s_suppkey AS source, CAST(p AS INTEGER) AS page_num, CASE WHEN s_suppkey % 2 = 0 AND p = 1 THEN 'http://x/first' ELSE 'http://x/' || (2 + (p - CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END) * 3) END AS url FROM supplier, range(1, 4) r(p)")
def page_plan(spark, sf):
    s = read_table(spark, sf, "supplier")
    rows = s.select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("source"), F.lit("http://x/{n}").alias("url_template"), F.when(F.col("s_suppkey") % 2 == 0, "http://x/first").alias("first_page_url"), F.lit(2).alias("n_start"), F.lit(3).alias("n_step"), F.lit(3).alias("max_pages"))
    return scan.page_plan(rows)


@query("search_plan", "SELECT replace('award {year} ' || r_name, '{year}', '2026') AS query, CAST(p AS INTEGER) AS page_num FROM region, range(1, 3) t(p)")
def search_plan(spark, sf):
    rows = read_table(spark, sf, "region").select(F.concat(F.lit("award {year} "), F.col("r_name")).alias("query"))
    return scan.search_plan(rows, 2, 2026)


_SEARCH_SQL = f"""WITH {ARTICLES_SQL}, r AS (SELECT a.source, d.lang AS account, id % 3 AS query, CAST(id // 3 % 5 AS INTEGER) AS page_num, a.publish_date, right(a.source, 1) AS mark FROM articles a JOIN documents d ON d.doc_id = a.id),
  p AS (SELECT DISTINCT source, query, page_num, (page_num * 3 + query + ascii(mark)) % 4 = 0 OR mark IN ('3', '6') AS broken FROM r),
  m AS (SELECT r.source, coalesce(account, '') = '' OR account = 'en' OR (account = 'de' AND mark IN ('1', '2')) AS ok, publish_date BETWEEN '2026-06-11' AND '{TODAY}' AS recent FROM r JOIN p ON p.source = r.source AND p.query = r.query AND p.page_num = r.page_num WHERE NOT broken),
  c AS (SELECT source, count(*) AS raw_count, count(*) FILTER (WHERE ok) AS matched_count, count(*) FILTER (WHERE ok AND recent) AS articles FROM m GROUP BY source), f AS (SELECT source, count(*) FILTER (WHERE broken) AS failed FROM p GROUP BY source)
  SELECT f.source, CASE WHEN coalesce(articles, 0) > 0 THEN 'success' WHEN failed > 0 THEN 'failed' ELSE 'empty' END AS status, coalesce(articles, 0) AS articles, coalesce(raw_count, 0) AS raw_count, coalesce(matched_count, 0) AS matched_count, CASE WHEN failed > 0 THEN failed || ' pages failed' END AS error FROM f LEFT JOIN c ON c.source = f.source"""


@query("search_scan_status", _SEARCH_SQL)
def search_scan_status(spark, sf):
    """Searches whose results are the documents: raw, matched and recent ones by source, where pages fail."""
    i = F.col("id")
    rows = articles(spark, sf).join(read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit(" "), F.upper("lang")).alias("account")), "id")
    rows = rows.select("source", "account", (i % 3).alias("query"), (F.expr("id div 3") % 5).cast("int").alias("page_num"), "publish_date", F.right("source", F.lit(1)).alias("mark"))
    broken = ((F.col("page_num") * 3 + F.col("query") + F.ascii("mark")) % 4 == 0) | F.col("mark").isin("3", "6")
    pages = rows.select("source", "query", "page_num", F.when(broken, "timeout").alias("fetch_error")).distinct()
    of = rows.select("source", "mark").distinct()
    aliases = of.select("source", F.lit("en").alias("alias")).unionByName(of.where("mark in ('1', '2')").select("source", F.lit("D e").alias("alias")))
    return scan.search_scan(pages, rows, aliases, today(), 30)[1]


@query("dedup_first_url", f"WITH {ARTICLES_SQL} SELECT id, {_CANON_SQL} AS canonical_url FROM articles QUALIFY row_number() OVER (PARTITION BY {_CANON_SQL} ORDER BY id) = 1")
def dedup_first_url(spark, sf):
    rows = articles(spark, sf).select("id", urls.canonical_url_native(F.col("url")).alias("canonical_url"))
    return dedup.first_by(rows, ["canonical_url"], "id")


_KEYED_SQL = f"{VISITS_SQL}, keyed AS (SELECT * FROM visits)"


@query("dedup_anti_window", f"WITH {_KEYED_SQL}, i AS (SELECT * FROM keyed WHERE id % 4 = 0), s AS (SELECT * FROM keyed WHERE id % 4 <> 0) SELECT id FROM i WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.created_at <= i.created_at AND s.created_at >= i.created_at - INTERVAL 90 DAY AND ((s.canonical_url = i.canonical_url AND s.canonical_url <> '') OR (s.normalized_title = i.normalized_title AND s.source = i.source)))")
def dedup_anti_window(spark, sf):
    rows = visits(spark, sf)
    return dedup.anti_window(rows.where("id % 4 = 0"), rows.where("id % 4 <> 0")).select("id")


_ANTI_SQL = "SELECT id FROM i WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.created_at <= i.created_at AND s.created_at >= i.created_at - INTERVAL 90 DAY AND ((s.canonical_url = i.canonical_url AND s.canonical_url <> '') OR (s.normalized_title = i.normalized_title AND s.source = i.source)))"


@query("dedup_pruned_lookup", f"WITH {_KEYED_SQL}, i AS (SELECT * FROM keyed WHERE created_at >= TIMESTAMP '2026-08-01'), s AS (SELECT * FROM keyed WHERE created_at < TIMESTAMP '2026-08-01') {_ANTI_SQL}")
def dedup_pruned_lookup(spark, sf):
    """Later visits against the stored keys of earlier ones; months before the window and files without a key of theirs stay unread."""
    rows, path = visits(spark, sf), fresh_path(spark)
    key_files.write_keys(rows.where("created_at < timestamp_ntz'2026-08-01'"), path)
    return key_files.anti_window_files(rows.where("created_at >= timestamp_ntz'2026-08-01'"), path).select("id")


@query("dedup_by_url_window", f"WITH RECURSIVE {_KEYED_SQL}, k AS (SELECT * FROM keyed WHERE canonical_url <> ''), kept AS (SELECT canonical_url, min(created_at) AS last FROM k GROUP BY 1 UNION ALL SELECT canonical_url, last FROM (SELECT x.canonical_url, (SELECT min(k.created_at) FROM k WHERE k.canonical_url = x.canonical_url AND k.created_at > x.last + INTERVAL 90 DAY) AS last FROM kept x) WHERE last IS NOT NULL) SELECT min(k.id) AS id FROM kept JOIN k ON k.canonical_url = kept.canonical_url AND k.created_at = kept.last GROUP BY kept.canonical_url, kept.last")
def dedup_by_url_window(spark, sf):
    return dedup.keep_window(visits(spark, sf).where("canonical_url <> ''"), ["canonical_url"], cut).select("id")


@query("dedup_by_title_source", f"WITH RECURSIVE {_KEYED_SQL}, kept AS (SELECT normalized_title, source, min(created_at) AS last FROM keyed GROUP BY 1, 2 UNION ALL SELECT normalized_title, source, last FROM (SELECT x.normalized_title, x.source, (SELECT min(k.created_at) FROM keyed k WHERE k.normalized_title = x.normalized_title AND k.source = x.source AND k.created_at > x.last + INTERVAL 90 DAY) AS last FROM kept x) WHERE last IS NOT NULL) SELECT min(k.id) AS id FROM kept JOIN keyed k ON k.normalized_title = kept.normalized_title AND k.source = kept.source AND k.created_at = kept.last GROUP BY kept.normalized_title, kept.source, kept.last")
def dedup_by_title_source(spark, sf):
    return dedup.keep_window(visits(spark, sf), ["normalized_title", "source"], cut).select("id")


_WALK_SQL = f"WITH RECURSIVE {_KEYED_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY created_at, id) AS n FROM keyed), walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id BIGINT, u VARCHAR, t VARCHAR, s VARCHAR, w TIMESTAMP)[]) AS kept UNION ALL SELECT o.n, CASE WHEN len(list_filter(walk.kept, lambda k: k.w >= o.created_at - INTERVAL 90 DAY AND ((k.u = o.canonical_url AND k.u <> '') OR (k.t = o.normalized_title AND k.s = o.source)))) = 0 THEN list_append(walk.kept, {{'id': o.id, 'u': o.canonical_url, 't': o.normalized_title, 's': o.source, 'w': o.created_at}}) ELSE walk.kept END FROM walk JOIN o ON o.n = walk.n + 1), f AS (SELECT unnest(kept).id AS id FROM (SELECT kept FROM walk ORDER BY n DESC LIMIT 1))"


@query("dedup_disjunctive", f"{_WALK_SQL} SELECT keyed.id, f.id IS NOT NULL AS kept FROM keyed LEFT JOIN f ON f.id = keyed.id")
def dedup_disjunctive(spark, sf):
    return dedup.keep_disjunctive(visits(spark, sf), cut).select("id", "kept")


@query("dedup_stream", f"{_WALK_SQL} SELECT id FROM f")
def dedup_stream(spark, sf):
    """The same rows as they arrive in four parts of their time, judged by keyed state."""
    rows = cut(visits(spark, sf))
    arrivals, store, check = (fresh_path(spark) for _ in range(3))
    first, last = rows.agg(F.min("created_at"), F.max("created_at")).first()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    keyed.make_folder(spark, arrivals)
    keyed.make_folder(spark, store)
    for n in range(4 if first else 0):
        step = (last - first) / 4
        part = F.col("created_at") >= F.lit(first + n * step).cast("timestamp_ntz")
        # nothing runs while a part is written, or a batch could take some of its files before the others
        rows.where(part & (F.col("created_at") < F.lit(first + (n + 1) * step).cast("timestamp_ntz")) if n < 3 else part).write.mode("append").parquet(arrivals)
        keyed.dedup_stream(spark, spark.readStream.schema(schema).parquet(arrivals), store, check, cut, available=True).awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(store).select("id")


_SOURCES = [("行业信息库", "website", "authoritative_secondary", 1), ("城市规划学会", "website", "official_website", 2), ("行业信息库", "website", "aggregator", 3), ("规划视界", "wechat", "authoritative_secondary", 4)]
_TIER_SQL = "CASE source WHEN '行业信息库' THEN 'authoritative_secondary' WHEN '微信公众号:规划视界' THEN 'authoritative_secondary' WHEN '微信公众号:未知号' THEN 'official_wechat' WHEN '资讯聚合' THEN 'aggregator' ELSE 'official_website' END"
_PRIORITY_SQL = "CASE tier WHEN 'official_website' THEN 400 WHEN 'official_wechat' THEN 300 WHEN 'authoritative_secondary' THEN 200 ELSE 100 END"


def _tiered(spark, sf):
    return events.source_tier(notices(spark, sf), spark.createDataFrame(_SOURCES, "name string, kind string, tier string, pos int"))


@query("source_tier_lookup", f"WITH {NOTICES_SQL}, t AS (SELECT *, {_TIER_SQL} AS tier FROM notices) SELECT id, tier, {_PRIORITY_SQL} AS priority FROM t")
def source_tier_lookup(spark, sf):
    return _tiered(spark, sf).select("id", "tier", "priority")


_COMPLETE_SQL = "CAST(CASE WHEN award_name <> '' THEN 100 ELSE 0 END + CASE WHEN deadline_date <> '' THEN 50 ELSE 0 END + CASE WHEN deadline_text <> '' THEN 25 ELSE 0 END + CASE WHEN scope_size > 0 THEN 25 ELSE 0 END + least(length(raw_content), 5000) // 100 AS INTEGER)"


@query("completeness_score", f"WITH {NOTICES_SQL} SELECT id, {_COMPLETE_SQL} AS completeness FROM notices")
def completeness_score(spark, sf):
    return notices(spark, sf).select("id", _completeness().alias("completeness"))


def _completeness():
    return events.completeness(F.col("award_name"), F.col("deadline_date"), F.col("deadline_text"), F.col("scope_size"), F.col("raw_content"), F.lit(""))


_STRIP = "regexp_replace(regexp_replace(regexp_replace(lower({c}), '\\s+', '', 'g'), '[，。！？：；、（）()【】\\[\\]‘’“”\"''…·,.;:!?]+', '', 'g'), '(19|20)[0-9][0-9](年度|年)?', '', 'g')"
_JUR = " , ".join(f"nullif(regexp_extract(title || source, '{p}', 0), '')" for p in events.JURISDICTIONS)
_PHASE_SQL = "CASE " + " ".join(f"WHEN {_has('title', words)} THEN '{name}'" for name, words in events.PHASES) + " ELSE 'application' END"
_KEY_SQL = f"coalesce(nullif({_STRIP.format(c='award_name')}, ''), {_STRIP.format(c='title')}) || '|' || coalesce(nullif(regexp_extract(award_name || ' ' || title || ' ' || publish_date, '(19|20)[0-9][0-9]', 0), ''), 'unknown') || '|' || {_PHASE_SQL} || '|' || coalesce({_JUR}, '全国')"


def _event_key(exact: bool = True):
    return events.event_key(F.col("award_name"), F.col("title"), F.lit(""), F.col("source"), F.col("publish_date"), exact)


@query("event_keys", f"WITH {NOTICES_SQL} SELECT id, {_KEY_SQL} AS event_key FROM notices")
def event_keys(spark, sf):
    return notices(spark, sf).select("id", _event_key().alias("event_key"))


_RANKED_SQL = f"{NOTICES_SQL}, t AS (SELECT *, {_TIER_SQL} AS tier, {_COMPLETE_SQL} AS completeness, {_KEY_SQL} AS event_key FROM notices), r AS (SELECT *, {_PRIORITY_SQL} AS priority FROM t)"


def _ranked(spark, sf):
    return _tiered(spark, sf).withColumn("event_key", _event_key()).withColumn("completeness", _completeness()).drop("raw_content")


@query("event_winner", f"WITH {_RANKED_SQL} SELECT event_key, id FROM r QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY priority DESC, completeness DESC, publish_date DESC, id DESC) = 1")
def event_winner(spark, sf):
    return events.winners(_ranked(spark, sf))


_NOW = "2026-07-31 09:59:00"


_MINE_SQL = "{'p': a.priority, 'c': a.completeness, 'd': a.publish_date, 'i': a.id}"
_RELEASE_SQL = f"""WITH RECURSIVE {_RANKED_SQL}, a AS (SELECT event_key, id, tier, priority, completeness, publish_date, created_at, row_number() OVER (PARTITION BY event_key ORDER BY created_at, id) AS n FROM r),
  z AS (SELECT NULL::STRUCT(p INTEGER, c INTEGER, d VARCHAR, i BIGINT) AS no),
  w AS (SELECT DISTINCT event_key, CAST(0 AS BIGINT) AS n, no AS waiting, CAST(NULL AS TIMESTAMP) AS due, no AS out, CAST([] AS STRUCT(id BIGINT, action VARCHAR, better_id BIGINT)[]) AS done FROM a, z
    UNION ALL SELECT event_key, n, CASE WHEN nout IS NOT NULL THEN no WHEN nwait IS NOT NULL AND nwait > mine THEN nwait WHEN tier = 'aggregator' THEN mine ELSE no END,
      CASE WHEN nout IS NOT NULL THEN NULL WHEN nwait IS NOT NULL AND nwait > mine THEN due WHEN tier = 'aggregator' THEN created_at + INTERVAL 24 HOUR END,
      CASE WHEN nout IS NOT NULL THEN CASE WHEN mine > nout THEN {{'p': mine.p, 'c': nout.c, 'd': nout.d, 'i': nout.i}} ELSE nout END WHEN (nwait IS NULL OR nwait < mine) AND tier <> 'aggregator' THEN mine ELSE no END,
      list_concat(CASE WHEN released THEN [{{'id': waiting.i, 'action': 'push', 'better_id': NULL::BIGINT}}] ELSE [] END,
        CASE WHEN nout IS NOT NULL THEN CASE WHEN mine > nout THEN [{{'id': mine.i, 'action': 'supersede', 'better_id': NULL}}, {{'id': nout.i, 'action': 'take_over', 'better_id': mine.i}}] ELSE [{{'id': mine.i, 'action': 'supersede', 'better_id': NULL}}] END
          WHEN nwait IS NOT NULL AND nwait > mine THEN [{{'id': mine.i, 'action': 'supersede', 'better_id': NULL}}]
          ELSE list_concat(CASE WHEN nwait IS NOT NULL THEN [{{'id': nwait.i, 'action': 'supersede', 'better_id': NULL::BIGINT}}] ELSE [] END, CASE WHEN tier <> 'aggregator' THEN [{{'id': mine.i, 'action': 'push', 'better_id': NULL::BIGINT}}] ELSE [] END) END)
      FROM (SELECT *, CASE WHEN released THEN waiting ELSE out END AS nout, CASE WHEN released THEN no ELSE waiting END AS nwait FROM (SELECT a.event_key, a.n, a.tier, a.created_at, {_MINE_SQL}::STRUCT(p INTEGER, c INTEGER, d VARCHAR, i BIGINT) AS mine, w.waiting, w.due, w.out, no, coalesce(w.due <= a.created_at, false) AS released FROM w JOIN a ON a.event_key = w.event_key AND a.n = w.n + 1, z))),
  steps AS (SELECT unnest(done) AS s FROM w), ends AS (SELECT waiting.i AS id, due FROM w QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY n DESC) = 1 AND waiting IS NOT NULL)
  SELECT s.id AS id, s.action AS action, s.better_id AS better_id FROM steps UNION ALL SELECT id, 'push', NULL FROM ends WHERE due <= (SELECT max(created_at) - INTERVAL 1 HOUR FROM r)"""


@query("release_stream", _RELEASE_SQL)
def release_stream(spark, sf):
    """What becomes of every report as reports arrive day by day: aggregators' go out by timers of their events."""
    rows = cut(_ranked(spark, sf).select("event_key", "id", "tier", "priority", "completeness", "publish_date", "created_at"))
    reports, out, check = (fresh_path(spark) for _ in range(3))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    keyed.make_folder(spark, reports)
    query = keyed.release_stream(spark, spark.readStream.schema(schema).parquet(reports), lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), check)
    try:
        for (day,) in rows.select(F.to_date("created_at").alias("day")).distinct().orderBy("day").collect():  # four days
            rows.where(F.to_date("created_at") == day).write.mode("append").parquet(reports)
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(keyed.ACTIONS).option("recursiveFileLookup", "true").parquet(out).select("id", "action", "better_id")


@query("event_merge_status", f"""WITH {_RANKED_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY priority DESC, completeness DESC, publish_date DESC, id DESC) AS rn,
  CASE WHEN status = 'pushed' THEN row_number() OVER (PARTITION BY event_key, status = 'pushed' ORDER BY priority DESC, completeness DESC, publish_date DESC, id DESC) END AS prn, bool_or(status = 'pushed') OVER (PARTITION BY event_key) AS any_pushed FROM r)
  SELECT id, CASE WHEN status = 'pushed' THEN CASE WHEN prn = 1 AND rn <> 1 THEN 'take_over' ELSE 'none' END WHEN any_pushed OR rn <> 1 THEN 'supersede' WHEN tier = 'aggregator' AND NOT (TIMESTAMP '{_NOW}' >= created_at + INTERVAL 24 HOUR) THEN 'wait' ELSE 'push' END AS action FROM o""")
def event_merge_status(spark, sf):
    return events.merge(_ranked(spark, sf), F.lit(_NOW).cast("timestamp_ntz")).select("id", "action")


@query("aggregator_due", f"WITH {NOTICES_SQL} SELECT id, TIMESTAMP '{_NOW}' >= created_at + INTERVAL 24 HOUR AS due FROM notices")
def aggregator_due(spark, sf):
    return notices(spark, sf).select("id", filters.aggregator_due(F.col("created_at"), F.lit(_NOW).cast("timestamp_ntz")).alias("due"))


@query("backfill_window", f"WITH {NOTICES_SQL} SELECT id FROM notices WHERE try_strptime(publish_date, '%Y-%m-%d') IS NULL OR CAST(try_strptime(publish_date, '%Y-%m-%d') AS DATE) BETWEEN DATE '{TODAY}' - 29 AND DATE '{TODAY}'")
def backfill_window(spark, sf):
    return notices(spark, sf).where(filters.in_backfill_window(F.col("publish_date"), today(), 30)).select("id")


@query("needs_detail", f"WITH {ARTICLES_SQL} SELECT source, count(*) AS n FROM articles WHERE length(coalesce(nullif(raw_content, ''), summary)) < 120 GROUP BY source")
def needs_detail(spark, sf):
    return articles(spark, sf).where(filters.needs_detail(F.col("raw_content"), F.col("summary"))).groupBy("source").agg(F.count("*").alias("n"))


@query("account_match", "SELECT s_suppkey FROM supplier WHERE regexp_replace(lower(s_name), '\\s+', '', 'g') IN ('supplier#000000001', 'supplier#000000004')")
def account_match(spark, sf):
    rows = read_table(spark, sf, "supplier").withColumn("account", F.col("s_name"))
    names = spark.createDataFrame([(" SUPPLIER #000000001",), ("supplier#000000004",), ("",)], "alias string")
    return filters.account_matches(rows, names, required=True).select("s_suppkey")


@query("site_keyword_filter", f"WITH {ARTICLES_SQL} SELECT id FROM articles WHERE contains(title, 'tion') OR contains(title, 'ung')")
def site_keyword_filter(spark, sf):
    return articles(spark, sf).where(filters.any_of(F.col("title"), ("tion", "ung"))).select("id")


@query("source_selector", f"WITH {NOTICES_SQL} SELECT id FROM notices WHERE source = '教育局'")
def source_selector(spark, sf):
    return notices(spark, sf).where(filters.source_selected("website:教育局", F.col("source"), F.when(F.col("source").startswith("微信"), "wechat").otherwise("website"))).select("id")


@query("source_baseline_upper_median", f"WITH {RUNS_SQL}, g AS (SELECT source, article_count FROM runs WHERE status = 'success' AND article_count > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY id DESC) <= 5), m AS (SELECT source, list_sort(list(article_count))[len(list(article_count)) // 2 + 1] AS v FROM g GROUP BY source) SELECT s.source, coalesce(m.v, 0) AS baseline FROM (SELECT DISTINCT source FROM runs) s LEFT JOIN m ON m.source = s.source")
def source_baseline_upper_median(spark, sf):
    return health.baseline(source_runs(spark, sf))


@query("failure_streak", f"WITH {RUNS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id DESC) AS rn FROM runs QUALIFY rn <= 20) SELECT source, coalesce(min(rn) FILTER (WHERE status NOT IN ('failed', 'partial')), count(*) + 1) - 1 AS streak FROM n GROUP BY source")
def failure_streak(spark, sf):
    return health.failure_streak(source_runs(spark, sf))


@query("streak_alerts", f"WITH {RUNS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id DESC) AS rn FROM runs QUALIFY rn <= 20), k AS (SELECT source, coalesce(min(rn) FILTER (WHERE status NOT IN ('failed', 'partial')), count(*) + 1) - 1 AS streak FROM n GROUP BY source) SELECT source FROM k WHERE streak = 3")
def streak_alerts(spark, sf):
    return health.failure_streak(source_runs(spark, sf)).where("streak = 3").select("source")


@query("health_override", f"WITH {RUNS_SQL}, g AS (SELECT source, max(article_count) AS b FROM runs WHERE status = 'success' GROUP BY source) SELECT id, CASE WHEN source_type = 'wechat' AND article_count > 0 AND id % 4 = 0 THEN 'no_match' WHEN status = 'empty' AND coalesce(b, 0) > 60 THEN 'anomaly' ELSE status END AS recorded FROM runs LEFT JOIN g USING (source)")
def health_override(spark, sf):
    runs = source_runs(spark, sf)
    best = runs.where("status = 'success'").groupBy("source").agg(F.max("article_count").alias("b"))
    base = F.when(F.col("b") > 60, F.col("b")).otherwise(0)
    return runs.join(best, "source", "left").select("id", health.recorded_status(F.col("source_type"), F.col("status"), F.col("article_count"), F.col("id") % 4, base).alias("recorded"))


@query("missed_windows", f"WITH {RUNS_SQL}, s AS (SELECT strftime(d, '%Y-%m-%d') || ' ' || h AS key, d + INTERVAL 1 HOUR * h AS scheduled_at FROM (SELECT TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * i AS d FROM range(0, 31) r(i)), (VALUES (9), (21)) v(h)) SELECT key FROM s WHERE TIMESTAMP '2024-01-30 11:00:00' >= scheduled_at + INTERVAL 90 MINUTE AND NOT EXISTS (SELECT 1 FROM runs WHERE status = 'success' AND article_count > 170 AND run_time BETWEEN s.scheduled_at - INTERVAL 15 MINUTE AND s.scheduled_at + INTERVAL 90 MINUTE)")
def missed_windows(spark, sf):
    days = spark.range(31).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d")).withColumn("h", F.explode(F.array(F.lit(9), F.lit(21))))
    at = F.timestamp_add("HOUR", F.col("h"), F.col("d").cast("timestamp_ntz"))
    schedule = days.select(F.concat_ws(" ", F.date_format("d", "yyyy-MM-dd"), F.col("h").cast("string")).alias("key"), at.alias("scheduled_at"))
    runs = source_runs(spark, sf).withColumn("status", F.when((F.col("status") == "success") & (F.col("article_count") > 170), "completed").otherwise("running"))
    return health.missed_windows(schedule, runs, F.lit("2024-01-30 11:00:00").cast("timestamp_ntz")).select("key")


@query("new_alerts", "SELECT 'k' || n_nationkey AS key FROM nation WHERE n_nationkey % 3 <> 0")
def new_alerts(spark, sf):
    keys = read_table(spark, sf, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"), "n_nationkey")
    return health.new_alerts(keys.select("key"), keys.where("n_nationkey % 3 = 0").select("key"))


@query("run_summary", f"WITH {RUNS_SQL}, b AS (SELECT status, article_count FROM runs) SELECT CAST(sum(article_count) AS BIGINT) AS total, count(*) AS sources, count(*) FILTER (WHERE status IN ('failed', 'partial')) AS with_errors, CASE WHEN count(*) FILTER (WHERE status = 'failed') = count(*) THEN 'failed' WHEN count(*) FILTER (WHERE status IN ('failed', 'partial')) > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM b")
def run_summary(spark, sf):
    return health.run_summary(source_runs(spark, sf).select("status", F.col("article_count").alias("articles")))


_STAGE_SQL = "CASE WHEN status IN ('ai_confirmed', 'ready_to_push', 'push_failed', 'pushed') THEN 'ai_positive' WHEN status = 'ai_rejected' THEN 'ai_negative' WHEN status IN ('new', 'keyword_rejected') THEN 'keyword_negative' ELSE 'unresolved' END"


@query("stage_counts", f"WITH {ARTICLES_SQL} SELECT stage, predicted, count(*) AS n FROM (SELECT {_STAGE_SQL} AS stage, CASE {_STAGE_SQL} WHEN 'ai_positive' THEN '是' WHEN 'unresolved' THEN '' ELSE '否' END AS predicted FROM articles) GROUP BY 1, 2")
def stage_counts(spark, sf):
    rows = articles(spark, sf).withColumn("stage", evaluate.stage(F.col("status"))).withColumn("predicted", evaluate.predicted(F.col("stage")))
    return rows.groupBy("stage", "predicted").agg(F.count("*").alias("n"))


@query("stratified_sample_hash", f"WITH {ARTICLES_SQL} SELECT id, source FROM articles QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || id)) <= 3")
def stratified_sample_hash(spark, sf):
    rows = articles(spark, sf).select("id", "source")
    order = F.sha2(F.concat(F.lit("7:"), F.col("id").cast("string")), 256)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(order))).where("n <= 3").select("id", "source")


@query("sampling_weights", f"WITH {ARTICLES_SQL}, k AS (SELECT source, count(*) AS population FROM articles WHERE status = 'keyword_rejected' GROUP BY source), t AS (SELECT count(*) AS s, least(count(*), sum(population)) AS target FROM k) SELECT source, population, printf('%.8f', population::DOUBLE) AS sampling_weight FROM k")
def sampling_weights(spark, sf):
    rows = articles(spark, sf).where("status = 'keyword_rejected'").select("id", "source")
    n = rows.select("source").distinct().count()  # one place for each source
    return evaluate.sample(rows, n, 7).select("source", "population", "sampling_weight")


_STAGE_SQL = "CASE WHEN status IN ('ai_confirmed', 'ready_to_push', 'push_failed', 'pushed') THEN 'ai_positive' WHEN status = 'ai_rejected' THEN 'ai_negative' WHEN status IN ('new', 'keyword_rejected') THEN 'keyword_negative' ELSE 'unresolved' END"
_QUEUE_SQL = f"""WITH {ARTICLES_SQL}, a AS (SELECT id, source, status, {_STAGE_SQL} AS decision_stage FROM articles), p AS (SELECT *, CASE decision_stage WHEN 'ai_positive' THEN '是' WHEN 'unresolved' THEN '' ELSE '否' END AS predicted_should_push FROM a),
  g AS (SELECT source, count(*) AS population FROM a WHERE decision_stage = 'keyword_negative' GROUP BY source), t AS (SELECT sum(population) AS total, count(*) AS n, least(40, sum(population)) AS target FROM g),
  q AS (SELECT *, CASE WHEN total > n THEN ((target - n) * (population - 1)) // (total - n) ELSE 0 END AS fl, CASE WHEN total > n THEN ((target - n) * (population - 1)) % (total - n) ELSE 0 END AS rem FROM g, t),
  r AS (SELECT *, row_number() OVER (ORDER BY rem DESC, source) AS place, row_number() OVER (ORDER BY population DESC, source) AS largest, sum(fl) OVER () AS given FROM q),
  z AS (SELECT source, population, CASE WHEN target >= total THEN population WHEN target < n THEN CAST(largest <= target AS BIGINT) ELSE 1 + fl + CAST(place <= target - n - given AS BIGINT) END AS sample_size FROM r),
  k AS (SELECT p.*, population, CAST(sample_size AS BIGINT) AS sample_size FROM p JOIN z ON z.source = p.source WHERE decision_stage = 'keyword_negative' QUALIFY row_number() OVER (PARTITION BY p.source ORDER BY sha256('20260710:' || id)) <= z.sample_size),
  f AS (SELECT *, count(*) OVER (PARTITION BY decision_stage) AS n FROM p WHERE decision_stage IN ('ai_positive', 'ai_negative'))
  SELECT id, source, status, decision_stage, predicted_should_push, n AS population, n AS sample_size, '1.00000000' AS sampling_weight, decision_stage AS sampling_stratum FROM f
  UNION ALL SELECT id, source, status, decision_stage, predicted_should_push, population, sample_size, printf('%.8f', population / sample_size), decision_stage || '|' || source FROM k"""


@query("review_queue", _QUEUE_SQL)
def review_queue(spark, sf):
    return evaluate.review_rows(articles(spark, sf).select("id", "source", "status"), 40, 20260710)


_CELL = "round(coalesce(sum(weight) FILTER (WHERE {c}), 0.0), 6)"


@query("weighted_confusion", f"WITH {REVIEWED_SQL}, c AS (SELECT * FROM reviewed WHERE basis <> 'unknown' AND label IS NOT NULL) SELECT stratum, {_CELL.format(c='predicted AND label')} AS tp, {_CELL.format(c='predicted AND NOT label')} AS fp, {_CELL.format(c='NOT predicted AND NOT label')} AS tn, {_CELL.format(c='NOT predicted AND label')} AS fn FROM c GROUP BY stratum")
def weighted_confusion(spark, sf):
    rows = reviewed(spark, sf).where("basis <> 'unknown' and label is not null").withColumn("actual", F.col("label"))
    return evaluate.confusion(rows, "stratum")


@query("eval_ratios", f"""WITH {REVIEWED_SQL}, r AS (SELECT *, basis <> 'unknown' AND label IS NOT NULL AS ok FROM reviewed), m AS (SELECT count(*) AS rows, count(*) FILTER (WHERE basis = 'unknown') AS unassessable, {_CELL.format(c="basis = 'unknown'")} AS unassessable_weight,
  count(*) FILTER (WHERE basis <> 'unknown' AND label IS NULL) AS uncertain, {_CELL.format(c="basis <> 'unknown' AND label IS NULL")} AS uncertain_weight, count(*) FILTER (WHERE ok) AS labelled, CAST(0 AS BIGINT) AS pending,
  {_CELL.format(c='ok AND predicted AND label')} AS tp, {_CELL.format(c='ok AND predicted AND NOT label')} AS fp, {_CELL.format(c='ok AND NOT predicted AND NOT label')} AS tn, {_CELL.format(c='ok AND NOT predicted AND label')} AS fn FROM r)
  SELECT *, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (tp + fp) * tp / (tp + fn) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM m""")
def eval_ratios(spark, sf):
    return evaluate.metrics(reviewed(spark, sf))


@query("bootstrap_intervals")
def bootstrap_intervals(spark, sf):
    rows = reviewed(spark, sf).where("basis <> 'unknown' and label is not null").select("stratum", "predicted", F.col("label").alias("actual"), "weight", (F.col("stratum") == "0").alias("census"))
    return evaluate.bootstrap(spark, rows, 200)


@query("weight_percentiles", f"WITH {ARTICLES_SQL} SELECT source, quantile_cont(length(raw_content), 0.025) AS low, quantile_cont(length(raw_content), 0.975) AS high FROM articles GROUP BY source")
def weight_percentiles(spark, sf):
    size = F.length("raw_content")
    return articles(spark, sf).groupBy("source").agg(F.percentile(size, 0.025).alias("low"), F.percentile(size, 0.975).alias("high"))


_LENIENT = "coalesce(strftime(try_strptime(regexp_extract(trim({c}), '^([0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}})', 1), ['%Y-%m-%d', '%Y/%m/%d']), '%Y-%m-%d'), '')"


@query("event_time_basis", f"WITH {NOTICES_SQL} SELECT id, CASE WHEN p <> '' THEN p ELSE s END AS event_date, CASE WHEN p <> '' THEN 'published_at' WHEN s <> '' THEN 'first_seen_at' ELSE 'unknown' END AS event_time_basis FROM (SELECT id, {_LENIENT.format(c='publish_date')} AS p, CASE WHEN id % 4 = 0 THEN '' ELSE strftime(created_at, '%Y-%m-%d') END AS s FROM notices)")
def event_time_basis(spark, sf):
    seen = F.when(F.col("id") % 4 == 0, "").otherwise(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    rows = notices(spark, sf).withColumn("t", evaluate.event_time(F.col("publish_date"), seen))
    return rows.select("id", "t.event_date", "t.event_time_basis")


_DAY_SQL = "strftime(try_cast(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE), '%Y-%m-%d')"
_DEADLINE_SQL = f"CASE k WHEN 0 THEN coalesce({_DAY_SQL.format(y=2026, m='m', d='d')}, '') WHEN 1 THEN coalesce({_DAY_SQL.format(y=2025, m='m', d='d')}, '') ELSE coalesce({_DAY_SQL.format(y=2025, m='m2', d='d2')}, {_DAY_SQL.format(y=2025, m='m', d='d')}, '') END"


@query("deadline_inference", f"SELECT id, {_DEADLINE_SQL} AS deadline FROM (SELECT doc_id AS id, doc_id % 3 AS k, CAST(doc_id % 14 AS INTEGER) AS m, CAST(doc_id * 7 % 33 AS INTEGER) AS d, CAST(doc_id * 5 % 15 AS INTEGER) AS m2, CAST(doc_id * 11 % 34 AS INTEGER) AS d2 FROM documents)")
def deadline_inference(spark, sf):
    i = F.col("doc_id")
    day = lambda m, d: F.concat(m.cast("string"), F.lit("月"), d.cast("string"), F.lit("日"))
    one, two = day(i % 14, i * 7 % 33), day(i * 5 % 15, i * 11 % 34)
    value = F.when(i % 3 == 0, F.concat(F.lit("截止"), one)).when(i % 3 == 1, F.concat(F.lit("2025年"), one)).otherwise(F.concat(F.lit("2025年"), one, F.lit("9:00至"), two))
    return read_table(spark, sf, "documents").select(i.alias("id"), text.infer_deadline(value, F.lit(2026)).alias("deadline"))


_ANY_SQL = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_KIND_SQL = f"""CASE WHEN {_ANY_SQL('title', evaluate.RESULT_WORDS)} THEN CASE WHEN {_ANY_SQL('title', ('名单', '公示'))} THEN '名单公示' ELSE '获奖结果' END WHEN v = 'positive' THEN CASE WHEN {_ANY_SQL('title', evaluate.COMPETITION_WORDS)} THEN '竞赛报名' ELSE '申报通知' END
  WHEN {_ANY_SQL('title', evaluate.TRAINING_WORDS)} THEN '培训会议' WHEN {_ANY_SQL('title', evaluate.COMPETITION_WORDS)} THEN '其他' WHEN {_ANY_SQL('title', evaluate.APPLICATION_WORDS)} THEN '申报通知' ELSE '其他' END"""


@query("title_adjudication", f"""WITH {NOTICES_SQL}, r AS (SELECT *, CASE id % 50 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'positive' WHEN 2 THEN 'stale' ELSE '' END AS v FROM notices),
  a AS (SELECT CASE v WHEN 'uncertain' THEN '其他' WHEN 'stale' THEN '申报通知' ELSE {_KIND_SQL} END AS content_type, CASE WHEN v = 'uncertain' THEN '不确定' WHEN v IN ('positive', 'stale') OR {_ANY_SQL('source', evaluate.INDUSTRY_SOURCES)} OR {_ANY_SQL('title', evaluate.INDUSTRY_TITLES)} THEN '是' ELSE '否' END AS related,
  CASE v WHEN 'uncertain' THEN '不确定' WHEN 'positive' THEN '是' ELSE '否' END AS actionable FROM r) SELECT content_type, related, actionable, actionable AS label, count(*) AS n FROM a GROUP BY ALL""")
def title_adjudication(spark, sf):
    i = F.col("id")
    verdict = F.when(i % 50 == 0, "uncertain").when(i % 50 == 1, "positive").when(i % 50 == 2, "stale")
    rows = notices(spark, sf).withColumn("a", evaluate.adjudicate(F.col("title"), F.col("source"), verdict))
    return rows.groupBy("a.content_type", "a.related", "a.actionable", "a.label").agg(F.count("*").alias("n"))


_STORED_SQL = "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '[broken' WHEN 2 THEN '{\"a\": 1}' ELSE CAST(to_json(string_split(coalesce(text, ''), ' ')) AS VARCHAR) END"


@query("stored_arrays", f"SELECT source, count(*) AS n, count(*) FILTER (WHERE s IS NOT NULL AND (NOT json_valid(s) OR json_type(CASE WHEN json_valid(s) THEN s END) <> 'ARRAY')) AS malformed, CAST(sum(CASE WHEN json_valid(s) AND json_type(s) = 'ARRAY' THEN json_array_length(s) ELSE 0 END) AS BIGINT) AS items, CAST(sum(CASE WHEN k > 2 THEN length(replace(coalesce(text, ''), ' ', '')) ELSE 0 END) AS BIGINT) AS chars FROM (SELECT source, text, doc_id % 6 AS k, {_STORED_SQL} AS s FROM documents) GROUP BY source")
def stored_arrays(spark, sf):
    """Words of the documents stored as JSON arrays, some of them broken, read back with recovery."""
    d = read_table(spark, sf, "documents")
    i = F.col("doc_id") % 6
    stored = F.when(i == 0, F.lit(None).cast("string")).when(i == 1, "[broken").when(i == 2, '{"a": 1}').otherwise(F.to_json(F.split(F.coalesce("text", F.lit("")), " ")))
    rows = d.select("source", stored.alias("s")).select("source", text.text_array(F.col("s")).alias("v"), text.array_problem(F.col("s")).alias("bad"))
    chars = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if("bad").alias("malformed"), F.sum(F.size("v")).cast("long").alias("items"), F.sum(chars).alias("chars"))


@query("fill_labels", "SELECT doc_id, CASE WHEN quality = 1 THEN '是' ELSE CASE WHEN toxic = 1 THEN '否' ELSE '不确定' END END AS label FROM labels")
def fill_labels(spark, sf):
    rows = read_table(spark, sf, "labels").withColumn("old", F.when(F.col("quality") == 1, "是").otherwise("  "))
    return rows.select("doc_id", evaluate.fill_label(F.col("old"), F.when(F.col("toxic") == 1, "否").otherwise("不确定")).alias("label"))


@query("parse_labels", "SELECT doc_id, CASE WHEN toxic = 1 THEN NULL ELSE quality = 1 END AS label FROM labels")
def parse_labels(spark, sf):
    yes, no = (F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("doc_id") % 4).cast("int") + 1) for words in ((" Yes", "是", "1", "TRUE "), ("否", "n", "False", " 0")))
    raw = F.when(F.col("toxic") == 1, F.when(F.col("doc_id") % 2 == 0, "不确定").otherwise(" ")).when(F.col("quality") == 1, yes).otherwise(no)
    return read_table(spark, sf, "labels").select("doc_id", evaluate.parse_label(raw).alias("label"))


def _extractions(spark, sf):
    lab = read_table(spark, sf, "labels")
    return lab.select(F.col("doc_id").alias("article_id"), (F.col("quality") == 1).alias("is_award_application"), F.concat(F.lit("a"), (F.col("doc_id") % 10).cast("string")).alias("award_name"))


@query("extraction_upsert_latest", "SELECT doc_id AS article_id, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'a' || (doc_id % 10) END AS award_name, CAST(1 AS BIGINT) AS created_seq FROM labels")
def extraction_upsert_latest(spark, sf):
    old = _extractions(spark, sf).select("article_id", "award_name", F.lit(1).cast("long").alias("created_seq"), F.lit(1).alias("seq"))
    new = old.where("article_id % 2 = 0").select("article_id", F.lit("new").alias("award_name"), F.lit(2).cast("long").alias("created_seq"), F.lit(2).alias("seq"))
    return state.upsert(old, new, "article_id", created="created_seq").drop("seq")


@query("left_join_extraction", f"WITH {ARTICLES_SQL} SELECT a.id, a.status, l.quality = 1 AS is_award_application, 'a' || (l.doc_id % 10) AS award_name FROM articles a LEFT JOIN labels l ON l.doc_id = a.id WHERE a.status IN ('ai_pending', 'ready_to_push') AND a.pipeline_version >= 2")
def left_join_extraction(spark, sf):
    rows = state.pending(articles(spark, sf), _extractions(spark, sf), ["ai_pending", "ready_to_push"])
    return rows.select("id", "status", "is_award_application", "award_name")


@query("status_transition", f"WITH {ARTICLES_SQL} SELECT id, CASE WHEN id % 5 = 0 THEN 'pushed' WHEN id % 5 = 1 THEN 'push_failed' ELSE status END AS status, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 'timeout' ELSE 'old' END AS last_error, CAST(attempt_count + CASE WHEN id % 5 = 1 THEN 1 ELSE 0 END AS INTEGER) AS attempt_count FROM articles")
def status_transition(spark, sf):
    base = articles(spark, sf).select("id", "status", "attempt_count", F.lit("").alias("ai_reason"), F.lit("old").alias("last_error"), F.col("created_at").alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("pushed_at"))
    hit = base.where("id % 5 < 2")
    good = F.col("id") % 5 == 0
    changes = hit.select("id", F.when(good, "pushed").otherwise("push_failed").alias("status"), F.when(~good, "timeout").alias("last_error"), (~good).alias("increment"), good.alias("pushed"), good.alias("clear_error"))
    return state.transition(base, changes, F.lit("2026-08-01 00:00:00").cast("timestamp_ntz")).select("id", "status", "last_error", "attempt_count")


@query("snapshot_commits", f"WITH {ARTICLES_SQL} SELECT id, CASE WHEN status = 'ready_to_push' THEN 'pushed' ELSE status END AS status, CAST(attempt_count + CASE WHEN status = 'push_failed' THEN 1 ELSE 0 END AS INTEGER) AS attempt_count FROM articles")
def snapshot_commits(spark, sf):
    """Transitions of pending and failed notices committed to a keyed table: two versions, each rewriting the buckets of its keys."""
    base = articles(spark, sf).select("id", "status", "attempt_count", F.lit("").alias("ai_reason"), F.lit("old").alias("last_error"), F.col("created_at").alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("pushed_at"))
    table = snapshots.Table.create(spark, fresh_path(spark), base, "id", 10_000)
    now = F.lit("2026-08-01 00:00:00").cast("timestamp_ntz")
    for status, changes in (("ready_to_push", [F.lit("pushed").alias("status"), F.lit(True).alias("pushed")]), ("push_failed", [F.lit(True).alias("increment")])):
        hit = table.read().where(F.col("status") == status).select("id", *changes)
        table.change(hit, lambda part: state.transition(part, hit, now))  # noqa: B023  run at once
    return table.read().select("id", "status", "attempt_count")


@query("provenance_audit", f"WITH {ARTICLES_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN 'better' ELSE source END AS source, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 'old; ' ELSE '' END || '来源升级: ' || source || ' -> better; 原因: rank' ELSE CASE WHEN id % 2 = 0 THEN 'old' END END AS ai_reason FROM articles")
def provenance_audit(spark, sf):
    rows = articles(spark, sf).select("id", "source", "url", "publish_date", F.when(F.col("id") % 2 == 0, "old").alias("ai_reason"), F.lit("").alias("canonical_url"), F.lit("").alias("dedup_key"), F.col("title").alias("normalized_title"), F.col("created_at").alias("updated_at"))
    changes = rows.where("id % 3 = 0").select("id", F.lit("better").alias("source"), F.lit("http://x/y").alias("url"), F.lit("rank").alias("reason"))
    return state.update_provenance(rows, changes, F.lit("2026-08-01 00:00:00").cast("timestamp_ntz")).select("id", "source", "ai_reason")


@query("push_batches_of_10", f"WITH {ARTICLES_SQL} SELECT id, (row_number() OVER (ORDER BY id) - 1) // 10 AS batch_no FROM articles WHERE status = 'ready_to_push'")
def push_batches_of_10(spark, sf):
    return state.batches(articles(spark, sf).where("status = 'ready_to_push'").select("id"))


_LINES_SQL = "'📌 ' || title || chr(10) || '来源：' || source || ' | 日期：' || publish_date || chr(10) || '摘要：' || coalesce(nullif(substr(summary, 1, 200), ''), '无摘要') || chr(10) || CASE WHEN id % 3 = 0 THEN '奖项：A' || chr(10) ELSE '' END || '截止：2026-08-31' || chr(10) || '申报对象：x、y' || chr(10) || '🔗 ' || url || chr(10) || repeat('━', 16)"


@query("message_rendering", f"WITH {ARTICLES_SQL}, b AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 10 AS batch_no FROM articles WHERE status = 'ready_to_push') SELECT batch_no, '📰 报奖信息监测 (本次发现 ' || count(*) || ' 条)' || chr(10) || string_agg({_LINES_SQL}, chr(10) ORDER BY id) AS content, count(*) AS n FROM b GROUP BY batch_no")
def message_rendering(spark, sf):
    award = F.when(F.col("id") % 3 == 0, "A")
    rows = articles(spark, sf).where("status = 'ready_to_push'").select("id", "title", "source", "publish_date", "summary", "url", award.alias("award_name"), F.lit("2026-08-31").alias("deadline_date"), F.lit("").alias("deadline_text"), F.array(F.lit("x"), F.lit("y")).alias("applicant_scope"))
    return state.render(state.batches(rows))


@query("legacy_export", f"WITH {ARTICLES_SQL} SELECT id, title, source, status, '' AS verdict, '' AS note FROM articles WHERE pipeline_version = 1 AND status = 'ai_confirmed'")
def legacy_export(spark, sf):
    rows = articles(spark, sf).where("pipeline_version = 1 and status = 'ai_confirmed'")
    return rows.orderBy("created_at", "id").select("id", "title", "source", "status", F.lit("").alias("verdict"), F.lit("").alias("note"))


@query("migrate_v1", f"WITH {ARTICLES_SQL} SELECT id, regexp_replace(lower(title), '\\s+', '', 'g') AS normalized_title, {_CANON_SQL} AS canonical_url, status, 1 AS pipeline_version, 0 AS attempt_count FROM articles")
def migrate_v1(spark, sf):
    old = articles(spark, sf).select("id", "title", "url", "source", "publish_date", "summary", "raw_content", "status", F.lit("").alias("ai_reason"), "created_at", F.lit(None).cast("timestamp_ntz").alias("pushed_at"))
    return state.migrate_v1(old).select("id", "normalized_title", "canonical_url", "status", "pipeline_version", "attempt_count")


@query("benchmark_sample", f"WITH {ARTICLES_SQL} SELECT id, status FROM articles WHERE status IN ('pushed', 'ai_rejected') ORDER BY CASE status WHEN 'pushed' THEN 0 ELSE 1 END, id LIMIT 6")
def benchmark_sample(spark, sf):
    rows = articles(spark, sf).where("status in ('pushed', 'ai_rejected')").select("id", "status")
    return rows.orderBy(F.when(F.col("status") == "pushed", 0).otherwise(1), "id").limit(6)


@query("worker_benchmark", "SELECT CAST(coalesce(min(n_nationkey + 1), 1) AS INTEGER) AS workers FROM nation WHERE n_nationkey > 0 AND 1 + n_nationkey * 0.05 >= 1.3 AND n_nationkey % 3 = 0 AND n_nationkey % 2 = 0 AND (n_nationkey % 4 = 0) = (SELECT n_nationkey % 4 = 0 FROM nation WHERE n_nationkey = 0)")
def worker_benchmark(spark, sf):
    i = F.col("n_nationkey")
    rows = read_table(spark, sf, "nation").select((i + 1).cast("int").alias("workers"), (1 + i * 0.05).alias("speedup"), (i % 3).cast("int").alias("errors"), (i % 2).cast("int").alias("invalid"), F.array(F.lit(True), i % 4 == 0).alias("decisions"))
    return evaluate.recommend_workers(rows)


_ASKED_OF = "(length(title) + 1 + length(substr(coalesce(nullif(raw_content, ''), summary), 1, 4000))) % 3 = 0"


@query("worker_benchmark_runs", f"WITH {ARTICLES_SQL} SELECT CAST(w AS INTEGER) AS workers, count(*) AS n, count(*) FILTER (WHERE {_ASKED_OF}) AS confirmed, CAST(0 AS BIGINT) AS errors, CAST(0 AS BIGINT) AS invalid, true AS alike FROM articles, (VALUES (1), (2), (4)) v(w) WHERE status = 'ai_pending' GROUP BY w")
def worker_benchmark_runs(spark, sf):
    """Notices judged with one, two and four workers, measured; what doesn't depend on the clock."""
    rows = articles(spark, sf).where("status = 'ai_pending'")
    runs = reply.benchmark(rows, _stub_model, 2026, repeats=1)
    return runs.select("workers", "n", "confirmed", "errors", "invalid", (F.col("decisions") == runs.first().decisions).alias("alike"))


@query("inspect_rows", f"WITH {ARTICLES_SQL} SELECT id, status FROM articles WHERE contains(title || ' ' || summary || ' ' || raw_content, 'idiot') OR contains(title || ' ' || summary || ' ' || raw_content, 'scum') OR id IN (3, 8)")
def inspect_rows(spark, sf):
    return state.matching(articles(spark, sf), ["idiot", "scum"], [3, 8]).select("id", "status")


@query("article_lookup", f"WITH {ARTICLES_SQL} SELECT id, status, url FROM articles WHERE id = 8")
def article_lookup(spark, sf):
    return state.article_by_id(articles(spark, sf), 8).select("id", "status", "url")


@query("search_urls", "SELECT r_regionkey, 'https://s.example.com/w?type=2&query=' || replace('award ' || r_name || '/x', ' ', '%20') || CASE WHEN r_regionkey > 1 THEN '&page=' || r_regionkey ELSE '' END AS url FROM region")
def search_urls(spark, sf):
    query = F.concat(F.lit("award "), F.col("r_name"), F.lit("/x"))
    return read_table(spark, sf, "region").select("r_regionkey", urls.search_url(F.lit("https://s.example.com/w?type=2&query={}"), query, F.col("r_regionkey")).alias("url"))


@query("request_signatures", "SELECT n_nationkey, md5('a=' || n_nationkey || '&k=' || n_name || (1700000000000 + n_nationkey) || 'secret') AS sign FROM nation")
def request_signatures(spark, sf):
    parameters = F.create_map(F.lit("k"), F.col("n_name"), F.lit("a"), F.col("n_nationkey").cast("string"), F.lit("blank"), F.lit(" "))
    return read_table(spark, sf, "nation").select("n_nationkey", urls.sign_parameters(parameters, F.lit(1700000000000) + F.col("n_nationkey"), F.lit("secret")).alias("sign"))


@query("error_sources", f"WITH {RUNS_SQL} SELECT source, count(*) AS n FROM runs WHERE status IN ('failed', 'partial', 'anomaly') GROUP BY source")
def error_sources(spark, sf):
    return source_runs(spark, sf).where(run_log.has_error(F.col("status"))).groupBy("source").agg(F.count("*").alias("n"))


@query("jsonp_scan", "SELECT 'src' AS source, CAST(doc_id AS INTEGER) AS n, 't' || doc_id AS title, 'http://x/' || doc_id AS url FROM documents")
def jsonp_scan(spark, sf):
    i = F.col("doc_id").cast("string")
    item = F.concat(F.lit("{'title':'t"), i, F.lit("','url':'http://x:80/"), i, F.lit("'}"))
    body = F.concat(F.lit("cb({'success':{'list':["), item, F.lit(",{'title':'','url':'y'}]}})"))
    pages = read_table(spark, sf, "documents").select(F.lit("src").alias("source"), body.alias("body"))
    return files.jsonp_rows(pages).select("source", F.substring("title", 2, 20).cast("int").alias("n"), "title", "url")


_ANCHORS_SQL = "regexp_extract_all(html, '<a [^>]*href=\"[^\"]*\"[^>]*>([^<]*)</a>', 1)"


@query("html_links", f"SELECT page_id, CAST(len(t) AS BIGINT) AS links, CAST(len(t) AS BIGINT) AS nav_wide, CAST(len(t) AS BIGINT) AS nav_narrow, list_max(list_transform(t, lambda x: trim(replace(x, '&amp;', '&')))) AS last_title FROM (SELECT page_id, {_ANCHORS_SQL} AS t FROM pages WHERE contains(html, '<a '))")
def html_links(spark, sf):
    links = read_table(spark, sf, "pages").select("page_id", F.explode(html.links_column()("html")).alias("l"))
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if("l.nav_wide").alias("nav_wide"), F.count_if("l.nav_narrow").alias("nav_narrow"), F.max("l.title").alias("last_title"))


_LISTED_SQL = """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+') AS site, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS hrefs, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS titles FROM pages),
  l AS (SELECT page_id, site || unnest(hrefs) AS url, replace(unnest(titles), '&amp;', '&') AS title, unnest(range(len(hrefs))) AS pos FROM p) SELECT page_id, title, url FROM l WHERE length(title) >= {least} QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pos) = 1"""


def _list_pages(spark, sf):
    """Pages whose navigation is a list of notices."""
    return read_table(spark, sf, "pages").withColumn("html", F.replace(F.replace("html", F.lit("<nav>"), F.lit("<div class='list'>")), F.lit("</nav>"), F.lit("</div>")))


@query("list_page_wide", _LISTED_SQL.format(least=6))
def list_page_wide(spark, sf):
    pages = _list_pages(spark, sf).withColumn("links", html.links_column(html.LIST_SELECTORS)("html"))
    return filters.link_rows(pages, "wide", []).select("page_id", "title", "url")


@query("list_page_narrow", _LISTED_SQL.format(least=8))
def list_page_narrow(spark, sf):
    pages = _list_pages(spark, sf).withColumn("links", html.links_column()("html"))
    return filters.link_rows(pages, "narrow", []).select("page_id", "title", "url")


_READABLE_SQL = "trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query("html_text", f"SELECT page_id, CAST(length(c) AS INTEGER) AS chars, substr(c, 1, 500) AS summary FROM (SELECT page_id, substr({_READABLE_SQL}, 1, 5000) AS c FROM pages)")
def html_text(spark, sf):
    body = html.readable_column("html")
    return read_table(spark, sf, "pages").select("page_id", body.alias("content")).select("page_id", F.length("content").alias("chars"), F.substring("content", 1, 500).alias("summary"))


@query("next_pages", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '^[a-z]+://[^/]+') || '/p?n=2' WHEN 1 THEN 'http://other.example.com/q' END AS next_url FROM pages")
def next_pages(spark, sf):
    """Pages with a next link by text, by its relation, or with none."""
    link = F.when(F.col("page_id") % 3 == 0, "<a href='/p?n=2'>下一页</a></article>").when(F.col("page_id") % 3 == 1, "<a rel='next' href='http://other.example.com/q'>more</a></article>").otherwise("</article>")
    return read_table(spark, sf, "pages").withColumn("html", F.replace("html", F.lit("</article>"), link)).select("page_id", html.next_page_column("html", "url").alias("next_url"))


_SCAN_SQL = """WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS source, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) ORDER BY page_id) AS page_num, page_id % 17 = 0 AS broken, html FROM pages),
  i AS (SELECT source, page_num, unnest(h) AS url, unnest(range(len(h))) AS pos FROM (SELECT source, page_num, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS h FROM p WHERE NOT broken)),
  n AS (SELECT source, page_num, row_number() OVER (PARTITION BY source, url ORDER BY page_num, pos) = 1 AS fresh FROM i), c AS (SELECT source, page_num, count(*) AS items, count(*) FILTER (WHERE fresh) AS new FROM n GROUP BY ALL),
  f AS (SELECT p.source, p.page_num, p.broken, coalesce(items, 0) AS items, coalesce(new, 0) AS new FROM p LEFT JOIN c ON c.source = p.source AND c.page_num = p.page_num),
  e AS (SELECT source, min(page_num) FILTER (WHERE broken) AS b, min(page_num) FILTER (WHERE NOT broken AND items = 0) AS z, min(page_num) FILTER (WHERE page_num > 1 AND items > 0 AND new = 0) AS s, max(page_num) + 1 AS after FROM f GROUP BY source),
  g AS (SELECT *, least(coalesce(b, after), coalesce(z, after), coalesce(s, after)) AS stop FROM e), k AS (SELECT n.source, count(*) AS articles FROM n JOIN g ON g.source = n.source WHERE fresh AND page_num < stop GROUP BY n.source)
  SELECT g.source, CASE WHEN b = stop AND coalesce(articles, 0) = 0 THEN 'failed' WHEN b = stop THEN 'partial' WHEN z = 1 AND stop = 1 THEN 'empty' ELSE 'success' END AS status, coalesce(articles, 0) AS articles FROM g LEFT JOIN k ON k.source = g.source"""


@query("paged_scan_status", _SCAN_SQL)
def paged_scan_status(spark, sf):
    i = F.col("page_id")
    pages = read_table(spark, sf, "pages").withColumn("source", urls.host(F.col("url"))).withColumn("page_num", F.row_number().over(Window.partitionBy("source").orderBy("page_id")))
    pages = pages.withColumn("fetch_error", F.when(i % 17 == 0, "timeout"))
    links = pages.where("fetch_error is null").select("source", "page_num", F.explode(html.links_column()("html")).alias("l"))
    items = links.select("source", "page_num", F.col("l.pos").alias("pos"), F.col("l.href").alias("url"))
    return scan.scan(pages, items)[1]


@query("stream_scan_status", _SCAN_SQL)
def stream_scan_status(spark, sf):
    """The same scans as a stream that plans a page once the page before is judged; pages behind a stop are never asked for."""
    i = F.col("page_id")
    site = read_table(spark, sf, "pages").withColumn("source", urls.host(F.col("url"))).withColumn("page_num", F.row_number().over(Window.partitionBy("source").orderBy("page_id")))
    landed = cut(site.select("source", "page_num", "url", F.when(i % 17 != 0, F.col("html")).alias("body"), F.when(i % 17 == 0, "timeout").alias("fetch_error")))
    links = html.links_column()

    def parse(pages):
        found = pages.select("source", "page_num", F.explode(links("body")).alias("l"))
        return found.select("source", "page_num", F.col("l.pos").alias("pos"), F.col("l.href").alias("url"))

    with tempfile.TemporaryDirectory() as verdicts:  # read by this driver's planner alone
        out = fresh_path(spark)
        query = page_stream.stream_scan(spark, landed, parse, out, verdicts, cut, landed=landed)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    return page_stream.scanned(spark, out)[1]


@query("reply_parse", "SELECT conv_id, turn, CASE WHEN k = 0 THEN true WHEN k = 1 THEN false END AS decision, CASE WHEN k < 2 THEN '' ELSE 'invalid_response' END AS error_kind, CASE WHEN k < 2 THEN '2026-08-31' ELSE '' END AS deadline_date FROM (SELECT conv_id, turn, (conv_id + turn) % 4 AS k FROM conversations)")
def reply_parse(spark, sf):
    c = read_table(spark, sf, "conversations")
    i = F.col("conv_id") + F.col("turn")
    flag = F.when(i % 4 == 0, "true").when(i % 4 == 1, "false").when(i % 4 == 2, '"false"').otherwise("null")
    body = F.concat(F.lit('<think>x</think>```json\n{"is_award_application": '), flag, F.lit(', "deadline_text": "8月31日", "reason": '), F.to_json(F.array(F.coalesce("text", F.lit("")))), F.lit("}\n``` trailing"))
    rows = c.select("conv_id", "turn", reply.parse_column(2026)(body).alias("r"))
    return rows.select("conv_id", "turn", "r.decision", "r.error_kind", "r.deadline_date")


_ASKED_SQL = _ASKED_OF


@query("decision_summary", f"WITH {ARTICLES_SQL} SELECT count(*) FILTER (WHERE {_ASKED_SQL}) AS confirmed, count(*) FILTER (WHERE NOT {_ASKED_SQL}) AS rejected, CAST(0 AS BIGINT) AS pending FROM articles WHERE status = 'ai_pending'")
def decision_summary(spark, sf):
    rows = articles(spark, sf).where("status = 'ai_pending'")
    return reply.decision_summary(reply.judge(rows, _stub_model, 2026, workers=2))


def _stub_model(prompt: str) -> str:
    """A deterministic stand-in for the model."""
    return '{"is_award_application": %s, "reason": "stub"}' % ("true" if len(prompt) % 3 == 0 else "false")


@query("monitor_screen", f"WITH {NOTICES_SQL}, g AS (SELECT id, {_GATE_SQL} AS reason, contains(title, '规划') OR contains(title, '竞赛') AS hit FROM notices WHERE status <> 'pushed') SELECT id, CASE WHEN reason = 'pass' AND hit THEN 'ai_pending' ELSE 'keyword_rejected' END AS status FROM g")
def monitor_screen(spark, sf):
    empty = lambda t: F.lit(None).cast(t)
    rows = notices(spark, sf).where("status <> 'pushed'").select(
        "id", "title", "source", "publish_date", F.lit("").alias("summary"), F.lit("discovered").alias("status"), F.lit(2).alias("pipeline_version"), F.lit(0).alias("attempt_count"),
        empty("string").alias("ai_reason"), empty("string").alias("last_error"), F.col("created_at").alias("updated_at"), empty("timestamp_ntz").alias("pushed_at"),
    )
    return monitor.screen(rows, ["规划", "竞赛"], [], today(), F.lit(_NOW).cast("timestamp_ntz")).select("id", "status")


@query("delivery_results", f"WITH {ARTICLES_SQL}, b AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 10 AS batch_no FROM articles WHERE status = 'ready_to_push') SELECT id, batch_no, count(*) OVER (PARTITION BY batch_no) = 10 AS success FROM b")
def delivery_results(spark, sf):
    rows = articles(spark, sf).where("status = 'ready_to_push'").select("id", "title", "source", "summary", "url", F.lit("").alias("deadline_date"), F.lit("").alias("deadline_text"), F.array().cast("array<string>").alias("applicant_scope"))
    return sinks.deliver(rows, _full_only, delay=0.0).select("id", "batch_no", "success")


def _full_only(content: str) -> str | None:
    """A sender that takes only messages of ten notices."""
    return None if content.count("📌 ") == 10 else "refused"


@query("event_time_queue", f"WITH {NOTICES_SQL} SELECT id, CASE WHEN p <> '' THEN p ELSE s END AS event_date, CASE WHEN p <> '' THEN 'published_at' WHEN s <> '' THEN 'first_seen_at' ELSE 'unknown' END AS event_time_basis FROM (SELECT id, {_LENIENT.format(c='publish_date')} AS p, CASE WHEN id % 4 = 0 THEN '' ELSE strftime(created_at, '%Y-%m-%d') END AS s FROM notices)")
def event_time_queue(spark, sf):
    rows = notices(spark, sf)
    seen = rows.where("id % 4 <> 0").select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("first_seen_at"))
    return monitor.event_time_queue(rows.select("id", "publish_date"), seen).select("id", "event_date", "event_time_basis")


@query("detail_counts", f"WITH {RUNS_SQL}, d AS (SELECT source, count(*) FILTER (WHERE status = 'success') AS detail_success, count(*) FILTER (WHERE status <> 'success') AS detail_failed FROM runs WHERE status <> 'empty' GROUP BY source) SELECT r.source, coalesce(d.detail_success, 0) AS detail_success, coalesce(d.detail_failed, 0) AS detail_failed FROM (SELECT DISTINCT source FROM runs) r LEFT JOIN d ON d.source = r.source")
def detail_counts(spark, sf):
    runs = source_runs(spark, sf)
    good = F.col("status") == "success"
    counts = runs.where("status <> 'empty'").groupBy("source").agg(F.count_if(good).alias("detail_success"), F.count_if(~good).alias("detail_failed"))
    return monitor.detail_counts(runs.select("source").distinct(), counts)


_REPLAY_GATE_SQL = _GATE_SQL[: _GATE_SQL.index("year(coalesce")] + "2026, false) THEN 'stale_year'" + _GATE_SQL[_GATE_SQL.index("THEN 'stale_year'") + len("THEN 'stale_year'") :]


@query("replay_predictions", f"WITH {NOTICES_SQL}, g AS (SELECT nullif({_REPLAY_GATE_SQL}, 'pass') AS gate, (length(title) + 1) % 3 = 0 AS hit FROM notices) SELECT gate, gate IS NULL AND hit AS predicted, count(*) AS n FROM g GROUP BY ALL")
def replay_predictions(spark, sf):
    rows = notices(spark, sf).select("id", "title", "source", F.lit("2026-07-07").alias("event_date"))
    return monitor.replay(rows, _stub_model).groupBy("gate", "predicted").agg(F.count("*").alias("n"))
