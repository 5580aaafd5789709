import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.operators import reply
from tidewater.plans import config, monitor, run, runs
from tidewater.storage import cut
from tidewater.schemas import ARTICLE, EXTRACTION
from tidewater.sources import sinks

T0 = dt.datetime(2026, 7, 30, 10)


def article(i, title, source="城市规划学会", status="discovered", version=2, created=T0):
    return (i, title, title, f"http://x/{i}", f"http://x/{i}", "", source, "2026-07-01", "", "正文" * 100, status, None, None, 0, version, created, created, None)


def now(hours):
    return F.lit((T0 + dt.timedelta(hours=hours)).isoformat(sep=" ")).cast("timestamp")


def model(prompt):
    if "报名" in prompt:
        raise ConnectionError("down")
    return '{"is_award_application": %s, "award_name": "规划奖", "reason": "r"}' % ("false" if "推荐" in prompt else "true")


def test_run_from_discovery_to_delivery(spark):
    rows = [
        article(1, "2026年规划奖申报"), article(2, "2026年规划奖获奖名单公示"), article(3, "2026年规划奖推荐"), article(4, "2026年规划大赛报名"),
        article(5, "2026年规划奖申报", "资讯聚合"), article(6, "2026年规划奖申报", version=1),
    ]
    articles = spark.createDataFrame(rows, ARTICLE)
    extractions = spark.createDataFrame([], EXTRACTION)
    articles = cut(monitor.screen(articles, ["奖", "赛"], [], F.lit("2026-07-10").cast("date"), now(0)))
    state = lambda: {r.id: r.status for r in articles.collect()}
    assert state() == {1: "ai_pending", 2: "keyword_rejected", 3: "ai_pending", 4: "ai_pending", 5: "ai_pending", 6: "discovered"}
    articles, extractions = monitor.judge(articles, extractions, model, 2026, now(1), cut, workers=4)
    articles, extractions = cut(articles), cut(extractions)
    got = {r.id: r for r in articles.collect()}
    assert got[4].status == "ai_pending" and got[4].attempt_count == 1 and got[4].last_error
    assert got[1].status == "ready_to_push" and got[3].status == "ai_rejected"  # called before the failing one, or by other workers
    extractions = cut(extractions.where("article_id <> 5").unionByName(extractions.where("article_id = 1").withColumn("article_id", F.lit(5).cast("long"))))
    articles = cut(articles.withColumn("status", F.when(F.col("id").isin(1, 5), "ready_to_push").otherwise(F.col("status"))))
    sources = spark.createDataFrame(config.source_rows({}), "name string, kind string, tier string, pos int")
    same = lambda: monitor.push(articles, extractions, sources, lambda c: None, now(2), cut, dry_run=True)
    assert {r.id: r.status for r in same().collect()} == state()
    failed = cut(monitor.push(articles, extractions, sources, lambda c: "refused", now(2), cut))
    got = {r.id: r for r in failed.collect()}
    assert (got[1].status, got[1].last_error, got[5].status) == ("push_failed", "refused", "source_superseded")
    done = {r.id: r for r in monitor.push(failed, extractions, sources, lambda c: None, now(3), cut).collect()}
    assert done[1].status == "pushed" and done[1].last_error is None and done[1].pushed_at is not None


def test_better_source_takes_over_without_a_second_message(spark):
    rows = [article(1, "2026年规划奖申报", "资讯聚合", "pushed"), article(2, "2026年规划奖申报", "城市规划学会", "ready_to_push")]
    sent = []
    sources = spark.createDataFrame([], "name string, kind string, tier string, pos int")
    got = {r.id: r for r in monitor.push(spark.createDataFrame(rows, ARTICLE), spark.createDataFrame([], EXTRACTION), sources, sent.append, now(1), cut).collect()}
    assert got[2].status == "source_superseded" and got[1].status == "pushed" and got[1].source == "城市规划学会" and "来源升级" in got[1].ai_reason and not sent


def test_aggregator_waits(spark):
    rows = spark.createDataFrame([article(1, "2026年规划奖申报", "资讯聚合", "ready_to_push")], ARTICLE)
    sources = spark.createDataFrame([], "name string, kind string, tier string, pos int")
    at = lambda h: monitor.push(rows, spark.createDataFrame([], EXTRACTION), sources, lambda c: None, now(h), cut).first().status
    assert at(23.9) == "ready_to_push" and at(24.1) == "pushed"


def test_enrich_counts_and_updates(spark):
    short = list(article(1, "t"))
    short[9] = ""
    rows = spark.createDataFrame([tuple(short), (2, *short[1:])], ARTICLE)
    pages = spark.createDataFrame([(1, "<article>" + "正文内容" * 20 + "</article>", "http://x/final")], "id long, html string, final_url string")
    updates, counts = monitor.enrich(rows, pages)
    assert [(r.id, r.url, len(r.summary)) for r in updates.collect()] == [(1, "http://x/final", 80)]
    assert tuple(counts.first())[1:] == (1, 1)


def test_watchdog_alerts_once(spark):
    at = dt.datetime(2026, 7, 31, 9)
    schedule = spark.createDataFrame([("morning", at)], "key string, scheduled_at timestamp")
    runs = spark.createDataFrame([], "run_time timestamp, status string")
    when = F.lit("2026-07-31 11:00:00").cast("timestamp")
    fresh, kept = monitor.watchdog(schedule, runs, spark.createDataFrame([], "key string"), when, cut)
    assert fresh.count() == 1
    again, _ = monitor.watchdog(schedule, runs, cut(kept), when, cut)
    assert again.count() == 0


def test_replay(spark):
    rows = spark.createDataFrame([(1, "2026年规划奖申报", "x", "2026-07-07"), (2, "2024年规划奖申报", "x", "2026-07-07")], "id long, title string, source string, event_date string")
    got = {r.id: (r.gate, r.predicted) for r in monitor.replay(rows, model).collect()}
    assert got == {1: (None, True), 2: ("stale_year", False)}


def test_rounds_of_a_replay_grow(spark):
    """The second round of a replay has twice the calls of the first, so many rows are few rounds."""
    rows = spark.range(300).select("id", F.format_string("2026年规划奖申报%d号", "id").alias("title"), F.lit("x").alias("source"), F.lit("2026-07-07").alias("event_date"))
    dealt = rows.repartition(2, "id").withColumn("w", F.spark_partition_id()).orderBy("id").collect()
    own = [[r.id for r in dealt if r.w == w] for w in (0, 1)]
    bad = f"报{own[0][reply.CALLS + 5]}号"

    def down(prompt):
        if bad in prompt:
            raise ConnectionError("down")
        return '{"is_award_application": true}'

    got = {r.id for r in monitor.replay(rows, down).where("predicted").collect()}
    assert got == {*own[0][: reply.CALLS + 5], *own[1][: 3 * reply.CALLS]}


def test_answers_are_decoded_by_all_cores(spark):
    """Answers that are much alike weigh little, and still one task doesn't decode them all."""
    rows = spark.range(3000).select("id", F.lit("x").alias("title"), F.lit("").alias("raw_content"), F.lit("").alias("summary"))
    judged = reply.judge(rows, lambda prompt: '{"is_award_application": true}', 2026, workers=2)
    got = judged.where("decision").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in got) == 3000 and len(got) == max(2, spark.sparkContext.defaultParallelism)


def test_sinks():
    assert sinks.signature("1", "s") == sinks.signature("1", "s") != sinks.signature("2", "s")
    answers = iter(["busy", None])
    assert sinks.send_with_retry(lambda c: next(answers), "x", sleep=lambda s: None) is None
    text = sinks.report({"precision": 0.5, "recall": None}, {"precision": (0.4, 0.6)})
    assert "| precision | 0.5000 | 0.4000 to 0.6000 |" in text and "| recall | - |  |" in text


SITES = {"sources": {"websites": [{"name": "城市规划学会", "url": "u"}, {"name": "坏站", "url": "u"}, {"name": "资讯聚合", "url": "u", "source_tier": "aggregator"}], "wechat_accounts": [{"name": "规划视界", "keyword": "k"}]}, "filter": {"keywords": ["奖"], "ai": {"max_workers": 1}}}
ROWS = "title string, url string, publish_date string, summary string, raw_content string"


def scans(spark, **found):
    """Scans by source: rows (title, url, content), or an error."""

    def of(name, rows):
        def scan():
            if isinstance(rows, Exception):
                raise rows
            table = spark.createDataFrame([(t, u, "2026-07-01", "", body) for t, u, body in rows], ROWS)
            kind = "source string, status string, articles long, raw_count long, matched_count long"
            return table, spark.createDataFrame([(name, "success" if rows else "empty", len(rows), len(rows) + 2 if name == "规划视界" else None, len(rows))], kind)

        return scan

    return {name: of(name, rows) for name, rows in found.items()}


def first_tables(spark):
    log, health = runs.empty_logs(spark)
    return run.Tables(spark.createDataFrame([], ARTICLE), spark.createDataFrame([], EXTRACTION), log, health)


def test_a_whole_run(spark, tmp_path):
    long = "正文" * 100
    found = scans(
        spark, 城市规划学会=[("2026年规划奖申报", "http://x/1", long), ("2026年规划奖名单公示", "http://x/2", long), ("2026年规划奖申报", "http://x/1?utm_source=z", long)],
        坏站=RuntimeError("layout"), 资讯聚合=[("2026年建设奖申报", "http://y/1", "短"), ("2026年规划奖申报 ", "http://x/1#top", long)], 规划视界=[],
    )
    writes, sent = [], []

    def write(df):
        writes.append(df.columns)
        return cut(df)

    def pages(short):
        return short.select("id", F.lit("<html><body><article>" + "建设奖申报通知正文" * 40 + "</article></body></html>").alias("html"), F.lit("http://y/final").alias("final_url"))

    def two_awards(prompt):
        return model(prompt).replace("规划奖", "建设奖") if "建设奖" in prompt else model(prompt)

    outside = run.Outside(two_awards, lambda c: sent.append(c), pages, lambda s: None)  # alerts are sent by the driver, so they would show here
    metrics = f"file://{tmp_path}/m"
    tables, told = run.run_pipeline(spark, SITES, first_tables(spark), found, outside, now(0), F.lit("2026-07-10").cast("date"), 2026, metrics_path=metrics, write=write)
    assert (told["status"], told["total_articles"], told["new_articles"], told["keyword_passed"], told["ai_confirmed"], told["pushed"]) == ("completed_with_errors", 5, 3, 2, 2, 1)
    assert told["errors"] == ["坏站: RuntimeError: layout"] and told["alerts"] == []
    got = {r.url: r for r in tables.articles.collect()}
    # the aggregator's own report waits; what it repeats of another source is that source's
    assert {u: r.status for u, r in got.items()} == {"http://x/1": "pushed", "http://x/2": "keyword_rejected", "http://y/final": "ready_to_push"}
    assert got["http://y/final"].raw_content.startswith("建设奖") and got["http://y/final"].canonical_url == "http://y/final"
    rows = {r.source: r for r in tables.source_runs.collect()}
    assert {s: (r.status, r.new_count, r.source_type, r.detail_success) for s, r in rows.items()} == {
        "城市规划学会": ("success", 2, "website", 0), "坏站": ("failed", 0, "website", 0), "资讯聚合": ("success", 1, "website", 1), "规划视界": ("no_match", 0, "wechat", 0)}
    assert [(r.source, r.raw_count, r.matched_count, r.status) for r in spark.read.json(metrics).collect()] == [("规划视界", 2, 0, "no_match")]
    row = tables.run_log.first()
    assert row.status == "completed_with_errors" and row.errors == told["errors"] and row.pushed == 1
    # whole tables of articles are written when notices are screened and at the end, new rows once for all sources
    assert sum(c == tables.articles.columns for c in writes) == 3
    # an hour later nothing is new; a day later the aggregator's report is due
    tables, told = run.run_pipeline(spark, SITES, tables, found, outside, now(1), F.lit("2026-07-10").cast("date"), 2026)
    assert (told["new_articles"], told["pushed"]) == (0, 0)
    early = SITES | {"notification": {"aggregator_delay_hours": 2}}
    tables, told = run.run_pipeline(spark, early, tables, found, outside, now(3), F.lit("2026-07-10").cast("date"), 2026, dry_run=True)
    assert told["pushed"] == 0 and told["alerts"] == [] and not sent
    tables, told = run.run_pipeline(spark, early, tables, found, outside, now(4), F.lit("2026-07-10").cast("date"), 2026)
    assert told["pushed"] == 1 and told["alerts"] == []  # a source has failed four times; the third, at which it is told, was the dry run
    with pytest.raises(run.RunFailed) as broken:
        run.run_pipeline(spark, SITES | {"filter": {"keywords": ["("]}}, tables, scans(spark, 城市规划学会=[("2026年新奖申报", "http://x/9", long)]), outside, now(5), F.lit("2026-07-10").cast("date"), 2026)
    assert {r.id: r.status for r in broken.value.tables.run_log.collect()}[5] == "failed" and broken.value.tables.articles.count() == 4


def test_runs_of_failing_sources(spark):
    waits, sent = [], []
    outside = run.Outside(model, lambda c: sent.append(c), None, waits.append)
    bad = scans(spark, 坏站=RuntimeError("layout"), 资讯聚合=RuntimeError("gone"))
    call = lambda tables, hours, found, **more: run.run_pipeline(spark, SITES, tables, found, outside, now(hours), F.lit("2026-07-10").cast("date"), 2026, **more)
    tables, told = call(first_tables(spark), 0, bad)
    assert waits == [1800.0, 5400.0] and told["status"] == "completed_with_errors" and "all sources failed, also after 2 more scans" in told["errors"]
    assert told["alerts"] == ["本次所有信息源抓取失败，请检查日志。"] and len(sent) == 1
    half = scans(spark, 坏站=RuntimeError("layout"), 资讯聚合=[])
    tables, told = call(tables, 1, half)
    assert told["alerts"] == [] and len(waits) == 2
    tables, told = call(tables, 2, half)
    assert told["alerts"] == ["以下渠道已连续失败3次：坏站"] and "⚠️" in sent[-1]
    tables, told = call(tables, 3, half)
    assert told["alerts"] == []  # told once
    tables, told = call(tables, 4, bad, source="坏站")
    assert len(waits) == 2 and {r.source for r in tables.source_runs.where("run_id = 5").collect()} == {"坏站"}  # a selected source isn't scanned again
    assert list(run.select_sources(SITES, bad, "website")) == ["坏站", "资讯聚合"] and list(run.select_sources(SITES, bad, "website:资讯聚合")) == ["资讯聚合"]
    with pytest.raises(run.RunFailed):
        call(tables, 5, bad, source="wechat")


def test_run_log(spark):
    log, health = runs.empty_logs(spark)
    log = runs.insert_run(log, now(0), {"pushed": 2})
    log, number = runs.start_run(log, now(1))
    assert number == 2 and [r.status for r in log.orderBy("id").collect()] == ["completed", "running"]
    states = lambda n, status: spark.createDataFrame([("a", "website", status, n)], "source string, source_type string, status string, article_count long")
    health = runs.record_sources(health, 1, states(4, "success"), now(0))
    health = runs.record_sources(health, 2, states(0, "empty"), now(1))
    assert [(r.id, r.status) for r in health.orderBy("id").collect()] == [(1, "success"), (2, "anomaly")]


def test_watchdog_state(spark, tmp_path):
    at = dt.datetime(2026, 7, 31, 9)
    schedule = spark.createDataFrame([("morning", at)], "key string, scheduled_at timestamp")
    none = spark.createDataFrame([], "run_time timestamp, status string")
    when = F.lit("2026-07-31 11:00:00").cast("timestamp")
    path, sent = str(tmp_path / "s" / "state.json"), []
    call = lambda send, **more: monitor.run_watchdog(schedule, none, path, when, send, cut, **more)
    assert call(sent.append, check_only=True) == ["morning"] and not sent
    assert call(lambda m: "down") == ["morning"] and monitor.read_alerted(path) == []
    assert call(sent.append) == ["morning"] and sent == ["morning"] and call(sent.append) == [] and sent == ["morning"]
    (tmp_path / "s" / "state.json").write_text("{")
    assert monitor.read_alerted(path) == []


def test_lock_and_log(tmp_path):
    from tidewater.sources import process

    one, two = process.ProcessLock(str(tmp_path / "l")), process.ProcessLock(str(tmp_path / "l"))
    with one:
        assert not two.acquire()
    assert two.acquire()
    two.release()
    found = process.logger("tidewater-test", str(tmp_path))
    found.info("x")
    assert process.logger("tidewater-test", str(tmp_path)) is found and len(found.handlers) == 1 and "INFO x" in (tmp_path / "tidewater-test.log").read_text()


def test_alerts_and_answers():
    sent = []
    assert sinks.alert("down", sent.append) is None and sent == ["⚠️ 报奖监测告警\ndown"]
    assert sinks.answer_error({"code": 0}) is None and sinks.answer_error({"code": 9, "msg": "no"}) == "no"
    assert sinks.payload("x", "1", "s")["sign"] == sinks.signature("1", "s") and "sign" not in sinks.payload("x")
    text = sinks.report({"f1": 1.0}, wrong=[{"id": 3, "title": "t", "error": "false_negative"}])
    assert "## false negatives: 1\n- 3: t" in text


GOOD = {"sources": {"websites": [{"name": "a", "url": "u"}]}, "filter": {"keywords": ["x"], "ai": {"api_url": "u", "model": "m"}}, "notification": {"feishu": {"webhook_url": "w"}}}


@pytest.mark.parametrize(
    "path, value",
    [
        (("sources",), None), (("sources", "websites"), []), (("sources", "websites"), [{"name": "a"}]), (("filter", "keywords"), []), (("filter", "ai", "max_workers"), 5),
        (("filter", "ai", "model"), ""), (("filter", "ai", "provider"), "other"), (("storage",), {"dedup_days": 0}), (("health",), {"all_failed_retry_delays_minutes": [-1]}), (("notification",), {}),
    ],
)
def test_config_rules(path, value):
    import copy

    bad = copy.deepcopy(GOOD)
    at = bad
    for p in path[:-1]:
        at = at[p]
    at[path[-1]] = value
    assert config.check(copy.deepcopy(GOOD)) and config.faults(GOOD) == []
    with pytest.raises(config.ConfigError):
        config.check(bad)


def test_all_faults_are_told(tmp_path):
    assert len(config.faults({"filter": {"ai": {"max_workers": 9}}, "storage": {"dedup_days": "x"}})) == 7
    assert config.faults({}, dry_run=True) and config.faults([]) and config.get({}, "notification.aggregator_delay_hours") == 24
    twice = GOOD | {"sources": {"websites": [{"name": "a", "url": "u"}, {"name": "a", "url": "v"}, {"name": "", "enabled": False}]}}
    assert config.faults(twice) == ["sources.websites: a name repeats"]
    (tmp_path / "c.yaml").write_text("storage: {db_path: data/x.db, other_path: /abs}\nsources: {}\n", encoding="utf-8")
    assert config.load(str(tmp_path / "c.yaml"))["storage"] == {"db_path": str(tmp_path / "data/x.db"), "other_path": "/abs"}
