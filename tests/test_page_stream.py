"""A scan as a stream: what is fetched, where it stops, and that it goes on after a break."""

import os
from collections import Counter

from pyspark.sql import functions as F

from tidewater.sources import page_stream
from tidewater.storage import cut

#: Bodies (links, comma-separated) by URL; None fails and "!" raises.
SITE = {
    "a": ["x1,x2", "x3", "x1,x2", "x9"],  # page 3 brings nothing new
    "b": ["y1", None, "y2", "y3"],  # page 2 fails
    "c": ["z1", "z2", "", "z4"],  # page 3 is empty
    "d": [None, "w1", "w2", "w3"],  # fails at once
    "e": ["v1,v1", "v2", "v3", "v4"],  # goes to the end
    "f": ["!", "u1", "u2", "u3"],
    "g": ["", "t1", "t2", "t3"],
    "h": ["s1,s2", "s2,s3", "s3", "s9"],
}


def make_fetcher(log):
    site = {f"http://{s}/{p + 1}": body for s, pages in SITE.items() for p, body in enumerate(pages)}

    def fetch(url):
        with open(os.path.join(log, url.replace("/", "_") + f".{os.getpid()}.{os.urandom(4).hex()}"), "w"):
            pass
        body = site[url]
        if body == "!":
            raise ConnectionError("gone")
        return body, None if body is not None else "timeout"

    return fetch


def parse(pages):
    links = pages.select("source", "page_num", F.posexplode(F.split("body", ",")).alias("pos", "url"))
    return links.where("url <> ''")


def start(spark, tmp_path):
    plan = spark.createDataFrame([(s, p + 1, f"http://{s}/{p + 1}") for s, pages in SITE.items() for p in range(len(pages))], "source string, page_num int, url string")
    log = tmp_path / "log"
    log.mkdir(exist_ok=True)
    return page_stream.stream_scan(spark, plan, parse, str(tmp_path / "out"), str(tmp_path / "verdicts"), cut, fetcher=make_fetcher(str(log)))


def fetched(tmp_path):
    return Counter(f.name.split(".")[0].removeprefix("http:__") for f in (tmp_path / "log").iterdir())


def test_nothing_is_fetched_behind_a_stop(spark, tmp_path):
    query = start(spark, tmp_path)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert fetched(tmp_path) == Counter({f"{s}_{p}": 1 for s, last in {"a": 3, "b": 2, "c": 3, "d": 1, "e": 4, "f": 1, "g": 1, "h": 3}.items() for p in range(1, last + 1)})
    kept, state = page_stream.scanned(spark, str(tmp_path / "out"))
    assert {(r.source, r.status, r.articles) for r in state.collect()} == {("a", "success", 3), ("b", "partial", 1), ("c", "success", 2), ("d", "failed", 0), ("e", "success", 4), ("f", "failed", 0), ("g", "empty", 0), ("h", "success", 3)}
    assert sorted(r.url for r in kept.where("source in ('a', 'e', 'h')").collect()) == ["s1", "s2", "s3", "v1", "v2", "v3", "v4", "x1", "x2", "x3"]


def test_offsets_follow_from_verdicts(tmp_path):
    plan = [["a", p, f"u{p}"] for p in (1, 2, 3)] + [["b", 1, "v1"]]
    reader = page_stream._Reader(plan, str(tmp_path), None)
    assert reader.initialOffset() == {"a": 0, "b": 0} and reader.latestOffset() == {"a": 1, "b": 1}
    page_stream.write_verdicts(str(tmp_path), 0, [("a", 1, True), ("b", 1, True)])
    assert reader.latestOffset() == {"a": 2, "b": 1}  # b has no second page
    assert [(p.source, p.page_num, p.url) for p in reader.partitions({"a": 1, "b": 1}, {"a": 2, "b": 1})] == [("a", 2, "u2")]
    page_stream.write_verdicts(str(tmp_path), 1, [("a", 2, False)])
    assert page_stream._Reader(plan, str(tmp_path), None).latestOffset() == {"a": 2, "b": 1}  # a stopped, also for a reader that is started again
    page_stream.write_verdicts(str(tmp_path), 1, [("a", 2, True)])  # a batch that is run again replaces its verdicts
    assert reader.latestOffset() == {"a": 3, "b": 1}


def test_a_scan_goes_on_where_it_was_broken_off(spark, tmp_path):
    import time

    query = start(spark, tmp_path)
    while not list((tmp_path / "verdicts").glob("*.json")) if (tmp_path / "verdicts").exists() else True:
        time.sleep(0.2)
    query.stop()
    query = start(spark, tmp_path)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {s: max(int(k.split("_")[1]) for k in fetched(tmp_path) if k[0] == s) for s in "abcdefgh"} == {"a": 3, "b": 2, "c": 3, "d": 1, "e": 4, "f": 1, "g": 1, "h": 3}
    state = page_stream.scanned(spark, str(tmp_path / "out"))[1]
    assert {(r.source, r.articles) for r in state.collect()} == {("a", 3), ("b", 1), ("c", 2), ("d", 0), ("e", 4), ("f", 0), ("g", 0), ("h", 3)}
