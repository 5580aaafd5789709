"""A sink that sends nothing twice."""

import os
from collections import Counter

import pytest

from tidewater.sources import sinks

COLUMNS = "id long, title string, source string, publish_date string, summary string, url string"


def notices(spark, n):
    return spark.createDataFrame([(i, f"t{i}", "s", "2026-07-01", "", f"http://x/{i}") for i in range(n)], COLUMNS)


def sender(folder, crash=None, refuse=None):
    """Notes what arrives; dies after a content with `crash` has arrived, refuses those with `refuse`."""

    def send(content):
        with open(os.path.join(folder, os.urandom(6).hex()), "w") as f:
            f.write(content)
        if crash and crash in content:
            os._exit(1)
        return "busy" if refuse and refuse in content else None

    return send


def arrived(folder):
    return Counter(open(os.path.join(folder, f)).read() for f in os.listdir(folder))


def test_what_a_dead_task_sent_is_not_sent_again(spark, tmp_path):
    got, ledger = str(tmp_path / "got"), f"file://{tmp_path}/ledger"
    os.mkdir(got)
    rows = notices(spark, 35)
    with pytest.raises(Exception):  # noqa: B017  the task dies after the message has arrived
        sinks.deliver(rows, sender(got, crash="t12\n"), delay=0, ledger=ledger)
    before = arrived(got)
    assert any("t12\n" in c for c in before)
    told = sinks.deliver(rows, sender(got), delay=0, ledger=ledger).collect()
    assert len(told) == 35 and all(r.success for r in told)
    after = arrived(got)
    assert len(after) == 4 and set(after.values()) == {1}  # every message once, over both


def test_refused_messages_come_again(spark, tmp_path):
    got, ledger = str(tmp_path / "got"), f"file://{tmp_path}/ledger"
    os.mkdir(got)
    rows = notices(spark, 25)
    told = {r.id: (r.batch_no, r.success, r.error) for r in sinks.deliver(rows, sender(got, refuse="t12\n"), delay=0, ledger=ledger).collect()}
    assert told[12] == (1, False, "busy") and told[3] == (0, True, None) and told[24][1]
    again = {r.id: r.success for r in sinks.deliver(rows, sender(got), delay=0, ledger=ledger).collect()}
    assert all(again.values())
    counts = arrived(got)
    assert sorted(n for c, n in counts.items()) == [1, 1, 4]  # the refused one: three tries, then once more
    sent = sinks.deliver(rows.limit(0), sender(got), delay=0).collect()
    assert sent == []
