"""Delivery: batches of notices through an injected sender, alerts, reports."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidewater.operators.state import batches, render
from tidewater.storage import cut, fresh_path


def signature(timestamp: str, secret: str) -> str:
    """What a signed webhook expects: an empty message keyed by time and secret."""
    return base64.b64encode(hmac.new(f"{timestamp}\n{secret}".encode(), b"", hashlib.sha256).digest()).decode()


def send_with_retry(send: Callable[[str], str | None], content: str, times: int = 3, sleep: Callable[[float], None] = time.sleep, delay: float = 2.0) -> str | None:
    """Error of the last try, or null; `send` returns an error or null, or raises."""
    error: str | None = "not sent"
    for attempt in range(times):
        try:
            error = send(content)
        except Exception as e:  # whatever the transport raises is an answer, not an end
            error = f"{type(e).__name__}: {e}"
        if error is None:
            return None
        if attempt + 1 < times:
            sleep(delay)
    return error


def alert_text(message: str) -> str:
    """What an alert says (its first line is fixed)."""
    return f"⚠️ 报奖监测告警\n{message}"


def alert(message: str, send: Callable[[str], str | None], sleep: Callable[[float], None] = time.sleep) -> str | None:
    """Send an alert; the error of the last try, or null."""
    return send_with_retry(send, alert_text(message), sleep=sleep)


def payload(content: str, timestamp: str | None = None, secret: str | None = None) -> dict:
    """A webhook's message, signed where there is a secret."""
    body = {"msg_type": "text", "content": {"text": content}}
    return body | {"timestamp": timestamp, "sign": signature(timestamp, secret)} if secret else body


def answer_error(answer: dict) -> str | None:
    """What a webhook's answer complains of; null for success."""
    if answer.get("StatusCode") == 0 or answer.get("code") == 0:
        return None
    return str(answer.get("msg", answer.get("StatusMessage", "unknown error")))


class Ledger:
    """Which contents have been sent, as small files in a folder that driver and executors share.

    A mark is made before a content is sent and another one after it. A content with
    the first mark alone was on its way when its task died; whether it arrived can't be
    known, so it isn't sent again.
    """

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _at(self, name: str):
        from pyarrow import fs

        plain = re.sub("^file:/*", "/", self.folder)
        system, path = fs.FileSystem.from_uri(plain if "://" in plain else f"file://{plain}")
        return system, f"{path}/{name}"

    @staticmethod
    def key(content: str) -> str:
        return hashlib.sha256(content.encode()).hexdigest()

    def has(self, name: str) -> bool:
        from pyarrow import fs

        system, path = self._at(name)
        return system.get_file_info(path).type == fs.FileType.File

    def put(self, name: str, body: str = "") -> None:
        system, path = self._at(name)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path) as out:
            out.write(body.encode())

    def send(self, send: Callable[[str], str | None], content: str, **more) -> str | None:
        """Error of the last try, or null; contents on their way or sent before are not sent again."""
        key = self.key(content)
        if self.has(f"{key}.begun") and not self.has(f"{key}.refused"):
            return None
        self.put(f"{key}.begun")
        error = send_with_retry(send, content, **more)
        if error is None:
            self.put(f"{key}.sent")
        else:
            self.put(f"{key}.refused", error)  # an answer, so another run may try again
        return error


@dataclass
class _Sent(WriterCommitMessage):
    outcomes: list  # (batch_no, success, error) of one task


class _MessageWriter(DataSourceWriter):
    def __init__(self, ledger: Ledger, name: str, sender: Callable[[str], str | None], delay: float):
        self.ledger, self.name, self.sender, self.delay = ledger, name, sender, delay

    def write(self, iterator) -> WriterCommitMessage:
        found = []
        for row in iterator:
            error = self.ledger.send(self.sender, row.content, delay=self.delay)
            found.append((row.batch_no, error is None, error))
        return _Sent(found)

    def commit(self, messages) -> None:
        """All tasks have ended: what became of every batch is written at once."""
        rows = [o for m in messages if m is not None for o in m.outcomes]
        self.ledger.put(f"{self.name}.outcomes", "\n".join(json.dumps(dict(zip(("batch_no", "success", "error"), r))) for r in rows))

    def abort(self, messages) -> None:
        """A task failed: no outcomes; what was sent keeps its marks, so the next try leaves it out."""
        self.ledger.put(f"{self.name}.aborted")


class MessageSink(DataSource):
    """Writes messages (batch_no, content) to a webhook. Options: ledger (a folder) and name (of the outcomes)."""

    sender: Callable[[str], str | None] | None = None
    delay = 2.0

    @classmethod
    def name(cls) -> str:
        return "tidewater_messages"

    def schema(self) -> str:
        return "batch_no long, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _MessageWriter(Ledger(self.options["ledger"]), self.options["name"], type(self).sender, type(self).delay)


def deliver(rows: DataFrame, send: Callable[[str], str | None], size: int = 10, delay: float = 2.0, ledger: str | None = None) -> DataFrame:
    """Send notices in batches of `size`: id, batch_no, success, error; each batch succeeds or fails alone.

    Messages are written by a data source whose tasks mark each content before and
    after it is sent, in the folder `ledger` (by default one of this delivery): a task
    that dies or is run again sends nothing twice. Given the folder of an earlier
    delivery that broke off, what that one sent is left out.
    """
    spark = rows.sparkSession
    kind = type("Messages", (MessageSink,), {"sender": staticmethod(send), "delay": delay})
    spark.dataSource.register(kind)
    folder, name = ledger or fresh_path(spark), uuid.uuid4().hex
    numbered = cut(batches(rows, size))  # numbered once: what is sent and what is reported agree
    render(numbered).select("batch_no", "content").write.format(kind.name()).mode("append").option("ledger", folder).option("name", name).save()
    sent = spark.read.schema("batch_no long, success boolean, error string").json(f"{folder}/{name}.outcomes")
    return numbered.select("id", "batch_no").join(sent, "batch_no").select("id", "batch_no", "success", "error")


def text_digest(rows: DataFrame) -> DataFrame:
    """One text of all notices of a batch, for sinks without markup."""
    return rows.groupBy("batch_no").agg(F.concat_ws("\n\n", F.transform(F.array_sort(F.collect_list(F.struct("id", F.concat_ws("\n", "title", "url").alias("t")))), lambda s: s["t"])).alias("content"))


def report(metrics: dict, intervals: dict[str, tuple] | None = None, wrong: list[dict] = ()) -> str:
    """Markdown of one row of metrics, with intervals where given, and of the rows predicted wrongly (id, title, error)."""
    shown = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["# Evaluation", "", "| measure | value | 95 % interval |", "| --- | --- | --- |"]
    for name, value in metrics.items():
        low, high = (intervals or {}).get(name, (None, None))
        lines.append(f"| {name} | {shown(value)} | {f'{shown(low)} to {shown(high)}' if low is not None else ''} |")
    for kind in ("false_positive", "false_negative"):
        rows = [r for r in wrong if r["error"] == kind]
        lines += ["", f"## {kind.replace('_', ' ')}s: {len(rows)}", *[f"- {r['id']}: {r.get('title', '')}" for r in rows]]
    return "\n".join(lines) + "\n"
