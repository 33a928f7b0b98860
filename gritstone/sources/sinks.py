"""Where results go: Parquet with a receipt, HTTP collectors, several sinks at once."""

from __future__ import annotations

import getpass
import hashlib
import json
import platform
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIES, TIMEOUT = 10, 30.0


def write_parquet(events: DataFrame, folder: str, name: str = "hunt") -> str:
    """Write below ``folder``, named by the time in UTC; returns the path."""
    path = f"{folder.rstrip('/')}/{datetime.now(timezone.utc):%Y%m%dT%H%M%S}_{name}.parquet"
    events.write.option("compression", "zstd").parquet(path)
    return path


def receipt(path: str, command: str = "") -> Path:
    """A chain-of-custody file beside a local result: digest and size of each of its files, who and where."""
    target = Path(path)
    files = sorted(x for x in (target.rglob("*") if target.is_dir() else [target]) if x.is_file() and not x.name.startswith((".", "_")))

    def digest(file: Path) -> str:
        with file.open("rb") as opened:
            return hashlib.file_digest(opened, "sha256").hexdigest()

    entries = [{"file": str(x), "size": x.stat().st_size, "sha256": digest(x)} for x in files]
    out = target.with_name(target.name + ".cc")
    out.write_text(json.dumps({"time": datetime.now(timezone.utc).isoformat(), "host": platform.node(), "user": getpass.getuser(), "command": command, "files": entries}, indent=2) + "\n")
    return out


def check_options(collector: str | None, token: str | None) -> None:
    """A collector needs a token, and a token a collector."""
    if bool(collector) != bool(token):
        raise ValueError("a collector and its token go together")


def post(url: str, body: bytes, token: str | None = None, tries: int = TRIES, timeout: float = TIMEOUT, wait: Callable[[float], None] = time.sleep) -> int:
    """One POST; server errors are tried again for as long as ``timeout``, client errors raise at once."""
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"} | ({"Authorization": f"Splunk {token}"} if token else {}))
    context = ssl.create_default_context() if url.startswith("https:") else None
    if context:
        context.minimum_version = ssl.TLSVersion.TLSv1_3
    until = time.monotonic() + timeout
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(request, timeout=timeout, context=context) as answer:
                return answer.status
        except urllib.error.HTTPError as error:
            if error.code < 500 or attempt + 1 == tries or time.monotonic() > until:
                raise
        except (urllib.error.URLError, TimeoutError):
            if attempt + 1 == tries or time.monotonic() > until:
                raise
        wait(min(2**attempt / 10, 5.0))
    raise AssertionError("unreachable")


def post_rows(rows: DataFrame, column: str, url: str, token: str | None = None, **options) -> DataFrame:
    """One POST for each value of ``column``, from the executors; (sent, failed) of each partition.

    A task that runs again sends its rows again: the collector has to tell them by their id.
    """

    def run(batches) -> Iterator:
        import pandas as pd

        sent = failed = 0
        for batch in batches:
            for value in batch[column]:
                try:
                    post(url, value.encode(), token, **options)
                    sent += 1
                except (urllib.error.URLError, TimeoutError):
                    failed += 1
        yield pd.DataFrame({"sent": [sent], "failed": [failed]})

    return rows.select(column).mapInPandas(run, "sent long, failed long").agg(F.sum("sent").alias("sent"), F.sum("failed").alias("failed"))


def fan_out(rows: DataFrame, sinks: list[Callable[[DataFrame], object]]) -> list[object]:
    """Give all rows to every sink; a sink that fails does not stop the others, and its error is its result."""
    rows = rows.persist()
    out: list[object] = []
    try:
        for sink in sinks:
            try:
                out.append(sink(rows))
            except Exception as error:  # noqa: BLE001
                out.append(error)
    finally:
        rows.unpersist()
    return out
