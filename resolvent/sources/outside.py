"""Answers from outside Spark: HTTP services and programs. Off unless the session allows them.

An answer is a row, a failure too: whoever reads it can tell "there is none" from "it couldn't be asked".
"""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import Failure
from .settings import OUTSIDE, outside_allowed

#: Seconds between requests of a task, for a request, and for a program.
DELAY_S, REQUEST_S, PROGRAM_S = 0.25, 30, 900
ANSWERS = "key string, ok boolean, payload string, error string"


def get_json(url: str, timeout: float = REQUEST_S) -> tuple[str | None, str | None]:
    """(the JSON text, None), or (None, why not)."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json"}), timeout=timeout) as r:
            text = r.read().decode("utf-8")
            json.loads(text)
            return (text, None) if r.status == 200 else (None, f"status {r.status}")
    except (OSError, ValueError, urllib.error.URLError) as e:
        return None, f"{type(e).__name__}: {e}"[:200]


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options.get("urls", "[]"))
        self.tasks, self.delay, self.timeout = int(options.get("tasks", "1")), float(options.get("delay", DELAY_S)), float(options.get("timeout", REQUEST_S))

    def partitions(self) -> list[_Urls]:
        n = max(1, min(self.tasks, len(self.urls)))
        return [_Urls(self.urls[k::n]) for k in range(n)]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        for k, url in enumerate(partition.urls):
            if k:
                time.sleep(self.delay)
            payload, error = get_json(url, self.timeout)
            yield url, error is None, payload, error


class HttpSource(DataSource):
    """format("http_json"): option `urls` (a JSON list), `tasks`, `delay` and `timeout` -> key, ok, payload, error."""

    @classmethod
    def name(cls) -> str:
        return "http_json"

    def schema(self) -> str:
        return ANSWERS

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader(self.options)


def _allowed(spark: SparkSession) -> None:
    if not outside_allowed(spark):
        raise Failure("invalid_state", f"set {OUTSIDE} to true to leave Spark")


def http(spark: SparkSession, urls: list[str], tasks: int = 1, delay: float = DELAY_S, timeout: float = REQUEST_S) -> DataFrame:
    """key (the URL), ok, payload, error. Each task waits `delay` between its requests."""
    _allowed(spark)
    spark.dataSource.register(HttpSource)
    return spark.read.format("http_json").options(urls=json.dumps(urls), tasks=tasks, delay=delay, timeout=timeout).load()


def run_program(command: list[str], request: dict, timeout: float = PROGRAM_S) -> tuple[str | None, str | None]:
    """Gives a program a request as JSON on its input, with a file `out` to answer in; what it prints is no answer."""
    handle, out = tempfile.mkstemp(suffix=".json")
    os.close(handle)
    try:
        done = subprocess.run(command, input=json.dumps({**request, "out": out}), capture_output=True, text=True, timeout=timeout)
        if done.returncode:
            return None, f"exit {done.returncode}: {done.stderr[-2000:]}"
        with open(out, encoding="utf-8") as f:
            text = f.read()
        if not text:
            return None, f"no answer: {done.stderr[-2000:]}"
        json.loads(text)
        return text, None
    except subprocess.TimeoutExpired:
        return None, f"timeout after {timeout:g} s"
    except (OSError, ValueError) as e:
        return None, f"{type(e).__name__}: {e}"[:200]
    finally:
        if os.path.exists(out):
            os.remove(out)


def programs(requests: DataFrame, command: list[str], timeout: float = PROGRAM_S) -> DataFrame:
    """requests(key, request as JSON) -> key, ok, payload, error: one run of the program for each row, on the executors."""
    _allowed(requests.sparkSession)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(key, *run_program(command, json.loads(request), timeout)) for key, request in zip(b["key"], b["request"])]
            yield pd.DataFrame([(key, error is None, payload, error) for key, payload, error in found], columns=["key", "ok", "payload", "error"])

    return requests.select("key", "request").mapInPandas(step, ANSWERS)
