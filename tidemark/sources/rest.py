"""A data source for paged JSON interfaces: requests in lanes, retried with growing pauses.

Without a network the source reads the same requests from a folder of recorded responses (option "recorded"), which is
how the tests run it.
"""

from __future__ import annotations

import gzip
import http.client
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Lane(InputPartition):
    """Requests that follow each other."""

    def __init__(self, requests: list[dict[str, str]]):
        super().__init__(json.dumps(requests, sort_keys=True))
        self.requests = requests


class QuotaError(RuntimeError):
    """The service says that the quota is used up or the plan doesn't include the data (402)."""


class RestReader(DataSourceReader):
    """Requests are read in so many lanes (option "lanes", by default one): the requests of a lane follow each other, with
    a pause of "throttle" seconds between them, so the server sees at most lanes / throttle requests a second."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        every = json.loads(self.options.get("requests", "[{}]"))
        lanes = max(1, min(int(self.options.get("lanes", "1")), len(every) or 1))
        return [Lane(every[i::lanes]) for i in range(lanes)]

    def fetch(self, params: dict[str, str]) -> str:
        """The response text. 429, server errors, failed connections and time-outs are tried again, with growing pauses;
        402 is a QuotaError; other client errors are raised at once."""
        if folder := self.options.get("recorded"):
            name = "_".join(f"{k}={params[k]}" for k in sorted(params)) or "all"
            path = Path(folder.removeprefix("file://"), f"{name}.json")
            return path.read_text() if path.exists() else "[]"
        headers = {"Accept-Encoding": "gzip", **json.loads(self.options.get("headers", "{}"))}
        if token := self.options.get("bearer"):
            headers["Authorization"] = f"Bearer {token}"
        url = self.options["url"] + "?" + urllib.parse.urlencode(params)
        pause, last = float(self.options.get("pause", "5")), None
        for attempt in range(int(self.options.get("tries", "4"))):
            if attempt:
                time.sleep(pause * 2 ** (attempt - 1))
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=float(self.options.get("timeout", "60"))) as r:
                    body = r.read()
                    return (gzip.decompress(body) if r.headers.get("Content-Encoding") == "gzip" else body).decode()
            except urllib.error.HTTPError as e:
                if e.code == 402:
                    raise QuotaError(f"{self.options['url']}: quota or plan") from e
                if e.code != 429 and e.code < 500:
                    raise
                last = e
            except (urllib.error.URLError, TimeoutError, ConnectionError, http.client.IncompleteRead) as e:
                last = e
        raise RuntimeError(f"no response from {self.options['url']}: {last}")

    def read(self, partition: Lane) -> Iterator[tuple[str, str]]:
        for i, params in enumerate(partition.requests):
            if i and "recorded" not in self.options:
                time.sleep(float(self.options.get("throttle", "0.25")))
            found = json.loads(self.fetch(params))
            rows = found.get(self.options.get("field", "data"), []) if isinstance(found, dict) else found
            for row in rows:
                yield json.dumps(params, sort_keys=True), json.dumps(row)


class RestSource(DataSource):
    """Rows (request, record), both JSON text; the caller applies a schema to record."""

    @classmethod
    def name(cls) -> str:
        return "rest_json"

    def schema(self) -> str:
        return "request string, record string"

    def reader(self, schema) -> RestReader:
        return RestReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RestSource)
