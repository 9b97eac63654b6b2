"""Search calls as a stream: queries from files that grow, within a rate, each asked once however often the stream starts again.

Offsets say how far in which file the queries have been taken. Each partition of a batch has its share of the rate as a bucket
of tokens. What a provider answers is kept in a journal in the shared folder before it is handed on, so a batch that is read
again - after a lost executor, a failed sink, a restart - takes the answers from there and asks nothing twice.

Only refusals for too many calls are tried again, each time after twice the wait; any other error is the query's answer.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tallygrain import config
from tallygrain.sources.flush import exists, opened
from tallygrain.sources.recorded import PROVIDERS

SCHEMA = "query string, result_idx int, title string, url string, snippet string, tries int, error string"
#: Messages of refusals for too many calls.
REFUSED = re.compile(r"rate.?limit|too many requests|\b429\b", re.I)


class Bucket:
    """Tokens that come at a rate, up to a burst; taking one waits for it."""

    def __init__(self, rate: float, burst: float, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.now, self.sleep = rate, burst, now, sleep
        self.tokens, self.at = burst, now()

    def take(self) -> None:
        now = self.now()
        self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
        if self.tokens < 1:
            wait = (1 - self.tokens) / self.rate
            self.sleep(wait)
            self.tokens, self.at = 1.0, now + wait
        self.tokens -= 1


def asked(provider: Callable, query: str, k: int, country: str, tries: int, wait: float, sleep: Callable[[float], None] = time.sleep) -> tuple[list, int, str | None]:
    """(results, tries made, error or null) of one query; results are (result_idx, title, url, snippet)."""
    for n in range(1, tries + 1):
        try:
            rows = list(provider(query, k, country))
            return [(i, *r) for i, r in enumerate(rows[:k]) if r[0] and r[1]], n, None
        except Exception as e:  # a provider may raise anything
            kind = f"{type(e).__name__}: {e}"
            if not REFUSED.search(kind) or n == tries:
                return [], n, kind
            sleep(wait * 2 ** (n - 1))
    return [], 0, "no try"


class Slice(InputPartition):
    """Lines [start, end) of a file, and the share of the rate that they are asked at."""

    def __init__(self, file: str, start: int, end: int, rate: float):
        self.file, self.start, self.end, self.rate = file, start, end, rate


def search_stream(provider_name: str) -> type[DataSource]:
    """A streaming data source of a registered provider, to pass to spark.dataSource.register; its format is
    tallygrain_<name>_stream.

    Options: path (a folder of text files, a query a line, taken in order of name; a file is complete when it is there), journal
    (a folder), rate (calls a second, 1), burst (1), parallel (partitions of a batch, 4), batch (queries of a batch, 100), k,
    country, tries (3), wait (seconds before the second try, 1).
    """
    provider = PROVIDERS[provider_name]  # travels with the class

    class Reader(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.options = options
            self.at: dict | None = None

        def get(self, name: str, default):
            return type(default)(self.options.get(name, default))

        def names(self) -> list[str]:
            from pyarrow import fs

            files, root = opened(self.options["path"])
            found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
            return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")

        def lines(self, name: str) -> list[str]:
            files, root = opened(self.options["path"])
            with files.open_input_stream(f"{root}/{name}") as f:
                return f.read().decode("utf-8").splitlines()

        def initialOffset(self) -> dict:
            return {"file": "", "line": 0}

        def latestOffset(self) -> dict:
            """At most a batch of queries further, and no further than the end of a file."""
            at = self.at or self.initialOffset()
            for name in self.names():
                if name < at["file"]:
                    continue
                done = at["line"] if name == at["file"] else 0
                size = len(self.lines(name))
                if done < size:
                    at = {"file": name, "line": min(size, done + self.get("batch", 100))}
                    break
            self.at = at
            return at

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            self.at = end
            first = start["line"] if start["file"] == end["file"] else 0
            n = end["line"] - first
            parts = min(self.get("parallel", 4), n)
            cut = [first + n * i // parts for i in range(parts + 1)] if parts > 0 else []
            return [Slice(end["file"], a, b, self.get("rate", 1.0) / parts) for a, b in zip(cut, cut[1:])]

        def read(self, partition: Slice) -> Iterator[tuple]:
            bucket = Bucket(partition.rate, self.get("burst", 1.0))
            files, root = opened(self.options["journal"])
            files.create_dir(root, recursive=True)
            for n, query in enumerate(self.lines(partition.file)[partition.start : partition.end], partition.start):
                if not query.strip():
                    continue
                own = f"{root}/{hashlib.sha256(f'{partition.file}:{n}:{query}'.encode()).hexdigest()}.json"
                if exists(files, own):
                    with files.open_input_stream(own) as f:
                        rows, tries, error = json.loads(f.read())
                else:
                    bucket.take()
                    rows, tries, error = asked(provider, query, self.get("k", config.SEARCH_K), self.get("country", "uk"), self.get("tries", 3), self.get("wait", 1.0))
                    draft = f"{own}.{uuid.uuid4().hex}"
                    with files.open_output_stream(draft) as out:
                        out.write(json.dumps([rows, tries, error]).encode())
                    files.move(draft, own)
                for i, title, url, snippet in rows:
                    yield query, i, title, url, snippet, tries, None
                if error or not rows:
                    yield query, None, None, None, None, tries, error

        def commit(self, end: dict) -> None:
            """Answers stay in the journal until their folder is cleared."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"tallygrain_{provider_name}_stream"

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Reader(dict(self.options))

    return Source
