"""A data source of stored search replies: JSON, or JSON within a call of a function, a file a reply."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

STOCKS = "file string, code string, stock_id string"
REPORTS = "file string, year string, date string, title_cn string, url string"
#: Files of a partition.
FILES = 64


@dataclass
class Files(InputPartition):
    paths: list[str]


def opened(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def body(text: str) -> dict:
    """The object in a reply; an empty one, if it holds none."""
    call = re.search(r"\((\{.*\})\)", text, re.S)
    try:
        found = json.loads(call.group(1) if call else text)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def stocks(reply: dict) -> Iterator[tuple]:
    """code, stock_id of each entry."""
    for x in reply.get("stockInfo") or []:
        yield str(x.get("code") or ""), None if x.get("stockId") is None else str(x["stockId"])


def reports(reply: dict) -> Iterator[tuple]:
    """year, date, title_cn, url of each entry of the result (JSON text within the reply) that has a link."""
    result = reply.get("result") or "[]"
    for x in json.loads(result) if isinstance(result, str) else result:
        title, link = x.get("TITLE") or "", x.get("FILE_LINK") or (x.get("FILE_INFO") or {}).get("fileLink") or ""
        year = re.search(r"20\d{2}", title)
        if link:
            yield year.group() if year else "unknown", x.get("DATE_TIME") or "", title, link


class RepliesReader(DataSourceReader):
    """Reads groups of files."""

    def __init__(self, options: dict, columns: list[str]):
        self.path, self.kind, self.columns = options["path"], options.get("kind", "reports"), columns
        self.wanted: list[tuple[str, frozenset]] = []

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, at = opened(self.path)
        info = system.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        base = self.path if info.type == fs.FileType.File else self.path.rstrip("/")
        paths = sorted(base + f.path.removeprefix(at.rstrip("/")) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        names = [v for c, v in self.wanted if c == "file"]
        paths = [p for p in paths if all(p in v for v in names)]
        return [Files(paths[i : i + FILES]) for i in range(0, len(paths), FILES)]

    def read(self, partition: Files) -> Iterator[tuple]:
        rows = stocks if self.kind == "stocks" else reports
        tests = [(self.columns.index(c), v) for c, v in self.wanted]
        for path in partition.paths:
            system, at = opened(path)
            with system.open_input_stream(at) as f:
                reply = body(f.read().decode("utf-8"))
            for row in rows(reply):
                row = (path, *row)
                if all(row[i] in v for i, v in tests):
                    yield row


class PushedReader(RepliesReader):
    """Applies equality and membership of any column where files are read, and those on `file` before."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                self.wanted.append((f.attribute[0], frozenset([f.value] if isinstance(f, EqualTo) else f.value)))
            else:
                yield f


class SavedReplies(DataSource):
    """spark.read.format("saved_replies").option("kind", "stocks" or "reports").load(path): a file or folder of any file
    system that pyarrow opens.  Option push: "true" takes over filters (Spark refuses that without its own setting)."""

    @classmethod
    def name(cls) -> str:
        return "saved_replies"

    def schema(self) -> str:
        return STOCKS if self.options.get("kind") == "stocks" else REPORTS

    def reader(self, schema) -> DataSourceReader:
        kind = PushedReader if self.options.get("push") == "true" else RepliesReader
        return kind(dict(self.options), schema.names)


def read_replies(spark: SparkSession, path: str, kind: str = "reports") -> DataFrame:
    """Stored replies as rows; filters are pushed if spark.sql.python.filterPushdown.enabled is set."""
    spark.dataSource.register(SavedReplies)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("saved_replies").option("kind", kind).option("push", push).load(path)
