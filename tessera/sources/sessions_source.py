"""A Python data source of benchmark sessions: one row for each segment of each turn of each session of each item.

    spark.dataSource.register(Sessions)
    spark.read.format("sessions").option("segmentation", "user-sentence").load("items.jsonl")

A file holds an item a line (JSON lines), or one JSON array of items. An item has a question_id, haystack_sessions (arrays of turns of role and content), and beside them haystack_dates
and haystack_session_ids. Lines are dealt into partitions by bytes (option splitBytes), each line to the partition that its first byte falls into; an array is one partition, and so is a file of another form.
Items that are no objects, and turns without content, are left out; a line that cannot be read is left out too.

Session ids are made of the namespace (prefix and question id) and the raw id, or the session's place, so that items that reuse a session stay apart. A turn's key has its place in the raw session, so that
equal turns differ and skipped ones shift none. Segmentation: none (the turn as a whole), sentence, or user-sentence (only turns of users are cut); the modes that need the
text's signs are columns: see `operators.segments.arm`.
Paths are those that driver and executors can open (a local or mounted folder).
"""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "namespace string, question_id string, session_id string, session int, occurred_at string, turn int, turn_key string, role string, segment int, content string, evidence string"
#: Fixed value: sentences end before white space and a capital.
BOUNDARY = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
SEGMENTATIONS = ("none", "sentence", "user-sentence")
SPLIT_BYTES = 32 << 20


@dataclass
class Stretch(InputPartition):
    path: str
    start: int
    stop: int  # -1: the whole file as one JSON text


def lines(path: str, start: int, stop: int) -> Iterator[bytes]:
    """The lines whose first byte is in [start, stop)."""
    with open(path, "rb") as f:
        if start:
            f.seek(start - 1)
            f.readline()
        while f.tell() < stop and (line := f.readline()):
            yield line


def items(part: Stretch) -> Iterator[dict]:
    if part.stop < 0:
        with open(part.path, "rb") as f:
            found = json.loads(f.read() or b"[]")
        yield from (x for x in (found if isinstance(found, list) else [found]) if isinstance(x, dict))
        return
    for line in lines(part.path, part.start, part.stop):
        try:
            item = json.loads(line)
        except ValueError:
            continue
        if isinstance(item, dict):
            yield item


def segments(item: dict, prefix: str, segmentation: str) -> Iterator[tuple]:
    """Rows of one item."""
    namespace = f"{prefix}{item.get('question_id', '')}"
    at = lambda name, k: next(iter((item.get(name) or [])[k : k + 1]), None)
    for s, session in enumerate(item.get("haystack_sessions") or []):
        raw, date = at("haystack_session_ids", s), at("haystack_dates", s)
        session_id = f"{namespace}-{raw}" if raw else f"{namespace}-s{s}"
        for t, turn in enumerate(session or []):
            content = (turn or {}).get("content") or ""
            if not content:
                continue
            role = turn.get("role") or "user"
            cut = segmentation == "sentence" or segmentation == "user-sentence" and role.strip().lower() == "user"
            parts = [p for p in (x.strip() for x in BOUNDARY.split(content)) if p] if cut else [content]
            for k, part in enumerate(parts):
                yield namespace, str(item.get("question_id", "")), session_id, s, date, t, f"{namespace}|{session_id}|t{t}", role, k, part, content


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.prefix = options.get("path", ""), options.get("prefix", "")
        self.segmentation, self.split = options.get("segmentation", "none"), int(options.get("splitbytes", SPLIT_BYTES))
        if self.segmentation not in SEGMENTATIONS:
            raise ValueError(f"segmentation is one of {', '.join(SEGMENTATIONS)}")

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        path = self.paths.removeprefix("file://")
        names = sorted(glob.glob(f"{path}/*.json*") if os.path.isdir(path) else glob.glob(path))
        if not names:
            raise ValueError(f"no file at {path}")
        for name in names:
            size = os.path.getsize(name)
            with open(name, "rb") as f:
                head = f.read(4096).lstrip()
            if head.startswith(b"["):
                found.append(Stretch(name, 0, -1))
            else:
                found += [Stretch(name, k, min(k + self.split, size)) for k in range(0, max(size, 1), self.split)]
        return found

    def read(self, partition: Stretch) -> Iterator[tuple]:
        for item in items(partition):
            yield from segments(item, self.prefix, self.segmentation)


class Sessions(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sessions"

    def schema(self) -> StructType | str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(dict(self.options))
