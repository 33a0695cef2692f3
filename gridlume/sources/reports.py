"""A reader for landed report files as a data source of its own: ``spark.read.format("gridlume_reports").load(folder)``.

A folder holds a JSON text a file, in sub-folders ``insee=...`` or named by the code. The driver lists the folder's own entries
only and deals them out; each task lists and reads what is below its share. Whatever is wrong with a file (unreadable, too
large, not UTF-8, no JSON) makes one row with an error and no value, so that its place is known and the others go on.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridlume.runtime import ship

NAME = "gridlume_reports"
#: Fixed value: bytes that a report may have.
MOST_BYTES = 2 * 1024 * 1024


@dataclass
class Share(InputPartition):
    """Some entries of the folder: (path, whether it is a file)."""

    entries: list[tuple[str, bool]]


def _hidden(path: str) -> bool:
    return path.rstrip("/").rsplit("/", 1)[-1][:1] in ("_", ".")


def _place(path: str) -> str | None:
    """The place of a file: of the folder ``insee=...`` it is in, else its own name's."""
    found = re.findall(r"(?:^|/)insee=([^/]+)", path) or re.findall(r"([^/]+)\.json$", path)
    return found[-1] if found else None


class ReportReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.shares = options["path"], int(options.get("partitions", "32"))
        self.most = int(options.get("most_bytes", str(MOST_BYTES)))

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def partitions(self) -> list[Share]:
        from pyarrow import fs

        store, root = self._files()
        found = sorted((x.path, x.type == fs.FileType.File) for x in store.get_file_info(fs.FileSelector(root)) if not _hidden(x.path))
        return [Share(found[k :: self.shares]) for k in range(min(self.shares, len(found)))] or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        from pyarrow import fs

        store, root = self._files()
        for path, is_file in partition.entries:
            below = [store.get_file_info(path)] if is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
            for info in sorted(below, key=lambda x: x.path):
                inside = info.path[len(root) :].strip("/").split("/")
                if info.type == fs.FileType.File and not any(map(_hidden, inside)):
                    yield (_place("/".join(inside)), "/".join(inside), *self._value(store, info))

    def _value(self, store, info) -> tuple[str | None, str | None]:
        try:
            if info.size > self.most:
                return None, "response too large"
            with store.open_input_stream(info.path) as f:
                text = f.read().decode("utf-8-sig")
            return (text, None) if isinstance(json.loads(text), dict | list) else (None, "invalid response")
        except (ValueError, RecursionError):
            return None, "invalid response"
        except OSError as e:
            return None, f"unreadable: {type(e).__name__}"


class ReportFiles(DataSource):
    """Options: ``path`` (any store that Arrow reads), ``partitions``, ``most_bytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "insee string, path string, value string, error string"

    def reader(self, schema) -> ReportReader:
        return ReportReader(dict(self.options))


def report_files(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """``insee, path, value, error`` of every file below ``path``: a JSON text, or what is wrong with the file."""
    ship(spark)
    spark.dataSource.register(ReportFiles)
    return spark.read.format(NAME).options(**options).load(path)
