"""Parts as numbered files, written by the executors: a data source ``parts`` with commit and abort.

Every task writes its parts beside their places under names of the job; only when all tasks are done are the files of the tasks that count renamed, the files of an earlier run removed and the
manifest written. A job that fails leaves the folder as it was, and so do tasks that ran twice. Contents never come to the driver. The folder has to be one that the executors share.
"""

from __future__ import annotations

import contextlib
import dataclasses
import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from corpusloom.sources import writers

SCHEMA = "part bigint, header string, entries array<struct<path:string,n:bigint>>, content string"


@dataclasses.dataclass
class Written(WriterCommitMessage):
    """What a task has written: temporary names and names."""

    files: list[tuple[str, str]]


class PartsWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder, self.job = Path(options["path"]), options["job"]
        self.template, self.title, self.project = options["template"], options["title"], options["project"]
        self.start, self.count, self.merge = int(options["start"]), int(options["count"]), options["merge"] == "true"

    def write(self, rows: Iterator) -> Written:
        done: list[tuple[str, str]] = []
        try:
            for row in rows:
                number = self.start + row.part - 1
                name = writers.part_name(self.template, number)
                done.append((f".{name}.{self.job}.{uuid.uuid4().hex[:8]}", name))
                head = self.title.format(project_name=self.project, part=number, total=self.count) + (row.header or "")
                entries = [writers.toc_entry(e.path, e.n) for e in row.entries or ()]
                with open(self.folder / done[-1][0], "wb") as f:
                    f.write((head + writers.toc(entries, number, self.start + self.count - 1) + row.content).encode())
            return Written(done)
        except BaseException:
            for temporary, _ in done:
                with contextlib.suppress(OSError):
                    os.unlink(self.folder / temporary)
            raise

    def commit(self, messages: list[Written | None]) -> None:
        if not self.merge:
            writers.clean(self.folder, self.template)
        names = []
        for temporary, name in (x for m in messages if m is not None for x in m.files):
            os.replace(self.folder / temporary, self.folder / name)
            names.append(name)
        writers.save_manifest(self.folder, list(dict.fromkeys([*writers.load_manifest(self.folder), *sorted(names, key=lambda n: (len(n), n))])))
        self._sweep()

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """Removes what tasks have left that don't count."""
        for path in self.folder.glob(f".*.{self.job}.*"):
            with contextlib.suppress(OSError):
                path.unlink()


class PartsSource(DataSource):
    """Options: path; template, title, project; start, count, merge; job."""

    @classmethod
    def name(cls) -> str:
        return "parts"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options)


def write(parts: DataFrame, count: int, folder: str | Path, template: str, title: str, project: str, merge: bool = False) -> list[str]:
    """``(part, header, entries, content)``, parts from 1 to ``count``, as numbered files; their names. ``merge`` numbers on behind what is there."""
    spark, folder = parts.sparkSession, Path(folder)
    spark.dataSource.register(PartsSource)
    with writers.merge_lock(folder):
        start = writers.next_number(folder, template) if merge else 1
        options = {"template": template, "title": title, "project": project, "start": start, "count": count, "merge": json.dumps(merge), "job": uuid.uuid4().hex}
        entries = F.transform("entries", lambda e: F.struct(e["path"].alias("path"), e["n"].cast("bigint").alias("n")))
        rows = parts.select(F.col("part").cast("bigint").alias("part"), F.col("header").cast("string").alias("header"), entries.alias("entries"), "content")
        rows.write.format("parts").mode("append").options(**options).save(str(folder.absolute()))
    return [writers.part_name(template, i) for i in range(start, start + count)]
