"""A stream of a growing table, read from a cursor on.

The source's offset is the cursor (time, id) of the last row that was read. A batch
takes the next ``limit`` rows in their order, cut into ranges that tasks fetch for
themselves; the stream's checkpoint keeps the cursor, so a restart goes on after the
last batch that was done and reads no row twice.

    spark.dataSource.register(CursorSource)
    spark.readStream.format("cursor").option("module", "sqlite3").option("target", path).option("table", "events").load()

Options: ``module`` (a DB-API module that executors have) with ``target`` (what its
connect() takes) and ``table``; or ``path`` (a headerless CSV file that executors see);
``columns`` (of the table, else those of a raw file), ``ts`` and ``id`` (columns of the
cursor), ``limit`` (rows of a batch), ``partitions`` (tasks of a batch), ``start_ts`` and
``start_id`` (where a new stream begins).
"""

from __future__ import annotations

import bisect
import csv
import importlib
import re
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from watchwell.sources.raw import RAW_COLUMNS

_MARKS = {"qmark": "?", "format": "%s", "pyformat": "%s"}
_NAME = re.compile(r"\w+(\.\w+)?")


class _Table:
    """A database table; the database compares times and ids."""

    def __init__(self, module: str, target: str, table: str, columns: tuple[str, ...], ts: str, id_column: str):
        bad = [n for n in (table, ts, id_column, *columns) if not _NAME.fullmatch(n)]
        if bad:
            raise ValueError(f"not a name: {bad[0]}")
        self.module, self.target, self.table, self.columns, self.ts, self.id = module, target, table, columns, ts, id_column

    def _range(self, after: list | None, to: list | None) -> tuple[str, list]:
        parts, values = [f"{self.ts} IS NOT NULL", f"{self.id} IS NOT NULL"], []
        for cursor, sign, last in ((after, ">", ">"), (to, "<", "<=")):
            if cursor:
                parts.append(f"({self.ts} {sign} @ OR ({self.ts} = @ AND {self.id} {last} @))")
                values += [cursor[0], cursor[0], cursor[1]]
        return " WHERE " + " AND ".join(parts), values

    def _query(self, sql: str, values: list) -> Iterator[tuple]:
        module = importlib.import_module(self.module)
        with closing(module.connect(self.target)) as connection, closing(connection.cursor()) as cursor:
            cursor.execute(sql.replace("@", _MARKS[module.paramstyle]), values)
            while rows := cursor.fetchmany(2000):
                yield from rows

    def cursors(self, after: list | None, to: list | None, limit: int | None, every: int) -> list[list]:
        """Of the rows in (after, to], up to ``limit``, each ``every``-th one's cursor and the last one's."""
        where, values = self._range(after, to)
        most = f" LIMIT {int(limit)}" if limit else ""
        inner = f"SELECT {self.ts} AS t, {self.id} AS i, row_number() OVER (ORDER BY {self.ts}, {self.id}) AS n FROM {self.table}{where} ORDER BY {self.ts}, {self.id}{most}"
        return [list(r) for r in self._query(f"SELECT t, i FROM (SELECT t, i, n, max(n) OVER () AS last FROM ({inner}) AS a) AS b WHERE n % {int(every)} = 0 OR n = last ORDER BY n", values)]

    def rows(self, after: list | None, to: list) -> Iterator[tuple]:
        where, values = self._range(after, to)
        yield from (tuple(None if v is None else str(v) for v in r) for r in self._query(f"SELECT {', '.join(self.columns)} FROM {self.table}{where} ORDER BY {self.ts}, {self.id}", values))


class _File:
    """A CSV file: numeric ids by value and before all others; rows of another width, without a time or an id are left out."""

    def __init__(self, path: str, columns: tuple[str, ...], ts: str, id_column: str):
        self.path, self.columns, self.ts, self.id = path, columns, columns.index(ts), columns.index(id_column)

    @staticmethod
    def _key(cursor: list) -> tuple:
        text = str(cursor[1])
        return (cursor[0], 0, int(text), "") if text.isdigit() else (cursor[0], 1, 0, text)

    def _read(self) -> Iterator[tuple[list, tuple]]:
        with open(self.path, encoding="utf-8-sig", newline="") as lines:
            for row in csv.reader(lines):
                if len(row) == len(self.columns) and row[self.id].strip():
                    try:
                        at = datetime.fromisoformat(row[self.ts].strip())
                    except ValueError:
                        continue
                    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
                    yield [at.astimezone(timezone.utc).isoformat(timespec="microseconds"), row[self.id].strip()], tuple(row)

    def _between(self, after: list | None, to: list | None) -> list[tuple[list, tuple]]:
        found = [x for x in self._read() if (not after or self._key(x[0]) > self._key(after)) and (not to or self._key(x[0]) <= self._key(to))]
        return sorted(found, key=lambda x: self._key(x[0]))

    def cursors(self, after: list | None, to: list | None, limit: int | None, every: int) -> list[list]:
        found = [c for c, _ in self._between(after, to)]
        # Rows that share a cursor can't be told apart by it: they come together.
        end = bisect.bisect_right(found, self._key(found[min(limit, len(found)) - 1]), key=self._key) if limit and found else len(found)
        return [c for n, c in enumerate(found[:end], 1) if n % every == 0 or n == end]

    def rows(self, after: list | None, to: list) -> Iterator[tuple]:
        yield from (row for _, row in self._between(after, to))


@dataclass
class _Range(InputPartition):
    after: list | None
    to: list


class _Reader(DataSourceStreamReader):
    def __init__(self, source: _Table | _File, limit: int, partitions: int, start: list | None):
        self.source, self.limit, self.tasks, self.start, self.at = source, limit, partitions, start, None

    def initialOffset(self) -> dict:
        return {"cursor": self.start}

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self.initialOffset()
        ends = self.source.cursors(self.at["cursor"], None, self.limit, self.limit)
        if ends:
            self.at = {"cursor": ends[-1]}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # After a restart the last planned batch is asked for first: the stream goes on behind it.
        self.at = self.at or end
        if start == end:
            return []
        cuts, after = [], start["cursor"]
        for to in self.source.cursors(after, end["cursor"], None, max(1, -(-self.limit // self.tasks))):
            cuts.append(_Range(after, to))
            after = to
        return cuts

    def read(self, partition: _Range) -> Iterator[tuple]:
        yield from self.source.rows(partition.after, partition.to)


class CursorSource(DataSource):
    """The data source "cursor"; see the module."""

    @classmethod
    def name(cls) -> str:
        return "cursor"

    def _columns(self) -> tuple[str, ...]:
        return tuple(c.strip() for c in self.options["columns"].split(",")) if "columns" in self.options else RAW_COLUMNS

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in self._columns()])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        o, columns = self.options, self._columns()
        ts, id_column = o.get("ts", "event_time"), o.get("id", "id" if "module" in o else "event_id")
        source = _Table(o["module"], o["target"], o["table"], columns, ts, id_column) if "module" in o else _File(o["path"], columns, ts, id_column)
        start = [o["start_ts"], o["start_id"]] if "start_ts" in o else None
        return _Reader(source, int(o.get("limit", 2000)), int(o.get("partitions", 4)), start)
