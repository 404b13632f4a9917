"""The log in the order of its commits: a data source whose offsets are commit numbers.

A batch that a crash cut off has no number, so it is never seen; a cursor is a number, so a reader that resumes misses nothing and gets
nothing twice. Works as a stream (``spark.readStream``) and as a batch over a range of commits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.sources.log import TABLES, commit_name

FORMAT = "tidemark_commits"
#: Most tasks that a range of commits is cut into.
MOST_TASKS = 256


class Range(InputPartition):
    """Commits from ``first`` to ``last``, both included."""

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Commits:
    """Options: path and table of a log; ``after``, the last commit that has been seen (a number, or ``latest``); ``upto``, the last to read."""

    def __init__(self, options, schema):
        import pyarrow.fs

        self.table, self.schema = options["table"], schema
        path = options["path"].rstrip("/")
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(path if ":" in path.split("/", 1)[0] else f"file://{path}")
        self.upto = int(options["upto"]) if options.get("upto") else None
        after = options.get("after", "0")
        self.after = self.newest() if after == "latest" else int(after)

    def newest(self) -> int:
        import pyarrow.fs

        found = self.fs.get_file_info(pyarrow.fs.FileSelector(f"{self.path}/commits", allow_not_found=True))
        number = max((int(f.base_name[1:-8]) for f in found if f.base_name.startswith("c") and f.base_name.endswith(".parquet")), default=0)
        return number if self.upto is None else min(number, self.upto)

    def ranges(self, after: int, upto: int) -> list[Range]:
        step = max(1, -(-(upto - after) // MOST_TASKS))
        return [Range(lo, min(lo + step - 1, upto)) for lo in range(after + 1, upto + 1, step)]

    def rows(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        """Batches of the files of each commit, in order; a commit without rows of the table has no folder. None: there is no commit to read."""
        if part is None:
            return
        import pyarrow.fs
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        for number in range(part.first, part.last + 1):
            with self.fs.open_input_file(f"{self.path}/commits/{commit_name(number)}") as f:
                seq = pq.read_table(f)["seq"][0].as_py()
            files = self.fs.get_file_info(pyarrow.fs.FileSelector(f"{self.path}/{self.table}/b{seq}", allow_not_found=True))
            for info in sorted((x for x in files if x.base_name.startswith("part-")), key=lambda x: x.base_name):
                with self.fs.open_input_file(info.path) as f:
                    for batch in pq.ParquetFile(f).iter_batches(batch_size=10_000):
                        have = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"number": pa.array([number] * batch.num_rows, pa.int64())}
                        yield pa.RecordBatch.from_arrays([have[c.name].cast(c.type) if c.name in have else pa.nulls(batch.num_rows, c.type) for c in schema], schema=schema)


class _BatchReader(_Commits, DataSourceReader):
    def partitions(self):
        return self.ranges(self.after, self.newest())

    def read(self, partition):
        return self.rows(partition)


class _StreamReader(_Commits, DataSourceStreamReader):
    def initialOffset(self):
        return {"number": self.after}

    def latestOffset(self):
        return {"number": max(self.after, self.newest())}

    def partitions(self, start, end):
        return self.ranges(start["number"], end["number"])

    def read(self, partition):
        return self.rows(partition)


class CommitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        table = self.options["table"]
        if table not in TABLES:
            raise ValueError(f"the log has no table {table}")
        return TABLES[table][0] + ", seq long, number long"

    def reader(self, schema):
        return _BatchReader(self.options, schema)

    def streamReader(self, schema):
        return _StreamReader(self.options, schema)


def _options(path: str, table: str, after, upto) -> dict:
    return {"path": path, "table": table, "after": str(after)} | ({} if upto is None else {"upto": str(upto)})


def between(spark: SparkSession, path: str, table: str, after: int = 0, upto: int | None = None) -> DataFrame:
    """Rows of the commits after one and up to another, with ``number``; all columns of the table, whatever a batch wrote."""
    spark.dataSource.register(CommitSource)
    return spark.read.format(FORMAT).options(**_options(path, table, after, upto)).load()


def newest(path: str) -> int:
    """The number of a log's last commit; 0 if there is none."""
    return _Commits({"path": path, "table": "events"}, None).newest()


def follow(spark: SparkSession, path: str, table: str, after: int | str = 0, upto: int | None = None) -> DataFrame:
    """A stream of the rows of all commits after one; ``latest`` begins with the next."""
    spark.dataSource.register(CommitSource)
    return spark.readStream.format(FORMAT).options(**_options(path, table, after, upto)).load()
