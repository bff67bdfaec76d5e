"""A data source of record folders: each JSON or YAML file is a record, or a list of them.

    register(spark)
    spark.read.format("records").schema(...).load(folder)
    df.write.format("records").option("name", "doc_id").mode("append").save(folder)

Files are read in groups, one task each; a file's fields go to the columns of their names, nested
ones too, and absent ones are null.  Each row is written as one JSON file called by a column;
files appear under their names only when the whole job commits, and a job that fails
leaves none.  The folder is one that driver and executors share as a file system; a store that
only Spark reads is served by tables.read_records().
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vellum.session import ship

ENDINGS = (".json", ".yaml", ".yml")
#: Bytes of files that one task reads, more where one file is larger.
GROUP_BYTES = 64_000_000


def _folder(options: dict) -> str:
    return options["path"].removeprefix("file://").rstrip("/")


def parsed(path: str) -> list[dict]:
    """The records of a file; what isn't a mapping is left out."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        data = json.loads(text) if text.strip() else None
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the yaml module, which this Python lacks") from e
        data = yaml.safe_load(text)
    return [x for x in (data if isinstance(data, list) else [data]) if isinstance(x, dict)]


def fitted(value, kind: pa.DataType):
    """A parsed value in the form of a column: scalars become text where text is asked, and what
    doesn't fit at all is null."""
    if value is None:
        return None
    if pa.types.is_struct(kind):
        return {f.name: fitted(value.get(f.name), f.type) for f in kind} if isinstance(value, dict) else None
    if pa.types.is_map(kind):
        return [(str(k), fitted(v, kind.item_type)) for k, v in value.items()] if isinstance(value, dict) else None
    if pa.types.is_list(kind):
        return [fitted(v, kind.value_type) for v in value] if isinstance(value, list) else None
    if pa.types.is_string(kind):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)
    if pa.types.is_boolean(kind):
        return value if isinstance(value, bool) else None
    try:
        return int(value) if pa.types.is_integer(kind) and not isinstance(value, float) else float(value) if pa.types.is_floating(kind) else None
    except (TypeError, ValueError):
        return None


@dataclass
class Files(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.folder = schema, _folder(options)
        self.size = int(options.get("groupbytes", GROUP_BYTES))

    def partitions(self) -> list[Files]:
        found = sorted(os.path.join(d, n) for d, _, names in os.walk(self.folder) for n in names if n.lower().endswith(ENDINGS) and not n.startswith(("_", ".")) and "/_" not in d[len(self.folder) :])
        groups, size = [], self.size
        for path in found:
            if size >= self.size:
                groups.append(Files([]))
                size = 0
            groups[-1].paths.append(path)
            size += os.path.getsize(path)
        return groups or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        for path in partition.paths:
            rows = [{f.name: path if f.name == "_path" else fitted(r.get(f.name), f.type) for f in schema} for r in parsed(path)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a file lies, and its name


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.name, self.overwrite = _folder(options), options["name"], overwrite
        self.pending = f"{self.folder}/_pending-{uuid.uuid4().hex}"
        # made here and not by the tasks: one that is still at work when its job has failed would make it anew
        os.makedirs(self.pending)

    def write(self, iterator) -> Written:
        files = []
        for row in iterator:
            data = row.asDict(recursive=True)
            at = f"{self.pending}/{uuid.uuid4().hex}"
            with open(at, "w", encoding="utf-8") as f:
                json.dump(data, f, ensure_ascii=False, indent=1, default=str)
            files.append((at, quote(str(data[self.name]), safe=" ") + ".json"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        kept = {name for _, name in files}
        for at, name in files:  # of rows of one name the last stays
            os.replace(at, f"{self.folder}/{name}")
        if self.overwrite and os.path.isdir(self.folder):
            for name in os.listdir(self.folder):
                if name.endswith(".json") and name not in kept:
                    os.remove(f"{self.folder}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        # aside first, so that no task can add to it any more
        gone = f"{self.pending}-gone"
        if os.path.isdir(self.pending):
            os.rename(self.pending, gone)
            for name in os.listdir(gone):  # of tasks that were tried twice
                os.remove(f"{gone}/{name}")
            os.rmdir(gone)


class Records(DataSource):
    """Folders of JSON and YAML records; a column `_path` takes the file's path."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "_path string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if "name" not in self.options or self.options["name"] not in schema.names:
            raise ValueError("option name must be the column that files are called by")
        os.makedirs(_folder(self.options), exist_ok=True)
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Records)
