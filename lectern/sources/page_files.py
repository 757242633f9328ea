"""Text files as rows: a reader and a stream reader for ``spark.read.format("text_pages")``, and a writer of one file for each row.

Each file is a row (part, stem, path, size, text), or with option ``lines`` each line (part, stem, path, line, text). Files are listed once; a task
reads up to ``per_task`` of them. Filters on ``part`` and ``stem`` (equality, IN) and on ``path`` are pushed down to the listing, so files
that a query leaves out are never opened. Empty files are rows with an empty text. The stream reader gives each file once, in the
order of (modification time, path), up to ``per_batch`` in a batch.
"""

from __future__ import annotations

import fnmatch
import sys
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull

from ..session import fresh_dir, kept

FORMAT = "text_pages"


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


def _listing(options: dict) -> list[fs.FileInfo]:
    """Files below the path, with the ending that is asked for, in order of their names."""
    store, base = fs.FileSystem.from_uri(options["path"])
    found = store.get_file_info(fs.FileSelector(base, recursive=options.get("recursive", "true") == "true", allow_not_found=True))
    hidden = lambda f: any(p.startswith((".", "_")) for p in f.path[len(base) :].split("/"))
    return sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(options.get("suffix", "")) and not hidden(f)), key=lambda f: f.path)


def _names(path: str) -> tuple[str, str]:
    """(part, stem): the name of the folder, and that of the file without its ending."""
    *_, part, name = ("", *path.split("/"))
    return part, name.rsplit(".", 1)[0] if "." in name else name


class _Read:
    """What both readers do with files."""

    options: dict

    def _rows(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.options["path"])
        lines = self.options.get("lines", "false") == "true"
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                raw = f.read()
            text = raw.decode("utf-8", "replace")
            part, stem = _names(path)
            if not lines:
                yield pa.record_batch([[part], [stem], [path], pa.array([len(raw)], pa.int64()), [text]], names=["part", "stem", "path", "size", "text"])
                continue
            own = text.split("\n")
            own = own[:-1] if own[-1] == "" else own
            for i in range(0, len(own), 4096):
                some = own[i : i + 4096]
                yield pa.record_batch([[part] * len(some), [stem] * len(some), [path] * len(some), pa.array(range(i, i + len(some)), pa.int64()), pa.array(some, pa.string())], names=["part", "stem", "path", "line", "text"])

    def _dealt(self, paths: list[str]) -> list[Files]:
        each = int(self.options.get("per_task", "64"))
        return [Files(paths[i : i + each]) for i in range(0, len(paths), each)] or [Files([])]


class PageReader(_Read, DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.wanted = options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, IsNotNull) and len(f.attribute) == 1:  # every column has a value
                continue
            if isinstance(f, (EqualTo, In)) and f.attribute in (("part",), ("stem",), ("path",)):
                self.wanted.append((f.attribute[0], set(f.value if isinstance(f, In) else [f.value])))
            else:
                yield f

    def _chosen(self, path: str) -> bool:
        part, stem = _names(path)
        own = {"part": part, "stem": stem, "path": path}
        return all(own[name] in values for name, values in self.wanted)

    def partitions(self) -> list[Files]:
        return self._dealt([f.path for f in _listing(self.options) if self._chosen(f.path)])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self._rows(partition)


class PageStream(_Read, DataSourceStreamReader):
    """An offset is the time and path of the last file of a batch."""

    def __init__(self, options: dict):
        self.options, self.last = options, None

    def _ordered(self) -> list[tuple[int, str]]:
        return sorted((f.mtime_ns, f.path) for f in _listing(self.options))

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        at = (self.last["at"], self.last["path"]) if self.last else (-1, "")
        later = [f for f in self._ordered() if f > at][: int(self.options.get("per_batch", "1024"))]
        if later:
            self.last = {"at": later[-1][0], "path": later[-1][1]}
        return self.last or self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.last = max(self.last or end, end, key=lambda o: (o["at"], o["path"]))
        low, high = ((o["at"], o["path"]) for o in (start, end))
        return self._dealt([path for at, path in self._ordered() if low < (at, path) <= high])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self._rows(partition)

    def commit(self, end: dict) -> None:
        pass


class TextPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"part string, stem string, path string, {'line' if self.options.get('lines', 'false') == 'true' else 'size'} long, text string"

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))

    def streamReader(self, schema) -> PageStream:
        return PageStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # planning and reading workers need no package
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TextPages)


def read_files(spark: SparkSession, path: str, suffix: str = "", **options) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).options(path=path, suffix=suffix, **options).load()


def numbered(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(index, value): lines of all files below a folder with their number from 0, in order of file names. Blank lines go, but take a number.

    A file's lines are numbered where they are read; only the numbers of lines of the files are added up.
    """
    lines = read_files(spark, path, suffix, lines="true")
    counts = lines.groupBy("path").agg(F.count("*").alias("n"))
    listed = sorted((r.path, r.n) for r in counts.collect())  # a row for each file, as the listing has
    before, rows = 0, []
    for p, n in listed:
        rows.append((p, before))
        before += n
    offsets = spark.createDataFrame(rows, "path string, before long")
    return lines.join(F.broadcast(offsets), "path").where(F.trim("text") != "").select((F.col("line") + F.col("before")).alias("index"), F.col("text").alias("value"))


def reaches(folder: str) -> bool:
    """Whether a folder is there and Arrow can reach it; a URI that it can't read raises."""
    store, base = fs.FileSystem.from_uri(folder.removesuffix("/*"))
    return store.get_file_info(base).type == fs.FileType.Directory


def below(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(stem, path, size) of the files below a folder, at any depth, whose names fit a pattern. No file is opened.

    Tasks list the folders of a level, each once, into a table in the shared folder, which has those of the next level too: the driver has no name of
    a file. Hidden files and folders (``.``, ``_``) are left out.
    """
    _, base = fs.FileSystem.from_uri(root)
    made, tables = fresh_dir(spark, "listing"), []

    def run(batches):
        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for one in batch.column(0).to_pylist():
                own = [f for f in store.get_file_info(fs.FileSelector(one)) if not f.base_name.startswith((".", "_"))]
                own = [f for f in own if f.type == fs.FileType.Directory or (f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern))]
                for i in range(0, len(own), 8192):
                    some = own[i : i + 8192]
                    columns = [[f.base_name.rsplit(".", 1)[0] for f in some], [f.path for f in some], pa.array([f.size for f in some], pa.int64()), [f.type == fs.FileType.Directory for f in some]]
                    yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), columns[2], pa.array(columns[3], pa.bool_())], names=["stem", "path", "size", "folder"])

    folders = spark.createDataFrame(pa.table({"path": pa.array([base], pa.string())}))
    while True:
        level = kept(folders.mapInArrow(run, "stem string, path string, size long, folder boolean"), f"{made}/{len(tables)}")
        tables.append(level.where(~F.col("folder")).drop("folder"))
        folders = level.where("folder").select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, tables)
        folders = folders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")


#: Bytes of text after which a task hands over what it has read.
_BATCH_BYTES = 4 << 20


def listed(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(stem, path, size) of the files of a folder whose names fit a pattern; ``<folder>/*`` has those of its folders too. No file is opened.

    A folder is listed in a task, so the driver has only the folders' names. Hidden files (``.``, ``_``) are left out.
    """
    store, base = fs.FileSystem.from_uri(folder.removesuffix("/*"))
    below = [f.path for f in store.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.Directory and not f.base_name.startswith((".", "_"))] if folder.endswith("/*") else []

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder.removesuffix("/*"))
        for batch in batches:
            for one in batch.column(0).to_pylist():
                own = store.get_file_info(fs.FileSelector(one, recursive=recursive))
                own = [f for f in own if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern) and not any(p.startswith((".", "_")) for p in f.path[len(base) :].split("/"))]
                for i in range(0, len(own), 8192):
                    some = own[i : i + 8192]
                    stems = [f.base_name.rsplit(".", 1)[0] for f in some]
                    yield pa.record_batch([pa.array(stems, pa.string()), pa.array([f.path for f in some], pa.string()), pa.array([f.size for f in some], pa.int64())], names=["stem", "path", "size"])

    folders = [base, *below] if not recursive else [base]
    rows = spark.createDataFrame(pa.table({"folder": pa.array(folders, pa.string())}))
    return rows.repartition(len(folders), "folder").mapInArrow(run, "stem string, path string, size long")


def opened(rows: DataFrame, folder: str, path: str = "path", out: str = "markdown") -> DataFrame:
    """``rows`` with the text of the file at ``path``, in the store of ``folder``. Rows are dealt to all cores before, so texts cross no exchange for it.

    An empty file is an empty text; bytes that are not UTF-8 raise.
    """
    spark, at = rows.sparkSession, rows.columns.index(path)
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder.removesuffix("/*"))
        for batch in batches:
            begin, texts, held = 0, [], 0
            for name in batch.column(at).to_pylist():
                with store.open_input_file(name) as f:
                    raw = f.read()
                texts.append(raw.decode())
                held += len(raw)
                if held >= _BATCH_BYTES or begin + len(texts) == len(batch):
                    yield pa.record_batch([*batch.slice(begin, len(texts)).columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])
                    begin, texts, held = begin + len(texts), [], 0

    return rows.repartition(tasks, path).mapInArrow(run, StructType([*rows.schema.fields, StructField(out, StringType())]))


def write_files(rows: DataFrame, folder: str, path: str = "path", content: str = "content") -> int:
    """Write the content of each row (text or binary) to a file below ``folder``, in the tasks; how many. A path outside the folder raises.

    A file is there only when it is whole; a task that runs again writes the same files. A null content is an empty file.
    """
    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        there = set()
        for batch in batches:
            n = 0
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"{name} is outside the folder")
                target = f"{base}/{name}"
                above = target.rsplit("/", 1)[0]
                if above not in there:
                    store.create_dir(above)
                    there.add(above)
                part = f"{above}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(body.as_buffer() if body.is_valid else b"")
                store.move(part, target)
                n += 1
            yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    return rows.select(F.col(path), F.col(content)).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
