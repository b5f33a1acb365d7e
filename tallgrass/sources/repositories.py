"""A data source over many repositories: a manifest of folders, partitions planned by bytes, skipped files never opened.

    spark.dataSource.register(Repositories)
    spark.read.format("tallgrass_repositories").option("manifest", path).load()

The manifest is a Parquet file of (repository_id, folder) and, where it is known, bytes. Repositories of few bytes share a partition,
one of many is split by the hash of its files' paths, so that partitions have about `partition_bytes` each. Which files are
read follows from the path and size alone, before a file is opened: `skip` is `general` (what most detectors pass over),
`security` (which reads environment templates), `unread` (what no detector reads) or `none`. Files that aren't UTF-8 are dropped.
Paths are relative to the folder. Any store is read that Arrow has a file system for.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallgrass.sources import corpus

NAME = "tallgrass_repositories"
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
_ARROW = pa.schema([("repository_id", pa.string()), ("path", pa.string()), ("content", pa.string())])


def _path_and_name(path: str) -> tuple[str, str]:
    low = f"/{path}".lower()
    return low, low.rsplit("/", 1)[1]


def skipped(path: str, size: int = 0) -> bool:
    low, name = _path_and_name(path)
    return name.startswith(".") or any(p in low for p in corpus.SKIPPED_PARTS) or name.endswith(corpus.SKIPPED_ENDS)


def skipped_by_security(path: str, size: int = 0) -> bool:
    low, name = _path_and_name(path)
    return name.startswith(".") and not name.startswith(".env") or any(p in low for p in corpus.SECURITY_PARTS)


def unread(path: str, size: int = 0) -> bool:
    low, name = _path_and_name(path)
    config = name.endswith(corpus.CONFIG_ENDS) or any(w in name for w in ("config", "openapi", "swagger", "api-gateway"))
    by_ports = name.startswith(".") and not config or any(p in low for p in ("node_modules", "target", ".git", *corpus.VENV_PARTS))
    return skipped(path) and skipped_by_security(path) and by_ports


SKIPS: dict[str, Callable[[str, int], bool]] = {"general": skipped, "security": skipped_by_security, "unread": unread, "none": lambda path, size: False}


def listed(folder: str) -> Iterator[tuple[str, int]]:
    """path and size of a folder's files, from the store's listing alone."""
    fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
    for f in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        if f.type == pafs.FileType.File:
            yield f.path[len(root.rstrip("/")) + 1 :], f.size


def opened(folder: str, path: str) -> bytes:
    fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
    with fs.open_input_stream(f"{root.rstrip('/')}/{path}") as f:
        return f.read()


@dataclass
class Share(InputPartition):
    """Folders of a partition: (repository_id, folder, part, parts), the files whose path's hash falls in this part."""

    folders: list[tuple[str, str, int, int]]


def planned(rows: list[tuple[str, str, int]], most: int) -> list[list[tuple[str, str, int, int]]]:
    """Partitions of about `most` bytes each from (repository_id, folder, bytes)."""
    out: list[list[tuple[str, str, int, int]]] = []
    held, size = [], 0
    for repository, folder, n in rows:
        if n > most:
            parts = -(-n // most)
            out += [[(repository, folder, k, parts)] for k in range(parts)]
            continue
        if held and size + n > most:
            out.append(held)
            held, size = [], 0
        held.append((repository, folder, 0, 1))
        size += n
    return out + [held] * bool(held)


class RepositoriesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.manifest, self.skip = options["manifest"], SKIPS[options.get("skip", "general")]
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[Share]:
        table = pq.read_table(self.manifest)
        known = table.column("bytes").to_pylist() if "bytes" in table.column_names else [None] * len(table)
        rows = zip(table.column("repository_id").to_pylist(), table.column("folder").to_pylist(), known, strict=True)
        sized = [(str(r), f, sum(s for p, s in listed(f) if not self.skip(p, s)) if n is None else n) for r, f, n in rows]
        return [Share(x) for x in planned(sized, self.most)] or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for repository, folder, part, parts in partition.folders:
            for path, n in listed(folder):
                if zlib.crc32(path.encode()) % parts != part or self.skip(path, n):
                    continue
                try:
                    content = opened(folder, path).decode()
                except UnicodeDecodeError:
                    continue
                held.append({"repository_id": repository, "path": path, "content": content})
                size += n
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, _ARROW)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, _ARROW)


class Repositories(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return corpus.SCHEMA

    def reader(self, schema) -> RepositoriesReader:
        return RepositoriesReader(dict(self.options))


def read_repositories(spark: SparkSession, manifest: str, **options) -> DataFrame:
    """The prepared files of all repositories of a manifest."""
    spark.dataSource.register(Repositories)
    reader = spark.read.format(NAME).option("manifest", manifest)
    for k, v in options.items():
        reader = reader.option(k, v)
    return corpus.prepared(reader.load())
