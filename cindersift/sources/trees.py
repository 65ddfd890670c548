"""File trees as a data source (S1, S2): names that start with a dot are read where asked for, skipped folders are never listed.

``spark.read.format("filetree").option("hidden", "true").load(folder)``: Spark's own file index hides names that start with a dot
or an underscore. This source walks folders itself, through Arrow's file systems, so any address they know will do if all
executors reach it. The driver lists only as many upper folders as make SPLITS parts of the tree; each part is walked, pruned
and read by a task, with at most one file in memory.

Columns: repo (the folder's name), file (path below it), ext, filename, content (undecodable bytes replaced), lines, bytes.

Defined results: what a walk skips (SKIPPED folders; hidden ones unless ``hidden`` is set), other endings and names, and files over ``maxBytes``
are no rows; a name that is only a dot and letters (``.env``) is its own ending, in lower case; files that vanish or can't be read meanwhile
are left out; an empty folder gives no rows; a missing one is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cindersift.sources.scanners import CODE, CONFIG, MANIFESTS, MAX_BYTES, SKIPPED

SPLITS = 256
_SKIPPED = frozenset(SKIPPED.replace("\\", "").split("|"))
_ENDINGS = frozenset(CODE + CONFIG)


def ending(name: str) -> str:
    """The ending with its dot, in lower case; of a name that has only its first dot, the name itself."""
    dot = name.rfind(".")
    return name[dot:].lower() if dot >= 0 else ""


def wanted(name: str) -> bool:
    return ending(name) in _ENDINGS or name in MANIFESTS or name.startswith(("Dockerfile", "docker-compose"))


@dataclass
class Part(InputPartition):
    """A folder, with all below it or only its own files."""

    path: str
    deep: bool


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.max_bytes = int(options.get("maxbytes", MAX_BYTES))
        self.splits = int(options.get("splits", SPLITS))

    def _opened(self):
        from pyarrow import fs

        # An address of a scheme, or a path of this system.
        return fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root.rstrip("/") or "/")

    def _listed(self, system, folder: str) -> tuple[list, list[str]]:
        """A folder's files, and its folders that a walk goes into, both by name."""
        from pyarrow import fs

        files, folders = [], []
        for x in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda x: x.base_name):
            if x.type == fs.FileType.Directory:
                if x.base_name not in _SKIPPED and (self.hidden or not x.base_name.startswith(".")):
                    folders.append(x.path)
            elif x.type == fs.FileType.File and wanted(x.base_name) and x.size is not None and x.size <= self.max_bytes:
                files.append(x)
        return files, folders

    def partitions(self) -> list[Part]:
        system, root = self._opened()
        parts, waiting = [], [root]
        while waiting and len(parts) + len(waiting) < self.splits:
            folder = waiting.pop(0)
            parts.append(Part(folder, False))
            waiting += self._listed(system, folder)[1]
        return parts + [Part(folder, True) for folder in waiting]

    def read(self, partition: Part) -> Iterator[tuple]:
        system, root = self._opened()
        repo, waiting = root.rstrip("/").rpartition("/")[2], [partition.path]
        while waiting:
            try:
                files, folders = self._listed(system, waiting.pop())
            except FileNotFoundError:
                continue
            waiting += folders if partition.deep else []
            for x in files:
                try:
                    with system.open_input_stream(x.path) as f:
                        raw = f.read()
                except OSError:
                    continue
                content = raw.decode("utf-8", "replace")
                yield repo, x.path[len(root.rstrip("/")) + 1 :], ending(x.base_name), x.base_name, content, content.count("\n") + 1, len(raw)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "repo string, file string, ext string, filename string, content string, lines int, bytes long"

    def reader(self, schema) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def tree(spark: SparkSession, root: str, *, hidden: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files of a tree, hidden ones such as ``.github/workflows`` included unless told otherwise; ``.env`` always is."""
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").option("hidden", str(hidden).lower()).option("maxBytes", max_bytes).load(root)
