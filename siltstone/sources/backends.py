"""Listings of storage backends as a Python data source.

A backend is a function from an address to a pyarrow file system and the path in
it; its name is the address's scheme. Prefixes of paths and the exclusion of
hidden entries are pushed into the listing, so that folders outside are not
opened. That takes the setting ``spark.sql.python.filterPushdown.enabled``, on when
the listing is made and when it is read; without, a listing is whole and Spark filters it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, IsNotNull, Not, StringStartsWith

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

Backend = Callable[[str], tuple[fs.FileSystem, str]]


def _by_uri(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address)


def _local(address: str) -> tuple[fs.FileSystem, str]:
    return fs.LocalFileSystem(), urlsplit(address).path or address


class Registry:
    """Backends by name; those that pyarrow knows are there from the start."""

    def __init__(self) -> None:
        self.backends: dict[str, Backend] = {"local": _local, "file": _local, "s3": _by_uri, "gs": _by_uri, "hdfs": _by_uri, "abfs": _by_uri}

    def register(self, name: str, backend: Backend) -> None:
        """Add a backend, or put it in the place of the one so named."""
        self.backends[name] = backend

    def unregister(self, name: str) -> bool:
        return self.backends.pop(name, None) is not None

    def names(self) -> list[str]:
        return sorted(self.backends)

    def find(self, address: str) -> Backend:
        """The backend of an address; one without a scheme is local."""
        name = urlsplit(address).scheme or "local"
        if name not in self.backends:
            raise ValueError(f"no backend is registered as {name}")
        return self.backends[name]


REGISTRY = Registry()

#: Folders are opened on the driver until there are so many to hand out.
WANTED = 32


class Folder(InputPartition):
    """A folder below the root, with all below it or its own files only."""

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class WholeReader(DataSourceReader):
    """A listing without pushdown: Spark refuses a reader that takes filters while the setting is off."""

    def __init__(self, address: str, backend: Backend):
        self.address, self.backend = address, backend
        self.prefix, self.skip_hidden, self.impossible = "", False, False
        self.opened = 0

    def _entries(self, folder: str) -> tuple[list[str], list[tuple]]:
        """(folders, files) in a folder that the filters let pass; names are from the root on."""
        self.opened += 1
        system, root = self.backend(self.address)
        root = root.rstrip("/")
        folders, files = [], []
        for info in system.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/") or "/", allow_not_found=bool(folder))):
            name = f"{folder}/{info.base_name}" if folder else info.base_name
            hidden = any(part.startswith(".") for part in name.split("/"))
            if hidden and self.skip_hidden:
                continue
            if info.type == fs.FileType.Directory:
                if f"{name}/".startswith(self.prefix) or self.prefix.startswith(f"{name}/"):
                    folders.append(name)
            elif info.type == fs.FileType.File and name.startswith(self.prefix):
                files.append((name, info.size, info.mtime, hidden))
        return sorted(folders), sorted(files, key=lambda f: f[0])

    def partitions(self) -> list[Folder]:
        """Folders are opened from the root down until there are enough of them, or no more."""
        if self.impossible:
            return []
        shallow: list[str] = []
        deep = [""]
        while deep and len(deep) < WANTED:
            found, some = [], False
            for folder in deep:
                below, files = self._entries(folder)
                if files:
                    shallow.append(folder)
                found += below
                some = some or bool(below)
            deep = found
            if not some:
                break
        return [Folder(f, False) for f in shallow] + [Folder(f, True) for f in deep]

    def read(self, partition: Folder) -> Iterator[tuple]:
        stack = [partition.path]
        while stack:
            folders, files = self._entries(stack.pop())
            yield from files
            if partition.deep:
                stack += folders


class ListingReader(WholeReader):
    """A listing that opens no folder outside the prefix, nor hidden ones where they are left out."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            match f:
                case StringStartsWith(attribute=("path",), value=value):
                    if value.startswith(self.prefix):
                        self.prefix = value
                    elif not self.prefix.startswith(value):
                        self.impossible = True
                case EqualTo(attribute=("hidden",), value=False) | Not(child=EqualTo(attribute=("hidden",), value=True)):
                    self.skip_hidden = True
                case IsNotNull(attribute=("path",) | ("hidden",)):
                    pass
                case _:
                    yield f


class Listing(DataSource):
    """Rows (path below the root, size, modified, hidden) of the files of ``root``, an address."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.backend, self.pushed = REGISTRY.find(options["root"]), False

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return "path string, size long, modified timestamp, hidden boolean"

    def reader(self, schema) -> DataSourceReader:
        return (ListingReader if self.pushed else WholeReader)(self.options["root"], self.backend)


def folder_listing(spark: SparkSession, root: str, backend: Backend | None = None) -> DataFrame:
    """The listing of an address, by the backend of its scheme or a given one."""
    held, on = backend or REGISTRY.find(root), spark.conf.get(PUSHDOWN, "false") == "true"

    class Given(Listing):
        def __init__(self, options: dict[str, str]):
            DataSource.__init__(self, options)
            self.backend, self.pushed = held, on

    spark.dataSource.register(Given)
    return spark.read.format("folder_listing").option("root", root).load()
