"""A store as a Spark data source: ``spark.read.format("tallyport")`` after :func:`register`.

Options: ``path``; ``part``, which is ``pool`` (store, digest, length, content), ``dumps`` (store, ref, index_raw, layout_raw)
or, for streams, ``arrivals`` (ref, kind, body, seq: tag files as they come); ``store``, ``folder`` and ``algo`` as for
:func:`tallyport.sources.store.read_pool`; ``tasks``, how many the work is dealt to; ``settle``, the seconds that a file
must be old before a stream takes it.

Columns are pruned by ``.schema(...)``: files are opened only if a column needs their bytes. Filters on ``digest`` and ``ref``
(equal to, in) are pushed down: then only what they name is looked at, and nothing is listed.
"""

from __future__ import annotations

import time

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, SimpleDataSourceStreamReader

from tallyport.sources import store

SCHEMAS = {
    "pool": "store string, digest string, length bigint, content binary",
    "dumps": "store string, ref string, index_raw binary, layout_raw binary",
    "arrivals": "ref string, kind string, body binary, seq bigint",
}
_KEY = {"pool": "digest", "dumps": "ref"}
#: Hex digits of each algorithm's digests. Fixed values.
HEX = {"sha256": 64, "sha384": 96, "sha512": 128}


class StoreSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tallyport"

    def schema(self) -> str:
        part = self.options.get("part", "pool")
        if part not in SCHEMAS:
            raise ValueError(f"no part {part}: {', '.join(SCHEMAS)}")
        return SCHEMAS[part]

    def reader(self, schema) -> "StoreReader":
        return StoreReader(dict(self.options), schema)

    def simpleStreamReader(self, schema) -> "ArrivalReader":
        return ArrivalReader(dict(self.options))


class StoreReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.root, self.part = options["path"].rstrip("/"), options.get("part", "pool")
        self.store, self.folder, self.algo = options.get("store", "local"), options.get("folder", store.POOL), options.get("algo", "sha256")
        self.tasks = max(1, int(options.get("tasks", 64)))
        self.columns = [f.name for f in schema.fields]
        unknown = set(self.columns) - {c.split()[0] for c in SCHEMAS[self.part].split(", ")}
        if unknown:
            raise ValueError(f"no columns {sorted(unknown)} in {self.part}")
        self.asked: set | None = None

    def pushFilters(self, filters):
        """Takes equality with names and lists of names on the part's key; the others are Spark's."""
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe)) and f.attribute == (_KEY[self.part],):
                names = {f.value}
            elif isinstance(f, In) and f.attribute == (_KEY[self.part],):
                names = set(f.value)
            else:
                yield f
                continue
            names.discard(None)
            self.asked = names if self.asked is None else self.asked & names

    def partitions(self):
        if self.asked is not None:
            names = sorted(self.asked)
        elif self.part == "dumps":
            names = store.walk_dumps(self.root)
        else:
            own, base = store.file_system(f"{self.root}/{self.folder}/{self.algo}")
            names = [f"{self.algo}:{name}" for name, is_dir in store.children(own, base) if not is_dir and len(name) == HEX[self.algo]]
        step = -(-len(names) // self.tasks) or 1
        return [InputPartition(tuple(names[i : i + step])) for i in range(0, len(names), step)] or [InputPartition(())]

    def read(self, partition):
        own, base = store.file_system(self.root)
        make = self._blob if self.part == "pool" else self._dump
        for name in partition.value:
            row = make(own, base, name)
            if row is not None:
                yield tuple(row[c] for c in self.columns)

    def _raw(self, own, path: str) -> bytes | None:
        try:
            with own.open_input_stream(path) as f:
                return f.read()
        except (FileNotFoundError, NotADirectoryError):
            return None

    def _blob(self, own, base: str, digest: str) -> dict | None:
        from pyarrow import fs

        algo, _, hex_ = digest.partition(":")
        if HEX.get(algo) != len(hex_) or set(hex_) - set("0123456789abcdef"):
            return None
        path = f"{base}/{self.folder}/{algo}/{hex_}"
        info = own.get_file_info(path)
        if info.type != fs.FileType.File:
            return None
        content = self._raw(own, path) if "content" in self.columns else None
        return {"store": self.store, "digest": digest, "length": info.size, "content": content}

    def _dump(self, own, base: str, ref: str) -> dict | None:
        from pyarrow import fs

        marked = any(f"/{m}/" in f"/{ref}" for m in store.MARKERS) and not set(ref.split("/")) & {"", ".", ".."}
        if not marked or own.get_file_info(f"{base}/{ref}").type != fs.FileType.Directory:
            return None
        files = {c: self._raw(own, f"{base}/{ref}/{name}") if c in self.columns else None for c, name in zip(("index_raw", "layout_raw"), store.TAG_FILES)}
        return {"store": self.store, "ref": ref} | files


class ArrivalReader(SimpleDataSourceStreamReader):
    """Tag files by the time at which they were written; a batch is what lies between two times, so it can be read again."""

    def __init__(self, options: dict):
        self.root, self.settle = options["path"].rstrip("/"), float(options.get("settle", 1))

    def initialOffset(self) -> dict:
        return {"upto": 0}

    def _between(self, start: int, end: int):
        own, base = store.file_system(self.root)
        kinds = {"index.json": "index", "oci-layout": "layout"}
        for ref in store.walk_dumps(self.root):
            for info in own.get_file_info([f"{base}/{ref}/{name}" for name in kinds]):
                if info.mtime_ns is not None and start < info.mtime_ns <= end:
                    with own.open_input_stream(info.path) as f:
                        yield ref, kinds[info.base_name], f.read(), info.mtime_ns

    def read(self, start: dict):
        end = int((time.time() - self.settle) * 1e9)
        rows = sorted(self._between(start["upto"], end), key=lambda r: r[3])
        return iter(rows), {"upto": max([start["upto"], *(r[3] for r in rows)])}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(sorted(self._between(start["upto"], end["upto"]), key=lambda r: r[3]))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark push filters to it."""
    spark.dataSource.register(StoreSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
