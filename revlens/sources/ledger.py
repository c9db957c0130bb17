"""Tables whose appends happen once, however often a job is run again (§2.1, §2.10).

A table is a folder of parts and a ledger. A write names its writer and batch; its rows go into a folder of their own,
and only then one file appears in the ledger, by a rename, under a name made of writer and batch. Readers follow the
ledger alone:

* a job that dies between the two leaves a folder that nobody reads;
* a batch that is run again finds its name in the ledger and writes nothing;
* of two runs of a batch that go on at the same time the one whose rename comes first counts.

``publish`` uses the same ledger for a table that is replaced as a whole: a version is read once it stands there, and
until then the one before. Ledger files are small and one per batch; ``compact`` puts those of many batches into one.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LEDGER = "_ledger"
PARTS = "parts"
SUMMARY = "summary-"
FORMATS = {"parquet": {"compression": "zstd"},
           "csv": {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
                   "ignoreTrailingWhiteSpace": "false"},
           "json": {}}


class _Store:
    """The files of a table on whatever store Spark reads it from."""

    def __init__(self, spark: SparkSession, table: str):
        self.jvm, self.table = spark._jvm, table.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.table}/{name}" if name else self.table)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def appear(self, name: str, text: str) -> bool:
        """Puts a whole file in place unless one is there; readers see all of it or nothing."""
        hidden = self._path(f"{LEDGER}/.{uuid.uuid4().hex}")
        out = self.fs.create(hidden, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        done = not self.exists(name) and self.fs.rename(hidden, self._path(name))
        if not done:
            self.fs.delete(hidden, False)
        return done

    def delete(self, name: str):
        self.fs.delete(self._path(name), True)


def _entry_name(writer: str, batch: int) -> str:
    return f"{quote(writer, safe='')}.{int(batch):020d}.json"


def _entries(store: _Store) -> dict[str, dict]:
    """Name -> entry of all that is committed, summaries first."""
    out: dict[str, dict] = {}
    names = [n for n in store.names(LEDGER) if n.endswith(".json")]
    for n in names:
        if n.startswith(SUMMARY):
            out.update(json.loads(store.read(f"{LEDGER}/{n}")))
    for n in names:
        if not n.startswith(SUMMARY) and n not in out:
            out[n] = json.loads(store.read(f"{LEDGER}/{n}"))
    return out


def is_committed(spark: SparkSession, table: str, writer: str, batch: int) -> bool:
    store, name = _Store(spark, table), _entry_name(writer, batch)
    return store.exists(f"{LEDGER}/{name}") or any(
        name in json.loads(store.read(f"{LEDGER}/{n}")) for n in store.names(LEDGER) if n.startswith(SUMMARY))


def write_part(df: DataFrame, table: str, fmt: str = "parquet") -> str:
    """Writes the rows of a batch where no reader sees them yet; the part's name."""
    part = f"{PARTS}/{uuid.uuid4().hex}"
    df.write.options(**FORMATS[fmt]).format(fmt).save(f"{table.rstrip('/')}/{part}")
    return part


def commit(spark: SparkSession, table: str, writer: str, batch: int, part: str, fmt: str = "parquet") -> bool:
    """Makes a written part belong to the table; False if the batch was there already, and the part goes."""
    store = _Store(spark, table)
    store.fs.mkdirs(store._path(LEDGER))
    entry = {"writer": writer, "batch": int(batch), "part": part, "format": fmt}
    done = not is_committed(spark, table, writer, batch) and store.appear(
        f"{LEDGER}/{_entry_name(writer, batch)}", json.dumps(entry))
    if not done:
        store.delete(part)
    return done


def append_once(df: DataFrame, table: str, writer: str, batch: int, fmt: str = "parquet") -> bool:
    """Appends ``df`` to ``table`` as batch ``batch`` of ``writer``; a batch that is there already changes nothing and
    is not even computed. True if rows were added. A batch must hold the same rows whenever it is run."""
    spark = df.sparkSession
    if is_committed(spark, table, writer, batch):
        return False
    return commit(spark, table, writer, batch, write_part(df, table, fmt), fmt)


def read_committed(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed parts; a table without any is empty. CSV parts are bound to ``schema`` by name."""
    parts: dict[str, list[str]] = {}
    for e in _entries(_Store(spark, table)).values():
        parts.setdefault(e.get("format", "parquet"), []).append(f"{table.rstrip('/')}/{e['part']}")
    out = spark.createDataFrame([], schema)
    for fmt, paths in parts.items():
        if fmt == "csv":
            from .files import NA_TOKENS, _bind, _reader
            got = _bind(_reader(spark).option("inferSchema", "false").csv(paths), schema, NA_TOKENS)
        else:
            reader = spark.read.schema(schema).format(fmt)
            got = reader.load(paths)
        out = out.unionByName(got) if len(parts) > 1 else got
    return out


def publish(df: DataFrame, table: str, version: int) -> bool:
    """Makes ``df`` the whole table from now on, as version ``version`` (rising). What readers had stays until the next
    version stands; a version that stands already is not written again. Older versions but one go."""
    spark = df.sparkSession
    done = append_once(df, table, "version", version)
    store = _Store(spark, table)
    old = sorted((e["batch"], n, e["part"]) for n, e in _entries(store).items() if e["writer"] == "version")[:-2]
    for _, name, part in old:
        store.delete(f"{LEDGER}/{name}")
        store.delete(part)
    return done


def read_version(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """The newest version of a published table."""
    versions = [e for e in _entries(_Store(spark, table)).values() if e["writer"] == "version"]
    if not versions:
        return spark.createDataFrame([], schema)
    newest = max(versions, key=lambda e: e["batch"])
    return spark.read.schema(schema).parquet(f"{table.rstrip('/')}/{newest['part']}")


def compact(spark: SparkSession, table: str, keep: int = 1000) -> int:
    """Puts the ledger's entries into one file once there are more than ``keep``; how many went into it. The parts stay
    where they are. One such job at a time; readers and writers go on meanwhile."""
    store = _Store(spark, table)
    single = [n for n in store.names(LEDGER) if n.endswith(".json") and not n.startswith(SUMMARY)]
    if len(single) <= keep:
        return 0
    entries = _entries(store)
    summaries = [n for n in store.names(LEDGER) if n.startswith(SUMMARY)]
    if not store.appear(f"{LEDGER}/{SUMMARY}{uuid.uuid4().hex}.json", json.dumps(entries)):
        return 0
    for n in [*single, *summaries]:
        store.delete(f"{LEDGER}/{n}")
    return len(single)


def orphans(spark: SparkSession, table: str) -> list[str]:
    """Parts that no entry names: of jobs that died, or that are still at work."""
    store = _Store(spark, table)
    known = {e["part"] for e in _entries(store).values()}
    return [f"{PARTS}/{n}" for n in store.names(PARTS) if f"{PARTS}/{n}" not in known]


def sweep(spark: SparkSession, table: str) -> int:
    """Deletes the parts that no entry names; call it while no writer is at work."""
    lost = orphans(spark, table)
    for part in lost:
        _Store(spark, table).delete(part)
    return len(lost)
