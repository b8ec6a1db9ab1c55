"""Versioned roots: sets of tables that are there whole or not at all.

Below a root::

    versions/<id>/<table>/    Parquet
    versions/<id>/MANIFEST    names, numbers of rows and identities of the tables, and the version before; canonical JSON
    journal/<id>              says that a version is being written
    CURRENT                   the current version and the digest of its manifest

A version is written beside the others and read back for its manifest; then one rename puts a new ``CURRENT`` in place of
the old one.  Whoever opens the root before that sees the old version, whoever opens it after it the new one.  What a
broken run left is in the journal, and the next run clears it away.  A root has one writer at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.digests import table_identity

POINTER, MANIFEST = "CURRENT", "MANIFEST"


class Store:
    """Small files and folders below a root, in whatever file system Hadoop finds for it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.root).getFileSystem(self._conf)

    def path(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def _at(self, name: str):
        return self._hadoop.Path(self.path(name))

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, folder: str = "") -> list[str]:
        """Entries of a folder in order; none if it is not there."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder))) if self.exists(folder) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, content: str) -> None:
        """A new file; one that is there is an error."""
        stream = self._fs.create(self._at(name), False)
        stream.write(bytearray(content.encode()))
        stream.close()

    def rename(self, source: str, target: str) -> None:
        """Move to where nothing is yet."""
        self._fs.mkdirs(self._at(target).getParent())
        if self.exists(target) or not self._fs.rename(self._at(source), self._at(target)):
            raise OSError(f"cannot move {self.path(source)} to {self.path(target)}")

    def rename_over(self, source: str, target: str) -> None:
        """Move a file to where another one may be, in one step."""
        gateway, option = self.spark.sparkContext._gateway, getattr(self._hadoop, "Options$Rename")
        options = gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._fs.makeQualified(self._at(source)), self._fs.makeQualified(self._at(target)), options)

    def write_table(self, name: str, rows: DataFrame) -> None:
        rows.write.parquet(self.path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def _canonical(value: dict) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _current(store: Store) -> str | None:
    return json.loads(store.read(POINTER))["version"] if store.exists(POINTER) else None


def manifest(spark: SparkSession, root: str) -> dict | None:
    """``{"version", "previous", "tables"}`` of the current version, None for a root without one.  A manifest that is not
    the one that the pointer was made for is an error."""
    store = Store(spark, root)
    if not store.exists(POINTER):
        return None
    pointer = json.loads(store.read(POINTER))
    text = store.read(f"versions/{pointer['version']}/{MANIFEST}")
    if _digest(text) != pointer["manifest_sha256"]:
        raise ValueError(f"{root}: the manifest of version {pointer['version']} is not what was published")
    return {"version": pointer["version"], **json.loads(text)}


def recover(spark: SparkSession, root: str) -> list[str]:
    """Clear away what a broken run left; the versions that were given up.  What the pointer names stays."""
    store, gone = Store(spark, root), []
    current = _current(store)
    for entry in store.names("journal"):
        version = entry.partition(".")[0]
        if version != current:
            store.delete(f"versions/{version}")
            gone.append(version)
        store.delete(f"journal/{entry}")
    return sorted(set(gone))


def _bound(rows: DataFrame) -> dict:
    found = table_identity(rows).first()
    return {"n_rows": found["n_rows"], "identity": found["identity"]}


def _point(store: Store, version: str, text: str) -> None:
    """The step that counts."""
    pointer = f"journal/{version}.pointer"
    store.create(pointer, _canonical({"version": version, "manifest_sha256": _digest(text)}))
    store.rename_over(pointer, POINTER)


def publish(tables: dict[str, DataFrame], root: str, replace: bool = False) -> str:
    """All tables as a new version: ``created``, or ``verified_existing`` if the current version holds equal ones.

    A current version with other tables or other rows is an error unless it is to be replaced (``replaced``).  Published
    versions stay until they are pruned.
    """
    spark = next(iter(tables.values())).sparkSession
    store = Store(spark, root)
    recover(spark, root)
    there = manifest(spark, root)
    if there:
        known = there["tables"]
        other = sorted(set(known) ^ set(tables)) or [name for name, rows in tables.items() if _bound(rows) != known[name]]
        if not other:
            return "verified_existing"
        if not replace:
            raise ValueError(f"{root} differs from what would be published: {', '.join(other)}")
    version = uuid.uuid4().hex
    store.create(f"journal/{version}", "")
    for name, rows in tables.items():
        store.write_table(f"versions/{version}/{name}", rows)
    bound = {name: _bound(spark.read.parquet(store.path(f"versions/{version}/{name}"))) for name in tables}
    text = _canonical({"tables": bound, "previous": there and there["version"]})
    store.create(f"versions/{version}/{MANIFEST}", text)
    _point(store, version, text)
    store.delete(f"journal/{version}")
    return "replaced" if there else "created"


def open_tables(spark: SparkSession, root: str, check: bool = False) -> dict[str, DataFrame]:
    """The tables of the current version by name; with ``check`` each is held against its identity in the manifest."""
    there = manifest(spark, root)
    if there is None:
        raise ValueError(f"{root} holds no version")
    found = {name: spark.read.parquet(f"{root.rstrip('/')}/versions/{there['version']}/{name}") for name in there["tables"]}
    if check and (bad := sorted(name for name, rows in found.items() if _bound(rows) != there["tables"][name])):
        raise ValueError(f"{root}: {', '.join(bad)} is not what was published")
    return found


def history(spark: SparkSession, root: str) -> list[str]:
    """The current version and those before it that are still there, latest first."""
    store, out, version = Store(spark, root), [], _current(Store(spark, root))
    while version and store.exists(f"versions/{version}/{MANIFEST}"):
        out.append(version)
        version = json.loads(store.read(f"versions/{version}/{MANIFEST}"))["previous"]
    return out


def rollback(spark: SparkSession, root: str) -> str:
    """Make the version before the current one current again, and say which that is."""
    store, known = Store(spark, root), history(spark, root)
    if len(known) < 2:
        raise ValueError(f"{root} has no version before the current one")
    _point(store, known[1], store.read(f"versions/{known[1]}/{MANIFEST}"))
    return known[1]


def prune(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete all versions but the current one and the ``keep`` before it; what was deleted."""
    store, kept = Store(spark, root), history(spark, root)[: keep + 1]
    gone = [v for v in store.names("versions") if v not in kept]
    for version in gone:
        store.delete(f"versions/{version}")
    return gone
