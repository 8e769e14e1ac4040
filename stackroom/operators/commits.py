"""Tables that are written together: a commit of several tables is one new manifest, or none.

Data files are written first, each under a name of its own. A commit is the file `manifest/<version>` that lists the
folders of every table; it is created only if it isn't there, so of two writers one gets the version and the other
starts again from the newest one. Readers take one manifest and see its tables alone; a writer that fails before its
manifest leaves folders that no one reads, which `vacuum` removes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """The version is taken."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> dict | None:
    """A manifest; none while it is being written, or if its writer has died meanwhile."""
    p, fs = _fs(spark, path)
    with_ = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(with_, "UTF-8"))
    except ValueError:
        return None
    finally:
        with_.close()


def versions(spark: SparkSession, root: str) -> list[int]:
    p, fs = _fs(spark, f"{root}/manifest")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []


def manifest(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict[str, list[str]]]:
    """The newest whole manifest, or that of a version: its number (-1: nothing yet) and each table's folders."""
    for v in reversed(versions(spark, root) if version is None else [version]):
        found = _read(spark, f"{root}/manifest/{v}")
        if found is not None:
            return v, found
    return -1, {}


def read(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of one manifest."""
    return {name: spark.read.parquet(*[f"{root}/{f}" for f in folders]) for name, folders in manifest(spark, root, version)[1].items() if folders}


def write_data(root: str, tables: dict[str, DataFrame]) -> dict[str, str]:
    """Folders of the tables' rows, which no manifest names yet."""
    out = {}
    for name, df in tables.items():
        out[name] = f"data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{root}/{out[name]}")
    return out


def publish(spark: SparkSession, root: str, version: int, folders: dict[str, list[str]]) -> None:
    p, fs = _fs(spark, f"{root}/manifest/{version}")
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        raise Conflict(str(version)) from e
    try:
        out.write(bytearray(json.dumps(folders).encode()))
    finally:
        out.close()


def append(spark: SparkSession, root: str, tables: dict[str, DataFrame], tries: int = 20) -> int:
    """Add rows to several tables at once; the new version. Appends of others in between are kept."""
    new = write_data(root, tables)
    for _ in range(tries):
        taken = versions(spark, root)
        _, old = manifest(spark, root)
        try:
            version = taken[-1] + 1 if taken else 0
            publish(spark, root, version, {n: old.get(n, []) + ([new[n]] if n in new else []) for n in sorted(old.keys() | new.keys())})
            return version
        except Conflict:
            continue
    raise Conflict(root)


def rewrite(spark: SparkSession, root: str, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> int:
    """Replace tables by what `change` makes of the newest ones; a conflict if another commit came in between."""
    taken = versions(spark, root)
    version, old = manifest(spark, root)
    new = write_data(root, change(read(spark, root, version) if version >= 0 else {}))
    publish(spark, root, taken[-1] + 1 if taken else 0, old | {n: [f] for n, f in new.items()})
    return versions(spark, root)[-1]


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Remove folders that none of the last `keep` manifests names; how many."""
    named = {f for v in versions(spark, root)[-keep:] for x in (_read(spark, f"{root}/manifest/{v}") or {}).values() for f in x}
    p, fs = _fs(spark, f"{root}/data")
    gone = [f.getPath() for f in (fs.listStatus(p) if fs.exists(p) else []) if f"data/{f.getPath().getName()}" not in named]
    for f in gone:
        fs.delete(f, True)
    return len(gone)
