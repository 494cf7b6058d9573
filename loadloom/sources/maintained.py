"""Pre-aggregates kept up to date part by part: mergeable state, and a manifest of what it was built from."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "part string, stamp string, folder string"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def source_parts(spark: SparkSession, path: str) -> dict[str, str]:
    """Part -> stamp of a Parquet table: a part is a partition folder (or the table itself), its stamp names, sizes and times of its files.

    Only the file listing is read, so looking for changes does not scan the table.
    """
    root, fs = _file_system(spark, path)
    home = fs.getFileStatus(root)
    base = home.getPath().toString()
    if home.isFile():
        return {"": f"{home.getLen()}:{home.getModificationTime()}"}
    found: dict[str, list[str]] = {}
    files = fs.listFiles(root, True)
    while files.hasNext():
        f = files.next()
        folder, _, name = f.getPath().toString().removeprefix(base).lstrip("/").rpartition("/")
        if not name.startswith(("_", ".")) and not any(x.startswith(("_", ".")) for x in folder.split("/")):
            found.setdefault(folder, []).append(f"{name}:{f.getLen()}:{f.getModificationTime()}")
    return {part: hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest() for part, names in found.items()}


def _read_manifest(spark: SparkSession, root: str) -> dict[str, tuple[str, str]]:
    path, fs = _file_system(spark, f"{root}/manifest")
    if not fs.exists(path):
        return {}
    versions = sorted(s.getPath().getName() for s in fs.listStatus(path) if fs.exists(_file_system(spark, f"{s.getPath().toString()}/_SUCCESS")[0]))
    if not versions:
        return {}
    rows = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest/{versions[-1]}").collect()
    return {r["part"]: (r["stamp"], r["folder"]) for r in rows}


def refresh(spark: SparkSession, root: str, parts: dict[str, str], build: Callable[[str], DataFrame]) -> list[str]:
    """Aggregate the parts whose stamp is new and return their names; the manifest then names exactly ``parts``.

    ``build(part)`` returns a part's mergeable state. A part is written to a folder of its own and the manifest's
    next version is written last, so a reader sees the old state or the new one, and a failed refresh leaves the old one.
    """
    held = _read_manifest(spark, root)
    changed = [p for p, stamp in parts.items() if held.get(p, ("", ""))[0] != stamp]
    if not changed and set(held) == set(parts):
        return []
    now = {p: held[p] for p in parts if p in held}
    for p in changed:
        folder = f"state-{uuid.uuid4().hex}"
        build(p).write.parquet(f"{root}/{folder}")
        now[p] = (parts[p], folder)
    path, fs = _file_system(spark, f"{root}/manifest")
    number = len(fs.listStatus(path)) if fs.exists(path) else 0
    (spark.createDataFrame([(p, stamp, folder) for p, (stamp, folder) in now.items()], _MANIFEST).coalesce(1)
     .write.parquet(f"{root}/manifest/{number:08d}-{uuid.uuid4().hex}"))
    return changed


def state(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """The states of all parts, one after the other; merging them is the reader's aggregate."""
    folders = [f"{root}/{folder}" for _, folder in _read_manifest(spark, root).values()]
    if not folders:
        raise ValueError(f"nothing was aggregated under {root}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*folders)


def merged(df: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Additive state folded over the parts and any key left out of ``by``."""
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])

