"""Small helpers over the Hadoop file system, for any storage that Spark reads."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def fs_of(spark: SparkSession, path: str):
    """The path object and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = fs_of(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, none if it does not exist."""
    p, fs = fs_of(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def empty_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Path and modification time (ms) of the files of no bytes below a
    folder.  Spark's own file sources leave such files out of every scan."""
    p, fs = fs_of(spark, path)
    found, listed = [], fs.listFiles(p, True)
    while listed.hasNext():
        f = listed.next()
        if f.getLen() == 0 and not f.getPath().getName().startswith(("_", ".")):
            found.append((f.getPath().toString(), f.getModificationTime()))
    return found


def size(spark: SparkSession, path: str) -> int:
    p, fs = fs_of(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def delete(spark: SparkSession, path: str) -> None:
    p, fs = fs_of(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    src, fs = fs_of(spark, source)
    dst, _ = fs_of(spark, target)
    fs.mkdirs(dst.getParent())
    if not fs.rename(src, dst):
        raise IOError(f"could not publish {source} -> {target}")


def commits(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the commits of a table, ascending."""
    return [int(n) for n in names(spark, f"{root}/_log") if n.isdigit()]


def read_commit(spark: SparkSession, root: str, number: int | None = None) -> dict | None:
    """What a commit of a table says (default: the newest); None before the
    first one."""
    if number is None:
        found = commits(spark, root)
        if not found:
            return None
        number = found[-1]
    p, fs = fs_of(spark, f"{root}/_log/{number:012d}")
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_commit(spark: SparkSession, root: str, said: dict) -> int:
    """Add a commit: written beside the others, then renamed, so a reader
    finds the one before or this one, whole."""
    number = (commits(spark, root) or [-1])[-1] + 1
    draft = f"{root}/_log/_draft-{uuid.uuid4().hex[:12]}"
    p, fs = fs_of(spark, draft)
    out = fs.create(p, True)
    try:
        out.write(json.dumps(said).encode())
    finally:
        out.close()
    rename(spark, draft, f"{root}/_log/{number:012d}")
    return number
