"""Publishing results without a moment in which neither the old nor the new run is there.

An output is written whole into a run folder beside its target
(``_run-<id>``; readers pass over names that begin with ``_``) and only then
takes the target's place: the old folder moves into the run folder, the new one
moves to the target, the run folder goes.  A job that dies while it writes
leaves the old output as it was.  One that dies between the two moves leaves
its mark ``_READY``; ``recover`` - called before every publication - finishes
such a move, and puts back an old output whose successor is gone.

Moves are renames of the file system that holds the target, reached through
Hadoop, so HDFS and object-store connectors work like local folders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

RUN, READY = "_run-", "_READY"


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))


def _fs(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _move(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"cannot move {source} to {target}")


def recover(spark: SparkSession, target: str) -> int:
    """Finishes publications of ``target`` that were cut off between their moves; how many."""
    at = _path(spark, target)
    fs, done = _fs(spark, at), 0
    if not fs.exists(at.getParent()):
        return 0
    for status in fs.listStatus(at.getParent()):
        run = status.getPath()
        if not run.getName().startswith(f"{RUN}{at.getName()}-") or not fs.exists(_path(spark, str(run), READY)):
            continue
        new, old = _path(spark, str(run), "new"), _path(spark, str(run), "old")
        if not fs.exists(at) and (fs.exists(new) or fs.exists(old)):
            _move(fs, new if fs.exists(new) else old, at)
            done += 1
        fs.delete(run, True)
    return done


def publish(spark: SparkSession, target: str, write: Callable[[str], None]) -> str:
    """``write(folder)`` writes the output; it replaces ``target`` once it is whole."""
    recover(spark, target)
    at = _path(spark, target)
    fs = _fs(spark, at)
    run = _path(spark, str(at.getParent()), f"{RUN}{at.getName()}-{uuid.uuid4().hex}")
    new, old = _path(spark, str(run), "new"), _path(spark, str(run), "old")
    try:
        write(str(new))
    except BaseException:
        fs.delete(run, True)
        raise
    fs.create(_path(spark, str(run), READY)).close()
    if fs.exists(at):
        _move(fs, at, old)
    _move(fs, new, at)
    fs.delete(run, True)
    return target


def one_file(spark: SparkSession, rows: DataFrame, target: str) -> str:
    """An ordered frame as one CSV file with a header, in order, also when it is empty.

    The rows are written as ordered part files by as many tasks as the sort
    has; their bytes are then joined on the file system, buffer by buffer.  No
    task and no process holds the rows.  For exports that people download: the
    file is as long as the export.
    """
    def write(folder: str) -> None:
        rows.write.option("header", False).csv(folder + "-parts")
        parts, whole = _path(spark, folder + "-parts"), _path(spark, folder)
        fs = _fs(spark, parts)
        out = fs.create(whole)
        try:
            out.write(bytearray(",".join(map(_quoted, rows.columns)) + "\n", "utf-8"))
            for name in sorted(str(s.getPath()) for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-")):
                source = fs.open(_path(spark, name))
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                source.close()
        finally:
            out.close()

    return publish(spark, target, write)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '\\"') + '"' if any(c in name for c in ',"\n') else name
