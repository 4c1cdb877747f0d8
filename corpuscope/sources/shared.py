"""Small files in any store that Spark reaches, through Hadoop's file systems: put if absent, replace whole, list, read."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def read(spark: SparkSession, path: str) -> str:
    """The text as it stands there now; whether it has been changed is for its readers to tell."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.newInstance(where.toUri(), spark._jsc.hadoopConfiguration())
    fs.setVerifyChecksum(False)
    try:
        stream = fs.open(where)
        try:
            return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
    finally:
        fs.close()


def names(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Full paths in a folder by a glob pattern, in order; none where there is no such folder."""
    fs, where = _at(spark, folder)
    if not fs.exists(where):
        return []
    keep = spark._jvm.org.apache.hadoop.fs.GlobFilter(pattern)
    return sorted(s.getPath().toString() for s in fs.listStatus(where, keep))


def _write(spark: SparkSession, path: str, body: str, overwrite: bool) -> None:
    fs, where = _at(spark, path)
    stream = fs.create(where, overwrite)
    try:
        stream.write(bytearray(body.encode()))
    finally:
        stream.close()


def put(spark: SparkSession, path: str, body: str) -> None:
    """Writes a file that isn't there yet; the store refuses the second of two writers. The same content again is no error."""
    if not exists(spark, path):
        try:
            return _write(spark, path, body, overwrite=False)
        except Exception:
            if not exists(spark, path):
                raise
    if read(spark, path) != body:
        raise FileExistsError(f"{path} holds something else")


def replace(spark: SparkSession, path: str, body: str) -> None:
    """Writes a file whole or not at all, in place of one that may be there."""
    fs, where = _at(spark, path)
    parked = f"{path}.{uuid.uuid4().hex}.tmp"
    _write(spark, parked, body, overwrite=False)
    fs.delete(where, False)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(parked), where):
        raise OSError(f"{path} can't be written")


def put_json(spark: SparkSession, path: str, value: object) -> None:
    put(spark, path, json.dumps(value, sort_keys=True, indent=1, ensure_ascii=False))
