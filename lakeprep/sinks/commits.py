"""Commit markers: what readers of a dataset of several folders may see.

A writer puts data into a folder of its own and then commits it by a marker file under ``<root>/_commits``.
The marker is written beside its place and renamed into it, so it is there whole or not at all. Readers list
the markers and read the folders they name; a folder without a marker is unfinished or was given up.
"""

from __future__ import annotations

import datetime as _dt
import json
import re
import uuid

from pyspark.sql import SparkSession

COMMITS = "_commits"
_VERSION = re.compile(r"^v\d{20}-[0-9a-f]{8}$")


def version_time(when: _dt.datetime) -> str:
    """How names of versions that began at ``when`` begin."""
    return f"v{when:%Y%m%d%H%M%S%f}"


def new_version() -> str:
    """A folder name that sorts by the time it was made."""
    return f"{version_time(_dt.datetime.now(_dt.timezone.utc))}-{uuid.uuid4().hex[:8]}"


def is_version(name: str) -> bool:
    return bool(_VERSION.match(name))


def file_system(spark: SparkSession, path: str):
    """``(file system, path)`` of a location, as the JVM's objects."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def sub_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path`` (a listing, no data read); none if there is no such path."""
    fs, place = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place) if s.isDirectory()) if fs.exists(place) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = file_system(spark, path)
    return fs.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder if it is there."""
    fs, place = file_system(spark, path)
    if fs.exists(place):
        fs.delete(place, True)


def rename(spark: SparkSession, src: str, dst: str) -> None:
    """Rename through the Hadoop FileSystem of ``dst`` (atomic on HDFS and local disks, a copy on object stores)."""
    fs, target = file_system(spark, dst)
    fs.mkdirs(target.getParent())
    if not fs.rename(file_system(spark, src)[1], target):
        raise OSError(f"could not move {src} to {dst}")


def commit(spark: SparkSession, root: str, name: str, content: dict) -> None:
    """Mark ``name`` as committed; a second commit of one name is refused."""
    folder = f"{root.rstrip('/')}/{COMMITS}"
    if exists(spark, f"{folder}/{name}"):
        raise FileExistsError(f"{name} is committed under {root} already")
    draft = f"{folder}/.{name}-{uuid.uuid4().hex[:8]}"
    fs, place = file_system(spark, draft)
    out = fs.create(place, False)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    rename(spark, draft, f"{folder}/{name}")


def committed(spark: SparkSession, root: str) -> list[str]:
    """Names committed under ``root``, sorted."""
    fs, place = file_system(spark, f"{root.rstrip('/')}/{COMMITS}")
    if not fs.exists(place):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(place) if s.isFile())
    return sorted(n for n in names if not n.startswith((".", "_")))


def content(spark: SparkSession, root: str, name: str) -> dict:
    """What a marker says (one short file)."""
    fs, place = file_system(spark, f"{root.rstrip('/')}/{COMMITS}/{name}")
    size, source = fs.getFileStatus(place).getLen(), fs.open(place)
    try:
        return json.loads(bytes(source.readNBytes(size)).decode())
    finally:
        source.close()


def forget(spark: SparkSession, root: str, name: str) -> None:
    """Take a marker away and then the folder it names: readers that list now do not meet it half deleted."""
    remove(spark, f"{root.rstrip('/')}/{COMMITS}/{name}")
    remove(spark, f"{root.rstrip('/')}/{name}")
