"""Put-if-absent commits in a folder that several writers share.

Data is written under a folder of its own for each attempt; a commit is one small marker that names the attempt. The
marker appears whole or not at all, and only one writer's can: whoever comes second is told so and reads the winner's.
Folders are reached through Hadoop's file systems, like Spark's own.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession
from py4j.protocol import Py4JJavaError

MARKER = "COMMIT.json"


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    place, files = _path(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies directly in a folder; nothing if there is none."""
    place, files = _path(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    place, files = _path(spark, path)
    files.delete(place, True)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text unless it exists; whether this call created it.

    The text is written beside it first. On a local file system a hard link then gives it its name, which fails if
    the name is taken; elsewhere a rename that never overwrites does.
    """
    jvm = spark._jvm
    place, files = _path(spark, path)
    if files.exists(place):
        return False
    files.mkdirs(place.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".draft-{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if files.getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(place), local(draft))
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, place, none)
        return True
    except (Py4JJavaError, CapturedException):
        if not files.exists(place):
            raise
        return False
    finally:
        files.delete(draft, False)


def committed(spark: SparkSession, folder: str) -> dict | None:
    """The facts of the folder's commit, with the place of its data; None if nothing was committed."""
    text = read_text(spark, f"{folder}/{MARKER}")
    if text is None:
        return None
    facts = json.loads(text)
    return facts | {"data": f"{folder}/{facts['attempt']}"}


def attempt(spark: SparkSession, folder: str, df: DataFrame) -> str:
    """Write ``df`` where no other writer writes; its name within the folder."""
    name = f"attempt-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    return name


def commit(spark: SparkSession, folder: str, name: str, facts: dict) -> tuple[dict, bool]:
    """Make an attempt the folder's content, unless it has one; the content's facts, and whether they are these.

    An attempt that comes second is removed."""
    won = put_if_absent(spark, f"{folder}/{MARKER}", json.dumps(facts | {"attempt": name}))
    if not won:
        remove(spark, f"{folder}/{name}")
    return committed(spark, folder), won
