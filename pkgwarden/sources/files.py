"""Small files beside the tables: listing, reading, and creating a file exactly once.

These go through the file system of the path, as Spark's own readers and writers do.
"""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _is(error: Py4JJavaError, name: str) -> bool:
    """Whether a Java error, or what caused it, is of the class of this simple name."""
    cause = error.java_exception
    while cause is not None:
        if cause.getClass().getSimpleName() == name:
            return True
        cause = cause.getCause()
    return False


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, ascending; none where there is no such folder."""
    system, place = _place(spark, folder)
    try:
        return sorted(status.getPath().getName() for status in system.listStatus(place))
    except Py4JJavaError as error:
        if _is(error, "FileNotFoundException"):
            return []
        raise


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return system.exists(place)


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    system, place = _place(spark, path)
    stream = system.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a file or a folder with all it holds; false where nothing is stored."""
    system, place = _place(spark, path)
    return system.delete(place, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text unless there is one; tells whether this call created it.

    The text is written beside it first and then given the name, in one step that fails if the name
    is taken: a reader sees the whole text or no file, and of any number of writers one wins. That
    step is a hard link on a local (or locally mounted) file system and a rename that does not
    replace on others; it is atomic where the store's rename is, as HDFS's. Stores that
    copy to rename need a file system client that offers conditional writes for it.
    """
    system, place = _place(spark, path)
    draft_path = f"{path.rpartition('/')[0]}/.draft-{uuid.uuid4().hex}"
    if system.getUri().getScheme() == "file":
        target = place.toUri().getPath()
        draft = _place(spark, draft_path)[1].toUri().getPath()
        os.makedirs(os.path.dirname(draft), exist_ok=True)
        with open(draft, "x", encoding="utf-8", newline="") as file:
            file.write(text)
            file.flush()
            os.fsync(file.fileno())
        try:
            os.link(draft, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    return _renamed(spark, draft_path, path, text)


def _renamed(spark: SparkSession, draft_path: str, path: str, text: str) -> bool:
    system, draft = _place(spark, draft_path)
    stream = system.create(draft, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    keep = gateway.new_array(options, 1)
    keep[0] = options.NONE
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), hadoop)
    try:
        context.rename(draft, _place(spark, path)[1], keep)
    except Py4JJavaError as error:
        system.delete(draft, False)
        if _is(error, "FileAlreadyExistsException"):
            return False
        raise
    return True
