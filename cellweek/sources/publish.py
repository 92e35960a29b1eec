"""Results that are replaced as a whole: a new folder, then a manifest that names it.

Readers follow the manifest, so they see the old result until the new one is complete, and a
write that stops in the middle leaves the old result as it was. The version before the current
one stays for readers that have already started; older ones go. What an interrupted write leaves
behind is named by no manifest and read by nobody.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

MANIFEST = "CURRENT"


def _paths(spark: SparkSession, *names: str):
    """The file system of some paths and the paths themselves."""
    jvm = spark.sparkContext._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(n) for n in names]
    return paths[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), *paths


def _versions(spark: SparkSession, path: str) -> list[str]:
    """The folders that the manifest names, the current one first; none without a manifest."""
    fs, manifest = _paths(spark, f"{path}/{MANIFEST}")
    if not fs.exists(manifest):
        return []
    stream = fs.open(manifest)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
    finally:
        stream.close()


def _point_to(spark: SparkSession, path: str, versions: list[str]) -> None:
    """Writes a manifest aside and moves it over the old one in a single rename."""
    jvm = spark.sparkContext._jvm
    fs, aside, manifest = _paths(spark, f"{path}/_{uuid.uuid4().hex}", f"{path}/{MANIFEST}")
    stream = fs.create(aside)
    stream.write(bytearray("\n".join(versions).encode()))
    stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(manifest).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(aside), fs.makeQualified(manifest), options)


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Calls write with a new folder and, once it is complete, makes that the result at path."""
    version = f"_v-{uuid.uuid4().hex}"
    write(f"{path}/{version}")
    before = _versions(spark, path)
    _point_to(spark, path, [version, *before[:1]])
    for old in before[1:]:
        fs, folder = _paths(spark, f"{path}/{old}")
        fs.delete(folder, True)


def current_path(spark: SparkSession, path: str) -> str:
    """The folder that holds the result; the path itself if nothing was published there."""
    versions = _versions(spark, path)
    return f"{path}/{versions[0]}" if versions else path
