"""Versioned folders behind one pointer.

A writer fills a new folder and switches the pointer last, in one rename; whatever stops it before
leaves the version that readers see.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from basketline.session import path_exists

POINTER = "CURRENT"


def new_version(root: str) -> str:
    return f"{root}/v-{uuid.uuid4().hex}"


def current(spark: SparkSession, root: str) -> str | None:
    """The folder that the pointer names, or None before the first switch."""
    if not path_exists(spark, f"{root}/{POINTER}"):
        return None
    return spark.read.text(f"{root}/{POINTER}").first()[0]


def require_current(spark: SparkSession, root: str) -> str:
    folder = current(spark, root)
    if folder is None:
        raise FileNotFoundError(f"{root} holds no version yet")
    return folder


def switch(spark: SparkSession, root: str, folder: str) -> None:
    """Let readers see a folder: the pointer is written beside the old one and renamed over it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs_package = jvm.org.apache.hadoop.fs
    target, staged = fs_package.Path(f"{root}/{POINTER}"), fs_package.Path(f"{root}/.{POINTER}-{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    out = fs.create(staged, True)
    out.write(bytearray(f"{folder}\n".encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(fs_package.Options.Rename, 1)
    options[0] = fs_package.Options.Rename.OVERWRITE
    fs_package.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), conf).rename(staged, target, options)


def folder_bytes(spark: SparkSession, path: str) -> int:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop_path).getLength()
