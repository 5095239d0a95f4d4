"""Files in whatever store Spark can reach."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def full_uri(spark: SparkSession, path: str) -> str:
    """The path with its scheme and store."""
    where, fs = _at(spark, path)
    return fs.makeQualified(where).toString()


def write_stream(spark: SparkSession, path: str, head: bytes, parts: Iterable[bytes]) -> int:
    where, fs = _at(spark, path)
    out, n = fs.create(where, True), 0
    for data in itertools.chain([head], parts):
        for i in range(0, len(data), 1 << 22):
            out.write(bytearray(data[i : i + (1 << 22)]))
        n += len(data)
    out.close()
    return n


def write_bytes(spark: SparkSession, path: str, data: bytes) -> int:
    return write_stream(spark, path, data, ())


def make_folder(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.mkdirs(where)


def size(spark: SparkSession, path: str) -> int:
    where, fs = _at(spark, path)
    return fs.getFileStatus(where).getLen()


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Moves a file to a name, in place of what has it."""
    where, fs = _at(spark, path)
    target, _ = _at(spark, to)
    fs.delete(target, False)
    if not fs.rename(where, target):
        raise OSError(f"{path} can't be renamed to {to}")


def write_text(spark: SparkSession, path: str, text: str) -> int:
    return write_bytes(spark, path, text.encode())


def write_json(spark: SparkSession, path: str, value) -> int:
    return write_text(spark, path, json.dumps(value, indent=2) + "\n")


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text; None if it isn't there."""
    return spark.read.text(path, wholetext=True).first().value if exists(spark, path) else None


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV part with a header; nothing for an empty frame."""
    if not rows.isEmpty():
        rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_jpeg(spark: SparkSession, path: str, png: bytes, quality: float = 0.9) -> int:
    """A PNG as JPEG, by the JVM's image writer; alpha is dropped onto black."""
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(png)))
    flat = jvm.java.awt.image.BufferedImage(image.getWidth(), image.getHeight(), 1)
    flat.createGraphics().drawImage(image, 0, 0, None)
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpg").next()
    how = writer.getDefaultWriteParam()
    how.setCompressionMode(2)
    how.setCompressionQuality(quality)
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(flat, None, None), how)
    writer.getOutput().flush()
    return write_bytes(spark, path, bytes(out.toByteArray()))


# The header of metrics.csv.
SAMPLE_COLUMNS = "timestamp,elapsed_seconds,stage,cpu_percent,rss_ram_mb,disk_read_mb,disk_write_mb"


def write_samples(spark: SparkSession, path: str, samples: list[tuple]) -> None:
    """The samples of a run as one CSV file; a header alone where there are none. A run's samples are some per second."""
    lines = [",".join(str(round(v, 4)) if isinstance(v, float) else str(v) for v in s) for s in samples]
    write_text(spark, path, "\n".join([SAMPLE_COLUMNS, *lines]) + "\n")
