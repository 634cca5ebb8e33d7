"""Figure files: sizes in pixels from the headers of PNG and JPEG files, any store that Spark reads."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from evigrid.session import ship

PNG = b"\x89PNG\r\n\x1a\n"
#: JPEG markers that carry the frame's size.
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}


def pixels(data: bytes) -> tuple[int, int] | None:
    """Width and height, null for anything that is no whole header of either kind."""
    if data[:8] == PNG:
        return struct.unpack(">II", data[16:24]) if len(data) >= 24 else None
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF:  # filling
            at += 1
        elif kind in FRAMES:
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def read_images(spark: SparkSession, folder: str, pattern: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """(path, width, height, bytes) of the image files of a folder; sizes are null where the header is broken."""
    ship(spark)

    def run(batches):
        for b in batches:
            sizes = [pixels(d) or (None, None) for d in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([w for w, _ in sizes], pa.int64()), pa.array([h for _, h in sizes], pa.int64()), b.column(2)], names=["path", "width", "height", "bytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content", "length").mapInArrow(run, "path string, width long, height long, bytes long")
