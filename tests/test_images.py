import struct

from pyspark.sql import functions as F

from evigrid import params as P
from evigrid.sources.images import pixels, read_images


def png(w, h, size=6000):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + bytes(size)


def jpeg(w, h, size=6000):
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + bytes(14) + b"\xff\xff\xc2" + struct.pack(">HBHHB", 11, 8, h, w, 1) + bytes(size)


def test_pixels():
    assert pixels(png(200, 300)) == (200, 300) and pixels(jpeg(640, 480)) == (640, 480)
    assert [pixels(x) for x in (b"", b"GIF89a", png(1, 1)[:20], jpeg(1, 1)[:6], b"\xff\xd8abc")] == [None] * 5


def test_junk_figures_of_files(spark, tmp_path):
    for name, data in {"a.png": png(200, 300), "b.jpg": jpeg(160, 2000), "c.png": png(149, 400), "d.jpeg": jpeg(300, 300, 100), "e.png": b"broken", "f.txt": b"no image"}.items():
        (tmp_path / name).write_bytes(data)
    files = read_images(spark, str(tmp_path))
    long, short = F.greatest("width", "height"), F.least("width", "height")
    kept = files.where((F.col("width") >= P.FIGURE_MIN_PX) & (F.col("height") >= P.FIGURE_MIN_PX) & (long / F.greatest(short, F.lit(1)) <= P.FIGURE_MAX_ASPECT) & (F.col("bytes") >= P.FIGURE_MIN_BYTES))
    assert files.count() == 5 and [r.path.rsplit("/", 1)[-1] for r in kept.collect()] == ["a.png"]
