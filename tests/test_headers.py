"""Headers read by ranges, against whole files."""

import struct

import numpy as np
import pytest

from terralign.sources import headers, images

from .survey import exif, flight, png_with


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Photos with much behind, and between, their headers."""
    where = tmp_path_factory.mktemp("photos")
    flight(where, 1, 2)
    app1 = b"Exif\0\0" + exif(10.0, 20.0)
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 300, 400, 3) + b"\0" * 3 + b"\xff\xda\0\2" + bytes(3_000_000)
    (where / "big.jpg").write_bytes(jpeg)
    png = png_with(np.zeros((4, 4, 3), np.uint8), exif(1.0, 2.0))
    tail = png[33:]  # a megabyte of another chunk before the position
    (where / "late.PNG").write_bytes(png[:33] + struct.pack(">I", 1_000_000) + b"prIv" + bytes(1_000_004) + tail)
    (where / "plain.tif").write_bytes(exif(-5.0, 6.0) + bytes(2_000_000))
    (where / "cut.jpeg").write_bytes(jpeg[:40])
    (where / "empty.jpg").write_bytes(b"")
    (where / "notes.txt").write_text("x")
    (where / "_hidden.jpg").write_bytes(jpeg)
    (where / "deeper").mkdir()
    (where / "deeper" / "other.jpg").write_bytes(jpeg)
    return where


def test_the_same_facts_from_few_bytes(spark, folder, monkeypatch):
    rows = images.read_frames(spark, str(folder)).collect()
    assert {r.frame_id: r.readable for r in rows}["empty"] is False and len(rows) == 7
    by_ranges = sorted(str(r) for r in rows if r.frame_id != "empty")
    told = headers.read_headers(spark, f"file:{folder}").collect()
    assert {r.path.rpartition("/")[2] for r in told} == {"frame_001.png", "frame_002.png", "big.jpg", "late.PNG", "plain.tif", "cut.jpeg", "empty.jpg"}
    assert all(r.bytes_read <= headers.XMP + 4 * headers.STEP for r in told) and sum(r.length for r in told) > 6_000_000
    monkeypatch.setattr(images, "reachable", lambda uri: False)
    assert sorted(map(str, images.read_frames(spark, str(folder)).collect())) == by_ranges


def test_ranges_are_bytes(tmp_path, monkeypatch):
    data = np.random.default_rng(1).bytes(1000)
    (tmp_path / "f").write_bytes(data)
    monkeypatch.setattr(headers, "STEP", 16)
    with open(tmp_path / "f", "rb") as file:
        view = headers.Ranges(file, 1000)
        for a, z in ((0, 2), (15, 17), (16, 32), (990, 2000), (1000, 1004), (5, 5), (7, 3)):
            assert view[a:z] == data[a:z]
        assert view[999] == data[999] and view[:2] == data[:2] and len(view) == 1000 and view.n_read < 200


def test_names_are_filtered_before_files_are_opened(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        frames = headers.read_headers(spark, f"file:{folder}")
        assert [r.path.rpartition("/")[2] for r in frames.filter("path LIKE '%.tif'").collect()] == ["plain.tif"]
        assert frames.filter("path LIKE '%frame%' AND length > 0").count() == 2 and frames.filter("length = 0").count() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = headers.AskedReader(f"file:{folder}", 2)
    kept = list(reader.pushFilters([headers.StringEndsWith(("path",), ".png"), headers.EqualTo(("length",), 3)]))
    assert len(kept) == 1 and [n for p in reader.partitions() for n, _ in p.files] == ["frame_001.png", "frame_002.png"]
    assert len(headers.HeaderReader(f"file:{folder}", 2).partitions()) == 2 and headers.HeaderReader(f"file:{folder}/none", 2).partitions() == []
