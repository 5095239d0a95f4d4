"""Rasters and tiles that executors write."""

import numpy as np
import pytest

from terralign.sinks import files, products, raster, writers


def canvas(spark, width, height, tile):
    image = np.random.default_rng(2).integers(0, 256, (height, width, 4), dtype=np.uint8)
    rows = []
    for y in range(0, height, tile):
        for x in range(0, width, tile):
            part = np.ascontiguousarray(image[y : y + tile, x : x + tile])
            rows.append((y // tile, x // tile, x, y, part.shape[1], part.shape[0], bytearray(part.tobytes())))
    return image, spark.createDataFrame(rows, "row long, col long, x0 long, y0 long, width long, height long, rgba binary").repartition(5)


@pytest.mark.parametrize("big", [None, True])
def test_a_raster_is_what_one_process_would_write(spark, tmp_path, big):
    image, tiles = canvas(spark, 150, 110, 64)
    path = str(tmp_path / "deep" / "r.tif")
    small = products.halved(tiles, 64)
    n = products.write_raster([(tiles, 150, 110), (small, 75, 55)], path, 64, 32, 32611, 1000.0, 2000.0, 0.5, big)
    content = open(path, "rb").read()
    levels = [raster.level_of(image, 32), raster.level_of(raster.overview(image), 32)]
    assert len(content) == n and content == raster.assemble(levels, 32611, 1000.0, 2000.0, 0.5, big=big)
    assert content[2] == (43 if big else 42)
    head = raster.read_header(content)
    assert (head["width"], head["height"], head["epsg"], head["overviews"], head["bounds"]) == (150, 110, 32611, 1, (1000.0, 1945.0, 1075.0, 2000.0))
    assert np.array_equal(raster.read_pixels(content), image) and np.array_equal(raster.read_pixels(content, 1), raster.overview(image))
    assert bytes(spark.read.format("binaryFile").load(path).first().content) == content
    assert [p.name for p in (tmp_path / "deep").iterdir() if not p.name.startswith(".")] == ["r.tif"]  # nothing is left aside


def test_offsets_have_64_bits_beyond_4_gb():
    level = {"width": 4096, "height": 4096, "bands": 4, "block": 512, "counts": [80_000_000] * 64}
    head = raster.header([level], 32611, 0.0, 0.0, 1.0)
    tags = raster.read_header(head)["tags"][0]
    assert head[2] == 43 and tags[raster.TAGS["offsets"]] == [len(head) + 80_000_000 * i for i in range(64)]
    with pytest.raises(ValueError):
        raster.header([level], 32611, 0.0, 0.0, 1.0, big=False)
    assert raster.header([level | {"counts": [9] * 64}], 32611, 0.0, 0.0, 1.0)[2] == 42


def test_stores_without_places_take_blocks_in_order(spark, tmp_path, monkeypatch):
    image, tiles = canvas(spark, 70, 40, 32)
    monkeypatch.setattr(writers, "mounted", lambda uri: None)
    products.write_raster([(tiles, 70, 40)], str(tmp_path / "r.tif"), 32, 32, 32611, 0.0, 0.0, 1.0)
    assert np.array_equal(raster.read_pixels((tmp_path / "r.tif").read_bytes()), image)


def test_missing_tiles_are_refused(spark, tmp_path):
    _, tiles = canvas(spark, 70, 40, 32)
    with pytest.raises(ValueError, match="don't cover"):
        products.write_raster([(tiles.filter("col < 2"), 70, 40)], str(tmp_path / "r.tif"), 32, 32, 32611, 0.0, 0.0, 1.0)
    assert not (tmp_path / "r.tif").exists()


@pytest.mark.parametrize("by_driver", [False, True])
def test_files_from_rows(spark, tmp_path, monkeypatch, by_driver):
    rows = spark.range(50).selectExpr("concat('a/', id % 7, '/', id, '.bin') AS path", "cast(repeat('x', cast(id AS int)) AS binary) AS data").repartition(4)
    if by_driver:
        monkeypatch.setattr(writers, "reachable", lambda uri: False)
    (tmp_path / "out" / "a" / "3").mkdir(parents=True)
    files.write_bytes(spark, str(tmp_path / "out" / "a" / "3" / "3.bin"), b"before")
    for _ in range(2):  # a second time over what is there
        assert writers.write_files(rows, str(tmp_path / "out")) == (50, sum(range(50)))
    found = {p.relative_to(tmp_path / "out").as_posix(): p.read_bytes() for p in (tmp_path / "out").rglob("*.bin")}
    assert found == {f"a/{i % 7}/{i}.bin": b"x" * i for i in range(50)}
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file() and p.suffix in (".part", ".json")]
    assert spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "out")).selectExpr("sum(length(content)) AS n").first().n == sum(range(50))
    assert writers.write_files(rows.limit(0), str(tmp_path / "none")) == (0, 0)
    assert not writers.reachable("nowhere://x/y") and files.full_uri(spark, str(tmp_path)).startswith("file:")
