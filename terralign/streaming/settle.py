"""Surveys that begin when a folder has settled: a stream of files, its arrivals, and the job that they start."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames as fr

ARRIVALS = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """The image files of a folder as they come, without their content."""
    stream = spark.readStream.format("binaryFile").schema(ARRIVALS).option("pathGlobFilter", "*.*").load(folder)
    return stream.select("path", "modificationTime", "length").filter(fr.is_image(F.col("path")))


def sessions(spark: SparkSession, folder: str, gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Sessions of arrivals by the files' own times, for runs over folders that are complete."""
    named = arrivals(spark, folder).withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).withWatermark("modificationTime", late)
    return named.groupBy("folder", F.session_window("modificationTime", gap).alias("w")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")).select("folder", F.col("w.start").alias("began"), F.col("w.end").alias("settled"), "files", "bytes")


def settled(files: DataFrame, settle_seconds: float) -> DataFrame:
    """(folder, files): a row whenever files of a folder have come and then none for settle_seconds; files counts all so far.

    Count and timer are the stream's state: after a restart a pause goes on, and what was told isn't told again.
    """
    import pandas as pd

    def count(key, batches, state):
        n, fresh = state.get if state.exists else (0, False)
        if state.hasTimedOut:
            state.update((n, False))
            if fresh:
                yield pd.DataFrame({"folder": [key[0]], "files": [n]})
            return
        n += sum(len(b) for b in batches)
        state.update((n, True))
        state.setTimeoutDuration(max(1, int(settle_seconds * 1000)))

    named = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"))
    return named.groupBy("folder").applyInPandasWithState(count, "folder string, files long", "files long, fresh boolean", "append", "ProcessingTimeTimeout")


def watch(spark: SparkSession, folder: str, job: Callable[[int], None], checkpoint: str, settle_seconds: float = 5.0, poll_seconds: float = 1.0, until: Callable[[], bool] | None = None) -> int:
    """Runs job(number of files so far) whenever the folder has settled, once per pause. Ends when until() holds; gives the number
    of jobs. The checkpoint holds which files were seen and what is still to settle."""
    jobs = 0

    def start(batch: DataFrame, _: int) -> None:
        nonlocal jobs
        for row in batch.collect():  # one row: the folder has no folders in it
            job(row.files)
            jobs += 1

    query = settled(arrivals(spark, folder), settle_seconds).writeStream.foreachBatch(start).option("checkpointLocation", checkpoint).trigger(processingTime=f"{poll_seconds} seconds").start()
    try:
        while not (until and until()):
            if query.exception():
                raise query.exception()
            time.sleep(min(0.2, poll_seconds))
    finally:
        query.stop()
    return jobs


#: What comes in: tiles of a run, numbered row by row from 0, and its end, whose number is that of all tiles.
TILES = "run string, number long, kind string, row long, col long, width long, height long, path string, bytes long"
EVENTS = "run string, seq long, event string, row long, col long, width long, height long, path string, bytes long"


def protocol(tiles: DataFrame) -> DataFrame:
    """The events of contract runs from a stream of TILES: first_tile, then tile_written for every other tile in order of its
    number, then final_output, whatever the order in which they come and however micro-batches part them.

    A tile that comes early waits in the state until those before it have come; a number that comes again, and what comes after
    the end, is dropped. The state is (the next number, whether the run has ended, what waits), so a restart goes on there.
    """
    import json

    import pandas as pd

    fields = [f.split(" ")[0] for f in TILES.split(", ")][3:]
    columns = [f.split(" ")[0] for f in EVENTS.split(", ")]

    def order(key, batches, state):
        due, ended, held = state.get if state.exists else (0, False, "{}")
        waiting = {int(k): v for k, v in json.loads(held).items()}
        for b in batches:
            for r in b.itertuples(index=False):
                if r.kind in ("tile", "end") and r.number >= due:
                    waiting.setdefault(int(r.number), {"kind": r.kind} | {f: None if pd.isna(v := getattr(r, f)) else v if isinstance(v, str) else int(v) for f in fields})
        out = []
        while not ended and due in waiting:
            w = waiting.pop(due)
            ended = w["kind"] == "end"
            out.append({"run": key[0], "seq": due, "event": "final_output" if ended else "tile_written" if due else "first_tile"} | {f: w[f] for f in fields})
            due += not ended
        state.update((due, ended, json.dumps({} if ended else waiting)))
        if out:
            yield pd.DataFrame(out, columns=columns).astype({c: "Int64" for c in ("row", "col", "width", "height", "bytes")})

    return tiles.groupBy("run").applyInPandasWithState(order, EVENTS, "due long, ended boolean, waiting string", "append", "NoTimeout")


def first_events(tiles: DataFrame, run: str = "run") -> DataFrame:
    """Labels a stream of tile rows: the first of each run is first_tile, all others tile_written, across micro-batches."""
    import pandas as pd

    columns = list(tiles.columns)
    fields = [f for f in columns if f != run]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tiles.schema.fields)

    def label(key, batches, state):
        seen = bool(state.get[0]) if state.exists else False
        for b in batches:
            if len(b):
                event = ["first_tile" if i == 0 and not seen else "tile_written" for i in range(len(b))]
                seen = True
                yield pd.DataFrame({run: key[0], **{f: b[f] for f in fields}, "event": event})[[*columns, "event"]]
        state.update((seen,))

    return tiles.groupBy(run).applyInPandasWithState(label, f"{kinds}, event string", "seen boolean", "append", "NoTimeout")
