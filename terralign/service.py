"""Projects as plain functions over a folder, for whatever serves them: create, list, upload, process, read, delete."""

from __future__ import annotations

import datetime
import json
import re
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import pipeline
from .config import build_config
from .functions.telemetry_status import upload_status
from .sinks import files
from .sources import images


class Projects:
    """One folder per project: metadata.json, pipeline_state.json, raw/ and output/."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, project: str, name: str = "") -> str:
        if not re.fullmatch(r"[A-Za-z0-9-]+", project):
            raise ValueError(f"not a project: {project}")
        return f"{self.root}/{project}/{name}".rstrip("/")

    def _read(self, project: str, name: str, default=None):
        text = files.read_text(self.spark, self._at(project, name))
        return default if text is None else json.loads(text)

    def create(self, name: str) -> dict:
        project = {"id": uuid.uuid4().hex[:12], "name": name, "status": "created", "created_at": datetime.datetime.now(datetime.timezone.utc).isoformat()}
        files.write_json(self.spark, self._at(project["id"], "metadata.json"), project)
        return project

    def get(self, project: str) -> dict | None:
        """The project's metadata, with the state of its run on top."""
        meta = self._read(project, "metadata.json")
        return None if meta is None else meta | (self._read(project, "pipeline_state.json") or {})

    def list(self) -> list[dict]:
        """All projects, the newest first."""
        if not files.exists(self.spark, self.root):
            return []
        texts = self.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").text(self.root, wholetext=True)
        found = texts.filter(F.get_json_object("value", "$.created_at").isNotNull()).orderBy(F.desc(F.get_json_object("value", "$.created_at"))).collect()
        return [json.loads(r.value) for r in found]

    def delete(self, project: str) -> bool:
        return files.delete(self.spark, self._at(project))

    def upload(self, project: str, name: str, content: bytes) -> None:
        """Puts a file into the project's raw folder; of a path only the last part counts."""
        files.write_bytes(self.spark, self._at(project, "raw/" + re.split(r"[\\/]", name)[-1]), content)

    def ingest(self, project: str) -> dict:
        """Checks what was uploaded; writes gps.json, ingest_report.json and the status."""
        report = images.folder_report(images.read_frames(self.spark, self._at(project, "raw"), coerce_refs=True))
        status = report.agg(upload_status(F.col("readable"), F.col("has_gps")).alias("status")).first().status
        rows = [r.asDict() for r in report.orderBy("path").collect()]
        gps = [{"filename": r["path"].rpartition("/")[2], "lat": r["lat"], "lon": r["lon"], "alt": r["altitude"]} for r in rows if r["has_gps"] and r["readable"]]
        result = {"total": len(rows), "accepted": len(gps), "rejections": [{"file": r["path"].rpartition("/")[2], "reason": r["rejection_reason"]} for r in rows if r["rejection_reason"]]}
        files.write_json(self.spark, self._at(project, "gps.json"), gps)
        files.write_json(self.spark, self._at(project, "ingest_report.json"), result)
        self._set(project, {"status": status})
        return result

    def _set(self, project: str, values: dict) -> None:
        files.write_json(self.spark, self._at(project, "metadata.json"), self._read(project, "metadata.json", {}) | values)

    def process(self, project: str, profile: str = "laptop", preset: str = "balanced", **overrides) -> dict:
        """Runs the survey; a project that is being processed is left alone. The state tells of success or failure."""
        state = self._read(project, "pipeline_state.json", {})
        if state.get("status") == "processing":
            return state
        path = self._at(project, "pipeline_state.json")
        files.write_json(self.spark, path, {"status": "processing"})
        try:
            summary = pipeline.run(self.spark, self._at(project, "raw"), self._at(project, "output"), build_config(profile, preset, overrides))
            state = {"status": "completed", "frames_accepted": summary.frames_accepted, "run_id": summary.run_id}
        except Exception as error:
            state = {"status": "error", "error": str(error)[:500]}
        files.write_json(self.spark, path, state)
        return state

    def gps(self, project: str) -> list:
        return self._read(project, "gps.json", [])

    def ingest_report(self, project: str) -> dict | None:
        return self._read(project, "ingest_report.json")

    def state(self, project: str) -> dict | None:
        return self._read(project, "pipeline_state.json")

    def metrics(self, project: str) -> dict | None:
        return self._read(project, "output/metrics.json")

    def product(self, project: str, name: str = "orthomosaic.tif") -> str | None:
        path = self._at(project, f"output/{name}")
        return path if files.exists(self.spark, path) else None


def health() -> dict:
    return {"status": "ok"}
