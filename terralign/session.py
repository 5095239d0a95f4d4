"""Session helpers."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g", app: str = "terralign") -> SparkSession:
    """A local session with the settings that the engine expects; a cluster session needs only UTC and AQE."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def bounds(config) -> dict:
    """Cores and memory of a session within the bounds of a machine's profile; without bounds all cores and 8 GB."""
    return {"cores": str(config.max_cpus or "*"), "memory": f"{config.max_ram_mb}m" if config.max_ram_mb else "8g"}


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables of a data folder; the path goes to Spark's readers only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
