"""The report of a run in Markdown."""

from __future__ import annotations

from .monitor import RunSummary


def transfer_seconds(n_bytes: float, mbps: float) -> float:
    return n_bytes * 8.0 / (mbps * 1e6) if mbps > 0 else 0.0


def scenarios(raw: int, product: int, speeds: tuple[float, ...] = (1.0, 5.0, 20.0)) -> list[dict]:
    rows = []
    for mbps in speeds:
        a, b = transfer_seconds(raw, mbps), transfer_seconds(product, mbps)
        saved = max(0.0, a - b)
        rows.append({"mbps": mbps, "raw": a, "product": b, "saved": saved, "percent": saved / a * 100 if a > 0 else 0.0})
    return rows


def spoken(seconds: float) -> str:
    if seconds < 60:
        return f"{seconds:.1f}s"
    whole = int(seconds)
    return f"{whole // 60}m {whole % 60:02d}s" if seconds < 3600 else f"{whole // 3600}h {whole % 3600 // 60:02d}m"


def markdown(s: RunSummary) -> str:
    mb, first = 2**20, s.time_to_first_tile_seconds
    facts = {
        "Frames accepted": f"{s.frames_accepted} of {s.total_frames_found}", "Frames rejected": s.frames_rejected, "Total time": f"{s.total_latency_seconds:.2f} s", "Time to first tile": "n/a" if first is None else f"{first:.2f} s",
        "Throughput": f"{s.frames_accepted / max(s.total_latency_seconds, 0.001):.2f} frames/s", "Peak memory": f"{s.peak_rss_ram_mb:.1f} MB", "Mean CPU": f"{s.avg_cpu_percent:.1f} %", "Mean inlier ratio of pairs": f"{s.mean_inlier_ratio * 100:.1f} %",
        "Mean reprojection error": f"{s.mean_reprojection_error:.2f} px", "Input": f"{s.input_bytes / mb:.2f} MB", "Mosaic": f"{s.output_geotiff_bytes / mb:.2f} MB", "Reduction": f"{s.bandwidth_reduction_factor:.1f}x",
    }
    total = max(s.total_latency_seconds, 0.001)
    table = lambda head, rows: ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(map(str, r)) + " |" for r in rows), ""]
    send = scenarios(s.input_bytes, s.output_cog_bytes or s.output_geotiff_bytes)
    lines = [f"# Run {s.run_id}", "", f"Profile {s.profile}, preset {s.preset}, data {s.dataset_name}; {s.metadata.get('timestamp', 'n/a')} on {s.metadata.get('platform', 'n/a')}.", "", "## Summary", ""]
    lines += table(("Measure", "Value"), facts.items())
    lines += ["## Stages", "", *table(("Stage", "Seconds", "Share"), ((k, f"{v:.2f}", f"{v / total * 100:.1f} %") for k, v in s.stages.items()))]
    lines += ["## Transfer", "", *table(("Uplink", "Raw", "Mosaic", "Saved", "Share saved"), ((f"{r['mbps']:.0f} Mbps", spoken(r["raw"]), spoken(r["product"]), spoken(r["saved"]), f"{r['percent']:.1f} %") for r in send))]
    lines += ["## Limits", "", "Profiles bound cores and memory of the session; they don't imitate other processors' speed.", "", "## Products", "", "orthomosaic.tif, orthomosaic_cog.tif, tiles/{z}/{x}/{y}.png, manifest.json, metrics.csv, metrics.json", ""]
    return "\n".join(lines)


def chart(samples: list[tuple], path: str) -> bool:
    """CPU and memory over time as a picture, where matplotlib is installed; whether it was drawn."""
    try:
        import matplotlib
    except ImportError:
        return False
    matplotlib.use("Agg")
    from matplotlib import pyplot

    if not samples:
        return False
    figure, left = pyplot.subplots(figsize=(10, 5))
    left.plot([s[1] for s in samples], [s[4] for s in samples])
    left.twinx().plot([s[1] for s in samples], [s[3] for s in samples], color="tab:orange")
    figure.savefig(path)
    pyplot.close(figure)
    return True
