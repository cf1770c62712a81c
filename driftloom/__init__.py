"""One-class anomaly analytics over trajectories, on Spark DataFrames."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path


def on_workers(spark) -> None:
    """Has Python workers find this package: by its folder where all runs on one machine, else as a zip that Spark ships."""
    root, context = Path(__file__).resolve().parent.parent, spark.sparkContext
    if context.master == "local" or context.master.startswith("local["):
        env = context.environment
        known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if str(root) not in known:
            env["PYTHONPATH"] = os.pathsep.join([str(root), *known])
        return
    if getattr(context, "_driftloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="driftloom-")) / "driftloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted((root / "driftloom").rglob("*.py")):
            z.write(source, source.relative_to(root))
    context.addPyFile(str(archive))
    context._driftloom_shipped = True
