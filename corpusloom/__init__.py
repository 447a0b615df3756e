"""corpusloom: dialog-corpus and training-data analytics as Spark DataFrame plans."""

from __future__ import annotations

import os


def share_code(spark) -> None:
    """Lets Python workers on machines that have this folder import the package from any working directory; a cluster whose
    machines don't have it gets the package by --py-files."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
