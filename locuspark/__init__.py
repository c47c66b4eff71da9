"""locuspark: a Spark-first engine for interval, genotype, graph and corpus analytics."""

import os
from pathlib import Path

_ROOT = str(Path(__file__).resolve().parent.parent)
# Python workers import the package by name; a JVM started after this inherits the path.
if _ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, os.environ.get("PYTHONPATH")) if x)
