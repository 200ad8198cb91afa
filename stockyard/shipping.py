"""The package itself, sent to the executors, which know nothing of the driver's path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from functools import cache

from pyspark.sql import SparkSession

_SENT: set[str] = set()


@cache
def _folder() -> str:
    """A folder of the driver for as long as it runs: Spark serves executors from it."""
    held = tempfile.mkdtemp(prefix="stockyard-code-")
    atexit.register(shutil.rmtree, held, ignore_errors=True)
    return os.path.realpath(held)


@cache
def _packed() -> str:
    source = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(source)
    path = os.path.join(_folder(), f"{name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as packed:
        for base, _, files in os.walk(source):
            for file in sorted(files):
                if file.endswith(".py"):
                    whole = os.path.join(base, file)
                    packed.write(whole, os.path.join(name, os.path.relpath(whole, source)))
    return path


def ship_package(spark: SparkSession) -> None:
    """Send this package once per application, so that tasks can import it anywhere."""
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        context.addPyFile(_packed())
        _SENT.add(context.applicationId)
