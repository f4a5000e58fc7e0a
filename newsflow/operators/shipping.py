"""The package on the workers, wherever the driver was started."""

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import newsflow

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that Spark pickles by name are then importable on executors
    that share neither the driver's path nor its working directory.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(newsflow.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="newsflow-"), "newsflow-package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
