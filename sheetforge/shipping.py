"""Makes the package importable on the executors."""

from __future__ import annotations

import importlib.util
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_done: set[str] = set()
#: Rows that go to a Python worker at once. Texts can be long, and two copies of a batch live in each worker.
BATCH_ROWS = 1_000


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application, and bounds the batches of Python helpers.

    Python helpers run in workers that have their own search path; a cluster needs the code there. Results are lazy, so the bound has to stay in the
    session; a session that has its own value, not Spark's default, keeps it.
    """
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(limit, "10000") == "10000":
        spark.conf.set(limit, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(importlib.util.find_spec("sheetforge").origin)))
    archive = os.path.join(tempfile.mkdtemp(prefix="sheetforge-"), "sheetforge-code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "sheetforge")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
    _done.add(app)
