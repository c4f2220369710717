"""Makes the package importable on executors that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


#: Bytes of an Arrow batch and rows that a Parquet reader holds, so that long texts take little memory; settings of the session's own stay.
BOUNDS = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def ensure_shipped(spark: SparkSession) -> None:
    """Sends the package to executors once a session, unless PYTHONPATH already tells them where it is; bounds batches of rows."""
    top = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    for name, value in BOUNDS.items():
        if not spark.sparkContext.getConf().contains(name):
            spark.conf.set(name, value)
    if app in _SHIPPED or str(top.parent) in map(os.path.realpath, os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    _SHIPPED.add(app)
    path = Path(tempfile.mkdtemp(prefix="quillon-")) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
