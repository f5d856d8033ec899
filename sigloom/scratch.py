"""Tables written to the shared folder, so that later steps don't depend on earlier stages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_LOCAL: dict[str, str] = {}


def keep(df: DataFrame) -> DataFrame:
    """Write the rows under ``spark.checkpoint.dir`` and read them back.

    Only where that is unset (tests on one machine) a temporary folder takes its place.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if app not in _LOCAL:
            folder = tempfile.mkdtemp(prefix="sigloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _LOCAL[app] = f"file://{folder}"
        root = _LOCAL[app]
    path = f"{root.rstrip('/')}/{app}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
