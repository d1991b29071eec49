"""What a session needs before Python code of this package runs on executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once a context, so that their workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_lectern_shipped", None) is None:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="lectern-code-")) / "lectern_code.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        context.addPyFile(str(archive))  # the driver serves it
        context._lectern_shipped = str(archive)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, a local one if the master is local, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="lectern-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
