import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    at = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.local.dir", at).config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", Path(at, "checkpoint").as_uri()).config("spark.sql.warehouse.dir", f"{at}/warehouse").getOrCreate()
    )
    session.sparkContext.setCheckpointDir(Path(at, "checkpoint").as_uri())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
