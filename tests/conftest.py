from __future__ import annotations

import shutil
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="module")
def spark(tmp_path_factory):
    """A session for each module: what one has left in memory and on disk goes with it."""
    places = [tmp_path_factory.mktemp(x) for x in ("warehouse", "shared", "local")]
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.default.parallelism", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(places[0])).config("spark.checkpoint.dir", f"file://{places[1]}").config("spark.local.dir", str(places[2]))
        # plans of a few rows: compiling them takes longer than running them
        .config("spark.sql.codegen.wholeStage", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
    for place in places:
        shutil.rmtree(place, ignore_errors=True)
