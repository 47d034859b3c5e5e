from __future__ import annotations

import os
import sys
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from catalogue.registry import scorer as session_scorer  # noqa: E402
from mimicry.operators.scoring import Scorer  # noqa: E402
from mimicry.session import configure  # noqa: E402


def make_session() -> SparkSession:
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("mimicry")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return configure(spark)


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    return make_session()


@pytest.fixture(scope="session")
def scorer(spark: SparkSession) -> Scorer:
    return session_scorer(spark)


@pytest.fixture(autouse=True)
def interpreted(request: pytest.FixtureRequest, spark: SparkSession) -> Iterator[None]:
    """Handmade rows are few: compiling code for them is most of a test's time.

    The contract tests keep the generated code that real runs use.
    """
    if request.module.__name__.endswith("test_contract"):
        yield
        return
    settings = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)
