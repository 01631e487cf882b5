import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from murmuration.session import local_session  # noqa: E402

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, "6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return TABLES


@pytest.fixture
def partitions(spark):
    """Run a block under another number of shuffle partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def use(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))

    yield use
    spark.conf.set("spark.sql.shuffle.partitions", before)
