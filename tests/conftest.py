import os
import sys
import uuid

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cdclake.plans.jobs import LakeConfig  # noqa: E402
from cdclake.session import get_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session("tests", "local[4]", {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lake(tmp_path):
    """Config of a lake nobody else uses."""
    run = uuid.uuid4().hex[:8]
    return LakeConfig(
        warehouse=str(tmp_path), bronze=f"bronze_{run}.cdc_events",
        lineage=f"lineage_{run}.events", silver=f"silver_{run}", gold=f"gold_{run}",
        staging=f"staging_{run}",
        etl=f"etl_{run}", demo=f"demo_{run}", source_format="json",
        brokers=str(tmp_path / "topics"), checkpoint=str(tmp_path / "checkpoint"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
