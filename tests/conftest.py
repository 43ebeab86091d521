import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from fabgrain.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


MEASURED = [
    ("P1", "Lot1", "W01", "Thickness", 1, 1, 1.0, 97.0),
    ("P1", "Lot1", "W01", "Thickness", 2, 1, 2.0, 97.0),
    ("P1", "Lot1", "W01", "Thickness", 1, 2, 4.0, 97.0),
    ("P1", "Lot1", "W01", "Thickness", 2, 2, 8.0, 97.0),
    ("P1", "Lot1", "W01", "Resistance", 1, 1, 5.0, 95.0),
    ("P1", "Lot1", "W02", "Thickness", 1, 1, 3.0, 96.5),
    ("P2", "Lot10", "W01", "Thickness", 1, 1, 7.0, 96.4),
    ("P2", "Lot2", "W01", "Thickness", 1, 1, 9.0, 100.0),
]


@pytest.fixture(scope="session")
def measured(spark):
    from fabgrain.sources.measurements import SCHEMA

    return spark.createDataFrame(MEASURED, SCHEMA)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)
