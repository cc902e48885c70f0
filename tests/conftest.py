import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tremora.session import session, ship_package

    spark = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def sf():
    return SF
