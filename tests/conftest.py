import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from khata.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "khata-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def messages_of(spark):
    """Message table out of (body, address, date_ms) tuples or bare bodies; ids count from 1."""

    def build(rows, inbox="u"):
        full = []
        for i, row in enumerate(rows, 1):
            body, address, ms = row if isinstance(row, tuple) else (row, "AX-HDFCBK", 1754332200000)
            full.append((inbox, i, body, ms, address))
        return spark.createDataFrame(full, "inbox_id string, id bigint, body string, date_ms bigint, address string")

    return build
