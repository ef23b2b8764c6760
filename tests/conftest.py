import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from tidewatch.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def many_slices(spark):
    """Keep every range apart, so that small groups are spread over several slices."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def make_packets(spark, rows):
    """rows: (ts, src, dst, sport, dport, protocol, length, label), frame numbers in order."""
    data = [("c", i + 1, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(
        data, "capture_id string, frame_number long, ts double, src_ip string, dst_ip string, src_port int, dst_port int, "
        "protocol string, wire_length int, binary_label int")


@pytest.fixture
def packet_table(spark):
    return lambda rows: make_packets(spark, rows)
