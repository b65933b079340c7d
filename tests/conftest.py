import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quantloom import session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session.build("local[4]", shuffle_partitions=4, app="tests")
    s.sparkContext.setLogLevel("OFF")
    yield s


def D(text):
    return dt.date.fromisoformat(text)


def business_days(start, n):
    d, out = D(start), []
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


def calendar(spark, days):
    return spark.createDataFrame([(d, i + 1) for i, d in enumerate(days)], "date date, pos int")


def rows(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def near(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    return abs(a - b) <= tol * max(1.0, abs(b))
