from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from tallyframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def answers(spark):
    """Ten rows with one gap in each of three columns."""
    categories = ["N", "S", "W", "N", None, "S", "W", "N", "S", "E"]
    first = [12.0, 18.0, None, 27.0, 24.0, 33.0, 41.0, 38.0, 52.0, 47.0]
    second = [9.5, 7.0, 8.0, 6.5, 5.0, None, 4.0, 3.5, 2.0, 1.0]
    texts = ["oak", "elm", "ash", "fir", "yew", "box", "bay", "fig", "gum", "77"]
    start = dt.datetime(2022, 3, 5)
    rows = [
        (i + 1, categories[i], first[i], second[i], start + dt.timedelta(days=i), texts[i], dt.timedelta(minutes=7 * (i + 1)))
        for i in range(10)
    ]
    return spark.createDataFrame(
        rows,
        "id long, category string, value1 double, value2 double, date timestamp_ntz, text string, duration interval day to second",
    )


@pytest.fixture(scope="session")
def staff(spark):
    age = [31.0, 44.0, None, 28.0, 52.0, 39.0, 47.0, None, 25.0, 36.0]
    department = ["Ops", "Lab", None, "Lab", "Ops", "Law", "Lab", "Ops", None, "Law"]
    salary = [41000, 73000, 58000, 49000, 91000, 66000, 78000, 52000, 38000, 70500]
    rows = [(i, f"name{i}", age[i], salary[i], department[i], i + 1, 10 * i) for i in range(10)]
    return spark.createDataFrame(
        rows, "id long, name string, age double, salary long, department string, experience long, score long"
    )
