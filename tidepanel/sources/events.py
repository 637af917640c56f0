"""A static calendar of macro events."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

#: Rate meetings, releases of consumer prices, releases of payrolls.
EVENTS = {
    "fomc": """
        2019-01-30 2019-03-20 2019-05-01 2019-06-19 2019-07-31 2019-09-18 2019-10-30 2019-12-11
        2020-01-29 2020-03-03 2020-03-15 2020-04-29 2020-06-10 2020-07-29 2020-09-16 2020-11-05 2020-12-16
        2021-01-27 2021-03-17 2021-04-28 2021-06-16 2021-07-28 2021-09-22 2021-11-03 2021-12-15
        2022-01-26 2022-03-16 2022-05-04 2022-06-15 2022-07-27 2022-09-21 2022-11-02 2022-12-14
        2023-02-01 2023-03-22 2023-05-03 2023-06-14 2023-07-26 2023-09-20 2023-11-01 2023-12-13
        2024-01-31 2024-03-20 2024-05-01 2024-06-12 2024-07-31 2024-09-18 2024-11-07 2024-12-18
        2025-01-29 2025-03-19 2025-05-07 2025-06-18
    """,
    "cpi": "2024-01-11 2024-02-13 2024-03-12 2024-04-10 2024-05-15 2024-06-12 2024-07-11 2024-08-14 2024-09-11 2024-10-10 2024-11-13 2024-12-11",
    "nfp": "2024-01-05 2024-02-02 2024-03-08 2024-04-05 2024-05-03 2024-06-07 2024-07-05 2024-08-02 2024-09-06 2024-10-04 2024-11-01 2024-12-06",
}


def event_calendar(spark: SparkSession) -> DataFrame:
    """(event, dt), a row for each date."""
    return spark.createDataFrame([(k, datetime.date.fromisoformat(d)) for k, dates in EVENTS.items() for d in dates.split()], "event string, dt date")
