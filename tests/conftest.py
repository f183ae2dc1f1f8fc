import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def series(spark):
    """series({basin: [values]}, start): a table (basin, date, v) from plain lists."""
    from datetime import date, timedelta

    def make(values, start=date(2020, 1, 1), names=("v",)):
        rows = []
        for basin, columns in values.items():
            columns = [columns] if len(names) == 1 else columns
            rows += [(basin, start + timedelta(days=i), *(None if v is None else float(v) for v in x)) for i, x in enumerate(zip(*columns, strict=True))]
        return spark.createDataFrame(rows, "basin string, date date, " + ", ".join(f"{n} double" for n in names))

    return make
