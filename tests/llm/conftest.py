import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
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
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
    return s


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents(texts, ids=None): a table with the columns of documents."""

    def make(texts, ids=None, extra=False):
        ids = list(range(len(texts))) if ids is None else ids
        df = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS).repartition(3)
        if extra:
            for c in ("block", "row", "fp", "quality", "words", "key", "kind", "index", "value", "line", "digest", "start", "n", "h", "component_id", "uid"):
                df = df.withColumn(c, df["source"])
        return df

    return make
