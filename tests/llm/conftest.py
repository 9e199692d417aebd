import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("llm-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    return s


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, label int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names clash with results."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, None, None, "x", 7) for i, t in rows], DOCS)

    return make
