import pytest

from casewise.llm.common import prepare



@pytest.fixture(scope="session")
def corpus(spark):
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    return spark
