import pytest


@pytest.fixture
def tables(spark, tmp_path):
    """make(name, rows, schema) writes a table; gives the folder."""

    class Folder(str):
        def make(self, name, rows, schema):
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{self}/{name}.parquet")

    return Folder(tmp_path)
