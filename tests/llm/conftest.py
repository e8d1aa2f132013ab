import pytest

from sensorlab.session import ship


@pytest.fixture
def make(spark):
    """Build a DataFrame over several partitions; columns given as DDL."""
    ship(spark)

    def build(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)
    return build


#: Texts that every operator has to get through.
ODD_TEXTS = [None, "", " ", "\n\n", "a", "don't 'll we've I'M", "é ß ñ 日本語 ١٢  x", "same same same", "same same same",
             "\x00\x1c\x85 á", "<|endoftext|>", "x" * 5000, "word " * 30_000, "Tab\tand\r\nlines\n" * 50]
