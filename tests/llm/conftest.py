import zlib

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

LONG = " ".join(f"word{i % 700}" for i in range(30_000))

# Null and empty texts, blanks, one very long text and word, repeated rows, a null key.
EDGE_ROWS = [
    (1, None), (2, ""), (3, " \t\n "), (4, LONG), (5, "x" * 20_000), (6, "The cat sat on the mat, again."),
    (6, "The cat sat on the mat, again."), (7, "The cat sat on the mat, again."), (None, "no key here at all"), (None, None),
    (8, "été 中文 😀 a<|endoftext|>b"), (9, "12 !! 34"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Edge rows with further columns, some named like results."""
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
    frame = spark.createDataFrame(EDGE_ROWS, schema)
    clashing = ["ids", "decoded", "score", "measure", "lang_pred", "fingerprint", "component_id", "n_lines", "n_dropped", "matches", "key", "doc", "lang"]
    return frame.selectExpr("*", *[f"'old' AS {c}" for c in clashing], "7L AS other")


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())
