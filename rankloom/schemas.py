"""Schemas of the files and frames that pass between operators."""

from __future__ import annotations

from pyspark.sql import types as T

CORPUS_FILE = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

QUERIES_FILE = T.StructType(
    [T.StructField("_id", T.StringType()), T.StructField("text", T.StringType())]
)

QRELS_FILE = T.StructType(
    [
        T.StructField("query-id", T.StringType()),
        T.StructField("corpus-id", T.StringType()),
        T.StructField("score", T.IntegerType()),
    ]
)


def run_schema(qid: T.DataType, doc_id: T.DataType) -> T.StructType:
    """Scored pairs before ranking; identifiers keep the type of their source."""
    return T.StructType(
        [
            T.StructField("qid", qid),
            T.StructField("doc_id", doc_id),
            T.StructField("score", T.DoubleType()),
        ]
    )


def vectors_schema(key: str, key_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField(key, key_type),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
        ]
    )
