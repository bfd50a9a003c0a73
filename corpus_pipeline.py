"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and gives documents again; run() writes
what a stage gives as Parquet to the shared folder and reads it back, so a
stage that is lost with an executor starts from its predecessor's files; these
go once the stage is written.

Nulls, repeated rows, empty texts and columns named like the results are as the
stages' docstrings say; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import common, langid, linetemplates, mixing, phraseindex, setjoin

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", langid.stage),
    ("line_dedup", linetemplates.stage),
    ("near_duplicates", setjoin.stage),
    ("decontamination", phraseindex.stage),
    ("source_mix", mixing.stage),
]

#: A trained model and components of a similarity join have no SQL; tests/llm/test_pipeline.py holds the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of sf_dir after all stages, with domain, epoch, n_tokens and taken."""
    docs = common.table(spark, sf_dir, "documents")
    where = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
        if before:
            common.remove(spark, before)
        before = f"{where}/{name}"
    return docs
