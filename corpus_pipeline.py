"""A corpus made ready for training: five of the operators, one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import decontaminate, pii, rules, simhash, spm
from marginalia.llm.shared import kept, mark

#: Each takes (spark, docs, sf_dir); the next reads its result back from Parquet.
STAGES = [
    ("quality_rules", rules.stage),
    ("near_duplicates", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("personal_data", pii.stage),
    ("sentencepiece", spm.stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table ``documents``: doc_id, n_tokens, ids and
    decoded of what they keep.  Each stage's result is written as Parquet in the
    shared folder and read again.

    Null, empty and blank texts go in the first stage, as they break its rule for
    texts without words; null ids and null hosts stay and are rows like others; of
    repeated rows and near-duplicates one stays; texts of any length are read to
    their end; further columns, whatever their names, are carried to the last
    stage; an empty table gives an empty one."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), since)  # what the stage read and wrote on its way goes
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no SimHash and no piece vocabulary: tested against brute force.
ORACLE_SQL = None
