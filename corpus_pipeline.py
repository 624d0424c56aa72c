"""A corpus pipeline of five stages, each over all that its predecessor kept.

toxicity drops the documents it rejects; near_duplicates keeps one document of each group;
decontamination drops documents that overlap the benchmark; personal_data masks spans in the
texts; packing cuts the texts into sequences. All but the last return the documents' columns.

Null and empty texts pass every stage and end as one piece; rows without an id are judged by their
texts and never count as copies; repeated rows of one id stay together; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm.bbit_minhash import keep_representatives
from quarrymill.llm.common import materialize, table
from quarrymill.llm.mil_toxicity import keep_clean, train_toxicity
from quarrymill.llm.pow2_packing import pack
from quarrymill.llm.queries import tokenizer_path
from quarrymill.llm.spaced_seed import keep_uncontaminated
from quarrymill.llm.weak_pii import fit_spans, mask


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask(docs, fit_spans(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Toxicity, personal data and packing can't be said in SQL. Tests run the stages one after the other and hold
#: near_duplicates against brute force; the other stages' operators have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return materialize(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
