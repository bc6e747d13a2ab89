"""A training-corpus pipeline over `documents`: each stage is one operator of staylens.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but
the last return the columns of `documents`.
"""

from __future__ import annotations

from staylens.llm import decontam, ngram_join, packing, pii, quality
from staylens.llm.common import Stored, documents
from staylens.llm.queries import tokenizer_file


def good_quality(spark, docs, sf_dir):
    """Documents that the perplexity classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Stored(spark, "quality"))


def one_of_each_group(spark, docs, sf_dir):
    """Of each group of equal and near documents the one with the smallest id stays."""
    return ngram_join.keep_one(docs, Stored(spark, "near"))


def no_benchmark(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_personal_data(spark, docs, sf_dir):
    """Personal data in the texts gives way to its kind in angle brackets."""
    return pii.redact(docs)


def packed(spark, docs, sf_dir):
    """Pieces of the kept texts in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("near duplicates", one_of_each_group),
    ("benchmark decontamination", no_benchmark),
    ("personal data", no_personal_data),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages applied to `documents`; each result is written as Parquet and read again."""
    store = Stored(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store.write(docs, f"{k}-{name.replace(' ', '-')}")
            if k:
                store.drop(f"{k - 1}-{STAGES[k - 1][0].replace(' ', '-')}")
    return docs
