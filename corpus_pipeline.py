"""A training-data pipeline in five stages over ``documents``.

``STAGES`` lists (name, function); a function takes (spark, docs, folder with the tables) and returns a DataFrame.  All but
the last return the columns of documents.  The stages call the operators of ``mediaprism.llm`` with their production
parameters:

1. toxicity: documents that the classifier rejects go;
2. near_dedup: of each group of near duplicates (five-word shingles, Jaccard 0.8; found by SimHash with Golay keys and by
   MinHash) the document with the smallest id stays;
3. substring_dedup: repeated passages are cut out of the texts; no document goes;
4. mixing: documents come as often as the mix to the sources' target weights takes them;
5. packing: the result has one row for each piece of a sequence.

SQL can't express a trained classifier, balanced sampling or a tokenizer, so there is no ``ORACLE_SQL``; the tests hold the
stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mediaprism.llm import cube, minhash, packing, substrings, toxicity
from mediaprism.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what scores 0.7 or more; the classifier learns from the labels of the documents given."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more."""
    return minhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words in windows of 35 words that start elsewhere, too; ``n_chars`` follows the text."""
    return substrings.remove_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source's words come near its target."""
    return cube.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in sequences."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
