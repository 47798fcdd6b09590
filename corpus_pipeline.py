"""The corpus pipeline: stages that each read what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, near, packing, substring, toxicity
from weftline.llm.common import Scratch, fresh, read, ship

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. It is learned from the labelled rows that aren't held out.

    Null, empty and wordless texts score as texts without features do and stay unless the
    labels say that toxic texts are the rule; very long texts are read whole; repeated rows
    score alike and stay or go together; a score of exactly the threshold goes; without
    labels all stay; an empty table stays empty; further columns are kept, whatever their names.
    """
    score = fresh(docs.columns, "score")
    model = toxicity.learned(spark, docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of the smallest doc_id stays.

    Null, empty and wordless texts are in no group and stay; texts under five words are one
    shingle; very long texts are compared whole; of rows that repeat doc_id and text one
    stays; texts that share a doc_id stay or go together; rows without a doc_id stay where
    their group has no other; an empty table stays empty; further columns are kept,
    whatever their names.
    """
    return near.representatives(docs, spark)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 25 words or more that occur again are cut; a document of which nothing is left goes.

    Null and empty texts and those under 25 words stay as they are; very long texts are read
    whole; the first occurrence by doc_id (rows without one come last) and place stays, ties
    going to the earlier place; repeated rows keep the same; an empty table stays empty;
    ``n_chars`` follows the text; further columns are kept, whatever their names.
    """
    removed, words = fresh(docs.columns, "removed"), fresh(docs.columns, "removed_words")
    found = substring.deduplicated(docs, spark, removed=removed, words=words)
    emptied = (F.col(removed) > 0) & (F.trim(F.translate("text", "\t\n\r\x0b\x0c", "     ")) == "")
    return found.where(~emptied).select(*docs.columns)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stretches of ten words or more (or whole shorter items) that the benchmark has too are cut.

    Documents stay, even if nothing is left of their text; null and empty texts stay as they
    are; very long texts are read whole; repeated rows are cut alike; overlapping hits are cut
    once; null and empty items and an empty benchmark cut nothing; an empty table stays
    empty; ``n_chars`` follows the text; further columns are kept, whatever their names.
    """
    return decontaminate.cleaned(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of at most 2048 tokens: one row for each piece.

    Null and empty texts are one piece of the end token; longer texts than a sequence are cut
    into pieces, none is left out; repeated rows are packed once each; ties between pieces of
    one length are free; an empty table gives no rows; further columns are left out.
    """
    import public_tokenizers

    return packing.pack(docs, spark, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("benchmark_passages", cut_benchmark_passages),
    ("packing", pack_sequences),
]
#: Trained models, token ids and MinHash bands are beyond SQL; tests/llm check run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again by the next.

    What becomes of nulls, empty and very long texts, ties, repeated rows, empty tables and
    further columns is said at each stage.
    """
    ship(spark)
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
