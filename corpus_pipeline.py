"""The corpus pipeline: stages in order, each of which keeps or rewrites documents."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import hyperminhash, personal_data, quality_rules, queries, source_mix
from riskframe.llm.tables import n_words, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rule ensemble does not reject.

    Learnt from the rows of ``labels`` that belong to ``docs``.  A null text is judged like
    an empty one; equal texts share their fate; no documents give none; columns named
    like the operator's own pass through untouched.
    """
    model = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return quality_rules.score_documents(whole, model).filter(F.col("score") >= queries.KEEP_FROM).select("doc.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: five-word shingles, similarity 0.8 or more.

    The smallest doc_id of a group stays, of rows equal in it the first in the order of
    hashes and columns.  Null and empty texts are no one's duplicates but stay once per
    id; a null id is never the smallest unless alone; no documents give none.
    """
    return hyperminhash.one_of_each(docs, width=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its personal data replaced by the kind in brackets and n_chars of the new text.

    A document without a span keeps its text, null included, and its n_chars; equal texts
    are masked alike; no documents give none; other columns pass through untouched.
    """
    whole = docs.select(F.struct(*docs.columns).alias("doc"), personal_data.candidates().alias("c"))
    found = written(whole.select("doc", "c.found"))
    spans = personal_data.accepted(found, personal_data.learn(found))
    rows = spans.select("doc", F.size("spans").alias("n_spans"), personal_data.masked("doc.text", "spans").alias("new"))
    n_chars = F.when(F.col("n_spans") > 0, F.length("new")).otherwise(F.col("doc.n_chars"))
    changed = {"text": F.col("new"), "n_chars": n_chars.cast(docs.schema["n_chars"].dataType)}
    return rows.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents are not torn apart.

    A null source is a source, the last in order; documents without words, null texts
    included, take no part of a budget and stay once; repeated rows are taken each for
    itself; ids that are null or equal differ by nothing else and are taken alike; no
    documents give none.
    """
    sized = written(docs.select("doc_id", "source", n_words("text").alias("size")))
    keyed = sized.withColumn("key", source_mix.row_key("doc_id", "size", "mix"))
    plan = source_mix.cuts(keyed, split_last=False)
    all_columns = F.struct(*[F.col(c) for c in docs.columns]).alias("doc")
    rows = docs.select(all_columns, "doc_id", "source", n_words("text").alias("size"))
    taken = source_mix.with_taken(rows.withColumn("key", source_mix.row_key("doc_id", "size", "mix")), plan)
    copies = F.when(F.col("size") > 0, F.expr("int(taken div size)")).otherwise(1)
    taken = taken.withColumn("copies", copies).filter("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of at most 2048 tokens with its place in a packed sequence.

    A null or empty text is one piece of its end id; repeated rows are packed each for
    itself; a null id stays null; no documents give no pieces.
    """
    return queries.packed_pieces(docs, public_tokenizers.path(queries.TOKENIZER))


STAGES = [
    ("good_quality", good_quality),
    ("one_of_each", one_of_each),
    ("without_personal_data", without_personal_data),
    ("mixed_sources", mixed_sources),
    ("packed", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
