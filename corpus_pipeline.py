"""The corpus pipeline: stages over documents, each one operator of ``ridgeline.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's result as Parquet to the shared folder and reads it again as the
next one's documents. All stages but the last return the columns of documents.

Defined results: documents without text fail the quality rules; rows that share
a doc_id share their decisions (kept if one of them is); documents without a
doc_id are told apart by their texts. Further columns stay as they are, whatever
their names. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.llm import langid, minhash, packing, quality, suffix
from ridgeline.llm.common import alone


def _name():
    """A row's name: its doc_id; without one its text decides, above all other ids."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 62))).alias("doc_id")


def _named(docs):
    return docs.select(_name(), "text", "lang", "source")


def _only(docs, ids):
    """The rows of ``docs`` whose name is among ``ids``; a row travels as one struct, so its columns clash with nothing."""
    kept = docs.select(_name(), F.struct("*").alias("row")).join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the base rules or their group's fences go."""
    return _only(docs, quality.quality_rules(_named(docs)).where("kept"))


def language_id(spark, docs, sf_dir):
    """Documents in no learned language go."""
    return _only(docs, langid.language_id(_named(docs)).where("not rejected"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    return _only(docs, minhash.minhash_dedup(_named(docs)).where("kept"))


def repeated_passages(spark, docs, sf_dir):
    """Passages that an earlier document holds are cut; bytes of a character that a cut splits go with it."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("doc_id"), *(F.col(f"`{c}`") for c in rest)).alias("rest"))
    cut = suffix.cut_repeats(packed, keep=("rest",), as_text=True)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return cut.select(*(new.get(c, F.col("rest").getField(c)).cast(kind).alias(c) for c, kind in docs.dtypes))


def pack(spark, docs, sf_dir):
    """What is left, packed into sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("best_fit_packing", pack)]

#: Neither the sketches nor the models, the packing or the byte-wise cuts are within SQL's reach.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        now = alone(lambda: stage(spark, docs, sf_dir), f"stage-{name}")
        if last:
            last.drop()
        docs, last = now.df, now
    return STAGES[-1][1](spark, docs, sf_dir)
