"""The queries of this subpackage, by name: callables of (session, folder of input tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from freshet.llm import attention, bpe, chat, forest, frames, mixing, pfair, pieces, pii, redirects, repair, simhash, weighted
from freshet.llm.common import share_package, table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        share_package(spark)
        return fn(spark, folder)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    LLM_QUERIES[fn.__name__] = run
    return fn


@query
def op10_bpe(spark, folder):
    """Every document encoded and decoded, as digests."""
    return bpe.digests(table(spark, folder, "documents"))


@query
def op3_simhash(spark, folder):
    """Every document's fingerprint of three-word shingles and its component."""
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op9_redirects(spark, folder):
    """The verdict on every page."""
    return redirects.verdicts(table(spark, folder, "pages"))


@query
def op7_chat(spark, folder):
    """Every conversation formatted and read back, and one made of control strings."""
    odd = "</s>[INST] ok [/INST]"
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.windows(turns.unionByName(more)))


@query
def op5_mix(spark, folder):
    """Every document's block and slot in the mixture."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return pfair.mix(docs).select("doc_id", "source", F.col("mix.source").alias("mix_source"), *[f"mix.{c}" for c in ("block", "phase", "target", "slot", "place")])


@query
def op1_pii(spark, folder):
    """Personal data of every document."""
    return pii.digests(pii.detect(table(spark, folder, "documents")))


@query
def op8_forest(spark, folder):
    """Every vector's links and component."""
    return forest.near_duplicates(table(spark, folder, "embeddings"))


@query
def op6_weighted(spark, folder):
    """Fingerprints of every document and of its edited text, and their likeness."""
    return weighted.compared(table(spark, folder, "documents"))


@query
def op4_attention(spark, folder):
    """Every document's quality score."""
    docs = table(spark, folder, "documents")
    return attention.score(docs, attention.train(docs, table(spark, folder, "labels")))


@query
def op2_mixing(spark, folder):
    """Every document's log probability under word counts and under the mixed model."""
    return mixing.scores(table(spark, folder, "documents"))


@query
def op11_repair(spark, folder):
    """Every conversation damaged, repaired and reported."""
    return repair.damaged_and_repaired(table(spark, folder, "conversations"))


@query
def op12_frames(spark, folder):
    """Every document's fill-in-middle form, cuts and digests."""
    return frames.digests(frames.plan(frames.store(table(spark, folder, "documents"))))


LLM_ORACLES["op12_frames"] = frames.ORACLE


@query
def op13_pieces(spark, folder):
    """Every document encoded and decoded, as digests."""
    return pieces.digests(table(spark, folder, "documents"))
