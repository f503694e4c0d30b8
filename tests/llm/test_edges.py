"""Nulls in any column, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator here."""

import pytest
from pyspark.sql import functions as F

from stepweave.llm import caps, conversations, languages, mixing, packing, pairs, personal, truncation

CLASHING = ("text", "cut", "carried", "tokens", "a", "b", "c", "n", "votes", "kind", "name", "chunk", "acc", "label", "defect", "seg_no", "source", "__at", "__rank", "__n", "cap", "rank", "h", "shard", "grp", "bin", "capacity", "record_key", "path", "s")

OPERATORS = {
    "conversations": (lambda t: conversations.left_out_logs(t["messages"]), ["messages"]),
    "conversation_rows": (lambda t: conversations.conversations(t["messages"]), ["messages"]),
    "caps": (lambda t: caps.capped_trajectories(t["trajectories"], t["contributors"]), ["trajectories", "contributors"]),
    "top": (lambda t: caps.best_of_tasks(t["trajectories"]), ["trajectories"]),
    "pairs": (lambda t: pairs.defective_pairs(t["sft_records"]), ["sft_records"]),
    "personal": (lambda t: personal.personal_values(t["browser_trajectory"], t["given_names"]), ["browser_trajectory", "given_names"]),
    "cut": (lambda t: truncation.cut_values(t["browser_trajectory"]), ["browser_trajectory"]),
    "shares": (lambda t: truncation.cut_shares(t["browser_trajectory"]), ["browser_trajectory"]),
    "limits": (lambda t: truncation.field_limits(t["browser_trajectory"]), ["browser_trajectory"]),
    "packing": (lambda t: packing.packed_documents(t["documents"], t["containers"]), ["documents", "containers"]),
    "mixing": (lambda t: mixing.mixture(t["documents"], t["mix_targets"]), ["documents", "mix_targets"]),
    "languages": (lambda t: languages.mislabelled(t["documents"]), ["documents"]),
}


def tables(spark, data, names):
    return {n: spark.read.parquet(f"{data}/{n}.parquet") for n in names}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, data, name):
    run, names = OPERATORS[name]
    assert run({n: t.limit(0) for n, t in tables(spark, data, names).items()}).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_and_clashing_columns_change_nothing(spark, data, name):
    run, names = OPERATORS[name]
    plain = tables(spark, data, names)
    want = sorted(map(repr, run(plain).collect()))
    assert want
    odd = {}
    for n, t in plain.items():
        nulls = spark.createDataFrame([tuple(None for _ in t.columns)] * 2, t.schema)
        # A row delivered again is the same row; the share of each contributor counts distinct hashes.
        more = t.unionByName(t.limit(7)).unionByName(nulls)
        odd[n] = more.select(*more.columns, *(F.lit("x").alias(c) for c in CLASHING if c not in more.columns))
    assert sorted(map(repr, run(odd).collect())) == want


def test_very_long_and_odd_texts(spark, data):
    long = ["word " * 40_000, "a" * 200_000, "。" * 50_000, "\u0000퟿", "1 " * 40_000, " ", "", "A. B. " * 8_000]
    docs = spark.createDataFrame([(i, t, None, "aldren-shop") for i, t in enumerate(long)], "doc_id bigint, text string, lang string, source string")
    t = tables(spark, data, ["containers", "mix_targets", "given_names"])
    assert packing.packed_documents(docs, t["containers"]).select("doc_id").distinct().count() == len(long)
    assert mixing.mixture(docs, t["mix_targets"]).count() == len(long)
    languages.mislabelled(docs).collect()
    sft = docs.select(F.col("doc_id").alias("record_id"), F.col("text").alias("instruction"), F.col("text").alias("response"))
    assert pairs.defective_pairs(sft).count() >= 3
    steps = docs.select(F.col("doc_id").alias("traj_id"), F.lit("x").alias("agent"), F.array(F.struct(F.col("text").alias("thought"), F.struct(F.lit("n").alias("name"), F.lit(None).cast("string").alias("parameters")).alias("tool_call"), F.struct(F.col("text").alias("output")).alias("tool_result"))).alias("steps"))
    truncation.cut_values(steps).collect()
    personal.personal_values(steps, t["given_names"]).collect()
