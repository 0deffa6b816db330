"""Property checks: results do not depend on the shuffle-partition count, the array
form of the conversation generator equals the turn-row form, and sample/split are consistent."""

import pytest

from pyspark.sql import functions as F

from conftest import SF01

from chatsift.operators.context import array_examples, conversation_examples
from chatsift.plans.queries import QUERIES

SP = "system text"


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("name", ["examples_multi_turn", "dedup_across_sources", "split_assignment",
                                  "session_context_batch"])
def test_independent_of_shuffle_partitions(spark, name):
    results = []
    for n in (1, 2, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            results.append(_rows(QUERIES[name](spark, SF01)))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2] and results[0]


def test_array_form_equals_turn_form_on_driver_data(spark):
    turns = spark.read.parquet(f"{SF01}/conversations.parquet")
    by_turn = conversation_examples(turns, system_prompt=SP, source="t", k=8)
    arrays = (turns.groupBy("conv_id")
              .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
              .select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"),
                                                                      x["text"].alias("content"))).alias("messages")))
    by_array = array_examples(arrays, "messages", system_prompt=SP, source="t", k=8, keep=("conv_id",))
    a = sorted(tuple(r) for r in by_turn.select("conv_id", F.to_json("prompt"), F.to_json("completion")).collect())
    b = sorted(tuple(r) for r in by_array.select("conv_id", F.to_json("prompt"), F.to_json("completion")).collect())
    assert a == b and len(a) == 140


def test_sample_is_prefix_of_larger_sample(spark):
    from chatsift.operators.sampling import sample_exact

    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id")
    small = {r.doc_id for r in sample_exact(docs, 50, 42, "doc_id").collect()}
    large = {r.doc_id for r in sample_exact(docs, 400, 42, "doc_id").collect()}
    assert len(small) == 50 and len(large) == 400 and small <= large


def test_split_is_disjoint_complete_and_exact(spark):
    df = QUERIES["split_assignment"](spark, SF01)
    counts = {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert counts == {"validation": 18, "train": 927 - 18}
    assert df.select("doc_id").distinct().count() == 927
