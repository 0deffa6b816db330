"""Registered queries of the training-data operators against their SQL, and the pipeline."""

import corpus_pipeline
import pytest
from conftest import SF01, SF001
from llm_helpers import union_smallest
from oracle_harness import compare, duck
from test_simhash import brute_fp

from chatsift.llm import decontamination, language_id, pii_crf
from chatsift.llm.oracles import ORACLES
from chatsift.llm.queries import QUERIES


@pytest.mark.parametrize("sf", [SF001, SF01])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name, sf):
    res = compare(QUERIES[name](spark, sf), duck(sf), ORACLES[name])
    assert res["cols_match"], res["cols"]
    assert res["rows"][0] == res["rows"][1] and res["hash_match"], res["first_diff"]


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_equals_its_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    found = {r.doc_id: r for r in language_id.document_languages(docs).collect()}
    left = [d for d in rows if rows[d].text and found[d].probability >= 0.5]
    fps = {d: brute_fp(rows[d].text) for d in left}
    links = [(a, b) for i, a in enumerate(left) for b in left[:i] if (fps[a] ^ fps[b]).bit_count() <= 3]
    low = union_smallest(left, links)
    left = [d for d in left if low[d] == d]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    from test_decontamination import brute

    left = [d for d, _, hit, _ in brute([(d, rows[d].text) for d in left], items, decontamination.WINDOW) if not hit]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF001).collect()}
    assert set(out) == set(left)
    for d, r in out.items():
        text = rows[d].text
        assert not pii_crf.base_spans(r.text) and r.n_chars == len(r.text)
        if "[" not in r.text:
            assert r.text == text
    assert len({(r.mix_slot, r.mix_rank) for r in out.values()}) == len(out)


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, f"{text} {i} " * 4, "en", "s", 1) for i in range(6)] + [(3, "another text " * 5, "en", None, None), (3, "another text " * 5, "en", None, None)]
    rows += [(20, None, "en", "s", 1), (21, "", None, None, None), (None, "no id but words " * 3, "en", "s", 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, keep in corpus_pipeline.STAGES[:-1]:
            docs = keep(spark, docs, SF001)
            assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
        out = corpus_pipeline.STAGES[-1][1](spark, docs, SF001).collect()
        ids = [r.doc_id for r in out]
        assert (not data or ids.count(3) == 2) and 20 not in ids and 21 not in ids and (not data or None in ids)


def test_rows_of_null_and_repeated_ids_are_judged_by_their_own_text(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = {c: " ".join(f"{c}{i * 7 % 40}" for i in range(60)) for c in "ABC"}
    rows = [(1, text["A"], "en", "s", 1), (5, text["A"], "en", "s", 1), (5, text["B"], "en", "s", 1),
            (None, text["C"], "en", "s", 1), (None, text["C"], "en", "t", 1), (9, text["B"], "en", "s", 1), (9, text["B"], "en", "s", 1)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(corpus_pipeline.drop_near_duplicates(spark, docs, SF001).select("doc_id", "text").collect(), key=str)
    assert got == sorted([(1, text["A"]), (5, text["B"]), (None, text["C"])], key=str)
    same = [(9, text["B"], "en", "s", 1)] * 3 + [(None, text["C"], "en", "s", 1)] * 2
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(same, schema), SF001).collect()
    assert sorted(str(r.doc_id) for r in got) == ["9", "None"]
    item = spark.read.parquet(f"{SF001}/benchmark.parquet").first().text
    rows = [(None, f"before {item} after", "en", "s", 1), (None, text["A"], "en", "s", 1), (3, item, "en", "s", 1), (3, "three clean words", "en", "s", 1)]
    got = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, schema), SF001).collect()
    assert sorted(r.text for r in got) == sorted([text["A"], "three clean words"])


def test_personal_data_stage_takes_a_batch_with_one_single_word_to_label(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = [f"so {x} and on" for i in range(60) for x in (f"a{i}@mail.example.com", f"10.0.{i}.1", f"room {i}")]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    alone = [(900, "mail a@b.co now", "en", "s", 15), (901, "plain words", None, None, None), (None, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, schema).unionByName(spark.createDataFrame(alone, schema).repartition(1))
    assert docs.rdd.getNumPartitions() > 1
    got = {r.doc_id: r for r in corpus_pipeline.mask_personal_data(spark, docs, SF001).collect()}
    assert len(got) == len(rows) + len(alone)
    assert (got[900].text, got[900].n_chars, got[901].text, got[None].text) == ("mail [EMAIL] now", 16, "plain words", None)
    assert [got[i].text for i in range(3)] == ["so [EMAIL] and on", "so [IP] and on", "so room 0 and on"]
