from conftest import SF01

from chatsift.llm import language_id as lid


def test_address_parts(spark):
    rows = [("https://m.blog.Example.com/fr/825?page=2",), ("http://x.de",), (None,), ("not a url",), ("http://a.b.co.uk:80/en-GB/x#y",)]
    got = spark.createDataFrame(rows, "url string").select(
        lid.url_host(lid.F.col("url")), lid.address_suffix(lid.F.col("url"))).collect()
    assert [tuple(r) for r in got] == [("m.blog.example.com", "com/fr"), ("x.de", "de/"), ("", "/"), ("", "/"), ("a.b.co.uk", "uk/en-gb")]


def test_documents_by_text_alone_and_fused(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = lid.document_languages(docs).collect()
    assert len(rows) == len(truth)
    assert sum(r.text_lang == truth[r.doc_id] for r in rows) >= 0.97 * len(rows)
    assert sum(r.lang == truth[r.doc_id] for r in rows) >= 0.99 * len(rows)
    assert not any(r.probability < 0.5 for r in rows)


def test_held_out_pages_without_a_declaration(spark):
    """Pages whose markup declaration is taken away are still told from the rest."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    truth = {r.page_id: r.lang for r in pages.select("page_id", lid.markup_language(F.col("html")).alias("lang")).collect()}
    blind = pages.withColumn("html", F.when(F.col("page_id") % 5 == 0, F.regexp_replace("html", ' lang="..">', ">")).otherwise(F.col("html")))
    rows = [r for r in lid.page_languages(blind).collect() if r.page_id % 5 == 0]
    assert rows and all(r.declared is None for r in rows)
    assert sum(r.lang == truth[r.page_id] for r in rows) >= 0.95 * len(rows)


def test_nulls_empty_long_and_repeated_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, vote int"
    rows = [(i, "the cat and the dog of the house " * 3, "en", "s", 1, "x", 1) for i in range(20)]
    rows += [(50 + i, "der hund und die katze von dem haus " * 3, "de", None, 1, "x", 1) for i in range(20)]
    rows += [(100, None, "en", "s", 1, None, 1), (101, "", None, None, None, None, None), (102, "und die katze " * 9000, None, None, 1, "x", 1),
             (103, "\n \t", "de", "s", 1, "x", 1), rows[0], (None, "the house and the dog", "en", "s", 1, "x", 1)]
    got = lid.document_languages(spark.createDataFrame(rows, schema))
    by = {r.doc_id: r for r in got.withColumn("out", lid.rejected()).collect()}
    assert got.count() == len(rows)
    assert by[102].lang == "de" and by[None].lang == "en" and by[100].out and by[101].out and not by[102].out
    assert lid.document_languages(spark.createDataFrame([], schema)).collect() == []
    none = spark.createDataFrame([(1, "some text", None, "s", 1, "x", 1)], schema)
    assert lid.document_languages(none).first().lang is None


def test_more_than_64_languages_and_a_rare_one(spark):
    schema = "doc_id long, text string, lang string, source string"
    rows = [(100 * k + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}" for w in ("qa", "ro", "mi", "tes")) * 5, f"l{k:02d}", "s")
            for k in range(80) for i in range(4)]
    got = lid.document_languages(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows) and all(r.lang == r.text_lang == f"l{r.doc_id // 100:02d}" and r.probability > 0.5 for r in got)
    table = [(f"the house {i}", "en", str(i)) for i in range(3000)] + [(f"das haus {i}", "de", f"d{i}") for i in range(3)]
    langs, model = lid.fit_text_model(spark.createDataFrame(table, "text string, declared string, key string"), 30)
    assert langs == ["de", "en"] and all(row.max() - row.min() > 1 for row in model)  # neither is flat
