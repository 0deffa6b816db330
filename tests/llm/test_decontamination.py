import random
import re

from chatsift.llm.decontamination import contamination, proximity_matches

DOCS = "doc_id long, text string, item_id string, w int"
ITEMS = "item_id long, text string"


def words(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window):
    runs = []
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            runs.append((item, w[s : s + window]))
    out = []
    for doc, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for item, run in runs:
            for s in range(len(w) - len(run) + 1):
                if w[s : s + len(run)] == run:
                    hit.update(range(s, s + len(run)))
                    found.add(str(item))
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def run(spark, docs, items, window):
    got = contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), window).collect()
    return sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got], key=str)


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(7)
    vocab = ["the", "of", "Éa", "éa", "x1", "Word", "word", "rare", "ß", "日本"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "--", "_"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 4, 7, 9]))) for i in range(12)] + [(90, None), (91, "..."), (92, "RARE")]
    items += [(93, items[3][1]), (94, "never-seen word")]
    docs = [(i, text(rng.choice([0, 3, 30, 120])), "x", i) for i in range(40)] + [(100, None, None, 1), (101, "", "x", 2)]
    docs += [(102, items[4][1] + " " + items[4][1], "x", 1)] * 2 + [(103, "z " * 3000 + (items[5][1] or ""), "x", 1)]
    assert run(spark, docs, items, 4) == brute(docs, items, 4)


def test_empty_tables_and_null_ids(spark):
    assert run(spark, [], [(1, "a b")], 10) == []
    assert run(spark, [(1, "a b", "x", 1)], [], 10) == [(1, 2, 0, [])]
    assert run(spark, [(None, "a b", "x", 1)], [(1, "a b")], 10) == [(None, 2, 2, ["1"])]


def test_many_blocks_give_the_same(spark, monkeypatch):
    from chatsift.llm import decontamination

    docs = [(i, f"alpha beta gamma delta w{i % 3} tail", "x", 1) for i in range(9)]
    items = [(1, "beta gamma delta"), (2, "w2 tail"), (3, "gamma")]
    whole = run(spark, docs, items, 3)
    monkeypatch.setattr(decontamination.phrase_matches, "__defaults__", ("doc_id", "text", 2))
    assert run(spark, docs, items, 3) == whole == brute(docs, items, 3)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "a b z z z z c"), (3, "c a b"), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, ["a", "b", "c"]), (8, ["x", "y"]), (9, ["nowhere"])], "query_id long, terms array<string>")
    got = sorted((r.doc_id, r.query_id, r.start) for r in proximity_matches(docs, asked, 5).collect())
    assert got == [(1, 7, 0), (1, 8, 1), (3, 7, 0)]


def test_rows_are_matched_by_their_own_text_whatever_their_id(spark):
    phrase = "a b c d e f g h i j"
    docs = [(None, f"x {phrase} y", "i", 1), (None, "clean words", "i", 1), (5, "three clean words", "i", 1),
            (5, f"{phrase} z", "i", 1), (5, f"{phrase} z", "i", 1)]
    got = run(spark, docs, [(1, phrase)], 10)
    assert got == sorted([(None, 12, 10, ["1"]), (None, 2, 0, []), (5, 3, 0, []), (5, 11, 10, ["1"]), (5, 11, 10, ["1"])],
                         key=str)
