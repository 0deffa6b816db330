import random
import re

from chatsift.llm import pii_crf

SCHEMA = "doc_id long, text string, spans string, kind int"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), m.end(), 0) for m in re.finditer(EMAIL, text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in re.finditer(CARD, text)
            if 12 <= len(digits(m[0])) <= 19 and pii_crf.luhn(digits(m[0]))]
    out += [(m.start(), m.end(), 3) for m in re.finditer(PHONE, text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(2)
    bits = ["a@b.c", "@", ".", "x_1", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+1 (555) 123-4567",
            "+", "-", "0", "00255", " ", "é", "日", "4111111111111111", "a@b", "foo@bar.com@baz.org", "\n", "..", "12", "@a.b"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert pii_crf.base_spans(text) == brute(text), text


def test_luhn():
    assert pii_crf.luhn("4111111111111111") and not pii_crf.luhn("4111111111111112")


def documents():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    card = lambda: next(c for i in range(10) if pii_crf.luhn(c := f"4{rng.randrange(10**14):014d}{i}") or i == 9)
    phone = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(10**4):04d}"
    docs = []
    for i in range(300):
        mid = rng.choice([card, phone, lambda: f"{word()}.{i}@mail{i % 5}.example.com",
                          lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), lambda: str(rng.randrange(2000))])()
        docs.append((i, f"{word()} {word()} {mid} {word()}, {word()}.", "x", 1))
    return docs, phone(), "4111111111111111"


def test_field_adds_what_the_greedy_patterns_miss(spark):
    docs, phone, card = documents()
    text = f"so {phone} {card} and on"
    docs += [(900, text, "x", 1), (901, None, "x", 1), (902, "", None, None), (903, "plain words only " * 2000, "x", 1),
             (904, "in 1999, room 12 and 3 more", "x", 1), (None, "a@b.co", "x", 1), docs[0]]
    df = spark.createDataFrame(docs, SCHEMA)
    field = pii_crf.fit(pii_crf.labelled_runs(df))
    got = {}
    for r in pii_crf.find_spans(df, field).collect():
        got.setdefault(r.doc_id, []).append([(s.start, s.end, s.kind, s.base) for s in r.spans])
    for doc, t, *_ in docs:
        base = [(b, e, pii_crf.KINDS[k], True) for b, e, k in brute(t or "")]
        assert all([s for s in x if s[3]] == base for x in got[doc])
    start = text.index("+")
    found = got[900][0]
    assert (start, start + len(phone), "phone", False) in found
    assert (text.index(card), text.index(card) + len(card), "card", False) in found
    assert got[901] == got[902] == got[903] == got[904] == [[]]
    assert len(got[0]) == 2 and got[None] == [[(0, 6, "email", True)]]
    masked = {r.doc_id: r.text for r in pii_crf.redact(df, field).collect()}
    assert masked[900] == "so [PHONE] [CARD] and on" and masked[901] is None and masked[903] == docs[303][1]


def test_nothing_to_train_on_and_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pii_crf.fit(pii_crf.labelled_runs(empty)) is None
    assert pii_crf.find_spans(empty, None).collect() == []
    one = spark.createDataFrame([(1, "x a@b.co y", "s", 1)], SCHEMA)
    assert [s.kind for s in pii_crf.find_spans(one, None).first().spans] == ["email"]


def test_viterbi_equals_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    emit, move, first = rng.normal(size=(5, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    for e, got in zip(emit, pii_crf.viterbi(emit, move, first)):
        best = max(itertools.product(range(3), repeat=4), key=lambda p: first[p[0]] + sum(e[t, p[t]] for t in range(4)) + sum(
            move[p[t - 1], p[t]] for t in range(1, 4)))
        assert tuple(got) == best


def test_marks_behind_long_stretches_and_draws_of_any_size():
    shapes = pii_crf._Shapes()
    assert {"luhn", "n=16"} <= set(shapes["x" * 300 + "4111111111111111"]) and "at-dot" in shapes["x-" * 150 + "a@b.org"]
    assert shapes["a-" * 40 + "1"][0] != shapes["a-" * 40 + "@"][0]
    for n in (4_000, 10_000, 4_000_000_001, 10**13):  # some hashes are drawn, in proportion
        part = (pii_crf.last_drawn(n, 4_000) + (1 << 63)) / 2**64
        assert abs(part - 4_000 / n) <= 1e-6 * 4_000 / n


def test_one_single_word_to_label_in_a_batch(spark):
    docs, phone, card = documents()
    field = pii_crf.fit(pii_crf.labelled_runs(spark.createDataFrame(docs, SCHEMA)))
    assert pii_crf.added_spans(["only 7 here", "plain"], [[], []], field) == [[], []]
    alone = [[(900, "mail a@b.co now", "x", 1)], [(901, "room 12", "x", 1), (902, f"{phone} {card}", "x", 1), (903, None, "x", 1)]]
    for rows, masked in zip(alone, ({900: "mail [EMAIL] now"}, {901: "room 12", 902: "[PHONE] [CARD]", 903: None})):
        df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        assert {r.doc_id: r.text for r in pii_crf.redact(df, field).collect()} == masked
        for r in pii_crf.find_spans(df, field).collect():
            base = [(b, e, pii_crf.KINDS[k]) for b, e, k in brute(dict((x[0], x[1]) for x in rows)[r.doc_id] or "")]
            assert [(s.start, s.end, s.kind) for s in r.spans if s.base] == base
