import random

import pytest

from formflow.llm import contamination as C
from formflow.llm.words import words_of

rng = random.Random(11)
VOCAB = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(3000)]


def passage(n, seed):
    return " ".join(random.Random(seed).choices(VOCAB, k=n))


ITEMS = {i: passage(60, i) + "\nQuestion: " + passage(8, 1000 + i) + "?" for i in range(20)}
ITEMS[20] = ITEMS[3].split("\n")[0] + "\nQuestion: another one?"  # shares the passage


def frames(spark, docs, items=None):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string, _spans int")
    i = spark.createDataFrame(list((items or ITEMS).items()), "item_id bigint, text string")
    return d, i


def altered(words, seed, every=8):
    """One small alteration every few words: a typo, a lost or an extra word, another case or punctuation."""
    r, out = random.Random(seed), []
    for k, w in enumerate(words):
        kind = r.randrange(5) if k % every == every - 1 else -1
        if kind == 0:
            w = w[:1] + w[2:]
        elif kind == 1:
            continue
        elif kind == 2:
            out.append("extra")
        elif kind == 3:
            w = w.upper() + ","
        elif kind == 4:
            w = "replaced"
        out.append(w)
    return " ".join(out)


def test_copies_and_alterations(spark):
    docs, want = [], set()
    for i in range(20):
        words = ITEMS[i].split("\n")[0].split()
        docs.append((i, f"{passage(300, 500 + i)} {' '.join(words[10:40])} {passage(300, 600 + i)}", "x", 1))
        docs.append((100 + i, f"{passage(50, 700 + i)}. {altered(words, i)} {passage(50, 800 + i)}", "x", 1))
        docs.append((200 + i, f"{passage(80, 900 + i)} {' '.join(words[:12])} {passage(80, 950 + i)}", "x", 1))  # too short
        docs.append((300 + i, passage(400, 2000 + i), "x", 1))
        want |= {(i, i), (100 + i, i)}
    want |= {(3, 20), (103, 20)}
    got = {tuple(r) for r in C.found_pairs(*frames(spark, docs)).collect()}
    assert got == want


def test_length_limit(spark):
    words = ITEMS[0].split()[:40]
    docs = [(n, f"{passage(30, 31)} {' '.join(words[:n])} {passage(30, 32)}", "", 0) for n in range(15, 26)]
    got = {r.doc_id for r in C.found_pairs(*frames(spark, docs)).collect()}
    assert got == set(range(20, 26))


def test_same_pattern_is_no_copy(spark):
    fill = lambda s: (lambda r: "the mill near {} kept a {} running on {} for {} days because the {} valve closes within {} seconds and the quarry is cut off from the {} main".format(*[r.choice(VOCAB) + str(r.randrange(10, 99)) for _ in range(7)]))(random.Random(s))
    items = {i: fill(i) + "\nQuestion?" for i in range(60)}
    docs = [(i, f"{passage(40, i)} {fill(5000 + i)} {passage(40, 77)}", "", 0) for i in range(40)] + [(99, f"x {fill(7)} y", "", 0)]
    assert {tuple(r) for r in C.found_pairs(*frames(spark, docs, items)).collect()} == {(99, 7)}


def test_look_alikes_and_hidden_characters(spark):
    words = ITEMS[4].split("\n")[0]
    swapped = words.translate(str.maketrans("aeocp", "\u0430\u0435\u043e\u0441\u0440"))
    hidden = "\u200b".join(words[k : k + 5] for k in range(0, len(words), 5))
    wide = "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in words)
    d, i = frames(spark, [(1, swapped, "", 0), (2, hidden, "", 0), (3, wide, "", 0)])
    assert {tuple(r) for r in C.found_pairs(d, i).collect()} == {(1, 4), (2, 4), (3, 4)}
    assert C.without_leaks(d, i).filter("length(trim(text)) > 0").count() == 0


def test_blocks_of_items_give_the_same(spark):
    docs = [(i, ITEMS[i % 21], "", 0) for i in range(42)]
    d, i = frames(spark, docs)
    whole = sorted(map(tuple, C.found_pairs(d, i).collect()))
    assert sorted(map(tuple, C.found_pairs(d, i, block_words=100).collect())) == whole
    assert len(whole) >= 42


def test_edges(spark):
    words = ITEMS[1].split("\n")[0]
    long = (passage(2000, 50005) + " ") * 40 + words + " " + passage(2000, 50006)
    docs = [(1, None, "", 0), (2, "", "", 0), (3, "   ", "", 0), (None, words, "", 0), (4, long, "", 0), (5, words, "", 0), (5, words, "", 0)]
    d, i = frames(spark, docs)
    assert sorted(map(tuple, C.found_pairs(d, i).collect())) == [(4, 1), (5, 1)]
    assert C.found_pairs(d.limit(0), i).count() == 0
    assert C.found_pairs(d, i.limit(0)).count() == 0
    with pytest.raises(ValueError, match="broadcast"):
        C.found_pairs(d, i, words_total=1)


def test_spans_are_cut(spark):
    words = ITEMS[2].split("\n")[0]
    d, i = frames(spark, [(1, f"Vorher. {words}! Nachher.", "keep", 3), (2, "nichts", "keep", 4), (None, None, None, None)])
    rows = {r.doc_id: r for r in C.without_leaks(d, i).collect()}
    assert rows[1].text == "Vorher. ! Nachher." and rows[1].leaked_words == 60 and rows[1].item_id == "keep"
    assert rows[2].text == "nichts" and rows[2].leaked_words == 0 and rows[None].text is None


def test_words():
    assert words_of("Über-Größe, 12.5 Fraîche_x") == ["uber", "große", "12", "5", "fraiche", "x"]
    assert words_of("über") == ["uber"]
    assert C.alike("still", "st1ll") and C.alike("kiln", "klin") and not C.alike("19", "29") and not C.alike("cat", "cap")
