import random
from collections import Counter

import numpy as np

from formflow.llm import stuffing as S
from formflow.llm.words import Cache

rng = random.Random(5)
NOUNS = [f"{a}{b}" for a in ("ro", "la", "ven", "kup", "mir") for b in ("tor", "der", "sel", "pan", "lig", "mor")]
VERBS = "turns holds lifts moves presses joins guides cools heats drives".split()
SHAPE = S.Shape(words=14, pairs=16, separators=10)


def sentence(r):
    a, b, c = r.choices(NOUNS, k=3)
    return r.choice([
        f"The {a} {r.choice(VERBS)} the {b} while it is held by the {c}.", f"In this case a {a} of the {b} {r.choice(VERBS)} against the {c}.",
        f"It has been found that the {a} is placed between the {b} and the {c}.", f"As shown in figure {r.randrange(9)}, the {a} ({r.randrange(200)}) {r.choice(VERBS)} a {b}.",
    ])


def prose(seed, n=25):
    r = random.Random(seed)
    return " ".join(sentence(r) for _ in range(n))


def spam(seed):
    r = random.Random(seed)
    w = lambda: r.choice(NOUNS)
    kind = seed % 5
    if kind == 0:
        k = w()
        return " ".join(f"cheap {k} buy {k} {w()} best {k} price {k}." for _ in range(30))
    if kind == 1:
        return "\n".join(f'<a href="http://{w()}-{w()}.example/{w()}-{w()}.html">{w()}</a>' for _ in range(30))
    if kind == 2:
        return "\n".join(f"#{w()}{w()}" for _ in range(80))
    if kind == 3:
        return "\n".join(f"Home > {w()} > {w()} {w()}" for _ in range(50))
    return "\n".join(f"AB {r.randrange(10**6, 10**7)} C{r.randrange(3)}" for _ in range(80))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, words int, _stuffed string")


def test_pages(spark):
    rows = [(i, prose(i), 1, "x") for i in range(400)] + [(1000 + i, spam(i), 1, "x") for i in range(25)]
    rows += [(2000 + i, prose(3000 + i, 30) + "\n" + "\n".join(spam(i).split("\n")[:6])[:300] + "\n" + prose(4000 + i, 30), 1, "x") for i in range(10)]
    rows += [(3000, None, 1, "x"), (3001, "", 1, "x"), (3002, "word", 1, "x"), (3003, "...", 1, "x"), (None, spam(1), 1, "x"), (1000, spam(0), 1, "x")]
    df = docs(spark, rows)
    got = sorted(r.doc_id for r in S.stuffed_pages(df, shape=SHAPE).collect())
    assert set(got) >= {1000 + i for i in range(25)} and len(got) <= 25 + 3
    kept = S.without_stuffing(df, shape=SHAPE)
    assert len(rows) - 29 <= kept.count() <= len(rows) - 26 and kept.columns == df.columns
    assert S.stuffed_pages(df.limit(0), shape=SHAPE).count() == 0


def test_copies_do_not_explain_a_page(spark):
    pages = [(i, prose(i), 1, "x") for i in range(300)]
    for kind in range(5):
        text = spam(20 + kind)
        copies = [text, text.upper(), text.replace(" ", "  ")]
        rows = pages + [(1000 + i, copies[i % 3] if kind else text, 1, "x") for i in range(150)]
        got = {r.doc_id for r in S.stuffed_pages(docs(spark, rows), shape=SHAPE).collect()}
        assert got >= {1000 + i for i in range(150)} and len(got) <= 150 + 3, kind


def test_rare_words_without_relation(spark):
    r = random.Random(8)
    rare = [f"{a}{b}{c}" for a in ("bal", "dor", "fen", "gis") for b in ("a", "e", "o", "u", "ima", "oru") for c in ("tt", "ll", "x", "sk", "rn", "ph", "nd", "mp", "gg", "dd")]
    usual = lambda: f"The {r.choice(rare)} turns the {r.choice(NOUNS)}. It has been found by the {r.choice(rare)}."
    pages = [(i, " ".join(usual() for _ in range(10)), 1, "x") for i in range(300)]
    salad = [(1000 + i, " ".join(r.sample(rare, 150)), 1, "x") for i in range(3)]
    foreign = [(2000, " ".join("".join(r.choices("aeioukst", k=6)) for _ in range(150)), 1, "x")]
    got = {x.doc_id for x in S.stuffed_pages(docs(spark, pages + salad + foreign), shape=S.Shape(words=18, pairs=18)).collect()}
    assert got == {1000, 1001, 1002}


def test_floor_is_the_count_of_what_never_occurred():
    sketch = S.Sketch(S.Shape(words=8, pairs=8, separators=8))
    r = np.random.default_rng(1)
    sketch.add("pairs", r.integers(0, 2**63, 20_000).astype(np.uint64))
    never = sketch.get("pairs", r.integers(0, 2**63, 20_000).astype(np.uint64))
    assert abs(sketch.floor("pairs") - never.mean()) < 2 and never.mean() > 50
    assert sketch.floor("words") == 0


def test_counts_are_those_of_one_pass(spark):
    texts = [prose(i, 5) + spam(i) for i in range(40)]
    whole = S.Sketch(SHAPE)
    for t in texts:
        page = S.Page([t], Cache(S._code))
        whole.add("words", page.word)
        whole.add("pairs", page.pair[page.follows])
        whole.add("separators", page.between)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(9)
    old, S.FAN_IN = S.FAN_IN, 3
    try:
        got = S.corpus_counts(df, SHAPE)
    finally:
        S.FAN_IN = old
    assert (got.counts == whole.counts).all() and got.total() == whole.total()


def test_sketch_bounds_counts_from_above():
    page = S.Page([prose(1, 200)], Cache(S._code))
    sketch = S.Sketch(S.Shape(words=6, pairs=6, separators=6))
    sketch.add("pairs", page.pair)
    exact = Counter(page.pair.tolist())
    est = sketch.get("pairs", np.array(list(exact), dtype=np.uint64))
    assert all(e >= n for e, n in zip(est, exact.values(), strict=True))


def test_page_structure():
    page = S.Page(["Ab cd, 12\nef", "", "x"], Cache(S._code))
    assert page.doc.tolist() == [0, 0, 0, 0, 2]
    assert page.follows.tolist() == [True, True, True, False, False]
    assert (page.stops - page.starts).tolist() == [4, 0, 1]
    one, two = S.Page(["12"], Cache(S._code)), S.Page(["345"], Cache(S._code))
    assert one.word[0] == two.word[0]
