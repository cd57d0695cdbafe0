import random

import pytest

from formflow.llm import canonical as C

MAINS = "Kürbissuppe Apfelstrudel Roggenfladen Zwiebelwähe Lachsröllchen Mohnschnecke Haferriegel Tofuspiess".split()
SECONDS = "Basilikum Haselnuss Rosinen Petersilie Rauchspeck Kardamom Bergkäse".split()
rng = random.Random(3)
PRODUCTS = [(i + 1, f"{m} {rng.choice(['an', 'mit', 'nach Art'])} {s}") for i, (m, s) in enumerate((m, s) for k, m in enumerate(MAINS) for j, s in enumerate(SECONDS) if (k + j) % 3)]
BY_NAME = {(n.split()[0], n.split()[-1]): i for i, n in PRODUCTS}
NAMES = C.ListMatcher(PRODUCTS, marks=False)
FORMS = [(1, "Bestellblatt 1"), (2, "Bestellblatt 2"), (3, "Formular A"), (4, "Formular B"), (5, "Wochenplan Nord"), (6, "Wochenplan Süd"), (7, "Retourenschein")]
CODES = C.CodeMatcher([(1, "1", 1, 1), (2, "74-85", 74, 85), (3, "90", 90, 90), (4, None, None, None), (5, "101", 101, 101)])


def noisy(text, r):
    """One or two alterations of a name."""
    for _ in range(r.randrange(1, 3)):
        k = r.randrange(1, len(text) - 1)
        kind = r.randrange(6)
        if kind == 0:
            text = text[:k] + text[k + 1 :]
        elif kind == 1:
            text = text[:k] + text[k + 1 : k + 2] + text[k : k + 1] + text[k + 2 :]
        elif kind == 2:
            text = text[:k] + text[k] + text[k:]
        elif kind == 3:
            text = text.replace("l", "1", 1)
        elif kind == 4:
            text = text.upper()
        else:
            text = text.replace("n", "ri", 1)
    return text


def test_accuracy_on_altered_names():
    r = random.Random(9)
    right = sum(NAMES.match(noisy(n, r)) == i for i, n in PRODUCTS for _ in range(15))
    assert right >= 0.97 * 15 * len(PRODUCTS)


@pytest.mark.parametrize("form", ["{s} / {m}", "{s}-{m}", "{m}, {s}", "{m} m. {s}", "[] {m} + {s}", "2x {m} {s} 250g", "{m} mit {s} (neu)", "{mu} {su}", "{m}\t{s}"])
def test_ways_of_writing(form):
    for (m, s), i in list(BY_NAME.items())[::5]:
        assert NAMES.match(form.format(m=m, s=s, mu=m.upper(), su=s.upper())) == i


def test_abbreviations_and_splits():
    m, s = next(iter(BY_NAME))
    assert NAMES.match(f"{m[:5]}. {s[:5]}.") == BY_NAME[m, s]
    assert NAMES.match(f"{m[:4]}- {m[4:]} an {s}") == BY_NAME[m, s]


def test_threshold_and_margin_decide():
    """Either parameter changes what is accepted; an entry that isn't told from the next is none."""
    entries = [(1, "Preiselbeeren"), (2, "Preiselbeerem"), (3, "Haselnuss")]
    assert C.ListMatcher(entries, marks=False, margin=0.0).match("Preiselbeere") in (1, 2)
    assert C.ListMatcher(entries, marks=False).match("Preiselbeere") == 0
    assert C.ListMatcher(entries, marks=False).match("Haslenuss") == 3
    assert C.ListMatcher(entries, marks=False, threshold=0.9).match("Haslenuss") == 0


def test_joining_words_come_from_the_list():
    assert NAMES.joiners == {"an", "mit", "nach", "art"}
    assert C.ListMatcher(FORMS, marks=True).joiners == set()
    other = C.ListMatcher([(1, "Pain con Tomate"), (2, "Arroz con Leche"), (3, "Crema de Leche")], marks=False)
    assert other.joiners == {"con", "de"} and other.match("tomate / pain") == 1 and other.match("Crema con Leche") == 3


def test_every_candidate_is_scored():
    """Words that share most n-grams but not the rare ones don't push out the right one."""
    far = [f"banane{x}banane" for x in ("nan", "ban", "ane", "anan", "bana")]
    index = C.WordIndex([*far, "banone"])
    assert len(index.scores("banane", False)) == 6
    assert index.near("banane", index.words.index("banone"), False) and not index.near("banane", 0, False)


def test_many_short_words():
    m, s = next(iter(BY_NAME))
    value = " ".join(w[i : i + 2] for w in (m + "x" * (len(m) % 2), s + "x" * (len(s) % 2)) for i in range(0, len(w), 2))
    assert NAMES.match(value) == BY_NAME[m, s]
    long = C.ListMatcher([(1, "Donaudampfschifffahrtskapitaen mit Petersilienwurzeln"), (2, "Donau mit Wurzeln")], marks=False)
    assert long.match("do na ud am pf sc hi ff fa hr ts ka pi ta en pe te rs il ie nw ur ze ln") == 1
    assert long.match("ab cd " * 30_000) == 0
    assert NAMES.match(f"{m} an {s} bitte ohne Zwiebeln aber mit viel Liebe und ganz schnell wie immer") == BY_NAME[m, s]


def test_what_the_list_does_not_hold():
    missing = [(m, s) for m in MAINS for s in SECONDS if (m, s) not in BY_NAME]
    assert missing and all(NAMES.match(f"{m} mit {s}") == 0 for m, s in missing)
    for v in ("Trüffelpraline an Basilikum", "Bemerkungen", "-", "???", "Gurkenkaltschale mit Rosinen", "x" * 100_000, "a " * 50_000):
        assert NAMES.match(v) == 0


@pytest.mark.parametrize(("value", "want"), [("1", 1), ("0001", 1), ("No. 1", 1), ("Nr.90", 3), ("９０", 3), ("9O", 3), ("#90", 3), ("(90)", 3), ("90.", 3), (" 90 ", 3), ("lOl", 5), ("80", 2), ("74 - 85", 2), ("74–85", 2), ("074-085", 2), ("74 bis 85", 2), ("75-85", 0), ("86", 0), ("--", 0), ("neu", 0), ("", 0), ("1 2 3", 0)])
def test_codes(value, want):
    assert CODES.match(value) == want


def test_forms():
    f = C.ListMatcher(FORMS, marks=True)
    for value, want in {
        "Betellbatt 1": 1, "BESTELLBLATT 2": 2, "Bestellblatt2": 2, "Bestellblatt Nr. 2": 2, "Bestell blatt 1": 1, "Bestellblatt  2 v2": 2, "Formular_A": 3,
        "FormularB": 4, "F0rmu1ar A": 3, "Formular A (Kopie)": 3, "WochenplanSüd": 6, "Wochen. Nord": 5, "Retour.": 7, "Retourenschein NEU": 7,
        "Bestellblatt 88": 0, "Formular X": 0, "Lieferschein": 0, "Bestellblatt": 0, "unknown": 0,
    }.items():
        assert f.match(value) == want, value


def test_table(spark):
    schema = "entry_id bigint, product_name string, product_number string, value string"
    m, s = next(iter(BY_NAME))
    exact = PRODUCTS[0][1]
    rows = [
        (1, f"{s} {m}", "80", "x"), (1, f"{s} {m}", "80", "y"), (2, exact, "1", "x"), (3, None, "", "x"), (4, " \t ", "?", "x"),
        (None, "abc", "80", "x"), (5, "Currywurst", None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, C.match_fields(df, {"product_name": NAMES, "product_number": CODES}).collect()))
    assert got == [(1, "product_name", BY_NAME[m, s]), (1, "product_number", 2), (4, "product_number", 0), (5, "product_name", 0)]
    assert C.match_fields(df.limit(0), {"product_name": NAMES}).count() == 0
    with pytest.raises(ValueError, match="broadcast"):
        C.read_list(df, ["entry_id"], most=1)


def test_edits():
    assert [C.edits(a, b) for a, b in (("", "abc"), ("abc", "abc"), ("abc", "acb"), ("kitten", "sitting"))] == [3, 0, 1, 3]
