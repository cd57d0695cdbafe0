import random

from pyspark.sql import functions as F

from formflow.llm import mojibake as M

WORDS = "Bäckerei Küche Müliau Zürnbach Grüsse Rückfrage Größe Prüfen Crème Brûlée Pâté Réassort Öhrliberg Früchte Käse Rösti Menü Süd Dvořiště Łęgowo naïf Smørrebrød".split()
WAYS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("cp1252", "cp850"), ("cp1252", "mac_roman")]


def wrong(text, true, other):
    return M.NON_ASCII.sub(lambda m: M.garble(m.group(), true, other) or m.group(), text)


def table(spark, rows):
    return spark.createDataFrame(rows, "email_id string, value string, key string, n int")


def test_round_trips():
    for w in WORDS:
        for true, other in WAYS:
            if any(M.garble(run, true, other) is None for run in M.NON_ASCII.findall(w)):
                continue
            g = wrong(w, true, other)
            if g != w and not M.stray(g):
                assert M.NON_ASCII.sub(lambda m: M.undo(m.group(), true, other) or "", g) == w
    assert M.restored_runs("KÃ¼che", M.ENCODINGS) == "Küche"
    twice = wrong(wrong("Küche", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert M.restored_runs(twice, M.ENCODINGS) == "Küche"
    assert M.explain("Küche", twice) == ("utf-8>cp1252*2", True)
    for clean in ("MAÇÃ", "«Öhrliberg»", "Łęgowo", "заказ", "Παραγγελία", "Größe", "öğle", "«CAFÉ»", "Ü»"):
        assert M.restored_runs(clean, M.ENCODINGS) is None, clean


def test_other_scripts():
    for w in ("שלום", "של", "مرحبا", "नमस्ते", "日本語", "한국어", "ไทย", "😀", "Երեվան", "Zürich–日本"):
        for other in ("cp1252", "latin-1", "mac_roman"):
            for times in (1, 2):
                g = w
                for _ in range(times):
                    g = wrong(g, "utf-8", other)
                assert M.restored_runs(g, M.ENCODINGS) == w, (w, other, times)
    for clean in ("café…»", "É»", "дії", "Ö…", "ΤΌ", "שלום", "日本語", "😀"):
        assert M.restored_runs(clean, M.ENCODINGS) is None, clean


def test_found_and_restored(spark):
    rng = random.Random(4)
    rows, want, originals = [], set(), {}
    for i in range(1500):
        text = " ".join(rng.choices(WORDS, k=3)) + f" {i % 7}"
        if i % 10 == 0:
            true, other = WAYS[i // 10 % len(WAYS)]
            bad = wrong(text, true, other)
            if bad != text:
                want.add(f"m{i}")
                originals[bad] = text
            text = bad
        elif i % 333 == 1:
            text, _ = text[:2] + "�" + text[3:], want.add(f"m{i}")
        rows.append((f"m{i}", text, "k", i))
    rows += [("null", None, None, None), ("empty", "", "", 0), ("ascii", "plain text", "", 0), ("nfd", "Küche Crème", "", 0), ("ru", "Заказ № 1 на мая", "", 0), ("gr", "Παραγγελία για", "", 0)]
    df = table(spark, rows + rows[:5])
    got = {r.email_id for r in M.garbled_values(df, ["email_id"]).collect()}
    assert got == want
    back = {r.value: r.restored for r in M.restored_values(df.filter(F.col("email_id").isin(list(want)) | (F.col("n") % 10 > 0))).collect()}
    right = sum(back.get(b) == o for b, o in originals.items())
    assert right >= 0.97 * len(originals)


def test_ways(spark):
    """Only what was learned is undone, and every token says by which way it was told."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices(WORDS, k=3)) for _ in range(300)]
    texts += [wrong(t, "utf-8", "cp1252") for t in texts[:60]] + ["Gänseblümchen".encode().decode("cp1252"), "Xüx".encode().decode("cp850")]
    df = table(spark, [(str(i), t, "", 0) for i, t in enumerate(texts)])
    found, learned = M.learn(df, fallback=())
    ways = {r.token: (r.restored, r.way) for r in found.collect()}
    assert "utf-8>cp1252" in learned and not any("cp850" in h for h in learned)
    assert ways["KÃ¼che"] == ("Küche", "twin") and ways["GÃ¤nseblÃ¼mchen"] == ("Gänseblümchen", "learned")
    assert "X├╝x" not in ways
    assert {r.token: r.way for r in M.learn(df)[0].collect()}["X├╝x"] == "fallback"


def test_edges(spark):
    assert M.garbled_values(table(spark, []), ["email_id"]).count() == 0
    odd = [("a", "ü" * 20_000, "", 0), ("b", "\x85\x9f", "", 0), ("c", "Ã", "", 0), ("d", "日本語" * 1000, "", 0), (None, "KÃ¼che", "", 0)]
    assert {r.email_id for r in M.garbled_values(table(spark, odd), ["email_id"]).collect()} == {"b", None}
