import random
from collections import Counter

import pytest

from formflow.llm import packing as P
from formflow.llm.words import TOKENIZER_FILE, Cache, token_counter


def contents(runs):
    return [(r.capacity, Counter(dict(r.pieces)), r.count) for r in runs]


def one_by_one(sizes, capacity):
    """Best fit decreasing, piece by piece."""
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in bins if b[0] >= s]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:
            b = [capacity]
            bins.append(b)
        b[0] -= s
        b.append(s)
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_same_windows_as_piece_by_piece(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 65) for _ in range(rng.randrange(1, 400))]
    runs = P.best_fit(Counter(sizes), [64])
    got = sorted(tuple(sorted(Counter(dict(r.pieces)).elements())) for r in runs for _ in range(r.count))
    assert sorted(x for b in got for x in b) == sorted(sizes)
    assert all(sum(b) <= 64 for b in got)
    assert len(got) == len(one_by_one(sizes, 64))


def test_several_capacities_downsize():
    rng = random.Random(5)
    sizes = Counter(rng.randrange(1, 200) for _ in range(3000))
    runs = P.best_fit(sizes, [64, 128, 256])
    total = sum(s * n for s, n in sizes.items())
    assert sum(r.used() * r.count for r in runs) == total
    for r in runs:
        assert r.used() <= r.capacity and not any(r.used() <= c < r.capacity for c in (64, 128))
    assert sum(r.capacity * r.count for r in runs) <= 1.02 * total
    assert P.best_fit({}, [64]) == []


def layout(df):
    rows = df.collect()
    windows = {}
    for r in rows:
        windows.setdefault((r.window_id, r.capacity), []).append(r)
    return rows, windows


def test_every_token_is_placed_once(spark):
    rng = random.Random(1)
    sizes = {i: rng.choice([0, 1, 7, 512, 513, 1024, 40, 40, 40, rng.randrange(1, 3000)]) for i in range(2000)}
    tokens = spark.createDataFrame(list(sizes.items()), "doc_id bigint, tokens bigint").repartition(7)
    for capacities in ([512], [512, 1024]):
        rows, windows = layout(P.pack(tokens, capacities))
        by_doc = {}
        for r in rows:
            by_doc.setdefault(r.doc_id, []).append(r)
        for i, n in sizes.items():
            pieces = sorted(by_doc.get(i, []), key=lambda r: r.piece_no)
            assert sum(r.tokens for r in pieces) == n
            assert [r.doc_start for r in pieces] == [k * max(capacities) for k in range(len(pieces))]
            assert len(pieces) == -(-n // max(capacities))
        for (_, capacity), held in windows.items():
            at = 0
            for r in sorted(held, key=lambda r: r.window_offset):
                assert r.window_offset == at
                at += r.tokens
            assert at <= capacity
        assert len({w for w, _ in windows}) == len(windows)
        used = sum(c for _, c in windows)
        assert used <= 1.12 * sum(sizes.values())  # pieces of 513 and of 512 don't share a window


def test_hot_size_and_edges(spark):
    hot = spark.createDataFrame([(i, 100) for i in range(3000)] + [(5, 100)] * 3, "doc_id bigint, tokens bigint")
    rows, windows = layout(P.pack(hot, [512]))
    assert len(rows) == 3003 and len(windows) == -(-3003 // 5)
    assert P.pack(hot.limit(0), [512]).count() == 0
    assert P.pack(spark.createDataFrame([(1, 0)], "doc_id bigint, tokens bigint"), [512]).count() == 0
    one = P.pack(spark.createDataFrame([("x", 1024)], "doc_id string, tokens bigint"), [512]).collect()
    assert sorted((r.piece_no, r.tokens) for r in one) == [(0, 512), (1, 512)]
    assert len({r.window_id for r in one}) == 2


def test_counts_equal_the_tokenizer(spark):
    import base64

    import tiktoken

    from formflow.llm.words import TOKENIZER_PATTERN

    with open(TOKENIZER_FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("t", pat_str=TOKENIZER_PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", " ", "\n\n  a", "don't  stop\t\n (12.5) x y  ", "ä ö　ü", "a" * 5000, " \r\n" * 50 + "end", "<|endoftext|>", "日本語 の テキスト", None]
    texts += [" ".join(random.Random(i).choices(["foo", "'s", "\n", "12", "—", "​", "é", "  "], k=200)) for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.tokens for r in P.count_tokens(df).collect()}
    assert got == {i: len(whole.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def test_cache_never_changes_results():
    c = Cache(len, limit=3)
    assert [c[x] for x in ("a", "bb", "ccc", "dddd", "a", "bb")] == [1, 2, 3, 4, 1, 2] and len(c) <= 3
    assert token_counter() ("") == 0
