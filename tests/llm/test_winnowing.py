import random

from veilcell.llm import winnowing as wn

from .helpers import documents, odd_rows, words


def judged(text, items):
    own, hit, found = words(text), set(), set()
    for item, t in items:
        theirs = words(t)
        n = min(13, len(theirs))
        windows = {tuple(theirs[i:i + n]) for i in range(len(theirs) - n + 1)} if n else set()
        for i in range(len(own) - n + 1):
            if tuple(own[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own)


def check(spark, ws, rows, items):
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = wn.contamination(ws, documents(spark, rows), benchmark).collect()
    want = [(d, *judged(t, [i for i in items if i[0] is not None])) for d, t, _ in rows]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=repr) == sorted(want, key=repr)
    return got


def test_equals_brute_force(spark, ws):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 7, 12, 13, 14, 30])))) for i in range(25)]
    items += [(100, "a " * 20), (100, "b c d e f g h i j k l m n"), (101, ""), (102, None), (None, "w1 w2"), (103, "Only, HERE: Über!")]
    rows = []
    for d in range(60):
        text = rng.choices(vocabulary, k=rng.randint(0, 80))
        own = words(rng.choice(items)[1])
        cut = rng.randint(0, max(0, len(own) - 13))
        text[5:5] = own[cut:cut + rng.choice([5, 12, 13, 20])]
        rows.append((d, "; ".join(text), "s"))
    rows += [(200, "a " * 19 + "x", "s"), (201, "only here über", "s"), *odd_rows()]
    assert any(r.contaminated for r in check(spark, ws, rows, items))


def test_without_items_or_documents(spark, ws):
    check(spark, ws, odd_rows(), [])
    check(spark, ws, odd_rows(), [(1, "...")])
    check(spark, ws, [], [(1, "a b c")])


def test_shared_spans_share_a_fingerprint():
    import numpy as np
    import pyarrow as pa

    from veilcell.llm.texts import word_hashes

    rng = random.Random(5)
    for length in (1, 4, 5, 6, 13):
        for _ in range(50):
            span = [f"s{rng.randint(0, 5)}" for _ in range(length)]
            kept = []
            for _ in range(2):
                text = [f"r{rng.random()}" for _ in range(rng.randint(0, 9))] + span + [f"r{rng.random()}" for _ in range(rng.randint(0, 9))]
                kept.append(wn._kept_hashes(*word_hashes(pa.array([" ".join(text)])), length)[1])
            assert len(np.intersect1d(*kept))
