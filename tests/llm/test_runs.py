import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from veilcell.llm import runs as rn

from .helpers import documents, odd_rows


def plain(words, least=12):
    """Runs by their definition: every maximal stretch of every period, with its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j - i + q), q)  # smaller periods come first
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


CASES = [[], [1], [1] * 11, [1] * 12, [1] * 40, [1, 2] * 6, [1, 2] * 6 + [1], [0] + [1, 2, 3] * 9 + [4], [1, 1, 2] * 30, fibonacci(300),
         list(range(20)) * 2, list(range(20)) * 2 + [0, 1], ([1] * 12 + [2]) * 5, [1, 2] * 8 + [1, 3] * 8, list(range(6)) * 2]


@pytest.mark.parametrize("least", [2, 7, 12])
def test_runs_equal_their_definition(least):
    rng = random.Random(5)
    cases = CASES + [[rng.randrange(k) for _ in range(rng.randrange(80))] for k in (1, 2, 2, 3, 4) for _ in range(60)]
    for i in range(60):
        block = [rng.randrange(3) for _ in range(rng.randrange(1, 12))]
        cases.append([rng.randrange(3) for _ in range(5)] + block * rng.randrange(1, 9) + [rng.randrange(3)] + block * 3)
    for words in cases:
        assert rn.word_runs(np.array(words, np.int64), least) == plain(words, least)


def test_texts_of_one_call_do_not_meet():
    texts = [b"a b c d e f " * 2, b"a b c d e f " * 2, b"", b"x " * 11, b"x " * 12]
    assert [r for _, r in rn.runs_of_texts(texts)] == [[(0, 12, 6)], [(0, 12, 6)], [], [], [(0, 12, 1)]]


def test_common_and_long_repetitions_are_fast():
    words = np.array([1] * 150_000 + fibonacci(100_000) + [7, 8, 9, 7, 8, 9, 4] * 20_000, np.int64)
    found = rn.word_runs(words)
    assert (0, 150_000, 1) in found and max(r[1] for r in found if r[2] == 7) >= 139_999


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain(words) if n < 5000 else rn.word_runs(np.unique(words, return_inverse=True)[1])
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_equals_the_definition(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(r.doc_id, r.text, r.source) for r in source if len(r.text) < 6000]
    ids = [i for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += [(i, " ".join(f"w{j}é" for j in range(j0)), "s") for j0, i in enumerate(ids[:60])]
    rows += odd_rows() + [(9000, "la " * 12, "a"), (9001, "\n la\tla\x0bla " * 30 + "\x85 la\x1cla", "a"), (ids[70], None, "a"), (ids[71], " ", "a")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = rn.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr(expected(d, t)) for d, t, _ in rows)
    assert rn.periodic_runs(documents(spark, [])).count() == 0


def test_collapsed_texts_keep_one_period(spark):
    got = rn.periodic_runs(documents(spark, [(1, "start " + "no more " * 20 + "end", "s")])).first()
    assert (got.n_words, [tuple(r) for r in got.runs], got.collapsed) == (42, [(1, 40, 2)], "start no more end")
