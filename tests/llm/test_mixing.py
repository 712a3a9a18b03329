import itertools
import random

import numpy as np
import pytest

from veilcell.llm import mixing as mx

from .helpers import documents, odd_rows


def size(text):
    import re
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def wanted_targets(sizes):
    """By resharing the excess in rounds."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check(spark, ws, rows):
    got = mx.mixed(ws, documents(spark, rows)).drop("row").collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    targets = wanted_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert sorted((repr(r.doc_id), r.size) for r in got) == sorted((repr(d), size(t)) for d, t, _ in rows)
    return targets, taken, sorted((repr(r.doc_id), r.size, r.taken) for r in got)


def test_targets_and_sums(spark, ws):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 200)), rng.choice(["a", "a", "a", "b", "c", "Z", None, "é"])) for i in range(900)]
    targets, taken, first = check(spark, ws, rows)
    for s in targets:
        assert abs(taken[s] - targets[s]) <= 1
    assert check(spark, ws, rng.sample(rows, len(rows)))[2] == first


def test_odd_rows(spark, ws):
    check(spark, ws, odd_rows())
    check(spark, ws, [])
    check(spark, ws, [(1, None, None), (2, " ", "a")])
    check(spark, ws, [(1, "a b", "s")] * 7)


def test_fit_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        lengths = np.array(rng.sample(range(1, 40), rng.randint(1, 4)))
        counts = np.array([rng.randint(0, 3) for _ in lengths])
        budget = rng.randint(0, int((lengths * counts).sum()) + 3)
        take = mx.fit(lengths, counts, budget)
        assert ((take >= 0) & (take <= counts)).all()
        best = min(abs(int(np.dot(c, lengths)) - budget) for c in itertools.product(*[range(n + 1) for n in counts]))
        assert abs(int(take @ lengths) - budget) == best


def test_fit_spreads_evenly():
    lengths, counts = np.arange(1, 2001), np.full(2000, 50)
    take = mx.fit(lengths, counts, 40_000_000, reserve=1 << 16)
    assert int(take @ lengths) == 40_000_000
    assert 15 <= take[200:].mean() <= 25
