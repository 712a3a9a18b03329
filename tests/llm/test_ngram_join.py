import random

import numpy as np

from veilcell.llm import ngram_join as nj

from .helpers import documents, odd_rows, words


def expected(rows):
    """(set, links) per text by brute force."""
    sets = {}
    for d, t, _ in rows:
        w = words(t)
        key = frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        sets.setdefault(key, []).append(d)
    keys = list(sets)
    near = {k: [o for o in keys if o is not k and k and o and 10 * len(k & o) >= 8 * len(k | o)] for k in keys}
    seen, parts = {}, {}
    for k in keys:
        if k not in seen:
            todo, part = [k], []
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen[x] = k
                    part.append(x)
                    todo += near[x]
            ids = [d for x in part for d in sets[x] if d is not None]
            parts[k] = min(ids, default=None)
    out = []
    for k in keys:
        ids = [d for d in sets[k] if d is not None]
        out += [(d, parts[seen[k]], min(ids, default=None), len(sets[k]), len(near[k]), len(k)) for d in sets[k]]
    return sorted(out, key=repr)


def check(spark, ws, rows):
    """Equal to brute force; of the links 1 in 1000 may be missing, none may be wrong."""
    got = sorted(map(tuple, nj.NgramJoin(ws, documents(spark, rows)).documents.drop("text_hash").collect()), key=repr)
    want = sorted(expected(rows), key=repr)
    without = lambda rows: sorted(((*r[:4], r[5]) for r in rows), key=repr)
    assert without(got) == without(want)
    links = lambda rows: sorted(((repr(r[0]), repr(r[2]), r[4]) for r in rows))
    assert all(a[:2] == b[:2] and a[2] <= b[2] for a, b in zip(links(got), links(want), strict=True))
    assert sum(r[4] for r in got) >= 0.999 * sum(r[4] for r in want)


def test_near_copies_and_odd_rows(spark, ws):
    rng = random.Random(1)
    rows = odd_rows()
    for g in range(30):
        base = [f"v{rng.randint(0, 400)}" for _ in range(rng.randint(6, 120))]
        for _ in range(rng.randint(1, 5)):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = f"x{rng.random()}"
            rows.append((1000 + len(rows), " ".join(text), "s"))
    check(spark, ws, rows)


def test_one_large_group_in_many_blocks(spark, ws, monkeypatch):
    """More near copies than a block holds, and more sharers of a passage than a leaf."""
    monkeypatch.setattr(nj, "BLOCK", 70)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for d in range(300):
        text = list(base)
        text[rng.randrange(100)] = f"x{d}"
        rows.append((d, " ".join(text), "s"))
    for d in range(300, 500):
        rows.append((d, "the same long first line of many texts here " + " ".join(f"u{d}-{i}" for i in range(40)), "s"))
    check(spark, ws, rows)


def test_rows_without_ids(spark, ws):
    """600 texts under no id, 40 more under one repeated id: each is told by its text."""
    rng = random.Random(3)
    rows = [(None if d < 600 else 7, " ".join(f"n{d // 2}-{i}" if i != rng.randrange(60) or d % 2 else "x" for i in range(60)), "s")
            for d in range(640)]
    check(spark, ws, rows + rows[:3])


def test_nodes_are_split_until_they_are_small(spark, ws, monkeypatch):
    """Texts that share half of their words meet in deep nodes; coordinates of several runs are used."""
    monkeypatch.setattr(nj, "LEAF", 3)
    rng = random.Random(4)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for d in range(150):
        text = common + [f"o{d // 2}-{i}" for i in range(60)]
        text[rng.randrange(60, 120)] = f"x{d}"
        rows.append((d, " ".join(text), "s"))
    got = nj.NgramJoin(ws, documents(spark, rows), recall=0.999, levels=1).documents
    want = {r[0]: r[4] for r in expected(rows)}
    assert sum(r.n_links for r in got.collect()) >= 0.99 * sum(want.values()) > 0


def test_empty_table(spark, ws):
    check(spark, ws, [])
    check(spark, ws, [(1, None, None), (2, "", None)])


def test_runs_reach_the_recall():
    assert nj.loss(0.8, 1) < 0.2
    for levels in (1, 2, 4, 8):
        assert nj.loss(0.8, levels) ** nj.runs_for(0.8, levels, 0.99) <= 0.01
        assert nj.loss(0.95, levels) < nj.loss(0.8, levels)
    rng, lost = np.random.default_rng(0), 0
    for _ in range(20_000):  # the branching process itself
        alive = 1
        for _ in range(3):
            picks = sum(1 + (rng.random() < nj.second_share(0.8)) for _ in range(alive))
            alive = rng.binomial(picks, 0.8)
        lost += alive == 0
    assert abs(lost / 20_000 - nj.loss(0.8, 3)) < 0.015


def test_common_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in (0, 1, 30, 50, 50)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = nj.common_counts(sets, sets[:], width=7)
    assert got.tolist() == want
    own = nj.common_counts(sets, width=7)
    assert all(own[i, j] == want[i][j] for i in range(5) for j in range(5) if i != j)
