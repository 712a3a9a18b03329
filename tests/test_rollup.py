import numpy as np
import pyarrow as pa

from tests import fixtures as fx
from veilcell.operators import rollup
from veilcell.operators.cells import Forest
from veilcell.operators.encoding import encode_table


def fine_cells(rng, k, bits, roots, n):
    tops, places = rng.integers(0, roots, n), [rng.integers(0, 1 << bits, n) for _ in range(k)]
    code = sum(((f >> b) & 1) << (b * k + k - 1 - d) for d, f in enumerate(places) for b in range(bits))
    _, first = np.unique(np.stack([tops, code]), axis=1, return_index=True)
    columns = {"combo": np.zeros(n, np.int32), **{f"t{d}": tops for d in range(1, k + 1)}, **{f"f{d}": f for d, f in enumerate(places, 1)},
               "rows": rng.integers(1, 4, n), "n0": rng.integers(0, 4, n), "s0": rng.integers(0, 99, n), "code": code}
    for d in range(1, k + 1):
        columns |= {f"mn{d}": places[d - 1] / 4, f"mx{d}": places[d - 1] / 4 + rng.integers(0, 2, n)}
    return pa.table({c: v[first] for c, v in columns.items()})


def test_levels_are_those_of_counting_each_cell(monkeypatch):
    rng = np.random.default_rng(5)
    for k, levels, extra, size in ((1, 6, 0, 7), (2, 4, 1, 64), (3, 2, 1, 10_000)):
        monkeypatch.setattr(rollup, "CHUNK", size)
        bits = levels + extra
        cells = fine_cells(rng, k, bits, 9, 700)
        got = {}
        for batch in rollup.rolled_up(k, 10, 1, levels, extra, 3)(iter(cells.to_batches(50))):
            for r in batch.to_pylist():
                key = (r["t1"], r["level"] - 10, *[r[f"p{d}"] for d in range(1, k + 1)])
                assert key not in got
                got[key] = r
        want, rows = {}, cells.to_pylist()
        for j in range(1, levels + 1):
            for r in rows:
                want.setdefault((r["t1"], j, *[r[f"f{d}"] >> bits - j for d in range(1, k + 1)]), []).append(r)

        def splits(key):
            held = want[key]
            return sum(r["n0"] for r in held) >= 3 and any(min(r[f"mn{d}"] for r in held) < max(r[f"mx{d}"] for r in held) for d in range(1, k + 1))

        expected = {key for key in want if all(splits((key[0], j, *[p >> key[1] - j for p in key[2:]])) for j in range(1, key[1]))}
        assert set(got) == expected
        for key in expected:
            held, r = want[key], got[key]
            assert [r[c] for c in ("rows", "n0", "s0")] == [sum(h[c] for h in held) for c in ("rows", "n0", "s0")]
            for d in range(1, k + 1):
                assert (r[f"mn{d}"], r[f"mx{d}"]) == (min(h[f"mn{d}"] for h in held), max(h[f"mx{d}"] for h in held))
                for b in (0, 1) if extra else ():
                    side = [h for h in held if h[f"f{d}"] >> bits - key[1] - 1 & 1 == b]
                    assert (r[f"h{d}_{b}_n0"], r[f"h{d}_{b}_s0"]) == (sum(h["n0"] for h in side), sum(h["s0"] for h in side))


def test_cells_below_weak_ones_are_not_carried(spark, ws):
    df = spark.range(64).selectExpr("cast(id * id % 64 + id / 64.0 as double) x", "cast(id * 37 % 64 as double) y")
    forest = Forest(ws, encode_table(ws, df, ["x", "y"], [], fx.NOISELESS), fx.NOISELESS)
    stats = forest._batch_stats(2, [(0, 1)], forest._exploded_rows([(0, 1)]), 0, 7)
    weak = {(r.level, r.c1, r.c2) for r in stats.where("n0 < 3").collect()}
    assert not [r for r in stats.where("level > 1").collect() if (r.level - 1, r.p1 >> 1, r.p2 >> 1) in {(w[0], w[1], w[2]) for w in weak}]
    assert stats.count() < 64 * 5


def test_roots_of_one_hash_and_levels_below_the_deepest(monkeypatch):
    rng = np.random.default_rng(7)
    cells = fine_cells(rng, 2, 5, 6, 500)
    mixed = cells.append_column("root", pa.array(np.zeros(len(cells), np.int64))).take(rng.permutation(len(cells)))

    def found(table, deepest):
        batches = rollup.rolled_up(2, 10, 1, 4, 1, 3, deepest)(iter(table.to_batches(50)))
        return sorted(tuple(sorted(r.items())) for b in batches for r in b.to_pylist())

    assert found(mixed, None) == found(cells, None)
    assert found(mixed, [12]) == [r for r in found(cells, None) if dict(r)["level"] <= 13]


def test_rows_below_small_roots_are_counted_at_once(spark, ws, monkeypatch):
    names, cut = [], ws.cut
    monkeypatch.setattr(ws, "cut", lambda df, name: (names.append(name), cut(df, name))[1])
    df = spark.range(480).selectExpr("cast(id % 2 * 4090 + id * 7 % 13 as double) x", "cast(id * 5 % 2 * 4090 - id % 11 / 3 as double) y")
    data, found = encode_table(ws, df, ["x", "y"], [], fx.NOISELESS), []
    for small in (1 << 18, 100, 0):
        monkeypatch.setattr("veilcell.operators.cells.SMALL_ROWS", small)
        names.clear()
        nodes = Forest(ws, data, fx.NOISELESS).dimension(2, [(0, 1)]).nodes
        if small > 100:
            assert names.count("stats2") == 2 and "rows2" not in names
        found.append(sorted(map(tuple, nodes.select(sorted(set(nodes.columns))).collect())))
    assert found[0] == found[1] == found[2] and nodes.where("level > 9").count()
