"""Prominence and width of trace peaks against their definition, over tile edges."""

import random

import pytest
from strandframe.operators import traces


def definition(x, least, width):
    out, n, i = [], len(x), 1
    while i < n - 1:
        j = i
        while j + 1 < n and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < n and x[j + 1] < x[i]:
            middle, v = (i + j) // 2, x[i]
            a, b = middle, middle
            while a >= 0 and x[a] <= v:
                a -= 1
            while b < n and x[b] <= v:
                b += 1
            prominence = v - max(min(x[a + 1 : middle + 1]), min(x[middle:b]))
            if prominence >= least:
                line, p, q = v - prominence / 2, middle, middle
                while x[p] > line:
                    p -= 1
                while x[q] > line:
                    q += 1
                wide = (q - (line - x[q]) / (x[q - 1] - x[q])) - (p + (line - x[p]) / (x[p + 1] - x[p]))
                if wide >= width:
                    out.append((middle, v, prominence, wide))
        i = j + 1
    return out


def series(seed, n, kind):
    rng, level, out = random.Random(seed), 50.0, []
    for i in range(n):
        level = {"walk": level + rng.choice([-2, -1, 0, 1, 2]), "ramp": i + rng.choice([0, 0, 3]), "noise": rng.randrange(6), "fall": n - i + rng.choice([0, 2])}[kind]
        out.append(float(max(level, 0)))
    return out


@pytest.mark.parametrize(("tile", "least", "width"), [(4, 2.0, 0.0), (16, 3.0, 3.0), (1024, 2.0, 1.5)])
def test_prominent_peaks(spark, monkeypatch, tile, least, width):
    monkeypatch.setattr(traces, "TILE", tile)
    all_series = {k: series(i, 300, k) for i, k in enumerate(("walk", "ramp", "noise", "fall"))} | {"flat": [1.0] * 9, "one": [5.0], "top": [0.0, 4.0, 4.0, 4.0, 4.0, 0.0]}
    rows = [(k, 3 * i + 5, v) for k, x in all_series.items() for i, v in enumerate(x)] + [("walk", 4, None)]
    got = traces.prominent_peaks(spark.createDataFrame(rows, "sample string, scan long, intensity double"), prominence=least, width=width, min_snr=0).collect()
    want = {(k, 3 * i + 5): (v, p, w) for k, x in all_series.items() for i, v, p, w in definition(x, least, width)}
    assert {(r.sample, r.scan) for r in got} == set(want) and len(got) == len(want) > 20
    for r in got:
        v, p, w = want[r.sample, r.scan]
        assert r.intensity == v and abs(r.prominence - p) < 1e-9 and abs(r.width - w) < 1e-9
