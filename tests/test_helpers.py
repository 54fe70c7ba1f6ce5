import numpy as np

from fenland.functions.helpers import row_envelope, thin_block, tile_components


def flood(cells, eight):
    left, out = set(cells), {}
    while left:
        first = min(left)
        stack, seen = [first], {first}
        while stack:
            r, c = stack.pop()
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    n = (r + dr, c + dc)
                    if n in left and n not in seen and (eight or not (dr and dc)):
                        seen.add(n)
                        stack.append(n)
        left -= seen
        out |= {x: first for x in seen}
    return out


def test_components_equal_flood_fill():
    rng = np.random.default_rng(1)
    for _ in range(40):
        m = rng.random((9, 11)) < rng.choice([0.3, 0.5, 0.7])
        r, c = np.nonzero(m)
        if not len(r):
            continue
        p = rng.permutation(len(r))
        r, c = r[p] + 5, c[p] + 7
        for eight in (True, False):
            first = tile_components(r, c, eight)
            want = flood(list(zip(r.tolist(), c.tolist())), eight)
            assert {(a, b): (r[i], c[i]) for a, b, i in zip(r.tolist(), c.tolist(), first)} == want


def test_envelope_equals_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(100):
        n = rng.integers(1, 30)
        g = np.where(rng.random(n) < 0.4, np.inf, rng.integers(0, 200, n).astype(float))
        c = np.arange(n)
        want = np.min(g[None, :] + (c[:, None] - c[None, :]) ** 2.0, axis=1)
        assert np.array_equal(row_envelope(c, g), want)


def test_thinning_settles_and_keeps_components():
    m = np.zeros((20, 30), bool)
    m[5:10, 2:28] = True
    thin = thin_block(m, 60)
    assert (thin_block(thin, 2) == thin).all() and 0 < thin.sum() < 40


def test_widest_equals_all_pairs():
    from fenland.functions.helpers import hull, widest

    rng = np.random.default_rng(11)
    for n in (1, 2, 3, 5, 40, 300):
        for box in (1, 2, 6, 50):
            p = rng.integers(0, box, (n, 2))
            want = max(int((a - b) @ (a - b)) for a in p for b in p)
            assert widest(hull(p)) == want
            parts = np.concatenate([hull(p[p[:, 0] // 7 == k]) for k in np.unique(p[:, 0] // 7)])
            assert widest(hull(parts)) == want
