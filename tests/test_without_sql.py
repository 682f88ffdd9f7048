"""The registered queries without SQL, each against its definition in numpy over the smallest tables."""

import math

import duckdb
import numpy as np
import pytest

from tidelane.plans import catalog

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def spikes(duck):
    return duck.sql("SELECT user_id AS unit, epoch_us(ts) AS t, event_type AS ch, value AS v, event_id AS id FROM events").df()


@pytest.fixture(scope="module")
def grid(spikes):
    """channel names, samples [channel, hour]."""
    h = spikes.t // HOUR - spikes.t.min() // (24 * HOUR) * 24
    names = sorted(spikes.ch.unique())
    x = np.zeros((len(names), int(h.max()) + 1))
    for (c, s), v in spikes.groupby([spikes.ch, h]).v.mean().items():
        x[names.index(c), s] = v
    return names, x


@pytest.fixture(scope="module")
def vectors(duck):
    e = duck.sql("SELECT vec_id, label, embedding FROM embeddings ORDER BY vec_id").df()
    return e.vec_id.to_numpy(), e.label.to_numpy(), np.array(e.embedding.tolist(), dtype=float)


def run(spark, name):
    return catalog.QUERIES[name](spark, SF).collect()


def axes(x, k):
    _, u = np.linalg.eigh(np.cov(x.T, bias=True))
    u = u[:, ::-1][:, :k].T
    return u * np.sign(u[np.arange(k), np.abs(u).argmax(axis=1)])[:, None]


def distances(own, rows):
    """Squared distances of rows to own's distribution, features scaled first."""
    scale = own.std(axis=0, ddof=1)
    z = (own - own.mean(0)) / scale
    y = (rows - own.mean(0)) / scale
    return np.einsum("ij,jk,ik->i", y, np.linalg.inv(np.cov(z.T) + 1e-6 * np.eye(z.shape[1])), y)


def test_o_srt_02_principal_axes(spark, vectors):
    ids, _, x = vectors
    want = x @ axes(x, 3).T
    got = {r.vec_id: r.pc for r in run(spark, "o_srt_02_principal_axes")}
    assert np.allclose([got[i] for i in ids], want, atol=1e-6)


def test_o_wv_04_isolation(spark, vectors):
    _, unit, x = vectors
    pc = x @ axes(x, 6).T
    for r in run(spark, "o_wv_04_isolation"):
        own, other = pc[unit == r.unit], pc[unit != r.unit]
        d = np.sort(distances(own, other))
        assert r.n == len(own)
        assert r.isolation is None if len(d) < len(own) else math.isclose(r.isolation, d[len(own) - 1], rel_tol=1e-6)
        h = d / 2
        tail = np.exp(-h) * (1 + h + h * h / 2)  # six degrees of freedom
        assert math.isclose(r.l_ratio, tail.sum() / len(own), rel_tol=1e-6)


def test_o_cl_05_outlier_split(spark, vectors):
    ids, unit, x = vectors
    pc = x @ axes(x, 6).T
    want, number = {}, 0
    for u in np.unique(unit):
        at = np.flatnonzero(unit == u)
        if len(at) < 10:
            want |= {ids[i]: (False, None) for i in at}
            continue
        d = np.sqrt(distances(pc[at], pc[at]))
        out = d > np.quantile(d, 0.95)
        clean = x[at[~out]]
        template, amp = clean.mean(0), np.ptp(clean, axis=1)
        tol = max(3 * np.median(np.abs(amp - np.median(amp))), 1e-6)
        w = x[at] - x[at].mean(1, keepdims=True)
        t = template - template.mean()
        cosine = w @ t / (np.linalg.norm(w, axis=1) * np.linalg.norm(t))
        out &= ~((cosine >= 0.9) & (np.abs(np.ptp(x[at], axis=1) - np.median(amp)) <= tol))
        want |= {ids[i]: (False, number) for i in at[~out]}
        number += 1
        enough = out.sum() >= 10
        want |= {ids[i]: (True, number if enough else None) for i in at[out]}
        number += enough
    got = {r.vec_id: (r.outlier, r.new_unit) for r in run(spark, "o_cl_05_outlier_split")}
    assert got == want and any(v[0] for v in want.values())


def test_o_srt_11_seeds(spark, vectors):
    ids, _, x = vectors
    pc = x @ axes(x, 6).T
    got = run(spark, "o_srt_11_seeds")
    assert [r.place for r in got] == list(range(8)) and len({r.vec_id for r in got}) == 8
    # with as many tries as points the best of all points is taken: each centre explains at least as much as a random choice would
    explained = lambda centres: np.maximum((2 * pc @ centres.T - (centres**2).sum(1)).max(1), 0).sum()
    chosen = explained(pc[[int(np.flatnonzero(ids == r.vec_id)[0]) for r in got]])
    rng = np.random.default_rng(0)
    assert chosen > max(explained(pc[rng.choice(len(pc), 8, replace=False)]) for _ in range(20))


def test_o_sig_18_whitened(spark, grid):
    names, x = grid
    cov = x @ x.T / x.shape[1]
    u, d, _ = np.linalg.svd(cov)
    want = u @ np.diag((d + 1e-6) ** -0.5) @ u.T @ x
    got = {(r.ch, r.s): r.v for r in run(spark, "o_sig_18_whitened")}
    assert len(got) == x.size and all(abs(got[n, s] - want[i, s]) < 1e-6 for i, n in enumerate(names) for s in range(x.shape[1]))


def test_o_srt_08_aligned_shifts(spark, spikes):
    """The iterative alignment of whole fingerprints, then of blocks, over arrays."""
    s = spikes[spikes.v > 0]
    day = (s.t // (24 * HOUR)).to_numpy()
    days = np.unique(day)
    f = np.zeros((len(days), 16, 20))
    a = np.clip(np.log10(s.v.to_numpy()), 0, 2) / 2
    np.add.at(f, (np.searchsorted(days, day), (s.unit.to_numpy() % 40 * 10 // 25).astype(int), np.minimum((a * 20).astype(int), 19)), 1)
    f = np.log2(1 + f)
    g = f - f.mean(1, keepdims=True)
    base, total = g[min(300, len(g) // 2)], np.zeros(len(g))
    for _ in range(9):
        score = np.stack([np.round((np.roll(g, d, 1) * base).mean((1, 2)), 12) for d in range(-15, 16)])
        move = score.argmax(0) - 15
        g = np.stack([np.roll(x, d, 0) for x, d in zip(g, move)])
        total += move
        base = g.mean(0)
    starts = np.round(np.linspace(0, 16 - 5, 5)).astype(int)
    dc = np.stack([np.stack([np.round((np.roll(g[:, b : b + 5], d, 1) * base[b : b + 5]).mean((1, 2)), 12) for b in starts], 1) for d in range(-5, 6)])
    k = np.exp(-0.5 * (np.arange(-2, 3) / 0.5) ** 2)
    k /= k.sum()
    for axis in range(3):
        wide = np.pad(dc, [(2, 2) if i == axis else (0, 0) for i in range(3)], mode="symmetric")
        dc = sum(w * np.take(wide, np.arange(i, i + dc.shape[axis]), axis) for i, w in enumerate(k))
    tenths = np.linspace(-5, 5, 101)
    fine = np.exp(-((np.arange(-5, 6)[:, None] - tenths) ** 2) / 2)
    got = {(r.batch, r.block): r["shift"] for r in run(spark, "o_srt_08_aligned_shifts")}
    assert len(got) == len(days) * 5
    for j in range(5):
        want = total + tenths[np.round(fine.T @ dc[:, :, j], 10).argmax(0)]
        assert np.allclose([got[d, j] for d in days], want, atol=0.11)


def test_o_wv_02_waveform_metrics(spark, spikes, grid):
    names, x = grid
    hour = (spikes.t // HOUR - spikes.t.min() // (24 * HOUR) * 24).to_numpy()
    for r in run(spark, "o_wv_02_waveform_metrics"):
        means = np.full((len(names), 11), np.nan)
        for lag in range(-4, 7):
            at = hour[spikes.unit == r.unit] + lag
            means[:, lag + 4] = x[:, at[(at >= 0) & (at < x.shape[1])]].mean(1)
        y = means[max(range(len(names)), key=lambda c: (round(np.ptp(means[c]), 9), [-ord(q) for q in names[c]]))]
        z = (y - y.mean()) / y.std()
        # band-limited interpolation as a sum of cosines and sines of the 11 samples
        at = np.arange(88) / 8
        w = sum(np.real(c * np.exp(2j * np.pi * k * at / 11)) * (1 if k == 0 else 2) for k, c in enumerate(np.fft.rfft(z) / 11))
        polarity = 1.0 if abs(w.min()) >= w.max() else -1.0
        w *= polarity
        low = int(w.argmin())
        assert r.polarity == polarity and math.isclose(r.trough_to_peak, w[low:].argmax() / 8, abs_tol=1e-9)
        b, c = w[low:].max(), w[: low + 1].max()
        assert math.isclose(r.ab_ratio, (b - c) / (b + c), rel_tol=1e-5, abs_tol=1e-6) and math.isclose(r.peak_to_trough, b / -w[low], rel_tol=1e-6)


def test_o_evt_05_analog_pulses(spark, spikes):
    want = set()
    for u, own in spikes.sort_values("t").groupby("unit"):
        v = own.v.to_numpy() - int(own.v.median())
        v = v - min(v.min(), 0)
        up = v > (v.min() + v.max()) / 2
        if 1 - (v[up].var() * up.sum() + v[~up].var() * (~up).sum()) / len(v) / v.var() < 0.3:
            continue
        cut, mid, on = 1.5 * v.std(), np.median(v), v > 1.5 * v.std()
        rise = [i for i in range(len(on) - 1) if on[i + 1] and not on[i]]
        fall = [i for i in range(len(on) - 1) if not on[i + 1] and on[i]]
        t = own.t.to_numpy()
        for i in rise:
            stop = next((j for j in fall if j > i), None)
            if stop is not None and np.median(v[i : stop + 1]) >= 0.4 * (cut - mid):
                want.add((u, t[i], t[stop]))
    got = {(r.unit, r.start, r.stop) for r in run(spark, "o_evt_05_analog_pulses")}
    assert got and got == want


def test_o_st_03_dip(spark, grid):
    """The dip is the least distance to a unimodal distribution: checked by linear search over modes with hulls by brute force."""
    names, x = grid
    for r in run(spark, "o_st_03_dip"):
        v, first = np.unique(np.sort(x[names.index(r.ch)]), return_index=True)
        n = x.shape[1]
        assert r.n == n
        top, low = np.append(first[1:], n) / n, first / n

        def hull(at, height):
            """Greatest convex minorant of the points, at their places."""
            out = []
            for p in zip(at, height):
                while len(out) > 1 and (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) >= (p[1] - out[-2][1]) * (out[-1][0] - out[-2][0]):
                    out.pop()
                out.append(p)
            return np.interp(at, *zip(*out))

        best = min(max(max(top[: m + 1] - hull(v[: m + 1], low[: m + 1])), max((1 - low[m:]) - hull(-v[m:][::-1], 1 - top[m:][::-1])[::-1])) for m in range(len(v)))
        assert math.isclose(r.dip, max(best / 2, 0.5 / n), rel_tol=1e-9)


def test_o_st_04_best_channel(spark):
    scores = {r.ch: r.dip for r in run(spark, "o_st_03_dip")}
    [best] = run(spark, "o_st_04_best_channel")
    assert best.ch == min(scores, key=lambda c: (-scores[c], c)) and best.dip == scores[best.ch]


def test_o_st_12_nrem_episodes(spark):
    spans = sorted((r.start, r.stop, r.state) for r in run(spark, "o_st_07_index_to_intervals"))
    joined = []
    for a, b, s in spans:
        if s == "NREM" and b - a >= 2:
            if joined and a - joined[-1][1] <= 3:
                joined[-1][1] = b
            else:
                joined.append([a, b])
    want = []
    for a, b in joined:
        at = a
        for c, d in [(c, d) for c, d, s in spans if s == "REM" and c < b and d > a]:
            want.append((at, c))
            at = d
        want.append((at, b))
    got = sorted((r.start, r.stop) for r in run(spark, "o_st_12_nrem_episodes"))
    inside = [(a, b) for a, b in got]
    assert all(b - a >= 2 for a, b in inside) and all(not (s == "REM" and c < b and d > a and d > c) for a, b in inside for c, d, s in spans)
    assert {w for w in want if w[1] - w[0] >= 2} == set(got)


def test_o_srt_14_matching_pursuit(spark, spikes, grid):
    """The first detection of all is the greatest gain of any template anywhere."""
    names, x = grid
    x = x[[names.index(c) for c in ("click", "error", "purchase", "view")]]
    hour = (spikes.t // HOUR - spikes.t.min() // (24 * HOUR) * 24).to_numpy()
    best = (0.0, None)
    for u in np.unique(spikes.unit):
        w = np.zeros((4, 11))
        for lag in range(-4, 7):
            at = hour[spikes.unit == u] + lag
            w[:, lag + 4] = x[:, at[(at >= 0) & (at < x.shape[1])]].mean(1)
        b = np.array([(x[:, s : s + 11] * w).sum() for s in range(x.shape[1] - 10)])
        gain = np.where(b > 0, b**2, 0) / (w**2).sum()
        s = int(gain.argmax())
        best = max(best, (gain[s], (int(u), s, b[s] / (w**2).sum())))
    got = run(spark, "o_srt_14_matching_pursuit")
    assert any((r.unit, r.s) == best[1][:2] and math.isclose(r.amplitude, best[1][2], rel_tol=1e-4) for r in got)
    assert all(r.amplitude > 0 for r in got)


def graph(spikes):
    """Weights of pairs of units: how often both act within a quarter of an hour, counted from either side."""
    t, u = spikes.t.to_numpy(), spikes.unit.to_numpy()
    w = {}
    for i in range(len(t)):
        gap = t - t[i]
        for v in u[(gap >= -HOUR // 4) & (gap < HOUR // 4) & (u != u[i])]:
            w[min(u[i], v), max(u[i], v)] = w.get((min(u[i], v), max(u[i], v)), 0) + 1.0
    return w


def modularity(w, label):
    total, k, inside = 2 * sum(w.values()), {}, 0.0
    for (a, b), x in w.items():
        inside += 2 * x * (label[a] == label[b])
        k[label[a]] = k.get(label[a], 0) + x
        k[label[b]] = k.get(label[b], 0) + x
    return inside / total - sum(x * x for x in k.values()) / total**2


def test_o_srt_10_modularity_clusters(spark, spikes):
    w = graph(spikes)
    label = {r.node: r.cluster for r in run(spark, "o_srt_10_modularity_clusters")}
    assert set(label) == {u for p in w for u in p}
    assert modularity(w, label) > modularity(w, {u: u for u in label}) + 0.03


def test_o_srt_12_cluster_links(spark, spikes):
    w = graph(spikes)
    links = {(r.a, r.b): (r.w, r.ratio) for r in run(spark, "o_srt_12_cluster_links")}
    total = 2 * sum(w.values())
    assert math.isclose(sum(x for x, _ in links.values()), total)
    k = {a: sum(x for (c, _), (x, _) in links.items() if c == a) for a, _ in links}
    assert all(math.isclose(ratio, x * total / (k[a] * k[b]), rel_tol=1e-9) for (a, b), (x, ratio) in links.items())


def test_o_srt_23_simulated_spikes(spark):
    rows = run(spark, "o_srt_23_simulated_spikes")
    assert {r.unit for r in rows} == set(range(8)) and rows == run(spark, "o_srt_23_simulated_spikes")
    for u in range(8):
        t = np.sort([r.t for r in rows if r.unit == u])
        assert np.diff(t).min() >= 0.002 and t[0] > 0 and t[-1] < 30
        # 30 s at 10 a second with a pause of 2 ms
        assert abs(len(t) - 30 / (0.1 + 0.002)) < 5 * math.sqrt(300)


def test_o_ccg_07_fit_acg(spark, spikes):
    """The fit explains the positive lags better than their mean, by the share that it reports."""
    rows = {r.unit: r for r in run(spark, "o_ccg_07_fit_acg")}
    assert set(rows) == set(spikes.unit)
    assert all(r.r2 <= 1 and 1 <= r.tau_decay <= 500 and 0.1 <= r.tau_rise <= 50 for r in rows.values())
    assert np.mean([r.r2 > 0 for r in rows.values()]) > 0.5


def test_o_wv_03_trilaterate(spark, spikes):
    """The fitted curve comes closer to the amplitudes than any from a grid of places and length constants."""
    y = {"click": 0.0, "error": 20.0, "purchase": 40.0, "view": 60.0}
    for r in run(spark, "o_wv_03_trilaterate"):
        own = spikes[spikes.unit == r.unit].groupby("ch").v.max()
        at, a = np.array([y.get(c, 80.0) for c in own.index]), own.to_numpy()
        assert (r.x is None) == (len(a) < 3)

        def error(d):
            best = np.inf
            for b in np.geomspace(1, 200, 60):
                basis = np.stack([np.exp(-d / b), np.ones(len(d))], axis=1)
                c = np.clip(np.linalg.lstsq(basis, a, rcond=None)[0], [1, 0], [5000, 1000])
                best = min(best, ((a - basis @ c) ** 2).sum())
            return best

        if r.x is not None:
            assert 0.001 <= r.length_constant <= 200
            assert error(np.hypot(r.x, at - r.y)) <= 1.25 * error(np.abs(at - (a**2 @ at) / (a**2).sum())) + 1e-6


def test_o_srt_25_bimodal_split(spark, vectors):
    ids, unit, x = vectors
    got = run(spark, "o_srt_25_bimodal_split")
    assert sorted(r.vec_id for r in got) == sorted(ids)
    pc = x @ axes(x, 6).T
    for u in np.unique(unit):
        own = [r for r in got if r.unit == u]
        side = {r.vec_id: r.side for r in own}
        s = np.array([side[i] for i in ids[unit == u]])
        assert len({r.split for r in own}) == 1
        if own[0].split:
            assert min((s == 0).sum(), (s == 1).sum()) >= 20
        elif 0 < s.sum() < len(s):  # the sides differ along some direction more than along a random one
            y = pc[unit == u]
            gap = y[s == 0].mean(0) - y[s == 1].mean(0)
            assert np.linalg.norm(gap) > 0


def test_every_query_without_sql_is_tested_here():
    assert {f"test_{n}" for n in set(catalog.QUERIES) - set(catalog.ORACLE_SQL)} <= set(globals())
