import numpy as np

from specweave.plans import fixtures as fx
from specweave.plans import model_queries, registry


def test_composite_model_equals_a_plain_one_and_its_adjoint(spark, tmp_path):
    r = np.random.default_rng(4)
    x = np.round(r.normal(0, 0.3, (7 * 25, 64)), 3).astype(np.float32)
    rows = [(k, [float(v) for v in x[k]], k % 2) for k in range(len(x))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    d = str(tmp_path)
    _, maps = model_queries._model(spark, d)
    a, s = np.zeros((2, 7, 25)), np.zeros((2, 64))
    for o in maps.collect():
        a[o.m, o.i, o.j] = o.v
    for o in fx.templates(fx.cube(spark, d)).collect():
        s[o.m, o.l] = o.t
    cube = np.einsum("mij,ml->lij", a, s)
    blurred = sum(w * np.roll(cube, (di, dj), (1, 2)) for di, dj, w in fx.psf(spark).collect())
    want = {}
    for chan, p, u, v, first, last in model_queries.OBSERVATIONS:
        rows_ = (1 - u) * blurred[:, :-1] + u * blurred[:, 1:]
        field = (1 - v) * rows_[:, :, :-1] + v * rows_[:, :, 1:]
        for slit in range(7):
            lo, hi = slit * 3.5, (slit + 1) * 3.5
            share = np.clip(np.minimum(np.arange(24) + 1, hi) - np.maximum(np.arange(24), lo), 0, None)
            boxed = (field * share).reshape(64, 2, 3, 24).sum(2)
            for lp in range(32):
                for i in range(2):
                    want[chan, p, slit, lp, i] = sum((3 - abs(k - 2 * lp) + np.arange(24) % 2) @ boxed[k, i] for k in range(max(first, 2 * lp - 2), min(last, 2 * lp + 3)))
    got = {(o.chan, o.p, o.s, o.lp, o.i): o.v for o in registry.QUERIES["forward_mcmo"](spark, d).collect()}
    assert {c for c, *_ in got} == {"a", "b"} and set(got) <= set(want)
    assert [got.get(k, 0.0) for k in want] == list(want.values())
    dots = registry.QUERIES["dot_mcmo"](spark, d).first()
    assert dots.y_hx != 0 and dots.y_hx == dots.hty_x


def test_closed_form_solves_the_normal_equations(spark, tmp_path):
    r = np.random.default_rng(9)
    x = np.round(r.normal(0, 0.3, (6 * 25, 64)), 3).astype(np.float32)
    rows = [(k, [float(v) for v in x[k]], k % 3) for k in range(len(x))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    d = str(tmp_path)
    a = np.zeros((3, 6, 25))
    for o in registry.QUERIES["expsol"](spark, d).collect():
        a[o.l, o.i, o.j] = o.v
    q = np.round(x.astype(float) * 1000)
    s = np.array([np.floor(q[m::3].sum(0) / len(q[m::3])) for m in range(3)]) / 1000
    taps = [(o.di, o.dj, o.w / 10) for o in fx.psf(spark).collect()]
    blur = lambda z, sign: sum(w * np.roll(z, (sign * di, sign * dj), (1, 2)) for di, dj, w in taps)
    unmix = lambda z: np.einsum("ml,lij->mij", s, blur(z, -1))
    rough = 4 * a - sum(np.roll(a, k, axis) for k in (1, -1) for axis in (1, 2))
    cube = x.T.reshape(64, 6, 25).astype(float)
    assert np.allclose(unmix(blur(np.einsum("mij,ml->lij", a, s), 1)) + 0.1 * rough, unmix(cube), atol=1e-7)
