import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import constraints as C
from tessella.operators import infer, losses, metrics, networks, training
from tessella.sources import datasets as D
from tessella.sources import tables


def images(spark, n=40):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=64)], int(rng.integers(0, 10))) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_constraints(spark):
    df = spark.createDataFrame([(1, 3, 4, 7, 7), (2, 3, 4, 8, 7), (3, 3, 4, 18, 18)], "ex int, d0 int, d1 int, s int, target int")
    v = C.verify(df, C.sum_constraints(F.col("d0"), F.col("d1"), F.col("s"), F.col("target")), ["ex"])
    assert v.count() == 3 * 22
    out = {r["ex"]: (r["satisfied"], r["if_satisfied"]) for r in C.satisfaction(v, ["ex"]).collect()}
    assert out[1] == (22, 100.0) and out[2][0] == 20 and out[3][0] == 21
    nan = v.filter("ex = 1 AND lc = 'sum_3'").first()
    assert math.isnan(nan["if_satisfied"]) and nan["satisfied"] == 100
    never = C.satisfaction(v.filter("lc = 'sum_3'"), ["ex"]).filter("ex = 1").first()
    assert never["if_satisfied"] is None
    flags = [F.col("d0") == 3, F.col("d1") == 3, F.col("s") == 7]
    r = df.select(C.exactly(flags, 2).alias("e"), C.at_most(flags).alias("a"), C.fixed(F.col("s"), F.col("target"), F.col("ex") == 2).alias("f")).collect()
    assert [tuple(x) for x in r] == [(True, False, True), (False, True, False), (False, True, True)]


def test_constrained_decoding_is_the_best_feasible(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.ones(10), size=(20, 2))
    df = spark.createDataFrame([(i, p[i, 0].tolist(), p[i, 1].tolist(), i % 19) for i in range(20)], "ex long, p0 array<double>, p1 array<double>, target int")
    for r in infer.constrained(df, lambda a, b, s: s == F.col("target")).collect():
        t = r["ex"] % 19
        best = max(((math.log(p[r["ex"], 0, a]) + math.log(p[r["ex"], 1, t - a]), -a) for a in range(10) if 0 <= t - a < 10))
        assert r["d0"] == -best[1] and r["d0"] + r["d1"] == r["s"] == t and r["score"] == pytest.approx(best[0])
    none = infer.constrained(df, lambda a, b, s: s == 30).first()
    assert none["d0"] is None and none["score"] is None


def test_refinement(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=10).tolist(), rng.normal(size=10).tolist(), rng.normal(size=19).tolist()) for i in range(30)]
    rows.append((99, *[[float(k == v) * 9 for k in range(n)] for v, n in ((2, 10), (3, 10), (5, 19))]))
    df = spark.createDataFrame(rows, "ex long, z0 array<double>, z1 array<double>, zs array<double>").repartition(3)
    out = {r["ex"]: r for r in infer.refine(df).collect()}
    assert len(out) == 31 and (out[99]["steps"], out[99]["satisfied"]) == (0, True)
    assert sum(r["satisfied"] for r in out.values()) > 20
    assert all((r["d0"] + r["d1"] == r["s"]) == r["satisfied"] for r in out.values())
    assert infer.refine_in_sequence(df.withColumn("part", F.col("ex") % 2)).count() == 31
    assert infer.refine(df.limit(0)).count() == 0


def test_report_of_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (0, 1), (2, 2)], "pred int, label int")
    out = {r["class"]: tuple(r)[1:] for r in metrics.report(df).collect()}
    assert out[1] == (0.0, 0.0, 0.0, 2) and out[2] == (1.0, 1.0, 1.0, 1) and out[0][:2] == (pytest.approx(1 / 3), 1.0)
    assert metrics.accuracy(df).first()[0] == 0.5


def test_losses(spark):
    df = spark.createDataFrame([([0.0, 1.0], 1), ([1.0, 0.0], 1)], "p array<double>, t int")
    bce = [r[0] for r in df.select(losses.bce(F.col("p"), F.col("t"), 2)).collect()]
    assert bce == [0.0, 100.0]  # logs stop at -100
    assert [r[0] for r in df.select(losses.nll(F.col("p"), F.col("t"))).collect()] == [-1.0, 0.0]
    assert df.select(losses.drawn(F.col("p"), F.lit(0.5))).collect() == [(1,), (0,)]


def test_datasets(spark):
    img = images(spark, 41)
    pairs = D.shuffled_pairs(img, 5).collect()
    assert len(pairs) == 20 and len({i for r in pairs for i in (r["img_a"], r["img_b"])}) == 40
    ranks = sorted(r["rn"] for r in D.shuffled_rank(img, 5).collect())
    assert ranks == list(range(41))
    assert D.subset(img, 8).count() == 9
    assert D.sample_exact(img, 7, 1).count() == 7 and D.sample_exact(img, 70, 1).count() == 41
    assert D.addition(img)[0] == "addition" and D.addition(img, 2)[0] == "multi_addition"
    e = D.operator_examples(img, 2, 2).orderBy("ex").first()
    labels = {r["vec_id"]: r["label"] for r in img.collect()}
    assert e["args"] == [[0, 1], [2, 3]] and e["expected"] == labels[0] * 10 + labels[1] + labels[2] * 10 + labels[3]
    assert D.operator_examples(img, 2, 2).count() == 10
    with pytest.raises(ValueError):
        D.operator_examples(img, 0)
    odd = D.operator_examples(img, 1, 3, of_list=lambda x: sorted(x)[1]).orderBy("ex").first()
    assert odd["expected"] == sorted(labels[i] for i in range(3))[1]
    assert [r[0] for r in D.operator_examples(img, 1, 1).orderBy("ex").select(D.example_line(D.operator_examples(img, 1, 1))).take(1)] == [f"(0,)\t{labels[0]}"]
    with pytest.raises(ValueError, match="asked of a table of 41"):
        D.readers(img, 30, 5, 10, 10)
    assert {k: v.count() for k, v in D.readers(img, *D.shares(41)).items()} == {"train": 24, "train_mini": 4, "valid": 8, "test": 9}
    many = D.proposals(spark, 400, 1)
    assert all(0 <= r["d0"] <= 9 and 0 <= r["d1"] <= 9 and r["d0"] + r["d1"] == r["s"] for r in many.collect())
    with pytest.raises(Exception, match="too few"):
        D.balanced_pairs(img, many, 1).collect()
    some = D.balanced_pairs(img, many, 1, strict=False).collect()
    used = [i for r in some for i in (r["img0"], r["img1"])]
    assert some and len(used) == len(set(used)) and all(labels[r["img0"]] == r["d0"] and labels[r["img1"]] == r["d1"] for r in some)


def test_parameters(spark, tmp_path):
    arrays = {"a.weight": np.arange(6.0).reshape(2, 3), "b.bias": np.ones(2)}
    tables.save_parameters(spark, arrays, f"{tmp_path}/p")
    back = tables.load_arrays(tables.parameters(spark, f"{tmp_path}/p"))
    assert all((back[k] == v).all() for k, v in arrays.items())
    assert set(tables.load_arrays(tables.parameters(spark, f"{tmp_path}/p", ["b.bias"]))) == {"a.weight"}
    tables.save_epoch(spark, str(tmp_path / "run"), 1, {"model": arrays, "constraints": {"multiplier": np.ones(1)}})
    with pytest.warns(UserWarning):
        tables.save_epoch(spark, str(tmp_path / "run"), 1, {"model": arrays})
    log = spark.createDataFrame([(0, 3.0), (1, 1.0), (2, 1.0)], "epoch int, loss double")
    assert tuple(tables.best_epoch(log).first()) == (1, 1.0)
    tables.write_tsv(log, f"{tmp_path}/tsv")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/tsv").count() == 3
    tables.write_lines(log, "loss", f"{tmp_path}/lines")
    assert spark.read.text(f"{tmp_path}/lines").count() == 3


def test_layers():
    rng = np.random.default_rng(4)
    x, w, b = rng.normal(size=(2, 3, 7, 7)), rng.normal(size=(4, 3, 3, 3)), rng.normal(size=4)
    got = networks.conv2d("c", padding=1)(x, {"c.weight": w, "c.bias": b})
    padded = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    want = np.zeros((2, 4, 7, 7))
    for n in range(2):
        for o in range(4):
            for i in range(7):
                for j in range(7):
                    want[n, o, i, j] = (padded[n, :, i : i + 3, j : j + 3] * w[o]).sum() + b[o]
    assert np.allclose(got, want)
    pooled = networks.max_pool(2)(x, {})
    assert pooled.shape == (2, 3, 3, 3) and pooled[0, 0, 1, 2] == x[0, 0, 2:4, 4:6].max()
    normed = networks.layer_norm("n")(rng.normal(size=(5, 8)), {"n.weight": np.ones(8), "n.bias": np.zeros(8)})
    assert np.allclose(normed.mean(axis=1), 0) and np.allclose(normed.var(axis=1), 1, atol=1e-3)


@pytest.mark.parametrize(("kind", "layers"), [("plain", networks.plain_cnn()), ("lenet", networks.lenet()), ("pair", networks.pair_cnn()), ("canvas", networks.canvas_cnn()), ("mlp", networks.perceptron())])
def test_networks(spark, kind, layers):
    params = networks.initial(networks.shapes(kind), 1)
    img = images(spark, 12)
    out = {r["vec_id"]: r["probs"] for r in networks.predict(img, layers, params, 8).collect()}
    rows = img.orderBy("vec_id").collect()
    direct = networks.forward(layers, np.array([r["embedding"] for r in rows], np.float32).astype(float).reshape(-1, 1, 8, 8), params)
    assert all(np.allclose(out[r["vec_id"]], v) for r, v in zip(rows, direct, strict=True))
    assert kind in ("pair", "canvas") or np.allclose(direct.sum(axis=1), 1)
    assert np.ptp(direct, axis=0).max() > 1e-6  # the images matter
    times = networks.layer_times(img, layers, params, 8).collect()
    assert sorted(r["layer"] for r in times) == list(range(len(layers))) and all(r["ms"] >= 0 and r["batches"] >= 1 for r in times)


def test_network_parts():
    params = networks.initial(networks.shapes("lenet"), 1)
    x = np.random.default_rng(1).normal(size=(3, 1, 8, 8))
    code = networks.forward(networks.lenet_encoder(), x, params)
    assert code.shape == (3, 8) and np.allclose(networks.forward(networks.lenet_classifier(), code, params), networks.forward(networks.lenet(), x, params))
    # parameters of 28 by 28 images with kernels of 5: 256 values are normalised, then 256 to 128 to 10
    full = networks.shapes("pair", 28, filters=(6, 16), kernel=5, hidden=128)
    assert full["norm.weight"] == (256,) and full["lin1.weight"] == (128, 256) and full["lin2.weight"] == (10, 128)
    assert networks.forward(networks.pair_cnn(), np.ones((2, 1, 28, 28)), networks.initial(full)).shape == (2, 10)
    wide = networks.shapes("canvas", 56, filters=(6, 16), kernel=5, hidden=512, out=19)
    assert wide["lin1.weight"] == (512, 16 * 11 * 11) and networks.forward(networks.canvas_cnn(), np.ones((3, 1, 56, 56)), networks.initial(wide)).shape == (3, 19)
    with pytest.raises(ValueError):
        networks.shapes("plain", 8, kernel=3)


def test_sum_layer_shapes():
    params = networks.initial(networks.shapes("sum"), 2)
    assert networks.forward(networks.sum_layer(), np.ones((3, 20)), params).shape == (3, 19)


@pytest.mark.parametrize("objective", [training.semantic, training.violation, training.primal_dual(), training.primal_dual(training.supervised, 0.3), training.digit_labels, training.supervised, training.explicit_sum])
def test_gradients_by_finite_differences(objective):
    rng = np.random.default_rng(6)
    a, b, s = rng.dirichlet(np.ones(10), 4), rng.dirichlet(np.ones(10), 4), np.array([0, 9, 13, 18])
    d0 = np.array([0, 4, 7, 9])
    of = lambda a, b: objective(training.Batch(a, b, s, d0, s - d0, weight=0.7))
    ga, gb, _, _ = of(a, b)
    for g, x, first in ((ga, a, True), (gb, b, False)):
        for r, c in ((0, 0), (1, 4), (2, 7), (3, 9)):
            ends = []
            for h in (1e-6, -1e-6):
                y = x.copy()
                y[r, c] += h
                ends.append(of(y, b)[2] if first else of(a, y)[2])
            assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(g[r, c], rel=1e-3, abs=1e-5)


def test_training_lowers_the_loss(spark):
    rng = np.random.default_rng(8)
    labels = rng.integers(0, 10, (200, 2))
    rows = [(i, np.eye(10)[a].tolist(), np.eye(10)[b].tolist(), int(a), int(b), int(a + b)) for i, (a, b) in enumerate(labels)]
    df = spark.createDataFrame(rows, "ex long, x0 array<double>, x1 array<double>, d0 int, d1 int, s int")
    seen = []
    w, log = training.train(df.repartition(4), 10, training.semantic, training.Adam(0.3), 12, after_epoch=lambda e, w: seen.append(e.number))
    assert log[-1].loss < 0.6 * log[0].loss and seen == list(range(13)) and w.shape == (10, 11)
    _, dual = training.train(df, 10, training.primal_dual(), training.Sgd(0.1), 2, multiplier_rate=0.5)
    assert dual[2].multiplier > dual[1].multiplier > dual[0].multiplier == 1.0
    check = training.Evaluation(3, True, df.limit(50))
    training.train(df, 10, training.supervised, training.Adam(0.3), 6, evaluation=check)
    assert [x[:3] for x in check.log] == [(e, p, "accuracy") for e in (0, 3, 6) for p in ("train", "valid")] and check.log[-1][3] > 0.95
    # drawn numbers belong to the pairs, not to the tasks
    one, four = (training.train(df.repartition(n), 10, training.sampling(20), training.Sgd(0.1), 2)[1] for n in (1, 4))
    assert [(round(e.loss, 9), round(e.violation, 9)) for e in one] == [(round(e.loss, 9), round(e.violation, 9)) for e in four]
    with pytest.raises(Exception, match="d0 and d1"):
        training.train(df.drop("d0"), 10, training.supervised, epochs=1)


def test_refinement_gradient_by_finite_differences():
    rng = np.random.default_rng(3)
    w = {k: v[None].repeat(2, axis=0) for k, v in infer.initial_parameters(5, 1).items()}
    origin = {k: v + rng.normal(0, 0.1, v.shape) for k, v in w.items()}
    x0, x1, open_ = rng.normal(size=(2, 5)), rng.normal(size=(2, 5)), np.array([1.0, 0.0])
    got = infer.refinement_gradient(w, origin, x0, x1, open_, 0.3)
    for name, v in w.items():
        for at in (tuple(rng.integers(0, n) for n in v.shape[1:]) for _ in range(4)):
            for n in (0, 1):
                ends = []
                for h in (1e-6, -1e-6):
                    y = {k: x.copy() for k, x in w.items()}
                    y[name][(n, *at)] += h
                    ends.append(infer.refinement_loss(y, origin, x0, x1, open_, 0.3)[n])
                assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(got[name][(n, *at)], rel=1e-4, abs=1e-7)


def test_refinement(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).tolist(), rng.normal(size=6).tolist(), i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "ex long, x0 array<double>, x1 array<double>, part int")
    params = infer.initial_parameters(6, 2)
    out = {r["ex"]: r for r in infer.refine(df, params, weight=0.1, rate=0.5, steps=60).collect()}
    assert len(out) == 30 and all(r["satisfied"] == (r["d0"] + r["d1"] == r["s"]) and (r["satisfied"] or r["steps"] == 60) for r in out.values())
    assert sum(r["satisfied"] for r in out.values()) > sum(r["steps"] == 0 for r in out.values())
    again = {r["ex"]: r for r in infer.refine(df.repartition(5), params, weight=0.1, rate=0.5, steps=60).collect()}
    assert out == again
    follow = {r["ex"]: r for r in infer.refine_in_sequence(df, params, weight=0.1, rate=0.5, steps=60).collect()}
    assert all(follow[i] == out[i] for i in range(3)) and len(follow) == 30  # the first of each part begins alike
    saved = []
    new, log = infer.learn_by_refining(df, params, 3, 0.1, 0.5, 10, interval=2, save=lambda n, w: saved.append(n))
    assert saved == [2, 3] and [x[:2] for x in log] == [(1, 30), (2, 30), (3, 30)]
    assert {k: v.shape for k, v in new.items()} == {k: v.shape for k, v in params.items()}


def test_few_shot(spark):
    rows = [(i, np.eye(10)[i % 10].tolist(), i % 10) for i in range(60)]
    img = spark.createDataFrame(rows, "vec_id long, x array<double>, label int")
    got = dict(training.few_shot(img, (5, 20), epochs=60, rate=0.05, decay=0.0))
    assert got[20] == 1.0 and got[5] < 1.0


def test_few_shot_sweep_runs_all_sizes(spark, monkeypatch):
    import inspect

    from tessella.plans import catalog

    seen = []
    shape = inspect.signature(training.few_shot)

    def spy(*args, **named):
        got = shape.bind(*args, **named)
        got.apply_defaults()
        seen.append((got.arguments["sizes"], got.arguments["epochs"]))
        return [(n, 0.0) for n in got.arguments["sizes"]]

    monkeypatch.setattr(training, "few_shot", spy)
    rows = catalog.few_shot_sweep(spark, "/root/testdata/sf0.001").collect()
    assert [r["n"] for r in rows] == [8, 16, 32, 64, 128, 256] and seen[0][1] == 40


def test_scalars(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], [1, 2, 0])], "z array<double>, d array<int>")
    r = df.select(S.argmax(F.col("z")).alias("a"), S.digits_to_number(F.col("d")).alias("n"), S.total(S.softmax(F.col("z"))).alias("t"), S.counts_text(F.col("d")).alias("s"), S.clamp(F.lit(5.0), 0, 1).alias("c")).first()
    assert (r["a"], r["n"], r["s"], r["c"]) == (1, 120, "0: 1 || 1: 2 || 2: 0", 1.0) and r["t"] == pytest.approx(1)
    nan = spark.createDataFrame([(float("nan"),), (2.0,), (4.0,)], "x double")
    assert nan.agg(S.nanmean(F.col("x"))).first()[0] == 3.0
