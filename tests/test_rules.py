"""Rules against enumeration of possible worlds, and literal cases with known answers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import facts, rules
from tessella.operators import provenance as P
from tessella.operators.program import Program
from tessella.operators.sensors import ConstantSensor, EdgeSensor, FunctionalSensor, Graph, JointSensor, ModuleLearner, ReaderSensor


def distribution(rng, n=10):
    w = [rng.random() ** 3 for _ in range(n)]
    return [x / sum(w) for x in w]


def relation(spark, dists):
    """ex 0, one variable a distribution."""
    rows = [(0, i, i, v, p) for i, d in enumerate(dists) for v, p in enumerate(d)]
    return spark.createDataFrame(rows, "ex long, vec_id long, pos int, value int, prob double")


def got(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r["prob"] for r in df.collect()}


def worlds(dists):
    for values in itertools.product(*[range(len(d)) for d in dists]):
        p = 1.0
        for d, v in zip(dists, values, strict=True):
            p *= d[v]
        yield values, p


def same(a, b):
    assert set(k for k, v in a.items() if v > 1e-12) <= set(b) and all(abs(a.get(k, 0) - v) < 1e-9 for k, v in b.items())


def test_sum_rule_forms_agree(spark):
    rng = random.Random(1)
    x, y = distribution(rng), distribution(rng)
    want = {}
    for (a, b), p in worlds([x, y]):
        want[a + b] = want.get(a + b, 0) + p
    rel = relation(spark, [x, y])
    parts = [(rules.literal(rel.filter(F.col("pos") == i), n, ["ex"], "vec_id"), n) for i, n in enumerate("ab")]
    body = rules.conjunction(parts, ["ex"])
    head = {"s": F.col("a") + F.col("b")}
    same(want, got(rules.derive(body, ["ex"], head), "s"))
    same(want, got(rules.derive(body, ["ex"], head, P.TopK(10, P.ExclusiveSum(), ("a",))), "s"))
    arrays = spark.createDataFrame([(0, x, y)], "ex long, p0 array<double>, p1 array<double>")
    same(want, got(arrays.select(F.posexplode(rules.sum_of_two()).alias("s", "prob")), "s"))
    top = got(rules.derive(body, ["ex"], head, P.TopK(3, P.ExclusiveSum(), ("a",))), "s")
    assert all(top[s] <= want[s] + 1e-12 for s in want)
    best = got(rules.derive(body, ["ex"], head, P.MaxProd()), "s")
    assert all(abs(best[s] - max(x[a] * y[s - a] for a in range(10) if 0 <= s - a < 10)) < 1e-12 for s in want)
    independent = got(rules.derive(body, ["ex"], head, P.NoisyOr()), "s")
    for s in want:
        miss = 1.0
        for a in range(10):
            if 0 <= s - a < 10:
                miss *= 1 - x[a] * y[s - a]
        assert abs(independent[s] - (1 - miss)) < 1e-9


def test_noisy_or_of_certain_facts(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 0.3), (2, 0.0)], "k int, prob double")
    assert got(P.NoisyOr().combine(df, ["k"]), "k") == {1: 1.0, 2: 0.0}


def test_shared_variable_counts_once(spark):
    rng = random.Random(2)
    x = distribution(rng)
    rel = relation(spark, [x])
    parts = [(rules.literal(rel, n, ["ex"], "vec_id"), n) for n in "ab"]
    out = got(rules.derive(rules.conjunction(parts, ["ex"]), ["ex"], {"s": F.col("a") + F.col("b")}), "s")
    assert set(out) == {2 * v for v in range(10)} and all(abs(out[2 * v] - x[v]) < 1e-12 for v in range(10))


@pytest.mark.parametrize(("n", "pairs"), [(4, [(0, 1), (2, 3)]), (3, [(0, 1), (1, 2)]), (3, [(0, 1), (1, 2), (0, 2)]), (2, [(0, 1)])])
def test_any_sum(spark, n, pairs):
    rng = random.Random(n + len(pairs))
    dists = [distribution(rng, 5) for _ in range(n)]
    want = {}
    for values, p in worlds(dists):
        for s in {values[i] + values[j] for i, j in pairs}:
            want[s] = want.get(s, 0) + p
    same(want, got(rules.any_sum(relation(spark, dists), ["ex"], "pos", n, pairs), "s"))


@pytest.mark.parametrize("pairs", [[(i, i + 1) for i in range(6)], [(0, i) for i in range(1, 7)], [(0, 1), (1, 2), (2, 0), (3, 4), (5, 5)]])
def test_any_sum_of_seven_variables_by_elimination(spark, pairs):
    rng = random.Random(len(pairs))
    dists = [distribution(rng, 3) for _ in range(7)]
    want = {}
    for values, p in worlds(dists):
        for s in {values[i] + values[j] for i, j in pairs}:
            want[s] = want.get(s, 0) + p
    same(want, got(rules.any_sum(relation(spark, dists), ["ex"], "pos", 7, pairs, top=2), "s"))


def test_exact_inference_is_bounded(spark):
    with pytest.raises(ValueError):
        rules.worlds(relation(spark, [[1.0]] * 7), ["ex"], "pos", 7)
    everyone = list(itertools.combinations(range(7), 2))
    with pytest.raises(ValueError):
        rules.any_sum(relation(spark, [[1.0]] * 7), ["ex"], "pos", 7, everyone)
    assert rules.elimination_order(7, everyone)[1] == 6 and rules.elimination_order(9, [(i, i + 1) for i in range(8)])[1] == 1


def test_program_text():
    p = Program("0.25 :: rain; 0.5 :: sun. wet :- rain. t(0.1) :: noisy. % a remark\nmore(X, Y) :- X > Y, Z is X - 2 * (Y + 1), Z =\\= 3.")
    assert [c.prob for c in p.choices["rain", 0]] == [0.25] and p.choices["rain", 0][0].group == p.choices["sun", 0][0].group
    assert p.choices["noisy", 0][0].prob == 0.1 and len(p.rules["more", 2][0].body) == 3
    for bad in ("a(X) :- ", "0.7 :: a; 0.7 :: b.", "0.5 :: a(X) :- b(X).", "a(X :- b.", "a ? b."):
        with pytest.raises(ValueError):
            Program(bad)
    with pytest.raises(ValueError, match="style"):
        Program("", style="other")


def test_program_over_facts(spark):
    one = spark.range(1).select(F.lit(0).alias("ex"))
    p = Program("0.3 :: rain. 0.6 :: sprinkler. wet(1) :- rain. wet(1) :- sprinkler. dry(1) :- \\+ rain, \\+ sprinkler. both(1) :- rain, \\+ rain. 0.2 :: die(1); 0.3 :: die(2); 0.5 :: die(3). even(Y) :- die(X), Y is X mod 2.")
    assert p.query("wet(Z)", one, ["ex"], provenance=P.NoisyOr()).collect()[0]["prob"] == pytest.approx(1 - 0.7 * 0.4)
    assert p.query("wet(Z)", one, ["ex"]).collect()[0]["prob"] == pytest.approx(1 - 0.7 * 0.4)  # independent branches
    assert p.query("dry(Z)", one, ["ex"]).collect()[0]["prob"] == pytest.approx(0.28)
    assert {r["y"]: r["prob"] for r in p.query("even(Y)", one, ["ex"]).collect()} == {1: pytest.approx(0.7), 0: pytest.approx(0.3)}
    with pytest.raises(ValueError, match="no proof"):
        p.query("both(Z)", one, ["ex"])
    with pytest.raises(ValueError, match="no predicate"):
        p.query("other(Z)", one, ["ex"])
    with pytest.raises(ValueError, match="doesn't end"):
        Program("loop(X) :- loop(X).").query("loop(Z)", one, ["ex"])


def test_program_against_worlds(spark):
    """Sums, bags that share an image, lists as numbers, one image twice: all by enumeration."""
    rng = random.Random(12)
    dists = [distribution(rng, 4) for _ in range(4)]
    table = spark.createDataFrame([(i, v, p) for i, d in enumerate(dists) for v, p in enumerate(d)], "id long, value int, prob double")
    p = Program("sum(X, Y, Z) :- digit(X, A), digit(Y, B), Z is A + B. any(L, Z) :- member([X, Y], L), sum(X, Y, Z). v([], V, V). v([H | T], V, W) :- digit(H, D), U is D + 10 * V, v(T, U, W). v(L, W) :- v(L, 0, W). two(X, Y, Z) :- v(X, A), v(Y, B), Z is A + B. big(X) :- digit(X, A), A >= 2.")
    p.relation("digit", table, ["id", "value"])
    bag = spark.range(1).select(F.lit(0).alias("ex"), *[F.lit(i).cast("long").alias(f"i{i}") for i in range(4)])
    cases = {
        "sum(I0, I1, Z)": lambda v: {v[0] + v[1]},
        "sum(I0, I0, Z)": lambda v: {2 * v[0]},
        "any([[I0, I1], [I1, I2], [I2, I0]], Z)": lambda v: {v[0] + v[1], v[1] + v[2], v[2] + v[0]},
        "any([[I0, I1], [I2, I3]], Z)": lambda v: {v[0] + v[1], v[2] + v[3]},
        "v([I2, I1, I0], Z)": lambda v: {100 * v[2] + 10 * v[1] + v[0]},
        "two([I0, I1], [I2, I3], Z)": lambda v: {10 * v[0] + v[1] + 10 * v[2] + v[3]},
    }
    for text, f in cases.items():
        want = {}
        for values, q in worlds(dists):
            for z in f(values):
                want[z] = want.get(z, 0) + q
        same(want, got(p.query(text, bag, ["ex"]), "z"))
    assert p.query("big(I3)", bag, ["ex"]).collect()[0]["prob"] == pytest.approx(sum(dists[3][2:]))
    # ids that are equal only in the row are one variable
    twice = bag.withColumn("i1", F.lit(0).cast("long"))
    assert got(p.query("sum(I0, I1, Z)", twice, ["ex"]), "z") == pytest.approx({2 * k: x for k, x in enumerate(dists[0])})
    kept = p.query("sum(I0, I1, Z)", bag, ["ex"], cache=True)
    assert p.query("sum(I0, I1, Z)", bag, ["ex"], cache=True) is kept and p.query("sum(I0, I2, Z)", bag, ["ex"], cache=True) is not kept
    kept.unpersist()
    dense = p.query("sum(I0, I1, Z)", bag, ["ex"], output_mapping=list(range(9))).collect()[0]["probs"]
    assert len(dense) == 9 and sum(dense) == pytest.approx(1) and dense[8] == 0


def test_sensors(spark):
    graph = Graph()
    image = graph.concept("image", "id")
    image["twice"] = FunctionalSensor(("pixel",), lambda x: x * 2)
    image["pixel"] = ReaderSensor("raw")
    image["one"] = ConstantSensor(1)
    image["truth"] = ReaderSensor("raw", label=True)
    image["out"] = ModuleLearner("twice", lambda df, key, x: df.select(key, (F.col(x) + 1).alias("probs")))
    pair = graph.concept("pair", "ex", JointSensor("image", lambda t: t.filter("id % 2 = 0").select((F.col("id") / 2).cast("long").alias("ex"), F.col("id").alias("first"))))
    pair["out0"] = EdgeSensor("image", "first", "out")
    source = {"image": spark.createDataFrame([(i, float(i)) for i in range(6)], "id long, raw double")}
    made = graph.build(source)
    assert sorted(map(tuple, made["pair"].select("ex", "out0").collect())) == [(0, 1.0), (1, 5.0), (2, 9.0)]
    assert "truth" in made["image"].columns and "truth" not in graph.build(source, labels=False)["image"].columns
    node, plan = graph.forward(source, "image", 3)
    assert node["twice"] == 6.0 and node["one"] == 1 and plan.count() == 1
    image["bad"] = FunctionalSensor(("nowhere",), lambda x: x)
    with pytest.raises(ValueError, match="nothing gives"):
        graph.build(source)


def test_many_digit_sums(spark):
    rng = random.Random(5)
    dists = [distribution(rng) for _ in range(4)]
    arrays = spark.createDataFrame([(0, *dists)], "ex long, p0 array<double>, p1 array<double>, p2 array<double>, p3 array<double>")
    want = [0.0] * 199
    for (a, b, c, e), p in worlds(dists):
        want[10 * a + b + 10 * c + e] += p
    rows = arrays.select("*", F.explode(F.sequence(F.lit(0), F.lit(250))).alias("t"))
    p = rules.ground_sum([F.col("p0"), F.col("p1")], [F.col("p2"), F.col("p3")], F.col("t"))
    out = {r["t"]: r["p"] for r in rows.select("t", p.alias("p")).collect()}
    assert all(abs(out[t] - want[t]) < 1e-9 for t in range(199)) and all(out[t] == 0 for t in range(199, 251))


def test_sum_of_many(spark):
    rng = random.Random(6)
    dists = [distribution(rng, 4) for _ in range(4)]
    want = {}
    for values, p in worlds(dists):
        want[sum(values)] = want.get(sum(values), 0) + p
    same(want, got(rules.sum_of_many(relation(spark, dists), ["ex"], "pos", 4), "s"))


def test_gradient_is_the_finite_difference(spark):
    rng = random.Random(7)
    x, y = distribution(rng), distribution(rng)
    arrays = spark.createDataFrame([(0, x, y)], "ex long, p0 array<double>, p1 array<double>")
    for r in rules.gradients(arrays, ["ex"]).collect():
        f = lambda h, r=r: sum((x[a] + h * (a == r["a"])) * y[r["s"] - a] for a in range(10) if 0 <= r["s"] - a < 10)
        assert abs((f(1e-4) - f(-1e-4)) / 2e-4 - r["grad"]) < 1e-8


def test_literal_cases(spark):
    uniform, three, five = [0.1] * 10, [float(i == 3) for i in range(10)], [float(i == 5) for i in range(10)]
    arrays = spark.createDataFrame([(0, uniform, uniform), (1, three, five)], "ex long, p0 array<double>, p1 array<double>")
    out = {(r["ex"], r["s"]): r["prob"] for r in arrays.select("ex", F.posexplode(rules.sum_of_two()).alias("s", "prob")).collect()}
    for s in range(19):
        assert abs(out[0, s] - (10 - abs(9 - s)) / 100) < 1e-12 and out[1, s] == float(s == 8)
    noisy = rules.noisy(arrays.filter("ex = 1").select(F.posexplode(rules.sum_of_two()).alias("s", "prob")), 0.1, 19)
    for r in noisy.collect():
        assert abs(r["prob"] - (0.9 * (r["s"] == 8) + 0.1 / 19)) < 1e-12
    assert facts.add_table(spark).count() == 100 and facts.uniform(spark, 19).agg(F.sum("prob")).first()[0] == pytest.approx(1)
    assert facts.bernoulli(spark, 0.1).first()[0] == 0.1


def test_unknown_provenance():
    with pytest.raises(ValueError):
        P.by_name("best")
