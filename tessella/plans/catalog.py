"""All queries on the engine's own operators, by name. Their SQL is in tessella.plans.oracle, under the same names."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators import constraints as C
from tessella.operators import facts, infer, losses, metrics, networks, rules, sensors, training
from tessella.operators import provenance as P
from tessella.operators.program import Program
from tessella.plans.oracle import SQL
from tessella.sources import datasets as D
from tessella.sources import tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SEED = 11


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in _QUERIES}


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _dist(spark, d):
    return facts.distributions(facts.images(spark, d))


def _pairs(spark, d):
    return facts.groups(_dist(spark, d), 2)


def _digits(spark, d):
    return facts.digits(facts.images(spark, d))


def _literals(digit: DataFrame, n: int) -> list[tuple[DataFrame, str]]:
    """Literal i reads vector i of each group of n."""
    rows = digit.withColumn("ex", F.expr(f"vec_id div {n}"))
    return [(rules.literal(rows.filter(F.col("vec_id") % n == i), name, ["ex"], "vec_id"), name) for i, name in zip(range(n), "abcdef", strict=False)]


def _sum2(spark, d, provenance):
    body = rules.conjunction(_literals(_digits(spark, d), 2), ["ex"])
    return rules.derive(body, ["ex"], {"s": F.col("a") + F.col("b")}, provenance).select("ex", "s", r6("prob").alias("prob"))


# Distributions and the sum rule


@query
def softmax_dist(spark, d):
    return _digits(spark, d).select("vec_id", "value", r6("prob").alias("prob"))


@query
def log_softmax_dist(spark, d):
    z = facts.images(spark, d).select("vec_id", F.posexplode(S.log_softmax(S.logits(F.col("embedding")))).alias("value", "lp"))
    return z.select("vec_id", "value", r6("lp").alias("log_prob"))


@query
def to_arrays_round_trip(spark, d):
    back = facts.to_arrays(_digits(spark, d), ["vec_id"])
    return back.select("vec_id", F.size("probs").alias("n"), r6(S.total(F.col("probs"))).alias("total"), S.argmax(F.col("probs")).alias("pred"))


@query
def sum2_exclusive(spark, d):
    return _sum2(spark, d, P.ExclusiveSum())


@query
def sum2_noisy_or(spark, d):
    return _sum2(spark, d, P.NoisyOr())


@query
def sum2_max_prod(spark, d):
    return _sum2(spark, d, P.MaxProd())


@query
def sum2_topk3_exclusive(spark, d):
    return _sum2(spark, d, P.by_name("topk", 3, ("a",)))


@query
def sum2_topk3_noisy_or(spark, d):
    return _sum2(spark, d, P.by_name("topk_noisy_or", 3, ("a",)))


@query
def sum2_best_first(spark, d):
    return _sum2(spark, d, P.TopK(1, P.ExclusiveSum(), ("a",), P.geometric_mean(F.col("prob"), 2)))


@query
def sum2_dense_array(spark, d):
    return _pairs(spark, d).select("ex", F.posexplode(rules.sum_of_two()).alias("s", "p")).select("ex", "s", r6("p").alias("prob"))


@query
def outer_product(spark, d):
    m = _pairs(spark, d).select("ex", F.posexplode(S.outer(F.col("p0"), F.col("p1"))).alias("a", "row"))
    return m.select("ex", "a", F.posexplode("row").alias("b", "p")).select("ex", "a", "b", r6("p").alias("prob"))


@query
def sum2_noisy(spark, d):
    exact = _pairs(spark, d).select("ex", F.posexplode(rules.sum_of_two()).alias("s", "prob"))
    return rules.noisy(exact, 0.1, 19).select("ex", "s", r6("prob").alias("prob"))


@query
def sum2_noisy_union(spark, d):
    """The same head from two rules: the noise, and its negation with the exact rule."""
    exact = _pairs(spark, d).select("ex", F.posexplode(rules.sum_of_two()).alias("s", "prob"))
    second = exact.withColumn("prob", rules.negation(F.lit(0.1)) * F.col("prob"))
    first = exact.select("ex", "s", (F.lit(0.1) * F.lit(1.0 / 19)).alias("prob"))
    return rules.either([first, second], ["ex", "s"]).select("ex", "s", r6("prob").alias("prob"))


@query
def sum_of_three(spark, d):
    rows = _digits(spark, d).withColumn("ex", F.expr("vec_id div 3")).withColumn("pos", F.col("vec_id") % 3)
    return rules.sum_of_many(rows, ["ex"], "pos", 3).select("ex", "s", r6("prob").alias("prob"))


@query
def addition_ground(spark, d):
    """Only the wanted sum of each pair: its probability, without the other eighteen."""
    g = _pairs(spark, d).withColumn("target", F.col("l0") + F.col("l1"))
    p = F.aggregate(S.feasible_range(F.col("target")), F.lit(0.0), lambda a, i: a + F.get("p0", i) * F.get("p1", F.col("target") - i))
    return g.select("ex", "target", r6(p).alias("prob"))


@query
def fact_accuracy(spark, d):
    g = _pairs(spark, d).withColumn("target", F.col("l0") + F.col("l1"))
    g = g.withColumn("prob", F.get(rules.sum_of_two(), F.col("target")))
    return metrics.fact_accuracy(g).select(r6("fact_accuracy").alias("fact_accuracy"))


@query
def all_digit_addition(spark, d):
    """z = x + y with three images: the sum is a key of the second join, not a filter on a product."""
    (a, _), (b, _), (c, _) = _literals(_digits(spark, d), 3)
    two = a.join(b, "ex").groupBy("ex", (F.col("a") + F.col("b")).alias("c")).agg(F.sum(F.col("a_p") * F.col("b_p")).alias("p"))
    return two.join(c, ["ex", "c"]).select("ex", F.col("c").alias("z"), r6(F.col("p") * F.col("c_p")).alias("prob"))


@query
def any_sum_disjoint(spark, d):
    rows = _digits(spark, d).withColumn("ex", F.expr("vec_id div 4")).withColumn("pos", F.col("vec_id") % 4)
    full = rows.groupBy("ex").agg(F.max("pos").alias("m")).filter("m = 3").select("ex")
    return rules.any_sum(rows.join(full, "ex", "left_semi"), ["ex"], "pos", 4, [(0, 1), (2, 3)]).select("ex", "s", r6("prob").alias("prob"))


@query
def any_sum_shared(spark, d):
    rows = _digits(spark, d).withColumn("ex", F.expr("vec_id div 3")).withColumn("pos", F.col("vec_id") % 3)
    return rules.any_sum(rows, ["ex"], "pos", 3, [(0, 1), (1, 2)]).select("ex", "s", r6("prob").alias("prob"))


@query
def addition_same_image(spark, d):
    """Both literals read one image: one variable, so only even sums are possible."""
    digit = _digits(spark, d).withColumn("ex", F.col("vec_id"))
    both = [(rules.literal(digit, n, ["ex"], "vec_id"), n) for n in "ab"]
    return rules.derive(rules.conjunction(both, ["ex"]), ["ex"], {"s": F.col("a") + F.col("b")}).select("ex", "s", r6("prob").alias("prob"))


@query
def number_dist(spark, d):
    rows = _digits(spark, d).withColumn("ex", F.expr("vec_id div 2"))
    parts = [rows.filter(F.col("vec_id") % 2 == i).select("ex", "value", "prob") for i in (0, 1)]
    return rules.number(parts, ["ex"]).select("ex", "number", r6("prob").alias("prob"))


@query
def multi_addition_ground(spark, d):
    g = facts.groups(_dist(spark, d), 4)
    target = ((F.col("l0") + F.col("l2")) * 10 + F.col("l1") + F.col("l3")).cast("long")
    p = rules.ground_sum([F.col("p0"), F.col("p1")], [F.col("p2"), F.col("p3")], target)
    return g.select("ex", target.alias("target"), F.round(p, 9).alias("prob"))


@query
def gradient_sum(spark, d):
    return rules.gradients(_pairs(spark, d), ["ex"]).select("ex", "s", "a", r6("grad").alias("grad"))


@query
def freq_sum_lineitem(spark, d):
    """Facts from frequencies: discount plus tax, in hundredths, within buckets of parts."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_partkey") % 100).alias("ex"), F.round(F.col("l_discount") * 100).cast("int").alias("x"), F.round(F.col("l_tax") * 100).cast("int").alias("y"))
    first, second = (facts.frequencies(rows, [F.col("ex")], F.col(c)) for c in "xy")
    parts = [(rules.literal(first, "a", ["ex"]), "a"), (rules.literal(second, "b", ["ex"]), "b")]
    out = rules.derive(rules.conjunction(parts, ["ex"]), ["ex"], {"s": F.col("a") + F.col("b")})
    return out.select("ex", "s", r6("prob").alias("prob"))


# Decoding, constraints, metrics


def _predictions(spark, d):
    return _dist(spark, d).select("vec_id", "label", S.argmax(F.col("probs")).alias("pred"))


@query
def argmax_pred(spark, d):
    return _predictions(spark, d)


@query
def accuracy(spark, d):
    return metrics.accuracy(_predictions(spark, d)).select(r6("accuracy").alias("accuracy"))


@query
def confusion_long(spark, d):
    return metrics.confusion(_predictions(spark, d))


@query
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(_predictions(spark, d), 10)


@query
def class_report(spark, d):
    return metrics.report(_predictions(spark, d)).select("class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def class_report_avgs(spark, d):
    return metrics.averages(metrics.report(_predictions(spark, d))).select("average", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query
def quality_report(spark, d):
    """The report of a real label table: quality against toxic."""
    rows = spark.read.parquet(f"{d}/labels.parquet").select(F.col("toxic").alias("pred"), F.col("quality").alias("label"))
    return metrics.report(rows).select("class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def ilp_fixed_sum(spark, d):
    g = _pairs(spark, d).withColumn("target", F.col("l0") + F.col("l1"))
    return infer.constrained(g, lambda a, b, s: s == F.col("target")).select("ex", "d0", "d1", "s", r6("score").alias("score"))


@query
def ilp_free_sum(spark, d):
    """The sum has a distribution of its own, here that of the next logits, and takes part in the score."""
    rows = facts.images(spark, d)
    sums = rows.select(F.expr("vec_id div 2").alias("ex"), S.softmax(F.transform(F.slice("embedding", 11, 19), lambda x: x.cast("double"))).alias("ps"), "vec_id").filter(F.col("vec_id") % 2 == 0).drop("vec_id")
    g = _pairs(spark, d).join(sums, "ex")
    return infer.constrained(g, lambda a, b, s: a + b == s, F.col("ps")).select("ex", "d0", "d1", "s", r6("score").alias("score"))


def _decoded(spark, d):
    """ex, method, d0, d1, s and the labels, by argmax (the sum decoded by itself) and under the fixed sum."""
    g = _pairs(spark, d).withColumn("target", F.col("l0") + F.col("l1"))
    # one pass: both methods of an example are made side by side and then become rows
    row = lambda name, d0, d1, s: F.struct(F.lit(name).alias("method"), d0.alias("d0"), d1.alias("d1"), s.alias("s"))
    plain = row("argmax", S.argmax(F.col("p0")), S.argmax(F.col("p1")), S.argmax(rules.sum_of_two()))
    ilp = S.let(infer.best_assignment(F.col("p0"), F.col("p1"), lambda a, b, s: s == F.col("target")), lambda b: row("ilp", b["d0"], b["d1"], b["s"]))
    return g.select("ex", "l0", "l1", "target", F.explode(F.array(plain, ilp)).alias("r")).select("ex", "l0", "l1", "target", "r.*")


@query
def predictions_long(spark, d):
    return _decoded(spark, d).select("ex", "method", "d0", "d1", "s")


@query
def constraint_satisfaction(spark, d):
    p = _decoded(spark, d)
    checks = C.sum_constraints(F.col("d0"), F.col("d1"), F.col("s"), F.col("target"))
    out = C.satisfaction(C.verify(p, checks, ["ex", "method"]), ["ex", "method"])
    return out.select("ex", "method", "satisfied", r6("if_satisfied").alias("if_satisfied"))


@query
def constraint_rates(spark, d):
    """Per method and constraint: share satisfied, and share where the antecedent holds (null if it never does)."""
    p = _decoded(spark, d)
    v = C.verify(p, C.sum_constraints(F.col("d0"), F.col("d1"), F.col("s"), F.col("target")), ["method"])
    return v.groupBy("method", "lc").agg(r6(F.avg("satisfied")).alias("satisfied"), r6(S.nanmean(F.col("if_satisfied"))).alias("if_satisfied"))


@query
def before_after_rates(spark, d):
    p = _decoded(spark, d)
    out = metrics.rates(p, (F.col("d0") == F.col("l0")) & (F.col("d1") == F.col("l1")), F.col("d0") + F.col("d1") == F.col("s"), ["method"])
    return out.select("method", r6("incorrect").alias("incorrect"), r6("unsatisfied").alias("unsatisfied"))


@query
def incorrect_pairs(spark, d):
    p = _decoded(spark, d).filter("method = 'argmax' AND (d0 <> l0 OR d1 <> l1)")
    return p.select("ex", "d0", "d1", "l0", "l1")


@query
def at_most_exactly(spark, d):
    """How many classes of each vector are above a threshold, as constraints see it."""
    flags = [F.get("probs", F.lit(i)) > 0.2 for i in range(10)]
    return _dist(spark, d).select("vec_id", C.count_of(flags).alias("n"), C.exactly(flags).alias("exactly_one"), C.at_most(flags).alias("at_most_one"))


@query
def mean_log_prob(spark, d):
    """Over all classes of all variables: both digits, and the sum, whose layer's outputs stand as scores."""
    g = _pairs(spark, d).select(F.transform("p0", lambda p: F.log(p)).alias("a"), F.transform("p1", lambda p: F.log(p)).alias("b"), S.log_softmax(rules.sum_of_two()).alias("c"))
    return g.select(F.explode(F.concat("a", "b", "c")).alias("p")).agg(r6(F.avg("p")).alias("mean_log_prob"))


@query
def resummed_digits(spark, d):
    """The sum of decoded digits, through their one-hot distributions."""
    p = _decoded(spark, d).filter("method = 'ilp'")
    return p.select("ex", S.argmax(S.antidiagonal_sums(S.one_hot(F.col("d0"), 10), S.one_hot(F.col("d1"), 10))).alias("s"))


# Rules as text

#: Clauses of the sum rules: digits of images, numbers as lists of digits, noise, and bags of pairs.
PROGRAM = """
nn(digit_net, [X], Y, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) :: digit(X, Y).
0.1 :: noisy.
%s.
sum(X, Y, Z) :- digit(X, A), digit(Y, B), Z is A + B.
sum_noisy(X, Y, Z) :- noisy, even(X, Y, Z).
sum_noisy(X, Y, Z) :- \\+ noisy, sum(X, Y, Z).
value([], V, V).
value([H | T], V, W) :- digit(H, D), U is D + 10 * V, value(T, U, W).
value(L, W) :- value(L, 0, W).
sum_any(L, Z) :- member([X, Y], L), sum(X, Y, Z).
""" % "; ".join(f"1/19 :: even(X, Y, {k})" for k in range(19))


def _program(spark, d) -> Program:
    return Program(PROGRAM).network("digit_net", lambda: _dist(spark, d))


def _bags(spark, d, n: int) -> DataFrame:
    """ex and the ids i0 to i{n - 1} of each n consecutive vectors."""
    first = facts.images(spark, d).select("vec_id").filter(F.col("vec_id") % n == 0)
    return first.select(F.expr(f"vec_id div {n}").alias("ex"), *[(F.col("vec_id") + i).alias(f"i{i}") for i in range(n)])


def _two_relations(spark, d) -> Program:
    rows = _digits(spark, d).withColumn("ex", F.expr("vec_id div 2"))
    out = Program("sum_2(a + b) :- digit_1(a), digit_2(b)", style="datalog")
    for i in (0, 1):
        out.relation(f"digit_{i + 1}", rows.filter(F.col("vec_id") % 2 == i), ["value"], context=["ex"], variable="vec_id")
    return out


@query
def rule_sum2(spark, d):
    return _two_relations(spark, d).query("sum_2(s)", keys=["ex"]).select("ex", "s", r6("prob").alias("prob"))


@query
def rule_sum2_dense(spark, d):
    layer = _two_relations(spark, d).forward("sum_2(s)", list(range(19)), keys=["ex"])
    return layer().select("ex", F.posexplode("probs").alias("s", "p")).select("ex", "s", r6("p").alias("prob"))


@query
def rule_best_first(spark, d):
    return _two_relations(spark, d).query("sum_2(s)", keys=["ex"], engine="approximate").select("ex", "s", r6("prob").alias("prob"))


@query
def rule_noisy(spark, d):
    return _program(spark, d).query("sum_noisy(I0, I1, S)", _bags(spark, d, 2), ["ex"]).select("ex", "s", r6("prob").alias("prob"))


@query
def rule_any_sum(spark, d):
    return _program(spark, d).query("sum_any([[I0, I1], [I1, I2]], S)", _bags(spark, d, 3), ["ex"]).select("ex", "s", r6("prob").alias("prob"))


@query
def rule_number(spark, d):
    return _program(spark, d).query("value([I0, I1], N)", _bags(spark, d, 2), ["ex"]).select("ex", F.col("n").cast("long").alias("number"), r6("prob").alias("prob"))


@query
def rule_same_image(spark, d):
    return _program(spark, d).query("sum(I0, I0, S)", _bags(spark, d, 1), ["ex"]).select("ex", "s", r6("prob").alias("prob"))


def _cnn(spark, d) -> DataFrame:
    params = networks.initial(networks.shapes("plain"), 1)
    return networks.predict(facts.images(spark, d), networks.plain_cnn(), params, 8)


@query
def rule_network(spark, d):
    """The sum rule over a convolutional network's predictions."""
    program = Program("nn(net, [X], Y, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) :: digit(X, Y). sum(X, Y, Z) :- digit(X, A), digit(Y, B), Z is A + B.").network("net", lambda: _cnn(spark, d))
    return program.query("sum(I0, I1, S)", _bags(spark, d, 2), ["ex"]).select("ex", "s", r6("prob").alias("prob"))


@query
def sensor_program(spark, d):
    """Images and pairs as concepts: digits by a learner, both over edges to the pair, the sum by a function of them."""
    graph = sensors.Graph()
    image = graph.concept("image", "vec_id")
    image["pixels"] = sensors.ReaderSensor("embedding")
    image["probs"] = sensors.ModuleLearner("pixels", lambda df, key, x: df.select(key, S.softmax(S.logits(F.col(x))).alias("probs")))
    image["digit"] = sensors.FunctionalSensor(("probs",), S.argmax)
    relate = lambda t: t.filter(F.col("vec_id") % 2 == 0).select(F.expr("vec_id div 2").alias("ex"), F.col("vec_id").alias("img0"), (F.col("vec_id") + 1).alias("img1"))
    pair = graph.concept("pair", "ex", sensors.JointSensor("image", relate))
    for i in (0, 1):
        pair[f"p{i}"] = sensors.EdgeSensor("image", f"img{i}", "probs")
        pair[f"d{i}"] = sensors.EdgeSensor("image", f"img{i}", "digit")
    pair["s"] = sensors.FunctionalSensor(("p0", "p1"), lambda a, b: S.argmax(S.antidiagonal_sums(a, b)))
    return graph.build({"image": facts.images(spark, d)})["pair"].select("ex", "d0", "d1", "s")


# Weak labels and losses


@query
def weak_labels(spark, d):
    t = facts.add_table(spark)
    n = Window.partitionBy("s")
    return t.select("s", F.col("a").alias("d"), r6(F.lit(1.0) / F.count("*").over(n)).alias("prob"))


@query
def joint_marginals(spark, d):
    """P(s) and P(d0, s) over all pairs of examples, from the joint distribution."""
    rows = _pairs(spark, d).select(F.posexplode("p0").alias("a", "pa"), "p1").select("a", "pa", F.posexplode("p1").alias("b", "pb"))
    joint = rows.groupBy("a", (F.col("a") + F.col("b")).alias("s")).agg(F.sum(F.col("pa") * F.col("pb")).alias("p"))
    return joint.select("a", "s", F.round("p", 5).alias("prob"), F.round(F.sum("p").over(Window.partitionBy("s")), 5).alias("prob_s"))


def _mean_loss(df, loss, name="loss"):
    return df.agg(r6(F.avg(loss)).alias(name), F.count("*").alias("n"))


def _targets(spark, d):
    return _pairs(spark, d).withColumn("target", F.col("l0") + F.col("l1")).withColumn("ps", rules.sum_of_two())


@query
def bce_loss(spark, d):
    return _mean_loss(_targets(spark, d), losses.bce(F.col("ps"), F.col("target")))


@query
def nll_loss(spark, d):
    return _mean_loss(_targets(spark, d), losses.nll(F.col("ps"), F.col("target")))


@query
def cross_entropy_loss(spark, d):
    return _mean_loss(_dist(spark, d), losses.cross_entropy(F.col("probs"), F.col("label")))


@query
def semantic_loss(spark, d):
    return _mean_loss(_targets(spark, d), losses.semantic(F.col("p0"), F.col("p1"), F.col("target")))


@query
def soft_ce_loss(spark, d):
    rows = facts.images(spark, d).withColumn("z", S.logits(F.col("embedding")))
    truth = F.transform(S.one_hot(F.col("label"), 10), lambda t: t * 0.9 + 0.01)
    return _mean_loss(rows, losses.soft_cross_entropy(F.col("z"), truth, 0.5))


@query
def masked_bce_loss(spark, d):
    rows = _dist(spark, d)
    return _mean_loss(rows, losses.masked_bce(F.col("probs"), S.one_hot(F.col("label"), 10), S.one_hot(S.argmax(F.col("probs")), 10), 0.1))


@query
def sampling_loss(spark, d):
    g = _targets(spark, d)
    return g.select("ex", r6(losses.sampled(F.col("p0"), F.col("p1"), F.col("target"), F.col("ex"), 100)).alias("loss"))


@query
def primal_dual_loss(spark, d):
    g = _targets(spark, d)
    violation = 1 - F.get("ps", F.col("target"))
    return _mean_loss(g, losses.primal_dual(losses.cross_entropy(F.col("p0"), F.col("l0")), violation, 0.7))


# Datasets


@query
def hash_shuffle_pairs(spark, d):
    return D.shuffled_pairs(facts.images(spark, d), SEED)


@query
def shuffled_batches(spark, d):
    return D.batches(D.shuffled_rank(facts.images(spark, d), SEED), 16).select("vec_id", "rn", "batch")


@query
def sample_exact_n(spark, d):
    return D.sample_exact(facts.images(spark, d), 100, SEED).select("vec_id", "label")


@query
def subset_n_plus_1(spark, d):
    return D.subset(facts.images(spark, d), 8, [0, 2, 4]).select("vec_id", "label")


@query
def split_ranges(spark, d):
    img = facts.images(spark, d)
    parts = D.readers(img, *D.shares(img.count()))
    rows = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("part"), "vec_id", "label")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"), F.sum("label").cast("long").alias("labels"))


@query
def sampler_in_order(spark, d):
    return D.in_order(facts.images(spark, d), [7, 3, 99, 3, 42]).select("pos", "vec_id", "label")


@query
def image_lookup(spark, d):
    img = facts.images(spark, d)
    wanted = spark.range(0, img.agg(F.max("vec_id")).first()[0] + 1, 7).select(F.col("id").alias("vec_id"))
    return D.lookup(img, wanted).select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("first"))


@query
def ground_queries(spark, d):
    return D.queries_of(facts.images(spark, d))


def _examples(spark, d):
    return D.addition(facts.images(spark, d), 2)[1]


@query
def operator_dataset(spark, d):
    e = _examples(spark, d)
    return e.select("ex", F.array_join(F.transform(F.flatten("args"), lambda x: x.cast("string")), ",").alias("args"), "expected")


@query
def operator_dataset_products(spark, d):
    e = D.operator_examples(facts.images(spark, d), 1, 3, lambda a, x: a * x, seed=SEED)
    return e.select("ex", F.array_join(F.transform(F.flatten("args"), lambda x: x.cast("string")), ",").alias("args"), "expected")


@query
def dataset_json(spark, d):
    e = _examples(spark, d)
    back = F.from_json(F.to_json("args"), "array<array<bigint>>")
    return e.select("ex", D.example_json(e).alias("json"), F.size(back).alias("groups"))


@query
def dataset_lines(spark, d):
    e = _examples(spark, d)
    return e.select("ex", D.example_line(e).alias("line"))


@query
def proposed_sums(spark, d):
    return D.proposals(spark, 500, SEED)


@query
def balanced_sum_sample(spark, d):
    return D.balanced_pairs(facts.images(spark, d), D.proposals(spark, 60, SEED), SEED, strict=False)


@query
def proposal_histogram(spark, d):
    return D.histogram(D.proposals(spark, 500, SEED), F.col("s"), 19)


@query
def digit_histogram(spark, d):
    return D.histogram(facts.images(spark, d), F.col("label"), 12)


@query
def distribution_text(spark, d):
    h = D.histogram(facts.images(spark, d), F.col("label"), 10)
    counts = h.agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("c"))
    return counts.select(S.counts_text(F.transform("c", lambda r: r["n"])).alias("text"))


@query
def bucket_lists(spark, d):
    return D.buckets(facts.images(spark, d)).select("label", F.size("ids").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query
def records(spark, d):
    """Pair records: pixels of both, the sum as a list of lists, the digits, the flag for evaluation."""
    g = facts.images(spark, d).withColumn("ex", F.expr("vec_id div 2"))
    at = lambda i, c: F.max(F.when(F.col("vec_id") % 2 == i, F.col(c)))
    g = g.groupBy("ex").agg(at(0, "embedding").alias("x0"), at(1, "embedding").alias("x1"), at(0, "label").alias("d0"), at(1, "label").alias("d1"))
    r = F.struct(F.array("x0", "x1").alias("pixels"), F.array(F.array(F.col("d0") + F.col("d1"))).alias("summation"), F.array("d0", "d1").alias("digit"), (F.col("ex") % 2 == 0).alias("eval"))
    r = g.select("ex", r.alias("r"))
    return r.select("ex", F.size("r.pixels").alias("images"), F.size(F.flatten("r.pixels")).alias("values"), F.get(F.get("r.summation", F.lit(0)), F.lit(0)).alias("s"), F.get("r.digit", F.lit(0)).alias("d0"), F.col("r.eval").alias("eval"))


# Scalars


@query
def normalised_pixels(spark, d):
    x = facts.images(spark, d).select("vec_id", S.normalise(F.col("embedding"), 0.1307, 0.3081).alias("x"))
    return x.select("vec_id", F.round(S.total(F.col("x")), 4).alias("total"), F.round(F.get("x", F.lit(0)), 5).alias("first"))


@query
def one_hot_labels(spark, d):
    return facts.images(spark, d).select("vec_id", F.posexplode(S.one_hot(F.col("label"), 10)).alias("value", "flag"))


@query
def digits_as_numbers(spark, d):
    e = _examples(spark, d).select("ex", F.explode(F.transform("digits", S.digits_to_number)).alias("number"))
    return e.groupBy("ex").agg(F.min("number").alias("least"), F.max("number").alias("most"), F.sum(F.expr("number div 10")).alias("tens"), F.sum(F.col("number") % 10).alias("units"))


@query
def distribution_distance(spark, d):
    g = _targets(spark, d)
    return g.select("ex", r6(S.distance(F.col("ps"), S.one_hot(F.col("target"), 19))).alias("distance"))


@query
def clamped_logits(spark, d):
    z = facts.images(spark, d).select("vec_id", F.posexplode(S.logits(F.col("embedding"))).alias("value", "z"))
    return z.select("vec_id", "value", r6(S.clamp(F.col("z"), 1e-5, 1 - 1e-5)).alias("z"))


# Graph, sets, parameters


@query
def addition_table(spark, d):
    return facts.add_table(spark)


@query
def relation_paths(spark, d):
    """Pair to image to label, by both edges, and back from an image to its pair."""
    img = facts.images(spark, d)
    pair = img.filter(F.col("vec_id") % 2 == 0).select(F.expr("vec_id div 2").alias("ex"), F.col("vec_id").alias("img0"), (F.col("vec_id") + 1).alias("img1"))
    out = pair.join(img.select(F.col("vec_id").alias("img0"), F.col("label").alias("l0")), "img0").join(img.select(F.col("vec_id").alias("img1"), F.col("label").alias("l1")), "img1")
    back = pair.select(F.explode(F.array("img0", "img1")).alias("img"), F.col("ex").alias("of"))
    return out.join(back.select(F.col("img").alias("img1"), "of"), "img1").select("ex", "img0", "img1", "l0", "l1", "of")


@query
def pair_semi(spark, d):
    valid = facts.add_table(spark).filter("s IN (3, 9, 17)").select(F.col("a").alias("d0"), F.col("b").alias("d1")).distinct()
    p = infer.argmax_digits(_pairs(spark, d))
    return p.join(F.broadcast(valid), ["d0", "d1"], "left_semi").select("ex", "d0", "d1")


@query
def enum_domains(spark, d):
    digits = spark.range(10).select(F.concat(F.lit("d0_"), F.col("id").cast("string")).alias("name"), F.col("id").cast("int").alias("value"))
    sums = spark.range(19).select(F.concat(F.lit("s_"), F.col("id").cast("string")).alias("name"), F.col("id").cast("int").alias("value"))
    return digits.unionByName(sums)


def _named_parameters(spark, d):
    """Vectors as parameters: name, values."""
    return facts.images(spark, d).select(F.concat(F.lit("layer"), (F.col("vec_id") % 7).cast("string"), F.when(F.col("vec_id") % 2 == 0, ".weight").otherwise(".bias")).alias("name"), "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("value"))


@query
def param_anti(spark, d):
    return tables.drop_named(_named_parameters(spark, d), ["layer1.weight", "layer1.bias", "layer2.weight", "layer2.bias"]).select("name", "vec_id")


@query
def param_exclude_join(spark, d):
    gone = spark.range(3).select(F.concat(F.lit("layer"), F.col("id").cast("string"), F.lit(".bias")).alias("name"))
    return rules.absent(_named_parameters(spark, d), gone, ["name"]).filter(F.col("name").endswith("bias")).select("name", "vec_id")


@query
def param_delta_norm(spark, d):
    rows = facts.images(spark, d).select("vec_id", F.posexplode("embedding").alias("at", "v"))
    at = lambda i: F.max(F.when(F.col("vec_id") % 2 == i, F.col("v").cast("double")))
    pairs = rows.groupBy(F.expr("vec_id div 2").alias("ex"), "at").agg(at(0).alias("x"), at(1).alias("y"))
    return metrics.delta_norm(pairs, "x", "y").select(F.round("norm", 5).alias("norm"))


@query
def hyper_grid(spark, d):
    """An axis is one partition made by the engine: a cross join has a task for each combination of its sides' partitions, and a list from Python has a partition for each core."""
    axis = lambda name, kind, values: spark.range(0, 1, 1, 1).select(F.explode(F.array(*map(F.lit, values)).cast(f"array<{kind}>")).alias(name))
    return axis("iters", "long", [10, 50, 100]).crossJoin(axis("lr", "double", [0.01, 0.1, 1.0])).crossJoin(axis("reg", "double", [0.01, 0.1, 1.0])).crossJoin(axis("samples", "long", [100]))


# Logs of runs


def _log(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select((F.col("event_id") % 200).alias("epoch"), F.col("event_type").alias("method"), F.col("value").alias("loss"))


@query
def best_epoch(spark, d):
    per = _log(spark, d).groupBy("epoch").agg(F.round(F.avg("loss"), 9).alias("loss"))
    return tables.best_epoch(per).select("epoch", r6("loss").alias("loss"))


@query
def running_best(spark, d):
    per = _log(spark, d).groupBy("epoch").agg(F.avg("loss").alias("loss"))
    w = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return per.select("epoch", r6("loss").alias("loss"), r6(F.min("loss").over(w)).alias("best"))


@query
def epoch_means(spark, d):
    return _log(spark, d).groupBy("method").agg(r6(F.avg("loss")).alias("mean"), r6(F.min("loss")).alias("least"), F.count("*").alias("n"))


@query
def every_kth(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").filter(F.col("event_id") % 50 == 0).select("event_id", "event_type", r6("value").alias("value"))


@query
def windowed_events(spark, d):
    """The batch form of the streaming extension's windows."""
    e = spark.read.parquet(f"{d}/events.parquet").groupBy(F.date_trunc("hour", "ts").alias("window_start"), "event_type")
    return e.agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean")).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "mean")


# Iterative operators and networks: rows only


def _vector_pairs(spark, d):
    rows = facts.images(spark, d).withColumn("ex", F.expr("vec_id div 2"))
    at = lambda i, c: F.max(F.when(F.col("vec_id") % 2 == i, F.col(c)))
    g = rows.groupBy("ex").agg(at(0, "embedding").alias("x0"), at(1, "embedding").alias("x1"), at(0, "label").alias("d0"), at(1, "label").alias("d1"))
    return g.filter("d1 IS NOT NULL").withColumn("s", F.col("d0") + F.col("d1"))


@query
def gbi_refine(spark, d):
    return infer.refine(_vector_pairs(spark, d), infer.initial_parameters(64))


@query
def gbi_refine_in_sequence(spark, d):
    """Sequences of 32 pairs: their number grows with the table."""
    return infer.refine_in_sequence(_vector_pairs(spark, d).withColumn("part", F.expr("ex div 32")), infer.initial_parameters(64))


@query
def gbi_training(spark, d):
    """Two rounds of learning by refinement, with the weights saved after each and read back: round, pairs, satisfied, and
    the norm of the saved weights."""
    folder = tables.scratch(spark, "gbi")
    pairs = _vector_pairs(spark, d).withColumn("part", F.expr("ex div 32"))
    _, log = infer.learn_by_refining(pairs, infer.initial_parameters(64), rounds=2, steps=20, interval=1, save=lambda n, w: tables.save_epoch(spark, folder, n, {"task": w}))
    norms = tables.epochs(spark, folder, ["task"]).select("epoch", F.explode("values").alias("v")).groupBy(F.col("epoch").alias("round")).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return spark.createDataFrame(log, "round int, pairs long, satisfied long").join(norms, "round")


def _training_log(spark, log):
    return spark.createDataFrame([(m, e.number, e.loss, e.violation, e.multiplier) for m, es in log for e in es], "method string, epoch int, loss double, violation double, multiplier double")


@query
def train_linear_head(spark, d):
    return _training_log(spark, [("semantic", training.train(_vector_pairs(spark, d), 64, training.semantic, training.Adam(0.01), 2)[1])])


@query
def train_programs(spark, d):
    """Epochs of the other programs: dual ascent with a task loss, drawn assignments, weak digit labels, true digit
    labels, the explicit sum."""
    pairs = _vector_pairs(spark, d)
    programs = {"primal_dual": training.primal_dual(training.digit_labels, 0.1), "sampling": training.sampling(100), "digit_labels": training.digit_labels, "supervised": training.supervised, "explicit_sum": training.explicit_sum}
    return _training_log(spark, [(m, training.train(pairs, 64, f, training.Adam(0.01), 2, multiplier_rate=0.1 * (m == "primal_dual"))[1]) for m, f in programs.items()])


@query
def training_evaluation(spark, d):
    """What an evaluation after every second epoch logs, on training and validation pairs."""
    pairs = _vector_pairs(spark, d)
    check = training.Evaluation(2, True, pairs.filter("ex % 5 = 0"), {"accuracy": metrics.accuracy_of, "macro_f1": metrics.macro_f1_of})
    training.train(pairs.filter("ex % 5 <> 0"), 64, training.supervised, training.Adam(0.01), 2, evaluation=check)
    return spark.createDataFrame(check.log, "epoch int, pairs string, tracker string, value double")


@query
def few_shot_sweep(spark, d):
    images = facts.images(spark, d).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), "label")
    return spark.createDataFrame(training.few_shot(images), "n int, accuracy double")


@query
def network_predict(spark, d):
    """A small convolutional classifier with given parameters, on vectors as 8 * 8 images."""
    return _cnn(spark, d).select("vec_id", S.argmax(F.col("probs")).alias("pred"), r6(S.total(F.col("probs"))).alias("total"))


@query
def network_layer_times(spark, d):
    return networks.layer_times(facts.images(spark, d), networks.plain_cnn(), networks.initial(networks.shapes("plain"), 1), 8)


@query
def composed_canvases(spark, d):
    rows = facts.images(spark, d).withColumn("ex", F.expr("vec_id div 2")).groupBy("ex").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("m"))
    rows = rows.select(F.col("ex").alias("key"), F.transform("m", lambda r: r["embedding"]).alias("parts"))
    return D.canvases(rows).select("key", F.size("pixels").alias("n"), F.round(F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total"))


# Written and read back


def _some_arrays(spark, d, ids) -> dict:
    rows = facts.images(spark, d).filter(F.col("vec_id").isin(list(ids))).orderBy("vec_id").collect()
    return {f"layer{r['vec_id']}.weight": np.array(r["embedding"], float).reshape(8, 8) for r in rows}


@query
def parameters_saved(spark, d):
    """Five vectors as parameters, saved, and loaded less one of them."""
    path = tables.scratch(spark, "parameters")
    tables.save_parameters(spark, _some_arrays(spark, d, range(5)), path)
    return tables.parameters(spark, path, ["layer2.weight"]).select("name", F.size("shape").alias("axes"), F.size("values").alias("n"), F.round(S.total(F.col("values")), 4).alias("total"))


@query
def checkpoints_saved(spark, d):
    """Epochs of a task's and a constraint's parameters; epoch 1 is saved twice, the second time counts."""
    folder = tables.scratch(spark, "checkpoints")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)
        for epoch, i in ((0, 0), (1, 1), (2, 2), (1, 3)):
            tables.save_epoch(spark, folder, epoch, {"task": _some_arrays(spark, d, [i]), "constraints": _some_arrays(spark, d, [i + 10])})
    return tables.epochs(spark, folder, ["task", "constraints"]).select("epoch", "model", "name", F.round(S.total(F.col("values")), 4).alias("total"))


@query
def accuracies_saved(spark, d):
    """Accuracy by label, as tab-separated lines and back."""
    path = tables.scratch(spark, "accuracies")
    hit = (F.col("pred") == F.col("label")).cast("double")
    tables.write_tsv(_predictions(spark, d).groupBy("label").agg(r6(F.avg(hit)).alias("accuracy"), F.count("*").alias("n")), path)
    return tables.read_tsv(spark, path, "label int, accuracy double, n long")


__all__ = ["oracle_sql", "queries"]
