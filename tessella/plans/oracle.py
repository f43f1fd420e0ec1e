"""For each query of the catalog that SQL can express, SQL that gives the same rows. Written apart from the engine: rules
are spelled out as joins over all assignments, so that a shared mistake is unlikely."""

from __future__ import annotations

_Z = "z AS (SELECT vec_id, label, unnest(range(10)) AS v, CAST(unnest(embedding[1:10]) AS DOUBLE) AS x FROM embeddings)"
_DIGIT = f"""{_Z},
ez AS (SELECT vec_id, label, v, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM z),
digit AS (SELECT vec_id, label, CAST(v AS INTEGER) AS value, e / sum(e) OVER (PARTITION BY vec_id) AS prob FROM ez)"""
_PAIR = f"""{_DIGIT},
pair AS (SELECT a.vec_id // 2 AS ex, a.value AS a, b.value AS b, a.prob AS pa, b.prob AS pb, a.label AS l0, b.label AS l1
  FROM digit a JOIN digit b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1)"""
_SUM = f"{_PAIR},\nsums AS (SELECT ex, a + b AS s, l0 + l1 AS target, any_value(l0) AS l0, any_value(l1) AS l1, sum(pa * pb) AS p FROM pair GROUP BY ex, a + b, l0 + l1)"
_PRED = f"{_DIGIT},\npred AS (SELECT vec_id, label, arg_max(value, (prob, -value)) AS pred FROM digit GROUP BY vec_id, label)"
_DECODED = f"""{_SUM},
d0 AS (SELECT ex, arg_max(a, (pa, -a)) AS d0 FROM (SELECT DISTINCT ex, a, pa FROM pair) GROUP BY ex),
d1 AS (SELECT ex, arg_max(b, (pb, -b)) AS d1 FROM (SELECT DISTINCT ex, b, pb FROM pair) GROUP BY ex),
ds AS (SELECT ex, arg_max(s, (p, -s)) AS s FROM sums GROUP BY ex),
labels_ AS (SELECT DISTINCT ex, l0, l1, l0 + l1 AS target FROM pair),
ranked AS (SELECT ex, a, b, ln(pa) + ln(pb) AS score, row_number() OVER (PARTITION BY ex ORDER BY ln(pa) + ln(pb) DESC, a, b) AS nth FROM pair WHERE a + b = l0 + l1),
decoded AS (
  SELECT ex, 'argmax' AS method, d0, d1, s FROM d0 JOIN d1 USING (ex) JOIN ds USING (ex)
  UNION ALL SELECT ex, 'ilp', a, b, a + b FROM ranked WHERE nth = 1),
full_ AS (SELECT * FROM decoded JOIN labels_ USING (ex))"""
_REPORT = """classes AS (SELECT pred AS class FROM pred UNION SELECT label FROM pred),
counted AS (SELECT class, (SELECT count(*) FROM pred WHERE label = class AND pred = class) AS hit, (SELECT count(*) FROM pred WHERE pred = class) AS given, (SELECT count(*) FROM pred WHERE label = class) AS support FROM classes),
pr AS (SELECT class, CASE WHEN given > 0 THEN hit / given ELSE 0.0::DOUBLE END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0.0::DOUBLE END AS r, support FROM counted),
report AS (SELECT class, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END AS f1, support FROM pr)"""
_RANK = "ranked AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5('11:' || vec_id), vec_id) - 1 AS rn FROM embeddings)"
_LC = """checks AS (
  SELECT ex, method, 'digits' AS lc, d0 BETWEEN 0 AND 9 AND d1 BETWEEN 0 AND 9 AS ok, TRUE AS applies FROM full_
  UNION ALL SELECT ex, method, 'sums', s BETWEEN 0 AND 18, TRUE FROM full_
  UNION ALL SELECT ex, method, 'fixed', s = target, TRUE FROM full_
  UNION ALL SELECT ex, method, 'sum_' || k, d0 + d1 = k, s = k FROM full_, range(19) t(k)),
verified AS (SELECT *, CASE WHEN ok OR NOT applies THEN 100.0::DOUBLE ELSE 0.0 END AS satisfied, CASE WHEN applies THEN CASE WHEN ok THEN 100.0::DOUBLE ELSE 0.0 END END AS if_satisfied FROM checks)"""
_EXAMPLES = """m AS (SELECT vec_id // 4 AS ex, list(vec_id ORDER BY vec_id) AS v, list(label ORDER BY vec_id) AS l FROM embeddings GROUP BY 1 HAVING count(*) = 4)"""
_PROPOSALS = """p0 AS (SELECT range AS req, CAST(('0x' || substr(md5('11:s:' || range), 1, 8)) AS BIGINT) % 19 AS s, CAST(('0x' || substr(md5('11:d:' || range), 1, 8)) AS BIGINT) AS u FROM range({n})),
p1 AS (SELECT req, CAST(s AS INTEGER) AS s, CAST(greatest(0, s - 9) + u % (least(s, 9) - greatest(0, s - 9) + 1) AS INTEGER) AS d0 FROM p0),
proposals AS (SELECT req, s, d0, s - d0 AS d1 FROM p1)"""
_LOG = "log_ AS (SELECT event_id % 200 AS epoch, event_type AS method, value AS loss FROM events)"



def _numbers(name: str, columns: str, array) -> str:
    """A table of an array's values by their places."""
    import numpy as np

    rows = ", ".join("(" + ", ".join([*map(str, at), f"{float(v)!r}::DOUBLE"]) + ")" for at, v in np.ndenumerate(array))
    return f"{name}({columns}) AS (VALUES {rows})"


def _cnn() -> str:
    """The plain network of the catalog: kernels of 2 by 2 over 8 by 8 images, pools of 2, two linear layers."""
    from tessella.operators import networks

    w = networks.initial(networks.shapes("plain"), 1)
    parts = [_numbers("w1", "o, ch, i, j, w", w["conv1.weight"]), _numbers("b1", "o, b", w["conv1.bias"]), _numbers("w2", "o, ch, i, j, w", w["conv2.weight"]), _numbers("b2", "o, b", w["conv2.bias"])]
    parts += [_numbers("w3", "o, x, w", w["fc1.weight"]), _numbers("b3", "o, b", w["fc1.bias"]), _numbers("w4", "o, x, w", w["fc2.weight"]), _numbers("b4", "o, b", w["fc2.bias"])]
    parts += ["px AS (SELECT vec_id, 0 AS ch, i // 8 AS r, i % 8 AS c, v FROM (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))"]
    for n, source, last in ((1, "px", 6), (2, "m1", 1)):
        parts += [f"c{n} AS (SELECT vec_id, o, p.r - i AS r, p.c - j AS c, sum(v * w) + any_value(b) AS v FROM {source} p JOIN w{n} USING (ch) JOIN b{n} USING (o) WHERE p.r - i BETWEEN 0 AND {last} AND p.c - j BETWEEN 0 AND {last} GROUP BY 1, 2, 3, 4)"]
        parts += [f"m{n} AS (SELECT vec_id, o AS ch, r // 2 AS r, c // 2 AS c, max(v) AS v FROM c{n} WHERE r < {(last + 1) // 2 * 2} AND c < {(last + 1) // 2 * 2} GROUP BY 1, 2, 3, 4)"]
    parts += ["h AS (SELECT vec_id, w3.o AS x, greatest(sum(v * w) + any_value(b), 0) AS v FROM m2 JOIN w3 ON w3.x = m2.ch JOIN b3 ON b3.o = w3.o GROUP BY vec_id, w3.o)"]
    parts += ["z AS (SELECT vec_id, w4.o AS k, sum(v * w) + any_value(b) AS x FROM h JOIN w4 ON w4.x = h.x JOIN b4 ON b4.o = w4.o GROUP BY vec_id, w4.o)"]
    return ",\n".join([*parts, "e AS (SELECT vec_id, k, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM z)", "cnn AS (SELECT vec_id, CAST(k AS INTEGER) AS value, e / sum(e) OVER (PARTITION BY vec_id) AS prob FROM e)"])


_SUM2 = f"WITH {_PAIR} SELECT ex, a + b AS s, round({{agg}}, 6) AS prob FROM pair GROUP BY ex, a + b"
_TOPK = f"""WITH {_PAIR}, proofs AS (SELECT ex, a + b AS s, pa * pb AS p, row_number() OVER (PARTITION BY ex, a + b ORDER BY pa * pb DESC, a) AS nth FROM pair)
SELECT ex, s, round({{agg}}, 6) AS prob FROM proofs WHERE nth <= {{k}} GROUP BY ex, s"""

SQL = {
    "softmax_dist": f"WITH {_DIGIT} SELECT vec_id, value, round(prob, 6) AS prob FROM digit",
    "log_softmax_dist": f"WITH {_DIGIT} SELECT vec_id, value, round(ln(prob), 6) AS log_prob FROM digit",
    "to_arrays_round_trip": f"WITH {_PRED} SELECT vec_id, CAST(10 AS INTEGER) AS n, CAST(1.0 AS DOUBLE) AS total, pred FROM pred",
    "sum2_exclusive": _SUM2.format(agg="sum(pa * pb)"),
    "sum2_dense_array": _SUM2.format(agg="sum(pa * pb)"),
    "sum2_noisy_or": _SUM2.format(agg="1 - exp(sum(ln(1 - pa * pb)))"),
    "sum2_max_prod": _SUM2.format(agg="max(pa * pb)"),
    "sum2_topk3_exclusive": _TOPK.format(agg="sum(p)", k=3),
    "sum2_topk3_noisy_or": _TOPK.format(agg="1 - exp(sum(ln(1 - p)))", k=3),
    "sum2_best_first": _TOPK.format(agg="sum(p)", k=1),
    "outer_product": f"WITH {_PAIR} SELECT ex, a, b, round(pa * pb, 6) AS prob FROM pair",
    "sum2_noisy": f"WITH {_SUM} SELECT ex, s, round(0.1::DOUBLE / 19 + 0.9::DOUBLE * p, 6) AS prob FROM sums",
    "sum2_noisy_union": f"WITH {_SUM} SELECT ex, s, round(0.1::DOUBLE / 19 + 0.9::DOUBLE * p, 6) AS prob FROM sums",
    "sum_of_three": f"""WITH {_DIGIT} SELECT a.vec_id // 3 AS ex, a.value + b.value + c.value AS s, round(sum(a.prob * b.prob * c.prob), 6) AS prob
FROM digit a JOIN digit b ON a.vec_id % 3 = 0 AND b.vec_id = a.vec_id + 1 JOIN digit c ON c.vec_id = a.vec_id + 2 GROUP BY 1, 2""",
    "addition_ground": f"WITH {_SUM} SELECT ex, target, round(p, 6) AS prob FROM sums WHERE s = target",
    "fact_accuracy": f"WITH {_SUM} SELECT round(1 - avg(abs(1 - p)), 6) AS fact_accuracy FROM sums WHERE s = target",
    "all_digit_addition": f"""WITH {_DIGIT} SELECT a.vec_id // 3 AS ex, c.value AS z, round(sum(a.prob * b.prob * c.prob), 6) AS prob
FROM digit a JOIN digit b ON a.vec_id % 3 = 0 AND b.vec_id = a.vec_id + 1 JOIN digit c ON c.vec_id = a.vec_id + 2 AND c.value = a.value + b.value GROUP BY 1, 2""",
    "any_sum_disjoint": f"""WITH {_SUM}, bag AS (SELECT x.ex // 2 AS ex, x.s AS s1, y.s AS s2, x.p * y.p AS p FROM sums x JOIN sums y ON x.ex % 2 = 0 AND y.ex = x.ex + 1)
SELECT ex, s, round(sum(p), 6) AS prob FROM (SELECT ex, s1 AS s, p FROM bag UNION ALL SELECT ex, s2, p FROM bag WHERE s1 <> s2) GROUP BY ex, s""",
    "any_sum_shared": f"""WITH {_DIGIT}, world AS (SELECT a.vec_id // 3 AS ex, a.value + b.value AS s1, b.value + c.value AS s2, a.prob * b.prob * c.prob AS p
FROM digit a JOIN digit b ON a.vec_id % 3 = 0 AND b.vec_id = a.vec_id + 1 JOIN digit c ON c.vec_id = a.vec_id + 2)
SELECT ex, s, round(sum(p), 6) AS prob FROM (SELECT ex, s1 AS s, p FROM world UNION ALL SELECT ex, s2, p FROM world WHERE s1 <> s2) GROUP BY ex, s""",
    "addition_same_image": f"WITH {_DIGIT} SELECT vec_id AS ex, value + value AS s, round(prob, 6) AS prob FROM digit",
    "number_dist": f"WITH {_PAIR} SELECT ex, CAST(10 * a + b AS BIGINT) AS number, round(pa * pb, 6) AS prob FROM pair",
    "multi_addition_ground": f"""WITH {_PAIR}, n AS (SELECT ex, 10 * a + b AS number, 10 * l0 + l1 AS truth, pa * pb AS p FROM pair)
SELECT x.ex // 2 AS ex, CAST(x.truth + y.truth AS BIGINT) AS target, round(sum(CASE WHEN x.number + y.number = x.truth + y.truth THEN x.p * y.p ELSE 0 END), 9) AS prob
FROM n x JOIN n y ON x.ex % 2 = 0 AND y.ex = x.ex + 1 GROUP BY 1, 2""",
    "gradient_sum": f"WITH {_PAIR} SELECT ex, a + b AS s, a, round(pb, 6) AS grad FROM pair",
    "freq_sum_lineitem": """WITH r AS (SELECT l_partkey % 100 AS ex, CAST(round(l_discount * 100) AS INTEGER) AS x, CAST(round(l_tax * 100) AS INTEGER) AS y FROM lineitem),
n AS (SELECT ex, count(*) AS n FROM r GROUP BY ex),
fx AS (SELECT ex, x, count(*) / any_value(n) AS p FROM r JOIN n USING (ex) GROUP BY ex, x), fy AS (SELECT ex, y, count(*) / any_value(n) AS p FROM r JOIN n USING (ex) GROUP BY ex, y)
SELECT fx.ex, x + y AS s, round(sum(fx.p * fy.p), 6) AS prob FROM fx JOIN fy ON fx.ex = fy.ex GROUP BY fx.ex, x + y""",
    "argmax_pred": f"WITH {_PRED} SELECT vec_id, label, pred FROM pred",
    "accuracy": f"WITH {_PRED} SELECT round(avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy FROM pred",
    "confusion_long": f"WITH {_PRED} SELECT label, pred, count(*) AS n FROM pred GROUP BY label, pred",
    "confusion_matrix": f"WITH {_PRED} SELECT label, " + ", ".join(f'count(*) FILTER (pred = {i}) AS "{i}"' for i in range(10)) + " FROM pred GROUP BY label",
    "class_report": f"WITH {_PRED}, {_REPORT} SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM report",
    "class_report_avgs": f"""WITH {_PRED}, {_REPORT} SELECT 'macro' AS average, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f1), 6) AS f1 FROM report
UNION ALL SELECT 'weighted', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6) FROM report""",
    "quality_report": f"WITH pred AS (SELECT toxic AS pred, quality AS label FROM labels), {_REPORT} SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM report",
    "ilp_fixed_sum": f"WITH {_DECODED} SELECT ex, a AS d0, b AS d1, a + b AS s, round(score, 6) AS score FROM ranked WHERE nth = 1",
    "ilp_free_sum": f"""WITH {_PAIR}, y AS (SELECT vec_id // 2 AS ex, unnest(range(19)) AS s, CAST(unnest(embedding[11:29]) AS DOUBLE) AS x FROM embeddings WHERE vec_id % 2 = 0),
ey AS (SELECT ex, s, x - max(x) OVER (PARTITION BY ex) AS x FROM y), ly AS (SELECT ex, s, x - ln(sum(exp(x)) OVER (PARTITION BY ex)) AS lp FROM ey),
r AS (SELECT ex, a, b, ln(pa) + ln(pb) + lp AS score, row_number() OVER (PARTITION BY ex ORDER BY ln(pa) + ln(pb) + lp DESC, a, b) AS nth FROM pair JOIN ly USING (ex) WHERE s = a + b)
SELECT ex, a AS d0, b AS d1, a + b AS s, round(score, 6) AS score FROM r WHERE nth = 1""",
    "predictions_long": f"WITH {_DECODED} SELECT ex, method, d0, d1, s FROM decoded",
    "constraint_satisfaction": f"WITH {_DECODED}, {_LC} SELECT ex, method, CAST(floor(sum(satisfied) / 100) AS BIGINT) AS satisfied, round(avg(if_satisfied), 6) AS if_satisfied FROM verified GROUP BY ex, method",
    "constraint_rates": f"WITH {_DECODED}, {_LC} SELECT method, lc, round(avg(satisfied), 6) AS satisfied, round(avg(if_satisfied), 6) AS if_satisfied FROM verified GROUP BY method, lc",
    "before_after_rates": f"WITH {_DECODED} SELECT method, round(avg(CASE WHEN d0 = l0 AND d1 = l1 THEN 0.0::DOUBLE ELSE 1.0 END), 6) AS incorrect, round(avg(CASE WHEN d0 + d1 = s THEN 0.0::DOUBLE ELSE 1.0 END), 6) AS unsatisfied FROM full_ GROUP BY method",
    "incorrect_pairs": f"WITH {_DECODED} SELECT ex, d0, d1, l0, l1 FROM full_ WHERE method = 'argmax' AND (d0 <> l0 OR d1 <> l1)",
    "at_most_exactly": f"WITH {_DIGIT} SELECT vec_id, CAST(count(*) FILTER (prob > 0.2::DOUBLE) AS INTEGER) AS n, count(*) FILTER (prob > 0.2::DOUBLE) = 1 AS exactly_one, count(*) FILTER (prob > 0.2::DOUBLE) <= 1 AS at_most_one FROM digit GROUP BY vec_id",
    "mean_log_prob": f"""WITH {_SUM}, logs AS (SELECT ln(pa) AS p FROM (SELECT DISTINCT ex, a, pa FROM pair) UNION ALL SELECT ln(pb) FROM (SELECT DISTINCT ex, b, pb FROM pair)
  UNION ALL SELECT p - ln(sum(exp(p)) OVER (PARTITION BY ex)) FROM sums)
SELECT round(avg(p), 6) AS mean_log_prob FROM logs""",
    "resummed_digits": f"WITH {_DECODED} SELECT ex, CAST(d0 + d1 AS INTEGER) AS s FROM decoded WHERE method = 'ilp'",
    "rule_sum2": _SUM2.format(agg="sum(pa * pb)"),
    "rule_sum2_dense": _SUM2.format(agg="sum(pa * pb)"),
    "rule_best_first": _TOPK.format(agg="sum(p)", k=1),
    "rule_noisy": f"WITH {_SUM} SELECT ex, s, round(0.1::DOUBLE / 19 + 0.9::DOUBLE * p, 6) AS prob FROM sums",
    "rule_any_sum": f"""WITH {_DIGIT}, world AS (SELECT a.vec_id // 3 AS ex, a.value + b.value AS s1, b.value + c.value AS s2, a.prob * b.prob * c.prob AS p
FROM digit a JOIN digit b ON a.vec_id % 3 = 0 AND b.vec_id = a.vec_id + 1 JOIN digit c ON c.vec_id = a.vec_id + 2)
SELECT ex, s, round(sum(p), 6) AS prob FROM (SELECT ex, s1 AS s, p FROM world UNION ALL SELECT ex, s2, p FROM world WHERE s1 <> s2) GROUP BY ex, s""",
    "rule_number": f"WITH {_PAIR} SELECT ex, CAST(10 * a + b AS BIGINT) AS number, round(pa * pb, 6) AS prob FROM pair",
    "rule_same_image": f"WITH {_DIGIT} SELECT vec_id AS ex, value + value AS s, round(prob, 6) AS prob FROM digit",
    "rule_network": f"WITH {_cnn()} SELECT a.vec_id // 2 AS ex, a.value + b.value AS s, round(sum(a.prob * b.prob), 6) AS prob FROM cnn a JOIN cnn b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1 GROUP BY 1, 2",
    "network_predict": f"WITH {_cnn()} SELECT vec_id, arg_max(value, (prob, -value)) AS pred, round(sum(prob), 6) AS total FROM cnn GROUP BY vec_id",
    "sensor_program": f"WITH {_DECODED} SELECT ex, d0, d1, s FROM decoded WHERE method = 'argmax'",
    "composed_canvases": "WITH p AS (SELECT vec_id // 2 AS key, vec_id, unnest(embedding) AS v FROM embeddings) SELECT key, CAST(256 AS INTEGER) AS n, round(sum(CAST(v AS DOUBLE)) - (256 - count(*)), 3) AS total FROM p GROUP BY key",
    "parameters_saved": "WITH p AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE vec_id IN (0, 1, 3, 4)) SELECT 'layer' || vec_id || '.weight' AS name, CAST(2 AS INTEGER) AS axes, CAST(count(*) AS INTEGER) AS n, round(sum(v), 4) AS total FROM p GROUP BY vec_id",
    "checkpoints_saved": """WITH k(epoch, model, i) AS (VALUES (0, 'task', 0), (1, 'task', 3), (2, 'task', 2), (0, 'constraints', 10), (1, 'constraints', 13), (2, 'constraints', 12)),
p AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), t AS (SELECT vec_id, round(sum(v), 4) AS total FROM p GROUP BY vec_id)
SELECT CAST(epoch AS INTEGER) AS epoch, model, 'layer' || i || '.weight' AS name, total FROM k JOIN t ON t.vec_id = i""",
    "accuracies_saved": f"WITH {_PRED} SELECT label, round(avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM pred GROUP BY label",
    "weak_labels": "WITH t AS (SELECT CAST(a.range + b.range AS INTEGER) AS s, CAST(a.range AS INTEGER) AS d FROM range(10) a, range(10) b) SELECT s, d, round(1.0::DOUBLE / count(*) OVER (PARTITION BY s), 6) AS prob FROM t",
    "joint_marginals": f"WITH {_PAIR}, j AS (SELECT a, a + b AS s, sum(pa * pb) AS p FROM pair GROUP BY a, a + b) SELECT a, s, round(p, 5) AS prob, round(sum(p) OVER (PARTITION BY s), 5) AS prob_s FROM j",
    "bce_loss": f"WITH {_SUM}, l AS (SELECT ex, avg(CASE WHEN s = target THEN -greatest(ln(p), -100) ELSE -greatest(ln(1 - p), -100) END) AS loss FROM sums GROUP BY ex) SELECT round(avg(loss), 6) AS loss, count(*) AS n FROM l",
    "nll_loss": f"WITH {_SUM} SELECT round(avg(-p), 6) AS loss, count(*) AS n FROM sums WHERE s = target",
    "cross_entropy_loss": f"WITH {_DIGIT} SELECT round(avg(-ln(prob)), 6) AS loss, count(*) AS n FROM digit WHERE value = label",
    "semantic_loss": f"WITH {_SUM} SELECT round(avg(-ln(p)), 6) AS loss, count(*) AS n FROM sums WHERE s = target",
    "soft_ce_loss": f"""WITH {_Z}, c AS (SELECT vec_id, label, v, greatest(least(x, 1 - 1e-5), 1e-5) AS x FROM z), l AS (SELECT vec_id, label, v, x - ln(sum(exp(x)) OVER (PARTITION BY vec_id)) AS lp FROM c),
e AS (SELECT vec_id, 0.5::DOUBLE * sum(-lp * (CASE WHEN v = label THEN 0.91::DOUBLE ELSE 0.01::DOUBLE END)) AS loss FROM l GROUP BY vec_id) SELECT round(avg(loss), 6) AS loss, count(*) AS n FROM e""",
    "masked_bce_loss": f"""WITH {_PRED}, e AS (SELECT vec_id, CASE WHEN digit.value = digit.label THEN -greatest(ln(prob), -100) ELSE -greatest(ln(1 - prob), -100) END AS x, abs(prob - CASE WHEN value = pred THEN 1 ELSE 0 END) > 0.5::DOUBLE AS off_ FROM digit JOIN pred USING (vec_id)),
l AS (SELECT vec_id, 0.1::DOUBLE * sum(CASE WHEN off_ THEN x ELSE 0.0 END) / 10 AS loss FROM e GROUP BY vec_id) SELECT round(avg(loss), 6) AS loss, count(*) AS n FROM l""",
    "sampling_loss": f"""WITH {_DIGIT}, cum AS (SELECT vec_id, label, list(c ORDER BY value) AS c FROM (SELECT vec_id, label, value, sum(prob) OVER (PARTITION BY vec_id ORDER BY value) AS c FROM digit) GROUP BY vec_id, label),
draws AS (SELECT a.vec_id // 2 AS ex, a.label + b.label AS target, k, least(9, len(list_filter(a.c, lambda c: c <= CAST(('0x' || substr(md5('a:' || (a.vec_id // 2) || ':' || k), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE))) AS x,
  least(9, len(list_filter(b.c, lambda c: c <= CAST(('0x' || substr(md5('b:' || (a.vec_id // 2) || ':' || k), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE))) AS y
  FROM cum a JOIN cum b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1, range(1, 101) t(k))
SELECT ex, round(-ln((count(*) FILTER (x + y = target) + 0.5::DOUBLE) / 101.0::DOUBLE), 6) AS loss FROM draws GROUP BY ex""",
    "primal_dual_loss": f"""WITH {_SUM}, first_ AS (SELECT ex, any_value(pa) AS p FROM pair WHERE a = l0 GROUP BY ex)
SELECT round(avg(-ln(first_.p) + 0.7::DOUBLE * (1 - sums.p)), 6) AS loss, count(*) AS n FROM sums JOIN first_ USING (ex) WHERE s = target""",
    "hash_shuffle_pairs": f"WITH {_RANK} SELECT a.rn // 2 AS ex, a.vec_id AS img_a, b.vec_id AS img_b, a.label + b.label AS target FROM ranked a JOIN ranked b ON a.rn % 2 = 0 AND b.rn = a.rn + 1",
    "shuffled_batches": f"WITH {_RANK} SELECT vec_id, rn, rn // 16 AS batch FROM ranked",
    "sample_exact_n": "SELECT vec_id, label FROM embeddings ORDER BY md5('11:' || vec_id), vec_id LIMIT 100",
    "subset_n_plus_1": "SELECT vec_id, label FROM embeddings WHERE label IN (0, 2, 4) ORDER BY vec_id LIMIT 9",
    "split_ranges": """WITH n AS (SELECT count(*) AS n FROM embeddings), b AS (SELECT n, CAST(floor(n * 0.6) AS BIGINT) AS a, CAST(floor(n * 0.1) AS BIGINT) AS m, CAST(floor(n * 0.2) AS BIGINT) AS v FROM n),
parts AS (SELECT unnest(['train', 'train_mini', 'valid', 'test']) AS part, unnest([0, 0, a, a + v]) AS lo, unnest([a, m, a + v, n]) AS hi FROM b)
SELECT part, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last, CAST(sum(label) AS BIGINT) AS labels FROM embeddings JOIN parts ON vec_id >= lo AND vec_id < hi GROUP BY part""",
    "sampler_in_order": "SELECT CAST(pos AS BIGINT) AS pos, e.vec_id, label FROM (VALUES (0, 7), (1, 3), (2, 99), (3, 3), (4, 42)) t(pos, vec_id) JOIN embeddings e ON e.vec_id = t.vec_id",
    "image_lookup": "SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings WHERE vec_id % 7 = 0",
    "ground_queries": "SELECT vec_id AS img, label FROM embeddings",
    "operator_dataset": f"WITH {_EXAMPLES} SELECT ex, array_to_string(v, ',') AS args, CAST((l[1] * 10 + l[2]) + (l[3] * 10 + l[4]) AS BIGINT) AS expected FROM m",
    "operator_dataset_products": f"""WITH {_RANK}, m AS (SELECT rn // 3 AS ex, list(vec_id ORDER BY rn) AS v, list(label ORDER BY rn) AS l FROM ranked GROUP BY 1 HAVING count(*) = 3)
SELECT ex, array_to_string(v, ',') AS args, CAST(l[1] * l[2] * l[3] AS BIGINT) AS expected FROM m""",
    "dataset_json": f"WITH {_EXAMPLES} SELECT ex, '[[[' || v[1] || ',' || v[2] || '],[' || v[3] || ',' || v[4] || ']],' || CAST(l[1] * 10 + l[2] + l[3] * 10 + l[4] AS BIGINT) || ']' AS json, CAST(2 AS INTEGER) AS groups FROM m",
    "dataset_lines": f"WITH {_EXAMPLES} SELECT ex, '(' || array_to_string(v, ', ') || ')' || chr(9) || CAST(l[1] * 10 + l[2] + l[3] * 10 + l[4] AS BIGINT) AS line FROM m",
    "proposed_sums": f"WITH {_PROPOSALS.format(n=500)} SELECT req, s, d0, d1 FROM proposals",
    "proposal_histogram": f"WITH {_PROPOSALS.format(n=500)} SELECT CAST(t.range AS INTEGER) AS value, count(s) AS n FROM range(19) t LEFT JOIN proposals ON s = t.range GROUP BY 1",
    "balanced_sum_sample": f"""WITH {_PROPOSALS.format(n=60)}, asked AS (SELECT req, 0 AS pos, d0 AS digit FROM proposals UNION ALL SELECT req, 1, d1 FROM proposals),
a AS (SELECT *, row_number() OVER (PARTITION BY digit ORDER BY req, pos) AS k FROM asked),
pool AS (SELECT label AS digit, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('11:' || vec_id), vec_id) AS k FROM embeddings),
got AS (SELECT req, pos, vec_id FROM a LEFT JOIN pool USING (digit, k))
SELECT p.req, p.s, x.vec_id AS img0, y.vec_id AS img1, p.d0, p.d1 FROM proposals p JOIN got x ON x.req = p.req AND x.pos = 0 JOIN got y ON y.req = p.req AND y.pos = 1 WHERE x.vec_id <> y.vec_id""",
    "digit_histogram": "SELECT CAST(t.range AS INTEGER) AS value, count(vec_id) AS n FROM range(12) t LEFT JOIN embeddings ON label = t.range GROUP BY 1",
    "distribution_text": "WITH h AS (SELECT t.range AS v, count(vec_id) AS n FROM range(10) t LEFT JOIN embeddings ON label = t.range GROUP BY 1) SELECT string_agg(v || ': ' || n, ' || ' ORDER BY v) AS text FROM h",
    "bucket_lists": "SELECT label, CAST(count(*) AS INTEGER) AS n, string_agg(vec_id, ',' ORDER BY vec_id) AS ids FROM embeddings GROUP BY label",
    "records": "SELECT a.vec_id // 2 AS ex, CAST(2 AS INTEGER) AS images, CAST(len(a.embedding) + len(b.embedding) AS INTEGER) AS values, a.label + b.label AS s, a.label AS d0, (a.vec_id // 2) % 2 = 0 AS eval FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1",
    "normalised_pixels": "WITH x AS (SELECT vec_id, unnest(range(64)) AS i, (CAST(unnest(embedding) AS DOUBLE) - 0.1307::DOUBLE) / 0.3081::DOUBLE AS v FROM embeddings) SELECT vec_id, round(sum(v), 4) AS total, round(max(v) FILTER (i = 0), 5) AS first FROM x GROUP BY vec_id",
    "one_hot_labels": "SELECT vec_id, CAST(t.range AS INTEGER) AS value, CASE WHEN label = t.range THEN 1.0::DOUBLE ELSE 0.0 END AS flag FROM embeddings, range(10) t",
    "digits_as_numbers": f"WITH {_EXAMPLES}, n AS (SELECT ex, CAST(unnest([l[1] * 10 + l[2], l[3] * 10 + l[4]]) AS BIGINT) AS number FROM m) SELECT ex, min(number) AS least, max(number) AS most, CAST(sum(number // 10) AS BIGINT) AS tens, CAST(sum(number % 10) AS BIGINT) AS units FROM n GROUP BY ex",
    "distribution_distance": f"WITH {_SUM} SELECT ex, round(sqrt(sum((p - CASE WHEN s = target THEN 1 ELSE 0 END) ** 2)), 6) AS distance FROM sums GROUP BY ex",
    "clamped_logits": f"WITH {_Z} SELECT vec_id, CAST(v AS INTEGER) AS value, round(greatest(least(x, 1 - 1e-5), 1e-5), 6) AS z FROM z",
    "addition_table": "SELECT CAST(a.range AS INTEGER) AS a, CAST(b.range AS INTEGER) AS b, CAST(a.range + b.range AS INTEGER) AS s FROM range(10) a, range(10) b",
    "relation_paths": "SELECT a.vec_id // 2 AS ex, a.vec_id AS img0, b.vec_id AS img1, a.label AS l0, b.label AS l1, a.vec_id // 2 AS of FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1",
    "pair_semi": f"WITH {_DECODED} SELECT ex, d0, d1 FROM decoded WHERE method = 'argmax' AND d0 + d1 IN (3, 9, 17)",
    "enum_domains": "SELECT 'd0_' || range AS name, CAST(range AS INTEGER) AS value FROM range(10) UNION ALL SELECT 's_' || range, CAST(range AS INTEGER) FROM range(19)",
    "param_anti": "SELECT * FROM (SELECT 'layer' || (vec_id % 7) || CASE WHEN vec_id % 2 = 0 THEN '.weight' ELSE '.bias' END AS name, vec_id FROM embeddings) WHERE name NOT IN ('layer1.weight', 'layer1.bias', 'layer2.weight', 'layer2.bias')",
    "param_exclude_join": "SELECT * FROM (SELECT 'layer' || (vec_id % 7) || CASE WHEN vec_id % 2 = 0 THEN '.weight' ELSE '.bias' END AS name, vec_id FROM embeddings) WHERE suffix(name, 'bias') AND name NOT IN ('layer0.bias', 'layer1.bias', 'layer2.bias')",
    "param_delta_norm": "WITH x AS (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT round(sqrt(sum((a.v - b.v) ** 2)), 5) AS norm FROM x a JOIN x b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1 AND a.i = b.i",
    "hyper_grid": "SELECT CAST(i AS BIGINT) AS iters, CAST(l AS DOUBLE) AS lr, CAST(r AS DOUBLE) AS reg, CAST(100 AS BIGINT) AS samples FROM (VALUES (10), (50), (100)) a(i), (VALUES (0.01), (0.1), (1.0)) b(l), (VALUES (0.01), (0.1), (1.0)) c(r)",
    "best_epoch": f"WITH {_LOG}, e AS (SELECT epoch, round(avg(loss), 9) AS loss FROM log_ GROUP BY epoch) SELECT epoch, round(loss, 6) AS loss FROM e ORDER BY e.loss, epoch LIMIT 1",
    "running_best": f"WITH {_LOG}, e AS (SELECT epoch, avg(loss) AS loss FROM log_ GROUP BY epoch) SELECT epoch, round(loss, 6) AS loss, round(min(loss) OVER (ORDER BY epoch), 6) AS best FROM e",
    "epoch_means": f"WITH {_LOG} SELECT method, round(avg(loss), 6) AS mean, round(min(loss), 6) AS least, count(*) AS n FROM log_ GROUP BY method",
    "every_kth": "SELECT event_id, event_type, round(value, 6) AS value FROM events WHERE event_id % 50 = 0",
    "windowed_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY date_trunc('hour', ts), event_type",
}
