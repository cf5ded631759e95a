import numpy as np
import pytest

from graphloom.llm import mixing


def told(spark, n, p):
    return spark.createDataFrame([(i, int(n[i]), [float(x) for x in p[i]]) for i in range(len(n))], "doc_id long, n_tokens long, p array<double>")


def brute(n, p, shares, rounds=4000):
    """Projected gradient on the same squares, in plain numpy with a small step."""
    a = p * n[:, None]
    total = n.sum()
    target = total * np.array(shares) / sum(shares)
    m = (p * n[:, None]).T @ p
    w = np.linalg.inv(m + 1e-12 * total * np.eye(p.shape[1]))
    r = np.ones(len(n))
    for _ in range(rounds):
        r = np.maximum(0, r - 0.5 * p @ (w @ (a.T @ r - target)))
    miss = a.T @ r - target
    return r, float(miss @ w @ miss), target


@pytest.mark.parametrize("shares", [(0.5, 0.3, 0.2), (0.98, 0.01, 0.01), (1.0, 0.0, 0.0)])
def test_rates_equal_plain_projected_gradient(spark, shares):
    rng = np.random.default_rng(3)
    n = rng.integers(1, 400, 300)
    p = rng.dirichlet([0.4, 0.3, 0.3], 300)
    rated, got = mixing.solve(told(spark, n, p), list(shares), rounds=200)
    rates = np.array([r["rate"] for r in rated.orderBy("doc_id").collect()])
    want, loss, target = brute(n, p, shares)
    assert (rates >= 0).all()
    a = p * n[:, None]
    assert np.allclose(a.T @ rates, got, rtol=1e-9)
    w = np.linalg.inv((p * n[:, None]).T @ p)
    mine = (a.T @ rates - target) @ w @ (a.T @ rates - target)
    assert mine <= loss * 1.05 + 1e-6 * n.sum()


def test_targets_are_met_where_they_can_be(spark):
    n, p = np.array([10, 20, 30, 40]), np.array([[1, 0], [1, 0], [0, 1], [0.5, 0.5]])
    _, got = mixing.solve(told(spark, n, p), [0.7, 0.3])
    assert np.allclose(got, [70, 30], rtol=1e-6)


def test_classifier_tells_domains_apart(spark):
    words = [f"w{i}" for i in range(400)]
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(900):
        text = list(rng.choice(words, 60))
        kind = ("news", "code", "spam")[i % 3]
        mark = {"news": [], "code": ["{", "}"], "spam": ["win!!"]}[kind]
        rows.append((i, " ".join(text + mark)))
        if i < 600:
            labels.append((i, kind))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    domains, priors, weights = mixing.learn(docs, spark.createDataFrame(labels, "doc_id long, domain string"))
    assert domains == ["code", "news", "spam"]
    got = {r["doc_id"]: r for r in mixing.posteriors(docs, domains, priors, weights).collect()}
    right = [domains[int(np.argmax(got[i]["p"]))] == ("news", "code", "spam")[i % 3] for i in range(600, 900)]
    assert np.mean(right) > 0.98 and all(abs(sum(r["p"]) - 1) < 1e-9 for r in got.values())
    assert got[0]["n_tokens"] == 60 and got[1]["n_tokens"] == 62


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0, 2), (2, "", 1.0, 2), (3, "a b", 1.0, 2), (3, "a c", 1.0, 2), (None, "x", 1.0, 2)], "doc_id long, text string, rate double, p int")
    labels = spark.createDataFrame([(3, "one"), (3, "two"), (2, None), (None, "one"), (77, "gone")], "doc_id long, domain string")
    rows = mixing.mix(docs, labels, {"one": 1.0, "absent": 1.0}).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]) for r in rows) == [(-1, 1), (1, 0), (2, 0), (3, 4)]
    assert all(r["p_one"] == 1.0 and r["rate"] >= 0 for r in rows)
    assert {r["rate"] for r in mixing.mix(docs, labels.limit(0), {"one": 1.0}).collect()} == {1.0}
    assert mixing.mix(docs.limit(0), labels, {"one": 1.0}).count() == 0
