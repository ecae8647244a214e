import math
import random

import pytest

from corpusmill.llm import mixing

DOCS = "doc_id bigint, source string, text string, n_tokens string"
TARGETS = "plan_id string, source string, target_share double, max_repeats int, token_budget bigint"


@pytest.fixture(scope="module")
def sizes(spark):
    rng = random.Random(2)
    words = "the river runs past the old mill and the garden".split()
    rows = [(i, "big" if i % 3 else "mid", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 200))), "clash") for i in range(900)]
    rows += [(1000 + i, "tiny", "a short note about rain", "x") for i in range(5)] + [(2000, "big", None, "x"), (2001, "big", "", "x"), (2002, None, "no source", "x")]
    return mixing.sizes_of(spark.createDataFrame(rows, DOCS)).cache()


def targets(spark):
    return spark.createDataFrame([("a", "big", 0.5, 3, 20000), ("a", "mid", 0.3, 3, 20000), ("a", "tiny", 0.1, 4, 20000), ("a", "absent", 0.1, 4, 20000), ("b", "big", 0.2, 1, 400000), ("b", "mid", 0.8, 2, 400000), ("a", "big", 0.5, 3, 20000)], TARGETS)


def brute(docs, u, targets, power):
    """The plan by hand: certain whole copies, then the scale by bisection and the documents in the order of their ranks."""
    want = {}
    for plan, source, share, most, budget in targets:
        mine = [(d, n) for d, s, n in docs if s == source]
        size, quota = sum(n for _, n in mine), share * budget
        if not size:
            continue
        whole = min(int(quota // size), most)
        rest = quota - whole * size if whole < most else 0
        w = {d: math.exp(math.floor(math.log(n) / math.log(mixing.STEP)) * math.log(mixing.STEP) * power) for d, n in mine}
        lo, hi = 0.0, 1e9
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(1, mid * w[d]) * n for d, n in mine) < rest else (lo, mid)
        rank = {}
        for d, _ in mine:
            p, x = min(1, hi * w[d]), u[plan, d]
            rank[d] = ((x / (1 - x)) * (1 - p) / max(p, 1e-300) if p < 1 - 1e-9 else 0, x, d)
        at = 0
        for d, n in sorted(mine, key=lambda m: rank[m[0]]):
            at += n
            k = whole + (rest > 0 and at - n / 2 <= rest and at - n < rest)
            if k:
                want[plan, source, d] = k
    return want


def randoms(sizes):
    return {(p, r.doc_id): r.u for p in "ab" for r in sizes.select("doc_id", mixing.uniform(mixing.F.lit(p), mixing.F.col("doc_id")).alias("u")).collect()}


@pytest.mark.parametrize("power", [0.0, 0.5, 1.0])
def test_against_brute_force(spark, sizes, power):
    docs = [(r.doc_id, r.source, r.n_tokens) for r in sizes.collect()]
    want = brute(docs, randoms(sizes), {tuple(r) for r in targets(spark).collect()}, power)
    got = {(r.plan_id, r.source, r.doc_id): r.repeats for r in mixing.mix(sizes, targets(spark), power).collect()}
    assert got == want


def test_odds_decide_who_is_taken(spark, sizes):
    """Without the inclusion odds the order would be that of the random number alone."""
    taken = {(r.plan_id, r.doc_id): r.n_tokens for r in mixing.mix(sizes, targets(spark)).where("source = 'big' and plan_id = 'a'").collect()}
    alike = {(r.plan_id, r.doc_id): r.n_tokens for r in mixing.mix(sizes, targets(spark), 0.0).where("source = 'big' and plan_id = 'a'").collect()}
    assert set(taken) != set(alike) and sum(taken.values()) / len(taken) > sum(alike.values()) / len(alike)
    assert abs(sum(taken.values()) - sum(alike.values())) < 200


def test_inclusion_follows_the_size(spark, monkeypatch):
    """Over many seeds a document is taken as often as its probability says."""
    rows = [(i, "s", 10 if i < 60 else 160) for i in range(80)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").cache()
    t = spark.createDataFrame([("a", "s", 1.0, 1, 1200)], TARGETS)
    got = {10: 0, 160: 0}
    for seed in range(12):
        monkeypatch.setattr(mixing, "SEED", seed)
        for r in mixing.mix(sizes, t).collect():
            got[r.n_tokens] += 1
    # p is four times as large for the long ones: 60 p 10 + 20 (4 p) 160 = 1200.
    p = 1200 / (600 + 12800)
    assert abs(got[160] / (20 * 12) - 4 * p) < 0.1 and abs(got[10] / (60 * 12) - p) < 0.05


def test_shares(spark, sizes):
    rows = {(r.plan_id, r.source): r for r in mixing.shares(sizes, targets(spark)).collect()}
    assert len(rows) == 6
    for (plan, source), r in rows.items():
        assert r.most_repeats <= r.max_repeats and r.tokens <= r.quota + 200
        if source in ("big", "mid") and r.size * r.max_repeats > r.quota:
            assert abs(r.tokens - r.quota) < 200
    assert rows["a", "absent"].tokens == 0 and rows["a", "tiny"].most_repeats == 4
    assert abs(sum(r.actual_share for (p, _), r in rows.items() if p == "a") - 1) < 1e-9


def test_empty_tables(spark, sizes):
    t = targets(spark)
    none = mixing.sizes_of(spark.createDataFrame([], DOCS))
    assert mixing.mix(none, t).count() == 0 and mixing.mix(sizes, t.limit(0)).count() == 0
    assert {r.tokens for r in mixing.shares(none, t).collect()} == {0}
