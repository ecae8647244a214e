import itertools
import random

from corpusmill.llm import nearcopies as nc

TYPES = "row_id bigint, item_id string, content string, keys string"


def exact(rows, least=nc.SIMILAR):
    sets, item = {}, {}
    for i, it, text, _ in rows:
        words = nc.WORD.findall((text or "").lower())
        if len(words) >= nc.MIN_WORDS:
            sets[i] = {tuple(words[k : k + 3]) for k in range(len(words) - 2)}
            item[i] = it
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if item[a] != item[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for base in range(12):
        words = [rng.choice(vocab) for _ in range(rng.randrange(80, 400))]
        for v in range(8):
            w = list(words)
            for _ in range(int(len(w) * rng.choice([0, 0.005, 0.01, 0.02, 0.05]))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), rng.choice([f"i{base}-{v}", f"i{base}", None]), " ".join(w), "clash"))
    han = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(200))
    rows += [(1000, "h1", han, "k"), (1001, "h2", han[:150] + "，" + han[150:], "k"), (1002, "h3", None, "k"), (1003, "h4", "", "k"), (1004, "h5", "short text", "k")]
    rows += [(2000 + i, f"copy{i % 40}", rows[0][2], "k") for i in range(60)]
    return rows


def test_masks_cover_the_radius():
    for radius in (1, 2, 3):
        n = 2 ** (radius + 1) - 1
        for differ in itertools.combinations(range(n), radius):
            assert any(not set(differ) & set(keep) for keep in nc.masks(radius))


def test_miss_probability_is_small():
    assert nc.miss_probability(0.64) < 0.01 and nc.miss_probability(0.7) < 0.001 and nc.miss_probability(0.8) < 1e-5


def test_pairs_against_brute_force(spark):
    rows = corpus()
    got = [tuple(r) for r in nc.found_rows(spark.createDataFrame(rows, TYPES).repartition(5)).collect()]
    assert len(got) == len(set(got)) and set(got) == exact(rows)


def test_groups_are_components(spark):
    rows = corpus(2)
    pairs = exact([(i, str(i), t, k) for i, _, t, k in rows])
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(b)] = root(a)
    want = {}
    for x in list(parent):
        want.setdefault(root(x), set()).add(x)
    got = {}
    for r in nc.groups(spark.createDataFrame(rows, TYPES)).collect():
        got.setdefault(r.group_id, set()).add(r.row_id)
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values()}
    assert all(g == min(v) for g, v in got.items())


def test_empty_table(spark):
    df = spark.createDataFrame([], TYPES)
    assert nc.found_rows(df).count() == 0 and nc.groups(df).count() == 0


def test_all_ways_find_the_same_pairs(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, TYPES)
    want = exact(rows)
    for how in ({"sketch": False}, {"blocks": 9}, {"blocks": 9, "sketch": False}):
        assert {tuple(r) for r in nc.found_rows(df, **how).collect()} == want
