"""Assignments against every permutation, and pages against plain costs."""

import itertools
import random

from pyspark.sql import Row

from caseflow.operators import assignment as A


def least(cost):
    rows, cols = len(cost), len(cost[0])
    if rows > cols:
        return least([list(c) for c in zip(*cost)])
    return min(sum(cost[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(cols), rows))


def total(cost, held):
    taken = [j for j in held if j is not None]
    assert len(taken) == len(set(taken)) == min(len(cost), len(cost[0]))
    return sum(cost[i][j] for i, j in enumerate(held) if j is not None)


def test_least_cost_of_all_permutations():
    rng = random.Random(5)
    for _ in range(400):
        n, m = rng.randint(1, 6), rng.randint(1, 6)
        cost = [[rng.choice([rng.random(), 9.0, 0.0, -0.05, 1.0]) for _ in range(m)] for _ in range(n)]
        assert abs(total(cost, A.cheapest(cost)) - least(cost)) < 1e-9
    assert A.cheapest([]) == [] and A.cheapest([[], []]) == [None, None]


def test_large_page_is_optimal():
    """Prices prove it: a shuffled identity hidden in dearer costs is found again."""
    rng = random.Random(6)
    n = 120
    order = list(range(n))
    rng.shuffle(order)
    cost = [[rng.random() + (0 if order[i] == j else 1) for j in range(n)] for i in range(n)]
    assert A.cheapest(cost) == order


def box(page, name, x, y, **more):
    return {"page": page, "ftype": "Text", "name": name, "x0": x, "y0": y, "x1": x + 0.1, "y1": y + 0.02} | more


def test_contending_fields(spark):
    # both boxes are nearest to field p; the sum is least when the left box takes the field beyond
    slots = [Row(**box(1, "a", 0.10, 0.5), slot="s1"), Row(**box(1, "b", 0.13, 0.5), slot="s2"), Row(**box(2, "a", 0.1, 0.1), slot="s1"), Row(**box(3, "a", 0.1, 0.1, x1=None), slot="s1")]
    widgets = [Row(**box(1, "x", 0.12, 0.5), has_value=False, widget="p"), Row(**box(1, "y", 0.06, 0.5), has_value=None, widget="q"), Row(**box(3, "y", 0.06, 0.5), has_value=None, widget="q")]
    schema = "page int, ftype string, name string, x0 double, y0 double, x1 double, y1 double"
    s = spark.createDataFrame([tuple(r) for r in slots], schema + ", slot string")
    w = spark.createDataFrame([tuple(r) for r in widgets], schema + ", has_value boolean, widget string")
    got = {(r.page, r.slot, r.widget): (round(r.cost, 9), r.tight) for r in A.assign_widgets(s, w, 0.01, 0.01).collect()}
    assert got == {(1, "s1", "q"): (0.05, False), (1, "s2", "p"): (0.02, False)}
    assert A.assign_widgets(s.limit(0), w, 0.01, 0.01).count() == 0
    # a pair that is too dear is left out after, not before, the assignment
    far = w.where("widget = 'q'").withColumn("x0", w.x0 + 0.5).withColumn("x1", w.x1 + 0.5)
    got = {(r.slot, r.widget) for r in A.assign_widgets(s.where("page = 1"), w.where("widget = 'p' and page = 1").unionByName(far.where("page = 1")), 0.01, 0.01).collect()}
    assert got in ({("s1", "p")}, {("s2", "p")}) and len(got) == 1


def test_of_equal_totals_the_first_box_takes_the_first_field():
    rng = random.Random(8)
    for _ in range(200):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        cost = [[rng.choice([0.1, 0.2, 0.3, 9.0]) for _ in range(m)] for _ in range(n)]
        k, ways = min(n, m), []
        for boxes in itertools.combinations(range(n), k):
            for fields in itertools.permutations(range(m), k):
                held = [None] * n
                for i, j in zip(boxes, fields):
                    held[i] = j
                ways.append((sum(round(cost[i][j] * 10) for i, j in zip(boxes, fields)), [m if j is None else j for j in held], held))
        assert A.first_cheapest(cost) == min(ways, key=lambda w: w[:2])[2]
    # the sums differ in their last bit only
    assert A.first_cheapest([[0.1 + 0.2, 0.1], [0.3, 0.1]]) == [0, 1]


def test_pages_over_several_batches_and_single_ones_agree(spark, monkeypatch):
    rng = random.Random(9)
    edge = lambda: rng.randrange(6) / 100  # noqa: E731  # ties are common
    kinds, names = ["Text", "Signature", "CheckBox", "Radio", None], ["a", "b", None]
    one = lambda p, k: (p, rng.choice(kinds), rng.choice(names), edge(), edge(), 0.1 + edge(), 0.1 + edge(), k)
    schema = "page int, ftype string, name string, x0 double, y0 double, x1 double, y1 double"
    slots = [one(p, f"s{i}") for p in range(40) for i in range(rng.randrange(5))]
    widgets = [one(p, f"w{i}") + (rng.random() < 0.5,) for p in range(40) for i in range(rng.randrange(5))]
    s, w = spark.createDataFrame(slots, schema + ", slot string"), spark.createDataFrame(widgets, schema + ", widget string, has_value boolean")
    rows = lambda: sorted(tuple(r) for r in A.assign_widgets(s, w, 0.02, 0.02).collect())
    whole = rows()
    monkeypatch.setattr(A, "PAIRS", 5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert whole and rows() == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_rows_with_a_cheapest_column_of_their_own_take_it(monkeypatch):
    rng, seen = random.Random(4), A.cheapest
    for _ in range(300):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        cost = [[rng.choice([1, 2, 3, 4, 9]) for _ in range(m)] for _ in range(n)]
        with monkeypatch.context() as short:
            short.setattr(A, "_plain", lambda cost: None)
            whole = A._first_cheapest(cost)
        assert A._first_cheapest(cost) == whole
    monkeypatch.setattr(A, "cheapest", None)
    assert A.first_cheapest([[0.3, 0.1], [0.2, 0.4], [0.9, 0.9]]) == [1, 0, None] and seen
