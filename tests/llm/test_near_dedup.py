"""Components against all pairs, and the stated cases."""

import random
import re

import pytest

from caseflow.llm import near_dedup as N
from caseflow.llm.common import components


def word_sets(docs):
    out = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    return out


def brute(docs):
    sets = word_sets(docs)
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    root[top(i)] = top(j)
    ids = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            ids[top(i)] = min(ids.get(top(i), d), d)
    return sorted(((d, len(s), ids.get(top(i)), d == ids.get(top(i))) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def run(spark, docs):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, node string, n_shingles int").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df).collect()), key=str)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_small_cases(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    docs = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\x0btwo"), (6, "one two three"), (7, long), (8, long + " more"), (9, long), (9, long),
        (10, "a a a a a a a a"), (11, "A a A a"), (12, "x y z w"), (13, "x y z w"), (None, "solo text with null id"), (14, "É é É é"), (15, "é é é é"),
    ]
    assert run(spark, docs) == brute(docs)


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("per_class", [100, 0])
def test_groups_with_hubs(spark, monkeypatch, per_class):
    """A crowded group of near copies, chains at the limit, a passage that many share: with and without hub rounds."""
    monkeypatch.setattr(N, "PAIRS_PER_CLASS", per_class)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    docs = [(i, edited(rng, base, rng.randrange(0, 6))) for i in range(60)]
    chain = [f"c{i}" for i in range(100)]
    for i in range(60, 80):
        chain = chain[2:] + [f"n{i}a", f"n{i}b"] if i % 3 else edited(rng, chain, 2).split()
        docs.append((i, " ".join(chain)))
    passage = " ".join(f"p{i}" for i in range(40))
    docs += [(i, passage + " " + " ".join(f"q{i}x{j}" for j in range(rng.randrange(5, 30)))) for i in range(80, 110)]
    rng.shuffle(docs)
    assert run(spark, docs) == brute(docs)


def test_few_pairs_for_edits_of_one_original(spark):
    """2,000 copies, edited apart: most are under 0.8 of each other and over 0.8 of the original."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    docs = [(0, " ".join(base))] + [(i, edited(rng, base, 2)) for i in range(1, 2001)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    compared = []
    components_of = N._components
    N._components = lambda d, c: components_of(d, c, compared)
    try:
        got = {r.doc_id: r.component_id for r in N.near_duplicates(df).collect()}
    finally:
        N._components = components_of
    sets = word_sets(docs)
    near = {i for i in range(2001) if 100 * len(sets[0] & sets[i]) >= 80 * len(sets[0] | sets[i])}
    assert {i for i, c in got.items() if c == 0} >= near and len(near) > 1900
    assert sum(compared) <= 10 * len(docs), compared


def test_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = run(spark, docs)
    assert got == brute(docs) and not all(x[3] for x in got)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 70)] + [(100, i) for i in range(101, 200)] + [(300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(71)} | {i: 100 for i in range(100, 200)}


def test_texts_stay_where_they_lie(spark, monkeypatch):
    plans, cut = {}, N.cut_lineage

    def noted(df, label="cut"):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return cut(df, label)

    monkeypatch.setattr(N, "cut_lineage", noted)
    text = " ".join(f"w{i}" for i in range(200))
    docs = [(i, f"{text} x{i}") for i in range(5)] + [(7, f"{text} x0"), (7, "other words with the same number"), (None, f"{text} y"), (None, f"solo {text[:50]}")]
    assert run(spark, docs) == brute(docs)
    before_sets = plans["near-sets"].split("MapInArrow", 1)[1].split("Exchange", 1)[0]
    assert "text" in before_sets  # what is read for the sets goes to the operator without an exchange


def test_first_shingles_are_passed_on_bit_by_bit(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, i, [rng.randrange(40) for _ in range(30)]) for i in range(60)]
    sets = spark.createDataFrame([(n, r, sorted(set(s))) for n, r, s in rows], "node long, root long, set array<long>")
    found = []
    for most in (N.HEADS, 7):
        monkeypatch.setattr(N, "HEADS", most)
        found.append(sorted(tuple(r) for r in N._prefix_pairs(sets).collect()))
    assert found[0] and found[0] == found[1]
