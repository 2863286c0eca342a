import random

from millrace.llm.components import components


def brute(links):
    label = {}
    for a, b in links:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return {k: v for k, v in label.items() if k != v}


def test_chains_stars_loops_and_nulls(spark):
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(1000, 1400)]
    star = [(k, 5000) for k in range(4000, 4100)]
    loose = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    links = chain + star + loose + [(7, 7), (-5, -9), (-5, -9)]
    rng.shuffle(links)
    table = spark.createDataFrame([*links, (None, 3), (4, None)], "u long, v long").repartition(6)
    assert {r.node: r.root for r in components(table).collect()} == brute(links)
    assert components(table.limit(0)).count() == 0
