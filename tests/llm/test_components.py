import random

from quarryline.llm import components as module
from quarryline.llm.components import components


def brute(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in root}


def cases():
    draw = random.Random(1)
    yield "path", [(i, i + 1) for i in range(300)]
    order = draw.sample(range(300), 300)
    yield "mixed path", list(zip(order, order[1:]))
    yield "star", [(i, 0) for i in range(1, 400)]
    yield "late star", [(i, 999) for i in range(1, 400)]
    yield "none", [(5, 5)]
    for n in (150, 250, 400):
        yield f"random {n}", [(draw.randrange(400), draw.randrange(400)) for _ in range(n)]


def test_equals_brute_force(spark):
    """All cases in one table, each in a range of numbers of its own."""
    links = [(1000 * c + x, 1000 * c + y) for c, (_, case) in enumerate(cases()) for x, y in case]
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == brute(links)


def test_only_news_travel(spark, monkeypatch):
    """Rows that are joined over all rounds stay near the number of links."""
    joined = []
    join = module.join_hot

    def counted(rows, keyed, on, *a):
        out = join(rows, keyed, on, *a)
        if on == "v":
            joined.append(out.count())
        return out

    monkeypatch.setattr(module, "join_hot", counted)
    links = [(g * 100, g * 100 + i) for g in range(30) for i in range(1, 60)]
    components(spark.createDataFrame(links, "a long, b long"))
    assert sum(joined) <= 1.2 * len(links)
