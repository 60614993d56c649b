"""Names that are alike, against all pairs."""

import random

from tessera.operators.entities import similar_names


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 45))) for _ in range(60)] + ["a" * n for n in (1, 2, 9, 10, 11, 20, 22, 40)] + ["ab" * 15, "ba" * 15]
    for x in names[:50]:
        for _ in range(3):
            y = list(x)
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(y) + 1)
                y[i : i + rng.randrange(2)] = rng.choice(["", "z", "q"])
            names.append("".join(y))
    df = spark.createDataFrame([(x, 1, 2) for x in [*names, *names[:20], None, ""]], "name string, n int, g int").repartition(4)
    got = {(r.a, r.b, r.distance) for r in similar_names(df).collect()}
    own = sorted({x for x in names if x})
    want = {(a, b, d) for i, a in enumerate(own) for b in own[i + 1 :] if (d := levenshtein(a, b)) * 10 <= max(len(a), len(b))}
    assert got == want and len(want) > 40
    assert similar_names(df.limit(0)).collect() == []


def test_both_ways_find_the_same(spark):
    """Names around the bound meet on parts, on grams, or one of them on either side of it."""
    rng = random.Random(8)
    names = ["".join(rng.choice("abc ") for _ in range(n)) for n in (9, 10, 18, 19, 20, 21, 29, 30, 31, 40, 59) for _ in range(4)]
    for x in list(names):
        for _ in range(3):
            y = list(x)
            for _ in range(rng.randrange(1, 5)):
                i = rng.randrange(len(y) + 1)
                y[i : i + rng.randrange(2)] = rng.choice(["", "z", "a"])
            names.append("".join(y))
    df = spark.createDataFrame([(x,) for x in names], "name string")
    own = sorted({x for x in names if x})
    want = {(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if levenshtein(a, b) * 10 <= max(len(a), len(b))}
    for long in (120, 20, 30):
        assert {(r.a, r.b) for r in similar_names(df, long=long).collect()} == want
    assert len(want) > 60


def test_parts_bring_few_together(spark):
    """Names of the same few syllables share all their grams, yet few parts."""
    from tessera.operators import entities as E

    rng = random.Random(2)
    names = sorted({"".join(rng.choice(["the", "an", "ing", "er", "ti"]) for _ in range(20)) for _ in range(300)})
    own = spark.createDataFrame([(x, len(x), len(x) // 9) for x in names], "x string, n int, d int")
    assert E._by_parts(own, E.SHARE).distinct().count() * 10 < E._by_grams(own).distinct().count()
