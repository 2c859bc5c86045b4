"""Fatal payments against the definition: every set of consumers is tried."""

import itertools
import random

from karst.operators import markets


def met(wants):
    return all(len(set().union(*(wants[c] for c in s))) >= n for n in range(1, len(wants) + 1) for s in itertools.combinations(wants, n))


def plain(wants, spends):
    if not met(wants):
        return []
    out = []
    for spend, token, satisfies in spends:
        rest = {c: set(w) - {token} for c, w in wants.items() if c not in satisfies}
        if not met(rest):
            out.append((spend, token, sorted(c for c in rest if met({x: w for x, w in rest.items() if x != c}))))
    return out


def test_squeezes_equal_the_definition(spark):
    rng, consumers, spends, want = random.Random(6), [], [], set()
    for m in range(120):
        tokens = [f"t{k}" for k in range(5)]
        wants = {c: rng.sample(tokens, rng.randrange(1, 4)) for c in range(rng.randrange(1, 6))}
        own = [(s, rng.choice([*tokens, "odd"]), sorted(rng.sample(sorted(wants), rng.randrange(0, 2)))) for s in range(6)]
        consumers += [(m, c, w) for c, w in wants.items()]
        spends += [(m, *s) for s in own]
        want |= {(m, s, t, tuple(x)) for s, t, x in plain(wants, own)}
    c = spark.createDataFrame([*consumers, (None, 1, ["t0"]), (500, None, ["t0"]), consumers[0]], "market long, consumer long, tokens array<string>")
    s = spark.createDataFrame([*spends, spends[0], (None, 1, "t0", []), (0, 9, None, None), (900, 1, "t0", [1])], "market long, spend long, token string, satisfies array<long>")
    got = [(r["market"], r["spend"], r["token"], tuple(r["starves"])) for r in markets.squeezes(c, s).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    assert markets.squeezes(c.limit(0), s).count() == markets.squeezes(c, s.limit(0)).count() == 0


def test_unmet_markets(spark):
    c = spark.createDataFrame([("a", 1, ["x"]), ("a", 2, ["x"]), ("b", 1, ["x", "y"]), ("b", 2, ["x"])], "market string, consumer long, tokens array<string>")
    assert [r["market"] for r in markets.unmet(c).collect()] == ["a"]
