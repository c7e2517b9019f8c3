"""The fold of similar events against a plain one over all pairs."""

import random
import re

import pytest

from caseweave.operators.similar import kept_similar_events

KIND = "document long, date string, n long, title string, description string, confidence double"


def plain(rows):
    """The fold as it reads: every event against all kept ones of its document."""

    def words(r):
        return set(filter(lambda w: len(w) > 3, re.split(r"\s+", re.sub(r"[^a-z0-9_àèéìòù\s]", "", f"{r[3] or ''} {r[4] or ''}".lower()))))

    def alike(a, b):
        if not a or not b:
            return not a and not b
        return len(a & b) / len(a | b) > 0.6

    def score(r):
        return 10 * (r[5] or 0) + len(r[4] or "")

    out = []
    for document in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == document), key=lambda r: r[2]):
            at = next((k for k, e in enumerate(kept) if (e[1] or "") == (r[1] or "") and alike(words(r), words(e))), None)
            if at is None:
                kept.append(r)
            elif score(r) > score(kept[at]):
                kept[at] = r
        out += kept
    return sorted(out, key=repr)


def answers(spark, rows, kind=KIND):
    return sorted((tuple(r)[:6] for r in kept_similar_events(spark.createDataFrame(rows, kind), ["document"], "date", "n").collect()), key=repr)


def test_chain_and_replaced_slot(spark):
    """A is like B and B like C, but A is not like C; C meets B in A's slot only if B was better."""
    a, b, c = "alpha beta1 gamma delta", "alpha beta1 gamma delta epsilon", "beta1 gamma delta epsilon zeta1"
    better = [(1, "d", 1, "", a, 1.0), (1, "d", 2, "", b, 9.0), (1, "d", 3, "", c, 1.0)]
    assert [r[2] for r in answers(spark, better)] == [2]
    worse = [(1, "d", 1, "", a, 9.0), (1, "d", 2, "", b, 1.0), (1, "d", 3, "", c, 1.0)]
    assert [r[2] for r in answers(spark, worse)] == [1, 3]
    # the slot that C took is met by what is like C alone
    later = [*better[:2], (1, "d", 3, "", c, 20.0), (1, "d", 4, "", "gamma delta epsilon zeta1 theta", 1.0), (1, "d", 5, "", a, 1.0)]
    assert [r[2] for r in answers(spark, later)] == [3, 5]
    assert plain(later) == answers(spark, later)


@pytest.mark.parametrize("seed", range(4))
def test_random_events(spark, seed):
    rng = random.Random(seed)
    pool = ["alpha", "beta1", "gamma", "delta", "epsilon", "di", "età", "Àlpha", "zeta-1"]
    text = lambda n: rng.choice([None, "", " ".join(rng.choice(pool) for _ in range(rng.randrange(n)))])
    rows = [(rng.randrange(3), rng.choice([None, "", "2024-01-01", "2024-01-02"]), n, text(4), text(9), rng.choice([None, 1.0, 5.0])) for n in range(300)]
    got = answers(spark, rows)
    assert got == plain(rows) and len(got) < 200


def test_other_columns_and_empty_table(spark):
    rows = [(1, None, 1, "visita medica", None, None, "a"), (1, "", 2, "visita medica", None, None, "b"), (None, None, 1, None, None, None, None)]
    got = kept_similar_events(spark.createDataFrame(rows, KIND + ", words string"), ["document"], "date", "n").collect()
    assert sorted((str(r.document), r.words) for r in got) == [("1", "a"), ("None", None)]
    assert kept_similar_events(spark.createDataFrame([], KIND), ["document"], "date", "n").count() == 0
