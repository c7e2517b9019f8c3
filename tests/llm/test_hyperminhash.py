"""HyperMinHash near-duplicates against all pairs, and its registers, estimates and recall."""

import random
import re

import duckdb
import numpy as np
import pytest

from caseweave.llm import hyperminhash, near_links, queries
from caseweave.llm.common import utf8

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string"


def shingles(text, size=3):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\\x20\\x09-\\x0D]+", lower)
    return {tuple(words)} if 0 < len(words) < size else {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def brute(rows, percent=85):
    """n_shingles, component_id and kept of each row, over all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            common = len(sets[x] & sets[y])
            if common and 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                label[root(x)] = root(y)
    members = {}
    for x in range(len(rows)):
        members.setdefault(root(x), []).append(x)
    out = []
    for x, (doc, _) in enumerate(rows):
        ids = [rows[k][0] for k in members[root(x)] if rows[k][0] is not None]
        least = min(ids, default=None)
        out.append((doc, len(sets[x]), least, doc is not None and doc == least))
    return sorted(out, key=repr)


def answers(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in df.collect()), key=repr)


def family(rng, words, copies, rate, first):
    """A text and copies of it in which words are replaced at up to a rate."""
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = [(first, " ".join(base))]
    for k in range(copies):
        edits = rng.random() * rate
        out.append((first + 1 + k, " ".join(f"x{rng.randrange(10**9)}" if rng.random() < edits else w for w in base)))
    return out


def test_query_equals_all_pairs_and_its_sql(spark):
    rows = duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = answers(queries.op11_minhash_near_dedup(spark, SF))
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(con.execute(queries.ORACLE_SQL["op11_minhash_near_dedup"]).fetchall(), key=repr)


@pytest.mark.parametrize("seed, block", [(1, 1024), (2, 16)])
def test_families_around_the_threshold(spark, monkeypatch, seed, block):
    """Families whose copies are linked with some of the others only, in one block and in many."""
    monkeypatch.setattr(near_links, "BLOCK", block)
    rng = random.Random(seed)
    rows = family(rng, 200, 120, 0.08, 0) + family(rng, 40, 60, 0.1, 1000) + family(rng, 22, 200, 0.1, 2000) + family(rng, 3000, 40, 0.06, 3000)
    rng.shuffle(rows)
    got = answers(hyperminhash.near_duplicates(spark.createDataFrame(rows, KIND)))
    want = brute(rows)
    assert got == want
    assert 20 < len({r[2] for r in want}) < len(rows) - 60


def test_odd_rows(spark):
    kind = "doc_id long, text string, node int, label string, kept int, n_shingles string"
    texts = [(5, None), (6, ""), (7, " \t\n"), (None, "A b c d"), (9, "a B c d"), (9, "a B c d"), (8, "a b c d"), (1, "One"), (2, "one"), (3, "one two"), (4, "One two"), (None, "alone here now"), (None, None), (12, "É é"), (13, "é é"), (14, "x " * 30000), (15, "x x x"), (2, "one two three four")]
    rows = [(*r, 1, "a", 2, "b") for r in texts]
    assert answers(hyperminhash.near_duplicates(spark.createDataFrame(rows, kind))) == brute(texts)
    assert answers(hyperminhash.near_duplicates(spark.createDataFrame([], kind))) == []


def test_registers_keep_zeros_and_mantissa_of_the_least_hash():
    rng = np.random.default_rng(3)
    hashes = np.sort(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    got = hyperminhash.registers(hashes, np.array([0, 5000, 5000]))
    assert (got[1] == 0).all()
    for k in range(128):
        least = min(int(h) & ((1 << 57) - 1) for h in hashes.tolist() if h >> 57 == k)
        bits = f"{least:057b}"
        zeros = bits.index("1")
        assert got[0, k] == ((zeros + 1) << 10) + int(bits[zeros + 1 : zeros + 11], 2)


def test_estimates_are_corrected_for_chance():
    """Registers of disjoint sets are equal about as often as expected, with fewer mantissa bits too; a similar pair is estimated well."""
    rng = np.random.default_rng(5)
    for n in (20, 300, 5000):
        sets = [np.sort(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for _ in range(400)]
        regs = np.concatenate([hyperminhash.registers(s, np.array([0, n])) for s in sets])
        # drop mantissa bits so that chance matches are many enough to count
        short = regs >> np.uint16(8)
        seen = np.mean([((short[k] == short[k + 1]) & (regs[k] > 0)).sum() for k in range(0, 400, 2)])
        want = float(hyperminhash.chance_matches(np.array([n]), np.array([n]))[0]) * 256
        assert abs(seen - want) < 6 * np.sqrt(max(want, 0.1) / 200) + 0.1 * want


def test_bands_lose_hardly_any_pair_at_the_threshold():
    """400 pairs at a similarity of 0.85 for each size: all meet under a band, and no estimate rules one out."""
    rng = np.random.default_rng(7)
    for n in (7, 20, 60, 300, 3000):
        apart = 3 * n // 40
        met = 0
        for _ in range(400):
            every = rng.integers(0, 1 << 64, n + apart, dtype=np.uint64)
            one, two = np.sort(every[:n]), np.sort(every[apart:])
            assert 100 * (n - apart) >= 85 * (n + apart)
            regs = [hyperminhash.registers(s, np.array([0, n])) for s in (one, two)]
            filled = (regs[0] > 0) | (regs[1] > 0)
            equal = regs[0] == regs[1]
            met += int(hyperminhash.first_bands(equal, filled)[0] < hyperminhash.BANDS and hyperminhash.may_link((equal & filled).sum(axis=1), filled.sum(axis=1), np.array([n]), np.array([n]), 0.85)[0])
        assert met == 400


def test_long_and_short_texts_have_the_same_hashes_alone_and_together():
    import pyarrow as pa

    texts = ["a b", "", "a b c a b c", "q", "a b c d " * 50, "a b c"]
    data, offsets = utf8(pa.array(texts))
    hashes, bounds = hyperminhash.shingle_hashes(data, offsets, 3)
    for k, t in enumerate(texts):
        alone, _ = hyperminhash.shingle_hashes(*utf8(pa.array([t])), 3)
        assert hashes[bounds[k] : bounds[k + 1]].tolist() == alone.tolist() and len(alone) == len(shingles(t))
