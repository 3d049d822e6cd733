import random
import re

import numpy as np
import xxhash

from factloom.llm import simhash

SF = "/root/testdata/sf0.001"


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """The smallest id that each row reaches, by comparing all pairs."""
    ids = list(range(len(prints)))
    root = ids[:]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array([p for _, p in prints], np.uint64)
    for i in ids:
        near = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= simhash.LINK_BITS)
        for j in near.tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i in ids:
        d = prints[i][0]
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(prints[i][0], prints[i][1], least.get(find(i))) for i in ids]


def test_fingerprints():
    rng = random.Random(4)
    texts = [None, "", " \t", "one", "one two THREE", "a b c d", "É é a\x0bb \x1f c", "w " * 70000, "ß\xa0x y z w v"]
    texts += [" ".join(rng.choices("abcde", k=rng.randrange(1, 90))) for _ in range(200)]
    assert [simhash.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]


def planted(rng, n):
    """Fingerprints with chains of near ones."""
    out = [(i, rng.getrandbits(64)) for i in range(n)]
    for k in range(n):
        p = rng.choice(out)[1]
        for b in rng.sample(range(64), rng.randrange(0, 7)):
            p ^= 1 << b
        out.append((n + k, p))
    return out


def test_links_are_all_pairs_within_four_bits(spark):
    prints = planted(random.Random(8), 400)
    values = sorted({p for _, p in prints} | {0, 1, 3, 2**64 - 1, 2**63})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    for axes in (5, 7):
        got = sorted(tuple(r) for r in simhash.links(nodes, axes, crowd=10**9).collect())
        want = sorted(
            tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4
        )
        assert got == want


def test_crowded_cells_give_the_same_components(spark):
    """Dense clusters and chains: stars and settled cells lose no link, and few are made."""
    rng = random.Random(9)
    prints = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for k in range(300):
            p = centre
            for b in rng.sample(range(64), rng.randrange(0, 4)):
                p ^= 1 << b
            prints.add(p)
    prints |= {p for _, p in planted(rng, 200)}
    values = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp long").repartition(6)
    want = {}
    for i, p, root in brute_components(list(enumerate(values))):
        want.setdefault(root, set()).add(signed(p))
    for axes, crowd in ((5, 4), (6, 32), (None, 2)):
        edges = simhash.links(nodes, axes, crowd)
        got = {}
        for r in simhash.components(edges).collect():
            got.setdefault(r["root"], set()).add(r["node"])
        assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)
        every = sum((a ^ b).bit_count() <= 4 for i, a in enumerate(values) for b in values[:i])
        assert edges.count() < every / 3


def test_axes_follow_the_number_of_fingerprints():
    axes = [simhash.axes_for(10**k) for k in range(11)]
    assert axes == sorted(axes) and axes[0] == simhash.LEAST_AXES and 8 < axes[9] < simhash.MOST_AXES


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = brute_components([(r["doc_id"], brute_print(r["text"])) for r in docs])
    got = simhash.query(spark, SF).collect()
    assert sorted((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in got) == sorted(want)
    assert all(len(r["fingerprint"]) == 16 for r in got)


def test_odd_rows(spark):
    rows = [(None, "a b c d e", "x"), (5, "A b c d e", "x"), (5, "A b c d e", "y"), (7, None, "x"), (6, "", "x"), (None, "z y x w v u", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((repr(r["doc_id"]), repr(r["component_id"])) for r in simhash.near_duplicates(df).collect())
    assert got == sorted([("None", "5"), ("5", "5"), ("5", "5"), ("7", "6"), ("6", "6"), ("None", "None")])
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert sorted(repr(r["doc_id"]) for r in simhash.deduplicated(df).collect()) == ["5", "6", "None"]


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(40)] + ["", None]
    upper = [t.upper() for t in texts[:40]]
    rows = []
    for i, t in enumerate(texts):  # a third without any id, a third with ids on several unlike texts
        ids = [[None, None], [None, 7, 7], [7, 3 + i % 5, None]][i % 3]
        for j, d in enumerate(ids):
            rows.append((d, upper[i] if j == 1 and i < 40 else t, f"{i}.{j}"))
        rows.append((*rows[-1][:2], f"{i}.again"))
    rng.shuffle(rows)
    # brute force: rows in one component, by comparing all pairs of fingerprints
    prints = np.array([brute_print(t) for _, t, _ in rows], np.uint64)
    of = list(range(len(rows)))
    for a in range(len(rows)):
        for b in np.flatnonzero(np.bitwise_count(prints ^ prints[a]) <= simhash.LINK_BITS).tolist():
            x, y = of[a], of[b]
            of = [min(x, y) if c in (x, y) else c for c in of]
    groups = {}
    for row, c in zip(rows, of, strict=True):
        groups.setdefault(c, []).append(row)
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    kept = [tuple(r) for r in kept.collect()]
    assert len(kept) == len(set(kept)) == len(groups) > 35
    for group in groups.values():
        (one,) = [r for r in kept if r in group]
        assert one[0] == min((d for d, _, _ in group if d is not None), default=None)


def test_a_long_chain_is_one_component(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long").repartition(4)
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}
