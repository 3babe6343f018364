import random
from collections import Counter

import edge
import pytest
import xxhash
from pyspark.sql import functions as F

from loadcast.llm import simhash
from loadcast.llm.components import components


def brute(text, n=3):
    words = edge.words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) <= n else [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_and_components_match_brute_force(spark):
    rows = edge.documents()
    found = simhash.near_duplicates(edge.frame(spark, rows)).collect()
    prints = {}
    for r in rows:
        prints.setdefault(signed(brute(r[1])), []).append(r[0])
    assert Counter((r.doc_id, r.fp) for r in found) == Counter((i, fp) for fp, ids in prints.items() for i in ids)
    group = edge.groups(list(prints), lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2)
    least = {}
    for fp, ids in prints.items():
        known = [i for i in ids if i is not None]
        if known:
            least[group[fp]] = min(least.get(group[fp], known[0]), *known)
    assert all(r.component_id == least.get(group[r.fp]) for r in found)


def test_native_hash_agrees(spark):
    found = spark.sql("SELECT xxhash64('a b c') AS h").first().h
    assert found == signed(xxhash.xxh64_intdigest(b"a b c", 42))


@pytest.mark.parametrize("cell_pairs", [1, 3, 1000])
def test_links_are_whole_for_pairs_and_midpoints(spark, cell_pairs):
    """Clusters of flipped bits, with cells far over and under the limit."""
    rng = random.Random(5)
    prints = {0, (1 << 64) - 1}
    for _ in range(6):
        center = rng.getrandbits(64)
        for _ in range(25):
            p = center
            for b in rng.sample(range(64), rng.randrange(0, 5)):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(map(signed, prints))
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    links = simhash.links(df, cell_pairs=cell_pairs)
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
    assert all(near(r.u, r.v) for r in links.collect())
    label = {r.node: r.component for r in components(links).collect()}
    assert {p: label.get(p, p) for p in prints} == edge.groups(prints, near)


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(1)
    pairs = [(signed(a), signed(a ^ rng.getrandbits(64) & rng.getrandbits(64))) for a in (rng.getrandbits(64) for _ in range(200))]
    df = spark.createDataFrame(pairs, "a bigint, b bigint").select(
        "a", "b", F.bit_count(simhash.embedding("a").bitwiseXOR(simhash.embedding("b"))).alias("low"),
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("full"))
    for r in df.collect():
        counts = [sum(abs((x >> s & 3).bit_count() - (y >> s & 3).bit_count()) for s in range(0, 64, 2))
                  for x, y in [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1)]]
        assert counts == [r.low] and r.low <= r.full


def test_long_chain_and_loops(spark):
    n = 300
    edges = [(i, i + 1) for i in range(n)] + [(5, 5), (1000, 1001), (1001, 1000), (1000, 1001), (None, 3), (7, None)]
    rows = components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    found = {r.node: r.component for r in rows}
    assert len(rows) == len(found) == n + 3
    assert all(found[i] == 0 for i in range(n + 1)) and found[1001] == found[1000] == 1000


def test_one_of_each_keeps_columns_and_smallest(spark):
    docs = edge.frame(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 0 in ids and 110 not in ids and 111 not in ids and ids.count(130) <= 1 and ids.count(None) == 2


def test_empty_table(spark):
    assert simhash.near_duplicates(edge.frame(spark, [])).count() == 0
    assert simhash.one_of_each(edge.frame(spark, [])).count() == 0


def test_odd_distance_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp bigint"), max_distance=3)
