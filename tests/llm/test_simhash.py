import re

import numpy as np
import pandas as pd
import xxhash

from rasterloom.llm import simhash
from rasterloom.operators.components import connected_components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, errors=3):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= errors:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components_match_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.toPandas()
    got = simhash.near_duplicates(docs).toPandas().set_index("doc_id")
    fps = [brute_fingerprint(t) for t in rows.text]
    groups = brute_groups(fps)
    least = {}
    for g, d in zip(groups, rows.doc_id):
        least[g] = min(least.get(g, d), d)
    for d, f, g in zip(rows.doc_id, fps, groups):
        assert got.loc[d, "fingerprint"] == f"{f:016x}"
        assert got.loc[d, "component_id"] == least[g]


def test_dense_group_needs_opened_nodes(spark):
    """Many fingerprints around a few centres: all caps give the same components as brute force."""
    rng = np.random.default_rng(5)
    values = {0, (1 << 64) - 1}
    for centre in rng.integers(0, 1 << 63, 4, dtype=np.uint64).tolist():
        for _ in range(60):
            x = centre
            for k in rng.integers(0, 64, int(rng.integers(0, 7))).tolist():
                x ^= 1 << k
            values.add(x)
    fps = sorted(values)
    groups = brute_groups(fps)
    expected = {frozenset(f for f, g in zip(fps, groups) if g == k) for k in set(groups)}
    expected = {s for s in expected if len(s) > 1}
    df = spark.createDataFrame(pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64)}))
    for cap in (4096, 20, 3):
        found = connected_components(simhash.node_links(df, 3, 8, cap)).toPandas()
        node = found.node.to_numpy().view(np.uint64)
        got = {frozenset(node[found.component == k].tolist()) for k in found.component.unique()}
        assert got == expected, cap


def test_trie_pairs_finds_every_pair():
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 63, 100, dtype=np.uint64), np.uint64(7) << rng.integers(0, 61, 50, dtype=np.uint64)]))
    flat = np.full(65, 3)
    got = {(int(a), int(b)) for i, j in simhash.trie_pairs(keys, np.array([[0, len(keys), 0, len(keys), 0]]), 0, flat) for a, b in zip(i, j)}
    expected = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if bin(int(keys[i] ^ keys[j])).count("1") <= 3}
    assert got == expected


def test_hard_rows(spark, docs, hard, clash):
    got = simhash.near_duplicates(docs(hard, clash)).toPandas()
    assert len(got) == len(hard)
    blank = got[got.fingerprint == "0" * 16]
    assert len(blank) == 4 and set(blank.component_id) == {2}
    assert simhash.near_duplicates(docs([])).count() == 0
    only = simhash.near_duplicates(docs([(None, "a b c d")])).toPandas()
    assert only.component_id.isna().all()
