"""Near-duplicates at Jaccard >= 0.8 of 5-word shingles, beside brute force over all pairs."""

import corpus_pipeline
import numpy as np

from rasterloom.llm import simhash, similar


def brute_keep(rows, words=5):
    """Ids that stay, by every pair of texts."""

    def cut(text):
        w = (text or "").encode().lower().split()
        return {b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)} or ({b" ".join(w)} if w else set())

    sets = [cut(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or 10 * len(a & b) >= 8 * len(a | b) > 0:
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def near_copies():
    """Texts with 0 to 8 words changed, chains of small changes, a passage that many share, and short texts."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(500)]
    text = lambda n: list(rng.choice(vocabulary, n))
    passage, rows = text(30), []
    for _ in range(25):
        base = text(int(rng.integers(60, 200)))
        rows.append(base)
        for k in range(6):
            copy = list(base)
            for i in rng.integers(0, len(copy), int(rng.integers(0, 9))):
                copy[i] = "changed" + str(k)
            rows.append(copy)
    base = text(150)
    for k in range(60):  # a chain
        base = list(base)
        base[int(rng.integers(0, 150))] = f"step{k}"
        rows.append(base)
    rows += [passage + text(20) for _ in range(80)] + [text(3), text(3), [], []]
    order = rng.permutation(len(rows))
    return [(int(i), " ".join(rows[j])) for i, j in enumerate(order)]


def test_stage_keeps_one_of_every_similar_group(docs, spark):
    rows = near_copies()
    got = corpus_pipeline.near_duplicates(spark, docs(rows), "")
    assert sorted(r["doc_id"] for r in got.collect()) == brute_keep(rows)


def test_large_groups_and_blocks(docs, monkeypatch):
    """Nothing is lost where large groups are compared with further texts first, blocks are small, and no shingle is put last."""
    rows = sorted(near_copies())[:120]
    monkeypatch.setattr(similar, "LARGE", 3)
    monkeypatch.setattr(similar, "TURNS", 2)
    monkeypatch.setattr(similar, "BLOCK", 4)
    monkeypatch.setattr(similar, "PAIRS", 8)
    monkeypatch.setattr(similar, "OFTEN", 10**9)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs(rows)).collect()) == brute_keep(rows)


def test_bitmaps_never_differ_more_than_the_sets():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 400, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.9], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64)]))
        p, q = (np.frombuffer(similar.bitmap(v), np.uint64) for v in (x, y))
        assert np.bitwise_count(p ^ q).sum() <= len(np.setxor1d(x, y))


def test_proposed_links_are_checked(spark, docs):
    """Fingerprints of fewer bits propose texts that aren't alike; the whole sets decide."""
    rows = near_copies()[:100]
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs(rows), errors=12).collect()) == brute_keep(rows)


def test_rows_that_agree_in_id_and_text(docs):
    """Which row stays doesn't depend on the order of rows; rows equal in all columns are one."""
    table = docs([(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "x"), (2, "other words here and there now", "z"), (2, "other words here and there now", "z")])
    got = [sorted(map(tuple, simhash.keep_one(t).collect())) for t in (table, table.orderBy("source"), table.orderBy("source", ascending=False).repartition(3))]
    assert got[0] == got[1] == got[2] and [r[0] for r in got[0]] == [1, 2]


def test_hard_rows(docs, hard, clash):
    table = docs(hard, clash)
    got = simhash.keep_one(table)
    assert got.columns == table.columns
    kept = got.toPandas()
    assert len(kept) == 6 and set(kept.doc_id.dropna()) == {1, 2, 5, 6, 7} and kept.doc_id.isna().sum() == 1
    assert simhash.keep_one(docs([])).count() == 0
