import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from rasterloom.llm import line_dedup, quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    t = text or ""
    words = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, r, n < 10 or 100 * r > 20 * n


def test_base_columns(spark, small, docs, hard, clash):
    tables = [spark.read.parquet(f"{small}/documents.parquet"), docs(hard + [(20, "a b c d e a b c d e f\n\nx\nx\n x"), (21, "q w e r t " * 9)], clash)]
    for table in tables:
        got = quality_rules.annotate(table.select("doc_id", "text"), table.select("doc_id").limit(5)).toPandas()
        assert len(got) == table.count()
        for x in got.itertuples():
            assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute_base(x.text)
            assert not (x.base_failed and x.kept)


def test_scores_match_brute_force(spark, small):
    import xxhash

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").select("doc_id")
    good = {r["doc_id"] for r in labels.collect()}
    got = quality_rules.annotate(docs, labels).toPandas()
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def buckets(text):
        words = WORD.findall(text.lower())
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
        pair = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), a) for a, b in zip([xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42) for x in h], h[1:])]
        return [signed(x) % 10_000 for x in h + pair]

    grams = [np.bincount(buckets(t), minlength=10_000) for t in got.text]
    raw = np.sum(grams, axis=0)
    target = np.sum([g for g, d in zip(grams, got.doc_id) if d in good], axis=0)
    ratio = np.log(target + 1) - np.log(raw + 1) + np.log(raw.sum() + 10_000) - np.log(target.sum() + 10_000)
    expected = np.array([(g * ratio).sum() / (g.sum() + quality_rules.PRIOR) for g in grams])
    assert np.allclose(got.score, expected, atol=1e-5)
    assert ((got.score >= quality_rules.THRESHOLD) & ~got.base_failed).equals(got.kept)


def test_quality_without_labels_and_empty(docs, hard, clash):
    table = docs(hard, clash)
    got = quality_rules.annotate(table.select("doc_id", "text"), table.select("doc_id").limit(0)).toPandas()
    assert (got.score == 0).all()
    kept = quality_rules.keep_good(table, table.select("doc_id"))
    assert kept.columns == table.columns and 0 < kept.count() < len(hard)
    assert quality_rules.keep_good(docs([]), docs([]).select("doc_id")).count() == 0


def brute_lines(rows, least):
    strip = " \t\n\x0b\x0c\r"
    sites, first = {}, {}
    for d, text, source in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if body := line.strip(strip):
                sites.setdefault(body, set()).add(source)
                place = (d is None, d if d is not None else 0, pos)
                first[body] = min(first.get(body, place), place)
    out = []
    for d, text, source in rows:
        if text is None:
            out.append((d, None, 0))
            continue
        kept, gone = [], 0
        for pos, line in enumerate(text.split("\n")):
            body = line.strip(strip)
            if body and len(sites[body]) >= least and first[body] != (d is None, d if d is not None else 0, pos):
                gone += 1
            else:
                kept.append(line)
        out.append((d, "\n".join(kept), gone))
    return out


@pytest.mark.parametrize("least", [2, 3, 5])
def test_line_dedup_matches_brute_force(docs, least):
    rng = np.random.default_rng(least)
    pool = [f"line number {i} of the pool" for i in range(30)]
    rows = []
    for d in range(120):
        lines = [pool[k] for k in rng.integers(0, 30, 4)] + [f"own line {d}", "", "  everywhere  " if d % 3 else "everywhere"]
        rows.append((d, "\n".join(lines), [None, "a", "b", "c", "d", "e", "f"][int(rng.integers(0, 7)) if d % 4 else 1]))
    got = line_dedup.remove_boilerplate(docs(rows), min_sites=least).toPandas().sort_values("doc_id")
    assert [tuple(x) for x in got[["doc_id", "text", "n_removed_lines"]].to_numpy().tolist()] == brute_lines(rows, least)


def test_line_dedup_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    sql = con.execute(queries.ORACLE_SQL["op5_line_dedup"]).df()[["doc_id", "n_removed_lines", "text"]].sort_values("doc_id", ignore_index=True)
    got = queries.op5_line_dedup(spark, small).toPandas().sort_values("doc_id", ignore_index=True)
    pd.testing.assert_frame_equal(got, sql)


def test_line_dedup_hard_rows(docs, hard, clash):
    table = docs(hard + [(i, "shared\nown " + str(i), f"s{i}") for i in range(30, 40)], clash)
    got = line_dedup.remove_boilerplate(table)
    assert got.columns == table.columns + ["n_removed_lines"]
    rows = got.toPandas()
    assert len(rows) == len(hard) + 10 and rows.n_removed_lines.sum() == 9
    assert rows.loc[rows.doc_id == 2, "text"].isna().all()
    assert line_dedup.remove_boilerplate(docs([])).count() == 0
