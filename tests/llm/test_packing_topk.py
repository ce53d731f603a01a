import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rasterloom.llm import packing, queries, topk

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "plain words", "  two  spaces \n\n\t tabs", "naïve 東京 😀 İ x", "it's they'll we'd 123 4567 !!!???", "<|endoftext|> inside", "a\x00b\x7f", "x" * 3000, "\r\n\r\n", "ÀÉ" * 50]


def test_ids_are_the_json_tokenizers():
    t, own = Tokenizer.from_file(PATH), packing.encoder(PATH)
    for text in ODD:
        assert own.encode_to_numpy(text, allowed_special="all").tolist() == t.encode(text, add_special_tokens=False).ids


def test_ids_of_long_white_space_runs():
    """Runs that the pattern matcher gives up on, alone and before, between and behind words."""
    t, own = Tokenizer.from_file(PATH), packing.encoder(PATH)
    run = " " * 1_000_000
    with pytest.raises(ValueError):
        own.encode_to_numpy(run)
    for text in (run, "\n" * 1_000_001, "a" + run + "word" + run, run + "'s x", "x\u3000" + run[:-3] + "\x1c" + "\t" * 5000 + "7" + run + "\r\n!"):
        assert packing.encode(text, PATH).tolist() == t.encode(text, add_special_tokens=False).ids


def test_ids_of_very_long_texts():
    for c, n in ((" ", 2_500_000), ("\n", 2_500_000), ("x", 10_000_000), ("a ", 5_000_000)):
        assert len(packing.encode(c * n, PATH)) >= len(c) * n / 100
    assert packing.encode(" " * 10_000_000, PATH).tolist() == [220] * 10_000_000


@pytest.mark.parametrize("seed", range(4))
def test_sequences_are_full_and_exact(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 2049 if seed else 800, 700)
    sequence, offset = packing.pack_sizes(sizes, 2048)
    for s in np.unique(sequence):
        own = np.argsort(offset[sequence == s])
        at, n = offset[sequence == s][own], sizes[sequence == s][own]
        assert (at == np.cumsum(n) - n).all() and n.sum() <= 2048
    plain = len(packing.best_fit(sizes[sizes < 2048], 2048)) + (sizes >= 2048).sum()
    assert len(np.unique(sequence)) <= plain


def test_local_search_empties_sequences():
    """From four sequences of length 10 no single move helps; two exchanges and a move leave three full ones."""
    sizes = np.array([6, 6, 4, 4, 5, 5])
    bad = [[0], [1], [2, 4], [3, 5]]
    better = packing.local_search(sizes, [list(b) for b in bad], 10)
    assert len(better) == 3 and sorted(sum(better, [])) == list(range(6)) and all(sizes[b].sum() <= 10 for b in better)


def test_two_for_one_exchange():
    sizes = np.array([7, 5, 3, 4, 9])
    got = packing.local_search(sizes, [[0], [1, 4][:1], [2, 3]], 14)
    assert all(sizes[b].sum() <= 14 for b in got) and len(got) == 2


def check(table, rows):
    got = packing.pack(table, PATH, group_items=50).toPandas()
    t = Tokenizer.from_file(PATH)
    ids = {d: t.encode(x or "", add_special_tokens=False).ids + [0] for d, x in rows}
    for d, g in got.sort_values(["doc_id", "piece"]).groupby("doc_id"):
        assert g.piece.tolist() == list(range(len(g))) and (g.start == np.cumsum(g.length) - g.length).all() and g.length.sum() == len(ids[d])
        assert (g.length.iloc[1:] == 2048).all()
        for x in g.itertuples():
            assert zlib.crc32(np.array(ids[d][x.start : x.start + x.length], "<u4").tobytes()) == x.ids_crc32
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == np.cumsum(g.length) - g.length).all() and g.length.sum() <= 2048
    return got


def test_pack_documents(spark, small, docs, clash):
    table = spark.read.parquet(f"{small}/documents.parquet")
    got = check(table, [(r["doc_id"], r["text"]) for r in table.collect()])
    assert got.sequence_id.nunique() <= 1.03 * got.length.sum() / 2048 + 5
    rows = [(i, t) for i, t in enumerate(ODD + [None, "long words here " * 4000])]
    check(docs(rows, clash), rows)
    assert packing.pack(docs([]), PATH).count() == 0
    same = packing.pack(docs([(None, "a b c"), (None, "a b c"), (1, "d"), (1, "d")]), PATH, with_ids=True).toPandas()
    assert len(same) == 4 and all(zlib.crc32(np.array(x.ids, "<u4").tobytes()) == x.ids_crc32 for x in same.itertuples())


def test_topk_is_brute_force(spark, small):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    sql = con.execute(queries.ORACLE_SQL["op8_topk"]).df().sort_values(["query_id", "rank"], ignore_index=True)
    got = queries.op8_topk(spark, small).toPandas().sort_values(["query_id", "rank"], ignore_index=True)
    assert got.equals(sql)


def test_topk_hot_codes_and_ties(spark):
    rng = np.random.default_rng(2)
    codes = [5] * 300 + [7] * 40 + rng.integers(0, 1 << 62, 200).tolist()
    rows = spark.createDataFrame([(i, [int(c)]) for i, c in enumerate(codes)], "id long, code array<long>")
    for m in (3, 4, 8):
        got = topk.search(rows.where("id % 50 = 0"), rows, 10, m).toPandas()
        for q in range(0, len(codes), 50):
            d = sorted((bin(codes[q] ^ c).count("1"), i) for i, c in enumerate(codes) if i != q)[:10]
            mine = got[got.query_id == q].sort_values("rank")
            assert list(zip(mine.distance, mine.neighbor_id)) == d


def test_topk_hard_rows(spark):
    schema = "vec_id long, embedding array<float>, code int, id int"
    rows = [(0, [1.0] * 64, 1, 1), (0, [1.0] * 64, 1, 1), (1, None, 1, 1), (None, [1.0] * 64, 1, 1), (2, [float("nan"), None] + [1.0] * 62, 1, 1), (3, [1.0] * 3, 1, 1), (4, [1.0] * 70, 1, 1)]
    got = topk.self_search(spark.createDataFrame(rows, schema), k=3).toPandas()
    assert list(zip(got.sort_values("rank").neighbor_id, got.sort_values("rank").distance)) == [(2, 2), (4, 6), (3, 61)]
    assert topk.self_search(spark.createDataFrame([], schema)).count() == 0


def test_topk_uses_every_value(spark):
    """Vectors of 200 values that agree in the first 64: brute force over all signs."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=200)
    vectors = [np.where(np.arange(200) < 64, centre, centre + rng.normal(size=200) * 2) for _ in range(300)]
    got = topk.self_search(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).toPandas()
    signs = np.array([v > 0 for v in vectors])
    for q in range(0, 300, 50):
        d = sorted((int((signs[q] != s).sum()), i) for i, s in enumerate(signs) if i != q)[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(zip(mine.distance, mine.neighbor_id)) == d
