import re
import zlib

import numpy as np
import pytest

from rasterloom.llm import licenses, ordinal, queries, toxicity

LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_base(text):
    words = LICENSE_WORD.findall((text or "").translate(LOWER))
    found = [(i, label) for phrase, label in licenses.BASE.items() for k in [phrase.split()] for i in range(len(words)) if words[i : i + len(k)] == k]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_license_places(spark, small, docs, hard, clash):
    odd = [(30, "CC-BY-NC cc by nc, CC BY NC 4.0. under the MIT license"), (31, "x cc by nc"), (32, "apache license version 2apache license version 2 under THE mit License")]
    for table in (spark.read.parquet(f"{small}/documents.parquet"), docs(hard + odd, clash)):
        got = {}
        for r in licenses.scan_licenses(table).collect():
            got.setdefault(r["doc_id"], []).append(r)
        for row in table.collect():
            expected = brute_base(row["text"])
            assert any((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == expected for r in got[row["doc_id"]])
            for r in got[row["doc_id"]]:
                assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert licenses.scan_licenses(docs([])).count() == 0


@pytest.mark.parametrize(
    "expression, labels, least",
    [
        ("MIT", ["mit"], 1),
        ("GPL-3.0-only OR MIT", ["gpl-3", "mit"], 1),
        ("GPL-2.0+ AND MIT", ["gpl-2", "mit"], 3),
        ("GPL-2.0 WITH Classpath-exception-2.0 AND MIT OR AGPL-3.0", ["gpl-2", "mit", "agpl-3"], 3),
        ("(MIT OR GPL-3.0) AND (Apache-2.0 OR AGPL-3.0)", ["mit", "gpl-3", "apache-2", "agpl-3"], 1),
        ("MIT AND (GPL-3.0 OR Apache-2.0)", ["mit", "gpl-3", "apache-2"], 1),
        ("MIT OR", ["mit"], 1),
        ("MIT GPL-3.0", ["mit"], 1),
        ("", [], None),
        (") AND MIT", [], None),
        ("see LICENSE file", [], None),
        ("MIT and other text here", ["mit"], 1),
        ("MIT OR (unknown AND GPL-3.0)", ["mit"], 1),
        ("GPL-2.0 WITH something", ["gpl-2"], 3),
        ("mit AND LicenseRef-Mine", ["mit", "licenseref-mine"], 3),
    ],
)
def test_license_expressions(expression, labels, least):
    assert licenses.evaluate(expression) == (labels, least)


def test_license_tag(docs):
    got = licenses.scan_licenses(docs([(1, "code\n// SPDX-License-Identifier: MIT OR Apache-2.0\nGPL-3.0 below"), (2, "spdx license"), (3, "SPDX-License-Identifier: see the file"), (4, "xspdx license identifier: MIT"), (5, "SPDX-License-Identifier:\nMIT")])).toPandas().set_index("doc_id")
    assert got.labels.tolist() == ["apache-2,mit", "", "", "", ""] and got.score[1] > 0.99 and got.score[2] == 0


def brute_labels(text):
    """All labels: every phrase looked for by itself, tags by lines."""
    words = LICENSE_WORD.findall((text or "").translate(LOWER))
    phrases = licenses.BASE | licenses.NOTICES
    line = " " + " ".join(words) + " "
    found = {x for p, x in phrases.items() if f" {p} " in line}
    for row in (text or "").split("\n"):
        for m in re.finditer(r"(?<![a-z0-9])spdx-license-identifier(?![a-z0-9])\s*:?(.*)", row, re.I):
            found |= set(licenses.evaluate(m[1])[0])
    return ",".join(sorted(found))


def test_licences_of_whole_documents_are_brute_force(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    got = licenses.scan_licenses(table).toPandas().set_index("doc_id")
    texts = table.toPandas().set_index("doc_id").text
    for d, text in texts.items():
        assert got.labels[d] == brute_labels(text)
        doubt = 1.0
        tagged = re.search("spdx", text or "", re.I)
        for x in filter(None, got.labels[d].split(",")):
            doubt *= 1 - (licenses.RESERVED_WEIGHT if x == "all-rights-reserved" else licenses.PHRASE_WEIGHT)
        assert tagged or abs(got.score[d] - (1 - doubt)) < 1e-9


def words_of(rng, n):
    syllables = ["ka", "lo", "mi", "tor", "ven", "sa", "ri", "dul"]
    return ["".join(rng.choice(syllables, int(rng.integers(1, 4)))) for _ in range(n)]


@pytest.fixture(scope="module")
def toxic_corpus(docs, spark):
    """Toxic documents hold insults, in test rows also written with signs, gaps and repeats; the second value is (doc_id, toxic)."""
    rng = np.random.default_rng(3)
    insults = ["grobnik", "stulpig", "vardox", "plimber"]
    noisy = ["gr0bn1k", "s t u l p i g", "v@rd0x", "pliiiimber", "g.r.o.b.n.i.k", "Stulpiiiig!!!"]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 4 == 0
        words = words_of(rng, int(rng.integers(20, 120)))
        if toxic:
            held = zlib.crc32(str(i).encode()) % 3 == 1
            for _ in range(3):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(noisy if held else insults)))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs(rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_deobfuscated_toxicity_on_held_out_rows(toxic_corpus):
    table, labels = toxic_corpus
    got = toxicity.score(table, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.held_out == (got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3) == 1)).all()
    test = got[got.held_out]
    assert test.predicted[test.toxic == 1].mean() > 0.9 and test.predicted[test.toxic == 0].mean() < 0.02
    assert ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_held_out_labels_are_never_read(toxic_corpus, spark):
    from pyspark.sql import functions as F

    table, labels = toxic_corpus
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = toxicity.score(table, labels).toPandas().sort_values("doc_id").score.to_numpy()
    b = toxicity.score(table, flipped).toPandas().sort_values("doc_id").score.to_numpy()
    assert np.allclose(a, b)


def test_decode_against_all_paths():
    """Viterbi finds the best of all readings of a short token."""
    from itertools import product

    counts = np.zeros(1 << 18, np.float32)
    rng = np.random.default_rng(0)
    counts[:] = rng.integers(0, 5, len(counts))
    model = toxicity.CharModel(counts, float(counts.sum()))
    for token in ("a1b0", "5a1", "x7e3"):
        choices = [[(c, toxicity.AS_IS)] * (c not in toxicity.LOOKS or c.isalpha()) + [(x, toxicity.LOOKALIKE) for x in toxicity.LOOKS.get(c, "")] for c in token]

        def total(path):
            context, p = "^", 0.0
            for letter, channel in path:
                p += channel + model.log(context[1 - toxicity.ORDER :], letter)
                context += letter
            return p + model.log(context[1 - toxicity.ORDER :], "$")

        best = max(product(*choices), key=total)
        assert toxicity.decode(token, model) == "".join(x for x, _ in best)


def model_of(words, n=100):
    hashes, counts, characters = toxicity.gram_counts(words, np.full(len(words), n))
    table = np.zeros(1 << 18, np.float32)
    np.add.at(table, hashes >> 14, counts)
    return toxicity.CharModel(table, characters)


def words_in(text, model):
    low = text.lower()
    of = toxicity.Restored(model)
    return {w for t in toxicity.tokens_of(low) for w in of.restore(t)} | set(toxicity.lonely(low, model))


def test_signs_inside_and_at_the_ends_of_tokens_are_decoded():
    """Dots inside tokens, tokens without letters and lookalikes at the ends reach the lattice; punctuation is still dropped."""
    model = model_of(["stupid", "idiot", "trash", "ass", "hello", "garden"])
    for text, word in [("stu.pid", "stupid"), ("an id.iot, he", "idiot"), ("tr,ash.", "trash"), ("!diot", "idiot"), ("@$$", "ass"), ("455", "ass"), ("(hello!)", "hello"), ("garden!, hello.", "garden")]:
        assert word in words_in(text, model), text


def test_words_anywhere_in_long_tokens_and_chains():
    """No cut tears a word: hidden ones are found at every place of a token of 300 characters and of a chain of 300 letters."""
    model = model_of(["stupid", "garden", "hello", "street"])
    for n in range(0, 48, 5):
        token = "_".join(["garden"] * n + ["s7up1d"] + ["hello"] * (48 - n))
        assert "stupid" in words_in(token, model), n
        chain = " ".join(" ".join(w) for w in ["garden"] * n + ["stupid"] + ["street"] * (48 - n))
        assert "stupid" in " ".join(toxicity.lonely(chain, model)).replace(" ", ""), n
    assert words_in("stuuuuuuuuuuuuuuuuuuuuuuuuuupid", model) == {"stupid"}


def test_long_decoding_is_the_full_one():
    """Settling 64 characters back gives the path that an unbounded memory gives."""
    rng = np.random.default_rng(2)
    words = ["stupid", "garden", "hello", "street", "tool", "seat"]
    model = model_of(words)
    for _ in range(5):
        text = "".join(rng.choice(list("st0ol3a7_-1pid"), 400))
        assert toxicity.decode(text, model) == toxicity.decode(text, model, lag=10**6)


def test_score_is_the_plain_computation(toxic_corpus):
    """Counts, lexicon, regression and score once more without Spark."""
    table, labels = toxic_corpus
    rows = table.toPandas().merge(labels.toPandas(), on="doc_id")
    rows["fold"] = rows.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3)
    seen = {}
    for t in rows.text:
        for w in toxicity.tokens_of(t.lower()):
            if w.isalpha():
                seen[w] = seen.get(w, 0) + 1
    hashes, n, characters = toxicity.gram_counts(list(seen), np.array(list(seen.values())))
    bits = min(22, max(18, (4 * (len(hashes) + 1)).bit_length()))
    grams = np.zeros(1 << bits, np.float32)
    np.add.at(grams, hashes >> (32 - bits), n)
    model = toxicity.CharModel(grams, characters)
    counts = {}
    total = np.zeros(4, int)
    for x in rows[rows.fold != 1].itertuples():
        kind = x.fold + x.toxic
        total[kind] += 1
        for b in {b for w in words_in(x.text, model) for b in toxicity.word_features(w)}:
            counts.setdefault(b, np.zeros(4, int))[kind] += 1
    bucket = np.array([*counts, toxicity.WORD_BUCKETS])
    by = np.array([*counts.values(), total])

    def tokens(clean, toxic):
        return toxicity.TokenScores(toxicity.Restored(model), dict(zip(*(v.tolist() for v in toxicity.lexicon(bucket, clean, toxic)))))

    first, both = tokens(by[:, 0], by[:, 1]), tokens(by[:, 0] + by[:, 2], by[:, 1] + by[:, 3])
    second = rows[rows.fold == 2]
    x, y = np.array([toxicity.summary(t, first) for t in second.text]), second.toxic.to_numpy().astype(float)
    all_, one = toxicity.logistic(x, y), toxicity.logistic(x[:, toxicity.ONE_WORD], y)
    z = np.array([toxicity.summary(t, both) for t in rows.text])
    logit = np.maximum(z @ all_, z[:, toxicity.ONE_WORD] @ one - toxicity.MARGIN)
    got = toxicity.score(table, labels).toPandas().set_index("doc_id").score.loc[rows.doc_id]
    assert np.allclose(got, 1 / (1 + np.exp(-np.clip(logit, -30, 30))), atol=1e-6)


def test_toxicity_hard_rows(docs, hard, clash, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs(hard, clash), none).toPandas()
    assert len(got) == len(hard) and (got.score == 0).all() and not got.held_out[got.doc_id.isna()].any()
    some = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, None), (7, 0), (5, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs(hard, clash), some).count() == len(hard)
    assert toxicity.score(docs([]), none).count() == 0


def test_several_labels_of_a_document(toxic_corpus, spark):
    """One that says toxic decides, in any order of rows; a bound on labelled rows is kept by ids."""
    table, labels = toxic_corpus
    a = toxicity.score(table, labels.unionByName(labels.selectExpr("doc_id", "0 as toxic"))).toPandas().set_index("doc_id").score
    b = toxicity.score(table, labels.selectExpr("doc_id", "0 as toxic").unionByName(labels)).toPandas().set_index("doc_id").score
    c = toxicity.score(table, labels).toPandas().set_index("doc_id").score
    assert np.allclose(a.sort_index(), c.sort_index()) and np.allclose(b.sort_index(), c.sort_index())
    from rasterloom.llm.text import bounded

    ids = spark.range(10_000).withColumnRenamed("id", "doc_id")
    n = [bounded(ids.repartition(k), 1000).orderBy("doc_id").toPandas().doc_id.tolist() for k in (2, 5)]
    assert n[0] == n[1] and 850 < len(n[0]) < 1150 and bounded(ids, 10_000).count() == 10_000


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(0)
    n = 600
    x = rng.integers(0, 3, n)
    ids = np.stack([x, np.full(n, 5)], axis=1).ravel()
    model = ordinal.fit(ids, np.ones(2 * n), np.repeat(np.arange(n), 2), x, 3, steps=400)
    assert model.thresholds[0] < model.thresholds[1]
    assert model.weights[0] < model.weights[1] < model.weights[2]
    above = model.above(model.weights[[0, 1, 2]] + model.weights[5])
    assert (above.sum(axis=1).round() == [0, 1, 2]).all()


def test_ordinal_gradient_is_that_of_the_likelihood():
    """A fitted model is no worse than models near it."""
    rng = np.random.default_rng(1)
    n = 300
    x = rng.integers(0, 4, n)
    y = np.clip(x // 2 + rng.integers(0, 2, n), 0, 2)
    rows = np.arange(n)
    model = ordinal.fit(x, np.ones(n), rows, y, 3, steps=3000, rate=0.05, l2=0.0)

    def loss(weights, thresholds):
        above = ordinal.Model(weights, thresholds).above(weights[x])
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        return -np.log(edge[rows, y] - edge[rows, y + 1]).sum()

    best = loss(model.weights, model.thresholds)
    for k in range(4):
        for step in (-0.05, 0.05):
            w = model.weights.copy()
            w[k] += step
            assert loss(w, model.thresholds) > best - 0.05
    for k in range(2):
        for step in (-0.05, 0.05):
            t = model.thresholds.copy()
            t[k] += step
            assert loss(model.weights, t) > best - 0.05


def test_ordinal_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op10_ordinal(spark, d).toPandas()
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    test = both[both.doc_id.map(lambda x: zlib.crc32(str(x).encode()) % 3) == 1]
    assert (test.kept == (test.quality == 1)).mean() > 0.95
    assert test.kept[test.quality == 1].mean() > 0.97


def test_ordinal_hard_rows(docs, hard, clash, spark):
    graded = spark.createDataFrame([(1, 2), (1, 2), (7, 0), (None, 1), (5, None)], "doc_id long, grade int")
    model = ordinal.train(docs(hard, clash), graded)
    got = ordinal.score(docs(hard, clash), model).toPandas()
    assert len(got) == len(hard) and got.tail_prob.between(0, 1).all() and got.expected_grade.between(0, 2).all()
    empty = ordinal.train(docs([]), graded)
    assert ordinal.score(docs([]), empty).count() == 0
    flat = ordinal.score(docs(hard), empty).toPandas()
    assert np.allclose(flat.score, 0) and np.allclose(flat.expected_grade, 1)


def test_ordinal_query_is_features_times_weights(spark, small):
    """The query's scores beside the sparse features of every text and the fitted weights."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    graded = ordinal.rated(spark.read.parquet(f"{small}/labels.parquet").where("crc32(cast(doc_id as string)) % 3 <> 1"))
    model = ordinal.train(docs, graded)
    got = queries.op10_ordinal(spark, small).toPandas().set_index("doc_id")
    texts = docs.toPandas().set_index("doc_id").text
    for d, text in list(texts.items())[:150]:
        ids, values = ordinal.features(text)
        score = float(np.dot(model.weights[ids], values))
        above = 1 / (1 + np.exp(model.thresholds - score))
        assert abs(got.score[d] - score) < 1e-3 and abs(got.expected_grade[d] - above.sum()) < 1e-3 and abs(got.tail_prob[d] - above[0]) < 1e-3


def test_several_grades_of_a_document(spark, docs):
    """The lowest counts, in any order of rows."""
    table = docs([(i, f"good words number {i}" if i % 2 else "junk junk junk") for i in range(60)])
    rows = [(i, 2 if i % 2 else 0) for i in range(60)]
    more = rows + [(i, 2) for i in range(60)]
    fits = [ordinal.train(table, spark.createDataFrame(r, "doc_id long, grade int")) for r in (rows, more, more[::-1])]
    assert all(np.allclose(f.weights, fits[0].weights, atol=1e-6) for f in fits)
