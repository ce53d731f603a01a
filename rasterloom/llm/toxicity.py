"""Toxicity of noisy text: Viterbi decoding of character lattices under a character language model, then scoring.

1. Language model: word counts over all documents (each task combines its own), then counts of character 1- to 4-grams of
   the different words, weighted by their counts. The different n-grams are counted, and the model has four hash buckets
   for each, 2^18 to 2^22, which bound what reaches the driver.
2. Noisy channel: a token with digits or signs among its letters, or with a character three times running, and letters
   that stand alone one after another, form a lattice: a sign may stand for each letter it resembles, a repeated
   character may be one, a separator may be a word's end or nothing; at a token's ends, a sign may be punctuation. Viterbi
   finds the likeliest text under model and channel, for tokens of any length: what lies more than LAG characters back is
   settled by the best path so far. One or two characters repeated more than four times running count as four times.
   Tokens without noise have one path and stay as they are. Decoded tokens are cached per task, up to a bound.
3. Lexicon: for restored words and their beginnings (3 to 9 bytes), in how many toxic and other labelled documents they
   are found; the lower confidence bound of the log ratio counts if it is above 0. Counts are over the labelled documents
   of the two training folds, all of them up to `labelled`, else about so many, chosen by a hash of their ids, whose ids
   are broadcast; they are hashed into 2^20 buckets.
4. A document's score is the larger of two logistic regressions, on all its large word scores and on the largest alone
   (so that a short text's one sure word isn't outvoted), fitted on at most `sample` labelled documents
   of the second training fold, with a lexicon of the first; documents are scored with the lexicon of both.

Labels are used only from rows whose crc32(doc_id as text) mod 3 isn't 1: remainder 0 is the first fold, 2 the
second. Defined results: a null text is empty and scores as a text without lexicon words; a null id isn't held out
and never learnt from; a document with several labels is toxic if one says so; without labels of both kinds every score is 0; repeated rows are scored like others; an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.text import bounded
from rasterloom.plans.scale import Written

GRAM_BITS = (18, 22)
WORD_BUCKETS = 1 << 20
ORDER = 4
#: Entries of a cache, of the one that holds a number per token only, and characters behind the current one after which Viterbi settles.
CACHE, SCORES, LAG = 1 << 18, 1 << 19, 64
FLUSH = 400_000
TOP = (1, 2, 3, 5, 10)
KNEES = (2.0, 4.0, 6.0)
INPUTS = len(TOP) + len(KNEES) + 3
#: One word alone must be surer, in log odds.
MARGIN = 4.0
ONE_WORD = [0, *range(len(TOP), len(TOP) + len(KNEES)), INPUTS - 1]
KINDS = ("clean0", "toxic0", "clean2", "toxic2")
#: The letters that a sign is used for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l"}
#: Signs put between letters.
SEPARATORS = " .,-_*~·"
STRIP = ".,;:?\"'()[]{}<>#%&*|!~-_…"
#: Those that stand for no letter are punctuation at a token's ends; the others may be.
PLAIN = "".join(c for c in STRIP if c not in LOOKS)
#: Log probabilities of the channel.
AS_IS, LOOKALIKE, REPEATED = math.log(0.9), math.log(0.3), math.log(0.2)
#: Of a separator between single letters to be nothing or a word's end: other signs than spaces seldom end words there.
GAPS = {False: (math.log(0.95), math.log(0.05)), True: (math.log(0.3), math.log(0.7))}
ALONE = re.compile(r"(?<!\w)(?:\w[ .\-_*~·]){2,}\w(?!\w)")
RUN = re.compile(r"(.)\1\1")
AGAIN = re.compile(r"(..?)\1{4,}", re.S)
#: The same sign three times or more at an end of a token is decoration: no letter stands there so often.
DECORATION = re.compile(r"^(\W)\1{2,}|(\W)\2{2,}$")


def gram_hash(gram: str) -> int:
    h = 0
    for c in gram:
        h = (h * 1_000_003 ^ ord(c)) & 0xFFFFFFFF
    return h * 2_654_435_761 & 0xFFFFFFFF


def gram_counts(words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Different 32-bit hashes of the 1- to 4-grams of ^word$ and their counts, each word as often as counts says, and the number of characters."""
    length = np.array([len(w) + 2 for w in words], np.int64)
    letters = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(length) - length, length)
    weight = np.repeat(counts.astype(float), length)
    found, weights = [], []
    h = np.zeros(len(letters), np.uint64)
    for k in range(ORDER):  # h: hashes of the k characters up to and with the one before
        h = (h * np.uint64(1_000_003) ^ letters) & np.uint64(0xFFFFFFFF)
        inside = place >= k
        found.append((h * np.uint64(2_654_435_761) & np.uint64(0xFFFFFFFF))[inside].astype(np.int64))
        weights.append(weight[inside])
        h = np.concatenate([np.zeros(1, np.uint64), h[:-1]])
    hashes, of = np.unique(np.concatenate(found), return_inverse=True)
    return hashes, np.bincount(of, np.concatenate(weights), minlength=len(hashes)), float((counts * (length - 1)).sum())


class CharModel:
    """Interpolated character n-grams; ^ starts and $ ends a word. counts: by the upper bits of the hash, 2^k of them."""

    def __init__(self, counts: np.ndarray, total: float):
        self.counts, self.total = counts, max(1.0, total)
        self.shift = 32 - (len(counts).bit_length() - 1)
        self.known: dict[tuple[str, str], float] = {}

    def count(self, gram: str) -> float:
        return float(self.counts[gram_hash(gram) >> self.shift])

    def prob(self, context: str, c: str) -> float:
        p = (self.count(c) + 0.05) / (self.total + 10)
        for k in range(1, len(context) + 1):
            h = context[-k:]
            p = (self.count(h + c) + 5 * p) / (self.count(h) + 5)
        return p

    def log(self, context: str, c: str) -> float:
        got = self.known.get((context, c))
        if got is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            got = self.known[context, c] = math.log(max(1e-12, self.prob(context, c)))
        return got


def decode(observed: str, model: CharModel, lag: int = LAG) -> str:
    """The likeliest text behind an observed one."""
    observed = AGAIN.sub(r"\1\1\1\1", observed)
    states: dict[tuple[str, str], tuple[float, str]] = {("^", ""): (0.0, "")}  # (context, last observed) -> (log p, text not yet settled)
    head, tail = len(observed) - len(observed.lstrip(STRIP)), len(observed.rstrip(STRIP))
    settled: list[str] = []
    for at, c in enumerate(observed):
        following: dict[tuple[str, str], tuple[float, str]] = {}

        def put(context: str, p: float, text: str) -> None:
            key = (context[1 - ORDER :], c)
            if key not in following or following[key][0] < p:
                following[key] = (p, text)

        for (context, last), (p, text) in states.items():
            if c in STRIP and not head <= at < tail:
                put(context, p + (AS_IS if c in LOOKS else 0.0), text)
                if c not in LOOKS:
                    continue
            if c in SEPARATORS:
                joined, broken = GAPS[c == " "]
                put(context, p + joined, text)
                if text and text[-1] != " ":
                    put("^", p + broken + model.log(context, "$"), text + " ")
                continue
            for letter in LOOKS.get(c, ""):
                put(context + letter, p + LOOKALIKE + model.log(context, letter), text + letter)
            if c.isalpha() or c not in LOOKS:
                put(context + c, p + AS_IS + model.log(context, c), text + c)
            if last and text and (c == last or text[-1] == c):
                put(context, p + REPEATED, text)
        states = following
        if at % lag == lag - 1 and states:  # paths that disagree with the best one so far back go
            best = max(states.values())[1][:-lag]
            if best:
                settled.append(best)
                states = {k: (p, text[len(best) :]) for k, (p, text) in states.items() if text.startswith(best)}
    ends = [(p + model.log(context, "$"), text) for (context, _), (p, text) in states.items()]
    return "".join(settled) + max(ends)[1] if ends else ""


class Restored:
    """Restored words of lower-cased tokens."""

    def __init__(self, model: CharModel):
        self.model = model

    def restore(self, token: str) -> tuple[str, ...]:
        if token.isalpha() and not RUN.search(token):
            return (token,)
        bare = DECORATION.sub("", token.strip(PLAIN)).strip(PLAIN)
        if not any(c.isalpha() or c in LOOKS for c in bare.strip(STRIP) or bare):
            return ()
        if bare.isalpha() and not RUN.search(bare):
            return (bare,)
        return tuple(decode(bare, self.model).split())


_kept: dict[str, object] = {}


def kept(run: str, name: str, make):
    """The model, or a cache, of one scoring run that the tasks of a Python worker share; a worker holds one cache at a time."""
    if _kept.get("run") != run:
        _kept.clear()
        _kept["run"] = run
    if name not in _kept:
        for other in set(_kept) - {"run", "model"}:
            del _kept[other]
        _kept[name] = make()
    return _kept[name]


def tokens_of(low: str) -> list[str]:
    """Tokens of a lower-cased text; full stops and commas end them only before white space or the text's end."""
    return [t.rstrip(".,") for t in low.split()]


def lonely(low: str, model: CharModel) -> list[str]:
    """Words behind letters that stand alone one after another."""
    return [w for m in ALONE.finditer(low) for w in decode(m[0], model).split()]


def word_features(word: str) -> list[int]:
    """Buckets of the whole word and of its first 3 to 9 bytes (UTF-8)."""
    raw = word.encode("utf-8", "surrogatepass")
    whole = crc32(b"$", crc32(raw)) & (WORD_BUCKETS - 1)
    h = crc32(raw[:2])
    found = [whole]
    for k in range(2, min(9, len(raw))):
        h = crc32(raw[k : k + 1], h)
        found.append(h & (WORD_BUCKETS - 1))
    return found


class TokenFeatures(dict):
    """The buckets of a token's restored words."""

    def __init__(self, words: Restored):
        self.words = words

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        got = self[token] = tuple({b for w in self.words.restore(token) for b in word_features(w)})
        return got

    def of_text(self, text: str) -> set[int]:
        low = text.lower()
        found = set().union(*map(self.__getitem__, set(tokens_of(low))))
        found.update(b for w in lonely(low, self.words.model) for b in word_features(w))
        return found


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): lower-cased words of letters over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            words = [w for w in held if w.isalpha()]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(tokens_of((text.as_py() or "").lower()))
                if len(held) >= FLUSH:
                    yield out()
                    held.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def char_model(docs: DataFrame) -> tuple[np.ndarray, float]:
    """Hashed n-gram counts and the number of characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts, characters = gram_counts(batch.column(0).to_pylist(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.append(hashes, -1)), pa.array(np.append(counts, characters))], names=["h", "n"])

    grams = Written(word_counts(docs).mapInArrow(run, "h long, n double").groupBy("h").agg(F.sum("n").alias("n")), "char-grams")
    low, high = GRAM_BITS
    bits = min(high, max(low, (4 * grams.df.count()).bit_length()))
    got = grams.df.groupBy(F.when(F.col("h") < 0, F.lit(-1)).otherwise(F.shiftright("h", 32 - bits)).alias("bucket")).agg(F.sum("n").alias("n")).toArrow()
    grams.drop()
    bucket, n = got["bucket"].to_numpy(), got["n"].to_numpy()  # at most 2^bits + 1 rows
    counts = np.zeros(1 << bits, np.float32)
    counts[bucket[bucket >= 0]] = n[bucket >= 0]
    return counts, float(n[bucket < 0].sum())


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3


def lexicon_counts(labelled: DataFrame, shared, tag: str) -> dict[str, np.ndarray]:
    """Documents by bucket, fold (0 or 2) and label, from rows (text, toxic, fold); bucket 2^20 counts all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = kept(tag, "features", lambda: TokenFeatures(kept(tag, "model", lambda: Restored(CharModel(*shared.value)))))
        counts = np.zeros((4, WORD_BUCKETS + 1), np.int64)
        for batch in batches:
            for text, toxic, part in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = features.of_text(text.as_py() or "")
                counts[int(part) + int(toxic == 1), list(found) + [WORD_BUCKETS]] += 1
        hit = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), *(pa.array(c[hit]) for c in counts)], names=["bucket", *KINDS])

    rows = labelled.select("text", "toxic", F.col("fold").cast("int")).mapInArrow(run, "bucket long, " + ", ".join(f"{k} long" for k in KINDS))
    sums = rows.groupBy("bucket").agg(*(F.sum(k).alias(k) for k in KINDS))
    got = sums.where((F.col("toxic0") + F.col("toxic2") > 0) | (F.col("bucket") == WORD_BUCKETS)).toArrow()  # at most 2^20 + 1 rows
    return {c: got[c].to_numpy() for c in ("bucket", *KINDS)}


def lexicon(bucket: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, scores above 0): the lower confidence bound of the log ratio of the shares of toxic and other documents."""
    docs = np.flatnonzero(bucket == WORD_BUCKETS)
    if not len(docs) or not clean[docs[0]] or not toxic[docs[0]]:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    ratio = np.log((toxic + 0.5) / (toxic[docs[0]] + 1)) - np.log((clean + 0.5) / (clean[docs[0]] + 1))
    bound = ratio - 1.64 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    keep = (bound > 0) & (bucket < WORD_BUCKETS)
    return bucket[keep], bound[keep].astype(np.float32)


class TokenScores(dict):
    """The largest lexicon score of a token's restored words."""

    def __init__(self, words: Restored, scores: dict[int, float]):
        self.words, self.scores = words, scores

    def of_word(self, word: str) -> float:
        best, scores = 0.0, self.scores
        for b in word_features(word):
            if b in scores and scores[b] > best:
                best = scores[b]
        return best

    def __missing__(self, token: str) -> float:
        if len(self) >= SCORES:
            self.clear()
        got = self[token] = max(map(self.of_word, self.words.restore(token)), default=0.0)
        return got


def summary(text: str, tokens: TokenScores) -> list[float]:
    """The document's inputs of the regression: its largest word scores and its number of words."""
    low = text.lower()
    distinct = set(tokens_of(low))
    found = [s for s in map(tokens.__getitem__, distinct) if s > 0]
    found += map(tokens.of_word, lonely(low, tokens.words.model))
    top = sorted(found, reverse=True)[: TOP[-1]]
    bent = [max(0.0, top[0] - k) if top else 0.0 for k in KNEES]  # one sure word can do
    return [sum(top[:n]) / n for n in TOP] + bent + [sum(found) / (1 + len(distinct)), math.log1p(len(distinct)) / 10, 1.0]


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 50) -> np.ndarray:
    """Penalised logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(len(w))
        change = np.linalg.solve(hessian, x.T @ (p - y) / len(y) + l2 * w)
        w -= change
        if np.abs(change).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 20_000, labelled: int = 200_000) -> DataFrame:
    """(doc_id, held_out, score, predicted). labels: (doc_id, toxic); held-out rows of it are never learnt from."""
    context = docs.sparkSession.sparkContext
    model = context.broadcast(char_model(docs))
    known = labels.where("doc_id is not null and toxic is not null").where(fold() != 1).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    learn = bounded(known, labelled)
    texts = docs.select("doc_id", "text")
    tag = uuid.uuid4().hex
    n = lexicon_counts(texts.join(F.broadcast(learn), "doc_id").select("text", "toxic", fold().alias("fold")), model, tag)
    first = context.broadcast(lexicon(n["bucket"], n["clean0"], n["toxic0"]))
    both = context.broadcast(lexicon(n["bucket"], n["clean0"] + n["clean2"], n["toxic0"] + n["toxic2"]))

    def of(batch: pa.RecordBatch, tokens: TokenScores) -> np.ndarray:
        return np.array([summary(t.as_py() or "", tokens) for t in batch.column(0)]).reshape(-1, INPUTS)

    def tokens_now(words, name: str) -> TokenScores:
        restored = kept(tag, "model", lambda: Restored(CharModel(*model.value)))
        return kept(tag, name, lambda: TokenScores(restored, dict(zip(*(x.tolist() for x in words.value)))))

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_now(first, "first")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(of(batch, tokens)), pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    weights = np.zeros((2, INPUTS))
    if len(first.value[0]):
        second = learn.where(fold() == 2).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounds what is collected
        got = texts.join(F.broadcast(second), "doc_id").select("text", "toxic").mapInArrow(summaries, "x array<double>, toxic int").toArrow()
        y = (got["toxic"].to_numpy() == 1).astype(float)
        if 0 < y.sum() < len(y):
            x = np.array(got["x"].to_pylist())
            weights[0], weights[1, ONE_WORD] = logistic(x, y), logistic(x[:, ONE_WORD], y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_now(both, "both")
        for batch in batches:
            z = (of(batch, tokens) @ weights.T - np.array([0.0, MARGIN])).max(axis=1)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30))) if weights.any() else np.zeros(len(z))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("text", "doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
