"""Best-fit packing into fixed-length sequences, improved by swap-based local search.

Whole texts are tokenised and end with id 0. A document longer than a sequence is cut from its end, so that its first
piece may be shorter and the others fill a sequence each. Full pieces are sequences of their own and take no part in what
follows. Short pieces are dealt at random to groups of about `group_items`. In a group, pieces go largest first into the
fullest sequence that still has room; then local search repeats, from the emptiest underfull sequence on: move a piece to
another one, exchange it for a smaller piece, or two pieces for one, wherever that raises the sum of squared fills most,
until sequences fall empty or nothing improves. Pieces of equal length are alike, so all exchanges are tried by trying
the different lengths. Groups bound the memory and the time of a task; each wastes less than one sequence.

The vocabulary is read with a rank-file tokenizer that gives the ids of the JSON tokenizer (tested) in a fifth of its time.
Its pattern matcher gives up on a run of some 10^6 white-space characters; such a run is encoded by itself, without one.

Defined results: a null text is empty and gives one piece of length 1; null ids and repeated rows are packed like others;
an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.plans.scale import Written

LENGTH = 2048
END_ID = 0
#: Ids that a task holds before it hands them on.
FLUSH = 1 << 20
#: How a byte-level vocabulary writes bytes that aren't printable, from the public byte-to-character rule.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Unicode white space, at least as often in a row as worth a piece of its own.
LONG_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")

_encoders: dict[str, object] = {}


def byte_of() -> dict[str, int]:
    """Byte by its character in a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    rest = [b for b in range(256) if b not in PRINTABLE]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """A tokenizer from a byte-level BPE JSON file, kept per process."""
    if path not in _encoders:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        of = byte_of()
        ranks = {bytes(of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        import public_tokenizers

        _encoders[path] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def encode(text: str, tokenizer: str) -> np.ndarray:
    """The ids of a text. A run of white space is one piece up to its last character, which belongs to what follows."""
    e = encoder(tokenizer)
    try:
        return e.encode_to_numpy(text, allowed_special="all")
    except ValueError:  # too long a run for the pattern matcher
        parts, at = [], 0
        for m in LONG_RUN.finditer(text):
            end = m.end() - (m.end() < len(text))
            parts += [e.encode_to_numpy(text[at : m.start()], allowed_special="all"), np.array(e._encode_single_piece(text[m.start() : end]), np.uint32)]
            at = end
        if not parts:
            raise
        return np.concatenate([*parts, e.encode_to_numpy(text[at:], allowed_special="all")])


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all but the first are full."""
    first = n % length or length
    return [(0, min(first, n))] + [(s, length) for s in range(first, n, length)]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt, number [, ids]): one row per piece. salt is random; number differs by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rng, count = np.random.default_rng(part), part << 33

        def out(ids: pa.Array, rows: dict[str, list]) -> pa.RecordBatch:
            nonlocal count
            n = len(rows["of"])
            salt, number = rng.integers(0, 1 << 62, n), count + np.arange(n)
            count += n
            cols = [ids.take(pa.array(rows["of"], pa.int64())), pa.array(rows["piece"], pa.int32()), *(pa.array(rows[c], pa.int64()) for c in ("start", "length", "ids_crc32")), pa.array(salt), pa.array(number)]
            if with_ids:
                flat = np.concatenate([*rows["ids"], np.zeros(0, np.int32)])
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rows["length"])]), pa.int32()), pa.array(flat, pa.int32())))
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "salt", "number", "ids"][: len(cols)])

        for batch in batches:
            rows: dict[str, list] = defaultdict(list)
            held = 0
            for k, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or "", tokenizer), END_ID).astype("<u4")
                for p, (start, n) in enumerate(cut(len(ids), length)):
                    own = ids[start : start + n]
                    for name, value in (("of", k), ("piece", p), ("start", start), ("length", n), ("ids_crc32", zlib.crc32(own.tobytes()))):
                        rows[name].append(value)
                    if with_ids:
                        rows["ids"].append(own.astype(np.int32))
                held += len(ids)
                if held > FLUSH:
                    yield out(batch.column(0), rows)
                    rows, held = defaultdict(list), 0
            if held:
                yield out(batch.column(0), rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, salt long, number long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Sequences as lists of piece numbers: each piece, largest first, goes where it leaves the least room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms: list[int] = []  # the rooms that occur, in order
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        at = bisect_left(rooms, s)
        if at == len(rooms):
            bins.append([i])
            b, room = len(bins) - 1, length - s
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            bins[b].append(i)
            room -= s
        if room:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append(b)
    return bins


def local_search(sizes: np.ndarray, bins: list[list[int]], length: int, block: int = 1 << 20) -> list[list[int]]:
    """Moves and exchanges between underfull sequences that raise the sum of squared fills, until there is none; empty ones go.

    block: pairs of one or two own pieces and another sequence's piece that are looked at at once.
    """
    fill = np.array([int(sizes[b].sum()) for b in bins], np.int64)
    improved = True
    while improved:
        improved = False
        for b in sorted(np.flatnonzero((fill > 0) & (fill < length)).tolist(), key=lambda k: (fill[k], k)):
            while 0 < fill[b] < length:
                # the other underfull sequences at least as full, and their pieces
                others = np.flatnonzero((fill >= fill[b]) & (fill < length) & (np.arange(len(fill)) != b))
                if not len(others):
                    break
                room = length - fill[others]
                held = [bins[o] for o in others.tolist()]
                at = np.repeat(np.arange(len(others)), [len(h) for h in held])
                piece = np.concatenate([np.array(h) for h in held])
                size, own_room, ahead = sizes[piece], room[at], (fill[others] - fill[b])[at]
                alike: dict[int, list[int]] = defaultdict(list)  # own pieces by length, longest first
                for i in sorted(bins[b], key=lambda i: (-sizes[i], i)):
                    alike[int(sizes[i])].append(i)
                raised, change = 0, None
                for s, (x, *_) in alike.items():  # move: the fullest that has room
                    ok = np.flatnonzero(room >= s)
                    if len(ok):
                        o = int(ok[np.argmin(room[ok])])
                        if (gain := s * int(fill[others[o]] - fill[b] + s)) > raised:
                            raised, change = gain, ([x], o, None)
                lengths = list(alike)
                out = [[alike[s][0]] for s in lengths] + [[alike[s][0], alike[t][int(s == t)]] for n, s in enumerate(lengths) for t in lengths[n:] if s != t or len(alike[s]) > 1]
                total = np.array([sizes[x].sum() for x in out])
                for first in range(0, len(out), max(1, block // len(size))):  # one for one, two for one
                    d = total[first : first + max(1, block // len(size)), None] - size[None, :]
                    value = np.where((d > 0) & (d <= own_room), d * (ahead + d), 0)
                    k = int(np.argmax(value))
                    if value.flat[k] > raised:
                        x, y = divmod(k, len(size))
                        raised, change = int(value.flat[k]), (out[first + x], int(at[y]), int(piece[y]))
                if change is None:
                    break
                gone, o, back = change
                to = int(others[o])
                bins[b] = [i for i in bins[b] if i not in gone] + ([back] if back is not None else [])
                bins[to] = [i for i in bins[to] if i != back] + gone
                fill[b], fill[to] = sizes[bins[b]].sum() if bins[b] else 0, sizes[bins[to]].sum()
                improved = True
    return [b for b in bins if b]


def pack_sizes(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece."""
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    whole = np.flatnonzero(sizes >= length)
    sequence[whole] = np.arange(len(whole))
    short = np.flatnonzero(sizes < length)
    bins = local_search(sizes[short], best_fit(sizes[short], length), length)
    for k, b in enumerate(bins):
        own = short[np.sort(b)]
        sequence[own] = len(whole) + k
        offset[own] = np.cumsum(sizes[own]) - sizes[own]
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, group_items: int = 4096, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 [, ids], sequence_id, offset): one row per piece. Full pieces have negative sequence ids."""
    cutted = Written(pieces(docs, tokenizer, length, with_ids), "pieces").df
    short = cutted.where(F.col("length") < length)
    groups = max(1, -(-short.count() // group_items))
    own = [c for c in cutted.columns if c not in ("salt", "number")]

    def place(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("salt", "ascending"), ("number", "ascending")])
        sequence, offset = pack_sizes(t["length"].to_numpy(), length)
        return t.select(own).append_column("sequence_id", pa.array(sequence + (key[0].as_py() << 32))).append_column("offset", pa.array(offset))

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cutted.select(*own).schema)
    placed = short.withColumn("grp", F.pmod("salt", F.lit(groups))).groupBy("grp").applyInArrow(place, f"{names}, sequence_id long, offset long")
    whole = cutted.where(F.col("length") >= length).select(*own, (F.lit(-1) - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(whole)
