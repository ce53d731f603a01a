"""Licence scans: Aho-Corasick over identifier tags and notice phrases, and licence expressions by a shunting-yard parser.

Whole texts are lower-cased (A-Z) and cut into words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. One automaton holds all phrases
and the words of the identifier tag; it runs over the words joined by single spaces. Where it meets the tag's words, the
line of the original text behind the tag is read as an expression of licence ids, AND, OR, WITH and brackets (WITH binds
closest, then AND, then OR) and gives the ids in it as labels. An expression evaluates to the least restrictive way to
meet it: OR takes the lesser, AND the greater of both sides, WITH the lesser of licence and exception. A broken
expression ends where it breaks, and so does one at a word that is no known licence id (or exception, behind WITH) and no
LicenseRef-; what was read before counts.

score: how sure it is that the text states a licence, 1 - the product of (1 - weight) over the different labels' weights.

Defined results: a null text is empty; texts without any place have empty label strings, null first and last words and
score 0; repeated rows and null ids are scanned like others; an empty table gives an empty table; further columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notice phrases and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "the mit license mit": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "apache license": "apache",
    "licensed under the apache license": "apache",
    "apache license 2 0": "apache-2",
    "www apache org licenses license 2 0": "apache-2",
    "apache software license version 1 1": "apache-1.1",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license v2": "gpl-2",
    "gnu general public license v3": "gpl-3",
    "gnu gpl": "gpl",
    "gplv2": "gpl-2",
    "gplv3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu lesser general public license version 2 1": "lgpl-2.1",
    "gnu lesser general public license version 3": "lgpl-3",
    "gnu library general public license": "lgpl-2",
    "gnu affero general public license": "agpl",
    "gnu affero general public license version 3": "agpl-3",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "mozilla public license version 2": "mpl-2",
    "mozilla public license v 2 0": "mpl-2",
    "eclipse public license": "epl",
    "eclipse public license version 2": "epl-2",
    "eclipse public license v1 0": "epl-1",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "european union public licence": "eupl",
    "redistribution and use in source and binary forms": "bsd",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "2 clause bsd license": "bsd-2-clause",
    "3 clause bsd license": "bsd-3-clause",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "boost software license version 1 0": "bsl-1",
    "the artistic license 2 0": "artistic-2",
    "academic free license": "afl",
    "open software license": "osl",
    "microsoft public license": "ms-pl",
    "python software foundation license": "psf",
    "zlib license": "zlib",
    "sil open font license": "ofl",
    "do what the fuck you want to public license": "wtfpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "creative commons attribution noderivatives": "cc-by-nd",
    "cc by 4": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creativecommons org licenses by": "cc-by",
    "creativecommons org licenses by sa": "cc-by-sa",
    "creativecommons org licenses by nc": "cc-by-nc",
    "creativecommons org publicdomain zero": "cc0",
    "cc0 1 0 universal": "cc0",
    "public domain dedication": "cc0",
    "open database license": "odbl",
    "open data commons attribution license": "odc-by",
}
#: Licence ids (SPDX) that an expression may name, besides LicenseRef-...; versions and suffixes as in `label`.
IDS = """0BSD AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause
BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 bzip2-1.0.6 CAL-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5
CC-BY-3.0 CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1
CDLA-Permissive-1.0 CDLA-Permissive-2.0 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 curl ECL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FTL
GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 HPND ICU IJG IPL-1.0 ISC JSON LGPL-2.0 LGPL-2.1 LGPL-3.0 Libpng libtiff LPL-1.02 LPPL-1.3c MIT MIT-0
MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-2.0 NASA-1.3 NCSA NTP ODbL-1.0 ODC-By-1.0 OFL-1.1 OLDAP-2.8 OpenSSL OSL-3.0
PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 RPL-1.5 Ruby SGI-B-2.0 Sleepycat SPL-1.0 SSPL-1.0 TCL Unicode-3.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim
W3C WTFPL X11 Xnet ZPL-2.1 Zlib""".split()
#: Fixed value: the words of the identifier tag.
TAG = "spdx license identifier"
#: How much a use is restricted, by the start of an id, longest start first; ids not named here have 3.
RESTRICTION = {"cc0": 0, "unlicense": 0, "mit": 1, "bsd": 1, "apache": 1, "isc": 1, "cc-by-nc": 4, "cc-by-nd": 4, "cc-by-sa": 2, "cc-by": 1, "lgpl": 2, "mpl": 2, "gpl": 3, "agpl": 4, "all-rights-reserved": 5}
PHRASE_WEIGHT, TAG_WEIGHT, RESERVED_WEIGHT = 0.9, 0.98, 0.3
PRECEDENCE = {"with": 3, "and": 2, "or": 1}
TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
REFERENCE = re.compile(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
EXCEPTION = re.compile(r"[a-z0-9.-]*exception[a-z0-9.-]*|additionref-[a-z0-9.-]+")
TAG_LINE = re.compile(rb"(?<![a-z0-9\x80-\xff])spdx[^a-z0-9\x80-\xff\n]*license[^a-z0-9\x80-\xff\n]*identifier(?![a-z0-9\x80-\xff])[^\S\n]*:?", re.I)

#: A-Z to a-z, word bytes as they are, all else to a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def restriction(licence: str) -> int:
    starts = [k for k in RESTRICTION if licence.startswith(k)]
    return RESTRICTION[max(starts, key=len)] if starts else 3


def label(identifier: str) -> str:
    """A licence id as a label: lower case, '-only' and '-or-later' off, a trailing '.0' of the version off."""
    x = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower().rstrip(".:-"))
    return re.sub(r"(?<=\d)\.0$", "", x)


KNOWN = {label(x) for x in IDS}


def postfix(expression: str) -> tuple[list[str], list[str]]:
    """The expression in postfix order by shunting-yard, as far as it is well formed, and its licence labels."""
    out: list[str] = []
    labels: list[str] = []
    waiting: list[str] = []
    operand_next = True
    after_with = False
    for token in TOKEN.findall(expression):
        low = token.lower()
        if low == "(":
            if not operand_next:
                break
            waiting.append(low)
        elif low == ")":
            if operand_next or "(" not in waiting:
                break
            while (top := waiting.pop()) != "(":
                out.append(top)
        elif low in PRECEDENCE:
            if operand_next:
                break
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand_next, after_with = True, low == "with"
        else:
            known = EXCEPTION.fullmatch(low) if after_with else label(token) in KNOWN or REFERENCE.fullmatch(low)
            if not operand_next or not known:
                break
            out.append(label(token))
            if not after_with:
                labels.append(label(token))
            operand_next, after_with = False, False
    if operand_next:  # the last operator has no right side
        while waiting and waiting[-1] == "(":
            waiting.pop()
        if waiting:
            waiting.pop()
    return out + [x for x in reversed(waiting) if x != "("], labels


def evaluate(expression: str) -> tuple[list[str], int | None]:
    """Labels of an expression, and the restriction of the least restrictive way to meet it (None if it has none)."""
    order, labels = postfix(expression)
    stack: list[int] = []
    for token in order:
        if token in PRECEDENCE:
            if len(stack) < 2:
                break
            right, left = stack.pop(), stack.pop()
            stack.append(max(left, right) if token == "and" else min(left, right))
        else:
            stack.append(restriction(token))
    return labels, stack[-1] if stack else None


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {**NOTICES, **BASE, TAG: ""}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan(text: str | None, machine) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int | None]]]:
    """Number of words; (phrase, first word) of every place; (label, 0, restriction) of every tag's licences."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    tokens = raw.translate(WORD_BYTES).split()
    line = (b" " + b" ".join(tokens) + b" ").decode("latin-1")
    places, tagged = [], []
    tags = False
    done, word = 0, 0
    for end, phrase in machine.iter(line):
        start = end - len(phrase) - 1  # the space before it
        at = word + line.count(" ", done, start) if start >= done else line.count(" ", 0, start)
        if start >= done:
            done, word = start, at
        if phrase == TAG:
            tags = True
        else:
            places.append((phrase, at))
    if tags:
        for m in TAG_LINE.finditer(raw):
            stop = raw.find(b"\n", m.end())
            labels, least = evaluate(raw[m.end() : stop if stop >= 0 else len(raw)].decode("utf-8", "replace"))
            tagged += [(x, 0, least) for x in labels]
    return len(tokens), places, tagged


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, restriction): one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n, places, tagged = scan(text.as_py(), machine)
                base = [(p, at) for p, at in places if p in BASE]
                phrases = {NOTICES.get(p) or BASE[p] for p, _ in places}
                weights = {x: RESERVED_WEIGHT if x == "all-rights-reserved" else PHRASE_WEIGHT for x in phrases} | {x: TAG_WEIGHT for x, *_ in tagged}
                doubt = 1.0
                for x in sorted(weights):
                    doubt *= 1 - weights[x]
                limits = [r for *_, r in tagged if r is not None] or [restriction(x) for x in phrases]
                at = [x for _, x in base]
                rows.append((n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted({BASE[p] for p, _ in base})), ",".join(sorted(weights)), 1 - doubt, max(limits, default=None)))
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int32()]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "restriction"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, restriction int"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
