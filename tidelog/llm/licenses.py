"""Operator 7: license scans by a trained paragraph classifier.

A paragraph is a run of lines that aren't blank, comment marks not counted, so a
wrapped notice is whole.  In it, wherever the words of a template stand close together, these
words are classified.  A multinomial logistic regression over hashed word 1- to
3-grams, sparse, is trained from the templates below: whole, cut, and with
words changed, against ordinary prose for the unknown class.  A temperature
calibrates it on held-out variants.  A prediction stands only if the words
of its family's template confirm it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, id_text, rows_of

#: The wording by which each family is commonly named or quoted.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "gpl-3.0": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or any later version",
    ],
    "bsd-3-clause": [
        "licensed under the bsd 3 clause license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "mpl-2.0": [
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "licensed under the mozilla public license version 2.0",
    ],
    "cc-by-nc-4.0": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc-by-4.0": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc0-1.0": ["released under cc0 1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "gpl-2.0": [
        "this work is licensed under the gnu general public license version 2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or any later version",
    ],
    "lgpl-2.1": [
        "licensed under the gnu lesser general public license version 2.1",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or any later version",
    ],
    "lgpl-3.0": [
        "licensed under the gnu lesser general public license version 3",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or any later version",
    ],
    "agpl-3.0": [
        "licensed under the gnu affero general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or any later version",
    ],
    "apache-1.1": ["licensed under the apache license version 1.1", "licensed under the apache software license version 1.1"],
    "bsd-2-clause": ["licensed under the bsd 2 clause license"],
    "cc-by-sa-4.0": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc-by-nc-sa-4.0": ["licensed under cc by nc sa 4.0", "this work is licensed under a creative commons attribution noncommercial sharealike 4.0 international license"],
    "cc-by-nd-4.0": ["licensed under cc by nd 4.0", "this work is licensed under a creative commons attribution noderivatives 4.0 international license"],
    "isc": ["licensed under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "bsl-1.0": ["distributed under the boost software license version 1.0"],
    "epl-2.0": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0"],
    "ofl-1.1": ["this font software is licensed under the sil open font license version 1.1"],
    "all-rights-reserved": ["all rights reserved", "copyright all rights reserved"],
}
#: Prose that speaks of the same things without granting a license.
OTHER = [
    "he lost his driving license in the spring and had to renew it at the office",
    "the version of the story that we heard under the bridge was not the same",
    "the public library holds a general collection of free works for all people",
    "she reserved all the rooms of the hotel by the sea for the whole group",
    "permission to enter the house was granted by the owner without any conditions",
    "the software was released to the public in the summer of that year",
    "a new creative project brought the commons and the city together at last",
    "the apache people lived in the mountains and the plains of the south",
    "students at mit wrote the first version of the program in two weeks",
    "the foundation of the work is free thought and the rights of man",
]
#: Words of other licenses whose wording is otherwise close to a family's.
OTHERS_WORDS = {
    "gpl-2.0": {b"lesser", b"affero", b"library"},
    "gpl-3.0": {b"lesser", b"affero", b"library"},
    "cc-by-4.0": {b"noncommercial", b"nc", b"sharealike", b"sa", b"noderivatives", b"noderivs", b"nd"},
    "cc-by-nc-4.0": {b"sharealike", b"sa", b"noderivatives", b"noderivs", b"nd"},
    "cc-by-sa-4.0": {b"noncommercial", b"nc", b"noderivatives", b"noderivs", b"nd"},
    "cc-by-nd-4.0": {b"noncommercial", b"nc", b"sharealike", b"sa"},
}
#: Names; a notice holds all those that its template has.
NAMES = {
    b"affero", b"apache", b"boost", b"bsd", b"cc", b"cc0", b"creative", b"eclipse", b"gnu", b"isc", b"lesser", b"mit", b"mozilla",
    b"nc", b"nd", b"noncommercial", b"noderivatives", b"sa", b"sharealike", b"sil",
}
BITS = 14
_WORDS = re.compile(rb"[a-z0-9]+(?:\.[0-9]+)*")
#: Comment marks that are letters, and lines that hold nothing but other marks.
_MARK = re.compile(rb"\s*(?:@?rem|dnl|c)\s", re.I)
_BLANK = re.compile(rb"[\s/*#;%!\"'<>|.=+~_-]*").fullmatch


def words_of(line: bytes) -> list[bytes]:
    return _WORDS.findall(line.lower())


def paragraphs(text: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first line, lines) of each run of lines that aren't blank, without letters that mark comments."""
    run: list[bytes] = []
    i = 0
    for i, line in enumerate(text.split(b"\n"), 1):
        if mark := _MARK.match(line):
            line = line[mark.end() :]
        if not _BLANK(line):
            run.append(line)
        elif run:
            yield i - len(run), run
            run = []
    if run:
        yield i + 1 - len(run), run


def _number(word: bytes) -> bytes:
    """A word with digits as a bare number: v3 and 3.0 are 3."""
    return word.removeprefix(b"v").removesuffix(b".0") if any(48 <= c < 58 for c in word) else word


def versions(words: list[bytes]) -> set[bytes]:
    """The words with digits, as bare numbers."""
    return {_number(w) for w in words if any(48 <= c < 58 for c in w)}


def grams(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest as h

    words = [_number(w) for w in words]
    out = {h(b" ".join(words[i : i + n])) & ((1 << BITS) - 1) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    return np.fromiter(out, np.int64, len(out))


class LicenseModel:
    """Weights, a temperature, and the templates' words."""

    def __init__(self, seed: int = 7, epochs: int = 30):
        self.names = [*TEMPLATES, "unknown"]
        rng = np.random.default_rng(seed)
        vocabulary = sorted({w for t in OTHER for w in t.encode().split()})
        rows: list[tuple[list[bytes], int]] = []
        for k, name in enumerate(TEMPLATES):
            for t in TEMPLATES[name]:
                w = words_of(t.encode())
                for v in range(24):
                    x = list(w)
                    if v % 4 == 3:  # a version by its number alone
                        x = [c for c in x if c != b"version"]
                    if v > 4:  # a word or two changed, others around it
                        for _ in range(int(rng.integers(0, 1 + len(x) // 8)) if len(x) > 6 else 0):
                            x[int(rng.integers(len(x)))] = vocabulary[int(rng.integers(len(vocabulary)))]
                        x = [vocabulary[i] for i in rng.integers(0, len(vocabulary), int(rng.integers(0, 4)))] + x
                        x += [vocabulary[i] for i in rng.integers(0, len(vocabulary), int(rng.integers(0, 4)))]
                    rows.append((x, k))
        everything = sorted({w for t in TEMPLATES.values() for s in t for w in words_of(s.encode())} | set(vocabulary))
        for v in range(900):
            if v < 3 * len(OTHER):
                x = words_of(OTHER[v % len(OTHER)].encode())
            else:  # words of licenses and prose in no order, and sequences of unseen words
                x = [everything[i] for i in rng.integers(0, len(everything), int(rng.integers(1, 30)))]
                if v % 2:
                    x = [b"%x" % i for i in rng.integers(0, 1 << 40, len(x))]
            rows.append((x, len(self.names) - 1))
        order = rng.permutation(len(rows))
        split = len(rows) * 4 // 5
        feats = [grams(rows[i][0]) for i in order]
        label = [rows[i][1] for i in order]
        self.weights = np.zeros((1 << BITS, len(self.names)))
        self.bias = np.zeros(len(self.names))
        self.temperature = 1.0
        for e in range(epochs):
            for f, y in zip(feats[:split], label[:split]):
                g = self.chances(f)
                g[y] -= 1
                self.weights[f] -= 0.5 / np.sqrt(max(1, len(f))) * g / (1 + e / 10)
                self.bias -= 0.02 * g
        held = [(self.logits(f), y) for f, y in zip(feats[split:], label[split:])]
        best = []
        for t in np.geomspace(0.25, 4, 17):
            z = [(x / t, y) for x, y in held]
            best.append((sum(float(np.log(np.exp(x - x.max()).sum()) + x.max() - x[y]) for x, y in z), float(t)))
        self.temperature = min(best)[1]
        self.accuracy = float(np.mean([int(x.argmax() == y) for x, y in held]))
        self.forms = {n: [set(zip(w, w[1:])) for w in (words_of(t.encode()) for t in ts)] for n, ts in TEMPLATES.items()}
        self.head = {w for ts in TEMPLATES.values() for t in ts for w in words_of(t.encode())}
        # (family, distinct word pairs, words, versions, names) of each template, and the templates that hold a pair
        self.templates: list[tuple[str, int, int, set[bytes], set[bytes]]] = []
        self.having: dict[tuple[bytes, bytes], list[int]] = {}
        for n, ts in TEMPLATES.items():
            for t, form in zip(ts, self.forms[n]):
                for pair in form:
                    self.having.setdefault(pair, []).append(len(self.templates))
                w = words_of(t.encode())
                self.templates.append((n, len(form), len(w), versions(w), NAMES.intersection(w)))

    def logits(self, feats: np.ndarray) -> np.ndarray:
        return self.weights[feats].sum(0) / np.sqrt(max(1, len(feats))) + self.bias

    def chances(self, feats: np.ndarray) -> np.ndarray:
        z = self.logits(feats) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def judge(self, line: bytes, chance: float, overlap: float) -> tuple[str, float, float] | None:
        """(family, chance, share of a template's word pairs found) of a line's clearest notice, if it holds one."""
        found = self.find([line], chance, overlap)
        return max((f[2:] for f in found), key=lambda f: (f[2], f[1])) if found else None

    def find(self, lines: list[bytes], chance: float, overlap: float) -> list[tuple[int, int, str, float, float]]:
        """(first line, last line, family, chance, overlap) of each notice in a paragraph, lines from 0.

        Each family is looked for on its own, so a line may hold several.  Findings of one family
        on a common line are one.  A notice must hold its template's version, at most three words away, the names
        that its template has, and no word that makes it another license's.
        """
        words, ends = [], []
        for line in lines:
            words += words_of(line)
            ends.append(len(words))
        if len(self.head.intersection(words)) < 3:  # less than any template's words
            return []
        hits: dict[int, list[tuple[int, tuple[bytes, bytes]]]] = {}
        for i, pair in enumerate(zip(words, words[1:])):
            for k in self.having.get(pair, ()):
                hits.setdefault(k, []).append((i, pair))
        found = []
        for k, places in hits.items():
            family, pairs, length, version, names = self.templates[k]
            for lo, hi, n in _close(places, math.ceil(overlap * pairs - 1e-9), 2 * length + 8):
                spans = (words[max(0, lo - more) : hi + 1 + more] for more in range(4))
                own = next((s for s in spans if version <= versions(s)), None)
                if own is None or not OTHERS_WORDS.get(family, set()).isdisjoint(own):
                    continue
                if not names.issubset(own):
                    continue
                p = self._confirmed(words, lo, hi, family)
                if p >= chance:
                    found.append((bisect_right(ends, lo), bisect_right(ends, hi), family, p, n / pairs))
        out: list[tuple[int, int, str, float, float]] = []
        for f in sorted(found, key=lambda f: (f[2], f[0], f[1])):
            if out and out[-1][2] == f[2] and f[0] <= out[-1][1]:
                was = out.pop()
                best = max(was, f, key=lambda x: (x[4], x[3]))
                f = (was[0], max(was[1], f[1]), *best[2:])
            out.append(f)
        return sorted(out)

    def _confirmed(self, words: list[bytes], lo: int, hi: int, family: str) -> float:
        """The chance of the family where it is the likeliest, for words lo to hi with up to three around them, as in training, or without."""
        k, best = self.names.index(family), 0.0
        for around in (3, 0):
            p = self.chances(grams(words[max(0, lo - around) : hi + 1 + around]))
            if int(p.argmax()) == k:
                best = max(best, float(p[k]))
        return best


def _close(places: list[tuple[int, tuple[bytes, bytes]]], need: int, room: int) -> Iterator[tuple[int, int, int]]:
    """(first word, last word, distinct pairs) of stretches of at most `room` words with `need` distinct pairs, none overlapping."""
    left = right = 0
    held: dict[tuple[bytes, bytes], int] = {}
    while right < len(places):
        at, pair = places[right]
        held[pair] = held.get(pair, 0) + 1
        while at + 1 - places[left][0] >= room:
            gone = places[left][1]
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
            left += 1
        if len(held) >= need:  # take what adds pairs in the room that is left, then cut repeats off the front
            last = right
            for j in range(right + 1, len(places)):
                if places[j][0] + 1 - places[left][0] >= room:
                    break
                if places[j][1] not in held or places[j][0] == places[last][0] + 1:
                    for x in range(last + 1, j + 1):
                        held[places[x][1]] = held.get(places[x][1], 0) + 1
                    last = j
            while held[places[left][1]] > 1:
                held[places[left][1]] -= 1
                left += 1
            yield places[left][0], places[last][0] + 1, len(held)
            left, right, held = last + 1, last, {}
        right += 1


@lru_cache(maxsize=1)
def model() -> LicenseModel:
    return LicenseModel()


def scan(docs: DataFrame, chance: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """(doc_id, line_no, last_line, fresh, family, chance, overlap): a row for each notice that grants or names a license.

    Every paragraph of every whole text is judged where it lies; nothing is
    shuffled.  A notice lies on lines line_no to last_line, counted from 1; `fresh` is how many of them are in no
    earlier row of its text.  Null and empty texts have no notices; a null
    doc_id is carried; repeated rows repeat theirs.  Only doc_id and text are read.
    The model is fixed by the templates and a seed, so each task trains the same one in a second or two.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("line_no", pa.int32()), ("last_line", pa.int32()), ("fresh", pa.int32()), ("family", pa.string()), ("chance", pa.float64()), ("overlap", pa.float64())]
    )

    def run(batches):
        m = model()
        for ids, texts in rows_of(batches, "doc_id", "text"):
            out = []
            for d, t in zip(ids, texts):
                done = 0  # rows come by line_no, so lines up to here are counted
                for first, lines in paragraphs(t):
                    for lo, hi, *rest in m.find(lines, chance, overlap):
                        lo, hi = first + lo, first + hi
                        out.append((d, lo, hi, max(0, hi - max(done, lo - 1)), *rest))
                        done = max(done, hi)
            if out:
                yield batch(schema, *map(list, zip(*out)))

    return id_text(docs).mapInArrow(run, "doc_id long, line_no int, last_line int, fresh int, family string, chance double, overlap double")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its license families, ordered, and how many of its lines notices lie on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs).groupBy("doc_id").agg(F.sort_array(F.collect_set("family")).alias("f"), F.sum("fresh").alias("n"))
    found = found.select(F.col("doc_id").alias("found_id"), "f", "n")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(found, F.col("doc_id") == F.col("found_id"), "left").select(
        "doc_id", F.coalesce(F.array_join("f", ","), F.lit("")).alias("families"), F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines")
    )
