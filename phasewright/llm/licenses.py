"""Licence scans by a positional index of rare words."""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import map_texts, table, utf8

_DELIMITERS = bytes(b if chr(b).isdigit() and b < 128 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: The same with A-Z lower-cased.
LETTERS = bytes(_DELIMITERS[b + 32 if 65 <= b <= 90 else b] for b in range(256))


def licence_words(text: str | None) -> list[bytes]:
    """Words of a whole text as UTF-8: A-Z lower-cased, cut at every other ASCII character."""
    return utf8(text).lower().translate(_DELIMITERS).split()


@dataclass(frozen=True)
class Template:
    """A notice: its words, the label it gives, and phrases that must stand in their places."""

    label: str
    text: str
    keys: tuple[str, ...]


# The phrases whose places are all reported, with their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Opening words of public licences and common notices.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("in compliance with the license", "licenses license 2 0")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "provided that the following conditions are met")),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", ("general public license version 2",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("you can redistribute it and or modify it", "gnu general public license")),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("subject to the terms of the mozilla public license",)),
    Template("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", ("eclipse public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4 0",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0",)),
    Template("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights", ("waived all copyright and related or neighboring rights",)),
    Template("all-rights-reserved", "All rights reserved", ("all rights reserved",)),
)


class Index:
    """Postings of each notice's rarest words: word to (notice, place in it)."""

    def __init__(self, idf: dict[bytes, float], templates: tuple[Template, ...] = TEMPLATES, anchors: int = 4) -> None:
        self.idf, self.templates = idf, templates
        self.words = [licence_words(t.text) for t in templates]
        self.keys = []
        for t, words in zip(templates, self.words, strict=True):
            places = []
            for key in t.keys:
                k = licence_words(key)
                places.append((next(i for i in range(len(words)) if words[i : i + len(k)] == k), k))
            self.keys.append(places)
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for i, words in enumerate(self.words):
            rare = sorted(set(words), key=lambda w: (-idf[w], w))[:anchors]
            for at, w in enumerate(words):
                if w in rare:
                    self.postings[w].append((i, at))
            self.needed.append(min(2, len(rare)))
        self.phrases = []
        for phrase, label in BASE_PHRASES:
            words = licence_words(phrase)
            rarest = min(range(len(words)), key=lambda j: (-idf[words[j]], j))
            self.phrases.append((words, label, rarest))
        self.looked_up = {*self.postings, *(w[r] for w, _, r in self.phrases)}
        self.weight = [sum(idf[w] for w in words) for words in self.words]

    def scan(self, text: str | None, slack: int = 2) -> tuple:
        """(words, base places, first, last, base labels, labels, score) of one whole text."""
        words = licence_words(text)
        seen = [(i, w) for i, w in enumerate(words) if w in self.looked_up]
        if not seen:
            return len(words), 0, None, None, "", "", 0.0
        base, labels = [], set()
        at_word = defaultdict(list)
        for i, w in seen:
            at_word[w].append(i)
        for phrase, label, rarest in self.phrases:
            for i in at_word.get(phrase[rarest], ()):
                start = i - rarest
                if start >= 0 and words[start : start + len(phrase)] == phrase:
                    base.append(start)
                    labels.add(label)
        base_labels, best = set(labels), 1.0 if base else 0.0
        votes: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for w in sorted(at_word, key=lambda w: (-self.idf[w], w)):  # rarest words first
            for t, place in self.postings.get(w, ()):
                for i in at_word[w]:
                    votes[t, i - place].add(w)
        for (t, start), anchors in votes.items():
            if len(anchors) >= self.needed[t] and self.verified(words, t, start, slack):
                labels.add(self.templates[t].label)
                best = max(best, self.share(words, t, start, slack))
        starts = sorted(base)
        return len(words), len(base), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted(base_labels)), ",".join(sorted(labels)), min(1.0, best)

    def verified(self, words: list[bytes], t: int, start: int, slack: int) -> bool:
        """Every key phrase stands at its place, give or take ``slack`` words."""
        return all(any(words[max(0, start + at + d) : max(0, start + at + d) + len(k)] == k for d in range(-slack, slack + 1)) for at, k in self.keys[t])

    def share(self, words: list[bytes], t: int, start: int, slack: int) -> float:
        """Share of the notice's weight whose words stand near their places."""
        found = sum(self.idf[w] for at, w in enumerate(self.words[t]) if w in words[max(0, start + at - slack) : max(0, start + at + slack + 1)])
        return found / self.weight[t] if self.weight[t] else 1.0


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> list[bytes]:
    """All words of notices and phrases; fixed with them, some 150."""
    return sorted({w for t in [*(t.text for t in templates), *(p for p, _ in BASE_PHRASES)] for w in licence_words(t)})


def inverse_frequencies(docs: DataFrame, *, text_col: str = "text") -> dict[bytes, float]:
    """IDF of every licence word, counted over all documents.

    Each task sums over its own rows; what is shuffled and collected is bounded
    by the notices' vocabulary.
    """
    known = set(vocabulary())

    def work(x: dict[str, list]) -> dict[str, object]:
        counts: dict[bytes, int] = defaultdict(int)
        for text in x[text_col]:
            for w in known.intersection(licence_words(text)):
                counts[w] += 1
        return {"word": [b"", *counts], "n": [len(x[text_col]), *counts.values()]}

    found = {bytes(r["word"]): r["n"] for r in map_texts(docs, [text_col], "word binary, n long", work).groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = found.get(b"", 0)
    return {w: math.log((1 + total) / (1 + found.get(w, 0))) + 1e-6 for w in vocabulary()}


def licence_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence phrases and notices in every whole text.

    Each notice is indexed by its few words of highest IDF. A file's own rare
    licence words are looked up, their postings are intersected by relative
    position, and a notice counts only if its key phrases stand in their places.
    A phrase is found at every place, through its rarest word.

    A null or empty text has no words and no labels, score 0; a null id stays
    null; repeated rows give repeated rows; an empty table gives none; other
    columns are not read.
    """
    index = Index(inverse_frequencies(docs, text_col=text_col))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

    def work(x: dict[str, list]) -> dict[str, object]:
        rows = [index.scan(t) for t in x[text_col]]
        return {"doc_id": x[id_col]} | {k: [r[i] for r in rows] for i, k in enumerate(names)}

    return map_texts(docs, [id_col, text_col], "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", work)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every whole text of ``documents``."""
    return licence_scan(table(spark, sf_dir, "documents"))


