"""Licence scan: texts streamed through a suffix automaton of licence texts.

Base labels stand for fixed phrases; every place where a phrase's words stand consecutively counts.
Template labels are the method's own: matching statistics give the maximal matches of at least
``MIN_MATCH`` words, matches of one template are chained in order, and a template whose words are
covered to at least ``MIN_COVERAGE`` by its best chain is reported with its span. ``score`` is the
largest coverage, 1 when a base phrase stands in the text, 0 without any match. Defined results: null
and empty texts have no words, no labels and score 0; repeated rows are judged alike.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.automaton import NEVER, SuffixAutomaton
from sluice.llm.common import alnum_words, utf8

# Phrases and labels of the base scan, opening words of public licence texts.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
MIN_MATCH = 3
MIN_COVERAGE = 0.7
MAX_GAP = 20
SCAN = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first_word:int,last_word:int,coverage:double>>"
)


class Licences:
    """The automaton of phrases and templates, with what its states mean."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str], min_match: int, min_coverage: float, max_gap: int):
        self.min_match, self.min_coverage, self.max_gap = min_match, min_coverage, max_gap
        bases = [(label, alnum_words(text.encode())) for text, label in phrases.items()]
        named = [(label, alnum_words(text.encode())) for label, text in templates.items()]
        self.size = {label: len(words) for label, words in named}
        self.automaton = auto = SuffixAutomaton([words for _, words in bases + named])
        base_at: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for label, words in bases:
            *_, (n, state) = auto.prefixes(words)
            base_at[state].append((n, label))
        self.bases = {s: [x for t in auto.suffixes(s) for x in base_at.get(t, ())] for s in range(1, len(auto.link))}
        # Where the factors of a state end in the templates.
        self.ends: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for label, words in named:
            for n, state in auto.prefixes(words):
                for t in auto.suffixes(state):
                    self.ends[t].append((label, n))
        self.limit = [NEVER] * len(auto.link)
        for s in range(1, len(auto.link)):
            self.limit[s] = min([n for n, _ in self.bases[s]] + [min_match], default=NEVER)

    def chain(self, size: int, matches: list[tuple[int, int, int, int]]) -> tuple[float, int, int]:
        """Best ordered chain of (text first, text end, template first, template end): (coverage, first, end)."""
        best: list[tuple[int, int]] = []
        for i, (first, end, start, stop) in enumerate(matches):
            covered, since = stop - start, first
            for j in range(i - 1, -1, -1):
                if first - matches[j][1] > self.max_gap:
                    break
                gain = best[j][0] + stop - max(start, matches[j][3])
                if matches[j][1] <= end and matches[j][2] < start and matches[j][3] < stop and gain > covered:
                    covered, since = gain, best[j][1]
            best.append((covered, since))
        top = max(range(len(best)), key=lambda i: (best[i][0], -i))
        return best[top][0] / size, best[top][1], matches[top][1]

    def scan(self, words: list[bytes]) -> tuple:
        base: list[tuple[int, str]] = []
        open_at, open_state, open_length = -2, 0, 0
        matches: dict[str, list[tuple[int, int, int, int]]] = defaultdict(list)

        def close() -> None:
            for label, stop in self.ends.get(open_state, ()) if open_length >= self.min_match else ():
                matches[label].append((open_at + 1 - open_length, open_at + 1, stop - open_length, stop))

        for i, state, length in self.automaton.alarms(words, self.limit):
            base += [(i + 1 - n, label) for n, label in self.bases[state] if n <= length]
            if i != open_at + 1 or length != open_length + 1:
                close()  # the match before can't be extended to the right
            open_at, open_state, open_length = i, state, length
        close()
        spans = []
        score = 1.0 if base else 0.0
        for label, found in sorted(matches.items()):
            coverage, first, end = self.chain(self.size[label], found)
            score = max(score, coverage)
            if coverage >= self.min_coverage:
                spans.append({"label": label, "first_word": first, "last_word": end - 1, "coverage": coverage})
        base_labels = sorted({label for _, label in base})
        labels = sorted({*base_labels, *(s["label"] for s in spans)})
        starts = [start for start, _ in base]
        return (
            len(words), len(base), min(starts, default=None), max(starts, default=None),
            ",".join(base_labels), ",".join(labels), score, spans,
        )


def scan(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES,
    min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, max_gap: int = MAX_GAP,
) -> DataFrame:
    """Per document: counts, places, labels and score as said above, and the template spans found."""
    shared = docs.sparkSession.sparkContext.broadcast(Licences(phrases, templates, min_match, min_coverage, max_gap))

    @F.pandas_udf(SCAN)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        licences = shared.value
        names = [part.split(" ")[0] for part in SCAN.split(", ")]
        for texts in batches:
            rows = pd.DataFrame([licences.scan(alnum_words(text)) for text in texts], columns=names)
            yield rows.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select("doc_id", scanned(utf8()).alias("found")).select("doc_id", "found.*")
