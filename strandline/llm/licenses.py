"""Licence scans: templates found in normalised text by the Dice coefficient over word bigrams.

Text is put in lower case and cut to its words. A passage matches a template if the Dice coefficient
of their sets of word bigrams is at least ``LEAST``. That bounds the passage's number of bigrams on both
sides and asks for a share of the template's bigrams somewhere in the text, which rules most templates
out before any passage is looked at. Passages start and end at a bigram of the template and have at most
the greater bound of bigrams, repeats counted. Every such passage of the whole text is looked at; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import whole_text
from strandline.llm.license_texts import TEMPLATES

LEAST = 0.9

_TERM = re.compile(r"[^\W_]+")


def normalise(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, least: float = LEAST) -> None:
        self.least, self.sets, self.lengths = least, {}, {}
        words = {name: normalise(text) for name, text in (TEMPLATES if templates is None else templates).items()}
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for ws in words.values() for w in ws}))}
        self.n = len(self.vocabulary) + 1
        for name, ws in words.items():
            ids = [self.vocabulary[w] for w in ws]
            self.sets[name] = {a * self.n + b for a, b in zip(ids, ids[1:])}
            self.lengths[name] = len(ids) - 1
        self.known = np.zeros(self.n * self.n, bool)
        self.known[sorted(set().union(*self.sets.values()))] = True

    def bounds(self, size: int) -> tuple[float, float]:
        """Numbers of bigrams a passage may have to reach ``least`` with a template of ``size``."""
        return self.least / (2 - self.least) * size, (2 - self.least) / self.least * size

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """Templates found: name, Dice coefficient, first word and number of words of the best passage."""
        words = normalise(text)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(self.n - 1)), np.int64, len(words))
        if len(ids) < 2:
            return []
        codes = ids[:-1] * self.n + ids[1:]
        at = np.flatnonzero(self.known[codes])
        if not len(at):
            return []
        present, found = set(codes[at].tolist()), []
        for name, wanted in self.sets.items():
            size = len(wanted)
            if len(present & wanted) < self.bounds(size)[0]:
                continue
            best = (0.0, 0, 0)
            hits = [int(p) for p in at if int(codes[p]) in wanted]
            span = int(self.bounds(self.lengths[name])[1])
            ends = np.searchsorted(hits, np.array(hits) + span).tolist()
            for k, first in enumerate(hits):
                if ends[k] - k < self.bounds(size)[0]:
                    continue
                own, common, at_hit = set(), set(), set(hits[k : ends[k]])
                for p in range(first, hits[ends[k] - 1] + 1):
                    own.add((words[p], words[p + 1]))
                    if p in at_hit:
                        common.add(int(codes[p]))
                        best = max(best, (2 * len(common) / (len(own) + size), -first, p - first + 2))
            if best[0] >= self.least:
                found.append((name, best[0], -best[1], best[2]))
        return sorted(found, key=lambda f: (-f[1], -f[3], f[0]))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """One row per row of ``docs``: ``key``, license, dice, first_word, n_words of the best passage, licenses (all found).

    Where nothing is found, and for null and empty texts, license is null, dice 0 and licenses empty. Ties
    go to the longer passage, then to the lesser name. Other columns aren't used.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, least)
        for frame in frames:
            out = []
            for k, t in zip(frame["k"], frame["t"], strict=True):
                found = scanner.scan(t)
                name, dice, first, n = found[0] if found else (None, 0.0, None, None)
                out.append((k, name, dice, first, n, [f[0] for f in found]))
            made = pd.DataFrame(out, columns=["k", "license", "dice", "first_word", "n_words", "licenses"])
            yield made.astype({"first_word": "Int64", "n_words": "Int64"})

    rows = docs.select(F.col(key).cast("string").alias("k"), whole_text(text).alias("t"))
    made = rows.mapInPandas(run, "k string, license string, dice double, first_word long, n_words long, licenses array<string>")
    return made.withColumn("k", F.col("k").cast("long")).withColumnRenamed("k", key)
