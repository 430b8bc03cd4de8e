"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

The blocks for a template of n words are windows of 2 n words that start at each
multiple of n, over the words of the whole text whatever lines they stand on: a
notice of n words lies whole in one of them, however it is wrapped.  A block B
matches a template T if ``|B & T| / |T|`` reaches the threshold.  Tokens are
ordered by the number of texts of the whole corpus that contain them, rarest
first; a match must contain one of the first ``|T| - ceil(t |T|) + 1`` tokens of
the template (prefix), have ``ceil(t |T|)`` template words (length), and leave
enough tokens after the first common one on both sides (position).  What passes
is verified.  Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .storage import tidy

#: Phrases that name a license wherever their words stand one after another.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices and texts of common licenses, as (label, words).
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or "
        "other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
        "other dealings in the software",
    ),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under "
        "the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the "
        "specific language governing permissions and limitations under the license",
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
        "software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be "
        "useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general "
        "public license for more details",
    ),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
    ),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this "
        "software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
]

MATCHES = "array<struct<kind:string, label:string, start:long, words:long, containment:double>>"


class Templates:
    """Token sets of templates, ordered by a table of frequencies."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.labels = [label for label, _ in templates]
        self.lengths = [len(words.split()) for _, words in templates]
        self.sets = [sorted({tx.word_hash(w) for w in words.split()}) for _, words in templates]
        self.needed = [max(1, int(np.ceil(threshold * len(s) - 1e-9))) for s in self.sets]
        self.tokens = np.array(sorted({h for s in self.sets for h in s}), dtype=np.uint64)

    def order(self, frequency: np.ndarray) -> None:
        """Rank tokens from their counts (aligned with ``tokens``), and build the prefix index."""
        at = np.lexsort((self.tokens, frequency))
        self.rank = np.empty(len(at), dtype=np.int64)
        self.rank[at] = np.arange(len(at))
        place = {int(h): int(r) for h, r in zip(self.tokens, self.rank, strict=True)}
        self.ranked = [np.array(sorted(place[h] for h in s)) for s in self.sets]
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, ranks in enumerate(self.ranked):
            for j, r in enumerate(ranks[: len(ranks) - self.needed[t] + 1].tolist()):
                self.index[r].append((t, j))
        self.in_prefix = np.zeros(len(at), dtype=bool)
        self.in_prefix[list(self.index)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index into ``tokens`` of each word, or -1."""
        if not len(self.tokens):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.tokens, hashes), len(self.tokens) - 1)
        return np.where(self.tokens[at] == hashes, at, -1)

    def containment(self, t: int, block: np.ndarray) -> float | None:
        """The share of a template in the sorted distinct ranks of a block, if it reaches the threshold."""
        need, own = self.needed[t], self.ranked[t]
        if len(block) < need:
            return None
        place = np.searchsorted(block, own)
        common = np.flatnonzero(block[np.minimum(place, len(block) - 1)] == own)
        # The first common token of the two orders: nothing before it is common.
        if not len(common) or 1 + min(len(block) - int(place[common[0]]) - 1, len(own) - int(common[0]) - 1) < need:
            return None
        return len(common) / len(own) if len(common) >= need else None


def _blocks(templates: Templates, token: np.ndarray, offsets: np.ndarray):
    """(text, template, first word, words, containment) of all blocks that match; ``token`` holds the words of some texts."""
    hits = np.flatnonzero(token >= 0)
    hits = hits[templates.in_prefix[token[hits]]]
    seen = set()
    for at, doc in zip(hits.tolist(), (np.searchsorted(offsets, hits, "right") - 1).tolist(), strict=True):
        begin, end = int(offsets[doc]), int(offsets[doc + 1])
        for t, _ in templates.index[int(templates.rank[token[at]])]:
            n = templates.lengths[t]
            last = (at - begin) // n
            for k in (last - 1, last):
                if k < 0 or (doc, t, k) in seen:
                    continue
                seen.add((doc, t, k))
                first, stop = begin + k * n, min(end, begin + (k + 2) * n)
                own = token[first:stop]
                share = templates.containment(t, np.unique(templates.rank[own[own >= 0]]))
                if share is not None:
                    yield doc, t, first - begin, stop - first, share


def _frequencies(docs: DataFrame, templates: Templates) -> np.ndarray:
    """Texts of the corpus that contain each template token."""

    def count(batches):
        n = np.zeros(len(templates.tokens), dtype=np.int64)
        for batch in batches:
            for _, hashes, offsets in tx.slices(tx.binary_column(batch, "text"), tx.ALNUM):
                at = templates.find(hashes)
                hits = np.flatnonzero(at >= 0)
                pairs = np.unique(np.searchsorted(offsets, hits, "right") * len(n) + at[hits])
                n += np.bincount(pairs % max(1, len(n)), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["token", "n"])

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(len(templates.tokens), dtype=np.int64)
    for row in sums:
        found[row["token"]] = row["n"]
    return found


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """License phrases and notices of each text: ``doc_id, n_words, matches``.

    docs: ``doc_id`` and ``text`` (other columns, whatever their names, are not read); one row per row,
    repeated ones too, and none for an empty table.  ``matches`` lists every phrase place (kind
    ``phrase``) and every block that contains a template (kind ``template``) with its label, first
    word (from 0), words and containment, in order of place, then of kind, label, words and
    containment; a notice may lie in two blocks.  Null and empty texts have no words and no matches.
    Very long texts are taken whole.  A null doc_id stays null.
    """
    known = Templates(templates, threshold)
    known.order(_frequencies(docs, known))
    phrases = [([np.uint64(tx.word_hash(w)) for w in phrase.split()], label) for phrase, label in PHRASES.items()]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("containment", pa.float64())]))

    def scan(batches):
        for batch in batches:
            matches: list[list] = [[] for _ in range(batch.num_rows)]
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            for first, hashes, offsets in tx.slices(tx.binary_column(batch, "text"), tx.ALNUM):
                n_words[first : first + len(offsets) - 1] = np.diff(offsets)
                for words, label in phrases:
                    at = np.flatnonzero(hashes[: max(0, len(hashes) - len(words) + 1)] == words[0])
                    for i, w in enumerate(words[1:], 1):
                        at = at[hashes[at + i] == w]
                    doc = np.searchsorted(offsets, at, "right") - 1
                    for a, d in zip(at.tolist(), doc.tolist(), strict=True):
                        if a + len(words) <= offsets[d + 1]:
                            matches[first + d].append(("phrase", label, a - int(offsets[d]), len(words), 1.0))
                for d, t, start, words, share in _blocks(known, known.find(hashes), offsets):
                    matches[first + d].append(("template", known.labels[t], start, words, share))
            for own in matches:
                own.sort(key=lambda m: (m[2], m[0], m[1], m[3], m[4]))
            columns = [batch.column("doc_id"), pa.array(n_words), pa.array([[dict(zip(("kind", "label", "start", "words", "containment"), m, strict=True)) for m in own] for own in matches], kind)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(scan), f"doc_id long, n_words long, matches {MATCHES}")


def license_digest(scanned: DataFrame) -> DataFrame:
    """Counts, places, labels and score of each text from the matches of ``license_scan``.

    ``score`` is the greatest containment of a match: 1 for a phrase, 0 without matches.
    """
    base = F.filter("matches", lambda m: m["kind"] == "phrase")
    starts = F.transform(base, lambda m: m["start"])
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("score"),
    )


def license_sql(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> str:
    """DuckDB SQL for the query over documents."""
    text = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rows = ", ".join(f"('{label}', string_split('{words}', ' '))" for label, words in templates)
    phrases = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for phrase, label in PHRASES.items())
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p(label, q) AS (VALUES {phrases}),
b AS (SELECT r, label, i - 1 AS place FROM (SELECT r, label, w, q, unnest(range(1, len(w) - len(q) + 2)) AS i FROM d, p WHERE len(w) >= len(q)) WHERE w[i] = q[1] AND w[i:i + len(q) - 1] = q),
t(label, q) AS (VALUES {rows}),
n AS (SELECT label, len(q) AS n, list_distinct(q) AS s FROM t),
k AS (SELECT r, label, n, s, w, unnest(range(0, len(w), n)) AS a FROM d, n WHERE len(list_filter(s, lambda x: list_contains(w, x))) >= {threshold} * len(s) - 1e-9),
m AS (SELECT r, label, len(list_intersect(w[a + 1:a + 2 * n], s))::DOUBLE / len(s) AS share, len(s) AS size FROM k),
f AS (SELECT r, label, share FROM m WHERE round(share * size) >= ceil({threshold} * size - 1e-9)),
g AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT r, label, 1.0::DOUBLE AS share FROM b UNION ALL SELECT * FROM f) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN g USING (r) LEFT JOIN l USING (r)"""
