"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a line of at most twice as many words as the template has, or any run of as many words as it has, over line
breaks too (a window at every word).  A template matches a block when the block holds at least ``threshold`` of the template's distinct words
(containment).  The join is exact:

* one pass over all texts counts how often each template word occurs; that is the global order, rarest first;
* prefix filter: a block can only match if it holds one of the first ``n - ceil(threshold * n) + 1`` words of the
  template in that order;
* length filter: a block with fewer distinct words than ``ceil(threshold * n)`` cannot match, nor can a window with
  fewer words of the template, repeats included;
* names: a block has to hold the words of a template that name the license (``NAMES``), so what a notice shares with that
  of another license is not enough;
* positional filter: with the first shared word at position p, at most ``n - p`` words can be shared.

Base: the places of fixed phrases, word by word (``phrases``); these always stay.

Nulls and empty texts have no words and no labels; ties and repeated rows are handled row by row; an empty table
gives an empty result; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm import textkit as tk

#: Phrases and labels of the base.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

#: License texts, the notices that files carry, and their short forms.  A label is what stands before the first "-".
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-full": """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the
        rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions the above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the software the
        software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the
        authors or copyright holders be liable for any claim damages or other liability whether in an action of
        contract tort or otherwise arising from out of or in connection with the software or the use or other dealings
        in the software""",
    "mit-short": "released under the mit license",
    "apache": "licensed under the apache license version 2.0 you may not use this file except in compliance with the license",
    "apache-full": """
        licensed under the apache license version 2.0 the license you may not use this file except in compliance with
        the license you may obtain a copy of the license at http www apache org licenses license 2.0 unless required by
        applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license for the specific
        language governing permissions and limitations under the license""",
    "apache-short": "licensed under the apache license version 2.0",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "gpl-full": """
        this program is free software you can redistribute it and or modify it under the terms of the gnu general public
        license as published by the free software foundation either version 3 of the license or at your option any later
        version this program is distributed in the hope that it will be useful but without any warranty without even the
        implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for
        more details you should have received a copy of the gnu general public license along with this program if not
        see https www gnu org licenses""",
    "gpl-short": "released under the gnu general public license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-full": """
        redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met 1 redistributions of source code must retain the above copyright notice this list
        of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright
        notice this list of conditions and the following disclaimer in the documentation and or other materials provided
        with the distribution this software is provided by the copyright holders and contributors as is and any express
        or implied warranties including but not limited to the implied warranties of merchantability and fitness for a
        particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any
        direct indirect incidental special exemplary or consequential damages including but not limited to procurement
        of substitute goods or services loss of use data or profits or business interruption however caused and on any
        theory of liability whether in contract strict liability or tort including negligence or otherwise arising in
        any way out of the use of this software even if advised of the possibility of such damage""",
    "mpl": "this source code form is subject to the terms of the mozilla public license",
    "mpl-full": """
        this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not
        distributed with this file you can obtain one at https mozilla org mpl 2.0""",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-full": """
        permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies the software is
        provided as is and the author disclaims all warranties with regard to this software including all implied
        warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect
        or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an
        action of contract negligence or other tortious action arising out of or in connection with the use or
        performance of this software""",
    "zlib-full": """
        this software is provided as is without any express or implied warranty in no event will the authors be held
        liable for any damages arising from the use of this software permission is granted to anyone to use this
        software for any purpose including commercial applications and to alter it and redistribute it freely subject to
        the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you
        wrote the original software if you use this software in a product an acknowledgment in the product documentation
        would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not
        be misrepresented as being the original software 3 this notice may not be removed or altered from any source
        distribution""",
    "boost-full": """
        permission is hereby granted free of charge to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license the software to use reproduce display distribute execute and
        transmit the software and to prepare derivative works of the software and to permit third parties to whom the
        software is furnished to do so all subject to the following the copyright notices in the software and this
        entire statement including the above license grant this restriction and the following disclaimer must be
        included in all copies of the software in whole or in part and all derivative works of the software unless such
        copies or derivative works are solely in the form of machine executable object code generated by a source
        language processor""",
    "unlicense-full": """
        this is free and unencumbered software released into the public domain anyone is free to copy modify publish use
        compile sell or distribute this software either in source code form or as a compiled binary for any purpose
        commercial or non commercial and by any means""",
    "cc": "this work is licensed under a creative commons attribution license",
    "cc-short": "licensed under cc by nc 4.0",
}
#: Words that name a license.  A block matches a template only if it holds those of them that the template has.
NAMES = {"mit", "apache", "gnu", "bsd", "mpl", "mozilla", "isc", "zlib", "boost", "unencumbered", "creative", "commons", "cc"}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _template_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return tk.Words(raw, np.array([0, len(raw)]), 0, 1, tk.ALNUM).hashes


def _template_words(templates: dict[str, str]) -> dict[str, list[int]]:
    return {name: sorted({int(h) for h in _template_hashes(text)}) for name, text in templates.items()}


def token_counts(df: DataFrame, tokens: list[int], text: str = "text") -> dict[int, int]:
    """How often each template word occurs in all texts; the result has one row per template word at most."""
    known = np.array(sorted(tokens), dtype=np.uint64)

    def count(batches):
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            data, offsets = tk.string_buffers(batch.column(0))
            for i, j in tk.slices(offsets):
                h = tk.Words(data, offsets, i, j, tk.ALNUM).hashes
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                total += np.bincount(at[known[at] == h], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(total)], names=["token", "n"])

    rows = df.select(text).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r.token & (2**64 - 1): r.n for r in rows}


class TemplateIndex:
    """Templates with their words in the global order."""

    def __init__(self, counts: dict[int, int], threshold: float, templates: dict[str, str] = TEMPLATES):
        words = _template_words(templates)
        order = sorted({w for ws in words.values() for w in ws}, key=lambda w: (counts.get(w, 0), w))
        rank = {w: i for i, w in enumerate(order)}
        by_hash = sorted(order)
        self.known = np.array(by_hash, dtype=np.uint64)
        self.rank = np.array([rank[w] for w in by_hash], dtype=np.int64)
        self.templates = [(name, np.array(sorted(rank[w] for w in ws)), math.ceil(threshold * len(ws) - 1e-9)) for name, ws in words.items()]
        named = {rank[w] for w in map(tk.hash_word, sorted(NAMES)) if w in rank}
        self.names = [np.array(sorted(named & set(ranks.tolist())), dtype=np.int64) for _, ranks, _ in self.templates]
        self.prefix_of: dict[int, list[int]] = {}
        for t, (_, ranks, need) in enumerate(self.templates):
            for r in ranks[: len(ranks) - need + 1].tolist():
                self.prefix_of.setdefault(r, []).append(t)
        self.in_prefix = np.zeros(len(order), dtype=bool)
        self.in_prefix[list(self.prefix_of)] = True
        self.sizes = [len(_template_hashes(templates[name])) for name, _, _ in self.templates]
        self.member = np.zeros((len(self.templates), len(order)), dtype=bool)
        self.prefix = np.zeros_like(self.member)
        for t, (_, ranks, need) in enumerate(self.templates):
            self.member[t, ranks] = True
            self.prefix[t, ranks[: len(ranks) - need + 1]] = True

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """The global rank of each word, -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.rank[at], -1)

    def matches(self, block: np.ndarray, n_distinct: int, n_words: int) -> list[tuple[str, float]]:
        """(template, containment) for the sorted distinct template ranks of one line."""
        found = []
        candidates = {t for r in block[self.in_prefix[block]].tolist() for t in self.prefix_of[r]}
        for t in sorted(candidates):
            name, ranks, need = self.templates[t]
            if n_distinct < need or n_words > 2 * self.sizes[t] or not np.isin(self.names[t], block, assume_unique=True).all():
                continue
            # the first word of the prefix that the block holds bounds what both can share, before that is counted
            prefix = ranks[: len(ranks) - need + 1]
            p = int(np.argmax(np.isin(prefix, block, assume_unique=True)))
            if min(len(ranks) - p, len(block) - int(np.searchsorted(block, prefix[p]))) < need:
                continue
            if (n := int(np.isin(ranks[p:], block, assume_unique=True).sum())) >= need:
                found.append((name, n / len(ranks)))
        return found

    def windows(self, ranks: np.ndarray, doc: np.ndarray, first_of: np.ndarray) -> list[tuple[str, int, float]]:
        """(template, text, containment) for the best window of each text, from the ranks of all words of the texts."""
        found = []
        known = np.flatnonzero(ranks >= 0)
        for t, (name, own, need) in enumerate(self.templates):
            size = self.sizes[t]
            at = known[self.member[t, ranks[known]]]
            hot = at[self.prefix[t, ranks[at]]]
            if not len(hot):
                continue
            # words that share a window with a word of the prefix
            k = np.searchsorted(hot, at)
            at = at[(at - hot[np.maximum(k - 1, 0)] < size) & (k > 0) | (hot[np.minimum(k, len(hot) - 1)] - at < size) & (k < len(hot))]
            each = np.arange(len(at))
            if (np.searchsorted(at, at + size) - each).max() < need:
                continue
            # a word counts in the windows that begin behind its last occurrence, up to itself
            order = np.argsort(ranks[at], kind="stable")
            again = np.flatnonzero(ranks[at[order[1:]]] == ranks[at[order[:-1]]])
            behind = np.zeros(len(at), np.int64)
            behind[order[again + 1]] = order[again] + 1
            behind = np.maximum(behind, np.searchsorted(at, np.maximum(at - size + 1, first_of[doc[at]])))
            n = np.cumsum(np.bincount(behind, minlength=len(at) + 1) - np.bincount(each + 1, minlength=len(at) + 1))[:-1]
            hit = np.flatnonzero(n >= need)
            if len(self.names[t]):
                until = np.searchsorted(at, at[hit] + size)
                hit = hit[[np.isin(self.names[t], ranks[at[x:y]][doc[at[x:y]] == doc[at[x]]]).all() for x, y in zip(hit.tolist(), until.tolist(), strict=True)]] if len(hit) else hit
            best: dict[int, int] = {}
            for x, c in zip(doc[at[hit]].tolist(), n[hit].tolist(), strict=True):
                best[x] = max(c, best.get(x, 0))
            found += [(name, x, c / len(own)) for x, c in best.items()]
        return found


def scan_licenses(df: DataFrame, threshold: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per text: see ``SCHEMA``.  ``score``: the best containment, 1 where a base phrase occurs."""
    tokens = sorted({w for ws in _template_words(TEMPLATES).values() for w in ws})
    index = TemplateIndex(token_counts(df, tokens, text), threshold)
    phrases = [([tk.hash_word(w) for w in words], label) for words, label in PHRASES.items()]

    def scan(batches):
        for batch in batches:
            ids = batch.column(0)
            data, offsets = tk.string_buffers(batch.column(1))
            for i, j in tk.slices(offsets):
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *_scan_slice(data, offsets, i, j, index, phrases)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(scan, SCHEMA)


def _scan_slice(data, offsets, i, j, index: TemplateIndex, phrases) -> list[pa.Array]:
    w = tk.Words(data, offsets, i, j, tk.ALNUM)
    n, h, d = j - i, w.hashes, w.doc
    n_words = w.counts()
    first_of = np.cumsum(n_words) - n_words
    places, labels = [], []
    for words, label in phrases:
        k = len(words)
        if len(h) < k:
            continue
        ok = d[: len(d) - k + 1] == d[k - 1 :]
        for t, x in enumerate(words):
            ok &= h[t : len(h) - k + 1 + t] == np.uint64(x)
        at = np.flatnonzero(ok)
        places.append(at)
        labels += [label] * len(at)
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    base: dict[int, tuple[set, list]] = {}
    for p, label in zip(at.tolist(), labels, strict=True):
        own = base.setdefault(int(d[p]), (set(), []))
        own[0].add(label)
        own[1].append(p - int(first_of[d[p]]))
    extra: dict[int, dict[str, float]] = {}
    ranks = index.ranks(h)
    hot = np.flatnonzero((ranks >= 0) & index.in_prefix[ranks])
    if len(hot):  # lines and windows that pass the prefix filter
        newlines = np.flatnonzero(data[w.base : int(offsets[j])] == 10)
        line = np.searchsorted(newlines, w.starts) + d  # a text begins a line of its own
        for b in np.unique(line[hot]).tolist():
            lo, hi = np.searchsorted(line, [b, b + 1])
            own = ranks[lo:hi]
            for name, c in index.matches(np.unique(own[own >= 0]), len(np.unique(h[lo:hi])), hi - lo):
                got = extra.setdefault(int(d[lo]), {})
                got[name.split("-")[0]] = max(c, got.get(name.split("-")[0], 0.0))
        for name, x, c in index.windows(ranks, d, first_of):
            got = extra.setdefault(x, {})
            got[name.split("-")[0]] = max(c, got.get(name.split("-")[0], 0.0))
    n_base = np.zeros(n, np.int64)
    first, last, base_labels, all_labels, score = [None] * n, [None] * n, [""] * n, [""] * n, np.zeros(n)
    for x in base.keys() | extra.keys():
        own, where = base.get(x, (set(), []))
        more = extra.get(x, {})
        if where:
            n_base[x], first[x], last[x] = len(where), min(where), max(where)
        base_labels[x] = ",".join(sorted(own))
        all_labels[x] = ",".join(sorted(own | more.keys()))
        score[x] = 1.0 if where else max(more.values())
    return [pa.array(n_words.astype(np.int64)), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base_labels), pa.array(all_labels), pa.array(score)]


def oracle_sql(threshold: float = 0.8) -> str:
    """The same rows by plain counting: every line, and every window that begins at a word of the template."""
    import re

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    values = ", ".join(f"('{name.split('-')[0]}', {re.findall(word, text)})" for name, text in TEMPLATES.items())
    names = ", ".join(f"'{n}'" for n in sorted(NAMES))
    return rf"""
WITH tpl(label, w) AS (VALUES {values}),
t AS (SELECT row_number() OVER () AS k, label, len(w) AS size, list_distinct(w) AS ws FROM tpl),
tw AS (SELECT k, label, size, len(ws) AS n, ceil({threshold} * len(ws) - 1e-9) AS need, len(list_filter(ws, lambda x: x IN ({names}))) AS names, unnest(ws) AS word FROM t),
d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS x FROM documents),
dl AS (SELECT r, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS line_no FROM d),
lw AS (SELECT r, line_no, regexp_extract_all(line, '{word}') AS w FROM dl),
flat AS (SELECT r, line_no, len(w) AS nl, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM lw),
pos AS (SELECT r, line_no, nl, word, row_number() OVER o - 1 AS p, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM flat WINDOW o AS (PARTITION BY r ORDER BY line_no, i)),
nw AS (SELECT r, count(*) AS n_words FROM pos GROUP BY r),
base AS (SELECT r, p, CASE word WHEN 'general' THEN 'gpl' ELSE word END AS label FROM pos
  WHERE word IN ('mit', 'apache') AND w2 = 'license' OR word = 'general' AND w2 = 'public' AND w3 = 'license'),
bs AS (SELECT r, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
occ AS (SELECT r, line_no, nl, p, k, label, size, n, need, names, tw.word FROM pos JOIN tw ON pos.word = tw.word),
enough AS (SELECT r, k FROM occ GROUP BY r, k, need HAVING count(DISTINCT word) >= need),
near AS (SELECT occ.* FROM occ SEMI JOIN enough USING (r, k)),
hits AS (SELECT r, label, count(DISTINCT word) / n AS c FROM near WHERE nl <= 2 * size GROUP BY r, k, label, line_no, n, need, names HAVING count(DISTINCT word) >= need AND count(DISTINCT word) FILTER (word IN ({names})) = names
  UNION ALL SELECT a.r, a.label, count(DISTINCT b.word) / a.n FROM near a JOIN near b ON a.r = b.r AND a.k = b.k AND b.p BETWEEN a.p AND a.p + a.size - 1
  GROUP BY a.r, a.k, a.label, a.p, a.n, a.need, a.names HAVING count(DISTINCT b.word) >= a.need AND count(DISTINCT b.word) FILTER (b.word IN ({names})) = a.names),
ls AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM hits UNION SELECT r, label FROM base) GROUP BY r),
sc AS (SELECT r, max(c) AS score FROM hits GROUP BY r)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(score, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN nw USING (r) LEFT JOIN bs USING (r) LEFT JOIN ls USING (r) LEFT JOIN sc USING (r)
"""
