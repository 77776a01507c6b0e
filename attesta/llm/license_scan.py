"""License scans with a generalised suffix automaton of template words.

Texts are lower-cased in A-Z and cut into runs of ASCII letters, digits and
anything above ASCII. Words of the templates have numbers; any other word ends
every match. The automaton reads the runs of known words and gives the matching
statistics: at each word the length of the longest match with any template that
ends there. Maximal matches of ``min_match`` words or more are chained in the
order of their template, over gaps of at most ``max_gap`` words; a template whose
chain covers ``cover`` of its words gives its label. Phrases are templates too,
and each place of one counts.

Defined results: a null or empty text has no words, no places, labels "" and
score 0; repeated rows get a row each; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.textnum import LOWER, MARKS, texts, words

# Phrases; opening passages, notices and whole short texts of public licenses, without marks and names.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this work is licensed under a creative commons attribution share alike international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution international license", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability "
        "and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability "
        "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
        "bsd-2-clause",
    ),
    (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "bsd-3-clause",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl-2.0-or-later",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl-3.0-or-later",
    ),
    (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation "
        "either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
        "lgpl-2.1-or-later",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software altered source versions must be plainly marked as such "
        "and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
        "zlib",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "mpl-2.0",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "unlicense",
    ),
)


class Automaton:
    """All templates' words in one suffix automaton; each state knows where it ends in each template."""

    def __init__(self, phrases, templates, min_match: int):
        self.labels = [label for _, label in (*phrases, *templates)]
        self.n_phrases, self.min_match = len(phrases), min_match
        split = [text.split() for text, _ in (*phrases, *templates)]
        self.size = [len(s) for s in split]
        names = sorted({w for s in split for w in s})
        t = next(texts(pa.array([" ".join(names)])))
        w = words(t, MARKS, LOWER)
        if w.n[0] != len(names):
            raise ValueError("a template word is no run of letters and digits")
        number = {w.data[a:b].tobytes(): k for k, (a, b) in enumerate(zip(w.start, w.end, strict=True))}
        self.spelt = [x.encode() for x in names]
        h = w.hashes()
        self.order = np.argsort(h)
        self.hash = h[self.order]
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(h & np.uint64(0xFFFF)).astype(int)] = True
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for k, s in enumerate(split):
            self._add([number[x.encode()] for x in s], k)
        self.phrase_state = [self._walk([number[x.encode()] for x in split[k]]) for k in range(self.n_phrases)]
        for v in sorted(range(1, len(self.len)), key=lambda v: -self.len[v]):
            for k, e in self.ends[v].items():
                own = self.ends[self.link[v]]
                own[k] = min(own.get(k, e), e)
        above = {}
        for v in sorted(range(len(self.len)), key=lambda v: self.len[v]):
            own = [k for k, p in enumerate(self.phrase_state) if p == v]
            above[v] = (above[self.link[v]] if v else []) + own
        self.phrases_at = [above[v] for v in range(len(self.len))]

    def _walk(self, word_ids: list[int]) -> int:
        v = 0
        for x in word_ids:
            v = self.next[v][x]
        return v

    def _new(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.len.append(length)
        self.next.append(nxt)
        self.link.append(link)
        self.ends.append({})
        return len(self.len) - 1

    def _add(self, word_ids: list[int], template: int) -> None:
        last = 0
        for at, x in enumerate(word_ids):
            last = self._extend(last, x)
            self.ends[last][template] = at + 1

    def _extend(self, last: int, x: int) -> int:
        """The state of ``last``'s words with x behind them."""
        if x in self.next[last]:
            q = self.next[last][x]
            return q if self.len[q] == self.len[last] + 1 else self._split(last, x, q)
        v, p = self._new(self.len[last] + 1, {}, 0), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = v
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[v] = q if self.len[q] == self.len[p] + 1 else self._split(p, x, q)
        return v

    def _split(self, p: int, x: int, q: int) -> int:
        """A copy of q for the shorter words that reach it through p."""
        c = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words the templates have, and their numbers."""
        may = np.flatnonzero(self.bits[(h & np.uint64(0xFFFF)).astype(np.int64)])
        where = np.searchsorted(self.hash, h[may])
        where[where == len(self.hash)] = 0
        ok = self.hash[where] == h[may]
        return may[ok], self.order[where[ok]]

    def read(self, ids: list[int], begin: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """A run of known words -> places of phrases (first word, phrase), maximal matches (first word, length, state)."""
        nxt, link, length, at_end = self.next, self.link, self.len, self.phrases_at
        v = n = 0
        places, matches = [], []
        for k, x in enumerate(ids):
            if x not in nxt[v]:
                if n >= self.min_match:
                    matches.append((begin + k - n, n, v))
                while v and x not in nxt[v]:
                    v = link[v]
                n = length[v]
            if x in nxt[v]:
                v = nxt[v][x]
                n += 1
            for p in at_end[v]:
                if n >= self.size[p]:
                    places.append((begin + k + 1 - self.size[p], p))
        if n >= self.min_match:
            matches.append((begin + len(ids) - n, n, v))
        return places, matches

    def chains(self, matches: list[tuple[int, int, int]], max_gap: int) -> dict[int, float]:
        """The largest share of each template that a chain of its matches covers."""
        best: dict[int, float] = {}
        by: dict[int, list[tuple[int, int, int]]] = {}
        for first, n, v in matches:
            for k, e in self.ends[v].items():
                by.setdefault(k, []).append((first, n, e - n))
        for k, own in by.items():
            held: list[tuple[int, int, int]] = []  # last word, template end, words covered
            top = 0
            for first, n, at in sorted(own):
                held = [x for x in held if x[0] + max_gap + n >= first]
                cover = n
                for last, end, had in held:
                    if last <= first + n and end <= at + n and at + n - end > 0 and first - last <= max_gap:
                        cover = max(cover, had + min(n, at + n - end, first + n - last))
                held.append((first + n, at + n, cover))
                top = max(top, cover)
            best[k] = min(1.0, top / self.size[k])
        return best


SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:int,words:int>>"
SCANNED = pa.schema(
    [("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("words", pa.int32())])))]
)


def license_scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, min_match: int = 4, max_gap: int = 4, cover: float = 0.6) -> DataFrame:
    """Rows of (doc_id, text) -> a row each: counts and places of phrases, labels, score, matched spans.

    score: the largest share of a template that a chain covers, 1 where a phrase stands.
    """
    made = Automaton(phrases, templates, min_match)
    shared = docs.sparkSession.sparkContext.broadcast(made)  # its size is the templates'

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for b in batches:
            for t in texts(b.column("text")):
                w = words(t, MARKS, LOWER)
                at, ids = a.known(w.hashes())
                places: dict[int, list] = {}
                matches: dict[int, list] = {}
                cut = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (w.doc[at[1:]] != w.doc[at[:-1]])]) if len(at) else np.zeros(0, int)
                ends = np.r_[cut[1:], len(at)] if len(cut) else cut
                long = ends - cut >= 2
                ids = ids.tolist()
                for x, y in zip(cut[long].tolist(), ends[long].tolist(), strict=True):
                    d = int(w.doc[at[x]])
                    p, m = a.read(ids[x:y], int(at[x] - w.at[d]))
                    if p:
                        places.setdefault(d, []).extend(p)
                    if m:
                        matches.setdefault(d, []).extend(m)
                out = []
                for d in range(len(t)):
                    p, m = places.get(d, ()), matches.get(d, ())
                    if not p and not m:
                        out.append((int(w.n[d]), 0, None, None, "", "", 0.0, []))
                        continue
                    base = sorted({a.labels[k] for _, k in p})
                    share = a.chains(m, max_gap) if m else {}
                    own = {a.labels[k] for k, s in share.items() if s >= cover and k >= a.n_phrases}
                    spans = [(a.labels[k], f, a.size[k]) for f, k in p] + [(a.labels[min(a.ends[v])], f, n) for f, n, v in m if a.ends[v]]
                    first = [f for f, _ in p]
                    out.append((int(w.n[d]), len(p), min(first, default=None), max(first, default=None), ",".join(base), ",".join(sorted(own | set(base))), 1.0 if p else max(share.values(), default=0.0), [dict(zip(("label", "first", "words"), s, strict=True)) for s in spans]))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(t.first, len(t)), *(pa.array(c, f.type) for c, f in zip(cols, list(SCANNED)[1:], strict=True))], schema=SCANNED)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCAN)
