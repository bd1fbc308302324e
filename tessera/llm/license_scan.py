"""License scans by template-markup matching.

A template is license wording with markup: ``<<optional>> ... <</optional>>`` may be missing, ``<<var:N>>`` stands for one to N
words of any kind. It is compiled into an automaton over words; a text is accepted where some run of its words leads from the
template's first mandatory words to its end, so all mandatory wording matches exactly. Automata start
only where their first two mandatory words stand. Plain phrases are found everywhere besides.

Words are runs of letters, digits and non-ASCII characters, A to Z lower-cased. Null texts have no words, no labels
and score 0. Repeated rows are judged alike. Very long texts are read whole, one block each. Phrases and templates that overlap or start at the same word
all count, whatever their order. Null ids stay null. An empty table gives an empty result. Only the id and the text are read, so other
columns may have any names; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textbytes import ALNUM, blocks

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Wording of common license notices.
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        <<optional>>(the "Software")<</optional>>, to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions: The above copyright notice and this permission notice <<optional>>(including the next paragraph)<</optional>> shall be included
        in all copies or substantial portions of the Software. The software is provided "as is", without warranty of any kind, express or implied, including but
        not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders
        be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the
        software or the use or other dealings in the software.""",
    "mit-permission": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        <<optional>>(the "Software")<</optional>>, to deal in the Software without restriction""",
    "mit-notice": "<<optional>>released licensed distributed<</optional>> under the <<optional>>terms of the<</optional>> MIT license",
    "apache-2.0-notice": "licensed under the Apache License, <<optional>>version<</optional>> 2.0",
    "gpl-notice": "licensed under the <<optional>>terms of the<</optional>> GNU General Public License, version <<var:1>>",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version <<var:1>> of the License, or <<optional>>(at your option)<</optional>> any later version.""",
    "cc-by-nc-notice": "licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> CC BY-NC <<optional>>4.0<</optional>>",
    "cc-by-sa-notice": "licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> CC BY-SA <<optional>>4.0<</optional>>",
    "cc-by-notice": "licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> CC BY 4.0",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. The software is provided "as is" and the author disclaims all warranties with regard to
        this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or
        consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious
        action, arising out of or in connection with the use or performance of this software.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        <<optional>>1.<</optional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<optional>>2.<</optional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. <<optional>>3.<</optional>>
        <<optional>>Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission.<</optional>> This software is provided by the copyright holders and contributors "as is" and any express or
        implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.""",
    "spdx-tag": "SPDX-License-Identifier: <<var:4>>",
}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def _hashes(words: list[str]) -> list[int]:
    if not words:
        return []
    b = next(blocks(pa.array([" ".join(words)])))
    s, e, _ = b.words()
    return [int(x) for x in b.hashes(s, e, lower=True)]


class Automaton:
    """States 0 to n over word hashes; ``eat[state]`` are its word edges (None: any word), ``skip[state]`` its free edges."""

    def __init__(self, template: str):
        self.eat: list[dict] = []
        self.skip: list[set[int]] = []
        self.lead: list[int] = []
        optional, fresh = 0, True
        opened = -1
        for part in re.split(r"(<<.*?>>)", template):
            if part == "<<optional>>":
                opened, optional = len(self.eat), 1
            elif part == "<</optional>>":
                self.skip_from(opened, len(self.eat))
                optional = 0
            elif m := re.fullmatch(r"<<var:(\d+)>>", part):
                after = len(self.eat) + int(m[1])
                for k in range(int(m[1])):
                    self.state({None: len(self.eat) + 1})
                    if k:  # the first word must be there
                        self.skip_from(len(self.eat) - 1, after)
                fresh = fresh and bool(optional)
            else:
                for h in _hashes(words_of(part)):
                    if not optional and len(self.lead) < 2 and (not self.lead or self.lead_at + 1 == len(self.eat)):
                        self.lead.append(h)
                        self.lead_at = len(self.eat)
                        if len(self.lead) == 1:
                            self.first = len(self.eat)
                    self.state({h: len(self.eat) + 1})
        self.end = len(self.eat)

    def state(self, edges: dict) -> None:
        self.eat.append(edges)
        while len(self.skip) < len(self.eat) + 1:
            self.skip.append(set())

    def skip_from(self, a: int, b: int) -> None:
        while len(self.skip) <= max(a, b):
            self.skip.append(set())
        self.skip[a].add(b)

    def closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            s = todo.pop()
            for t in self.skip[s] if s < len(self.skip) else ():
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def accepts(self, words: list[int], at: int) -> bool:
        """Whether a run that begins with the first mandatory word at ``at`` reaches the end."""
        now = self.closed({self.first})
        while now:
            if self.end in now:
                return True
            if at >= len(words):
                return False
            w = words[at]
            now = self.closed({t for s in now if s < self.end for e, t in self.eat[s].items() if e is None or e == w})
            at += 1
        return False


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row."""
    machines = {name: Automaton(t) for name, t in (TEMPLATES if templates is None else templates).items()}
    phrases = {label: np.array(_hashes(words_of(p)), np.uint64) for p, label in PHRASES.items()}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def places(h: np.ndarray, owner: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        n = len(h) - len(wanted) + 1
        if n <= 0:
            return np.empty(0, np.int64)
        at = np.flatnonzero(h[:n] == wanted[0])
        for i in range(1, len(wanted)):
            at = at[h[at + i] == wanted[i]]
        return at[owner[at] == owner[at + len(wanted) - 1]]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in blocks(b.column(1)):
                starts, ends, owner = k.words(ALNUM)
                h = k.hashes(starts, ends, lower=True) if len(starts) else np.empty(0, np.uint64)
                edges = np.searchsorted(owner, np.arange(k.n + 1))
                n_base, first, last = np.zeros(k.n, np.int64), np.full(k.n, np.iinfo(np.int64).max), np.full(k.n, -1)
                base: dict[int, set[str]] = {}
                own: dict[int, set[str]] = {}
                for label, wanted in phrases.items():
                    at = places(h, owner, wanted)
                    t, rel = owner[at], at - edges[owner[at]]
                    np.add.at(n_base, t, 1)
                    np.minimum.at(first, t, rel)
                    np.maximum.at(last, t, rel)
                    for x in np.unique(t):
                        base.setdefault(int(x), set()).add(label)
                for name, m in machines.items():
                    for p in places(h, owner, np.array(m.lead, np.uint64)):
                        t = int(owner[p])
                        if name not in own.get(t, ()) and m.accepts(h[p : min(p + m.end, edges[t + 1])].tolist(), 0):
                            own.setdefault(t, set()).add(name)
                none = n_base == 0
                base_labels = [",".join(sorted(base.get(t, ()))) for t in range(k.n)]
                labels = [",".join(sorted(base.get(t, set()) | own.get(t, set()))) for t in range(k.n)]
                score = [1.0 if t in own else 0.5 if t in base else 0.0 for t in range(k.n)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(k.first, k.n), pa.array(np.diff(edges).astype(np.int64)), pa.array(n_base), pa.array(first, mask=none), pa.array(last, mask=none), pa.array(base_labels, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64())],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    out = rows.mapInArrow(apply, schema)
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)
