"""License scan: marked-up templates compiled to token automata.

A template is wording with markup: ``<<beginOptional>> ... <<endOptional>>`` may be left
out, ``<<var;max=N>>`` stands for zero to N words of any kind. All other wording is
mandatory and must stand word for word. Every template (and every plain phrase) becomes
a chain of states in one shared automaton; sets of states are turned into deterministic
ones as texts ask for them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_binary

#: The phrases that every scan looks for, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices and licence texts that the method recognises beyond the phrases, with markup.
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var;max=1>> Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer. <<var;max=1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY <<var;max=12>> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL <<var;max=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
    "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
_GNU_NOTICE = (
    "<<var;max=8>> is free software<<var;max=1>> you can redistribute it and/or modify it under the terms of the GNU {name} <<beginOptional>>Public<<endOptional>> License as published by the Free Software Foundation<<var;max=1>> "
    "either version {version} of the License, or (at your option) any later version. <<var;max=8>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
    "FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} <<beginOptional>>Public<<endOptional>> License for more details."
)
TEMPLATES = {
    "mit-notice": "<<beginOptional>>this work is<<endOptional>> released under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "apache-2.0-notice": "licensed under the <<beginOptional>>terms of the<<endOptional>> Apache License <<beginOptional>>version<<endOptional>> 2.0",
    "gpl-3.0-notice": "licensed under <<beginOptional>>the terms of<<endOptional>> the GNU General Public License <<beginOptional>>version<<endOptional>> 3",
    "cc-by-nc-4.0-notice": "licensed under <<beginOptional>>a<<endOptional>> CC BY-NC 4.0 <<beginOptional>>license<<endOptional>>",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this <<var;max=4>> and associated documentation files",
    "apache-2.0-header": "licensed under the Apache License Version 2.0 the License you may not use this <<var;max=3>> except in compliance with the License",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;max=10>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, <<beginOptional>>and/or<<endOptional>> <<beginOptional>>and<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND <<var;max=6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
        "EVENT SHALL <<var;max=6>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause": _BSD_TERMS.rstrip() + _BSD_END,
    "bsd-3-clause": _BSD_TERMS + (
        "<<var;max=1>> Neither the name of <<var;max=12>> nor the names of <<beginOptional>>its<<endOptional>> <<beginOptional>>the<<endOptional>> contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ) + _BSD_END,
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<var;max=1>> The origin of this software must not be misrepresented; you must not claim "
        "that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<var;max=1>> Altered source versions must be plainly marked "
        "as such, and must not be misrepresented as being the original software. <<var;max=1>> This notice may not be removed or altered from any source distribution."
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use <<var;max=3>> except in compliance with the License. You may obtain a copy of the License at <<var;max=9>> Unless required by applicable law or agreed "
        "to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License."
    ),
    "gpl-2.0-or-later": _GNU_NOTICE.format(name="General", version="2"),
    "gpl-3.0-or-later": _GNU_NOTICE.format(name="General", version="3"),
    "lgpl-3.0-or-later": _GNU_NOTICE.format(name="Lesser General", version="3"),
    "agpl-3.0-or-later": _GNU_NOTICE.format(name="Affero General", version="3"),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<var;max=6>> <<beginOptional>>This Source Code Form is "
        "Incompatible With Secondary Licenses, as defined by the Mozilla Public License, v. 2.0.<<endOptional>>"
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, "
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"
    ),
    "cc-by-4.0": "<<beginOptional>>this work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution 4.0 International <<beginOptional>>Public<<endOptional>> License",
    "cc0-1.0": "To the extent possible under law, <<var;max=12>> has waived all copyright and related or neighboring rights to <<var;max=12>>",
}

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z to a-z; every ASCII character that is neither a digit nor a letter to a space.
FOLD = bytes(
    c if (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) else 32 for c in _LOWER
)
_MARK = re.compile(r"<<\s*(beginOptional|endOptional|var\s*;\s*max\s*=\s*\d+)\s*>>")


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: runs of digits, letters (lower-cased A-Z) and non-ASCII bytes."""
    return text.translate(FOLD).split()


def parse_template(markup: str) -> list[tuple]:
    """Markup to nested items: ("word", w), ("var", max) and ("opt", items)."""
    stack: list[list[tuple]] = [[]]
    at = 0
    for m in _MARK.finditer(markup):
        stack[-1] += [("word", w) for w in words_of(markup[at : m.start()].encode())]
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(("opt", inner))
        else:
            stack[-1].append(("var", int(m[1].rpartition("=")[2])))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    stack[-1] += [("word", w) for w in words_of(markup[at:].encode())]
    if not any(kind == "word" for kind, _ in stack[0]):
        raise ValueError("a template needs mandatory wording")
    return stack[0]


def trimmed(items: list[tuple]) -> list[tuple]:
    """items without the optional and replaceable regions at either end: a text that holds the rest matches with none of their words."""
    at = [n for n, (kind, _) in enumerate(items) if kind == "word"]
    return items[at[0] : at[-1] + 1]


class TokenAutomaton:
    """One automaton for all templates; run(words, i) gives the labels of those that match at i."""

    def __init__(self, templates: dict[str, str]):
        self.on: list[dict[bytes, list[int]]] = []
        self.any: list[list[int]] = []
        self.skip: list[list[int]] = []
        self.accept: dict[int, str] = {}
        self.start = self._state()
        must: dict[str, set[bytes]] = {}
        for label, markup in templates.items():
            items = trimmed(parse_template(markup))
            words = {x for kind, x in items if kind == "word"}
            must[label] = {w for w in words if len(w) > 7} or words
            first = self._state()
            self.skip[self.start].append(first)
            self.accept[self._chain(first, items)] = label
        self.required = self._cover(must)
        self.dfa: dict[tuple[frozenset, bytes | None], frozenset] = {}
        self.alphabet = {w for d in self.on for w in d}
        self.initial = self._closed({self.start})
        self.labels: dict[frozenset, tuple[str, ...]] = {}
        self.first = {w for s in self.initial for w in self.on[s]} if not any(self.any[s] for s in self.initial) else None

    def _state(self) -> int:
        self.on.append({})
        self.any.append([])
        self.skip.append([])
        return len(self.on) - 1

    def _chain(self, at: int, items: list[tuple]) -> int:
        for kind, x in items:
            nxt = self._state()
            if kind == "word":
                self.on[at].setdefault(x, []).append(nxt)
            elif kind == "opt":
                self.skip[self._chain(at, x)].append(nxt)
                self.skip[at].append(nxt)
            else:
                self.skip[at].append(nxt)
                for _ in range(x):
                    more = self._state()
                    self.any[at].append(more)
                    self.skip[more].append(nxt)
                    at = more
            at = nxt
        return at

    @staticmethod
    def _cover(must: dict[str, set[bytes]]) -> list[bytes]:
        """Few words of which every template must hold one: texts without any cannot match."""
        left, chosen = dict(must), []
        while left:
            best = max(sorted({w for ws in left.values() for w in ws}), key=lambda w: (sum(w in ws for ws in left.values()), len(w)))
            chosen.append(best)
            left = {k: ws for k, ws in left.items() if best not in ws}
        return chosen

    def _closed(self, states: set[int]) -> frozenset:
        todo, out = list(states), set(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    def _step(self, states: frozenset, word: bytes) -> frozenset:
        key = (states, word if word in self.alphabet else None)
        nxt = self.dfa.get(key)
        if nxt is None:
            to = {t for s in states for t in self.on[s].get(word, ())} | {t for s in states for t in self.any[s]}
            nxt = self.dfa[key] = self._closed(to) if to else frozenset()
        return nxt

    def run(self, words: list[bytes], i: int) -> set[str]:
        found: set[str] = set()
        states = self.initial
        n = len(words)
        while states:
            hit = self.labels.get(states)
            if hit is None:
                hit = self.labels[states] = tuple(self.accept[s] for s in states if s in self.accept)
            found.update(hit)
            if i >= n:
                break
            states = self._step(states, words[i])
            i += 1
        return found


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document with the license wording found anywhere in its whole text.

    n_base counts every place of every phrase; first_word and last_word are the smallest
    and largest start of such a place (words from 0). labels are those of the phrases
    and of the templates that match somewhere. score is 1 where a template's mandatory
    wording stands in full, 0.5 where only phrases were found, else 0.

    Null and empty texts give zero words, no label and score 0. Repeated rows are each
    scanned. An empty table gives no rows. Other columns are not read, so their names
    cannot clash. Narrow: no shuffle, memory bounded by one Arrow batch.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = TokenAutomaton({f"phrase {p}": p for p in phrases} | {f"notice {k}": v for k, v in templates.items()})
        required = [b" " + w + b" " for w in auto.required]
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in b.column(1).to_pylist():
                flat = text.translate(FOLD)
                words = flat.split()
                starts: list[int] = []
                base: set[str] = set()
                more: set[str] = set()
                padded = b" " + flat + b" "
                if any(w in padded for w in required):
                    for i, w in enumerate(words):
                        if auto.first is None or w in auto.first:
                            for found in auto.run(words, i):
                                kind, _, name = found.partition(" ")
                                if kind == "phrase":
                                    starts.append(i)
                                    base.add(phrases[name])
                                else:
                                    more.add(name)
                row = (
                    len(words), len(starts), min(starts) if starts else None, max(starts) if starts else None,
                    ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if more else 0.5 if base else 0.0,
                )
                for o, x in zip(out, row):
                    o.append(x)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, t) for o, t in zip(out, types))], names=names)

    return map_binary(docs, id_col, text_col, scan, SCHEMA)


def _template_regex(items: list[tuple]) -> str:
    """The same template as a regular expression over words that each end in a space (for SQL)."""
    out = ""
    for kind, x in items:
        if kind == "word":
            out += x.decode() + " "
        elif kind == "opt":
            out += f"(?:{_template_regex(x)})?"
        else:
            out += f"(?:[^ ]+ ){{0,{x}}}"
    return out


def license_sql() -> str:
    """The scan as DuckDB SQL over `documents`: words joined by single spaces, then regular expressions."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    hits = []
    for phrase, label in PHRASES.items():
        ws = phrase.split()
        cond = " AND ".join(f"w[i + {k + 1}] = '{w}'" for k, w in enumerate(ws))
        hits.append(f"SELECT doc_id, rid, i, '{label}' AS label FROM (SELECT doc_id, rid, w, unnest(range(len(w))) AS i FROM d) WHERE {cond}")
    extra = ", ".join(f"CASE WHEN regexp_matches(s, ' {_template_regex(parse_template(t))}') THEN '{k}' END" for k, t in TEMPLATES.items())
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
d AS (SELECT rid, doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM t),
hits AS ({" UNION ALL ".join(hits)}),
b AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS bl FROM hits GROUP BY rid),
m AS (SELECT rid, list_filter([{extra}], lambda x: x IS NOT NULL) AS ml FROM d)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
 CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
 coalesce(array_to_string(bl, ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), ml))), ','), '') AS labels,
 CASE WHEN len(ml) > 0 THEN 1.0 WHEN bl IS NOT NULL THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM d JOIN m USING (rid) LEFT JOIN b USING (rid)"""
