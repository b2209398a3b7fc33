"""License scans by template-markup matching.

A template is license wording with marked regions:

* `<<beginOptional>> ... <<endOptional>>`: the wording inside may be absent; regions nest;
* `<<var;name="...";match="...">>`: replaceable wording; `match` is `.{m,n}`, `.*` or `.+` (any words, counted, at most
  `LOOP` for the open forms) or literal alternatives such as `copyright holders|authors`.

Templates are compiled to position automata over words (`Automaton`): one state per word of the wording, edges where
one word may follow another. Only A-Z are lower-cased and a word is a run of digits, letters and characters outside
ASCII, so case, punctuation and line breaks never matter, and every mandatory word must be there in its place, with
nothing between. A place is the first word of a text part that an automaton accepts; from each place the longest
accepted part counts. The four base phrases are templates like the others.

Words of a whole Arrow slice are hashed at once; an automaton only starts where its first two words stand, and a part
that it accepts by hashes is compared again word by word.

Defined results: a null text counts as empty; a text without words has no places, labels '' and score 0; repeated rows
and equal texts get equal results; rows are never merged or dropped; input columns with the name of an output column are
replaced; a template that can be empty, begins or ends with a replaceable region or leaves a region open is a ValueError.
"""
from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aislemetry.llm.common import Words, segment_hashes, slices

LOOP = 40                   # most words of an open replaceable region

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
BLANK = np.ones(256, bool)
BLANK[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_A_TO_Z = {c: c + 32 for c in range(0x41, 0x5B)}


@dataclass(frozen=True)
class Template:
    """Wording with its label; `weight` is the score of a text in which it stands; base templates only count places."""
    label: str
    weight: float
    markup: str
    base: bool = False


# Phrases and labels of the base scan.
BASE = tuple(Template(label, 0.5, phrase, True) for phrase, label in (
    ("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")))

_UNDER = ('<<var;name="act";match="licensed|released|distributed|available|published">> under '
          '<<beginOptional>>the terms of <<endOptional>>')
_VERSION = '<<beginOptional>><<var;name="v";match="version|v">> <<endOptional>>'
_HOLDERS = '<<var;name="holders";match="copyright holders|authors|author|owner|contributors">>'
_AS_IS = ('THIS SOFTWARE IS PROVIDED BY <<var;name="who";match=".{1,20}">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
          'INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE '
          'ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="who";match=".{1,20}">> BE LIABLE FOR ANY DIRECT, INDIRECT, '
          'INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF '
          'SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON '
          'ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) '
          'ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.')
_BSD = ('Redistribution and use in source and binary forms, with or without modification, are permitted provided that the '
        'following conditions are met: <<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the '
        'above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2. '
        '<<endOptional>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions '
        'and the following disclaimer in the documentation and/or other materials provided with the distribution. ')

# Wording of public licenses and of their usual notices.
PUBLIC = (
    Template("mit-notice", 0.8, _UNDER + "the <<beginOptional>>(<<endOptional>>MIT License"),
    Template("apache-2.0-notice", 0.8, _UNDER + "the Apache License, " + _VERSION + "2.0"),
    Template("gpl-notice", 0.8, _UNDER + "the GNU General Public License<<beginOptional>>, " + _VERSION
             + '<<var;name="n";match="1|2|3">><<endOptional>>'),
    Template("cc-by-notice", 0.8, _UNDER + "<<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>"
             '<<var;name="cc";match="CC|Creative Commons">> <<var;name="by";match="BY|Attribution">> '
             '<<beginOptional>><<var;name="n";match="1.0|2.0|2.5|3.0|4.0">><<endOptional>>'),
    Template("cc-by-sa-notice", 0.8, _UNDER + "<<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>"
             '<<var;name="cc";match="CC BY-SA|Creative Commons Attribution-ShareAlike">> '
             '<<beginOptional>><<var;name="n";match="1.0|2.0|2.5|3.0|4.0">><<endOptional>>'),
    Template("cc-by-nc-notice", 0.8, _UNDER + "<<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>"
             '<<var;name="cc";match="CC BY-NC|Creative Commons Attribution-NonCommercial">> '
             '<<beginOptional>><<var;name="n";match="1.0|2.0|2.5|3.0|4.0">><<endOptional>>'),
    Template("mit-text", 1.0, 'Permission is hereby granted, free of charge, to any person obtaining a copy of '
             '<<var;name="what";match=".{1,6}">> and associated documentation files (the "Software"), to deal in the '
             'Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
             'distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is '
             'furnished to do so, subject to the following conditions: The above copyright notice and this permission '
             'notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or '
             'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS '
             'OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE '
             'AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="who";match=".{1,20}">> BE LIABLE FOR ANY CLAIM, DAMAGES '
             'OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN '
             'CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    Template("isc-text", 1.0, 'Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this '
             'software for any purpose with or without fee is hereby granted, provided that the above copyright notice and '
             'this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND '
             '<<var;name="who";match=".{1,10}">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
             'IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="who";match=".{1,10}">> BE '
             'LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM '
             'LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING '
             'OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    Template("bsd-2-text", 1.0, _BSD + _AS_IS),
    Template("bsd-3-text", 1.0, _BSD + '<<beginOptional>>3. <<endOptional>>Neither the name of '
             '<<var;name="org";match=".{1,20}">> nor the names of its contributors may be used to endorse or promote '
             'products derived from this software without specific prior written permission. ' + _AS_IS),
    Template("apache-2.0-header", 1.0, 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use '
             'this file except in compliance with the License. You may obtain a copy of the License at '
             '<<var;name="link";match="http|https">>://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable '
             'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
             'WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
             'language governing permissions and limitations under the License.'),
    Template("gpl-header", 1.0, 'This program is free software<<var;name="c";match="; you|: you">> can redistribute it and/or '
             'modify it under the terms of the GNU General Public License as published by the Free Software Foundation'
             '<<beginOptional>>, either<<endOptional>> version <<var;name="n";match="2|3">> of the License<<beginOptional>>, '
             'or (at your option) any later version<<endOptional>>.'),
    Template("mpl-2.0-header", 1.0, 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If '
             'a copy of the MPL was not distributed with this file, You can obtain one at '
             '<<var;name="link";match="http|https">>://mozilla.org/MPL/2.0/.'),
)
TEMPLATES = BASE + PUBLIC


# ---------------------------------------------------------------- compiling

def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(_A_TO_Z))


_MARK = re.compile(r"<<\s*(beginOptional|endOptional|var)\b(.*?)>>", re.S)
_MATCH = re.compile(r'match\s*=\s*"(.*?)"', re.S)
_COUNTED = re.compile(r"\.\{(\d+),(\d+)\}")


def parse(markup: str) -> list:
    """Nested nodes: ("word", w), ("optional", nodes), ("any", least, most), ("either", [words, ...])."""
    root: list = []
    open_: list = [root]
    at = 0
    for mark in _MARK.finditer(markup):
        open_[-1] += [("word", w) for w in words_of(markup[at:mark.start()])]
        at = mark.end()
        if mark[1] == "beginOptional":
            node = ("optional", [])
            open_[-1].append(node)
            open_.append(node[1])
        elif mark[1] == "endOptional":
            if len(open_) == 1:
                raise ValueError("optional region ends before it begins")
            open_.pop()
        else:
            found = _MATCH.search(mark[2])
            if not found:
                raise ValueError(f"replaceable region without match: {mark[0]}")
            open_[-1].append(_replaceable(found[1]))
    if len(open_) > 1:
        raise ValueError("optional region never ends")
    root += [("word", w) for w in words_of(markup[at:])]
    return root


def _replaceable(match: str):
    counted = _COUNTED.fullmatch(match)
    if counted or match in (".*", ".+"):
        least, most = map(int, counted.groups()) if counted else (int(match == ".+"), LOOP)
        if least > most:
            raise ValueError(f"empty range {match}")
        return "any", least, most
    if re.search(r"[.*+?\[\](){}\\^$]", re.sub(r"(?<=\d)\.(?=\d)", "", match)):
        raise ValueError(f"unknown match {match!r}")
    return "either", [words_of(part) for part in match.split("|")]


class Automaton:
    """Position automaton: `symbol[p]` is a word or None (any word), `loop[p]` how often position p may repeat."""

    def __init__(self, markup: str):
        self.symbol: list[str | None] = []
        self.loop: list[int] = []
        self.follow: list[set[int]] = []
        first, last, empty = self._sequence(parse(markup))
        if empty or not first:
            raise ValueError("a template needs mandatory words")
        if any(self.symbol[p] is None for p in first | last):
            raise ValueError("a template begins and ends with wording")
        self.first, self.last = first, last

    def _position(self, symbol, loop=1):
        self.symbol.append(symbol)
        self.loop.append(loop)
        self.follow.append(set())
        p = {len(self.symbol) - 1}
        return p, p, False

    def _sequence(self, nodes):
        first, last, empty = set(), set(), True
        for node in nodes:
            f, e, none = self._node(node)
            for p in last:
                self.follow[p] |= f
            first = first | f if empty else first
            last = last | e if none else e
            empty = empty and none
        return first, last, empty

    def _node(self, node):
        if node[0] == "word":
            return self._position(node[1])
        if node[0] == "optional":
            first, last, _ = self._sequence(node[1])
            return first, last, True
        if node[0] == "either":
            parts = [self._sequence([("word", w) for w in words]) for words in node[1]]
            return set().union(*[p[0] for p in parts]), set().union(*[p[1] for p in parts]), any(p[2] for p in parts)
        _, least, most = node
        first, last, empty = self._sequence([("word", None)] * least)
        if most > least:
            p, _, _ = self._position(None, most - least)
            for q in last:
                self.follow[q] |= p
            first, last = (first | p if empty else first), last | p
        return first, last, empty

    def starts(self) -> set[tuple]:
        """(first word, second word) of all accepted texts; None stands for any word or for none."""
        return {(self.symbol[p], self.symbol[q]) for p in self.first for q in self.follow[p]} | {
            (self.symbol[p], None) for p in self.first & self.last}

    def longest(self, words, at: int, end: int) -> int:
        """End of the longest accepted part that begins at word `at`, or -1. `words` may be codes or texts."""
        states, found = {}, -1
        symbol, loop, follow = self.symbol, self.loop, self.follow
        for p in self.first:
            if symbol[p] == words[at]:
                states[p] = 1
        while states:
            if not self.last.isdisjoint(states):
                found = at + 1
            at += 1
            if at == end:
                break
            now, after = words[at], {}
            for p, n in states.items():
                for q in follow[p]:
                    if symbol[q] is None or symbol[q] == now:
                        after[q] = 1
                if n < loop[p]:
                    after[p] = min(after.get(p, n + 1), n + 1)
            states = after
        return found

    def coded(self, codes: dict[str, int]) -> Automaton:
        """The same automaton over word codes."""
        other = object.__new__(Automaton)
        other.symbol = [None if s is None else codes[s] for s in self.symbol]
        other.loop, other.follow, other.first, other.last = self.loop, self.follow, self.first, self.last
        return other


class Scanner:
    """All templates over coded words of Arrow slices."""

    def __init__(self, templates):
        self.plain = [Automaton(t.markup) for t in templates]
        known = sorted({s for a in self.plain for s in a.symbol if s is not None})
        codes = {w: k for k, w in enumerate(known)}
        raw = [w.encode() for w in known]
        starts = np.cumsum([0, *map(len, raw)])[:-1]
        hashes = segment_hashes(np.frombuffer(b"".join(raw), np.uint8), starts)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.automata = [a.coded(codes) for a in self.plain]
        n = len(known)
        self.pairs: dict[int, list[int]] = {}
        for k, a in enumerate(self.automata):
            for one, two in a.starts():
                # Column n stands for any second word.
                self.pairs.setdefault(one * (n + 1) + (n if two is None else two), []).append(k)
        self.n, self.pair_codes = n, np.array(sorted(self.pairs), np.int64)

    def codes(self, words: Words) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, words.hash), self.n - 1)
        return np.where(self.hashes[at] == words.hash, self.order[at], -1)

    def places(self, data: np.ndarray, offsets: np.ndarray):
        """(words per row, rows, template numbers, first words, ends): places in order of row and first word."""
        words = Words(data, offsets, BLANK)
        none = np.zeros(0, np.int64)
        if not len(words.start):
            return words.count, none, none, none, none
        codes = self.codes(words)
        after = np.append(codes[1:], -1)
        last = np.append(words.row[1:] != words.row[:-1], True)
        after[last] = -1
        base = codes * (self.n + 1)
        hits = (codes >= 0) & (np.isin(base + self.n, self.pair_codes)
                               | ((after >= 0) & np.isin(base + after, self.pair_codes)))
        begin = np.concatenate([[0], np.cumsum(words.count)])
        found = []
        for i in np.flatnonzero(hits).tolist():
            row = int(words.row[i])
            end = int(begin[row + 1])
            numbers = {*self.pairs.get(int(base[i]) + self.n, ()), *self.pairs.get(int(base[i] + after[i]), ())}
            for k in sorted(numbers):
                stop = self.automata[k].longest(codes, i, end)
                if stop > 0 and self._same(data, offsets, words, k, i, stop):
                    found.append((row, k, i - int(begin[row]), stop - int(begin[row])))
        rows = np.array(found, np.int64).reshape(-1, 4)
        return words.count, rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3]

    def _same(self, data, offsets, words, k, i, stop):
        """Whether the words that were met by their hashes are the template's words."""
        row_end = int(offsets[words.row[i] + 1])
        end = int(words.start[stop]) if stop < len(words.start) and words.start[stop] < row_end else row_end
        part = words_of(data[int(words.start[i]):end].tobytes().decode())
        return self.plain[k].longest(part, 0, len(part)) == stop - i


@lru_cache(maxsize=4)
def _scanner(templates) -> Scanner:
    return Scanner(templates)


# ---------------------------------------------------------------- Spark side

_PLACE = T.StructType([T.StructField("template", T.IntegerType()), T.StructField("first_word", T.LongType()),
                       T.StructField("end_word", T.LongType())])


def places(docs: DataFrame, templates=TEMPLATES, keep=("doc_id",), text="text") -> DataFrame:
    """One row per document: kept columns, n_words, places (template number, first word, end; by first word)."""
    templates = tuple(templates)
    outputs = ("n_words", "places")
    names = [c for c in keep if c.lower() not in outputs]
    rows = docs.select(F.struct(*names).alias("kept"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["kept"], T.StructField("n_words", T.LongType()),
                           T.StructField("places", T.ArrayType(_PLACE))])

    def run(batches):
        scanner = _scanner(templates)
        kind = pa.struct([("template", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64())])
        for batch in batches:
            for row, data, offsets in slices(batch):
                n, at, number, first, end = scanner.places(LOWER[data], offsets)
                bounds = np.searchsorted(at, np.arange(len(n) + 1))
                found = pa.StructArray.from_arrays(
                    [pa.array(number, pa.int32()), pa.array(first), pa.array(end)], fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("kept").slice(row, len(n)), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), found)], ["kept", "n_words", "places"])

    return rows.mapInArrow(run, schema).select("kept.*", *outputs)


def _of(templates, field, default):
    """Column function: a template's field by its number, as a literal lookup."""
    table = F.array(*[F.lit(getattr(t, field)) for t in templates]) if templates else F.array(F.lit(default))
    return lambda number: F.element_at(table, number + 1)


def passages(docs: DataFrame, templates=TEMPLATES, keep=("doc_id",), text="text") -> DataFrame:
    """One row per place: kept columns, label, base, weight, first_word and end_word (exclusive)."""
    templates = tuple(templates)
    found = places(docs, templates, keep, text).drop("n_words").withColumn("__place", F.explode("places"))
    number = F.col("__place.template")
    return found.drop("places", "label", "base", "weight", "first_word", "end_word").select(
        *[c for c in found.columns if c not in ("places", "__place", "label", "base", "weight", "first_word", "end_word")],
        _of(templates, "label", "")(number).alias("label"), _of(templates, "base", False)(number).alias("base"),
        _of(templates, "weight", 0.0)(number).alias("weight"), "__place.first_word", "__place.end_word")


def report(docs: DataFrame, templates=TEMPLATES, keep=("doc_id",), text="text") -> DataFrame:
    """Per document: n_words, places of base phrases, their first and last word, labels, and the best weight."""
    templates = tuple(templates)
    outputs = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    keep = [c for c in keep if c.lower() not in outputs and c.lower() != "places"]
    found = places(docs, templates, keep, text)
    label, base, weight = _of(templates, "label", ""), _of(templates, "base", False), _of(templates, "weight", 0.0)
    starts = F.transform(F.filter("places", lambda p: base(p["template"])), lambda p: p["first_word"])

    def joined(part):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(part, lambda p: label(p["template"])))), ",")

    return found.select(
        *keep, "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.filter("places", lambda p: base(p["template"]))).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: weight(p["template"]))), F.lit(0.0)).alias("score"))


# ---------------------------------------------------------------- the same as SQL

def as_regex(nodes) -> str:
    """Regular expression of parsed nodes over text in which every word has a blank on both sides."""
    out = []
    for node in nodes:
        if node[0] == "word":
            out.append(f" {node[1]} ")
        elif node[0] == "optional":
            out.append(f"(?:{as_regex(node[1])})?")
        elif node[0] == "either":
            out.append("(?:" + "|".join("".join(f" {w} " for w in words) for words in node[1]) + ")")
        else:
            out.append(f"(?: [^ ]+ ){{{node[1]},{node[2]}}}")
    return "".join(out)


def oracle(templates=TEMPLATES) -> str:
    """DuckDB SQL for `report` over documents."""
    def starts(t):
        return " and ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(words_of(t.markup)))

    upper = "".join(map(chr, range(0x41, 0x5B)))
    base = [t for t in templates if t.base]
    hit = [f"regexp_matches(flat, '{as_regex(parse(t.markup))}')" for t in templates]

    def labels(rows):
        cases = ", ".join(f"case when {h} then '{t.label}' end" for h, t in rows)
        return f"array_to_string(list_sort(list_distinct(list_filter([{cases}], lambda x: x is not null))), ',')"

    both = list(zip(hit, templates))
    return rf"""
with lowered as (select doc_id, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') as body from documents),
listed as (select doc_id, regexp_extract_all(body, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from lowered),
flat as (select doc_id, w, coalesce(array_to_string(list_transform(w, lambda x: ' ' || x || ' '), ''), '') as flat,
    list_filter(range(1, len(w) + 1), lambda i: {' or '.join(f'({starts(t)})' for t in base)}) as s from listed)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(s) as bigint) as n_base,
    cast(list_min(s) - 1 as bigint) as first_word, cast(list_max(s) - 1 as bigint) as last_word,
    {labels([b for b in both if b[1].base])} as base_labels, {labels(both)} as labels,
    cast(greatest({', '.join(f'case when {h} then {t.weight} else 0 end' for h, t in both)}) as double) as score
from flat"""
