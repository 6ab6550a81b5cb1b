"""License scans: fixed phrases, and templates with optional and replaceable wording.

Templates are written in markup: `<<opt>>` ... `<<end>>` around wording that can be left out
(it nests), and `<<var:N>>` for up to N words of any wording. Each is compiled to an
automaton over word hashes; a text has a template's label if its mandatory wording stands
somewhere in the text exactly, with any choice of optional parts. Only places whose word can
begin a template are tried, and an automaton's states are bounded by its template.

Words are runs of digits, ASCII letters in lower case and non-ASCII characters. Score is the
largest share of a template's mandatory words that matched in a row from its beginning, 1
where it is accepted, and at least 0.5 where a fixed phrase was found.

Defined cases: null and empty texts have no word, no label, score 0 and null places; very
long texts count whole; a phrase that stands twice counts twice; repeated rows get equal
answers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm import _text as X

#: Fixed phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_AS_IS = "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_UNDER = ("released", "licensed", "distributed")


def _mit(noninfringement: str) -> str:
    return f"""permission is hereby granted free of charge to any person obtaining a copy of this software
        and associated documentation files the software to deal in the software without restriction including without
        limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
        and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice <<opt>>including the next paragraph<<end>> shall be included in all copies or
        substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and {noninfringement} in no event shall <<var:8>>
        be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from
        out of or in connection with the software or the use or other dealings in the software"""


def _bsd(third: str) -> str:
    return f"""redistribution and use in source and binary forms with or without modification are permitted
        provided that the following conditions are met
        <<var:1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        <<var:1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
        disclaimer in the documentation and or other materials provided with the distribution {third}
        this software is provided by <<var:12>> as is and any express or implied warranties including but not limited to the
        implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var:12>> {_AS_IS}"""


def _apache(granted: str) -> str:
    return f"""{granted} under the apache license version 2 0 the license you may not use <<var:4>> except in
        compliance with the license you may obtain a copy of the license at <<var:1>> www apache org licenses license 2 0
        unless required by applicable law or agreed to in writing software distributed under the license is distributed on an
        as is basis without warranties or conditions of any kind either express or implied see the license for the specific
        language governing permissions and limitations under the license"""


def _gpl_notices(version: int) -> tuple[str, ...]:
    by, gpl = "as published by the free software foundation", "gnu general public license"
    return (
        *(f"{verb} under the <<opt>>terms of the<<end>> {gpl} <<opt>>{by} <<opt>>either<<end>><<end>> {v}" for verb in _UNDER for v in (f"version {version}", f"v{version}")),
        *(f"{verb} under <<opt>>the terms of<<end>> version {version} of the {gpl}" for verb in _UNDER),
        f"modify it under the terms of the {gpl} {by} <<opt>>either<<end>> version {version}",
        f"modify it under the terms of the {gpl} version {version} <<opt>>only<<end>> {by}",
        f"modify it under the terms of version {version} of the {gpl} {by}",
    )


def _gpl_header(version: int) -> str:
    return f"""free software you can redistribute it and or modify it under the terms of the gnu general public license
        as published by the free software foundation <<opt>>either<<end>> version {version} of the license <<opt>>or at your option any later version<<end>>
        <<var:8>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
        merchantability or fitness for a particular purpose see the gnu general public license for more details
        you should have received a copy of the gnu general public license along with <<var:8>> if not
        <<opt>>see <<var:1>> www gnu org licenses<<end>> <<opt>>write to the free software foundation<<end>>"""


#: The six licences of Creative Commons: the mark, and the words of its name.
_CC = {
    "by": ("attribution",), "by-sa": ("attribution sharealike", "attribution share alike"), "by-nd": ("attribution noderivatives", "attribution noderivs", "attribution no derivatives"),
    "by-nc": ("attribution noncommercial", "attribution non commercial"), "by-nc-sa": ("attribution noncommercial sharealike", "attribution non commercial share alike"),
    "by-nc-nd": ("attribution noncommercial noderivatives", "attribution noncommercial noderivs", "attribution non commercial no derivatives"),
}


def _cc_notices(mark: str, names: tuple[str, ...]) -> tuple[str, ...]:
    begins = "licensed under <<opt>>a<<end>> <<opt>>the<<end>> <<opt>>a rel license href <<var:10>><<end>>"
    return (f"{begins} <<opt>>creative commons<<end>> cc {mark.replace('-', ' ')} 4 0", *(f"{begins} creative commons {n} <<opt>>cc {mark.replace('-', ' ')}<<end>> 4 0" for n in names))


#: Published wordings of licences and notices, and the labels they give; a label can have
#: several alternatives. `-text` and `-header` have the whole mandatory wording of the licence
#: and of the notice for source files; `-notice` is the sentence that names the licence.
TEMPLATES: dict[str, str | tuple[str, ...]] = {
    "mit-notice": tuple(f"{verb} under <<opt>>the<<end>> <<opt>>terms of the<<end>> mit license" for verb in _UNDER),
    "mit-text": (_mit("noninfringement"), _mit("non infringement")),
    "apache-2.0-notice": tuple(f"{verb} under the <<opt>>terms of the<<end>> apache license <<opt>>version<<end>> 2 0" for verb in (*_UNDER, "licenses <<var:4>> to you")),
    "apache-2.0-header": (_apache("licensed"), _apache("licenses <<var:4>> to you")),
    "gpl-3.0-notice": _gpl_notices(3),
    "gpl-2.0-notice": _gpl_notices(2),
    "gpl-3.0-header": _gpl_header(3),
    "gpl-2.0-header": _gpl_header(2),
    **{f"cc-{mark}-4.0-notice": _cc_notices(mark, names) for mark, names in _CC.items()},
    "bsd-2-clause-text": _bsd(""),
    "bsd-3-clause-text": _bsd("""<<var:1>> neither the name of <<var:12>> nor the names of <<var:4>> contributors may be used to endorse or
        promote products derived from this software without specific prior written permission"""),
    "isc-text": """permission to use copy modify and <<opt>>or<<end>> distribute this software for any purpose with or without fee
        is hereby granted provided that the above copyright notice and this permission notice appear in all copies
        the software is provided as is and <<var:6>> disclaims all warranties with regard to this software including all
        implied warranties of merchantability and fitness in no event shall <<var:8>> be liable for any special direct indirect or
        consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of
        contract negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    "copyright-notice": "copyright <<opt>>c<<end>> <<var:6>> all rights reserved",
}


class Automaton:
    """States of a template: edges by word hash, free steps, and loops of bounded length."""

    def __init__(self, markup: str):
        tokens = re.findall(r"<<[^>]*>>|[0-9a-z\x80-\U0010ffff]+", markup.lower())
        self.words: list[dict[int, set[int]]] = [{}]
        self.any: list[set[int]] = [set()]
        self.free: list[set[int]] = [set()]
        self.depth = [0]
        self.mandatory, at, opened = 0, 0, []
        for t in tokens:
            if t == "<<opt>>":
                opened.append(at)
            elif t == "<<end>>":
                self.free[opened.pop()].add(at)
            elif t.startswith("<<var:"):
                entry = at
                for _ in range(int(t[6:-2])):
                    new = self._new(self.depth[entry])
                    self.any[at].add(new)
                    at = new
                    self.free[entry].add(at)
            else:
                self.mandatory += not opened
                new = self._new(self.mandatory)
                self.words[at].setdefault(int(X.word_hash(t)[0]), set()).add(new)
                at = new
        if opened:
            raise ValueError("an optional part isn't closed")
        self.last = at
        self.ends = {s for s in range(len(self.words)) if at in self.close({s})}
        self.starts = {h for s in self.close({0}) for h in self.words[s]}

    def _new(self, depth: int) -> int:
        for x in (self.words, self.any, self.free):
            x.append(type(x[0])())
        self.depth.append(depth)
        return len(self.words) - 1

    def close(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def match(self, hashes: np.ndarray, at: int) -> float:
        """Share of mandatory words read in a row from this word on; 1 if accepted."""
        states, best = self.close({0}), 0
        for h in hashes[at:].tolist() if len(hashes) - at < 64 else map(int, hashes[at:]):
            new = set().union(*(self.any[s] for s in states), *(self.words[s].get(h, ()) for s in states))
            if not new:
                break
            states = self.close(new)
            best = max(best, max(self.depth[s] for s in new))
            if states & self.ends:
                return 1.0
        return min(best / max(self.mandatory, 1), 0.99)


class Scanner:
    def __init__(self, templates: dict[str, str | tuple[str, ...]], phrases: dict[str, str]):
        self.automata = [(label, Automaton(m)) for label, ms in templates.items() for m in ([ms] if isinstance(ms, str) else ms)]
        self.phrases = [(X.word_hash(*p.split()), label) for p, label in phrases.items()]
        starts: dict[int, list[tuple[str, Automaton]]] = {}
        for label, a in self.automata:
            for h in a.starts:
                starts.setdefault(h, []).append((label, a))
        self.by_start = starts
        self.start_hashes = np.array(sorted(starts), np.uint64)

    def scan(self, column) -> dict[str, np.ndarray | list]:
        t = X.text_of(column)
        m = len(t)
        out: dict = {"n_words": np.zeros(m, np.int64), "n_base": np.zeros(m, np.int64), "first_word": [None] * m, "last_word": [None] * m, "base": [set() for _ in range(m)], "own": [set() for _ in range(m)], "score": np.zeros(m)}
        for first, last, s in X.slices(t):
            data = X.lower(s.data)
            w = X.words_of(s, data, X.ALNUM_WORD[data])
            out["n_words"][first:last] = np.diff(w.first)
            owner = lambda at: np.searchsorted(w.first, at, "right") - 1  # noqa: E731, B023
            for hashes, label in self.phrases:
                n = len(hashes)
                if len(w.hashes) < n:
                    continue
                hit = w.hashes[: len(w.hashes) - n + 1] == hashes[0]
                for k in range(1, n):
                    hit &= w.hashes[k : len(w.hashes) - n + 1 + k] == hashes[k]
                at = np.flatnonzero(hit)
                at = at[owner(at) == owner(at + n - 1)]
                for p, i in zip(at.tolist(), owner(at).tolist()):
                    k, p = first + i, int(p - w.first[i])
                    out["n_base"][k] += 1
                    out["base"][k].add(label)
                    out["first_word"][k] = p if out["first_word"][k] is None else min(p, out["first_word"][k])
                    out["last_word"][k] = p if out["last_word"][k] is None else max(p, out["last_word"][k])
                    out["score"][k] = max(out["score"][k], 0.5)
            at = np.flatnonzero(np.isin(w.hashes, self.start_hashes))
            for p, i in zip(at.tolist(), owner(at).tolist()):
                k, own = first + i, w.hashes[w.first[i] : w.first[i + 1]]
                for label, automaton in self.by_start[int(w.hashes[p])]:
                    share = automaton.match(own, int(p - w.first[i]))
                    out["score"][k] = max(out["score"][k], share)
                    if share == 1.0:
                        out["own"][k].add(label)
        return out


@X.releases
def _scan(batches: Iterator[pa.RecordBatch], templates: dict[str, str | tuple[str, ...]], phrases: dict[str, str]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(templates, phrases)
    for batch in batches:
        r = scanner.scan(batch.column(1))
        base = [",".join(sorted(b)) for b in r["base"]]
        both = [",".join(sorted(b | o)) for b, o in zip(r["base"], r["own"])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(r["n_words"]), pa.array(r["n_base"]), pa.array(r["first_word"], pa.int64()), pa.array(r["last_word"], pa.int64()), pa.array(base, pa.string()), pa.array(both, pa.string()), pa.array(r["score"])], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def scan_licenses(docs: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs(doc_id, text)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = partial(_scan, templates=TEMPLATES if templates is None else templates, phrases=PHRASES if phrases is None else phrases)
    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
