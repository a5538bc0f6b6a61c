"""Operator 6: license scans by a positional rare-token index.

Templates (base phrases, notices and whole license texts) are indexed by word and position, each at its rarest positions:
a base phrase at one; a text at so many that a text that is verified must have some of them in place. Each occurrence at
file position p of a word at template position q votes for the template starting at p - q, so postings are intersected
by relative position; every occurrence in a file votes. Words may have come in or gone: votes within a tolerance of one
start, a tenth of the template, count together. A start with enough votes is verified: a base phrase needs every word
in place; a text needs its mandatory key phrases inside the span, and its score is the share of its words that stand
in order, none further out of place than the tolerance.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Words of whole license texts and notices.
_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _WARRANTY
_BSD_HEAD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
_BSD_TAIL = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
BSD_2 = _BSD_HEAD + _BSD_TAIL
BSD_3 = _BSD_HEAD + "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission " + _BSD_TAIL
ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
ZLIB = "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"
APACHE_NOTICE = "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
GPL_NOTICE = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program"
UNLICENSE = "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind"
# Label, opening or notice text, mandatory key phrases.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license version 2 0", "except in compliance"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["free software", "gnu general public license"]),
    ("gpl-3", "gnu general public license version 3", ["gnu general public license version 3"]),
    ("lgpl", "gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl", "gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc0", "creative commons zero v1 0 universal", ["creative commons zero"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "following conditions are met"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee", "hereby granted"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("mit", MIT, ["permission is hereby granted free of charge", "without restriction"]),
    ("bsd", BSD_2, ["redistribution and use in source and binary forms", "redistributions in binary form must reproduce"]),
    ("bsd-3", BSD_3, ["redistribution and use in source and binary forms", "neither the name of"]),
    ("isc", ISC, ["with or without fee", "hereby granted"]),
    ("zlib", ZLIB, ["provided as is without any express or implied warranty", "altered source versions must be plainly marked"]),
    ("apache", APACHE_NOTICE, ["licensed under the apache license", "limitations under the license"]),
    ("gpl", GPL_NOTICE, ["gnu general public license", "free software foundation"]),
    ("unlicense", UNLICENSE, ["unencumbered software", "public domain"]),
    ("epl", "made available under the terms of the eclipse public license", ["eclipse public license"]),
]
#: Share of a license text's words that must stand in order, and how far from their place: a share of the text, and words at least.
LEAST, DRIFT, DRIFT_WORDS = 0.6, 0.1, 2
#: Share of a text's words that must vote besides the first.
VOTES = 0.15
#: A-Z to a-z, other ASCII but digits and letters to a space; bytes over 127 belong to words.
_TABLE = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def license_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Template(NamedTuple):
    label: str
    words: list[bytes]
    keys: list[list[bytes]] | None
    need: int
    drift: int
    votes: int


class Index:
    """Postings of each template's rarest positions, by IDF over the templates."""

    def __init__(self, base: dict[str, str], templates: list[tuple[str, str, list[str]]]):
        self.entries = [Template(label, w := license_words(phrase), None, len(w), 0, 1) for phrase, label in base.items()]
        for label, text, keys in templates:
            words = license_words(text)
            need = next(k for k in range(len(words) + 1) if k / len(words) >= LEAST)
            drift = max(DRIFT_WORDS, int(len(words) * DRIFT))
            self.entries.append(Template(label, words, [license_words(k) for k in keys], need, drift, 1 + int(len(words) * VOTES)))
        df = Counter(w for entry in self.entries for w in set(entry.words))
        self.idf = {w: math.log((len(self.entries) + 1) / n) for w, n in df.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, (_, words, _, need, _, votes) in enumerate(self.entries):
            # a verified text misses len(words) - need words; of equal IDF, long words are rarer in files
            ranked = sorted(range(len(words)), key=lambda q: (-self.idf[words[q]], -len(words[q]), words[q], q))
            for q in ranked[: len(words) - need + votes]:
                self.postings.setdefault(words[q], []).append((t, q))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float]]:
        """Base places (start, label), and the best score of each label whose text is verified."""
        postings = self.postings
        votes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if w in postings:
                for t, q in postings[w]:
                    votes.setdefault(t, []).append(i - q)
        base, found = [], {}
        for t, starts in votes.items():
            label, template, keys, need, drift, least = self.entries[t]
            if keys is None:
                base += [(start, label) for start in starts if start >= 0 and words[start : start + len(template)] == template]
                continue
            starts.sort()
            near: dict[int, int] = {}  # starts with enough votes around, by the votes for just them
            for i in range(len(starts) - least + 1):
                low, high = starts[i], starts[i + least - 1]
                if high - low <= 2 * drift:
                    near.update(dict.fromkeys(range(high - drift, low + drift + 1), 0))
            for start in starts:
                if start in near:
                    near[start] += 1
            best = found.get(label, 0.0)
            for start in sorted(near, key=lambda s: -near[s]):
                if best == 1.0:
                    break
                span = words[max(start - drift, 0) : max(start + len(template) + drift, 0)]
                if all(_inside(k, span) for k in keys):
                    score = in_order(template, words, start, drift) / len(template)
                    best = max(best, score if score >= LEAST else 0.0)
            if best:
                found[label] = best
        return sorted(base), found


def in_order(template: list[bytes], words: list[bytes], start: int, drift: int) -> int:
    """The most words of the template that stand in order in words, each within drift of start plus its place."""
    width = 2 * drift + 1
    above = [0] * (width + 1)  # by place off the diagonal; the last is a border
    for q, w in enumerate(template):
        row, left, first = [0] * (width + 1), 0, start + q - drift
        for k in range(width):
            p = first + k
            left = max(left, above[k + 1])
            if 0 <= p < len(words) and words[p] == w and above[k] >= left:
                left = above[k] + 1
            row[k] = left
        row[width] = left
        above = row
    return above[width - 1]


def _inside(phrase: list[bytes], words: list[bytes]) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, templates: list | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text), see SCHEMA; other columns are ignored.

    A null or empty text has no words, no places, empty labels and score 0; a null doc_id stays null; repeated rows
    give equal rows, an empty table none. score: 1 where a base phrase stands, else the best verified text's share of
    words in order; equal scores need no choice, as all labels are told. One narrow pass over whole texts of any length.
    """
    index = Index(BASE if base is None else base, TEMPLATES if templates is None else templates)

    def scan(batches):
        for batch in batches:
            out = []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = license_words(text.as_py())
                places, found = index.scan(words)
                base_labels = {label for _, label in places}
                score = 1.0 if places else max(found.values(), default=0.0)
                ends = (places[0][0], places[-1][0]) if places else (None, None)
                out.append((id_, len(words), len(places), *ends, ",".join(sorted(base_labels)), ",".join(sorted(base_labels | found.keys())), score))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"]).mapInArrow(scan, SCHEMA)
