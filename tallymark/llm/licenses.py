"""License scans: known sentences become identifiers, and their sequence meets ordered rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices, in normal form (lower
# case, single spaces, no punctuation at the ends), and their identifiers.
SENTENCES = {
    # MIT
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions": "MITGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITNotice",
    "the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement": "MITWarranty",
    "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software": "MITLiability",
    "released under the mit license": "MITRef",
    "licensed under the mit license": "MITRef",
    "this project is licensed under the mit license": "MITRef",
    "distributed under the mit license": "MITRef",
    # ISC
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "ISCGrant",
    "the software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISCWarranty",
    "in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software": "ISCLiability",
    "licensed under the isc license": "ISCRef",
    # BSD
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "BSDGrant",
    "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "BSDBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDEndorse",
    "this software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSDWarranty",
    "licensed under the bsd license": "BSDRef",
    "use of this source code is governed by a bsd-style license that can be found in the license file": "BSDRef",
    # Apache
    "licensed under the apache license, version 2.0": "ApacheRef",
    "released under the apache license, version 2.0": "ApacheRef",
    "licensed under the apache license, version 2.0 (the \"license\")": "ApacheHead",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopy",
    "you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0": "ApacheCopy",
    "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied": "ApacheBasis",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    # GNU
    "this work is licensed under the gnu general public license, version 3": "GPL3Ref",
    "licensed under the gnu general public license, version 3": "GPL3Ref",
    "licensed under the gnu general public license, version 2": "GPL2Ref",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "GPL3Later",
    "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version": "GPL2Later",
    "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version": "LGPL21Later",
    "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose": "GPLWarranty",
    "see the gnu general public license for more details": "GPLSee",
    "you should have received a copy of the gnu general public license along with this program": "GPLCopy",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "AGPL3Later",
    "see the gnu affero general public license for more details": "AGPLSee",
    "you should have received a copy of the gnu affero general public license along with this program": "AGPLCopy",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "LGPL3Later",
    "this library is free software: you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "LGPL3Later",
    # zlib
    "this software is provided 'as-is', without any express or implied warranty": "ZlibWarranty",
    "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions": "ZlibGrant",
    "the origin of this software must not be misrepresented; you must not claim that you wrote the original software": "ZlibOrigin",
    "altered source versions must be plainly marked as such, and must not be misrepresented as being the original software": "ZlibAltered",
    "this notice may not be removed or altered from any source distribution": "ZlibNotice",
    # Unlicense
    "this is free and unencumbered software released into the public domain": "UnlicenseHead",
    "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means": "UnlicenseGrant",
    # Boost
    "boost software license - version 1.0 - august 17th, 2003": "BoostHead",
    "distributed under the boost software license, version 1.0": "BoostRef",
    "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"software\") to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following": "BoostGrant",
    # Eclipse
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/": "EPL2Terms",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0": "EPL2Terms",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html": "EPL1Terms",
    # Mozilla
    "this source code form is subject to the terms of the mozilla public license, v. 2.0": "MPLSubject",
    "if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/": "MPLCopy",
    "if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/": "MPLCopy",
    # Creative Commons
    "licensed under cc by-nc 4.0": "CCBYNC4Ref",
    "licensed under cc by-sa 4.0": "CCBYSA4Ref",
    "licensed under cc by 4.0": "CCBY4Ref",
    "licensed under cc by-nd 4.0": "CCBYND4Ref",
    "licensed under cc by-nc-sa 4.0": "CCBYNCSA4Ref",
    "licensed under cc by-nc-nd 4.0": "CCBYNCND4Ref",
    "this work is licensed under a creative commons attribution-noderivatives 4.0 international license": "CCBYND4Ref",
    "this work is licensed under a creative commons attribution-noncommercial-sharealike 4.0 international license": "CCBYNCSA4Ref",
    "this work is licensed under a creative commons attribution-noncommercial-noderivatives 4.0 international license": "CCBYNCND4Ref",
    "this work is licensed under a creative commons attribution 4.0 international license": "CCBY4Ref",
    "this work is licensed under a creative commons attribution-sharealike 4.0 international license": "CCBYSA4Ref",
    "this work is licensed under a creative commons attribution-noncommercial 4.0 international license": "CCBYNC4Ref",
    "this work is dedicated to the public domain under cc0 1.0 license": "CC0Ref",
}

# Sentences in which a holder is named: what stands before the name,
# a pattern of what follows, and the identifier.
HOLDER = (
    ("neither the name of ", r" nor the names? of (?:(?:its|their|the|any|other|his|her) )*contributors may be used to endorse or promote products derived from this software without specific(?:,)? prior written permission", "BSDEndorse"),
    ("neither the names of ", r" nor the names? of (?:(?:its|their|the|any|other|his|her) )*contributors may be used to endorse or promote products derived from this software without specific(?:,)? prior written permission", "BSDEndorse"),
    ("this software is provided by ", r" \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "BSDWarranty"),
    ("the software is provided \"as is\" and ", r" disclaims? all warranties with regard to this software,? including all implied warranties of merchantability and fitness", "ISCWarranty"),
    ("in no event shall ", r" be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software", "ISCLiability"),
    ("in no event shall ", r" be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software", "MITLiability"),
)

# Licences and the identifiers they are made of, the longer rule first.
RULES = (
    ("MIT", ("MITGrant", "MITNotice", "MITWarranty", "MITLiability")),
    ("MIT", ("MITGrant", "MITNotice", "MITWarranty")),
    ("MIT-variant", ("MITGrant", "MITNotice")),
    ("MIT", ("MITRef",)),
    ("ISC", ("ISCGrant", "ISCWarranty", "ISCLiability")),
    ("ISC", ("ISCRef",)),
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse", "BSDWarranty")),
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDWarranty")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary")),
    ("BSD", ("BSDRef",)),
    ("Apache-2.0", ("ApacheHead", "ApacheComply", "ApacheCopy", "ApacheBasis", "ApacheSee")),
    ("Apache-2.0", ("ApacheHead", "ApacheComply", "ApacheCopy")),
    ("Apache-2.0", ("ApacheHead",)),
    ("Apache-2.0", ("ApacheRef",)),
    ("AGPL-3.0-or-later", ("AGPL3Later", "GPLWarranty", "AGPLSee", "AGPLCopy")),
    ("AGPL-3.0-or-later", ("AGPL3Later",)),
    ("LGPL-3.0-or-later", ("LGPL3Later",)),
    ("GPL-3.0-or-later", ("GPL3Later", "GPLWarranty", "GPLSee", "GPLCopy")),
    ("GPL-3.0-or-later", ("GPL3Later",)),
    ("GPL-2.0-or-later", ("GPL2Later", "GPLWarranty", "GPLSee", "GPLCopy")),
    ("GPL-2.0-or-later", ("GPL2Later",)),
    ("LGPL-2.1-or-later", ("LGPL21Later",)),
    ("GPL-3.0-only", ("GPL3Ref",)),
    ("GPL-2.0-only", ("GPL2Ref",)),
    ("MPL-2.0", ("MPLSubject", "MPLCopy")),
    ("MPL-2.0", ("MPLSubject",)),
    ("Zlib", ("ZlibWarranty", "ZlibGrant", "ZlibOrigin", "ZlibAltered", "ZlibNotice")),
    ("Zlib", ("ZlibGrant", "ZlibOrigin", "ZlibAltered", "ZlibNotice")),
    ("Unlicense", ("UnlicenseHead", "UnlicenseGrant")),
    ("Unlicense", ("UnlicenseHead",)),
    ("BSL-1.0", ("BoostHead", "BoostGrant")),
    ("BSL-1.0", ("BoostGrant",)),
    ("BSL-1.0", ("BoostRef",)),
    ("EPL-2.0", ("EPL2Terms",)),
    ("EPL-1.0", ("EPL1Terms",)),
    ("CC-BY-NC-SA-4.0", ("CCBYNCSA4Ref",)),
    ("CC-BY-NC-ND-4.0", ("CCBYNCND4Ref",)),
    ("CC-BY-ND-4.0", ("CCBYND4Ref",)),
    ("CC-BY-NC-4.0", ("CCBYNC4Ref",)),
    ("CC-BY-SA-4.0", ("CCBYSA4Ref",)),
    ("CC-BY-4.0", ("CCBY4Ref",)),
    ("CC0-1.0", ("CC0Ref",)),
)

#: One of these is in every known sentence and tag, within a word, so texts without one have none.
ANCHORS = ("license", "permission", "warrant", "liable", "redistribut", "mpl", "endorse", "misrepresented", "altered", "unencumbered", "binary")
_ANCHOR = re.compile("|".join(ANCHORS))
_MARKS = re.compile(r"""^(?:[\s#*/%;>|!-]|<!--|<%--|\(\*|\{[-#*]|\"{3}|'{3}|'(?=\s)|@?rem\s|dnl\s)+""", re.IGNORECASE)
#: Marks that close a comment end a piece wherever they stand; others only at the end of a line.
_CLOSED = re.compile(r"""\*+/|-+->|-+%>|\*+\)|[-#*]\}|\"{3}|'{3}|\s[#*|]+\s*$""")
_ITEM = re.compile(r"^(?:\d+\.|\([a-z\d]\)|[-*])\s+")
_SPACE = re.compile(r"\s+")
#: Sentences may end here; a known sentence that goes on is followed over it.
_SENTENCE = re.compile(r"(?<=[.!?;:])(?<!(?i:identifier:))\s+(?=\S)")
_ENDS = " .,:;!?"
_TAG = "spdx-license-identifier:"
_TOKEN = re.compile(r"[()]|[^\s()]+")


def normal(sentence: str) -> str:
    """Lower case, single spaces, plain quotes, no list marks, no punctuation at the ends."""
    plain = sentence.replace("“", '"').replace("”", '"').replace("''", '"').replace("``", '"')
    plain = _SPACE.sub(" ", plain.lower()).strip()
    return _ITEM.sub("", plain).strip(_ENDS)


@dataclass(frozen=True)
class Found:
    """Identifiers of a text in order, licences by rule, and identifiers no rule took."""

    identifiers: list[str]
    licenses: list[str]
    unmatched: list[str]


class Expression:
    """An SPDX expression, read token by token: licences and exceptions in order."""

    def __init__(self) -> None:
        self.found: list[str] = []
        self.depth, self.operand = 0, True  # operand: a licence or an opening bracket comes next
        self.after_with = self.ended_with = self.bare = False

    def take(self, token: str) -> bool:
        """Whether the expression can go on with ``token``."""
        if self.operand and token == "(" and not self.after_with:
            self.depth += 1
        elif self.operand and token not in ("(", ")", "and", "or", "with"):
            self.found.append(f"SPDX:{token.upper()}")
            self.operand, self.after_with, self.ended_with, self.bare = False, False, self.after_with, True
        elif not self.operand and token == ")" and self.depth:
            self.depth, self.bare = self.depth - 1, False
        elif not self.operand and token in ("and", "or"):
            self.operand = True
        elif not self.operand and token == "with" and self.bare and not self.ended_with:
            self.operand = self.after_with = True
        else:
            return False
        return True

    @property
    def whole(self) -> bool:
        """Whether it may end here."""
        return bool(self.found) and not self.depth and not self.operand


@dataclass
class Words:
    """Words of a text in normal form, where pieces and paragraphs start, and the words that end pieces."""

    words: list[str]
    starts: list[int]
    paragraphs: list[int]  # of each start
    ends: set[int]


def split_words(text: str) -> Words:
    """Words of all pieces: text between line ends, comment marks, and ends of sentences."""
    out = Words([], [], [], set())
    paragraph = 0
    for line in text.split("\n"):
        blank = True
        for part in _CLOSED.split(line):
            bare = _MARKS.sub("", part).strip()
            for piece in _SENTENCE.split(bare) if bare else ():
                plain = piece.replace("“", '"').replace("”", '"').replace("''", '"').replace("``", '"').lower()
                words = _ITEM.sub("", _SPACE.sub(" ", plain).strip()).split(" ")
                blank = False
                out.starts.append(len(out.words))
                out.paragraphs.append(paragraph)
                out.words += words
                out.ends.add(len(out.words) - 1)
        paragraph += blank
    return out


def _trie(sentences: dict[str, str]) -> dict:
    """Known sentences word by word; the identifier stands under the empty word."""
    root: dict = {}
    for sentence, name in sentences.items():
        node = root
        for word in sentence.split(" "):
            node = node.setdefault(word, {})
        node[""] = name
    return root


_KNOWN = _trie(SENTENCES)
_HELD = [(start.strip().split(" "), re.compile(rest.strip()), name) for start, rest, name in HOLDER]


def known_sentence(text: Words, at: int) -> tuple[int, str] | None:
    """End and identifier of the longest known sentence that starts at a word and ends where a piece does."""
    node, best = _KNOWN, None
    for i in range(at, len(text.words)):
        word = text.words[i].lstrip(_ENDS) if i == at else text.words[i]
        if i in text.ends:
            last = node.get(word.rstrip(_ENDS))
            if last is not None and "" in last:
                best = i + 1, last[""]
        node = node.get(word)
        if node is None:
            break
    return best


def held_sentences(text: Words) -> dict[int, tuple[int, str]]:
    """By start: end and identifier of sentences of ``HOLDER``, whatever they put for the holder.

    A name lies between the words before it and the first that follow it, in one
    paragraph and before the next such beginning; so each word is looked at once
    per known sentence.
    """
    out: dict[int, tuple[int, str]] = {}
    stops = [*text.starts[1:], len(text.words)]
    last_of: dict[int, int] = dict(zip(text.paragraphs, stops))  # the end of each paragraph
    for first, rest, name in _HELD:
        begun = [(s, p) for s, p in zip(text.starts, text.paragraphs) if text.words[s : s + len(first)] == first]
        for n, (start, paragraph) in enumerate(begun):
            stop = last_of[paragraph]
            if n + 1 < len(begun):
                stop = min(stop, begun[n + 1][0])
            begin = start + len(first)
            if stop - begin < 2:
                continue
            flat = " ".join(text.words[begin:stop])
            offsets = {0: begin}
            where = 0
            for i in range(begin, stop):
                where += len(text.words[i]) + 1
                offsets[where] = i + 1
            for found in rest.finditer(flat):
                end = found.end() + len(flat[found.end() :]) - len(flat[found.end() :].lstrip(_ENDS[1:]))
                after = offsets.get(end + 1)
                if found.start() > 0 and found.start() in offsets and after is not None and after - 1 in text.ends:
                    if start not in out or out[start][0] < after:
                        out[start] = after, name
                    break
    return out


def tag(text: Words, at: int) -> tuple[int, list[str]] | None:
    """End and identifiers of an SPDX tag at a word; the longest whole expression that ends where a piece does."""
    if text.words[at] != _TAG and not text.words[at].startswith(_TAG):
        return None
    read, best = Expression(), None
    for i in range(at, len(text.words)):
        word = text.words[i].removeprefix(_TAG) if i == at else text.words[i]
        ending = i in text.ends
        tokens = _TOKEN.findall(word.rstrip(_ENDS) if ending else word)
        if not all(read.take(token) for token in tokens):
            break
        if ending and read.whole:
            best = i + 1, list(read.found)
        if ending and not read.depth:
            break  # only brackets go on over the end of a piece
    return best


def identify(text: str) -> list[str]:
    """Identifiers of the known sentences of a text, in order.

    Comment marks are left out. Any name may stand for the holder in the sentences
    of ``HOLDER``. An SPDX tag gives an identifier for each licence and exception
    of its expression (AND, OR, WITH, brackets, which may run over lines).

    Text is cut at line ends and where sentences may end. From the start of each piece
    its words are followed in a trie of the known sentences, over as many
    pieces as these have words for; the longest that ends where a piece does
    counts, however the text is wrapped.
    """
    if not _ANCHOR.search(text.lower()):
        return []
    split = split_words(text)
    held = held_sentences(split)
    found: list[str] = []
    free = 0
    for at in split.starts:
        if at < free:
            continue
        sentence, named = known_sentence(split, at), held.get(at)
        if named and (sentence is None or named[0] > sentence[0]):
            sentence = named
        if sentence:
            free = sentence[0]
            found.append(sentence[1])
        elif spdx := tag(split, at):
            free = spdx[0]
            found += spdx[1]
    return found


def match(identifiers: list[str]) -> Found:
    """Apply the rules in order, each to every place where its whole sequence stands."""
    hits: list[tuple[int, str]] = [(i, name[5:]) for i, name in enumerate(identifiers) if name.startswith("SPDX:")]
    left: list[str | None] = [None if name.startswith("SPDX:") else name for name in identifiers]
    for license_name, sequence in RULES:
        for at in range(len(left) - len(sequence) + 1):
            if tuple(left[at : at + len(sequence)]) == sequence:
                hits.append((at, license_name))
                left[at : at + len(sequence)] = [None] * len(sequence)
    return Found(identifiers, [name for _, name in sorted(hits)], [name for name in left if name])


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Licences of every document, from whole texts.

    Sentences in normal form are looked up among known licence sentences, and the
    sequence of their identifiers is matched by rules, longer ones first; what no
    rule takes is told apart. A pure projection: nothing is shuffled.

    Returns ``row`` (struct of all input columns), ``identifiers``, ``licenses``
    (in the order they stand, repeats included), ``unmatched``; all arrays of
    strings, empty for a null or empty text or one without known sentences.
    Repeated rows get equal results. An empty table gives an empty result.
    """
    kind = "identifiers array<string>, licenses array<string>, unmatched array<string>"

    @F.pandas_udf(kind)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in texts:
            found = [match(identify(t)) for t in text]
            yield pd.DataFrame({n: [getattr(f, n) for f in found] for n in ("identifiers", "licenses", "unmatched")})

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), scan(text).alias("found"))
    return rows.select("row", "found.identifiers", "found.licenses", "found.unmatched")
