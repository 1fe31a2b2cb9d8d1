"""Classifiers, licences, mixing and vector operators against plain versions, and their edge cases."""

import math
import random
import re
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import ann, embedding_dedup, queries
from tallymark.llm.ann import MultiIndex, Panel, fit_index, nearest
from tallymark.llm.embedding_dedup import filters_of, make_codes, near_vectors, unit
from tallymark.llm.labelled import training_texts
from tallymark.llm.licenses import ANCHORS, RULES, SENTENCES, identify, match, scan_licenses
from tallymark.llm.mixing import mix, plan_mixture
from tallymark.llm.quality import CHUNK, WIDTH, ByteNetwork, chunk_starts, score_quality
from tallymark.llm.toxicity import Letters, keep_harmless, letter_counts, score_toxicity
from workload.check import difference, duck

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, "you 1d10t, w o r t h l e s s stuff\nlooooser", None, None, None),
    (4, "plain words here", "en", "b", 1),
    (4, "plain words here", "en", "b", 1),
    (None, "plain words here", "en", "b", 1),
    (5, "word " * 60_000, "en", "b", 1),
    (6, "Привет, Straße! \U0001f600\n" * 3, "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    names = ("row", "id", "of", "score", "held_out", "judged", "source_", "key", "block", "plan", "text2", "label")
    return spark.createDataFrame(ODD, SCHEMA).select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="module")
def odd_labels(spark):
    rows = [(1, 1, 0), (2, 0, 0), (3, 0, 1), (4, 1, None), (None, 1, 1), (5, None, 0), (6, 1, 0), (6, 1, 1)]
    return spark.createDataFrame(rows, LABELS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)


# Mixing


@pytest.mark.parametrize("sf", [SF, MORE])
def test_mixing_matches_sql(spark, sf):
    assert difference(spark, duck(sf), sf, queries.QUERIES["op3_mixing"], queries.ORACLE["op3_mixing"]) == ""


@pytest.fixture(scope="module")
def skewed(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), "big" if i % 10 else f"s{i % 3}") for i in range(2000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mixing_meets_the_repetition_limit(skewed):
    mixture = plan_mixture(skewed, max_repeats=1.5)
    plan = {r["source"]: r for r in mixture.plan.collect()}
    assert 0 < mixture.exponent < 1
    assert max(r["passes"] for r in plan.values()) == pytest.approx(1.5, abs=1e-6)
    assert plan["big"]["passes"] == 1.0 and sum(r["weight"] for r in plan.values()) == pytest.approx(1)
    drawn = mixture.draws(mixture.sizes, F.col("id"), F.col("source")).collect()
    seen, tokens = Counter(), defaultdict(int)
    for r in drawn:
        seen[r["row"]["id"]] += 1
        tokens[r["row"]["source"]] += r["row"]["tokens"]
        assert 0 <= r["place"] <= 1
    assert set(seen) == set(range(2000)) and max(seen.values()) == 2
    for name, r in plan.items():
        assert r["budget"] - 7 < tokens[name] <= r["budget"]
    total = sum(tokens.values())
    assert all(abs(tokens[n] / total - r["weight"]) < 0.002 for n, r in plan.items())
    # Any stretch of the mixture has the target weights.
    half = [r for r in drawn if r["place"] < 0.5]
    share = sum(r["row"]["tokens"] for r in half if r["row"]["source"] == "big") / sum(r["row"]["tokens"] for r in half)
    assert abs(share - plan["big"]["weight"]) < 0.03


def test_mixing_meets_the_entropy_and_budget(skewed):
    mixture = plan_mixture(skewed, max_repeats=None, target_entropy=0.6, budget=3000)
    weights = [r["weight"] for r in mixture.plan.collect()]
    assert -sum(w * math.log(w) for w in weights) == pytest.approx(0.6 * math.log(len(weights)), abs=1e-6)
    drawn = mixture.draws(mixture.sizes, F.col("id"), F.col("source"))
    total = drawn.agg(F.sum("row.tokens")).first()[0]
    assert 3000 - 7 * len(weights) <= total <= 3000 + len(weights)


def test_mixing_odd_rows(odd, empty):
    mixed = mix(odd, max_repeats=3.0)
    assert mixed.columns == odd.columns
    found = Counter(r["doc_id"] for r in mixed.collect())
    assert set(found) == {r[0] for r in ODD} and found[4] >= 2
    assert mix(empty).collect() == []
    with pytest.raises(ValueError):
        plan_mixture(odd, max_repeats=None)


# Licences

MIT = """# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the “Software”), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
# copies of the Software, and to permit persons to whom the Software is
# furnished to do so, subject to the following conditions:
#
# The above copyright notice and this permission notice shall be included in all
# copies or substantial portions of the Software.
"""


def test_license_sentences_and_rules():
    found = match(identify(f"some words\n{MIT}More words. Licensed under CC BY-NC 4.0.\nReleased under the\n MIT License.\n"))
    assert found.identifiers == ["MITGrant", "MITNotice", "CCBYNC4Ref", "MITRef"]
    assert found.licenses == ["MIT-variant", "CC-BY-NC-4.0", "MIT"] and found.unmatched == []
    assert match(["MITGrant", "MITNotice", "MITWarranty", "MITLiability"]).licenses == ["MIT"]
    assert match(["MITNotice", "MITGrant"]).unmatched == ["MITNotice", "MITGrant"]
    assert identify("// SPDX-License-Identifier: Apache-2.0") == ["SPDX:APACHE-2.0"]
    assert identify("A license to write about warranties.") == []
    assert all(any(a in s for a in ANCHORS) for s in SENTENCES)


def test_closing_marks_and_spdx_expressions():
    for line in ("/* SPDX-License-Identifier: GPL-2.0 */", "<!-- SPDX-License-Identifier: GPL-2.0 -->", "/* SPDX-License-Identifier: GPL-2.0 */ int x;", "# SPDX-License-Identifier: (GPL-2.0) #"):
        assert identify(line) == ["SPDX:GPL-2.0"]
    assert identify("/* Released under the MIT License. */\n/* See more. */") == ["MITRef"]
    assert identify("// SPDX-License-Identifier: MIT OR Apache-2.0") == ["SPDX:MIT", "SPDX:APACHE-2.0"]
    whole = ["SPDX:GPL-2.0-ONLY", "SPDX:LINUX-SYSCALL-NOTE", "SPDX:BSD-3-CLAUSE", "SPDX:MIT"]
    assert identify("/* SPDX-License-Identifier: ((GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause) AND MIT */") == whole
    assert identify("# SPDX-License-Identifier: ((GPL-2.0-only WITH Linux-syscall-note)\n#   OR BSD-3-Clause) AND MIT") == whole
    assert identify("SPDX-License-Identifier: MIT OR") == identify("SPDX-License-Identifier: goes on top of files") == []
    assert identify("you can obtain one at\nIf a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.") == ["MPLCopy"]


def test_named_holders():
    start = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 *   1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
 *   2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
    end = """
 * THIS SOFTWARE IS PROVIDED BY {} ``AS IS'' AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
 * IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {} BE LIABLE FOR ANY DIRECT DAMAGES. */"""
    for holder in ("Google Inc.", "the University of California, Berkeley", "the copyright holder", "Foo Ltd. and Bar Co."):
        clause = f"\n *   3. Neither the name of {holder} nor the names of its\n * contributors may be used to endorse or promote products derived from this software without specific prior written permission."
        found = match(identify(start + clause + end.replace("{}", holder.upper())))
        assert found.licenses == ["BSD-3-Clause"] and found.unmatched == []
        assert found.identifiers[-2:] == ["BSDEndorse", "BSDWarranty"]
        assert match(identify(start + end.replace("{}", holder))).licenses == ["BSD-2-Clause"]
    isc = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND ISC DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL ISC BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
    assert match(identify(isc)).licenses == ["ISC"]


def plain_identify(text):
    """Every run of words at a line start or sentence end that is a known sentence, tried one by one; the longest."""
    words, starts, ends = [], [], set()
    for line in text.split("\n"):
        for piece in re.split(r"(?<=[.!?;:])\s+", re.sub(r"^[\s*#/]+", "", line).strip().lower()):
            if piece:
                starts.append(len(words))
                words += piece.split()
                ends.add(len(words))
    found, free = [], 0
    for start in starts:
        runs = [(end, SENTENCES.get(" ".join(words[start:end]).strip(" .,:;!?"))) for end in sorted(ends) if end > start]
        runs = [(end, name) for end, name in runs if name]
        if start >= free and runs:
            free, name = runs[-1]
            found.append(name)
    return found


KNOWN = {name: sentence for sentence, name in SENTENCES.items()}


@pytest.mark.parametrize("rule", RULES, ids=lambda rule: f"{rule[0]}-{len(rule[1])}")
def test_every_license_is_found_however_it_is_wrapped(rule):
    license_name, sequence = rule
    sentences = [KNOWN[name][0].upper() + KNOWN[name][1:] + "." for name in sequence]
    assert match(identify(" ".join(sentences))).licenses == [license_name]
    for width in (20, 24, 40, 80, 200):
        wrapped = [textwrap.wrap(s, width, break_long_words=False, break_on_hyphens=False) for s in sentences]
        text = "/*\n" + "\n *\n".join("\n".join(f" * {line}" for line in lines) for lines in wrapped) + "\n */\nint main;\n"
        found = match(identify(text))
        assert found.licenses == [license_name] and found.unmatched == []
        assert found.identifiers == plain_identify(text)


def test_licenses_without_caps():
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    assert identify(apache) == ["ApacheHead", "ApacheComply"] and match(identify(apache)).licenses == ["Apache-2.0"]
    name = "The Very Long Holder Inc. and Others, Ltd. " * 60
    clause = f"Neither the name of {name}nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    assert identify(clause) == identify("\n".join(textwrap.wrap(clause, 30))) == ["BSDEndorse"]
    # A name does not go on over a blank line, nor over another such beginning.
    assert identify(clause.replace("Others", "\n\nOthers", 1)) == []
    text = random.Random(4)
    sentences = [*SENTENCES, "some other words about a license", "no warranty here"]
    for _ in range(30):
        body = " ".join(text.choice(sentences) + text.choice([".", ";", "\n", ".\n\n"]) for _ in range(12))
        assert identify(body) == plain_identify(body)


@pytest.mark.parametrize("unit", ["neither the name of x ", "license ( ", "SPDX-License-Identifier: (a or ", "in no event shall\n", "permission is hereby granted, free of charge, to any person obtaining a copy of\n"])
def test_long_texts_take_linear_time(unit):
    started = time.perf_counter()
    identify(unit * (400_000 // len(unit)))
    assert time.perf_counter() - started < 3


def test_license_scan_of_all_documents(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op5_license_scan"](spark, MORE).collect()}
    lines = {
        "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    }
    docs = spark.read.parquet(f"{MORE}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for r in docs:
        expected = [lines[x] for x in r["text"].split("\n") if x in lines]
        assert rows[r["doc_id"]]["licenses"].split() == expected


def test_license_scan_odd_rows(odd, empty):
    rows = scan_licenses(odd).collect()
    assert len(rows) == len(ODD) and all(r["licenses"] == [] for r in rows)
    assert scan_licenses(empty).collect() == []


# Classifiers


def accuracy(rows, labels, name):
    held = [(r["predicted"], labels[r["doc_id"]][name]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    return sum(a == b for a, b in held) / len(held), held


@pytest.fixture(scope="module")
def large_labels(spark):
    return {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}


def test_quality_on_held_out_documents(spark, large_labels):
    rows = queries.QUERIES["op9_quality_classifier"](spark, "/root/testdata/sf0.1").collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == 10_000
    assert accuracy(rows, large_labels, "quality")[0] > 0.97


def test_toxicity_on_held_out_documents(spark, large_labels):
    rows = queries.QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1").collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == 10_000
    right, held = accuracy(rows, large_labels, "toxic")
    assert right > 0.97 and sum(a for a, b in held if not b) <= 3


def test_training_skips_held_out_rows(spark, odd, odd_labels):
    found = training_texts(odd, odd_labels, "toxic", 10).collect()
    expected = [i for i in (1, 2, 3, 5) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(found) == len(expected)
    assert training_texts(odd, odd_labels, "toxic", 1).count() <= 1


def test_stretched_spaced_and_split_words_are_read(spark):
    docs = spark.createDataFrame([(i, "you are an idiot and a stupid one, some text of the old day, what a good idea") for i in range(50)], "doc_id long, text string")
    letters = Letters(letter_counts(docs))
    for form in ("iiddiioott", "idioot", "i  d  i  o  t", "i/d/i/o/t", "i,d,i,o,t", "i. d. i. o. t", "id-iot", "i d i o t"):
        assert letters.restore(f"you are an {form.upper()}").split()[-1] == "idiot"
    assert letters.restore("a stu pid one").split() == ["a", "stupid", "one"]
    assert letters.restore("what a good idea") == "what a good idea"


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_classifiers_odd_rows(score, odd, odd_labels, no_labels, empty):
    for labels in (odd_labels, no_labels):
        rows = score(odd, labels).collect()
        assert sorted((r["row"]["doc_id"] for r in rows), key=repr) == sorted((r[0] for r in ODD), key=repr)
        assert all(0 <= r["score"] <= 1 for r in rows)
        scores = {r["row"]["doc_id"]: r["score"] for r in rows}
        assert scores[1] == scores[2] and scores[4] == scores[None]
    assert score(empty, odd_labels).collect() == []
    assert len(keep_harmless(odd, no_labels).columns) == len(odd.columns)


def test_deobfuscation(spark):
    letters = Letters(letter_counts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))
    told = letters.restore("You 1d10t and m0r0n, w o r t h l e s s l0$er! tr@sh stuuuuupid p4thet1c c.l.o.w.n in 2019 the$$$")
    assert told == "you idiot and moron, worthless loser! trash stupid pathetic clown in 2019 the$$$"


@pytest.fixture(scope="module")
def letters(spark):
    return Letters(letter_counts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))


def test_words_with_double_letters_stay(letters):
    assert letters.restore("A worthless book") == "a worthless book"


def cost_of(letters, symbols, extra):
    state, total = 0, extra
    for symbol in [*symbols, 0]:
        if symbol or state % 28:
            state = state * 28 + symbol
            total += float(letters.cost[state])
            state %= 28**3
    return total


def every_path(letters, span):
    paths = [((), "", 0.0)]
    for readings in letters.lattice(span):
        paths = [(s + symbols, t + text, e + extra) for s, t, e in paths for symbols, text, extra in readings]
    return paths


SPANS = ["1d10t", "w o r t h", "stu pid", "looooser", "l0$er!", "$$uu", "a..b,,c", "iiddiioott", "of the in", "é èè de", "11!!", "t r @ s h", "aaab bb a"]


@pytest.mark.parametrize("span", SPANS)
def test_viterbi_equals_all_paths(letters, span):
    costs = {}
    for symbols, text, extra in every_path(letters, span):
        costs[text] = min(costs.get(text, 1e9), cost_of(letters, symbols, extra))
    found = letters.decode(span)
    assert costs[found] == pytest.approx(min(costs.values()), abs=1e-4)


def test_rows_may_be_read_in_parts(letters):
    rng = np.random.default_rng(3)
    words = ["the", "of", "in", "a", "see", "idi", "ot", "st", "u", "p", "1", "id", "and", "to", "th", "hello", "$", "x"]
    for _ in range(300):
        row = " ".join(rng.choice([w for w in words if len(w) <= 3], rng.integers(2, 9)))
        if any(c.isalpha() for c in row) and len(row.split()) > 1:
            assert letters.restore(row) == letters.decode(row)
        text = "\n".join(" ".join(rng.choice(words, 6)) for _ in range(3))
        assert letters.restore(text) == "\n".join(letters.restore(line) for line in text.split("\n"))
    texts = ["w o r t h", "", "plain", "a b\nc d e", "stu pid\n"]
    assert letters.restore_all(texts) == [letters.restore(t) for t in texts]


@pytest.mark.parametrize("text", ["a" * 200_000, "!" * 200_000, "a" + "." * 100_000 + "b" + "," * 100_000 + "c", "$" * 100_000 + "a" * 100_000])
def test_long_runs_take_no_longer(letters, text):
    started = time.perf_counter()
    letters.restore(text)
    assert time.perf_counter() - started < 2


@pytest.mark.parametrize("unit", ["a.b", "ab ", "!a", "aab", "a b c\n"])
def test_long_spans_take_linear_time(letters, unit):
    def seconds(many):
        started = time.perf_counter()
        letters.restore(unit * many)
        return time.perf_counter() - started

    seconds(100)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.02)


def test_letter_counts_are_of_all_documents(spark, empty):
    docs = spark.createDataFrame([(1, "ab  ab!"), (2, None), (3, "é")], "doc_id long, text string")
    counts = letter_counts(docs.coalesce(1)).reshape((28,) * 4)
    assert counts[0, 0, 1, 2] + counts[0, 1, 2, 0] >= 2 and counts[1, 2, 0, 1] == 1
    assert letter_counts(empty).sum() == 0


def test_chunks_cover_whole_texts():
    for size in (WIDTH, CHUNK - 1, CHUNK, CHUNK + 1, 5_000, 40_000):
        starts = chunk_starts(size)
        windows = {w for a in starts for w in range(a, min(a + CHUNK, size) - WIDTH + 1)}
        assert windows == set(range(size - WIDTH + 1))


def test_chunk_logits_match_plain_convolution():
    network, rng = ByteNetwork(), np.random.default_rng(3)
    for size in (0, 3, WIDTH, 700, 40_000):
        text = rng.integers(0, 256, size, np.uint8).tobytes()
        raw = np.frombuffer(text.ljust(WIDTH, b"\0"), np.uint8)
        expected = []
        for a in chunk_starts(len(raw)):
            vectors = network.bytes[raw[a : a + CHUNK]]
            windows = np.lib.stride_tricks.sliding_window_view(vectors, WIDTH, axis=0)
            top = np.einsum("nvw,wvf->nf", windows, network.filters).max(axis=0)
            expected.append(np.maximum(top + network.bias, 0) @ network.out + network.out_bias[0])
        assert np.allclose(network.chunk_logits(network.tables(), text), expected, atol=1e-4)


# Vectors


def vectors_of(spark, rows):
    names = ("row", "cell", "part", "id", "rep", "of", "n", "vector")
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.select("*", *[F.lit("x").alias(n) for n in names])


NAN = float("nan")
ODD_VECTORS = [
    (1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 0.0], 1), (5, [1.0, NAN, 0.0], 1),
    (6, [float("inf"), 0.0, 0.0], 1), (7, [1.0, 0.0, 0.0], 1), (8, [1.0, 0.0, -0.0], 1), (9, [3.0, 0.0, 0.0], 1),
    (10, [1.0, 0.1, 0.0], 2), (11, [1.0, 0.1, 0.0], None), (12, [-1.0, 0.0, 0.0], 1), (13, [1.0, 0.0], 1),
    (14, [1e-30, 0.0, 1e-31], 1), (20, [0.9, 0.1, 0.0], 2), (40, [0.0, 0.0, 2.0], 2), (None, [1.0, 0.0, 0.0], 1),
    (7, [1.0, 0.0, 0.0], 1),
]


def plain_rows(rows, query, k):
    """Ranks, ids and scores of all rows but the one at position ``query``."""
    at = np.array(rows[query][1])
    scored = [(-float((np.array(v) * at).sum()), i) for n, (i, v, _) in enumerate(rows) if n != query and len(v) == len(at)]
    return [(rank + 1, i, -score) for rank, (score, i) in enumerate(sorted(scored)[:k])]


def test_nearest_odd_rows(spark):
    table = vectors_of(spark, ODD_VECTORS)
    rows = nearest(table, table.where("vec_id % 20 = 0")).collect()  # more than there are
    # Each of the two equal rows 7 is a row; number 13 is of another length.
    good = [(i, np.array(v, np.float32).astype(float), None) for i, v, _ in ODD_VECTORS if i in (7, 8, 9, 10, 11, 12, 14, 20, 40)]
    found = defaultdict(list)
    for r in rows:
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {20, 40}
    for query, got in found.items():
        at = next(n for n, (i, _, _) in enumerate(good) if i == query)
        assert sorted(got) == plain_rows(good, at, 20)
    assert nearest(table.limit(0), table.limit(0)).collect() == []


def test_nearest_counts_every_row_and_keeps_lengths_apart(spark):
    """Ids that repeat with equal and other vectors, and vectors of three lengths in one table."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).tolist(), 0) for i in range(150)]
    rows += [(i, rng.normal(size=4).tolist(), 0) for i in range(0, 60)] + [(40, rows[40][1], 0)] * 2 + [(33, rows[33][1], 0)] * 3
    rows += [(200 + i, rng.normal(size=3).tolist(), 0) for i in range(100)] + [(300, [1.0, 2.0], 0), (320, [3.0, 1.0], 0), (340, [1.0] * 7, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = defaultdict(list)
    for r in nearest(table, table.where("vec_id % 20 = 0"), k=250).collect():  # more than there are: all cells are seen
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    expected = defaultdict(list)
    for n, (i, _, _) in enumerate(rows):
        if i % 20 == 0:
            expected[i] += plain_rows(rows, n, 250)
    assert set(found) == {i for i in expected if expected[i]}
    for i, got in found.items():
        assert [(a, b) for a, b, _ in sorted(got)] == [(a, b) for a, b, _ in sorted(expected[i])]
        assert np.allclose([c for *_, c in sorted(got)], [c for *_, c in sorted(expected[i])], rtol=1e-12, atol=1e-12)
    with pytest.raises(ValueError, match="integers"):
        nearest(table.withColumn("vec_id", F.col("vec_id").cast("string")), table)


def test_one_odd_vector_changes_no_other_row(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label")
    before = {tuple(r) for r in nearest(table, table.where("vec_id % 20 = 0"), k=5).collect()}
    odd = spark.createDataFrame([(i, [1.0, 2.0, 3.0], 0) for i in range(-7, 0)], table.schema)
    both = table.union(odd)
    after = {tuple(r) for r in nearest(both, both.where("vec_id % 20 = 0 and vec_id >= 0"), k=5).collect()}
    assert after == before


def test_nearest_recall_and_ties(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    copies = table.where("vec_id < 60").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    table = table.unionByName(copies)
    kept = table.collect()
    ids, values = np.array([r["vec_id"] for r in kept]), np.array([r["embedding"] for r in kept], float)
    hits = total = 0
    found = defaultdict(dict)
    for r in nearest(table, table.where("vec_id % 20 = 0")).collect():
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    for at in np.flatnonzero(ids % 20 == 0):
        score = values @ values[at]
        score[at] = -np.inf
        best = np.lexsort((ids, -score.round(12)))[:20]
        got = [found[ids[at]][rank] for rank in range(1, 21)]
        assert all(a[1] > b[1] or (a[1] == b[1] and a[0] < b[0]) for a, b in zip(got, got[1:]))
        hits, total = hits + len({i for i, _ in got} & set(ids[best])), total + 20
    assert hits / total >= 0.9


def test_nearest_makes_no_row_per_query_and_cell(spark, monkeypatch):
    """Tables kept are no longer than the input, and blocks of any size give the same rows."""
    rng, sizes, cut = np.random.default_rng(4), [], ann.cut

    def recorded(df):
        done = cut(df)
        sizes.append(done.count())
        return done

    monkeypatch.setattr(ann, "cut", recorded)
    rows = [(i, rng.normal(size=8).tolist(), 0) for i in range(1_200)] + [(i, [0.5] * 8, 0) for i in range(2_000, 2_300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    asked = table.where("vec_id % 10 = 0")
    whole = sorted(map(tuple, nearest(table, asked, k=6).collect()))
    assert max(sizes) <= len(rows)  # 150 queries that see some 45 of 64 cells would be 7,000
    for name, value in (("FEW", 40), ("MANY", 60), ("QUERIES", 7)):
        monkeypatch.setattr(ann, name, value)
    assert sorted(map(tuple, nearest(table, asked, k=6).collect())) == whole
    assert len(whole) == 6 * 150


def test_a_panel_keeps_the_best_of_all_that_pass(monkeypatch):
    """Runs of any size, many equal vectors, and queries among the entries."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(ann, "TILE", 500)
    values = np.concatenate([rng.integers(-3, 4, (400, 5)).astype(float), np.ones((200, 5))])
    ids, owns, times = rng.permutation(600), values @ 7 ** np.arange(5).astype(np.int64), np.ones(600, np.int64)
    owns = owns.astype(np.int64)
    panel, asked = Panel(None, 9), np.arange(0, 600, 7)
    for part in np.array_split(asked, 3):
        panel.ask(ids[part], owns[part], np.full(len(part), -np.inf), values[part])
    for part in np.array_split(np.arange(600), 11):
        panel.meet(0, ids[part], owns[part], times[part], values[part])
    found = defaultdict(list)
    for batch in panel.best():
        for r in batch.to_pylist():
            found[r["query_id"]].append((-r["score"], r["vec_id"]))
    for at in asked:
        plain = sorted((-float(values[n] @ values[at]), int(ids[n])) for n in range(600) if n != at)
        assert found[ids[at]] == plain[:9]


def test_cells_are_traversed_in_order():
    rng = np.random.default_rng(1)
    index = fit_index(rng.normal(size=(500, 8)), 5, 100_000)
    query = rng.normal(size=8)
    order = list(index.traverse(query))
    sums = [(index.left @ query[:4])[c // len(index.right)] + (index.right @ query[4:])[c % len(index.right)] for c in order]
    assert sorted(order) == list(range(index.counts.size)) and sums == sorted(sums, reverse=True)
    assert isinstance(index, MultiIndex) and index.counts.sum() == 500


def plain_links(rows, least):
    good = [
        (i, np.array(v, np.float32).astype(float), label)
        for i, v, label in rows
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    links, parent = Counter(), {i: i for i, _, _ in rows if i is not None}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for a, (i, u, x) in enumerate(good):
        for j, v, y in good[a + 1 :]:
            if x == y and len(u) == len(v) and float(unit(u) @ unit(v)) >= least:
                links[i] += 1
                links[j] += 1
                one, other = sorted((find(i), find(j)))
                parent[other] = one
    return links, find


def test_near_vectors_odd_rows(spark):
    rows = [r for r in ODD_VECTORS if r[0] != 7] + [ODD_VECTORS[6]]
    found = near_vectors(vectors_of(spark, ODD_VECTORS)).collect()
    links, find = plain_links(rows, 0.93)
    assert len(found) == len(ODD_VECTORS)
    for r in found:
        i = r["row"]["vec_id"]
        if i is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
            continue
        extra = 1 if i in (7, 8, 9, 14) else 0  # vector 7 is there twice
        assert (i, r["n_links"]) == (i, links[i] + extra)
        assert r["component_id"] == find(i) and r["kept"] == (find(i) == i)
    assert near_vectors(vectors_of(spark, ODD_VECTORS).limit(0)).collect() == []


@pytest.fixture(scope="module")
def clusters():
    """Random vectors, pairs just over the bound, a chain, copies, and a dense group over the block size."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)

    def near(x, cosine):
        noise = rng.normal(size=x.shape)
        noise -= (noise * x).sum(axis=1, keepdims=True) * x
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        return cosine * x + math.sqrt(1 - cosine**2) * noise

    chain = [base[:1]]
    for _ in range(6):
        chain.append(near(chain[-1], 0.95))
    dense = near(np.repeat(base[1:2], 90, axis=0), 0.985)
    values = np.concatenate([base, near(base[100:160], 0.935), near(base[160:200], 0.925), *chain[1:], dense, np.repeat(base[5:6], 70, axis=0)])
    return [(int(i), [float(x) for x in v], int(i % 2 == 0 and i < 300 and i > 200)) for i, v in enumerate(values.astype(np.float32))]


@pytest.mark.parametrize("sizes", [(1, 2, 3), (4, 5, 8), (12, 15, 16)])
def test_no_link_is_lost_with_few_dimensions(spark, sizes):
    """Vectors of several lengths in one table, against all pairs."""
    rng = np.random.default_rng(sum(sizes))
    rows, expected = [], Counter()
    for size in sizes:
        centres = rng.normal(size=(40, size))
        values = centres[rng.integers(0, 40, 300)] + rng.normal(size=(300, size)) * 0.25
        labels, first = rng.integers(0, 3, 300), len(rows)
        units = unit(values)
        linked = (units @ units.T >= 0.93) & (labels[:, None] == labels[None, :])
        np.fill_diagonal(linked, False)
        expected.update({first + i: int(n) for i, n in enumerate(linked.sum(axis=1))})
        rows += [(first + i, v.tolist(), int(label)) for i, (v, label) in enumerate(zip(values, labels))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r["row"]["vec_id"]: r["n_links"] for r in near_vectors(table, least=0.93).collect()} == expected


@pytest.mark.parametrize("block", [2048, 40])
def test_near_vectors_of_clusters(spark, clusters, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    found = near_vectors(vectors_of(spark, clusters)).collect()
    links, find = plain_links(clusters, 0.93)
    assert sum(links.values()) > 5000
    for r in found:
        i = r["row"]["vec_id"]
        assert (r["n_links"], r["component_id"]) == (links[i], find(i))


@pytest.mark.parametrize("vectors", [300, 50_000, 400_000])
def test_filters_miss_no_pair_at_the_bound(vectors):
    rng = np.random.default_rng(4)
    x = unit(rng.normal(size=(600, 64)))
    noise = rng.normal(size=x.shape)
    noise = unit(noise - (noise * x).sum(axis=1, keepdims=True) * x)
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * noise
    codes = make_codes(64, vectors)
    shared = [len(np.intersect1d(a, b)) for a, b in zip(filters_of(x, codes), filters_of(y, codes))]
    assert min(shared) >= 1


def test_decoding_finds_all_filters_over_the_bound():
    rng = np.random.default_rng(2)
    units = unit(rng.normal(size=(20, 24)))
    code = make_codes(24, 1000)[0]
    a, b = code.books
    directions = np.concatenate([np.repeat(a, len(b), axis=0), np.tile(b, (len(a), 1))], axis=1)
    products = (units @ code.rotation) @ directions.T
    for row, found in zip(products, code.decode(units, 0.7, 0)):
        assert set(found.tolist()) == set(np.flatnonzero(row >= 0.7).tolist())
