"""BPE, word-piece counts and licence scans against the libraries and brute force."""

import hashlib
import random
import re

import pytest

from concord.llm import bpe, licenses, queries, wordpiece

PATH = queries.tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(open(PATH, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def odd_texts():
    rnd = random.Random(1)
    fixed = ["", "<|endoftext|>hi<|startoftext|>", "a\x1cb \x85c d", "ΣΑΣ İstanbul", "é q̣̇", "don't I'LL we're'S ", "x" * 300, "日本語テキスト" * 30, "１２３ ²½ 9a_b", "\U0001f600‍", "ǅ ß ẞ", "aaa" * 500 + "b!!!???", "word" * 3000]
    return fixed + ["".join(rnd.choice("abcdeéÉ 'stSTlL,.!?\n\t12<|>́ 中Σ") for _ in range(rnd.randint(0, 90))) for _ in range(1500)]


def test_bpe_equals_the_library(encoder, library):
    texts = odd_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder.limit = 700  # the caches run over
    assert [x.tolist() for at in range(0, len(texts), 50) for x in encoder.encode_batch(texts[at : at + 50])] == want
    for ids in want:
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)
        assert encoder.decode(ids, True) == library.decode(ids, skip_special_tokens=True)


def test_tree_and_matrix_agree(encoder):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("thearinou") for _ in range(rnd.randint(1, 64))).encode() for _ in range(500)]
    merged = encoder.merge(words)
    for w, ids in zip(words, merged):
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == encoder.merge_one(w)


def test_bpe_query_rows(spark, library):
    rows = [(1, "Hello, World"), (2, None), (3, ""), (None, "x"), (1, "Hello, World"), (4, "long " * 30_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, id int")
    got = bpe.encode_digests(docs, PATH).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    full = {r.id: (r.ids, r.decoded) for r in bpe.encode_documents(docs, PATH).collect()}
    assert full[2] == ([], "") and full[1][0] == library.encode("Hello, World", add_special_tokens=False).ids
    assert bpe.encode_digests(docs.limit(0), PATH).count() == 0


def greedy(word, first, later):
    """Longest match first, as published for word pieces; None if the word is not covered."""
    at, n = 0, 0
    while at < len(word):
        pieces = later if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), 0)
        if not end:
            return None
        at, n = end, n + 1
    return n


def test_piece_counter_equals_greedy():
    rnd = random.Random(9)
    for _ in range(150):
        alphabet = "abc"[: rnd.randint(1, 3)]
        make = lambda: {"".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 12))}
        first, later = make(), make()
        counter = wordpiece.PieceCounter(sorted(first), sorted(later))
        for _ in range(60):
            word = "".join(rnd.choice(alphabet + "d" * (rnd.random() < 0.1)) for _ in range(rnd.randint(1, 14)))
            assert counter.count(word) == (greedy(word, first, later) or 0), (word, first, later)


def test_piece_counts_over_texts(spark, sf):
    first, later = wordpiece.load_vocabulary(queries.tokenizer("piece_bpe_32k.model"))
    a, b = set(first), set(later)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).unionByName(spark.createDataFrame([(-1, None), (-2, ""), (None, "漢字 \U0001f9ff x_y")], "doc_id bigint, text string"), allowMissingColumns=True)
    got = {r.id: r for r in wordpiece.piece_counts(docs, (first, later)).collect()}
    for d in docs.collect():
        words = re.findall(r"\w+|[^\w\s]|_", d.text or "")
        each = [greedy(w, a, b) for w in words]
        assert (got[d.doc_id].n_words, got[d.doc_id].n_unknown, got[d.doc_id].n_pieces) == (len(words), each.count(None), sum(x or 1 for x in each))


def test_piece_counts_of_odd_tables(spark):
    first, later = ["ab", "a", "x"], ["b", "bb", "a"]
    texts = ["ab abb x", "ab abb x", "ab" * 300_000, "ab " * 300_000, "q" * 50_000, None, ""]
    docs = spark.createDataFrame([(1, t, 7, "n", None) for t in texts], "doc_id int, text string, id int, n_words string, n_pieces double")
    got = sorted((r.id, r.n_words, r.n_pieces, r.n_unknown) for r in wordpiece.piece_counts(docs, (first, later)).collect())
    want = []
    for t in texts:
        words = re.findall(r"\w+|[^\w\s]|_", t or "")
        known = {w: greedy(w, set(first), set(later)) if len(w) < 9 else None if w[0] == "q" else len(w) - 1 for w in set(words)}  # ab, then a and b in turn
        want.append((1, len(words), sum(known[w] or 1 for w in words), sum(known[w] is None for w in words)))
    assert got == sorted(want)
    empty = wordpiece.piece_counts(docs.limit(0), (first, later))
    assert empty.columns == ["id", "n_words", "n_pieces", "n_unknown"] and empty.count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("Intro.\nThis work is licensed under the GNU General Public License, version 3.\nMore text.", ["GPL-3.0-only"]),
        ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n http://www.apache.org/licenses/LICENSE-2.0\n", ["Apache-2.0"]),
        ("x. Released under the MIT License. y. Licensed under the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software. The above copyright notice and this permission notice shall be included in all copies. THE SOFTWARE IS PROVIDED \"AS IS\".", ["MIT"]),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted: \nRedistributions of source code must retain the above copyright notice. Redistributions in binary form must reproduce the above copyright notice.", ["BSD-2-Clause"]),
        ("// SPDX-License-Identifier: MPL-2.0\nint x;", ["MPL-2.0"]),
        ("Released under the Creative Commons Attribution-ShareAlike 3.0 licence.", ["CC-BY-SA-3.0"]),
        ("Copyright 2020 A. All rights reserved.", ["Proprietary"]),
        ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1", ["LGPL-2.1-only"]),
        ("A text that says nothing of the kind. The permission was given.", []),
    ],
)
def test_licences(text, want):
    assert [x[0] for x in licenses.scan(text)[0]] == want


def test_licence_rows(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License."), (2, None), (3, ""), (None, "My own licence applies."), (1, "Released under the MIT License.")], "doc_id bigint, text string")
    rows = licenses.scan_licenses(docs).collect()
    assert sorted((str(r.id), len(r.licenses), r.n_unknown) for r in rows) == [("1", 1, 0), ("1", 1, 0), ("2", 0, 0), ("3", 0, 0), ("None", 0, 1)]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_trigger_covers_all_phrases():
    for phrase, name in licenses.PHRASES.items():
        if not name.startswith(("name:", "gnu:")) and name not in ("grant", "gnu-later") and phrase != ("c", "*"):
            sentence = " ".join(phrase).replace("*", "someone")
            assert licenses.speaks(sentence), phrase
            assert name in licenses.identifiers(sentence) or name in ("gnu-see",), phrase


def slow_longest(words, at):
    """Every known phrase tried at ``at``, word by word."""

    def ends(phrase, n):
        if not phrase:
            return {n}
        if phrase[0] == "*":
            return set().union(*(ends(phrase[1:], n + k) for k in range(1, licenses.SLOT_WORDS + 1) if n + k <= len(words)))
        return ends(phrase[1:], n + 1) if n < len(words) and words[n] == phrase[0] else set()

    found = [(end, name) for phrase, name in licenses.PHRASES.items() for end in ends(phrase, at)]
    return max(found)[0] if found else None


def test_longest_phrase_equals_a_slow_search():
    import random

    rnd = random.Random(6)
    known = list(licenses.PHRASES)
    for _ in range(60):
        words = []
        for _ in range(rnd.randint(1, 5)):
            part = [w for x in rnd.choice(known) for w in (rnd.choices(["acme", "inc", "license", "2"], k=rnd.randint(1, 4)) if x == "*" else [x])]
            words += part[: rnd.randint(1, len(part))] if rnd.random() < 0.3 else part
        for at in range(len(words)):
            hit = licenses.longest(words, at)
            assert (hit and hit[0]) == slow_longest(words, at), words[at:]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("This file is not licensed under the MIT License.", []),
        ("We do not claim that all rights reserved applies.", []),
        ("Licensed under the BSD license.", ["BSD"]),
        ("Licensed under the MIT License or the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["MPL-2.0"]),
        ("made available under the terms of the Eclipse Public License v2.0", ["EPL-2.0"]),
        ("Released under the Artistic License 2.0.", ["Artistic-2.0"]),
        ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
        ("Licensed under the zlib license. Also licensed under the ISC license.", ["Zlib", "ISC"]),
        ("The MIT License (MIT)", ["MIT"]),
        ("BSD 3-Clause License", ["BSD-3-Clause"]),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", ["GPL-2.0"]),  # a title does not say only
        ("Licensed under GPLv3+.", ["GPL-3.0-or-later"]),
        ("The MIT License is short, the GPL 3 is not.", []),
        ('token = "cc0f735eef57bdf461"', []),
        ("You must apply for a driver license under MIT supervision.", []),
        ("We don't release this under the MIT license.", []),
        ("It can't be licensed under the GPL.", []),
        ("This was released by MIT under the MIT license.", ["MIT"]),
        ("License: MIT", ["MIT"]),
        ("License: GPL-3.0+", ["GPL-3.0+"]),
        ("License: Apache-2.0", ["Apache-2.0"]),
        ("license = 'BSD-3-Clause'", ["BSD-3-Clause"]),
        ('{"name": "x",\n\n"license": "MIT OR Apache-2.0",', ["MIT OR Apache-2.0"]),
        ("License: see below", []),
        ("License :: OSI Approved :: MIT License", ["MIT"]),
        ("Classifier: License :: OSI Approved :: Apache Software License", ["Apache"]),
        ("Licensed under the GPL.", ["GPL"]),
        ("The package is under the GNU LGPL.", ["LGPL"]),
        ("They live under GPL rules.", []),
        ("Readme\n\nMIT\n\nMore", ["MIT"]),
        ("The MIT is in Cambridge.", []),
        ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", ["GPL-3.0"]),
        ("Dual licensed under CC BY 4.0 and the GNU LGPL 2.1 or later.", ["CC-BY-4.0", "LGPL-2.1-or-later"]),
    ],
)
def test_names_negations_and_titles(text, want):
    assert [x[0] for x in licenses.scan(text)[0]] == want
    assert len(licenses.NAMES) + sum(len(v) for _, v in licenses.FAMILIES.values()) > 50


def test_licences_of_long_texts(spark):
    text = "word " * 400_000 + "end.\nReleased under the MIT License.\n" + "word " * 1000
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x")], "doc_id bigint, text string, licenses string")
    rows = licenses.scan_licenses(docs).collect()
    assert [[(x.license, text[x.start : x.end].strip()) for x in r.licenses] for r in rows] == [[("MIT", "Released under the MIT License.")]] * 2


GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program.  If not, see <https://www.gnu.org/licenses/>."""
BSD = """Copyright (c) 2020, A. Author
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above
   copyright notice, this list of conditions and the following disclaimer.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""


@pytest.mark.parametrize(("head", "mark", "tail"), [("", "", ""), ("/*\n", " * ", "\n */"), ("/*\n", "", "\n*/"), ("", "// ", ""), ("", "# ", ""), ("", "-- ", ""), ("", ";; ", ""), ("", "% ", ""), ("<!--\n", "  ", "\n-->"), ('"""\n', "", '\n"""'), ("", " * ", "")])
def test_wrapped_headers_in_comments(head, mark, tail):
    lesser = GPL.replace("General", "Lesser General").replace("version 2", "version 2.1").replace("This program", "This library")
    affero = GPL.replace("General", "Affero General").replace("version 2", "version 3")
    for body, want in ((GPL, "GPL-2.0-or-later"), (BSD, "BSD-3-Clause"), (lesser, "LGPL-2.1-or-later"), (affero, "AGPL-3.0-or-later")):
        text = "int before;\n\n" + head + "\n".join((mark + x).rstrip() for x in body.split("\n")) + tail + "\n\nint after;\n"
        found, unknown = licenses.scan(text)
        assert [x[0] for x in found] == [want] and unknown == 0, text
        part = text[found[0][1] : found[0][2]]
        assert part.startswith(("Copyright", "you can", "This")) and part.endswith(("licenses/>.", "DISCLAIMED."))


def test_wraps_before_capitals_and_statements_without_end_marks():
    names = lambda t: [x[0] for x in licenses.scan(t)[0]]
    assert names("It is licensed under the Apache\nLicense, Version 2.0.") == ["Apache-2.0"]
    assert names("under the terms of the GNU\nGeneral Public License, version 3.") == ["GPL-3.0-only"]
    assert names("Copyright 2020 A\nAll rights reserved\nReleased under the MIT License\nLicensed under the Apache License, Version 2.0") == ["Proprietary", "MIT", "Apache-2.0"]
    assert licenses.scan("Copyright 2020 A\nMy own licence applies")[1] == 1


@pytest.mark.parametrize(("text", "want"), [("(MIT OR Apache-2.0)", "(MIT OR Apache-2.0)"), ("GPL-2.0-only WITH Classpath-exception-2.0 AND (BSD-3-Clause OR ISC)", "GPL-2.0-only WITH Classpath-exception-2.0 AND (BSD-3-Clause OR ISC)"), ("GPL-2.0+ OR", "GPL-2.0+"), ("mit or apache-2.0", "MIT OR Apache-2.0"), ("MIT", "MIT")])
def test_spdx_expressions(text, want):
    for line in (f"// SPDX-License-Identifier: {text}\nint x;", f"/* SPDX-License-Identifier: {text} */\nint x;", f"# SPDX-License-Identifier: {text}\n# more"):
        assert [x[0] for x in licenses.scan(line)[0]] == [want]


def test_licence_query_keeps_every_place(spark, tmp_path):
    text = "Released under the MIT License. Licensed under the Apache License, Version 2.0. Prose. Released under the MIT License."
    spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op9_licenses(spark, str(tmp_path)).collect()}
    assert [(x.license, x.start, x.end) for x in rows[1].licenses] == licenses.scan(text)[0] and rows[2].licenses == []
    assert [x.license for x in rows[1].licenses] == ["MIT", "Apache-2.0", "MIT"]
    assert (rows[1].license_ids, rows[1].n_licenses, rows[1].first_end) == ("Apache-2.0,MIT", 3, rows[1].licenses[0].end)
