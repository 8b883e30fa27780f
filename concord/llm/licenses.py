"""License scans by sentence rules.

Comment marks are blanked out and wrapped lines joined, then a text is cut into sentences and
each is normalised to a list of words. Known licence sentences and names, some with slots for
names and years, are word lists too, in a trie: from left to right the longest one known at
a place gives its identifier. The run of identifiers of a text is matched against ordered
licence rules; the first rule that fits at a place wins and consumes its identifiers. A name
counts where something is licensed under it or where it stands alone as a title; one that a
negation comes before counts as nothing. Licences have their SPDX names. Sentences that
speak of licensing but match nothing are counted as unknown. Offsets are those of the text as
it was.

Null and empty texts have no licences. Null ids are kept; repeated rows are scanned again;
very long texts are scanned whole; of phrases that start at one word the longest wins, of
rules the first; a version of a GNU licence is ``-only`` where a text is licensed under it and
neither where it is a title; licences named without a version keep their family's name; an empty table gives an empty result; other columns, whatever their names,
are left out first.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from concord.llm._common import map_texts

# SPDX identifiers, what the licences are called, and sentences of their texts.
NAMES: dict[str, list[str]] = {
    "0BSD": ["zero clause bsd license", "bsd zero clause license", "0 bsd", "bsd 0 clause license"],
    "AFL-3.0": ["academic free license 3"],
    "Apache": ["apache license", "apache software license"],
    "Apache-1.1": ["apache license 1.1", "apache software license 1.1"],
    "Apache-2.0": ["apache license 2", "apache software license 2", "apache 2 license", "apache 2", "asl 2", "apache public license 2"],
    "APSL-2.0": ["apple public source license 2"],
    "Artistic-1.0": ["artistic license 1"],
    "Artistic-2.0": ["artistic license 2"],
    "Beerware": ["beer ware license", "beerware license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "two clause bsd license", "simplified bsd license", "freebsd license", "bsd 2 clause"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "three clause bsd license", "new bsd license", "modified bsd license", "revised bsd license", "bsd 3 clause"],
    "BSD-4-Clause": ["bsd 4 clause license", "4 clause bsd license", "four clause bsd license", "original bsd license", "bsd 4 clause"],
    "BSD": ["bsd license", "bsd style license"],
    "BSL-1.0": ["boost software license 1", "boost software license", "boost license 1", "boost license"],
    "BUSL-1.1": ["business source license 1.1"],
    "CC0-1.0": ["cc 0 1", "cc 0", "cc 0 1 universal", "creative commons zero 1", "creative commons zero", "creative commons cc 0 license", "creative commons zero 1 universal"],
    "CDDL-1.0": ["common development and distribution license 1", "common development and distribution license", "cddl 1"],
    "CECILL-2.1": ["cecill license 2.1", "cecill 2.1"],
    "CPL-1.0": ["common public license 1", "common public license"],
    "ECL-2.0": ["educational community license 2"],
    "EPL-1.0": ["eclipse public license 1", "epl 1"],
    "EPL-2.0": ["eclipse public license 2", "epl 2"],
    "EUPL-1.1": ["european union public license 1.1", "eupl 1.1"],
    "EUPL-1.2": ["european union public license 1.2", "eupl 1.2"],
    "ISC": ["isc license", "isc licence isc"],
    "LPPL-1.3c": ["latex project public license 1.3", "lppl 1.3"],
    "MIT": ["mit license", "mit license mit", "expat license", "mit expat license", "mit"],
    "MIT-0": ["mit no attribution license", "mit 0 license"],
    "MPL-1.1": ["mozilla public license 1.1", "mpl 1.1"],
    "MPL-2.0": ["mozilla public license 2", "mpl 2"],
    "MS-PL": ["microsoft public license", "ms pl license"],
    "NCSA": ["university of illinois ncsa open source license", "ncsa open source license"],
    "ODbL-1.0": ["open database license 1", "open database license", "odbl 1"],
    "OFL-1.1": ["sil open font license 1.1", "open font license 1.1", "ofl 1.1"],
    "OSL-3.0": ["open software license 3"],
    "PHP-3.01": ["php license 3.01"],
    "PostgreSQL": ["postgresql license", "postgresql licence"],
    "PSF-2.0": ["python software foundation license 2", "psf license 2"],
    "Unlicense": ["unlicense", "unlicense license"],
    "UPL-1.0": ["universal permissive license 1"],
    "WTFPL": ["do what fuck you want to public license", "wtfpl 2", "wtfpl"],
    "X11": ["x 11 license"],
    "Zlib": ["zlib license", "zlib libpng license"],
    "ZPL-2.1": ["zope public license 2.1"],
}
FAMILIES = {
    "GPL": (["gnu general public license", "gnu gpl", "gpl", "general public license"], ["1.0", "2.0", "3.0"]),
    "LGPL": (["gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"], ["2.0", "2.1", "3.0"]),
    "AGPL": (["gnu affero general public license", "gnu agpl", "agpl"], ["1.0", "3.0"]),
    "GFDL": (["gnu free documentation license", "gfdl"], ["1.1", "1.2", "1.3"]),
}
COMMONS = {"BY": "attribution", "BY-SA": "attribution share alike", "BY-NC": "attribution non commercial", "BY-ND": "attribution no derivatives", "BY-NC-SA": "attribution non commercial share alike", "BY-NC-ND": "attribution non commercial no derivatives"}
GRANTS = ["licensed under", "licensed under terms of", "licensed to you under", "released under", "released under terms of", "distributed under", "distributed under terms of", "available under", "available under terms of", "made available under", "made available under terms of", "published under", "provided under", "provided under terms of", "under terms of", "subject to terms of", "subject to", "covered by", "governed by", "use of this source code is governed by", "dual licensed under", "under", "license is", "license"]
SENTENCES: dict[str, list[str]] = {
    "apache-condition": ["you may not use this file except in compliance with license", "you may not use this work except in compliance with license"],
    "apache-copy": ["you may obtain copy of license at"],
    "apache-basis": ["unless required by applicable law or agreed to in writing software distributed under license is distributed on as is basis"],
    "apache-terms": ["see license for specific language governing permissions and limitations"],
    "gnu-later": ["any later version", "at your option any later version", "or at your option any later version", "or any later version", "+", "or later", "or newer"],
    "gnu-warranty": ["this * is distributed in hope that it will be useful but without any warranty", "is distributed in hope that it will be useful but without any warranty"],
    "gnu-copy": [f"you should have received copy of {x}" for x in ("gnu general public license", "gnu lesser general public license", "gnu library general public license", "gnu affero general public license")],
    "gnu-more": [f"see {x} for more details" for x in ("gnu general public license", "gnu lesser general public license", "gnu library general public license", "gnu affero general public license")],
    "gnu-see": ["if not see", "if not write to free software foundation"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining copy"],
    "mit-notice": ["above copyright notice and this permission notice shall be included in all copies"],
    "boost-grant": ["permission is hereby granted free of charge to any person or organization obtaining copy of software and accompanying documentation covered by this license"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"],
    "zlib-warranty": ["this software is provided as is without any express or implied warranty"],
    "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications"],
    "zlib-origin": ["origin of this software must not be misrepresented"],
    "zlib-altered": ["altered source versions must be plainly marked as such"],
    "as-is": ["software is provided as is", "this software is provided as is", "this software is provided by * as is", "software is provided by * as is"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "bsd-source": ["redistributions of source code must retain above copyright notice"],
    "bsd-binary": ["redistributions in binary form must reproduce above copyright notice"],
    "bsd-advertising": ["all advertising materials mentioning features or use of this software must display following acknowledgement"],
    "bsd-endorse": ["neither name of * may be used to endorse or promote products", "names of * may not be used to endorse or promote products"],
    "unlicense": ["this is free and unencumbered software released into public domain"],
    "public-domain": ["dedicated to public domain", "dedicated this work to public domain"],
    "all-rights": ["all rights reserved"],
    "copyright": ["copyright", "c *", "©"],
}
NEGATIONS = {"not", "never", "no", "isn", "cannot", "nor"}
#: Licences and the identifier sequences that show them; ``?`` marks one that may be absent,
#: ``*`` any name, which ``{}`` stands for. The first that fits wins.
GNU = ("gnu-warranty?", "gnu-more?", "gnu-copy?", "gnu-see?")
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("{}", ("spdx:*",)),
    ("{}-or-later", ("gnu:*", "gnu-later", *GNU)),
    ("{}-only", ("gnu:*", *GNU)),
    ("Apache-2.0", ("name:Apache-2.0", "apache-condition?", "apache-copy?", "apache-basis?", "apache-terms?")),
    ("MIT", ("name:MIT", "copyright?", "all-rights?", "mit-grant?", "mit-notice?", "as-is?")),
    ("ISC", ("name:ISC", "copyright?", "all-rights?", "isc-grant?", "as-is?")),
    ("BSL-1.0", ("name:BSL-1.0", "boost-grant?")),
    ("Zlib", ("name:Zlib", "copyright?", "zlib-warranty?", "zlib-grant?", "zlib-origin?", "zlib-altered?")),
    ("BSD-4-Clause", ("name:BSD-4-Clause", "copyright?", "all-rights?", "bsd-grant", "bsd-source?", "bsd-binary?", "bsd-advertising?", "bsd-endorse?", "as-is?")),
    ("BSD-3-Clause", ("name:BSD-3-Clause", "copyright?", "all-rights?", "bsd-grant", "bsd-source?", "bsd-binary?", "bsd-endorse?", "as-is?")),
    ("BSD-2-Clause", ("name:BSD-2-Clause", "copyright?", "all-rights?", "bsd-grant", "bsd-source?", "bsd-binary?", "as-is?")),
    ("{}", ("name:*",)),
    ("BSD-4-Clause", ("copyright?", "all-rights?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse", "as-is?")),
    ("BSD-3-Clause", ("copyright?", "all-rights?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "as-is?")),
    ("BSD-2-Clause", ("copyright?", "all-rights?", "bsd-grant", "bsd-source", "bsd-binary", "as-is?")),
    ("MIT", ("copyright?", "mit-grant", "mit-notice?", "as-is?")),
    ("ISC", ("copyright?", "isc-grant", "as-is?")),
    ("BSL-1.0", ("boost-grant",)),
    ("Zlib", ("copyright?", "zlib-warranty?", "zlib-grant", "zlib-origin?", "zlib-altered?")),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("public-domain",)),
    ("Apache-2.0", ("apache-condition", "apache-copy?", "apache-basis?", "apache-terms?")),
    ("Proprietary", ("copyright?", "all-rights")),
]

SLOT, SLOT_WORDS = "*", 12
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*|[+©*]")
_SPLIT = re.compile(r"([a-z]+?)v?(\d+(?:\.\d+)*)")
_DROPPED = {"the", "a", "an", "version", "v", "ver"}


def words_of(sentence: str) -> list[str]:
    """Lower-case words of a sentence: one spelling of 'license', no articles, versions as bare
    numbers without a trailing .0, letters and a number behind them apart."""
    out = []
    for w in _WORD.findall(sentence.lower().replace("licence", "license").replace("sharealike", "share alike").replace("noncommercial", "non commercial").replace("noderiv", "no deriv")):
        m = _SPLIT.fullmatch(w)
        for x in m.groups() if m else (w,):
            x = x.removesuffix(".0") if x[0].isdigit() else "derivatives" if x == "derivs" else x
            if x not in _DROPPED:
                out.append(x)
    return out


def phrases() -> dict[tuple[str, ...], str]:
    """All known word lists and their identifiers."""
    out = {}
    for name, texts in NAMES.items():
        out.update({tuple(words_of(t)): f"name:{name}" for t in texts})
    for family, (texts, versions) in FAMILIES.items():
        for t in texts:
            for v in versions:
                for form in (f"{t} {v}", f"{t} as published by free software foundation {v}", f"{t} as published by free software foundation either {v}", f"{v} of {t}", f"{t} as published by free software foundation {v} of license", f"{t} as published by free software foundation either {v} of license", f"{v} or at your option any later version of {t}"):
                    out[tuple(words_of(form))] = f"gnu:{family}-{v}"
        out.update({tuple(words_of(t)): f"name:{family}" for t in texts})  # no version said
    for kind, text in COMMONS.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            for form in (f"cc {kind} {v}", f"cc {kind} license {v}", f"creative commons {text} {v}", f"creative commons {kind} {v}", f"creative commons {text} license {v}", f"creative commons {text} {v} international", f"creative commons {text} {v} unported"):
                out[tuple(words_of(form))] = f"name:CC-{kind}-{v}"
    out.update({tuple(words_of(t)): "grant" for t in GRANTS})
    for name, texts in SENTENCES.items():
        out.update({tuple(words_of(t)): name for t in texts})
    return out


PHRASES = phrases()


def _trie() -> dict:
    root: dict = {}
    for phrase, name in PHRASES.items():
        node = root
        for w in phrase:
            node = node.setdefault(w, {})
        node[""] = name
    return root


_TRIE = _trie()


def longest(words: list[str], at: int) -> tuple[int, str] | None:
    """The end and identifier of the longest known phrase from ``at``; a slot takes up to
    ``SLOT_WORDS`` words, as few as it can."""
    best, open_ = None, [(_TRIE, at, 0)]
    while open_:
        node, n, skipped = open_.pop()
        if "" in node and n > at and (best is None or n > best[0]):
            best = n, node[""]
        if n < len(words):
            if words[n] in node and words[n] != SLOT:
                open_.append((node[words[n]], n + 1, 0))
            if SLOT in node:
                open_.append((node[SLOT], n + 1, 1))
            if skipped and skipped < SLOT_WORDS:
                open_.append((node, n + 1, skipped + 1))
    return best


SPDX = {x.lower(): x for x in [*NAMES, *(f"{f}-{v}{e}" for f, (_, vs) in FAMILIES.items() for v in vs for e in ("", "-only", "-or-later", "+")), *(f"CC-{k}-{v}" for k in COMMONS for v in ("1.0", "2.0", "2.5", "3.0", "4.0")), "Classpath-exception-2.0", "GCC-exception-3.1", "LLVM-exception", "Linux-syscall-note", "OpenSSL", "Python-2.0", "Ruby", "Vim"]}

#: Every known phrase that can begin a rule holds one of these, so a text without any has no licence.
KEYS = ("licen", "copyright", "©", "(c)", "permission", "redistribut", "unencumbered", "public", "rights", "spdx", "cc0", "cc 0", "cc-0", "cc by", "cc-by", "creative", "gnu", "apache", "warrant", "under", "provided", "governed", "covered", "subject", "gpl", "mit", "bsd")
#: What other known phrases hold: sentences with neither need no matching.
MORE = ("endorse", "advertising", "misrepresented", "plainly", "later", "newer", "agreed", "if not", "option", "+")


def speaks(text: str, keys: tuple[str, ...] = KEYS + MORE) -> bool:
    """Whether a text may hold a known phrase; a plain search for each key, faster than one pattern."""
    low = text.lower()
    return any(map(low.__contains__, keys))


_END = re.compile(r"(?<=[.!?])(?<![ (][vV]\.)\s+|(?<!Identifier:)(?<![Ll]icense:)(?<![Ll]icence:)(?<!LICENSE:)(?<![Ll]icense\x22:)(?<!Classifier:)(?<!::)(?<=:)\s+(?!:)|\s*\x1e\s*|\n\s*\n")
#: Comment marks at the ends of a line.
_OPEN = re.compile(r"[ \t]*(/\*+!?|<!--+|\(\*+|\{-|\"\"\"|\x27\x27\x27|\*+/|\*+\)|--+>|\*+(?![\w*])|//+!?|#+!?|--+(?!>)|;+|%+|\.\.(?=\s)|(?i:rem|dnl)\b|c(?= {2,}))")
_CLOSE = re.compile(r"[ \t]*(\*+/|--+>|\*+\)|-\}|\"\"\"|\x27\x27\x27|(?<=\s)[*#;|]+)[ \t\r]*$")
#: Lines that are a statement of their own, and items of lists.
_OWN = re.compile(r"[ \t]*(Copyright\b(?=\s*(\(c\)|©|\d{4}|[A-Z]))|\([cC]\)\s*\d|©|\S*SPDX-License-Identifier:)")
_ITEM = re.compile(r"[ \t]*-\s")
_MARKED = re.compile(r"^[ \t]*(/\*|<!--|\(\*|\{-|\"\"\"|\x27\x27\x27|\*|//|#|--|;|%|\.\.|-\s|\([cC]\)|©|Copyright\b|rem\b|dnl\b|c  )|SPDX-License-Identifier:", re.M | re.I)
_BLOCKS = {"/*": "*/", "<!": "->", "(*": "*)", "{-": "-}", '""': '""', "\x27\x27": "\x27\x27"}


def uncomment(text: str) -> str:
    """The text, as long as before, with blanks for comment marks and the separator \x1e for
    line ends that end a statement: beside notices, before list items, and where the kind
    of comment changes."""
    if not _MARKED.search(text):
        return text
    out, last, own, until = [], None, False, ""
    for line in text.split("\n"):
        kind = until and "block"
        if m := _OPEN.match(line):
            mark = m[1]
            if not until and mark[:2] in _BLOCKS:
                kind, until = "block", _BLOCKS[mark[:2]]
                body = line[m.end() :]
            else:
                kind, body = kind or ("*" if mark[0] == "*" else mark[:2].lower()), line[m.end() :]
                if until and mark[-2:] == until:
                    until = ""
            line = " " * m.end() + body
        if until and until in line:
            until = ""
        if m := kind and _CLOSE.search(line):
            line = line[: m.start()] + " " * (len(line) - m.start())
        mine = bool(_OWN.match(line))
        if out:
            out.append("\x1e" if mine or own or kind != last or (not kind and _ITEM.match(line)) else "\n")
        out.append(line)
        last, own = kind, mine
    return "".join(out)


def sentences(text: str):
    """(start, end) of each sentence of a text without comment marks."""
    at = 0
    for m in _END.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def expression(text: str, at: int = 0) -> tuple[str, int] | None:
    """The longest SPDX expression of a text from ``at`` on, identifiers as SPDX writes them,
    and where it ends."""
    tokens = [(m[0].rstrip(".:") or m[0], m.start(), m.end()) for m in re.finditer(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*|[^\s()]+", text[at:])]
    operators = ("and", "or", "with")

    def term(k: int):
        if k < len(tokens) and tokens[k][0] == "(":
            inner = anyof(k + 1)
            return (f"({inner[0]})", inner[1] + 1) if inner and inner[1] < len(tokens) and tokens[inner[1]][0] == ")" else None
        if k >= len(tokens) or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.+:-]*", tokens[k][0]) or tokens[k][0].lower() in operators:
            return None
        return SPDX.get(tokens[k][0].lower(), tokens[k][0]), k + 1

    def anyof(k: int):
        left = term(k)
        while left and left[1] < len(tokens) and tokens[left[1]][0].lower() in operators:
            right = term(left[1] + 1)
            if not right:
                break
            left = f"{left[0]} {tokens[left[1]][0].upper()} {right[0]}", right[1]
        return left

    try:
        found = anyof(0)
    except RecursionError:  # thousands of brackets are no expression
        return None
    return found and (found[0], at + tokens[found[1] - 1][2])


_TAG = re.compile(r"spdx-license-identifier:\s*", re.I)
#: A field of a manifest, or a classifier.
_FIELD = re.compile(r"\s*(?:classifier:\s*)?[\"\x27]?licen[cs]e[\"\x27]?\s*(?:::?|=)\s*[\"\x27]?(.*?)[\"\x27]?[\s,;.]*", re.I | re.S)
#: Words of which one must come before a plain 'under'.
VERBS = {"licensed", "released", "distributed", "redistributed", "available", "published", "provided", "offered", "shared", "redistribute", "modify", "use", "copy", "issued", "made", "dual", "relicensed", "shipped"}


def _lone(text: str) -> bool:
    """Whether the text is an SPDX identifier and nothing else."""
    return SPDX.get(text.lower()) == text and text not in ("BSD", "Apache")


def field(sentence: str) -> list[str] | None:
    """The identifiers of a manifest field such as ``License: MIT`` or of a classifier; None
    if the sentence is neither."""
    m = _FIELD.fullmatch(sentence)
    if not m or not m[1].strip():
        return None
    value = m[1].rpartition("::")[2].strip()
    whole = expression(value)
    if whole and not value[whole[1] :].strip() and all(x.lower() in SPDX for x in re.findall(r"[A-Za-z0-9][A-Za-z0-9.+:-]*", whole[0]) if x not in ("AND", "OR", "WITH")):
        return [f"spdx:{whole[0]}"]
    return identifiers(f"licensed under {value}")


def identifiers(sentence: str) -> list[str]:
    """The identifiers of a sentence, in order; only 'unknown' for one that just mentions a licence."""
    if tag := _TAG.search(sentence):
        whole = expression(sentence, tag.end())
        return [f"spdx:{whole[0]}"] if whole else ["unknown"]
    alone = sentence.strip()
    if _lone(alone):
        return [f"spdx:{alone}"]
    if (named := field(sentence)) is not None:
        return named
    words = words_of(sentence)
    found: list[tuple[int, int, str]] = []
    at = 0
    while at < len(words):
        if hit := longest(words, at):
            found.append((at, hit[0], hit[1]))
            at = hit[0]
        else:
            at += 1
    out, granted, denied = [], -1, False
    for k, (a, b, name) in enumerate(found):
        if _negated(words, a) and name not in ("bsd-endorse",) and (not k or found[k - 1][1] <= a - 1):
            denied = True  # what follows a negation in the sentence is not said of this text
        if name == "grant":
            if words[a:b] != ["under"] or (a and words[a - 1] in ("is", "are")) or not VERBS.isdisjoint(words[max(0, a - 12) : a]):
                granted = b
            continue
        if name.startswith(("name:", "gnu:")):
            title = a == 0 and len(words) - b <= 4 and (b == len(words) or words[b] in _MONTHS or words[b].isdigit()) and len(words) > 1 + (name == "name:MIT")
            joined = granted >= 0 and all(w in _JOINING for w in words[granted:a])
            if words[a:b] == ["mit"] and b < len(words) and words[b] not in _AFTER:
                continue  # the institute
            if not denied and (joined or title):
                # a title does not say whether later versions will do
                out.append(name if joined or not name.startswith("gnu:") else f"name:{name[4:]}")
                granted = b
        elif name == "copyright":
            if a == 0 and name not in out:
                out.append(name)
        elif name == "gnu-later":
            if out and out[-1].startswith("gnu:"):
                out.append(name)
        elif not denied:
            out.append(name)
    return out or (["unknown"] if any(w.startswith("licens") for w in words) else [])


def _negated(words: list[str], at: int) -> bool:
    """Whether a negation stands in the six words before; ``n't`` is the word ``t``."""
    return any(w in NEGATIONS or (w == "t" and k and words[k - 1].endswith("n")) for k, w in enumerate(words[:at]) if k >= at - 6)


#: What may follow a bare 'MIT' that names the licence.
_AFTER = {"license", "licenses", "licensed", "or", "and", "as", "with", "terms", "unless", "see", "c", "copyright", "©", "for", "by"}
_MONTHS = {"january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"}
_JOINING = {"or", "and", "both", "either", "license", "licenses", "terms", "of", "following", "this", "s", "its", "same", "as"}


def identify(sentence: str) -> str | None:
    """The first identifier of a sentence."""
    return next(iter(identifiers(sentence)), None)


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], int]:
    """Licences found, (name, start, end) in order, and the number of unknown sentences."""
    if not text or not speaks(text, KEYS):
        return [], 0
    run: list[tuple[str, int, int]] = []
    clean = uncomment(text)
    for a, b in sentences(clean):
        part = clean[a:b]
        if speaks(part) or _lone(part.strip()):
            a, b = a + len(part) - len(part.lstrip()), b - len(part) + len(part.rstrip())
            run += [(found, a, b) for found in identifiers(part)]
    out, at = [], 0
    unknown = sum(r[0] == "unknown" for r in run)
    run = [r for r in run if r[0] != "unknown"]
    while at < len(run):
        for name, rule in RULES:
            i, named = at, ""
            for want in rule:
                kind = want.rstrip("?")
                here = i < len(run) and (run[i][0].startswith(kind[:-1]) if kind[-1] == "*" else run[i][0] == kind)
                if here:
                    named = run[i][0].partition(":")[2] if kind[-1] == "*" else named
                    i += 1
                elif not want.endswith("?"):
                    break
            else:
                if i > at:
                    out.append((name.replace("{}", named), run[at][1], run[i - 1][2]))
                    at = i
                    break
        else:
            at += 1
    return out, unknown


SCHEMA = "id bigint, licenses array<struct<license:string,start:bigint,end:bigint>>, n_unknown bigint"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licenses, n_unknown) of every whole text; offsets count characters."""

    def run(ids, texts):
        found = [scan(t) for t in texts]
        return {"id": ids, "licenses": [[{"license": x, "start": a, "end": b} for x, a, b in f] for f, _ in found], "n_unknown": [u for _, u in found]}

    return map_texts(docs, id_col, text_col, SCHEMA, run)
