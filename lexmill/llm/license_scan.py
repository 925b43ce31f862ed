"""License scans by ordered signature rules.

Texts become words in ASCII lower case with one space between and around them. Rules are
regexes over that form, built from a table of licenses (`LICENSES`) and sentence frames
(`FRAMES`), and from full-text signatures (`SIGNATURES`). A rule runs only on a text that
holds strings that all its matches hold (`gates`, read off its pattern).

Matches overlap, so two steps resolve them. A match within another one is dropped (of
equal intervals the rule that comes first stays). The others are settled in order of
priority: a match stays unless it overlaps one of a smaller rule number that stayed. The
matches left give labels and a score.

A match has at most `MOST` characters (all of a rule's repetitions are bounded), and a
rule's matches don't overlap; so an interval around a given one is among the last
`LOOK_BACK` matches before it, and the search there is exact.

All of it is column expressions over the row where the text is read: no shuffle, no Python.

Null texts count as empty: no words, no labels, score 0. Rows are answered each, repeated
ones too. Other columns are kept, but for those named like a result. An empty table gives
none.
"""

from __future__ import annotations

import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.spans import located, matches_of

_ASCII = [chr(c) for c in range(128)]
_OTHER = "".join(c for c in _ASCII if not c.isalnum())
_FROM, _TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _OTHER, "abcdefghijklmnopqrstuvwxyz" + " " * len(_OTHER)

#: Phrases that always give their label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BASE_SCORE = 0.9

#: Label: SPDX name in words, other names (regexes over words).
LICENSES = {
    "mit": ("mit", "mit|expat"),
    "mit-0": ("mit 0", "mit no attribution"),
    "apache-1.1": ("apache 1 1", "apache (?:software )?1 1"),
    "apache-2": ("apache 2 0", "apache (?:software )?(?:v ?)?2(?: 0)?|apache"),
    "bsd-2-clause": ("bsd 2 clause", "bsd 2 clause|simplified bsd|freebsd|2 clause bsd"),
    "bsd-3-clause": ("bsd 3 clause", "bsd 3 clause|new bsd|modified bsd|revised bsd|3 clause bsd"),
    "bsd-4-clause": ("bsd 4 clause", "bsd 4 clause|original bsd|4 clause bsd"),
    "0bsd": ("0bsd", "zero clause bsd|bsd zero clause"),
    "gpl-1.0": ("gpl 1 0(?: only| or later)?", "gnu general public license (?:version |v ?)?1(?: 0)?"),
    "gpl-2.0": ("gpl 2 0(?: only| or later)?", "gnu general public license (?:version |v ?)?2(?: 0)?"),
    "gpl-3.0": ("gpl 3 0(?: only| or later)?", "gnu general public license (?:version |v ?)?3(?: 0)?"),
    "gpl": ("gpl", "gnu general public|gnu gpl"),
    "lgpl-2.0": ("lgpl 2 0(?: only| or later)?", "gnu (?:library|lesser) general public license (?:version |v ?)?2(?: 0)?"),
    "lgpl-2.1": ("lgpl 2 1(?: only| or later)?", "gnu lesser general public license (?:version |v ?)?2 1"),
    "lgpl-3.0": ("lgpl 3 0(?: only| or later)?", "gnu lesser general public license (?:version |v ?)?3(?: 0)?"),
    "agpl-3.0": ("agpl 3 0(?: only| or later)?", "gnu affero general public license (?:version |v ?)?3(?: 0)?|gnu affero general public"),
    "gfdl": ("gfdl 1 [123](?: only| or later)?", "gnu free documentation"),
    "mpl-1.1": ("mpl 1 1", "mozilla public license (?:version |v ?)?1 1"),
    "mpl-2.0": ("mpl 2 0", "mozilla public license (?:version |v ?)?2(?: 0)?|mozilla public"),
    "epl-1.0": ("epl 1 0", "eclipse public license (?:version |v ?)?1(?: 0)?"),
    "epl-2.0": ("epl 2 0", "eclipse public license (?:version |v ?)?2(?: 0)?"),
    "eupl": ("eupl 1 [012]", "european union public"),
    "cddl": ("cddl 1 [01]", "common development and distribution"),
    "cpl-1.0": ("cpl 1 0", "common public"),
    "artistic-1.0": ("artistic 1 0", "artistic license 1(?: 0)?"),
    "artistic-2.0": ("artistic 2 0", "artistic license 2(?: 0)?|artistic"),
    "bsl-1.0": ("bsl 1 0", "boost software"),
    "isc": ("isc", "isc"),
    "zlib": ("zlib", "zlib(?: libpng)?"),
    "unlicense": ("unlicense", "the unlicense"),
    "wtfpl": ("wtfpl", "do what the (?:fuck )?you want to public"),
    "python": ("python 2 0|psf 2 0", "python software foundation"),
    "ruby": ("ruby", "ruby"),
    "php": ("php 3 0[01]?", "php"),
    "openssl": ("openssl", "openssl"),
    "postgresql": ("postgresql", "postgresql"),
    "ofl-1.1": ("ofl 1 1", "sil open font"),
    "odbl": ("odbl 1 0", "open database|odc open database"),
    "odc-by": ("odc by 1 0", "open data commons attribution"),
    "ms-pl": ("ms pl", "microsoft public"),
    "ms-rl": ("ms rl", "microsoft reciprocal"),
    "cc0": ("cc0 1 0", "cc0(?: 1 0)?"),
    "cc-by": ("cc by [1-4] [05]", "cc by(?: [1-4] [05])?"),
    "cc-by-sa": ("cc by sa [1-4] [05]", "cc by sa(?: [1-4] [05])?"),
    "cc-by-nd": ("cc by nd [1-4] [05]", "cc by nd(?: [1-4] [05])?"),
    "cc-by-nc": ("cc by nc [1-4] [05]", "cc by nc(?: [1-4] [05])?"),
    "cc-by-nc-sa": ("cc by nc sa [1-4] [05]", "cc by nc sa(?: [1-4] [05])?"),
    "cc-by-nc-nd": ("cc by nc nd [1-4] [05]", "cc by nc nd(?: [1-4] [05])?"),
}
_GRANT = "(?:licensed|released|distributed|available|published|provided|covered|governed|licenced)"
_TERMS = "(?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
#: Sentence frames around a license's names in order of priority: pattern, score, whether it takes the SPDX name.
FRAMES = (
    ("spdx license identifier (?:{})", 1.0, True),
    (_GRANT + " under " + _TERMS + "(?:{})(?: licen[cs]e)?(?: (?:version |v ?)[0-9](?: [0-9])?)?", 0.95, False),
    ("(?:subject to|according to|in accordance with) " + _TERMS + "(?:{})(?: licen[cs]e)", 0.9, False),
    ("under " + _TERMS + "(?:{}) licen[cs]e", 0.85, False),
    ("licen[cs]e (?:is )?(?:the )?(?:{}|{spdx})", 0.7, False),
    ("(?:{}) licen[cs]ed?", 0.6, False),
    ("(?:sous|bajo|sotto|sob) (?:la |a )?(?:licence|licencia|licenza) (?:{})", 0.85, False),
    ("unter (?:der |einer )?(?:{}) lizenz", 0.85, False),
)
#: Label (several are joined by +), words of a license's own text, notice, address or SPDX expression, score.
SIGNATURES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 1.0),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 1.0),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 0.95),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", 0.95),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", 0.95),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.9),
    ("apache-2", "apache org licenses license 2 0", 1.0),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.95),
    ("gpl-2.0", "gnu general public license as published by the free software foundation either version 2 of the license", 1.0),
    ("gpl-3.0", "gnu general public license as published by the free software foundation either version 3 of the license", 1.0),
    ("lgpl-2.1", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license", 1.0),
    ("agpl-3.0", "gnu affero general public license as published by the free software foundation either version 3 of the license", 1.0),
    ("gpl", "gnu org (?:licenses|copyleft) gpl(?: [123] 0)?", 0.95),
    ("lgpl", "gnu org licenses lgpl(?: [23] [01])?", 0.95),
    ("agpl-3.0", "gnu org licenses agpl(?: 3 0)?", 0.95),
    ("mpl-2.0", "mozilla org mpl 2 0", 1.0),
    ("mit", "opensource org licenses mit(?: license php)?", 1.0),
    ("bsd-3-clause", "opensource org licenses bsd 3 clause", 1.0),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause", 1.0),
    ("unlicense", "free and unencumbered software released into the public domain", 1.0),
    ("public-domain", "(?:released into|dedicated to|placed in|in) the public domain", 0.7),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 1.0),
    ("zlib", "provided as is without any express or implied warranty in no event will the authors be held liable", 0.9),
    ("cc0", "creativecommons org publicdomain zero 1 0", 1.0),
    ("cc-by", "creativecommons org licenses by [1-4] [05]", 1.0),
    ("cc-by-sa", "creativecommons org licenses by sa [1-4] [05]", 1.0),
    ("cc-by-nd", "creativecommons org licenses by nd [1-4] [05]", 1.0),
    ("cc-by-nc", "creativecommons org licenses by nc [1-4] [05]", 1.0),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa [1-4] [05]", 1.0),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd [1-4] [05]", 1.0),
    ("cc-by", "creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)? license", 0.95),
    ("cc-by-sa", "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?", 0.95),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:s|atives)(?: [1-4] [05])?(?: international| unported| generic)?", 0.95),
    ("cc-by-nc", "creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?", 0.95),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?", 0.95),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1-4] [05])?(?: international| unported| generic)?", 0.95),
    ("proprietary", "all rights reserved", 0.5),
    ("proprietary", "(?:confidential|proprietary) and (?:confidential|proprietary)", 0.6),
    ("proprietary", "may not be reproduced (?:distributed )?(?:or transmitted )?(?:in whole or in part )?without (?:the )?(?:prior )?(?:express )?(?:written )?permission", 0.6),
    # further sentences of license texts
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.95),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", 0.8),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", 1.0),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.9),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", 0.9),
    ("bsd", "this software is provided by the (?:copyright holders|regents|author|authors)(?: and contributors)? as is and any express or implied warranties", 0.85),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software", 0.9),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 1.0),
    ("apache-2", "you may not use this file except in compliance with the license", 0.85),
    ("apache-2", "apache license version 2 0 january 2004", 1.0),
    ("apache-2", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable", 1.0),
    ("apache-1.1", "this product includes software developed by the apache software foundation", 0.8),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty", 0.9),
    ("gpl", "you should have received a copy of the gnu general public license along with", 0.95),
    ("gpl", "the licenses for most software are designed to take away your freedom to share and change it", 1.0),
    ("gpl-2.0", "gnu general public license version 2 june 1991", 1.0),
    ("gpl-3.0", "gnu general public license version 3 29 june 2007", 1.0),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license along with", 0.95),
    ("lgpl-2.0", "gnu library general public license version 2 june 1991", 1.0),
    ("lgpl-2.1", "gnu lesser general public license version 2 1 february 1999", 1.0),
    ("lgpl-3.0", "gnu lesser general public license version 3 29 june 2007", 1.0),
    ("lgpl-3.0", "gnu lesser general public license as published by the free software foundation either version 3 of the license", 1.0),
    ("agpl-3.0", "gnu affero general public license version 3 19 november 2007", 1.0),
    ("agpl-3.0", "you should have received a copy of the gnu affero general public license along with", 0.95),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 1.0),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", 1.0),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0", 1.0),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("bsl-1.0", "distributed under the boost software license version 1 0", 1.0),
    ("zlib", "this software is provided as is without any express or implied warranty", 0.85),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 1.0),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", 1.0),
    ("wtfpl", "you just do what the fuck you want to", 1.0),
    ("cc0", "to the extent possible under law the (?:author|person who associated cc0)", 0.95),
    ("cc0", "no copyright the person who associated a work with this deed has dedicated the work to the public domain", 1.0),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", 1.0),
    ("odbl", "made available under the open database license", 1.0),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", 0.9),
    ("artistic-2.0", "you are permitted to use and distribute the package under the terms of the artistic license", 0.8),
    ("openssl", "this product includes software developed by the openssl project", 1.0),
    ("php", "this product includes php software freely available from", 1.0),
    ("python", "psf is making python available to licensee on an as is basis", 1.0),
    ("eupl", "licensed under the eupl version 1 [12]", 1.0),
    # addresses
    ("mit", "choosealicense com licenses mit", 0.95),
    ("apache-2", "(?:choosealicense com licenses apache|opensource org licenses apache|apache org licenses license) 2 0", 0.95),
    ("gpl", "(?:opensource org licenses gpl|fsf org licensing licenses gpl)", 0.95),
    ("isc", "opensource org licenses isc(?: license txt)?", 1.0),
    ("epl-2.0", "eclipse org legal epl 2 0", 1.0),
    ("epl-1.0", "eclipse org legal epl v10", 1.0),
    ("bsl-1.0", "boost org license 1 0", 1.0),
    ("unlicense", "unlicense org", 1.0),
    ("wtfpl", "wtfpl net", 1.0),
    ("ofl-1.1", "scripts sil org ofl", 1.0),
    ("odbl", "opendatacommons org licenses odbl", 1.0),
    ("odc-by", "opendatacommons org licenses by", 1.0),
    ("cc0", "creativecommons org licenses cc0", 0.95),
    # SPDX expressions of two licenses, with both labels
    ("apache-2+mit", "(?:spdx license identifier )?(?:apache 2 0 (?:or|and) mit|mit (?:or|and) apache 2 0)", 1.0),
    ("gpl-2.0+mit", "(?:spdx license identifier )?(?:gpl 2 0 (?:only|or later) (?:or|and) mit|mit (?:or|and) gpl 2 0 (?:only|or later))", 1.0),
    ("gpl-3.0+mit", "(?:spdx license identifier )?(?:gpl 3 0 (?:only|or later) (?:or|and) mit|mit (?:or|and) gpl 3 0 (?:only|or later))", 1.0),
    ("apache-2+gpl-2.0", "(?:spdx license identifier )?(?:apache 2 0 (?:or|and) gpl 2 0 (?:only|or later)|gpl 2 0 (?:only|or later) (?:or|and) apache 2 0)", 1.0),
    ("bsd-3-clause+gpl-2.0", "(?:spdx license identifier )?(?:bsd 3 clause (?:or|and) gpl 2 0 (?:only|or later)|gpl 2 0 (?:only|or later) (?:or|and) bsd 3 clause)", 1.0),
    ("apache-2+bsd-3-clause", "(?:spdx license identifier )?(?:apache 2 0 (?:or|and) bsd 3 clause|bsd 3 clause (?:or|and) apache 2 0)", 1.0),
    ("mit+unlicense", "(?:spdx license identifier )?(?:mit (?:or|and) unlicense|unlicense (?:or|and) mit)", 1.0),
    ("bsd-3-clause+mit", "(?:spdx license identifier )?(?:bsd 3 clause (?:or|and) mit|mit (?:or|and) bsd 3 clause)", 1.0),
    ("gpl-2.0+mpl-2.0", "(?:spdx license identifier )?(?:gpl 2 0 (?:only|or later) (?:or|and) mpl 2 0|mpl 2 0 (?:or|and) gpl 2 0 (?:only|or later))", 1.0),
    ("apache-2+lgpl-2.1", "(?:spdx license identifier )?(?:apache 2 0 (?:or|and) lgpl 2 1 (?:only|or later)|lgpl 2 1 (?:only|or later) (?:or|and) apache 2 0)", 1.0),
    ("classpath-exception", "with classpath exception(?: 2 0)?", 0.95),
    ("llvm-exception", "with llvm exceptions?", 0.95),
    ("gcc-exception", "with gcc (?:runtime library )?exception(?: [23] [01])?", 0.95),
    ("linux-syscall-note", "with linux syscall note", 0.95),
    # notices in other languages, and of closed texts
    ("public-domain", "(?:gemeinfreies werk|dans le domaine public|en el dominio público|de dominio público)", 0.7),
    ("proprietary", "(?:tous droits réservés|alle rechte vorbehalten|todos los derechos reservados|tutti i diritti riservati)", 0.5),
    ("proprietary", "(?:reproduction interdite|nachdruck verboten|prohibida su reproducción|prohibida la reproducción)", 0.6),
    ("proprietary", "unauthorized (?:copying|use|reproduction|distribution) of this (?:file|document|software|work|material) is (?:strictly )?prohibited", 0.6),
    ("proprietary", "no part of this (?:publication|document|book|work|site) may be reproduced", 0.6),
    ("proprietary", "for internal use only", 0.5),
    ("proprietary", "this (?:software|document) is the (?:confidential and )?proprietary (?:information|property) of", 0.7),
    ("non-commercial", "for (?:personal|private|research|educational)(?: and| or)? non ?commercial use only", 0.6),
    ("non-commercial", "free for non ?commercial use", 0.6),
)
MOST, LOOK_BACK, BESIDE = 512, 16_384, 256


def gates(pattern: str) -> list[list[str]]:
    """Lists of strings, the most telling first: any match of the pattern holds a string of each list.

    A list is a run of plain characters outside of optional parts, or one for each branch of
    a group. What always follows a space has it before it, so that it begins a word.
    """

    def lists(tree, spaced: bool) -> tuple[list[list[str]], bool]:
        """The lists, and whether a space always stands at the end; spaced: one stands before."""
        out, run = [], ""
        for op, arg in [*tree, (None, None)]:
            if str(op) == "LITERAL":
                run = (run or (" " if spaced and arg != 32 else "")) + chr(arg)
                spaced = arg == 32
                continue
            out, run = ([*out, [run]] if run else out), ""
            if str(op) == "SUBPATTERN":
                more, spaced = lists(arg[-1], spaced)
                out += more
            elif str(op) == "BRANCH":
                ways = [lists(way, spaced) for way in arg[1]]
                spaced = all(end for _, end in ways)
                if all(found for found, _ in ways):
                    out.append(sorted({x for found, _ in ways for x in max(found, key=telling)}))
            elif str(op) == "MAX_REPEAT" and arg[:2] == (0, 1):
                spaced = spaced and lists(arg[2], spaced)[1]
            elif op is not None:
                spaced = False
        return out, spaced

    telling = lambda x: min(map(len, x))
    return sorted(lists(parser.parse(pattern), False)[0], key=telling, reverse=True)


def anchors(own: list[Rule]) -> str:
    """A regex that finds something in each text that holds a match of one of the rules: beginnings of words, as a tree of characters."""
    found = set()
    for r in own:
        # the most telling list of strings that begin a word; 16 characters tell enough
        found.update(x[:16] for x in next(g for g in gates(r.pattern) if all(x[0] == " " for x in g)))
    found = {x for x in found if not any(y != x and x.startswith(y) for y in found)}

    def tree(ends: list[str]) -> str:
        if "" in ends:
            return ""
        ways = [c + tree([x[1:] for x in ends if x[0] == c]) for c in sorted({x[0] for x in ends})]
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return tree(sorted(found))


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    score: float


def rules() -> list[Rule]:
    """All rules, the best first: signatures, then the frames in order, in each the licenses in order of LICENSES."""
    out = [Rule(label, f" {p} ", score) for label, p, score in SIGNATURES]
    for frame, score, by_spdx in FRAMES:
        for label, (spdx, names) in LICENSES.items():
            out.append(Rule(label, " " + frame.replace("{spdx}", spdx).replace("{}", spdx if by_spdx else names) + " ", score))
    return out


def in_words(text: Column) -> Column:
    """The text's words with one space between and around them; one space where there are none."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(F.translate(text, _FROM, _TO), F.lit(" ")), " +", " ")))


def _spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def _base(t: Column, n_words: Column) -> Column:
    """For each base phrase that occurs: label, places, first and last word."""
    one = []
    for phrase, label in BASE.items():
        pieces = F.split(t, f" {phrase}(?= )", -1)
        last = n_words - len(phrase.split()) - (_spaces(F.element_at(pieces, -1)) - 1)
        found = F.struct(F.lit(label).alias("label"), (F.size(pieces) - 1).cast("long").alias("n"), _spaces(F.element_at(pieces, 1)).alias("first"), last.alias("last"))
        one.append(F.when(F.contains(t, F.lit(f" {phrase} ")), F.array(found)).otherwise(F.array().cast("array<struct<label:string,n:bigint,first:bigint,last:bigint>>")))
    return F.concat(*one)


def _detected(t: Column, own: list[Rule]) -> Column:
    """All rules' matches without the spaces around them as (start, less = -end, rule, score, label), sorted."""
    # one parsed expression: a call for each literal would take longer than the scan of a small table
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    array = lambda xs, kind: f"cast(array({', '.join(xs)}) as array<{kind}>)"
    own_gates = lambda r: array([array(map(text, x), "string") for x in gates(r.pattern) if min(map(len, x)) > 2], "array<string>")
    table = F.expr(f"array({', '.join(f"named_struct('rule', {i}, 'label', {text(r.label)}, 'gates', {own_gates(r)}, 'pattern', {text(r.pattern)}, 'score', {r.score}D)" for i, r in enumerate(own))})")
    gated = F.filter(table, lambda r: F.forall(r["gates"], lambda x: F.exists(x, lambda g: F.contains(t, g))))

    def of(r: Column) -> Column:
        found = located(t, r["pattern"], matches_of(t, r["pattern"]), 1)
        return F.transform(found, lambda m: F.struct((m["start"] + 1).alias("start"), (1 - m["end"]).alias("less"), r["rule"].alias("rule"), r["score"].alias("score"), r["label"].alias("label")))

    return F.array_sort(F.flatten(F.transform(gated, of)))


def _outer(s: Column) -> Column:
    """Those of sorted matches that no earlier one holds."""
    around = lambda x, i: F.exists(F.slice(s, F.greatest(i - LOOK_BACK + 1, F.lit(1)), F.least(i, F.lit(LOOK_BACK))), lambda b: b["less"] <= x["less"])
    return F.filter(s, lambda x, i: F.when(i == 0, F.lit(True)).otherwise(~around(x, i)))


def _ranked(s: Column) -> Column:
    """Of sorted matches, none within another, those that stay in order of priority: a match stays unless it overlaps one of a smaller rule number that stayed.

    A rule's own matches don't overlap, so each of the rules found is settled in one step.
    Starts and ends both rise: what overlaps a match is among the BESIDE before and after it.
    """
    overlap = lambda x, y: (x["start"] < -y["less"]) & (y["start"] < -x["less"])
    clash = F.exists(F.transform(s, lambda x, i: F.coalesce(F.get(s, i + 1)["start"] < -x["less"], F.lit(False))), lambda c: c)

    def settle(own: Column, rule: Column) -> Column:
        """state 0 is open, 1 stays, 2 goes."""
        near = lambda i: F.slice(own, F.greatest(i + 1 - BESIDE, F.lit(1)), F.lit(2 * BESIDE + 1))
        hit = lambda x, i: F.exists(near(i), lambda y: (y["state"] == 0) & (y["m"]["rule"] == rule) & overlap(x["m"], y["m"]))
        state = lambda x, i: F.when(x["state"] != 0, x["state"]).when(x["m"]["rule"] == rule, F.lit(1)).when(hit(x, i), F.lit(2)).otherwise(F.lit(0))
        return F.transform(own, lambda x, i: F.struct(x["m"].alias("m"), state(x, i).alias("state")))

    found = F.array_sort(F.array_distinct(F.transform(s, lambda x: x["rule"])))
    settled = F.aggregate(found, F.transform(s, lambda x: F.struct(x.alias("m"), F.lit(0).alias("state"))), settle)
    return F.when(clash, F.transform(F.filter(settled, lambda x: x["state"] == 1), lambda x: x["m"])).otherwise(s)


def scan(docs: DataFrame, own: list[Rule] | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents with n_words, base (label, n, first, last) and detections (start, less, rule, score, label)."""
    own = rules() if own is None else own
    names = ["n_words", "base", "detections"]
    out = [c for c in (docs.columns if keep is None else keep) if c not in names]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in out], F.lit(0).alias("__none")).alias("__row"), in_words(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("__t"))
    t = F.col("__t")
    df = df.select("__row", "__t", (_spaces(t) - 1).alias("n_words"), t.rlike(anchors(own)).alias("__gate"))
    none = F.array().cast("array<struct<start:bigint,less:bigint,rule:int,score:double,label:string>>")
    df = df.select("__row", "n_words", _base(t, F.col("n_words")).alias("base"), F.when(F.col("__gate"), _detected(t, own)).otherwise(none).alias("__all"))
    df = df.select("__row", "n_words", "base", _outer(F.col("__all")).alias("__outer"))
    df = df.select("__row", "n_words", "base", _ranked(F.col("__outer")).alias("detections"))
    return df.select(*[F.col("__row")[c].alias(c) for c in out], *names)


def op5(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    labels = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda x: x["score"])), F.lit(0.0)), F.when(F.size("base") > 0, BASE_SCORE).otherwise(0.0))
    return found.select(
        "doc_id", "n_words", F.aggregate("base", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_base"), F.array_min(F.transform("base", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["last"])).alias("last_word"), joined(labels("base")).alias("base_labels"), joined(F.concat(labels("base"), F.flatten(F.transform("detections", lambda x: F.split(x["label"], "[+]"))))).alias("labels"), best.alias("score"),
    )


def _sql5() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    hits = " union all ".join(f"select row_no, {i} rule, {q(r.label)} label, cast({r.score} as double) score, regexp_extract_all(t, {q(r.pattern)}) ms, string_split_regex(t, {q(r.pattern)}) ps from t where regexp_matches(t, {q(r.pattern)})" for i, r in enumerate(rules()))
    base = ", ".join(f"({q(p)}, {len(p.split())}, {q(label)})" for p, label in BASE.items())
    return rf"""
with recursive d as (select doc_id, row_number() over () row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
t as materialized (select doc_id, row_no, w, case when len(w) = 0 then ' ' else ' ' || array_to_string(w, ' ') || ' ' end t from d),
phrases(phrase, k, label) as (values {base}),
places as (
    select row_no, label, i - 1 p from (select row_no, w, label, phrase, k, unnest(range(1, len(w) - k + 2)) i from t join phrases on contains(t, ' ' || phrase || ' '))
    where array_to_string(w[i:i + k - 1], ' ') = phrase),
b as (select row_no, count(*) n_base, min(p) first_word, max(p) last_word, list(distinct label) ls from places group by 1),
hit as materialized ({hits}),
m as (
    select row_no, rule, label, score, length(ms[i]) n, coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) s
    from (select *, unnest(range(1, len(ms) + 1)) i from hit)),
x as (select row_no, rule, label, score, s + 1 s, s + n - 1 e from m),
o as materialized (
    select *, row_number() over (partition by row_no order by rule, s) k from x
    where not exists (select 1 from x y where y.row_no = x.row_no and y.s <= x.s and y.e >= x.e and (y.s < x.s or y.e > x.e or y.rule < x.rule))),
g(row_no, k, kept) as (
    select distinct row_no, cast(0 as bigint), cast([] as struct(s bigint, e bigint, label varchar, score double)[]) from o
    union all
    select o.row_no, o.k, case when len(list_filter(kept, lambda z: z.s < o.e and o.s < z.e)) = 0 then list_append(kept, {{'s': cast(o.s as bigint), 'e': cast(o.e as bigint), 'label': o.label, 'score': o.score}}) else kept end
    from g join o on o.row_no = g.row_no and o.k = g.k + 1),
f as (select row_no, list_distinct(flatten(list_transform(kept, lambda z: string_split(z.label, '+')))) ls, list_max(list_transform(kept, lambda z: z.score)) score from (select *, max(k) over (partition by row_no) last from g) where k = last)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_base, 0) n_base, first_word, last_word, coalesce(array_to_string(list_sort(b.ls), ','), '') base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(f.ls, [])))), ','), '') labels, greatest(coalesce(cast(f.score as double), 0), case when b.ls is null then 0 else {BASE_SCORE} end) score
from t left join b using (row_no) left join f using (row_no)
"""


SQL5 = _sql5()
