"""License scans by ordered signature rules, in DataFrame functions only.

A text becomes a line of lower-case words, one space between them. Rules are regular expressions
over that line; each names a word sequence that it cannot match without (its keyword), so a rule
is tried only where its keyword stands. They are SPDX identifiers behind their tag, sentences of
license bodies and standard notices, and names of licenses; what stands before a name gives its weight. Detections inside a larger detection, or inside an equal
one of an earlier rule, are suppressed. The line is looked at in windows of fixed length that
overlap by more than any rule can match (longer rules are refused), and a detection counts in the window where it starts, so
work per text is linear in its length. Nothing is shuffled.

Defined results: a null text is an empty one; a text without words has ``n_words`` 0 and no labels;
repeated rows each get their result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakemoor.llm.common import query, table, texts_of

# Everything that no word holds; letters are lowered after the split.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# The phrases whose places are counted, and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Label, then its names as word patterns; the first word sequence free of pattern signs is the keyword.
NAMES = (
    ("mit", "mit license", "expat license", "x11 license"),
    ("apache-2", "apache(?: software)? license (?:version |v)?2", "apache 2 0 license", "apache 2 0"),
    ("apache-1", "apache(?: software)? license (?:version |v)?1"),
    ("bsd-2-clause", "bsd 2 clause(?: license)?", "2 clause bsd(?: license)?", "simplified bsd license", "freebsd license"),
    ("bsd-3-clause", "bsd 3 clause(?: license)?", "3 clause bsd(?: license)?", "new bsd license", "modified bsd license"),
    ("bsd-4-clause", "bsd 4 clause(?: license)?", "original bsd license"),
    ("bsd", "bsd license", "bsd style license"),
    ("gpl-3", "gnu general public license (?:version |v)3", "(?:gnu )?gpl ?v ?3", "(?:gnu )?gpl 3 0"),
    ("gpl-2", "gnu general public license (?:version |v)2", "(?:gnu )?gpl ?v ?2", "(?:gnu )?gpl 2 0"),
    ("gpl-1", "gnu general public license (?:version |v)1", "(?:gnu )?gpl ?v ?1", "(?:gnu )?gpl 1 0"),
    ("gpl", "gnu general public license", "gnu gpl", "gpl license"),
    ("lgpl-3", "gnu lesser general public license (?:version |v)3", "(?:gnu )?lgpl ?v ?3", "lgpl 3 0"),
    ("lgpl-2-1", "gnu lesser general public license (?:version |v)2 1", "(?:gnu )?lgpl ?v ?2 1", "lgpl 2 1"),
    ("lgpl-2", "gnu library general public license (?:version |v)2", "lgpl 2 0"),
    ("lgpl", "gnu lesser general public license", "gnu library general public license", "gnu lgpl"),
    ("agpl-3", "gnu affero general public license (?:version |v)3", "(?:gnu )?agpl ?v ?3", "agpl 3 0"),
    ("agpl", "gnu affero general public license", "affero general public license", "gnu agpl"),
    ("gfdl", "gnu free documentation license", "gfdl 1 [123]"),
    ("mpl-2", "mozilla public license (?:version |v)?2", "mpl 2 0"),
    ("mpl-1-1", "mozilla public license (?:version |v)?1 1", "mpl 1 1"),
    ("mpl", "mozilla public license"),
    ("epl-2", "eclipse public license (?:version |v)?2", "epl 2 0"),
    ("epl-1", "eclipse public license (?:version |v)?1", "epl 1 0"),
    ("epl", "eclipse public license"),
    ("cddl", "common development and distribution license", "cddl 1 [01]"),
    ("cpl", "common public license", "cpl 1 0"),
    ("eupl", "european union public licence", "european union public license", "eupl 1 [012]"),
    ("ms-pl", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft reciprocal license", "ms rl"),
    ("artistic-2", "artistic license (?:version |v)?2", "artistic 2 0"),
    ("artistic", "artistic license"),
    ("zlib", "zlib license", "zlib libpng license"),
    ("libpng", "libpng license"),
    ("boost-1", "boost software license", "bsl 1 0"),
    ("busl", "business source license", "busl 1 1"),
    ("isc", "isc license"),
    ("wtfpl", "do what the fuck you want to public license", "wtfpl"),
    ("unlicense", "unlicense", "the unlicense"),
    ("cc0", "cc0", "cc0 1 0 universal", "cc zero"),
    ("cc-by-nc-sa", "cc by nc sa", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "cc by nc nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s"),
    ("cc-by-nc", "cc by nc", "creative commons attribution non ?commercial"),
    ("cc-by-sa", "cc by sa", "creative commons attribution share ?alike"),
    ("cc-by-nd", "cc by nd", "creative commons attribution no ?deriv(?:ative)?s"),
    ("cc-by", "cc by [1234]", "creative commons attribution"),
    ("cc", "creative commons license", "creative commons"),
    ("ofl", "sil open font license", "open font license", "ofl 1 1"),
    ("postgresql", "postgresql license"),
    ("psf", "python software foundation license", "psf license"),
    ("ruby", "ruby license"),
    ("php", "php license"),
    ("perl", "same terms as perl itself"),
    ("openssl", "openssl license"),
    ("ncsa", "university of illinois ncsa open source license", "ncsa license"),
    ("afl", "academic free license", "afl 3 0"),
    ("osl", "open software license", "osl 3 0"),
    ("ecl", "educational community license", "ecl 2 0"),
    ("sspl", "server side public license", "sspl 1 0"),
    ("elastic", "elastic license"),
    ("json", "json license", "shall be used for good not evil"),
    ("vim", "vim license"),
    ("w3c", "w3c software license", "w3c software notice and license"),
    ("zpl", "zope public license"),
    ("odbl", "open database license", "odbl 1 0"),
    ("odc-by", "open data commons attribution license"),
    ("public-domain", "in the public domain", "into the public domain", "public domain dedication"),
    ("all-rights-reserved", "all rights reserved"),
)

# What may stand before a name, and the weight of a detection found that way.
GRANT = "(?:licensed|released|distributed|available|provided|published|redistribute it)"
TEMPLATES = (
    (1.0, "spdx license identifier {name}"),
    (0.9, GRANT + " under (?:the )?(?:terms of )?(?:the )?{name}"),
    (0.7, "under (?:the )?(?:terms of )?(?:the )?{name}"),
    (0.5, "{name}"),
)


# Label, then SPDX identifiers; each is a rule of its own behind the tag, or behind "or", "and" or "with" in its expression.
SPDX = (
    ("mit", "MIT", "X11", "MIT-Modern-Variant", "MIT-feh", "MIT-advertising"),
    ("mit-0", "MIT-0"),
    ("apache-2", "Apache-2.0"),
    ("apache-1", "Apache-1.0", "Apache-1.1"),
    ("0bsd", "0BSD"),
    ("bsd-1-clause", "BSD-1-Clause"),
    ("bsd-2-clause", "BSD-2-Clause", "BSD-2-Clause-Patent", "BSD-2-Clause-Views", "BSD-2-Clause-FreeBSD"),
    ("bsd-3-clause", "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-3-Clause-LBNL", "BSD-3-Clause-Attribution"),
    ("bsd-4-clause", "BSD-4-Clause", "BSD-4-Clause-UC"),
    ("bsd", "BSD-Source-Code", "BSD-Protection"),
    ("gpl-3", "GPL-3.0", "GPL-3.0+", "GPL-3.0-only", "GPL-3.0-or-later"),
    ("gpl-2", "GPL-2.0", "GPL-2.0+", "GPL-2.0-only", "GPL-2.0-or-later"),
    ("gpl-1", "GPL-1.0", "GPL-1.0+", "GPL-1.0-only", "GPL-1.0-or-later"),
    ("lgpl-3", "LGPL-3.0", "LGPL-3.0+", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    ("lgpl-2-1", "LGPL-2.1", "LGPL-2.1+", "LGPL-2.1-only", "LGPL-2.1-or-later"),
    ("lgpl-2", "LGPL-2.0", "LGPL-2.0+", "LGPL-2.0-only", "LGPL-2.0-or-later"),
    ("agpl-3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    ("agpl", "AGPL-1.0", "AGPL-1.0-only", "AGPL-1.0-or-later"),
    ("gfdl", "GFDL-1.1", "GFDL-1.2", "GFDL-1.3", "GFDL-1.1-only", "GFDL-1.2-only", "GFDL-1.3-only",
     "GFDL-1.1-or-later", "GFDL-1.2-or-later", "GFDL-1.3-or-later"),
    ("mpl-2", "MPL-2.0", "MPL-2.0-no-copyleft-exception"),
    ("mpl-1-1", "MPL-1.1"),
    ("mpl", "MPL-1.0"),
    ("epl-2", "EPL-2.0"),
    ("epl-1", "EPL-1.0"),
    ("cddl", "CDDL-1.0", "CDDL-1.1"),
    ("cpl", "CPL-1.0"),
    ("eupl", "EUPL-1.0", "EUPL-1.1", "EUPL-1.2"),
    ("ms-pl", "MS-PL"),
    ("ms-rl", "MS-RL"),
    ("artistic-2", "Artistic-2.0"),
    ("artistic", "Artistic-1.0", "Artistic-1.0-Perl", "Artistic-1.0-cl8", "ClArtistic"),
    ("zlib", "Zlib", "zlib-acknowledgement"),
    ("libpng", "Libpng", "libpng-2.0"),
    ("boost-1", "BSL-1.0"),
    ("busl", "BUSL-1.1"),
    ("isc", "ISC"),
    ("wtfpl", "WTFPL"),
    ("unlicense", "Unlicense"),
    ("cc0", "CC0-1.0"),
    ("cc-by-nc-sa", *(f"CC-BY-NC-SA-{n}" for n in ("1.0", "2.0", "2.5", "3.0", "4.0"))),
    ("cc-by-nc-nd", *(f"CC-BY-NC-ND-{n}" for n in ("1.0", "2.0", "2.5", "3.0", "4.0"))),
    ("cc-by-nc", *(f"CC-BY-NC-{n}" for n in ("1.0", "2.0", "2.5", "3.0", "4.0"))),
    ("cc-by-sa", *(f"CC-BY-SA-{n}" for n in ("1.0", "2.0", "2.5", "3.0", "4.0"))),
    ("cc-by-nd", *(f"CC-BY-ND-{n}" for n in ("1.0", "2.0", "2.5", "3.0", "4.0"))),
    ("cc-by", *(f"CC-BY-{n}" for n in ("1.0", "2.0", "2.5", "3.0", "4.0"))),
    ("ofl", "OFL-1.0", "OFL-1.1", "OFL-1.1-RFN", "OFL-1.1-no-RFN"),
    ("postgresql", "PostgreSQL"),
    ("psf", "PSF-2.0", "Python-2.0", "Python-2.0.1"),
    ("ruby", "Ruby"),
    ("php", "PHP-3.0", "PHP-3.01"),
    ("openssl", "OpenSSL", "OpenSSL-standalone", "SSLeay-standalone"),
    ("ncsa", "NCSA"),
    ("afl", "AFL-1.1", "AFL-1.2", "AFL-2.0", "AFL-2.1", "AFL-3.0"),
    ("osl", "OSL-1.0", "OSL-1.1", "OSL-2.0", "OSL-2.1", "OSL-3.0"),
    ("ecl", "ECL-1.0", "ECL-2.0"),
    ("sspl", "SSPL-1.0"),
    ("elastic", "Elastic-2.0"),
    ("json", "JSON"),
    ("vim", "Vim"),
    ("w3c", "W3C", "W3C-19980720", "W3C-20150513"),
    ("zpl", "ZPL-1.1", "ZPL-2.0", "ZPL-2.1"),
    ("odbl", "ODbL-1.0"),
    ("odc-by", "ODC-By-1.0"),
    ("curl", "curl"),
    ("hpnd", "HPND", "HPND-sell-variant"),
    ("ntp", "NTP"),
    ("upl", "UPL-1.0"),
    ("blueoak", "BlueOak-1.0.0"),
    ("beerware", "Beerware"),
    ("bzip2", "bzip2-1.0.6"),
    ("icu", "ICU"),
    ("unicode", "Unicode-3.0", "Unicode-DFS-2015", "Unicode-DFS-2016"),
    ("ftl", "FTL"),
    ("ijg", "IJG"),
    ("tcl", "TCL"),
    ("ipl", "IPL-1.0"),
    ("cecill", "CECILL-1.0", "CECILL-2.0", "CECILL-2.1", "CECILL-B", "CECILL-C"),
    ("mulan", "MulanPSL-1.0", "MulanPSL-2.0"),
    ("pddl", "PDDL-1.0"),
    ("cdla", "CDLA-Permissive-1.0", "CDLA-Permissive-2.0", "CDLA-Sharing-1.0"),
)
TAG = "spdx license identifier"

# Label, then sentences of its body and its standard notices, none longer than MARGIN.
LICENSE = "licen[cs]e"
BODIES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
     " documentation files"),
    ("boost-1", "permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy of the"
     " software and accompanying documentation covered by this license"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is"
     " hereby granted provided that the above copyright notice"),
    ("0bsd", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is"
     " hereby granted the software is provided"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose"
     " without fee and without a written agreement is hereby granted"),
    ("hpnd", "permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any"
     " purpose(?: and| is hereby granted)? without fee"),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose with or"
     " without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
     " the following conditions are met"),
    ("bsd-2-clause", "the views and conclusions contained in the software and documentation are those of the authors and"
     " should not be interpreted as representing official policies"),
    ("bsd-3-clause", "nor the names? of (?:its|the|any|other) contributors may be used to endorse or promote products"
     " derived from this software", "the name of the author may not be used to endorse or promote products derived from"
     " this software"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following"
     " acknowledge?ment"),
    ("ncsa", "redistributions of source code must retain the above copyright notice this list of conditions and the"
     " following disclaimers"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"
     " (?:https? )?www apache org licenses license 2 0", "apache license version 2 0 january 2004"),
    ("apache-1", "this product includes software developed by the apache (?:software foundation|group)"),
    ("gpl-3", "gnu general public license as published by the free software foundation (?:either )?version 3",
     "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2", "gnu general public license as published by the free software foundation (?:either )?version 2",
     "gnu general public license version 2 as published by the free software foundation",
     "the gnu general public license is intended to guarantee your freedom to share and change free software"),
    ("gpl-1", "gnu general public license as published by the free software foundation (?:either )?version 1"),
    ("lgpl-3", "gnu lesser general public license as published by the free software foundation (?:either )?version 3",
     "this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("lgpl-2-1", "gnu lesser general public license as published by the free software foundation (?:either )?version 2 1",
     "this is the first released version of the lesser gpl"),
    ("lgpl-2", "gnu library general public license as published by the free software foundation (?:either )?version 2",
     "this is the first released version of the library gpl"),
    ("agpl-3", "gnu affero general public license as published by the free software foundation (?:either )?version 3",
     "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free"
     " documentation license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
     "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1-1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", "the accompanying program is provided under the terms of this eclipse public license"),
    ("cpl", "the accompanying program is provided under the terms of this common public license"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl", "licensed under the eupl"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("artistic-2", "this license establishes the terms under which a given free software package may be copied modified"
     " distributed and or redistributed"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors? be held"
     " liable for any damages arising from the use of this software", "altered source versions must be plainly marked as"
     " such and must not be misrepresented as being the original software"),
    ("libpng", "this copy of the libpng notices is provided for your convenience"),
    ("busl", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non"
     " production use of the licensed work"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and"
     " changing it is allowed as long as the name is changed"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "waived all copyright and related or neighbou?ring rights"),
    ("ofl", "the goals of the open font license ofl are to stimulate worldwide development"),
    ("psf", "this license agreement is between the python software foundation"),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("php", "this product includes php software freely available from"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit",
     "this product includes cryptographic software written by eric young"),
    ("elastic", "you may not provide the software to third parties as a hosted or managed service"),
    ("vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("w3c", "by obtaining using and or copying this work you the licensee agree that you have read understood"),
    ("beerware", "if we meet some ?day and you think this stuff is worth it you can buy me a beer in return"),
)


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches whole words of a line; ``keyword`` stands in every match."""

    label: str
    weight: float
    keyword: str
    pattern: str


def _keyword(name: str) -> str:
    """The longest part of a name that holds no pattern signs."""
    plain, depth, parts = "", 0, []
    for at, sign in enumerate(name):
        depth += (sign in "([") - (sign in ")]")
        optional = name[at + 1 : at + 2] == "?"
        if depth or sign in ")]?|" or optional:
            parts.append(plain)
            plain = ""
        else:
            plain += sign
    return max([*parts, plain], key=len).strip()


def _spelled(pattern: str) -> str:
    """``pattern`` for "license" and "licence" alike."""
    return pattern.replace(LICENSE, "license").replace("licence", "license").replace("license", LICENSE)


def _words(identifier: str) -> str:
    return re.sub("[^a-z0-9]+", " ", identifier.lower()).strip()


def signature_rules() -> tuple[Rule, ...]:
    """The base phrases first, then identifiers, bodies, and every name in every template, strongest template first."""
    rules = [Rule(label, 1.0, phrase, phrase) for phrase, label in BASE.items()]
    for label, *identifiers in SPDX:
        words = dict.fromkeys(map(_words, identifiers))
        rules += [Rule(label, 1.0, TAG, f"{TAG} {one}") for one in words]
    for label, *sentences in BODIES:
        rules += [Rule(label, 1.0, _keyword(_spelled(one)), _spelled(one)) for one in sentences]
    for weight, template in TEMPLATES:
        for label, *names in NAMES:
            spelled = dict.fromkeys(map(_spelled, names))
            rules += [Rule(label, weight, _keyword(one), _spelled(template.format(name=one))) for one in spelled]
    return tuple(rules)


CORE, MARGIN = 1000, 200  # characters: a window's own part, and what it sees on either side


def line_of_words(text: Column) -> Column:
    """The words in lower case, one space before, between and behind them."""
    return F.lower(F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), NOT_WORD, " "))


def expression_labels(line: Column) -> Column:
    """The labels of all identifiers in the SPDX expressions of a line, however long those are.

    An expression is what stands behind the tag: identifiers, or, and, with, up to the first other word.
    """
    label_of = {_words(one): label for label, *identifiers in SPDX for one in identifiers}
    known = "|".join(sorted(label_of, key=len, reverse=True))
    # Possessive repetition: one step after the other, without a way back to remember.
    expressions = F.regexp_extract_all(line, F.lit(f"(?<= ){TAG} ((?:(?:{known}|or|and|with) )++)"), F.lit(1))
    met = F.flatten(
        F.transform(expressions, lambda one: F.regexp_extract_all(F.concat(F.lit(" "), one), F.lit(f"(?<= )({known})(?= )"), F.lit(1)))
    )
    labels = F.create_map(*[F.lit(text) for pair in label_of.items() for text in pair])
    found = F.transform(F.array_distinct(met), lambda one: F.element_at(labels, one))
    none = F.array().cast("array<string>")
    return F.when(line.contains(f" {TAG} "), F.array_distinct(found)).otherwise(none)


def _longest(pattern: str) -> int:
    """The most characters that a pattern can match."""
    return re._parser.parse(pattern).getwidth()[1]


def _spaces(line: Column) -> Column:
    return F.char_length(line) - F.char_length(F.replace(line, F.lit(" "), F.lit("")))


def _whole(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def _base_places(line: Column, phrase: str) -> Column:
    """Number, first and last word position of the places of ``phrase``: what stands between tells."""
    between = F.split(line, _whole(phrase), -1)
    inner = phrase.count(" ")
    n = F.size(between) - 1
    last = _spaces(line) - _spaces(F.element_at(between, -1)) - inner - 1
    return F.when(
        F.col("anchored") & line.contains(f" {phrase} "),
        F.struct(n.alias("n"), (_spaces(between[0]) - 1).alias("first"), last.alias("last")),
    )


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _detections(window: Column, origin: Column, rule: Column) -> Column:
    """All places of one rule in one window, as (start, stop, label, weight, rank)."""
    gaps = F.transform(F.split(window, rule.pattern, -1), F.char_length)
    lengths = F.transform(F.regexp_extract_all(window, rule.pattern, F.lit(0)), F.char_length)

    def step(done: Column, place: Column) -> Column:
        start = done.at + place.gaps
        stop = start + place.lengths
        one = F.struct(
            (origin + start).alias("start"),
            (origin + stop).alias("stop"),
            rule.label.alias("label"),
            rule.weight.alias("weight"),
            rule["rank"].alias("rank"),
        )
        return F.struct(F.array_append(done.found, one).alias("found"), stop.cast("int").alias("at"))

    none = "array<struct<start: int, stop: int, label: string, weight: double, rank: int>>"
    start = F.struct(F.array().cast(none).alias("found"), F.lit(0).alias("at"))
    # One gap stands before each match, and one behind the last, which has no length.
    places = F.filter(F.arrays_zip(gaps.alias("gaps"), lengths.alias("lengths")), lambda one: one.lengths.isNotNull())
    return F.aggregate(places, start, step, lambda done: done.found)


def _surviving(found: Column) -> Column:
    """Without detections inside a longer one, or inside an equal one of an earlier rule."""

    def beaten(one: Column, other: Column) -> Column:
        inside = (other.start <= one.start) & (other.stop >= one.stop)
        longer = (other.stop - other.start) > (one.stop - one.start)
        return inside & (longer | (other["rank"] < one["rank"]))

    return F.filter(found, lambda one: ~F.exists(found, lambda other: beaten(one, other)))


def detections(line: Column, rules: tuple[Rule, ...]) -> Column:
    """The surviving detections in ``line`` (see :func:`line_of_words`), by start."""
    by_keyword: dict[str, list[Column]] = {}
    for rank, rule in enumerate(rules):
        told = {"label": rule.label, "weight": rule.weight, "pattern": _whole(rule.pattern), "rank": rank}
        one = F.struct(*[F.lit(value).alias(name) for name, value in told.items()])
        by_keyword.setdefault(rule.keyword, []).append(one)
    gated = F.array(
        *[F.struct(F.lit(word).alias("keyword"), F.array(*own).alias("rules")) for word, own in by_keyword.items()]
    )
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(line) - 1, F.lit(0)), F.lit(CORE))

    def in_window(core: Column) -> Column:
        origin = F.greatest(core - MARGIN, F.lit(0))
        window = line.substr(origin + 1, core - origin + CORE + MARGIN)
        surviving = _with(_with(window, lambda one: in_text(one, origin)), _surviving)
        return F.filter(surviving, lambda one: (one.start >= core) & (one.start < core + CORE))

    def in_text(window: Column, origin: Column) -> Column:
        present = F.flatten(
            F.transform(F.filter(gated, lambda one: F.contains(window, one.keyword)), lambda one: one.rules)
        )
        return F.flatten(F.transform(present, lambda rule: _detections(window, origin, rule)))

    return F.array_sort(F.flatten(F.transform(starts, in_window)))


# Parts that many keywords have in common.
COMMON = ("licen", "gpl", "creative commons", "public domain", "clause", "this software", "hereby granted", "apache")


def anchors_of(rules: tuple[Rule, ...]) -> tuple[str, ...]:
    """Where none of these stands in a line, no keyword of ``rules`` and no base phrase can."""
    keywords = [*BASE, *[rule.keyword for rule in rules]]
    some = dict.fromkeys(next((part for part in COMMON if part in word), word) for word in keywords)
    return tuple(one for one in some if not any(other in one for other in some if other != one))


ANCHORS = anchors_of(signature_rules())


def license_scan(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """Per row of ``docs``: its number of words, base places and labels, and the surviving detections.

    Without ``rules`` they are :func:`signature_rules`, and SPDX expressions are read to their end as well.
    No rule may match more than MARGIN characters. ``score`` says how surely the text names a license: 1 less
    the chance that every surviving label is a false one, taking each label's strongest detection.
    """
    expressions = F.array().cast("array<string>") if rules else expression_labels(F.col("line"))
    rules = signature_rules() if rules is None else rules
    for rule in rules:
        if _longest(rule.pattern) > MARGIN - 2:  # with a space on either side
            raise ValueError(f"rule {rule.label!r} can match more than {MARGIN - 2} characters: {rule.pattern}")
    line = F.col("line")
    anchored = reduce(or_, [line.contains(anchor) for anchor in anchors_of(rules)])
    lines = texts_of(docs).select("doc_id", line_of_words(F.col("text")).alias("line"))
    lines = lines.withColumn("anchored", anchored)
    none = F.array().cast("array<struct<start: int, stop: int, label: string, weight: double, rank: int>>")
    found = lines.select(
        "doc_id",
        (_spaces(line) - 1).cast("long").alias("n_words"),
        *[_base_places(line, phrase).alias(label) for phrase, label in BASE.items()],
        F.when(F.col("anchored"), detections(line, rules)).otherwise(none).alias("detections"),
        expressions.alias("expressions"),
    )
    base = [F.col(f"`{label}`") for label in BASE.values()]
    labels = F.array_sort(
        F.array_distinct(
            F.array_compact(
                F.concat(
                    F.array(*[F.when(one.isNotNull(), F.lit(label)) for one, label in zip(base, BASE.values())]),
                    F.transform("detections", lambda one: one.label),
                    F.col("expressions"),
                )
            )
        )
    )
    base_labels = F.array_sort(
        F.array_compact(F.array(*[F.when(one.isNotNull(), F.lit(label)) for one, label in zip(base, BASE.values())]))
    )

    def doubt(label: Column) -> Column:
        own = F.filter("detections", lambda one: one.label == label)
        best = F.array_max(F.transform(own, lambda one: one.weight))
        return F.lit(1.0) - F.coalesce(best, F.lit(1.0))

    doubts = F.aggregate(F.transform("labels", doubt), F.lit(1.0), lambda a, b: a * b)
    return found.select(
        "doc_id",
        "n_words",
        sum((F.coalesce(one.n, F.lit(0)) for one in base), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[one.first for one in base]).cast("long").alias("first_word"),
        F.greatest(*[one["last"] for one in base]).cast("long").alias("last_word"),
        base_labels.alias("base_labels"),
        labels.alias("labels"),
        "detections",
    ).withColumn("score", F.when(F.size("labels") == 0, F.lit(0.0)).otherwise(F.lit(1.0) - doubts))


@query()
def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
