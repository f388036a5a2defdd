"""License scans by ordered signature rules.

Rules are regexes over the lower-cased text, each gated by literal keywords that its matches contain: a stem search over
whole blocks of text, then one Aho-Corasick pass over the texts that have a stem, tells which rules can match at all.
Overlapping detections are resolved by priority and containment: one that lies within a detection of higher priority, or
within a longer one of its own, is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, bounded, counts_between, documents, slices, span_hashes, text_bytes, word_bounds

#: Words are runs of 0-9, a-z and the bytes of all characters beyond ASCII.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label: (names, address patterns, SPDX identifier patterns). A blank in a name stands for any run of separators.
LICENSES: dict[str, tuple[list[str], list[str], list[str]]] = {
    "gpl-1.0": (["gnu (?:general public license|gpl) (?:version |v )?1(?: 0)?"], [r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"],
        [r"gpl-1\.0(?:-only|-or-later|\+)?"]),
    "gpl-2.0": (["gnu (?:general public license|gpl) (?:as published by the free software foundation )?(?:either )?(?:version |v )?2(?: 0)?",
        "version 2 of the gnu general public license", "gplv2"], [r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"],
            [r"gpl-2\.0(?:-only|-or-later|\+)?"]),
    "gpl-3.0": (["gnu (?:general public license|gpl) (?:as published by the free software foundation )?(?:either )?(?:version |v )?3(?: 0)?",
        "version 3 of the gnu general public license", "gplv3"], [r"gnu\.org/licenses/gpl(?:-3\.0)?(?:\.html|\.txt)"],
            [r"gpl-3\.0(?:-only|-or-later|\+)?"]),
    "lgpl": (["gnu (?:lesser|library) general public license", "gnu lgpl"], [r"gnu\.org/licenses/lgpl\.(?:html|txt)"], []),
    "lgpl-2.0": (["gnu library general public license (?:version |v )?2(?: 0)?"], [r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"],
        [r"lgpl-2\.0(?:-only|-or-later|\+)?"]),
    "lgpl-2.1": (["gnu lesser general public license (?:as published by the free software foundation )?(?:either )?(?:version |v )?2 1", "lgplv2 1"],
        [r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"], [r"lgpl-2\.1(?:-only|-or-later|\+)?"]),
    "lgpl-3.0": (["gnu lesser general public license (?:as published by the free software foundation )?(?:either )?(?:version |v )?3(?: 0)?",
        "lgplv3"], [r"gnu\.org/licenses/lgpl-3\.0"], [r"lgpl-3\.0(?:-only|-or-later|\+)?"]),
    "agpl-3.0": (["gnu affero general public license(?: as published by the free software foundation)?(?: either)?(?: version 3| v3)?", "affero gpl",
        "agplv3"], [r"gnu\.org/licenses/agpl"], [r"agpl-3\.0(?:-only|-or-later|\+)?"]),
    "gfdl": (["gnu free documentation license", "gnu fdl"], [r"gnu\.org/(?:copyleft|licenses)/fdl"], [r"gfdl-1\.[123](?:-only|-or-later)?"]),
    "apache-1.0": (["apache (?:software )?license (?:version |v )?1 0"], [r"apache\.org/licenses/license-1\.0"], [r"apache-1\.0"]),
    "apache-1.1": (["apache (?:software )?license (?:version |v )?1 1"], [r"apache\.org/licenses/license-1\.1"], [r"apache-1\.1"]),
    "apache-2.0": (["apache (?:software )?license (?:version |v )?2(?: 0)?"], [r"apache\.org/licenses/license-2\.0"], [r"apache-2\.0"]),
    "mit-0": (["mit no attribution license"], [r"opensource\.org/licenses?/mit-0"], [r"mit-0"]),
    "mit": (["permission is hereby granted free of charge to any person obtaining a copy",
        "the above copyright notice and this permission notice shall be included", "expat license"],
            [r"opensource\.org/licenses?/mit(?:-license)?(?:\.php)?"], [r"mit"]),
    "bsd-2-clause": (["(?:2|two) clause bsd(?: license)?", "simplified bsd license", "freebsd license"], [r"opensource\.org/licenses?/bsd-2-clause"],
        [r"bsd-2-clause"]),
    "bsd-3-clause": (["(?:3|three) clause bsd(?: license)?", "new bsd license", "modified bsd license", "revised bsd license"],
        [r"opensource\.org/licenses?/bsd-3-clause"], [r"bsd-3-clause(?:-clear)?"]),
    "bsd-4-clause": (["(?:4|four) clause bsd(?: license)?", "original bsd license"], [], [r"bsd-4-clause"]),
    "bsd": (["bsd style license", "bsd license", "redistributions of source code must retain the above copyright notice"],
        [r"opensource\.org/licenses?/bsd-license"], []),
    "0bsd": (["zero clause bsd(?: license)?", "free public license 1 0 0"], [r"opensource\.org/licenses?/0bsd"], [r"0bsd"]),
    "isc": (["isc license", "internet systems consortium license"], [r"opensource\.org/licenses?/isc"], [r"isc"]),
    "mpl-1.0": (["mozilla public license (?:version |v )?1 0"], [r"mozilla\.org/mpl/1\.0"], [r"mpl-1\.0"]),
    "mpl-1.1": (["mozilla public license (?:version |v )?1 1"], [r"mozilla\.org/mpl/(?:mpl-)?1\.1"], [r"mpl-1\.1"]),
    "mpl-2.0": (["mozilla public license (?:version |v )?2 0"], [r"mozilla\.org/mpl/2\.0"], [r"mpl-2\.0(?:-no-copyleft-exception)?"]),
    "mpl": (["mozilla public license"], [r"mozilla\.org/mpl"], []),
    "epl-1.0": (["eclipse public license (?:version |v )?1 0"], [r"eclipse\.org/legal/epl-v10"], [r"epl-1\.0"]),
    "epl-2.0": (["eclipse public license (?:version |v )?2 0"], [r"eclipse\.org/legal/epl-(?:v20|2\.0)"], [r"epl-2\.0"]),
    "epl": (["eclipse public license"], [r"eclipse\.org/legal/epl"], []),
    "edl": (["eclipse distribution license"], [r"eclipse\.org/(?:org/documents|legal)/edl"], []),
    "cddl-1.0": (["common development and distribution license(?: version)? 1 0"], [r"opensource\.org/licenses?/cddl-?1"], [r"cddl-1\.0"]),
    "cddl": (["common development and distribution license"], [r"oracle\.com/.{0,40}cddl"], [r"cddl-1\.1"]),
    "cpl-1.0": (["common public license"], [r"opensource\.org/licenses?/cpl1\.0"], [r"cpl-1\.0"]),
    "ipl-1.0": (["ibm public license"], [r"opensource\.org/licenses?/ibmpl"], [r"ipl-1\.0"]),
    "artistic-1.0": (["artistic license(?: version)? 1 0"], [r"opensource\.org/licenses?/artistic-license-1\.0"], [r"artistic-1\.0(?:-perl|-cl8)?"]),
    "artistic-2.0": (["artistic license(?: version)? 2 0"], [r"perlfoundation\.org/artistic_license_2_0"], [r"artistic-2\.0"]),
    "artistic": (["artistic license"], [r"opensource\.org/licenses?/artistic"], []),
    "bsl-1.0": (["boost software license"], [r"boost\.org/license_1_0"], [r"bsl-1\.0"]),
    "busl-1.1": (["business source license"], [r"mariadb\.com/bsl11"], [r"busl-1\.1"]),
    "sspl-1.0": (["server side public license"], [r"mongodb\.com/licensing/server-side-public-license"], [r"sspl-1\.0"]),
    "elastic-2.0": (["elastic license(?: 2 0)?"], [r"elastic\.co/licensing/elastic-license"], [r"elastic-2\.0"]),
    "zlib": (["zlib license", "zlib libpng license"], [r"zlib\.net/zlib_license"], [r"zlib(?:-acknowledgement)?"]),
    "libpng": (["libpng license", "png reference library license"], [r"libpng\.org/pub/png/src/libpng-license"], [r"libpng(?:-2\.0)?"]),
    "unlicense": (["the unlicense", "released into the public domain under the unlicense"], [r"unlicense\.org"], [r"unlicense"]),
    "wtfpl": (["do what the fuck you want to public license"], [r"wtfpl\.net"], [r"wtfpl"]),
    "public-domain": (["(?:released |placed |dedicated )(?:in|into|to) the public domain", "public domain dedication"],
        [r"creativecommons\.org/publicdomain/mark"], []),
    "cc0-1.0": (["cc0 1 0(?: universal)?", "creative commons (?:cc0|zero)(?: license)?"], [r"creativecommons\.org/publicdomain/zero/1\.0"],
        [r"cc0-1\.0"]),
    "cc-by": (["creative commons attribution(?: license| international| unported| [1-4] [05])"], [r"creativecommons\.org/licenses/by/[1-4]\.[05]"],
        [r"cc-by-[1-4]\.[05]"]),
    "cc-by-sa": (["creative commons attribution share ?alike", "cc by sa"], [r"creativecommons\.org/licenses/by-sa/[1-4]\.[05]"],
        [r"cc-by-sa-[1-4]\.[05]"]),
    "cc-by-nc": (["creative commons attribution non ?commercial", "cc by nc"], [r"creativecommons\.org/licenses/by-nc/[1-4]\.[05]"],
        [r"cc-by-nc-[1-4]\.[05]"]),
    "cc-by-nd": (["creative commons attribution no ?deriv(?:s|atives)", "cc by nd"], [r"creativecommons\.org/licenses/by-nd/[1-4]\.[05]"],
        [r"cc-by-nd-[1-4]\.[05]"]),
    "cc-by-nc-sa": (["creative commons attribution non ?commercial share ?alike", "cc by nc sa"],
        [r"creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]"], [r"cc-by-nc-sa-[1-4]\.[05]"]),
    "cc-by-nc-nd": (["creative commons attribution non ?commercial no ?deriv(?:s|atives)", "cc by nc nd"],
        [r"creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]"], [r"cc-by-nc-nd-[1-4]\.[05]"]),
    "odbl-1.0": (["open (?:data commons )?database license", "odbl"], [r"opendatacommons\.org/licenses/odbl"], [r"odbl-1\.0"]),
    "odc-by-1.0": (["open data commons attribution license", "odc by"], [r"opendatacommons\.org/licenses/by"], [r"odc-by-1\.0"]),
    "pddl-1.0": (["public domain dedication and license", "open data commons public domain"], [r"opendatacommons\.org/licenses/pddl"],
        [r"pddl-1\.0"]),
    "eupl-1.1": (["european union public licen[cs]e(?: v| version)? 1 1"], [r"eupl\.eu/1\.1"], [r"eupl-1\.1"]),
    "eupl-1.2": (["european union public licen[cs]e(?: v| version)? 1 2"], [r"eupl\.eu/1\.2"], [r"eupl-1\.2"]),
    "eupl": (["european union public licen[cs]e"], [r"joinup\.ec\.europa\.eu/.{0,60}eupl"], []),
    "cecill": (["cecill (?:free software )?licen[cs]e", "cecill [abc]"], [r"cecill\.info/licences"], [r"cecill-[abc12](?:\.[01])?"]),
    "ogl": (["open government licen[cs]e"], [r"nationalarchives\.gov\.uk/doc/open-government-licence"], [r"ogl-uk-[123]\.0"]),
    "psf-2.0": (["python software foundation license", "psf license"], [r"python\.org/psf/license"], [r"(?:psf|python)-2\.0"]),
    "php-3.01": (["php license(?: version)?(?: 3 01?)?"], [r"php\.net/license/3_01"], [r"php-3\.0(?:1)?"]),
    "ruby": (["ruby license"], [r"ruby-lang\.org/.{0,20}license"], [r"ruby"]),
    "ofl-1.1": (["sil open font license"], [r"scripts\.sil\.org/ofl", r"openfontlicense\.org"], [r"ofl-1\.[01]"]),
    "ubuntu-font": (["ubuntu font licen[cs]e"], [r"ubuntu\.com/legal/font-licence"], []),
    "openssl": (["openssl license", "openssl toolkit license"], [r"openssl\.org/source/license"], [r"openssl"]),
    "ssleay": (["original ssleay license"], [], [r"ssleay"]),
    "postgresql": (["postgresql licen[cs]e"], [r"postgresql\.org/about/licence"], [r"postgresql"]),
    "ncsa": (["university of illinois ncsa open source license", "ncsa open source license"], [r"opensource\.org/licenses?/(?:ui)?ncsa"], [r"ncsa"]),
    "ms-pl": (["microsoft public license"], [r"opensource\.org/licenses?/ms-pl"], [r"ms-pl"]),
    "ms-rl": (["microsoft reciprocal license"], [r"opensource\.org/licenses?/ms-rl"], [r"ms-rl"]),
    "osl-3.0": (["open software license(?: version| v)?(?: 3 0)?"], [r"opensource\.org/licenses?/osl-3\.0"], [r"osl-[123]\.[01]"]),
    "afl-3.0": (["academic free license(?: version| v)?(?: 3 0)?"], [r"opensource\.org/licenses?/afl-3\.0"], [r"afl-[123]\.[012]"]),
    "upl-1.0": (["universal permissive license"], [r"oss\.oracle\.com/licenses/upl"], [r"upl-1\.0"]),
    "vim": (["vim license"], [r"vimhelp\.org/uganda"], [r"vim"]),
    "tcl": (["tcl tk license"], [r"tcl\.tk/software/tcltk/license"], [r"tcl"]),
    "w3c": (["w3c software (?:notice|and document) (?:and )?license", "w3c license"], [r"w3\.org/consortium/legal/.{0,30}copyright-software"],
        [r"w3c(?:-20150513)?"]),
    "x11": (["x11 license", "mit x consortium license"], [], [r"x11"]),
    "zpl-2.1": (["zope public license"], [r"zope\.org/resources/zpl"], [r"zpl-[12]\.[01]"]),
    "qpl-1.0": (["q public license"], [r"trolltech\.com/.{0,20}qpl"], [r"qpl-1\.0"]),
    "rail": (["responsible ai license", "openrail(?: m)? license", "creativeml open rail"], [r"licenses\.ai"], []),
    "gpl": (["this program is free software you can redistribute it and or modify",
        "you should have received a copy of the gnu general public license"], [], []),
    "apache": (["unless required by applicable law or agreed to in writing software distributed under the license"], [], []),
    "bsd-text": (["redistribution and use in source and binary forms", "neither the name of the copyright holder nor the names of its contributors"],
        [], []),
    "isc-text": (["permission to use copy modify and or distribute this software for any purpose"], [], []),
    "zlib-text": (["altered source versions must be plainly marked as such"], [], []),
    "mpl-text": (["this source code form is subject to the terms of the mozilla public license"], [], []),
    "unlicense-text": (["this is free and unencumbered software released into the public domain"], [], []),
    "gcc-exception": (["gcc runtime library exception"], [r"gnu\.org/licenses/gcc-exception"], [r"gcc-exception-[23]\.[01]"]),
    "classpath-exception": (["classpath exception"], [r"gnu\.org/software/classpath/license"], [r"classpath-exception-2\.0"]),
    "llvm-exception": (["llvm exceptions? to the apache"], [r"llvm\.org/license"], [r"llvm-exception"]),
    "apsl": (["apple public source license"], [r"opensource\.apple\.com/apsl"], [r"apsl-[12]\.[0-2]"]),
    "aladdin": (["aladdin free public license"], [r"artifex\.com/licensing/aladdin"], [r"aladdin"]),
    "beerware": (["beer ?ware license", "buy me a beer in return"], [], [r"beerware"]),
    "blueoak-1.0.0": (["blue oak model license"], [r"blueoakcouncil\.org/license"], [r"blueoak-1\.0\.0"]),
    "cal-1.0": (["cryptographic autonomy license"], [r"opensource\.org/licenses?/cal-1\.0"], [r"cal-1\.0"]),
    "catosl-1.1": (["computer associates trusted open source license"], [], [r"catosl-1\.1"]),
    "cnri": (["cnri (?:python|open source) license"], [r"handle\.net/.{0,30}cnri"], [r"cnri-python"]),
    "cpal-1.0": (["common public attribution license"], [r"opensource\.org/licenses?/cpal"], [r"cpal-1\.0"]),
    "ecl-2.0": (["educational community license"], [r"opensource\.org/licenses?/ecl"], [r"ecl-[12]\.0"]),
    "hpnd": (["historical permission notice and disclaimer"], [r"opensource\.org/licenses?/hpnd"], [r"hpnd"]),
    "icu": (["icu license"], [r"icu-project\.org/.{0,30}license"], [r"icu"]),
    "ijg": (["independent jpeg groups? software"], [], [r"ijg"]),
    "json": (["the software shall be used for good not evil"], [r"json\.org/license"], [r"json"]),
    "lppl": (["latex project public license"], [r"latex-project\.org/lppl"], [r"lppl-1\.[0-3][abc]?"]),
    "mulan": (["mulan permissive software license", "mulan psl"], [r"license\.coscl\.org\.cn/mulanpsl"], [r"mulanpsl-[12]\.0"]),
    "nasa-1.3": (["nasa open source agreement"], [r"opensource\.org/licenses?/nasa1\.3"], [r"nasa-1\.3"]),
    "npl": (["netscape public license"], [r"mozilla\.org/npl"], [r"npl-1\.[01]"]),
    "nokia": (["nokia open source license"], [r"opensource\.org/licenses?/nokia"], [r"nokia"]),
    "oclc-2.0": (["oclc research public license"], [r"opensource\.org/licenses?/oclc"], [r"oclc-2\.0"]),
    "parity": (["parity public license"], [r"paritylicense\.com"], [r"parity-[67]\.0\.0"]),
    "polyform": (["polyform (?:noncommercial|shield|strict) license"], [r"polyformproject\.org/licenses"], [r"polyform-noncommercial-1\.0\.0"]),
    "prosperity": (["prosperity public license"], [r"prosperitylicense\.com"], []),
    "rpsl-1.0": (["realnetworks public source license"], [r"opensource\.org/licenses?/real"], [r"rpsl-1\.0"]),
    "rpl-1.5": (["reciprocal public license"], [r"opensource\.org/licenses?/rpl"], [r"rpl-1\.[15]"]),
    "sleepycat": (["sleepycat (?:public )?license"], [r"opensource\.org/licenses?/sleepycat"], [r"sleepycat"]),
    "spl-1.0": (["sun public license"], [r"opensource\.org/licenses?/sunpublic"], [r"spl-1\.0"]),
    "sissl": (["sun industry standards source license"], [r"opensource\.org/licenses?/sisslpl"], [r"sissl(?:-1\.2)?"]),
    "watcom-1.0": (["sybase open watcom public license"], [r"opensource\.org/licenses?/watcom"], [r"watcom-1\.0"]),
    "unicode": (["unicode license agreement", "unicode data files and software"], [r"unicode\.org/copyright"], [r"unicode-(?:dfs-201[56]|3\.0|tou)"]),
    "vsl-1.0": (["vovida software license"], [r"opensource\.org/licenses?/vovidapl"], [r"vsl-1\.0"]),
    "zend-2.0": (["zend (?:engine )?license"], [r"zend\.com/license"], [r"zend-2\.0"]),
    "commons-clause": (["commons clause license condition"], [r"commonsclause\.com"], []),
    "hippocratic-2.1": (["hippocratic license"], [r"firstdonoharm\.dev"], [r"hippocratic-2\.1"]),
    "llama": (["llama [234] community license"], [r"ai\.meta\.com/llama/license"], []),
    "gemma": (["gemma terms of use"], [r"ai\.google\.dev/gemma/terms"], []),
    "proprietary": (["all rights reserved", "unauthorized copying of this file", "proprietary and confidential"], [], [r"licenseref-proprietary"]),
}

#: Of a rule's kind: the priority, and the confidence it gives.
TAG, ADDRESS, GRANT, NAME = 100, 90, 80, 60
#: Every rule's match contains one of these stems; a text without any of them isn't looked at further.
STEMS = tuple(
    x.encode() for x in (
    "licen", "spdx", "gpl", "gnu", "commons", "creative", "cc", "domain", "bsd", "mozilla", "eclipse",
    "opensource.org", "permission", "redistrib", "wtfpl", "odbl", "odc", "rights", "unauthorized", "proprietary",
    "rail", "cecill", "eupl", "vimhelp", "mariadb.com", "oracle.com", "w3.org", "trolltech", "zope.org", "sil.org",
    "redistribut", "altered", "contributors", "unencumbered", "llvm.org", "exception", "apsl", "artifex", "beer",
    "handle.net", "jpeg", "evil", "lppl", "mulan", "nasa", "unicode", "firstdonoharm", "gemma",
    )
)

_SEP = r"[\x00-/:-`{-\x7f]{1,24}"
_FROM, _TO = r"(?<![0-9a-z\x80-\U0010ffff])", r"(?![0-9a-z\x80-\U0010ffff])"


class Rule(NamedTuple):
    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: re.Pattern


def _keyword(pattern: str, stop: str = "") -> str:
    """The longest literal run at the top level of a pattern: every match contains it."""
    out, depth, run, i = "", 0, "", 0
    while i <= len(pattern):
        c = pattern[i] if i < len(pattern) else "("
        plain = c if c.isalnum() or c in "/- " else pattern[i + 1] if c == "\\" and pattern[i + 1 : i + 2] in (".",) else ""
        if plain == " " and stop:
            plain = ""
        if plain and not depth:
            optional = pattern[i + 1 + (c == "\\") : i + 2 + (c == "\\")] in ("?", "*", "{")
            run = run if optional else run + plain
            if optional:
                out, run = max(out, run, key=len), ""
        else:
            out, run = max(out, run, key=len), ""
            depth += (c == "(" or c == "[") - (c == ")" or c == "]") if i < len(pattern) else 0
        i += 1 + (c == "\\")
    return out


def _spaced(name: str) -> str:
    """Blanks to separators; an optional blank, or one inside an optional group, stays optional with it."""
    return name.replace(" ?", "\0").replace(" ", _SEP).replace("\0", f"(?:{_SEP})?")


_UNDER = rf"(?:licensed|released|distributed|available|provided|published){_SEP}under{_SEP}(?:the{_SEP}|a{_SEP})?(?:terms{_SEP}of{_SEP}(?:the{_SEP})?)?"
#: Of an expression of identifiers, the operands before the one that a rule looks for.
_OPERANDS = r"(?:[a-z0-9.+:-]+[ \t()]+(?:and|or|with)[ \t(]+)*?"


@cache
def rules() -> tuple[Rule, ...]:
    out = []
    for label, (names, addresses, tags) in LICENSES.items():
        for x in tags:
            own = max(_keyword(x).split("/"), key=len)
            tag = rf"spdx-license-identifier:[ \t(]*{_OPERANDS}(?P<x>{x})(?![0-9a-z.+-])"
            out.append(Rule(label, TAG, ("spdx", own), re.compile(tag)))
            field = rf"{_FROM}licen[cs]e(?:d under)?[\"']?[ \t]*[:=][ \t\"'\[]*{x}(?![0-9a-z.+-])"
            out.append(Rule(label, GRANT, ("licen", own), re.compile(field)))
        for x in addresses:
            out.append(Rule(label, ADDRESS, (_keyword(x),), re.compile(rf"(?:https?://)?(?:www\.)?{x}")))
        for x in names:
            # a name's blanks stand for any separators, so that its keyword is a single word
            word = max((_keyword(w, " ") for w in re.split(r" (?![^(]*\))", x)), key=len)
            out.append(Rule(label, GRANT, (word, "under"), re.compile(rf"{_FROM}{_UNDER}{_spaced(x)}{_TO}")))
            out.append(Rule(label, NAME, (word,), re.compile(rf"{_FROM}{_spaced(x)}{_TO}")))
    return tuple(out)


@cache
def _gate() -> tuple[ahocorasick.Automaton, dict[str, list[Rule]]]:
    by: dict[str, list[Rule]] = {}
    found = ahocorasick.Automaton()
    for r in rules():
        by.setdefault(r.keywords[-1] if r.keywords[-1] != "under" else r.keywords[0], []).append(r)
        for k in r.keywords:
            found.add_word(k, k)
    found.make_automaton()
    return found, by


def _hits(rule: Rule, low: str) -> list[tuple[int, int, int, str]]:
    """(start, end, priority, label) of a rule's matches; of an expression, the place of the operand."""
    x = "x" if "x" in rule.pattern.groupindex else 0
    return [(m.start(x), m.end(x), rule.priority, rule.label) for m in rule.pattern.finditer(low)]


def detect(low: str) -> list[tuple[int, int, int, str]]:
    """The detections that stand, (start, end, priority, label), in a lower-cased text."""
    found, by = _gate()
    there = {k for _, k in found.iter(low)}
    hits: set[tuple[int, int, int, str]] = set()
    for k in there:
        for r in by.get(k, ()):
            if there.issuperset(r.keywords):
                hits.update(_hits(r, low))
    kept: list[tuple[int, int, int, str]] = []
    above_start, above_end = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for level in sorted({h[2] for h in hits}, reverse=True):
        now, reach, last = [], -1, None
        for h in sorted((h for h in hits if h[2] == level), key=lambda h: (h[0], -h[1], h[3])):
            within = np.searchsorted(above_start, h[0], "right")
            if (within and above_end[within - 1] >= h[1]) or (h[1] <= reach and h[:2] != last):
                continue
            now.append(h)
            if h[1] > reach:
                reach, last = h[1], h[:2]
        kept += now
        order = sorted(kept)
        above_start = np.array([h[0] for h in order], np.int64)
        above_end = np.maximum.accumulate(np.array([h[1] for h in order], np.int64)) if order else above_end
    return sorted(kept)


def _base(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Words a text, and the words (counted through the block) at which each phrase starts."""
    starts, ends = word_bounds(data, offsets, _IN_WORD)
    n_words = counts_between(starts, offsets)
    h, doc = span_hashes(data, starts, ends), np.repeat(np.arange(len(n_words)), n_words)
    at = {}
    for phrase in BASE:
        words = phrase.encode().split()
        raw = np.frombuffer(b"".join(words), np.uint8)
        to = np.cumsum([len(w) for w in words])
        want = span_hashes(raw, to - [len(w) for w in words], to)
        here = np.flatnonzero(h[: max(0, len(h) - len(words) + 1)] == want[0])
        for i in range(1, len(words)):
            here = here[(h[here + i] == want[i]) & (doc[here + i] == doc[here])]
        at[phrase] = here
    return n_words, at


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Words, base phrases and labels of each row, a row each.

    score is the highest priority among the standing detections over 100, 0.6 at least where a base phrase stands, else
    0. A null or empty text has no words and no labels (empty strings, score 0); a null key stays null. Only the two
    columns named are read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                data, offsets = text_bytes(part.column("t"))
                data, n = LOWER[data], len(part)
                n_words, at = _base(data, offsets)
                first_word = np.concatenate([[0], np.cumsum(n_words)])
                places: list[list[int]] = [[] for _ in range(n)]
                base: list[set[str]] = [set() for _ in range(n)]
                for phrase, here in at.items():
                    for w, d in zip(here.tolist(), (np.searchsorted(first_word, here, "right") - 1).tolist(), strict=True):
                        places[d].append(w - int(first_word[d]))
                        base[d].add(BASE[phrase])
                raw = data.tobytes()
                own: list[list] = [[] for _ in range(n)]
                for d in _with_stems(raw, offsets):
                    own[d] = detect(raw[offsets[d] : offsets[d + 1]].decode())
                labels = [sorted(b | {h[3] for h in o}) for b, o in zip(base, own, strict=True)]
                score = [max([0.6 * bool(b), *(h[2] / 100 for h in o)]) for b, o in zip(base, own, strict=True)]
                columns = [part.column("k").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array([len(p) for p in places], pa.int64()),
                    pa.array([min(p, default=None) for p in places], pa.int64()), pa.array([max(p, default=None) for p in places], pa.int64()),
                        pa.array([",".join(sorted(b)) for b in base], pa.string()), pa.array([",".join(x) for x in labels], pa.string()),
                            pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SCHEMA.split(", ")])

    bounded(docs.sparkSession)
    return docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInArrow(run, _SCHEMA)


def _with_stems(raw: bytes, offsets: np.ndarray) -> list[int]:
    """The texts that contain a stem: bytes.find runs over the whole block, once for each stem and text that has it."""
    out: set[int] = set()
    for stem in STEMS:
        at = raw.find(stem)
        while at >= 0:
            d = int(np.searchsorted(offsets, at, "right")) - 1
            out.add(d)
            at = raw.find(stem, int(offsets[d + 1]))
    return sorted(out)


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
