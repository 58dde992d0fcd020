"""Signature rules for license scans.

A rule is a regular expression over a text's lower-cased words, a keyword that gates it,
a label, a priority and a weight.  The rules below are written by hand in a small notation,
a word after the other:

=========  =====================================================
``gpl``    the word itself
``a|b``    either word
``v?``     the word or nothing
``*``      any one word
``~3``     up to three words
=========  =====================================================

``V`` stands for one of a license's versions, written ``3.0``, ``3`` or ``v3``; a signature
with ``V`` gives one rule for each version.  Notices stand above full names, names above
short forms, and these above general remarks.  Within a kind the longer detection stands
above one inside it, and of two with the same words the rule earlier in the list.
"""

from __future__ import annotations

import re
from itertools import product
from typing import NamedTuple


class Rule(NamedTuple):
    """``pattern`` is over words that are each set between two blanks; every match holds ``keyword``.

    ``sure``: runs of words of which every match holds one, if more is known than the keyword.
    """

    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float
    sure: tuple[str, ...] = ()


NOTICE, NAME, SHORT, REMARK = 40, 30, 20, 10
WEIGHT = {NOTICE: 0.95, NAME: 0.85, SHORT: 0.6, REMARK: 0.3}

#: label, versions (blank-separated; "-" for none), priority, keyword, signature
SIGNATURES = """
gpl-V | 1.0 2.0 3.0 | notice | general | under the terms of the gnu general public license ~6 version V
gpl-V-or-later | 1.0 2.0 3.0 | notice | later | gnu? general public license ~12 version V ~4 or at? your? option? any? later version?
gpl-V-only | 1.0 2.0 3.0 | notice | only | gnu? general public license ~3 version? V only
gpl-V | 1.0 2.0 3.0 | name | general | gnu? general public license version? V
gpl-V | 1.0 2.0 3.0 | short | gpl | gpl version? V
gpl-V-or-later | 1.0 2.0 3.0 | short | gpl | gpl version? V or later
gpl-V-only | 1.0 2.0 3.0 | short | gpl | gpl version? V only
lgpl-V | 2.0 2.1 3.0 | notice | lesser | under the terms of the gnu lesser general public license ~6 version V
lgpl-V | 2.0 2.1 3.0 | notice | library | under the terms of the gnu library general public license ~6 version V
lgpl-V-or-later | 2.0 2.1 3.0 | notice | later | gnu? lesser|library general public license ~12 version V ~4 or at? your? option? any? later version?
lgpl-V-only | 2.0 2.1 3.0 | notice | only | gnu? lesser|library general public license ~3 version? V only
lgpl-V | 2.0 2.1 3.0 | name | general | gnu? lesser|library general public license version? V
lgpl-V | 2.0 2.1 3.0 | short | lgpl | lgpl version? V
lgpl-V-or-later | 2.0 2.1 3.0 | short | lgpl | lgpl version? V or later
lgpl-V-only | 2.0 2.1 3.0 | short | lgpl | lgpl version? V only
agpl-V | 1.0 3.0 | notice | affero | under the terms of the gnu? affero general public license ~6 version V
agpl-V-or-later | 1.0 3.0 | notice | affero | gnu? affero general public license ~12 version V ~4 or at? your? option? any? later version?
agpl-V-only | 1.0 3.0 | notice | affero | gnu? affero general public license ~3 version? V only
agpl-V | 1.0 3.0 | name | affero | gnu? affero general public license version? V
agpl-V | 1.0 3.0 | short | agpl | agpl version? V
agpl-V-or-later | 1.0 3.0 | short | agpl | agpl version? V or later
gpl | - | name | general | gnu general public license
lgpl | - | name | general | gnu lesser|library general public license
agpl | - | name | affero | gnu affero general public license
gpl | - | short | gpl | licensed under the? gpl
lgpl | - | short | lgpl | licensed under the? lgpl
agpl | - | short | agpl | licensed under the? agpl
gfdl-V | 1.1 1.2 1.3 | notice | documentation | under the terms of the gnu free documentation license version V
gfdl-V | 1.1 1.2 1.3 | name | documentation | gnu? free documentation license version? V
gfdl-V | 1.1 1.2 1.3 | short | gfdl | gfdl version? V
gfdl | - | name | documentation | gnu free documentation license
gcc-exception | - | notice | exception | gcc runtime library exception
classpath-exception | - | notice | exception | classpath exception
linking-exception | - | notice | exception | linking exception
apache-V | 1.0 1.1 2.0 | notice | apache | licensed under the apache license version? V
apache-V | 1.0 1.1 2.0 | name | apache | apache software? license version? V
apache-V | 1.0 1.1 2.0 | name | asl | asl V
apache-V | 1.0 1.1 2.0 | short | apache | apache V
apache-2.0 | - | notice | apache | you may not use this file except in compliance with the license ~8 apache org licenses license 2 0
apache | - | name | apache | apache software? license
apache | - | short | apache | licensed under the? apache
mit | - | notice | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | - | notice | mit | released|licensed|distributed|available under the? terms? of? the? mit license
mit | - | name | mit | the? mit license
mit | - | name | expat | expat license
x11 | - | name | x11 | x11 license
mit-0 | - | name | attribution | mit no attribution
mit-0 | - | short | mit | mit 0 license
isc | - | notice | hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | - | name | isc | isc license
0bsd | - | name | 0bsd | 0bsd
0bsd | - | name | zero | zero clause bsd
bsd | - | notice | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | - | name | bsd | bsd 2|two clause
bsd-2-clause | - | name | bsd | 2|two clause bsd
bsd-2-clause | - | name | simplified | simplified bsd license
bsd-2-clause | - | name | freebsd | freebsd license
bsd-3-clause | - | name | bsd | bsd 3|three clause
bsd-3-clause | - | name | bsd | 3|three clause bsd
bsd-3-clause | - | name | revised | new|revised|modified bsd license
bsd-3-clause | - | notice | endorse | neither the name of ~12 may be used to endorse or promote products
bsd-4-clause | - | name | bsd | bsd 4|four clause
bsd-4-clause | - | name | bsd | 4|four clause bsd
bsd-4-clause | - | name | original | original bsd license
bsd-4-clause | - | notice | advertising | all advertising materials mentioning features or use of this software must display
bsd | - | name | bsd | bsd license
bsd | - | short | bsd | licensed under the? bsd
bsd-protection | - | name | protection | bsd protection license
mpl-V | 1.0 1.1 2.0 | notice | mozilla | subject to the terms of the mozilla public license ~3 V
mpl-V | 1.0 1.1 2.0 | name | mozilla | mozilla public license version? V
mpl-V | 1.0 1.1 2.0 | short | mpl | mpl version? V
mpl | - | name | mozilla | mozilla public license
npl-V | 1.0 1.1 | name | netscape | netscape public license version? V
npl | - | name | netscape | netscape public license
epl-V | 1.0 2.0 | notice | eclipse | under the terms of the eclipse public license ~3 V
epl-V | 1.0 2.0 | name | eclipse | eclipse public license version? V
epl-V | 1.0 2.0 | short | epl | epl version? V
epl | - | name | eclipse | eclipse public license
edl-V | 1.0 | name | eclipse | eclipse distribution license version? V
cpl-V | 1.0 | name | common | common public license version? V
ipl-V | 1.0 | name | ibm | ibm public license version? V
cddl-V | 1.0 1.1 | notice | development | subject to the terms of the common development and distribution license ~4 V
cddl-V | 1.0 1.1 | name | development | common development and distribution license ~1 version? V
cddl-V | 1.0 1.1 | short | cddl | cddl version? V
cddl | - | name | development | common development and distribution license
cecill-V | 1.0 1.1 2.0 2.1 | name | cecill | cecill free? software? license? agreement? version? V
cecill | - | short | cecill | cecill license
cecill-b | - | short | cecill | cecill b
cecill-c | - | short | cecill | cecill c
eupl-V | 1.0 1.1 1.2 | name | european | european union public licence|license version? V
eupl-V | 1.0 1.1 1.2 | short | eupl | eupl version? V
eupl | - | name | european | european union public licence|license
osl-V | 1.0 2.0 2.1 3.0 | name | open | open software license version? V
osl-V | 1.0 2.0 2.1 3.0 | short | osl | osl version? V
afl-V | 1.1 1.2 2.0 2.1 3.0 | name | academic | academic free license version? V
afl-V | 1.1 1.2 2.0 2.1 3.0 | short | afl | afl version? V
artistic-V | 1.0 2.0 | name | artistic | artistic license version? V
artistic | - | name | artistic | artistic license
perl | - | notice | perl | under the same terms as perl itself
boost-V | 1.0 | name | boost | boost software license version? V
boost | - | name | boost | boost software license
zlib | - | name | zlib | zlib license
zlib | - | notice | altered | altered source versions must be plainly marked as such
libpng | - | name | libpng | libpng license
libtiff | - | name | libtiff | libtiff license
openssl | - | name | openssl | openssl license
python-V | 2.0 | name | python | python software foundation license version? V
python | - | name | python | python software foundation license
php-V | 3.0 3.1 | name | php | php license version? V
ruby | - | name | ruby | ruby license
ruby | - | notice | ruby | under the same terms as ruby itself
postgresql | - | name | postgresql | postgresql license
unlicense | - | notice | unencumbered | this is free and unencumbered software released into the public domain
unlicense | - | name | unlicense | the? unlicense
wtfpl | - | name | wtfpl | wtfpl
wtfpl | - | name | what | do what the fuck you want to public license
beerware | - | name | beerware | beerware license
beerware | - | name | beer | beer ware license
zpl-V | 1.1 2.0 2.1 | name | zope | zope public license version? V
ncsa | - | name | illinois | university of illinois ncsa open source license
upl-V | 1.0 | name | universal | universal permissive license version? V
ms-pl | - | name | microsoft | microsoft public license
ms-rl | - | name | microsoft | microsoft reciprocal license
ofl-V | 1.0 1.1 | notice | font | licensed under the sil open font license version? V
ofl-V | 1.0 1.1 | name | font | sil? open font license version? V
ofl | - | name | font | open font license
odbl-V | 1.0 | name | database | open database license version? V
odbl-V | 1.0 | short | odbl | odbl version? V
odc-by-V | 1.0 | name | commons | open data commons attribution license version? V
pddl-V | 1.0 | name | commons | open data commons public domain dedication ~3 V
pddl | - | name | commons | open data commons public domain dedication
cdla-permissive-V | 1.0 2.0 | name | community | community data license agreement permissive version? V
cdla-sharing-V | 1.0 | name | community | community data license agreement sharing version? V
ogl-V | 1.0 2.0 3.0 | name | government | open government licence|license version? V
ogl | - | name | government | open government licence|license
openrail | - | name | openrail | openrail license
openrail | - | name | responsible | responsible ai license
cc0-V | 1.0 | name | cc0 | cc0 version? V
cc0 | - | short | cc0 | cc0
cc0 | - | notice | waived | has waived all copyright and related or neighboring rights
cc-by-V | 1.0 2.0 2.5 3.0 4.0 | name | cc | cc by V
cc-by-sa-V | 1.0 2.0 2.5 3.0 4.0 | name | cc | cc by sa V
cc-by-nd-V | 1.0 2.0 2.5 3.0 4.0 | name | cc | cc by nd V
cc-by-nc-V | 1.0 2.0 2.5 3.0 4.0 | name | cc | cc by nc V
cc-by-nc-sa-V | 1.0 2.0 2.5 3.0 4.0 | name | cc | cc by nc sa V
cc-by-nc-nd-V | 1.0 2.0 2.5 3.0 4.0 | name | cc | cc by nc nd V
cc-by-V | 1.0 2.0 2.5 3.0 4.0 | name | creative | creative commons attribution V
cc-by-sa-V | 1.0 2.0 2.5 3.0 4.0 | name | creative | creative commons attribution share alike|sharealike V
cc-by-sa-V | 1.0 2.0 2.5 3.0 4.0 | name | creative | creative commons attribution sharealike V
cc-by-nd-V | 1.0 2.0 2.5 3.0 4.0 | name | creative | creative commons attribution no? noderivatives|noderivs|derivatives|derivs V
cc-by-nc-V | 1.0 2.0 2.5 3.0 4.0 | name | creative | creative commons attribution non? noncommercial|commercial V
cc-by-nc-sa-V | 1.0 2.0 2.5 3.0 4.0 | name | creative | creative commons attribution non? noncommercial|commercial share? alike|sharealike V
cc-by-nc-nd-V | 1.0 2.0 2.5 3.0 4.0 | name | creative | creative commons attribution non? noncommercial|commercial no? noderivatives|noderivs|derivatives|derivs V
cc-by | - | short | cc | cc by
cc-by-sa | - | short | cc | cc by sa
cc-by-nd | - | short | cc | cc by nd
cc-by-nc | - | short | cc | cc by nc
cc-by-nc-sa | - | short | cc | cc by nc sa
cc-by-nc-nd | - | short | cc | cc by nc nd
creative-commons | - | short | creative | creative commons license|licence
creative-commons | - | remark | creative | creative commons
public-domain | - | notice | dedicate | dedicated|released|placed ~3 in|into|to the public domain
public-domain | - | remark | public | public domain
proprietary | - | notice | proprietary | proprietary and confidential
proprietary | - | notice | proprietary | proprietary software|license|licence
proprietary | - | notice | prohibited | unauthorized copying|reproduction|distribution ~8 strictly prohibited
proprietary | - | notice | reproduced | no part of this publication|book|work may be reproduced
non-commercial | - | notice | commercial | for non? noncommercial|commercial use only
reserved | - | name | reserved | all rights reserved
reserved | - | short | reserved | some rights reserved
copyright | - | remark | copyright | copyright c? *
warranty-disclaimer | - | remark | warranty | without warranty|warranties of any kind
warranty-disclaimer | - | remark | warranty | without any warranty
spdx | - | remark | spdx | spdx license identifier *
license-notice | - | remark | licen | licensed|licenced under the? *
license-notice | - | remark | licen | license|licence agreement
"""

#: The words with which the prefilter finds texts worth taking apart: the stem of a license remark.  A rule that
#: none of them covers is found by its keyword (see ``license_scan.prefilter``).
STEMS = ("licen[cs]", "copyright", "reproduced", "reserved", "redistribut", "warrant", "permission", "proprietary", "prohibited", "spdx",
         "unlicense", "wtfpl", "cc0", "0bsd", "agpl", "lgpl", "gpl", "gfdl", "cddl", "eupl", "odbl", "cecill", "waived", "exception",
         "creative", "mozilla", "apache", "clause", "itself", "altered", "advertising", "attribution")
PAIRS = (("cc", "by"), ("public", "domain"), ("mpl",), ("epl",), ("osl",), ("afl",), ("asl",), ("commercial", "use"))

def sure_runs(signature: str) -> tuple[str, ...]:
    """For each choice of a signature's alternatives the words that a match must hold, a bar between words that may be apart."""
    choices = [[w] if not (w in "V*" or w[0] == "~" or w[-1] == "?") else ["|"] for w in signature.split()]
    choices = [c[0].split("|") if c != ["|"] else c for c in choices]
    return tuple(" ".join(words) for words in product(*choices))


PRIORITY = {"notice": NOTICE, "name": NAME, "short": SHORT, "remark": REMARK}


def _words(signature: str, version: str) -> str:
    """A signature in the notation above as a pattern over blank-framed words."""
    out = []
    for item in signature.split():
        if item == "V":
            major, _, minor = version.partition(".")
            ending = f"(?: {minor} )?" if minor == "0" else f" {minor} "
            out.append(f" v?{major} {ending}")
        elif item == "*":
            out.append(" [^ ]+ ")
        elif item[0] == "~":
            out.append(f"(?: [^ ]+ ){{0,{item[1:]}}}")
        elif item[-1] == "?":
            out.append(f"(?: {item[:-1]} )?")
        elif "|" in item:
            out.append(f" (?:{item}) ")
        else:
            out.append(f" {item} ")
    return "".join(out)


def rules() -> list[Rule]:
    """All rules in their order."""
    out: list[Rule] = []
    lines = [line for line in SIGNATURES.strip().splitlines()]
    for line in lines:
        label, versions, kind, keyword, signature = re.split(r" \| ", line, maxsplit=4)
        for version in versions.split():
            priority = PRIORITY[kind]
            out.append(Rule(label.replace("V", version) if version != "-" else label, keyword, _words(signature, version), priority, WEIGHT[priority], sure_runs(signature)))
    return out
