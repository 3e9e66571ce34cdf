"""License scans: ordered signature rules behind a filter of their trigger words. Spark functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.plans.checkpoint import stored

#: What parts words: ASCII other than digits and letters.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Fixed values of the contract: (phrase, label).
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: (label, what it is called in normalised words, versions). A version v adds -v to the label.
FAMILIES = (
    ("mit", "(?:expat|mit|x11)", ()),
    ("apache", "(?:apache software|apache)", ("1 0", "1 1", "2 0")),
    ("gpl", "(?:gnu general public|gnu gpl|gpl)", ("1", "2", "3")),
    ("lgpl", "(?:gnu (?:lesser|library) general public|gnu lgpl|lgpl)", ("2", "2 1", "3")),
    ("agpl", "(?:gnu affero general public|affero general public|gnu agpl|agpl)", ("1", "3")),
    ("gfdl", "(?:gnu free documentation|gfdl)", ("1 1", "1 2", "1 3")),
    ("bsd", "(?:berkeley software distribution|bsd)", ("2 clause", "3 clause", "4 clause")),
    ("mpl", "(?:mozilla public|mpl)", ("1 0", "1 1", "2 0")),
    ("epl", "(?:eclipse public|epl)", ("1 0", "2 0")),
    ("cddl", "(?:common development and distribution|cddl)", ("1 0", "1 1")),
    ("cpl", "(?:common public|cpl)", ("1 0",)),
    ("eupl", "(?:european union public|eupl)", ("1 0", "1 1", "1 2")),
    ("osl", "(?:open software|osl)", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "(?:academic free|afl)", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", "artistic", ("1 0", "2 0")),
    ("boost", "boost software", ("1 0",)),
    ("odbl", "(?:open database|odbl)", ("1 0",)),
    ("ofl", "(?:sil open font|open font|ofl)", ("1 0", "1 1")),
    ("psf", "(?:python software foundation|psf)", ("2",)),
    ("php", "php", ("3 0", "3 01")),
    ("zpl", "(?:zope public|zpl)", ("1 1", "2 0", "2 1")),
    ("lppl", "(?:latex project public|lppl)", ("1 0", "1 1", "1 2", "1 3")),
    ("ms-pl", "(?:microsoft public|ms pl)", ()),
    ("ms-rl", "(?:microsoft reciprocal|ms rl)", ()),
    ("isc", "(?:internet systems consortium|isc)", ()),
    ("zlib", "(?:zlib libpng|zlib)", ()),
    ("ncsa", "(?:university of illinois ncsa|ncsa)", ()),
    ("postgresql", "postgresql", ()),
    ("unlicense", "unlicense", ()),
    ("wtfpl", "(?:do what the fuck you want to public|wtfpl)", ()),
    ("vim", "vim", ()),
    ("ruby", "ruby", ()),
    ("cc0", "(?:cc0|creative commons zero)", ("1 0",)),
    ("cc-by", "(?:cc by|creative commons attribution)", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)", ("1 0", "2 0", "2 5", "3 0", "4 0")),
)
#: (priority, confidence, pattern for a version). n is the name, v the version.
VERSIONED = (
    (3, 1.0, "spdx license identifier {n}(?: {v}| {v} (?:only|or later))"),
    (3, 0.95, "(?:(?:(?:re)?licensed|released|distributed|available|published|free) )?(?:under|to) (?:the |an? )?(?:terms of the )?{n} licen[cs]e (?:version |v)?{v}"),
    (3, 0.95, "{n}(?: public)?(?: licen[cs]e)?(?: version| ?v)? ?{v}"),
    (3, 0.9, "version {v} of the {n} licen[cs]e"),
)
#: The same for a name alone, always with words that tell a licence from other uses of the name.
PLAIN = (
    (2, 0.9, "spdx license identifier {n}"),
    (2, 0.8, "(?:(?:re)?licensed|released|distributed|available|published|free) under (?:the |an? )?(?:terms of the )?{n}(?: licen[cs]e)?"),
    (1, 0.7, "(?:see|read|accept|under|by|with|terms of) (?:the )?{n} licen[cs]e"),
    (1, 0.7, "{n} licensed|licen[cs]e {n}(?: licen[cs]e)?|(?<=^ )(?:the )?{n} licen[cs]e(?= (?:copyright|version|permission|terms|[0-9]{{4}}|$))"),
    (1, 0.6, "{n} licen[cs]e (?:agreement|terms|text|file|notice|header|copyright)"),
)
#: Signatures: label; priority; trigger, a word of every match; pattern over normalised words.
SIGNATURES = r"""
mit; 3; hereby; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit; 2; obtaining; free of charge to any person obtaining a copy
mit; 2; substantial; this permission notice shall be included in all copies or substantial portions of the software
mit; 2; sublicense; (?:to )?use copy modify merge publish distribute sublicense and or sell copies of the software
mit; 2; dealings; arising from out of or in connection with the software or the use or other dealings in the software
mit; 2; mit; opensource org licenses?(?: php)? mit(?: license)?(?: php)?
mit-0; 3; mit; mit (?:no attribution|0)(?: license)?
x11; 2; consortium; the name of the x consortium shall not be used in advertising
apache-1.1; 3; jakarta; the names (?:the )?jakarta project (?:commons )?and apache software foundation must not be used
apache-1.1; 2; acknowledgment; this product includes software developed by the apache software foundation http www apache org alternately this acknowledgment
apache-2.0; 3; apache; you may not use this file except in compliance with the license you may obtain a copy of the license at https? www apache org licenses license 2 0
apache-2.0; 3; apache; (?:www )?apache org licenses(?: license)? 2 0(?: txt| html)?
apache-2.0; 2; agreed; unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0; 2; contributor; each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0; 2; reproduction; terms and conditions for use reproduction and distribution
apache-2.0; 2; boilerplate; to apply the apache license to your work attach the following boilerplate notice
apache; 2; asf; licensed to the apache software foundation asf under one or more contributor license agreements
bsd; 3; redistribution; redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd; 2; redistributions; redistributions of source code must retain the (?:above )?copyright notice
bsd; 2; redistributions; redistributions in binary form must reproduce the above copyright notice
bsd-3-clause; 3; endorse; neither the names? of .{1,80}? may be used to endorse or promote products derived from this software
bsd-3-clause; 3; promote; may not be used to endorse or promote products derived from this software without (?:specific )?prior written permission
bsd-4-clause; 3; advertising; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause; 2; freebsd; the freebsd (?:copyright|license)
bsd; 2; regents; copyright (?:c )?(?:\d{4} )+the regents of the university of california
bsd-3-clause; 2; bsd; opensource org licenses bsd 3 clause
bsd-2-clause; 2; bsd; opensource org licenses bsd 2 clause
bsd; 1; bsd; bsd style (?:open source )?licen[cs]e
0bsd; 3; 0bsd; (?:licen[cs]e )?0bsd|zero clause bsd 0bsd
0bsd; 2; purpose; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)
isc; 3; fee; permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
isc; 2; disclaims; the author disclaims all warranties with regard to this software
isc; 2; isc; opensource org licenses isc(?: license)?
gpl; 3; redistribute; this (?:program|library|file|package|software) is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2; 3; gnu; under the terms of the gnu general public license as published by the free software foundation either version 2 of the license(?! or)|redistribute it .{1,60}? gnu general public license version 2
gpl-2-or-later; 3; later; gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3-or-later; 3; later; gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2-only; 3; gnu; gnu general public license version 2 only|version 2 only of the gnu general public license
gpl-3-only; 3; gnu; gnu general public license version 3 only|version 3 only of the gnu general public license
gpl; 2; gnu; you should have received a copy of the gnu general public license along with
gpl; 2; hope; (?:program|software) is distributed in the hope that it will be useful but without any warranty .{1,90}? gnu general public license
gpl; 2; copyleft; the gnu general public license is a free copyleft license for software
gpl-2; 3; june; gnu general public license version 2 june 1991
gpl-3; 3; june; gnu general public license version 3 29 june 2007
gpl; 1; copyleft; copyleft licen[cs]e
gpl; 2; gnu; (?:www )?gnu org (?:licenses|copyleft) gpl(?: txt| html)?
gpl-classpath; 3; classpath; classpath exception(?: to the gpl)?
gpl-linking-exception; 3; exception; as a special exception .{1,120}? permission to link (?:or combine )?this (?:program|library|work)
lgpl; 3; redistribute; this (?:program|library|file|package|software) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl-2.1; 3; lesser; gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-3; 3; lesser; gnu lesser general public license as published by the free software foundation either version 3
lgpl; 2; lesser; you should have received a copy of the gnu lesser general public license
lgpl-2.1; 3; february; gnu lesser general public license version 2 1 february 1999
lgpl-2; 3; library; gnu library general public license version 2 june 1991
lgpl-3; 3; lesser; gnu lesser general public license version 3 29 june 2007
lgpl; 2; gnu; (?:www )?gnu org (?:licenses|copyleft) (?:old licenses )?lgpl(?: \d(?: \d)?)?(?: txt| html)?
agpl; 3; affero; under the terms of the gnu affero general public license
agpl-3; 3; affero; gnu affero general public license as published by .{1,60}? version 3
agpl-3; 3; november; gnu affero general public license version 3 19 november 2007
agpl; 2; affero; you should have received a copy of the gnu affero general public license
agpl; 2; gnu; (?:www )?gnu org licenses agpl(?: \d(?: \d)?)?(?: txt| html)?
gfdl; 3; invariant; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license .{0,160}? invariant sections
gfdl; 2; gnu; under the (?:terms of the )?gnu free documentation license
gfdl; 2; gnu; (?:www )?gnu org (?:licenses|copyleft) fdl(?: txt| html)?
mpl-1.1; 3; mozilla; the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0; 3; mozilla; this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0; 3; mozilla; (?:www )?mozilla org mpl 2 0
mpl-1.1; 3; mozilla; (?:www )?mozilla org mpl mpl 1 1(?: html)?
mpl; 2; incompatible; incompatible with secondary licenses
npl; 3; netscape; (?:subject to the )?netscape public license(?: version 1 [01])?
epl-1.0; 3; eclipse; eclipse public license v(?:ersion)? ?1 0 which accompanies this distribution
epl-2.0; 3; eclipse; (?:this program and the accompanying materials are made available under the terms of the )?eclipse public license (?:v )?2 0 which is available at
epl; 2; eclipse; (?:www )?eclipse org legal epl(?: v10| 2 0| v20)?(?: html)?
cpl-1.0; 3; common; common public license v(?:ersion)? ?1 0
ipl-1.0; 3; ibm; ibm public license(?: version)?(?: 1 0)?
cddl; 3; development; common development and distribution license (?:the license|cddl)(?: version 1 [01])?
cddl-1.0; 3; opensolaris; (?:usr src )?opensolaris license or http www opensolaris org os licensing
sissl; 3; sun; sun industry standards source license
bcl; 3; sun; sun microsystems inc binary code license agreement
oracle-bcl; 3; oracle; oracle binary code license agreement
oracle-tn; 3; oracle; oracle technology network (?:developer )?license(?: agreement)?
eupl; 3; eupl; licensed under the eupl(?: version)?(?: 1 [012])?
osl; 3; open; licensed under the open software license version(?: \d 0)?
afl; 3; academic; licensed under the academic free license version(?: \d \d)?
artistic-2.0; 3; artistic; (?:the )?artistic license 2 0 copyright
artistic; 3; artistic; under the (?:terms of the )?artistic license
artistic; 2; artistic; (?:same terms as perl itself .{0,80}? )?gnu general public license or the artistic license
perl; 3; perl; (?:free software you can redistribute it and or modify it )?under the same terms as perl(?: itself)?
boost-1.0; 3; boost; (?:distributed under the )?boost software license version 1 0 see accompanying file
boost-1.0; 3; boost; boost org license 1 0(?: txt)?
boost-1.0; 2; accompanying; accompanying documentation covered by this license the software
odbl-1.0; 3; database; made available under the open database license
odbl-1.0; 2; opendatacommons; opendatacommons org licenses odbl(?: 1 0)?
odc-by-1.0; 3; opendatacommons; opendatacommons org licenses by(?: 1 0)?
odc-by-1.0; 3; commons; open data commons attribution license
pddl-1.0; 3; dedication; public domain dedication and licen[cs]e(?: pddl)?
ofl-1.1; 3; sil; this font software is licensed under the sil open font license version 1 1
ofl; 2; ofl; (?:scripts sil org|openfontlicense org) ofl|scripts sil org cms scripts page php site id nrsi id ofl
ofl; 2; reserved; with reserved font name
psf-2; 3; python; psf license agreement for python(?: \d)?|python software foundation license version 2(?: psf)?
psf-2; 2; psf; psf hereby grants licensee
python; 2; beopen; beopen python open source license agreement
cnri; 3; cnri; cnri (?:open source|python)? ?license agreement
php-3.01; 3; php; the php license version 3 01
php; 2; php; this source file is subject to version 3 0?1? ?of the php license
php; 2; php; (?:www )?php net license(?: 3 0\d?)?(?: txt)?
zend-2.0; 3; zend; zend engine license(?: version 2 00)?
zpl; 3; zope; (?:subject to the provisions of the )?zope public license
lppl; 3; latex; conditions of the latex project public license
lppl; 2; latex; (?:www )?latex project org lppl(?: txt)?
ms-pl; 3; microsoft; microsoft public license(?: ms pl)? this license governs use of the accompanying software
ms-rl; 3; microsoft; microsoft reciprocal license(?: ms rl)? this license governs
ms-eula; 2; microsoft; microsoft software license terms
ms-limited; 3; microsoft; microsoft limited public license
zlib; 3; misrepresented; the origin of this software must not be misrepresented
zlib; 2; altered; altered source versions must be plainly marked as such
zlib; 2; express; this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng; 3; png; the png reference library is supplied as is
libtiff; 3; silicon; the names of sam leffler and silicon graphics may not be used
ncsa; 3; ncsa; university of illinois ncsa open source license
postgresql; 3; postgresql; postgresql database management system(?: formerly known as postgres.{0,40}?)? portions copyright
postgresql; 3; documentation; permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
unlicense; 3; unencumbered; this is free and unencumbered software released into the public domain
unlicense; 2; unlicense; (?:https? )?unlicense org
wtfpl; 3; fuck; do what the fuck you want to public license
wtfpl; 2; wtfpl; (?:www )?wtfpl net
vim; 3; vim; (?:distributed )?under the vim license|vim license which is in the file
ruby; 3; ruby; (?:under|to) the (?:same )?terms (?:as|of) (?:the )?ruby(?: license)?(?: itself)?|ruby s license
curl; 3; stenberg; copyright and permission notice copyright c .{1,60}? daniel stenberg
curl; 3; curl; curl license
openssl; 3; openssl; software developed by the openssl project for use in the openssl toolkit
ssleay; 3; cryptographic; this product includes cryptographic software written by eric young
libressl; 2; eric; copyright c \d{4}(?: \d{4})? eric young
ntp; 3; ntp; university of delaware .{0,200}? ntp|ntp license
icu; 3; icu; icu license icu 1 8 1 and later
unicode; 3; unicode; unicode inc license agreement data files and software
w3c; 3; w3c; w3c software (?:and document )?notice and license
x-net; 2; xfree86; xfree86 (?:project )?licen[cs]e
json; 3; evil; the software shall be used for good not evil
beerware; 3; beer; (?:the )?beer ?ware license|buy me a beer in return
jasper-2.0; 3; jasper; jasper (?:software )?license version 2 0
imagemagick; 3; imagemagick; imagemagick studio llc .{0,120}? license|imagemagick license
freetype; 3; freetype; the freetype project license
ijg; 3; jpeg; this software is based in part on the work of the independent jpeg group
sleepycat; 3; sleepycat; sleepycat (?:software )?(?:public )?license
sqlite-blessing; 3; blessing; the author disclaims copyright to this source code in place of a legal notice here is a blessing
bzip2; 3; bzip2; bzip2 (?:and libbzip2 )?license|this program bzip2 the associated library libbzip2
info-zip; 3; zip; info zip license|this is version \d{4} \w{3} \d{2} of the info zip license
tcl; 3; tcl; tcl tk license(?: terms)?
naumen; 3; naumen; naumen public license
nasa; 3; nasa; nasa open source agreement(?: version 1 3)?
nokia; 3; nokia; nokia open source license
intel; 3; intel; intel open source license
apsl; 3; apple; apple public source license(?: version 2 0)?
rpl; 3; reciprocal; reciprocal public license(?: 1 [15])?
qpl; 3; trolltech; q public license .{0,60}? trolltech
cpal; 3; attribution; common public attribution license(?: version 1 0)?(?: cpal)?
cecill; 3; cecill; licen[cs]e (?:(?:de logiciel libre|libre|free software) )?cecill(?: [bc])?
watcom; 3; watcom; sybase open watcom public license
hpnd; 3; historical; historical permission notice and disclaimer
sspl; 3; server; server side public license(?: version 1)?
busl; 3; business; business source license(?: 1 1)?
elastic; 3; elastic; elastic license(?: 2 0)?
confluent; 3; confluent; confluent community license
commons-clause; 3; commons; commons clause license condition(?: v1 0)?
polyform; 3; polyform; polyform (?:noncommercial|small business|shield|strict|perimeter) license
blueoak; 3; blue; blue oak model license(?: 1 0 0)?
mulan; 3; mulan; mulan psl v\d|mulan permissive software license
anti-996; 3; 996; anti 996 license
cc0-1.0; 3; zero; (?:cc0 1 0 universal )?creative commons zero|cc zero
cc0-1.0; 3; cc0; (?:licensed under |released under |dedicated to the public domain under )cc0
cc0-1.0; 3; publicdomain; creativecommons org publicdomain zero 1 0
public-domain; 2; creativecommons; creativecommons org (?:licenses )?publicdomain(?! zero)
cc-by; 3; creativecommons; creativecommons org licenses by(?: \d \d)?
cc-by-sa; 3; creativecommons; creativecommons org licenses by sa(?: \d \d)?
cc-by-nd; 3; creativecommons; creativecommons org licenses by nd(?: \d \d)?
cc-by-nc; 3; creativecommons; creativecommons org licenses by nc(?: \d \d)?
cc-by-nc-sa; 3; creativecommons; creativecommons org licenses by nc sa(?: \d \d)?
cc-by-nc-nd; 3; creativecommons; creativecommons org licenses by nc nd(?: \d \d)?
cc; 1; creative; (?:under|with) a creative commons licen[cs]e|creative commons licensed|some rights reserved .{0,60}? creative commons
openrail; 3; rail; (?:bigscience |bigcode |creativeml )?open rail(?: m)?(?: license)?
llama; 3; llama; llama \d(?: \d)? community license(?: agreement)?
gemma; 3; gemma; gemma terms of use
ogl; 3; government; open government licen[cs]e(?: v(?:ersion)? ?\d(?: 0)?)?
odc; 1; commons; open data commons
etalab; 3; etalab; licence ouverte(?: open licence)? etalab|etalab 2 0
public-domain; 2; domain; (?:released|dedicated|placed|committed) (?:in|to|into) the public domain
public-domain; 2; domain; this (?:work|file|software|text|code|book) is in the public domain
public-domain; 1; waived; all copyright and related rights (?:are )?waived
proprietary; 1; reserved; all rights reserved
proprietary; 2; confidential; confidential and proprietary
proprietary; 2; proprietary; proprietary (?:software|source code|information|license)
proprietary; 2; reproduced; no part of this (?:publication|work|book|document|site) may be reproduced
proprietary; 2; unauthori[sz]ed; unauthori[sz]ed (?:copying|reproduction|distribution|use) of this (?:file|work|software|material) .{0,60}?prohibited
proprietary; 1; permission; without (?:the )?(?:express |prior )?written permission of
proprietary; 2; eula; end user licen[cs]e agreement eula
commercial-no; 2; non; for non commercial (?:use|purposes) only
commercial-no; 2; noncommercial; for noncommercial (?:use|purposes) only
commercial-no; 2; personal; for (?:your )?personal (?:and|or) non ?commercial use
commercial-no; 1; commercial; (?:no|not for) commercial use
evaluation; 2; evaluation; for evaluation (?:use|purposes) only
educational; 2; educational; for educational (?:use|purposes) only
research-only; 2; research; for research (?:use|purposes) only
freeware; 1; freeware; this (?:program|software|font|game) is freeware
shareware; 1; shareware; this (?:program|software|game) is shareware
donationware; 1; donationware; donationware
dual; 1; dual; dual licensed
"""
#: What a signature of each priority is worth.
WORTH = {1: 0.6, 2: 0.8, 3: 0.95}


def _version(label: str, v: str) -> str:
    """The label of a version: its numbers joined by dots, words by hyphens."""
    return f"{label}-{re.sub(r' (?=[0-9])', '.', v).replace(' ', '-')}"


def _unfolded(trigger: str) -> list[str]:
    """The words of a trigger with one choice of letters."""
    choice = re.search(r"\[(\w+)\]", trigger)
    return [trigger.replace(choice[0], x) for x in choice[1]] if choice else [trigger]


def rules() -> list[tuple[int, str, int, float, list[str], str, bool]]:
    """(rule, label, priority, confidence, triggers, pattern, base), base rules first, then in fixed order.

    A rule runs on a text that has one of its trigger words: of a signature the word that each match holds; of
    a name the first word of each of its forms, also with a version joined to it.
    """
    found = [(label, 4, 1.0, [{"cc-by-nc": "nc"}.get(label) or label.split("-")[0]], phrase, True) for phrase, label in BASE]
    for line in SIGNATURES.strip().splitlines():
        label, p, trigger, pattern = (x.strip() for x in line.split(";"))
        found.append((label, int(p), WORTH[int(p)], _unfolded(trigger), pattern, False))
    for label, name, versions in FAMILIES:
        triggers = sorted({form.split()[0] for form in re.sub(r"^\(\?:|\)$", "", name).split("|") if "(" not in form.split()[0] and ")" not in form.split()[0]})
        for v in versions:
            joined = sorted({*triggers, *(t + x + v.split()[0] for t in triggers for x in ("", "v"))})
            found += [(_version(label, v), p, c, joined, form.format(n=name, v=v), False) for p, c, form in VERSIONED]
        found += [(label, p, c, triggers, form.format(n=name), False) for p, c, form in PLAIN]
    return [(i, label, p, c, triggers, f"(?<= )(?:{pattern})(?= )", base) for i, (label, p, c, triggers, pattern, base) in enumerate(found)]


def triggered(norm: Column) -> Column:
    """Whether folded words hold a trigger word of any rule: without one no rule runs."""
    return F.arrays_overlap(F.split(norm, " "), F.array(*[F.lit(t) for t in sorted({t for r in rules() for t in r[4]})]))


def normalised(text: Column) -> Column:
    """The words with one space between and around them."""
    return F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), BREAKS, " ")


def folded(norm: Column) -> Column:
    """Lower case, for rules of ASCII words: as folding A-Z alone, as the two other letters that fold to ASCII are changed before."""
    return F.lower(F.replace(F.replace(norm, F.lit("\u0130"), F.lit("\u0131")), F.lit("\u212a"), F.lit("\u0138")))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def _places(met: DataFrame, keys: list[str]) -> DataFrame:
    """``met`` with a row for each match of its pattern in norm: first and until (characters, from 0), and word, the words before.

    What lies between the matches and they themselves are rows of lengths first; running sums make them places.
    """
    matches, gaps = F.regexp_extract_all("norm", F.col("pattern"), F.lit(0)), F.split("norm", F.col("pattern"), -1)
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("match"), _spaces(g).alias("gap_words"), _spaces(m).alias("words")))
    kept = [c for c in met.columns if c not in ("norm", "pattern")]
    each = met.select(*kept, F.posexplode(sizes).alias("_at", "_s")).select(*kept, "_at", "_s.*").repartition(*keys[:2])
    so_far = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    until, word = F.sum(F.col("gap") + F.col("match")).over(so_far), F.sum(F.col("gap_words") + F.col("words")).over(so_far) - F.col("words") - 1
    return each.select(*kept, (until - F.col("match")).cast("int").alias("first"), until.cast("int").alias("until"), word.cast("int").alias("word"))


def detections(texts: DataFrame) -> DataFrame:
    """(doc_id, row, label, base, confidence, first, until, word) that stand, from (doc_id, row, norm).

    A detection falls to one of no lower priority whose interval contains it: with the detections of a text
    by start, longest first, it does so iff one of those before it reaches as far. Base rules fall to none.
    """
    spark: SparkSession = texts.sparkSession
    known = rules()
    table = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[5], r[6]) for r in known], "rule int, label string, priority int, confidence double, pattern string, base boolean")
    triggers = sorted({t for r in known for t in r[4]})
    of = F.create_map(*[x for t in triggers for x in (F.lit(t), F.array(*[F.lit(r[0]) for r in known if t in r[4]]))])
    present = F.array_intersect(F.split("norm", " "), F.array(*[F.lit(t) for t in triggers]))
    chosen = texts.select("doc_id", "row", "norm", present.alias("present"))
    chosen = chosen.select("doc_id", "row", "norm", F.explode(F.array_distinct(F.flatten(F.transform("present", lambda t: of[t])))).alias("rule"))
    met = chosen.join(F.broadcast(table), "rule")  # a fixed table of some hundred rows
    each = _places(met.select("doc_id", "row", "rule", "label", "priority", "confidence", "base", "norm", "pattern"), ["doc_id", "row", "rule"])
    before = Window.partitionBy("doc_id", "row").orderBy("first", F.desc("until"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.lit(-1)
    for p in (4, 3, 2, 1):
        reach = F.greatest(reach, F.when(F.col("priority") <= p, F.coalesce(F.max(F.when(F.col("priority") == p, F.col("until"))).over(before), F.lit(-1))).otherwise(-1))
    return each.withColumn("_reach", reach).where(F.col("base") | (F.col("_reach") < F.col("until"))).drop("_reach", "rule", "priority")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of ``docs``.

    A null text is empty: no words, no labels (empty strings), no places (nulls), score 0. Repeated rows come
    back as often; rows with equal ids and other texts are scanned apart. The score is the surest rule's.
    """
    norm = normalised(F.col(text_column))
    texts = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("row"), norm.alias("norm")).withColumn("folded", folded(F.col("norm")))
    texts = texts.select("doc_id", "row", (_spaces(F.col("norm")) - 1).cast("long").alias("n_words"), F.when(triggered(F.col("folded")), F.col("folded")).alias("norm"))
    texts = stored(texts, "license-texts")
    # The texts left are few but slow: by number they are dealt over all partitions, whatever their bytes.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    open_ = texts.where(F.col("norm").isNotNull()).select("doc_id", "row", "norm")
    found = detections(open_.repartition(n, "doc_id", "row", "norm").distinct())
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    at = F.when(F.col("base"), F.col("word").cast("long"))
    per = found.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(
        F.count_if("base").alias("n_base"), F.min(at).alias("first_word"), F.max(at).alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("confidence").alias("score"),
    )
    out = texts.drop("norm").join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    filled = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return out.select("doc_id", "n_words", filled("n_base", 0), "first_word", "last_word", filled("base_labels", ""), filled("labels", ""), filled("score", 0.0))
