"""License scanning by ordered signature rules.

A text is lower-cased (A-Z) and cut into words; the rules are regular expressions over the words
joined by single spaces.  A rule runs only where all words of one of its prefilters occur, which one
Aho-Corasick pass over the text finds out.  The prefilters come from the pattern: the listed keywords
that every match has as words, else other words that every match has, else a prefilter per spelling.  Detections are intervals of words.  One is suppressed if a detection
of better rank covers it: rank is the rule's priority, then the longer interval, then the earlier
rule.  What survives gives the labels.

Defined results: a null text is an empty one, without words or detections.  A text of any length
is scanned whole; the work is linear in its words and n log n in its detections.  Equal texts give
equal results, repeated rows included.  Existing columns of the same name are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache
from re import _parser as regex
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import append_columns, texts

#: Everything that is no word character becomes a space, A-Z become a-z.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_GAPS = re.compile(rb"  +")

#: Rules in order of text: label | priority (1 best) | keywords | pattern over lower-case words.
#: Keywords say which words to look for first; those that a match can do without are not needed.
#: Priorities: 1 license texts, 2 grants and notices, 3 identifiers and names with a version,
#: 4 names, 5 mentions.
SIGNATURES = r"""
gpl | 4 | gnu general public | gnu general public license
apache | 4 | apache license | apache license
cc-by | 4 | cc by | cc by
mit | 4 | mit license | mit license
gpl-1.0 | 3 | gnu general public | gnu general public license (?:as published by the free software foundation )?(?:either )?(?:v|version )1
gpl-2.0 | 3 | gnu general public | gnu general public license (?:as published by the free software foundation )?(?:either )?(?:v|version )2(?: 0)?
gpl-3.0 | 3 | gnu general public | gnu general public license (?:as published by the free software foundation )?(?:either )?(?:v|version )3(?: 0)?
gpl-1.0-or-later | 2 | gnu general public later | gnu general public license as published by the free software foundation either version 1 (?:of the license )?or at your option any later version
gpl-2.0-or-later | 2 | gnu general public later | gnu general public license as published by the free software foundation either version 2 (?:of the license )?or at your option any later version
gpl-3.0-or-later | 2 | gnu general public later | gnu general public license as published by the free software foundation either version 3 (?:of the license )?or at your option any later version
gpl-2.0-only | 2 | gnu general public | under the terms of (?:the )?gnu general public license version 2 (?:only )?as published by the free software foundation
gpl-3.0-only | 2 | gnu general public | under the terms of (?:the )?gnu general public license version 3 (?:only )?as published by the free software foundation
gpl-1.0 | 3 | gpl | gpl 1 0(?: only| or later)?
gpl-2.0 | 3 | gpl | gpl 2 0(?: only| or later)?
gpl-3.0 | 3 | gpl | gpl 3 0(?: only| or later)?
gpl-2.0 | 3 | gplv2 | gplv2(?: only| or later)?
gpl-3.0 | 3 | gplv3 | gplv3(?: only| or later)?
gpl-2.0 | 3 | gpl | gpl (?:v|version )2
gpl-3.0 | 3 | gpl | gpl (?:v|version )3
gpl-2.0 | 1 | gnu general public 1991 | gnu general public license version 2 june 1991
gpl-3.0 | 1 | gnu general public 2007 | gnu general public license version 3 29 june 2007
gpl-1.0 | 1 | gnu general public 1989 | gnu general public license version 1 february 1989
gpl-2.0 | 1 | copyleft conditions translated | this general public license applies to most of the free software foundation s software
gpl-3.0 | 1 | copyleft | the gnu general public license is a free copyleft license for software and other kinds of works
gpl | 2 | free redistribute gnu | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | 2 | warranty gnu | see the gnu general public license for more details
gpl | 2 | received gnu | you should have received a copy of the gnu general public license
gpl | 2 | licensed gnu | (?:is )?licensed under the (?:terms of the )?gnu general public license
gpl | 2 | released gnu | (?:is )?released under the (?:terms of the )?gnu general public license
gpl | 2 | distributed gnu | (?:is )?distributed under the (?:terms of the )?gnu general public license
gpl | 5 | gpl licensed | (?:licensed|released|distributed|available) under (?:the )?gpl
gpl | 4 | gnu gpl | gnu gpl
gpl-classpath | 3 | classpath exception | gpl 2 0 with classpath exception(?: 2 0)?
gpl-classpath | 2 | linking exception combined | as a special exception the copyright holders of this library give you permission to link
gpl-gcc-exception | 3 | gcc runtime | gcc runtime library exception(?: version)?(?: 3 1)?
gpl-font-exception | 2 | embed font exception | as a special exception if you create a document which uses this font
lgpl-2.0 | 3 | library general public | gnu library general public license(?: as published by the free software foundation)?(?: either)?(?: version 2(?: 0)?)?
lgpl-2.1 | 3 | lesser general public | gnu lesser general public license (?:as published by the free software foundation )?(?:either )?(?:v|version )2 1
lgpl-3.0 | 3 | lesser general public | gnu lesser general public license (?:as published by the free software foundation )?(?:either )?(?:v|version )3(?: 0)?
lgpl-2.1-or-later | 2 | lesser general public later | gnu lesser general public license as published by the free software foundation either version 2 1 (?:of the license )?or at your option any later version
lgpl-3.0-or-later | 2 | lesser general public later | gnu lesser general public license as published by the free software foundation either version 3 (?:of the license )?or at your option any later version
lgpl | 4 | lesser general public | gnu lesser general public license
lgpl | 4 | lesser general public | lesser general public license
lgpl-2.0 | 3 | lgpl | lgpl 2 0(?: only| or later)?
lgpl-2.1 | 3 | lgpl | lgpl 2 1(?: only| or later)?
lgpl-3.0 | 3 | lgpl | lgpl 3 0(?: only| or later)?
lgpl-2.1 | 3 | lgplv2 | lgplv2(?: 1)?
lgpl-3.0 | 3 | lgplv3 | lgplv3
lgpl-2.1 | 1 | lesser 1999 | gnu lesser general public license version 2 1 february 1999
lgpl | 5 | lgpl licensed | (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?lgpl
agpl-3.0 | 3 | affero general public | gnu affero general public license (?:as published by the free software foundation )?(?:either )?(?:v|version )3(?: 0)?
agpl-3.0-or-later | 2 | affero general public later | gnu affero general public license as published by the free software foundation either version 3 (?:of the license )?or at your option any later version
agpl | 4 | affero general public | (?:gnu )?affero general public license
agpl-3.0 | 3 | agpl | agpl 3 0(?: only| or later)?
agpl-3.0 | 3 | agplv3 | agplv3
agpl-3.0 | 1 | affero 2007 | gnu affero general public license version 3 19 november 2007
sspl-1.0 | 3 | server side public | server side public license(?: version 1| v1)?
sspl-1.0 | 3 | sspl | sspl 1 0
gfdl-1.1 | 3 | free documentation | gnu free documentation license version 1 1
gfdl-1.2 | 3 | free documentation | gnu free documentation license version 1 2
gfdl-1.3 | 3 | free documentation | gnu free documentation license version 1 3
gfdl | 4 | free documentation | (?:gnu )?free documentation license
gfdl | 3 | gfdl | gfdl 1 [123](?: only| or later)?
gfdl | 2 | invariant cover texts | with no invariant sections no front cover texts and no back cover texts
apache-1.0 | 3 | apache 1 0 | apache (?:software )?license (?:version )?1 0
apache-1.1 | 3 | apache 1 | apache (?:software )?license (?:version )?1 1
apache-2.0 | 3 | apache 2 | apache license (?:version )?2(?: 0)?
apache-2.0 | 3 | apache v2 | apache license v2(?: 0)?
apache-2.0 | 3 | apache | apache 2 0
apache-2.0 | 2 | licensed apache | licensed under the apache license version 2 0(?: the license)?
apache-2.0 | 2 | licensed apache | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0 | 2 | www apache licenses | www apache org licenses license 2 0(?: html| txt)?
apache-2.0 | 2 | asis conditions governing | you may not use this file except in compliance with the license
apache-2.0 | 2 | conditions governing limitations | see the license for the specific language governing permissions and limitations under the license
apache-2.0 | 1 | apache january 2004 | apache license version 2 0 january 2004
apache-1.1 | 1 | apache acknowledgment | this product includes software developed by the apache software foundation
apache | 5 | apache licensed | (?:licensed|released|distributed|available) under (?:the )?apache
cc-by-1.0 | 3 | cc by | cc by 1 0
cc-by-2.0 | 3 | cc by | cc by 2 0
cc-by-2.5 | 3 | cc by | cc by 2 5
cc-by-3.0 | 3 | cc by | cc by 3 0
cc-by-4.0 | 3 | cc by | cc by 4 0
cc-by-sa | 3 | cc by sa | cc by sa
cc-by-sa-1.0 | 3 | cc by sa | cc by sa 1 0
cc-by-sa-2.0 | 3 | cc by sa | cc by sa 2 0
cc-by-sa-2.5 | 3 | cc by sa | cc by sa 2 5
cc-by-sa-3.0 | 3 | cc by sa | cc by sa 3 0
cc-by-sa-4.0 | 3 | cc by sa | cc by sa 4 0
cc-by-nc | 3 | cc by nc | cc by nc
cc-by-nc-2.0 | 3 | cc by nc | cc by nc 2 0
cc-by-nc-2.5 | 3 | cc by nc | cc by nc 2 5
cc-by-nc-3.0 | 3 | cc by nc | cc by nc 3 0
cc-by-nc-4.0 | 3 | cc by nc | cc by nc 4 0
cc-by-nd | 3 | cc by nd | cc by nd
cc-by-nd-3.0 | 3 | cc by nd | cc by nd 3 0
cc-by-nd-4.0 | 3 | cc by nd | cc by nd 4 0
cc-by-nc-sa | 3 | cc by nc sa | cc by nc sa
cc-by-nc-sa-2.0 | 3 | cc by nc sa | cc by nc sa 2 0
cc-by-nc-sa-3.0 | 3 | cc by nc sa | cc by nc sa 3 0
cc-by-nc-sa-4.0 | 3 | cc by nc sa | cc by nc sa 4 0
cc-by-nc-nd | 3 | cc by nc nd | cc by nc nd
cc-by-nc-nd-3.0 | 3 | cc by nc nd | cc by nc nd 3 0
cc-by-nc-nd-4.0 | 3 | cc by nc nd | cc by nc nd 4 0
cc-by | 2 | creative commons attribution | creative commons attribution (?:international |unported |generic )?(?:license )?(?:[1-4] [05])?
cc-by-sa | 2 | creative commons sharealike | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by-nc | 2 | creative commons noncommercial | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by-nd | 2 | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by-nc-sa | 2 | creative commons noncommercial sharealike | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by-nc-nd | 2 | creative commons noncommercial | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by | 2 | creativecommons licenses by | creativecommons org licenses by(?: [1-4] [05])?
cc-by-sa | 2 | creativecommons licenses by sa | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-nc | 2 | creativecommons licenses by nc | creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd | 2 | creativecommons licenses by nd | creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-nc-sa | 2 | creativecommons licenses nc sa | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-nd | 2 | creativecommons licenses nc nd | creativecommons org licenses by nc nd(?: [1-4] [05])?
cc0-1.0 | 3 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 2 | creativecommons zero | creativecommons org publicdomain zero(?: 1 0)?
cc0-1.0 | 1 | universal creative commons | creative commons (?:legal code )?cc0 1 0 universal
cc0-1.0 | 2 | dedicated waiving worldwide | dedicated the work to the public domain by waiving all of (?:his or her|their) rights to the work worldwide
cc-pdm | 2 | creativecommons mark | creativecommons org publicdomain mark(?: 1 0)?
cc-pddc | 2 | creativecommons publicdomain | creativecommons org licenses publicdomain
cc | 5 | creative commons | creative commons(?: license)?
mit | 1 | permission granted obtaining | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 1 | merchantability noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | 2 | permission notice substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 2 | licensed mit | (?:is )?licensed under the (?:terms of the )?mit license
mit | 2 | released mit | (?:is )?released under the (?:terms of the )?mit license
mit | 2 | distributed mit | (?:is )?distributed under the (?:terms of the )?mit license
mit | 2 | opensource mit | opensource org licenses mit(?: license)?(?: php)?
mit | 4 | mit licence | mit licence
mit | 4 | mit licensed | mit licensed
mit-0 | 3 | mit no attribution | mit no attribution(?: license)?
mit-0 | 3 | spdx mit 0 | spdx license identifier mit 0
mit-modern | 3 | mit modern variant | mit license modern variant
mit-advertising | 2 | enlightenment advertising | enlightenment license
mit-cmu | 3 | mit cmu | mit cmu
mit-feh | 3 | mit feh | mit feh
x11 | 4 | x11 | x11 license
x11 | 2 | consortium | except as contained in this notice the name of the x consortium shall not be used
expat | 4 | expat | expat license
bsd-0-clause | 3 | 0bsd | 0bsd
bsd-0-clause | 3 | zero clause bsd | (?:bsd zero clause|zero clause bsd)(?: license)?
bsd-1-clause | 3 | bsd 1 clause | bsd 1 clause(?: license)?
bsd-2-clause | 3 | bsd 2 clause | bsd 2 clause(?: license)?
bsd-2-clause | 3 | simplified bsd | simplified bsd(?: license)?
bsd-2-clause | 3 | freebsd | freebsd (?:copyright|license)
bsd-2-clause-patent | 3 | bsd 2 clause patent | bsd 2 clause patent
bsd-3-clause | 3 | bsd 3 clause | bsd 3 clause(?: license)?
bsd-3-clause | 3 | new bsd | (?:new|modified|revised) bsd(?: license)?
bsd-3-clause | 3 | modified bsd | modified bsd(?: license)?
bsd-3-clause-clear | 3 | bsd clear | bsd 3 clause clear(?: license)?
bsd-4-clause | 3 | bsd 4 clause | bsd 4 clause(?: license)?
bsd-4-clause | 3 | original bsd | original bsd(?: license)?
bsd-source-code | 3 | bsd source code | bsd source code
bsd-protection | 3 | bsd protection | bsd protection license
bsd | 1 | redistribution binary permitted | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | 2 | redistributions retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 2 | redistributions reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | 2 | endorse promote contributors | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | 2 | advertising acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | 4 | bsd license | bsd license
bsd | 4 | bsd licence | bsd licence
bsd | 4 | berkeley software | berkeley software distribution
isc | 1 | permission modify distribute fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 4 | isc license | isc license
isc | 4 | isc licensed | isc licensed
isc | 2 | internet consortium | internet (?:software|systems) consortium
mpl-1.0 | 3 | mozilla public | mozilla public license (?:version |v )?1 0
mpl-1.1 | 3 | mozilla public | mozilla public license (?:version |v )?1 1
mpl-2.0 | 3 | mozilla public | mozilla public license (?:version |v )?2 0
mpl-1.1 | 3 | mpl | mpl 1 1
mpl-2.0 | 3 | mpl | mpl 2 0
mpl-2.0 | 2 | mozilla source | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | 2 | mozilla mpl | mozilla org mpl 2 0
mpl-1.1 | 2 | mozilla contents file | the contents of this file are subject to the mozilla public license version 1 1
mpl | 4 | mozilla public | mozilla public license
epl-1.0 | 3 | eclipse public | eclipse public license (?:version |v )?1 0
epl-2.0 | 3 | eclipse public | eclipse public license (?:version |v )?2 0
epl-1.0 | 3 | epl | epl 1 0
epl-2.0 | 3 | epl | epl 2 0
epl | 2 | eclipse legal | www eclipse org legal epl(?: v10| 2 0| v20)?
epl | 4 | eclipse public | eclipse public license
edl-1.0 | 3 | eclipse distribution | eclipse distribution license(?: v)?(?: 1 0)?
cpl-1.0 | 3 | common public | common public license(?: version)?(?: 1 0)?
ipl-1.0 | 3 | ibm public | ibm public license(?: version)?(?: 1 0)?
cddl-1.0 | 3 | common distribution | common development and distribution license(?: version| v)? 1 0
cddl-1.1 | 3 | common distribution | common development and distribution license(?: version| v)? 1 1
cddl-1.0 | 3 | cddl | cddl 1 0
cddl-1.1 | 3 | cddl | cddl 1 1
cddl | 4 | common distribution | common development and distribution license
eupl-1.1 | 3 | eupl | eupl (?:v ?)?1 1
eupl-1.2 | 3 | eupl | eupl (?:v ?)?1 2
eupl | 4 | european public | european union public licen[cs]e
cecill-2.1 | 3 | cecill | cecill (?:version )?2 1
cecill-b | 3 | cecill | cecill b
cecill-c | 3 | cecill | cecill c
cecill | 4 | cecill | cecill
artistic-1.0 | 3 | artistic | artistic license 1 0(?: perl)?
artistic-2.0 | 3 | artistic | artistic license (?:version )?2 0
artistic-2.0 | 3 | artistic | artistic 2 0
artistic | 4 | artistic | artistic license
perl | 2 | perl itself | under the same terms as perl itself
python-2.0 | 3 | python software foundation | python software foundation license(?: version 2)?
python-2.0 | 3 | psf | psf 2 0
python-cnri | 3 | cnri | cnri (?:open source )?license agreement
ruby | 4 | ruby license | ruby license
php-3.0 | 3 | php license | php license (?:version |v )?3 0
php-3.01 | 3 | php license | php license (?:version |v )?3 01
php | 2 | php includes | this product includes php software
zlib | 1 | misrepresented origin | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 4 | zlib license | zlib license
libpng | 4 | libpng | libpng license(?: version 2)?
bsl-1.0 | 1 | boost software | boost software license version 1 0(?: august 17th 2003)?
bsl-1.0 | 3 | bsl | bsl 1 0
bsl | 4 | boost software | boost software license
busl-1.1 | 3 | business source | business source license(?: version)?(?: 1 1)?
busl-1.1 | 3 | busl | busl 1 1
elastic-2.0 | 3 | elastic license | elastic license(?: version)?(?: 2 0)?
commons-clause | 3 | commons clause | commons clause(?: license condition)?(?: v1 0)?
unlicense | 1 | unencumbered public domain | this is free and unencumbered software released into the public domain
unlicense | 2 | unlicense org | unlicense org
unlicense | 4 | unlicense | the unlicense
wtfpl | 1 | fuck public | do what the fuck you want to public license
wtfpl | 3 | wtfpl | wtfpl(?: 2 0)?
beerware | 3 | beerware | beer ?ware license
beerware | 1 | beer return | you can buy me a beer in return
public-domain | 4 | public domain | (?:released|placed|dedicated|is) (?:in|into|to) the public domain
public-domain | 5 | public domain | public domain
openssl | 3 | openssl | openssl license
openssl | 1 | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | 1 | ssleay cryptographic | this product includes cryptographic software written by eric young
curl | 4 | curl license | curl license
icu | 4 | icu license | icu license
unicode-dfs | 3 | unicode terms | unicode (?:inc )?license agreement data files and software
w3c | 3 | w3c software | w3c software (?:and document )?(?:notice and )?license
w3c-document | 3 | w3c document | w3c document license
ofl-1.1 | 1 | sil open font | sil open font license version 1 1(?: 26 february 2007)?
ofl-1.1 | 3 | ofl | ofl 1 1
ofl | 4 | open font license | open font license
ms-pl | 3 | microsoft public | microsoft public license(?: ms pl)?
ms-rl | 3 | microsoft reciprocal | microsoft reciprocal license(?: ms rl)?
ms-pl | 3 | ms pl | ms pl
ms-rl | 3 | ms rl | ms rl
afl-3.0 | 3 | academic free | academic free license(?: version| v)?(?: [123] [01])?
osl-3.0 | 3 | open software license | open software license(?: version| v)?(?: [123] [01])?
ecl-2.0 | 3 | educational community | educational community license(?: version)?(?: [12] 0)?
ncsa | 3 | ncsa | (?:university of illinois )?ncsa open source license
upl-1.0 | 3 | universal permissive | universal permissive license(?: upl)?(?: version| v)?(?: 1 0)?
qpl-1.0 | 3 | q public | q public license(?: version)?(?: 1 0)?
lppl | 3 | latex public | latex project public license(?: version)?(?: 1 [0-3][abc]?)?
sleepycat | 4 | sleepycat | sleepycat license
postgresql | 4 | postgresql license | postgresql licen[cs]e
vim | 4 | vim license | vim license
ijg | 2 | independent jpeg | this software is based in part on the work of the independent jpeg group
freetype | 4 | freetype | freetype (?:project )?license
imagemagick | 4 | imagemagick | imagemagick license
odbl-1.0 | 3 | open database | open (?:data commons open )?database license(?: v)?(?: 1 0)?
odc-by-1.0 | 3 | data commons attribution | open data commons attribution license(?: v)?(?: 1 0)?
pddl-1.0 | 3 | public domain dedication | (?:open data commons )?public domain dedication (?:and|&) license(?: v)?(?: 1 0)?
cdla-permissive | 3 | community data permissive | community data license agreement permissive(?: version)?(?: [12] 0)?
cdla-sharing | 3 | community data sharing | community data license agreement sharing(?: version)?(?: 1 0)?
ogl-uk | 3 | open government | open government licence(?: v)?(?: [123] 0)?
openrail | 3 | openrail | (?:bigscience |creativeml )?open ?rail(?: m)?(?: license)?
llama-community | 3 | llama community | llama [234](?: [123])? community license(?: agreement)?
proprietary | 5 | all rights reserved | all rights reserved
proprietary | 2 | confidential proprietary | confidential and proprietary
proprietary | 2 | unauthorized copying | unauthorized copying of this (?:file|software) (?:via any medium )?is strictly prohibited
spdx | 5 | spdx identifier | spdx license identifier
dual | 5 | dual licensed | dual licensed
"""

#: The rules whose labels a caller may count on, by label.
BASE = ("apache", "cc-by", "gpl", "mit")
_STRENGTH = {1: 1.0, 2: 0.9, 3: 0.75, 4: 0.6, 5: 0.3}


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: tuple[bytes, ...]
    pattern: re.Pattern
    #: a match has all words of one of these
    needs: tuple[frozenset[bytes], ...] = ()


class Detection(NamedTuple):
    rule: int
    label: str
    priority: int
    first: int
    last: int


#: Stands for characters that a match may choose; a word with it is not known.
_ANY = "\0"


def _spellings(parsed) -> set[str]:
    """All texts that a parsed pattern matches, with ``_ANY`` for what is free."""
    out = {""}
    for op, arg in parsed:
        if op is regex.LITERAL:
            ways = {chr(arg)}
        elif op is regex.SUBPATTERN:
            ways = _spellings(arg[-1])
        elif op is regex.BRANCH:
            ways = set().union(*map(_spellings, arg[1]))
        elif op is regex.MAX_REPEAT and arg[:2] == (0, 1):
            ways = {""} | _spellings(arg[2])
        elif op in (regex.IN, regex.ANY) or (op is regex.MIN_REPEAT and arg[0] > 0):
            ways = {_ANY}
        else:
            raise ValueError(f"no prefilter for {op} in a license rule")
        out = {a + b for a in out for b in ways}
    return out


def prefilters(pattern: str, keywords: list[str]) -> tuple[frozenset[bytes], ...]:
    """Sets of words such that every match of the pattern has all words of one of them."""
    spelled = {frozenset(w for w in x.split() if _ANY not in w) for x in _spellings(regex.parse(pattern))}
    always = frozenset.intersection(*spelled)
    if always:
        chosen = [always & set(keywords) or sorted(always, key=lambda w: (-len(w), w))[:3]]
    else:
        chosen = [x for x in spelled if not any(y < x for y in spelled)]
    return tuple(sorted((frozenset(w.encode() for w in x) for x in chosen), key=sorted))


def parse_rules(signatures: str) -> list[Rule]:
    out = []
    for line in signatures.strip().splitlines():
        label, priority, keywords, pattern = (x.strip() for x in line.split(" | ", 3))
        words = list(dict.fromkeys(keywords.split()))
        out.append(Rule(label, int(priority), tuple(w.encode() for w in words), re.compile(rf"(?<= )(?:{pattern})(?= )".encode()), prefilters(pattern, words)))
    return out


class Scanner:
    """Rules with their keyword prefilter."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        #: (rule, its keywords' numbers) per prefilter
        self.needs: list[tuple[int, frozenset[int]]] = []
        ids: dict[bytes, int] = {}
        for r, rule in enumerate(rules):
            for need in rule.needs:
                self.needs.append((r, frozenset(ids.setdefault(k, len(ids)) for k in sorted(need))))
        self.always = [r for r, need in self.needs if not need]
        self.by_keyword: dict[int, list[int]] = {}
        for i, (_, need) in enumerate(self.needs):
            for k in need:
                self.by_keyword.setdefault(k, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for k, i in ids.items():
            self.automaton.add_word(f" {k.decode()} ", i)
        self.automaton.make_automaton()

    def candidates(self, line: bytes) -> list[int]:
        """Rules with a prefilter all of whose words are among the words of the line, in order."""
        found = {i for _, i in self.automaton.iter(line.decode("latin-1"))}
        near = {i for k in found for i in self.by_keyword[k]}
        return sorted({r for r, need in map(self.needs.__getitem__, near) if need <= found}.union(self.always))

    def scan(self, text: bytes) -> tuple[int, list[Detection]]:
        """Number of words, and all detections in order of place and rule."""
        line = b" " + _GAPS.sub(b" ", text.translate(_WORDS)).strip() + b" "
        out = []
        for r in self.candidates(line):
            rule, at, place = self.rules[r], 0, 0
            for m in rule.pattern.finditer(line):
                place += line.count(b" ", at, m.start())
                at = m.start()
                out.append(Detection(r, rule.label, rule.priority, place - 1, place - 1 + m[0].strip().count(b" ")))
        return line.count(b" ") - 1 if len(line) > 2 else 0, sorted(out, key=lambda d: (d.first, d.rule, d.last))


@cache
def default_scanner() -> Scanner:
    return Scanner(parse_rules(SIGNATURES))


def rank(d: Detection) -> tuple:
    return d.priority, d.first - d.last, d.rule, d.first


def survivors(found: list[Detection]) -> list[Detection]:
    """Detections that none of better rank covers.

    Better ranks first: a detection is covered if, among those before it that start no later, one
    ends no earlier.  Cover is transitive, so the kept ones suffice; they are held by start with
    the running maximum of their ends, which only grows to the right among kept ones."""
    kept: list[Detection] = []
    starts: list[int] = []
    ends: list[int] = []
    for d in sorted(found, key=rank):
        i = bisect_right(starts, d.first)
        if i and ends[i - 1] >= d.last:
            continue
        kept.append(d)
        # a skyline: starts and ends both ascending, what the new interval covers goes
        j = i
        while j < len(ends) and ends[j] <= d.last:
            j += 1
        if i and starts[i - 1] == d.first:
            i -= 1
        starts[i:j], ends[i:j] = [d.first], [d.last]
    return sorted(kept, key=lambda d: (d.first, d.rule, d.last))


def confidence(kept: list[Detection]) -> float:
    """0 without a detection, else the odds that not all signs are chance, by the rules' strength."""
    doubt = 1.0
    for priority in sorted({d.priority for d in kept}):
        doubt *= 1.0 - min(0.99, _STRENGTH[priority])
    return round(1.0 - doubt, 6)


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_words`` and ``detections``: rule, label, priority, first and last word, kept."""

    def make():
        scanner = default_scanner()

        def one(text: bytes):
            n, found = scanner.scan(text)
            kept = set(survivors(found))
            return n, [{**d._asdict(), "kept": d in kept} for d in found]

        def compute(column: pa.Array):
            return list(zip(*map(one, texts(column))))

        return compute

    kind = "array<struct<rule: int, label: string, priority: int, first: bigint, last: bigint, kept: boolean>>"
    return append_columns(docs, [text_col], f"n_words bigint, detections {kind}", make)


def license_labels(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Labels by document: those of the four base rules with all their places, and of all rules
    after suppression, to which the base labels are always added."""

    def make():
        scanner = default_scanner()
        base = {i for i, r in enumerate(scanner.rules[: len(BASE)])}

        def one(text: bytes):
            n, found = scanner.scan(text)
            kept = survivors(found)
            places = [d for d in found if d.rule in base]
            own = {d.label for d in places}
            return (
                n,
                len(places),
                min((d.first for d in places), default=None),
                max((d.first for d in places), default=None),
                ",".join(sorted(own)),
                ",".join(sorted(own | {d.label for d in kept})),
                confidence(kept),
                len(found),
                len(kept),
            )

        def compute(column: pa.Array):
            return list(zip(*map(one, texts(column))))

        return compute

    outputs = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, n_detections bigint, n_kept bigint"
    return append_columns(docs, [text_col], outputs, make)
