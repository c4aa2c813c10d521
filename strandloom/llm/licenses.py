"""License scans with ordered signature rules, with DataFrame functions only.

Texts that no stem of ``STEMS`` admits are not scanned. The others are normalised to lower-case words between
single blanks. A rule is tried where one of its own keywords stands as a whole word, at every word: its place is
that of the longest text that its pattern gives there first. Rules come in levels (tags, license texts, notices,
names, hints). Level by level, the highest first, a detection is suppressed if it overlaps one of a higher level
that stays, or if its interval lies within that of another one of its own level (the same interval: within that
of the earlier rule). What is suppressed suppresses nothing.

Places come from the lengths between matches, summed by a window over a document's matches, and suppression from
running extremes over its detections in order of place; so the time grows with the number of detections (and
its logarithm), and nothing is compared pair by pair. Only numbers of detections are shuffled, no text.

Base phrases are judged apart from the rules and are never suppressed.

Cases: a null text is an empty one: no words, no places, score 0. Words are runs of letters, digits and
non-ASCII characters, A-Z lower-cased. Equal rows get equal results, each its own row; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CHARS

#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Levels, from the highest, with the confidence of their rules.
LEVELS = {"tag": 1.0, "text": 0.95, "notice": 0.9, "name": 0.8, "hint": 0.5}
# Identifiers of the SPDX list.
SPDX = (
    "0bsd aal afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 bsd-1-clause bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 busl-1.1 "
    "cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 "
    "cddl-1.0 cddl-1.1 cecill-2.1 cecill-b cpl-1.0 ecl-2.0 efl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 fsfap gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 hpnd ijg ipl-1.0 isc "
    "lgpl-2.0 lgpl-2.1 lgpl-3.0 lppl-1.3c mit mit-0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 odc-by-1.0 ofl-1.1 openssl osl-3.0 pddl-1.0 php-3.01 postgresql psf-2.0 python-2.0 ruby sspl-1.0 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1"
).split()
#: Labels of identifiers that go by another name here.
SAME = {"0bsd": "bsd-0-clause", "bsl-1.0": "boost-1", "psf-2.0": "python-2", "cc0-1.0": "cc0"}
# Label, level, keywords (any of which a match holds as whole words), pattern of a match in normalised words.
SIGNATURES = r"""
mit | text | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | text | permission notice | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software
mit | text | warranty | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
isc | text | permission | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
bsd-0-clause | text | permission | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is
hpnd | text | permission | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
hpnd-purpose | text | permission | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
bsd | text | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | text | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | text | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | text | endorse | nor the names of (?:its|his|their|the) contributors may be used to endorse or promote products derived from this software
bsd-4-clause | text | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2 | text | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | text | apache | you may obtain a copy of the license at https? www apache org licenses license 2 0
apache-2 | text | distributed | software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
apache-1.1 | text | apache | this product includes software developed by the apache (?:software foundation|group)
gpl-2 | text | general public license | terms of the gnu general public license as published by the free software foundation(?: either)? version 2
gpl-3 | text | general public license | terms of the gnu general public license as published by the free software foundation(?: either)? version 3
gpl-2 | text | general public license | terms of the gnu general public license version 2 as published by the free software foundation
gpl-3 | text | general public license | terms of the gnu general public license version 3 as published by the free software foundation
lgpl-2 | text | library general public license | terms of the gnu library general public license as published by the free software foundation(?: either)? version 2
lgpl-2.1 | text | lesser general public license | terms of the gnu lesser general public license as published by the free software foundation(?: either)? version 2 1
lgpl-3 | text | lesser general public license | terms of the gnu lesser general public license as published by the free software foundation(?: either)? version 3
agpl-3 | text | affero general public license | terms of the gnu affero general public license as published by the free software foundation(?: either)? version 3
gpl | text | general public license | you should have received a copy of the gnu general public license along with this program
lgpl | text | general public license | you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|library)
agpl-3 | text | affero general public license | you should have received a copy of the gnu affero general public license along with this program
gpl | text | general public license | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed gnu general public license
gfdl-1.3 | text | free documentation license | terms of the gnu free documentation license version 1 [123] or any later version published by the free software foundation
mpl-2 | text | mozilla public license | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | text | mozilla public license | the contents of this file are subject to the mozilla public license version 1 1
cddl-1 | text | common development and distribution license | the contents of this file are subject to the terms of the common development and distribution license
epl-1 | text | eclipse public license | accompanying materials are made available under the terms of the eclipse public license (?:v|version )?1 0
epl-2 | text | eclipse public license | accompanying materials are made available under the terms of the eclipse public license (?:v|version )?2 0
boost-1 | text | boost software license | distributed under the boost software license version 1 0
boost-1 | text | permission | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
zlib | text | misrepresented | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | text | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
unlicense | text | unencumbered | this is free and unencumbered software released into the public domain
cc0 | text | waived | has waived all copyright and related or neighboring rights
ofl-1.1 | text | open font license | this font software is licensed under the sil open font license version 1 1
openssl | text | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
postgresql | text | permission | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
python-2 | text | psf | psf is making python available to licensee on an as is basis
w3c | text | licensee | by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms and conditions
artistic-2 | text | artistic license | you may distribute this (?:program|package|software) under the terms of the artistic license 2 0
perl | text | perl | this (?:library|program|module) is free software you can redistribute it and or modify it under the same terms as perl itself
ruby | text | redistribute it | you can redistribute it and or modify it under (?:either the terms of the gpl|the same terms as ruby)
elastic-2 | text | managed service | you may not provide the software to third parties as a hosted or managed service
busl-1.1 | text | business source license | use of the licensed work is governed by the business source license
commons-clause | text | right to sell the software | the license does not grant to you the right to sell the software
proprietary | text | proprietary | this (?:software|file|document) (?:is|contains) (?:the )?(?:proprietary and confidential|confidential and proprietary)
proprietary | text | unauthorized | unauthorized copying of this (?:file|software|document) via any medium is strictly prohibited
mit | notice | mit | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?mit(?: x11| expat)? licen[sc]e
apache-2 | notice | apache | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?apache(?: software)? licen[sc]e(?: version)? 2(?: 0)?
gpl-2 | notice | general public license,general public licence,gpl | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:gnu )?(?:general public licen[sc]e|gpl)(?: version| v)? v?2(?: 0)?
gpl-3 | notice | general public license,general public licence,gpl | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:gnu )?(?:general public licen[sc]e|gpl)(?: version| v)? v?3(?: 0)?
bsd | notice | bsd | (?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of the )?bsd(?: style)? licen[sc]e
bsd-2-clause | notice | bsd,freebsd | (?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of the )?(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?
bsd-3-clause | notice | bsd | (?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of the )?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?
isc | notice | isc | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?isc licen[sc]e
mpl-2 | notice | mozilla public license,mozilla public licence,mpl | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:mozilla public licen[sc]e|mpl)(?: version| v)? v?2(?: 0)?
cc-by | notice | cc by,creative commons | (?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of the )?(?:cc by|creative commons attribution)(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?
cc-by-sa | notice | cc by sa,creative commons attribution | (?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of the )?(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?
cc-by-nc | notice | cc by nc,creative commons attribution | (?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of the )?(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?(?: international| unported)?(?: licen[sc]e)?
cc0 | notice | cc0 | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:creative commons )?cc0(?: 1 0)?(?: universal)?
odbl-1 | notice | odbl,open database license,open database licence | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:open database licen[sc]e|odbl)
public-domain | notice | public domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
unlicense | notice | unlicense | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?unlicense
python-2 | notice | psf | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?psf licen[sc]e
dual | notice | dual licensed | dual licensed under
mit | name | mit license,mit x11 license,mit expat license | mit(?: x11| expat)? license
mit | name | mit licence | mit licence
mit-0 | name | mit no attribution | mit no attribution(?: license)?
expat | name | expat license | expat license
x11 | name | x11 license | x11 license
apache-2 | name | apache license,apache software license | apache(?: software)? license(?: version| v)? v?2(?: 0)?
apache-2 | name | apache 2 | apache 2(?: 0)? licen[sc]e
apache-1.1 | name | apache license,apache software license | apache(?: software)? license(?: version)? 1 1
apache-1 | name | apache license,apache software license | apache(?: software)? license(?: version)? 1 0
gpl-1 | name | general public license | (?:gnu )?general public license(?: version| v)? v?1(?: 0)?
gpl-2 | name | general public license | (?:gnu )?general public license(?: version| v)? v?2(?: 0)?
gpl-3 | name | general public license | (?:gnu )?general public license(?: version| v)? v?3(?: 0)?
gpl-2 | name | gpl | (?:gnu )?gpl(?: version| v)? 2(?: 0)?
gpl-3 | name | gpl | (?:gnu )?gpl(?: version| v)? 3(?: 0)?
gpl-2 | name | gplv2 | gplv2(?: 0)?
gpl-3 | name | gplv3 | gplv3(?: 0)?
lgpl-2 | name | library general public license,lesser general public license | (?:gnu )?(?:lesser|library) general public license(?: version| v)? v?2(?: 0)?
lgpl-2.1 | name | lesser general public license | (?:gnu )?lesser general public license(?: version| v)? v?2 1
lgpl-3 | name | lesser general public license | (?:gnu )?lesser general public license(?: version| v)? v?3(?: 0)?
lgpl-2.1 | name | lgpl,lgplv2 | (?:gnu )?(?:lgpl(?: version| v)? v?2|lgplv2) 1
lgpl-3 | name | lgpl,lgplv3 | (?:gnu )?(?:lgpl(?: version| v)? v?3|lgplv3)(?: 0)?
agpl-3 | name | affero general public license | (?:gnu )?affero general public license(?: version| v)? v?3(?: 0)?
agpl-3 | name | agpl,agplv3 | (?:gnu )?(?:agpl(?: version| v)? v?3|agplv3)(?: 0)?
gfdl-1.2 | name | free documentation license | (?:gnu )?free documentation license(?: version)? 1 2
gfdl-1.3 | name | free documentation license | (?:gnu )?free documentation license(?: version)? 1 3
classpath-exception | name | classpath exception | classpath exception(?: 2 0)?
gcc-exception | name | gcc runtime library exception | gcc runtime library exception
llvm-exception | name | llvm exception,llvm exceptions | llvm exceptions?
font-exception | name | font exception | font exception(?: 2 0)?
bsd-1-clause | name | bsd | (?:bsd 1 clause|1 clause bsd)(?: license)?
bsd-2-clause | name | bsd | (?:bsd 2 clause|2 clause bsd|simplified bsd)(?: license)?
bsd-3-clause | name | bsd | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?
bsd-4-clause | name | bsd | (?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?
bsd-0-clause | name | 0bsd,zero clause bsd | (?:0bsd|zero clause bsd)(?: license)?
isc | name | isc license | isc license
mpl-1.1 | name | mozilla public license,mpl | (?:mozilla public license|mpl)(?: version| v)? v?1 1
mpl-2 | name | mozilla public license,mpl | (?:mozilla public license|mpl)(?: version| v)? v?2(?: 0)?
epl-1 | name | eclipse public license,epl | (?:eclipse public license|epl)(?: version| v)? v?1(?: 0)?
epl-2 | name | eclipse public license,epl | (?:eclipse public license|epl)(?: version| v)? v?2(?: 0)?
cddl-1 | name | common development and distribution license,cddl | (?:common development and distribution license|cddl)(?: version| v)? v?1(?: [01])?
cpl-1 | name | common public license | common public license(?: version)? 1(?: 0)?
eupl-1.1 | name | european union public licence,european union public license,eupl | (?:european union public licen[cs]e|eupl)(?: version| v)? v?1 1
eupl-1.2 | name | european union public licence,european union public license,eupl | (?:european union public licen[cs]e|eupl)(?: version| v)? v?1 2
cecill-2.1 | name | cecill | cecill(?: free software license agreement)?(?: version)? 2 1
artistic-1 | name | artistic license | artistic license(?: version)? 1(?: 0)?
artistic-2 | name | artistic license | artistic license(?: version)? 2(?: 0)?
zlib | name | zlib license,zlib libpng license | zlib(?: libpng)? license
boost-1 | name | boost software license | boost software license(?: version)?(?: 1 0)?
unlicense | name | the unlicense | the unlicense
wtfpl | name | wtfpl | wtfpl(?: version 2)?
postgresql | name | postgresql license | postgresql license
python-2 | name | python software foundation license,psf license | (?:python software foundation|psf) license(?: version 2| agreement)?
ofl-1.1 | name | open font license | (?:sil )?open font license(?: version)?(?: 1 1)?
ms-pl | name | microsoft public license,ms pl | (?:microsoft public license|ms pl)
ms-rl | name | microsoft reciprocal license,ms rl | (?:microsoft reciprocal license|ms rl)
osl-3 | name | open software license | open software license(?: version)?(?: 3 0)?
afl-3 | name | academic free license | academic free license(?: version)?(?: 3 0)?
ecl-2 | name | educational community license | educational community license(?: version)?(?: 2 0)?
ncsa | name | ncsa | (?:university of illinois )?ncsa open source license
upl-1 | name | universal permissive license | universal permissive license(?: version| v)?(?: 1 0)?
vim | name | vim license | vim license
lppl-1.3c | name | latex project public license | latex project public license(?: version)?(?: 1 3c)?
sspl-1 | name | server side public license | server side public license(?: version| v)?(?: 1)?
busl-1.1 | name | business source license | business source license(?: version)?(?: 1 1)?
elastic-2 | name | elastic license | elastic license(?: version| v)?(?: 2(?: 0)?)?
commons-clause | name | commons clause | commons clause
mulanpsl-2 | name | mulan permissive software license,mulan psl | (?:mulan permissive software license|mulan psl)(?: version| v)?(?: 2)?
odbl-1 | name | open database license,odbl | (?:open database license|odbl)(?: v)?(?: 1 0)?
odc-by-1 | name | open data commons attribution license | open data commons attribution license(?: v)?(?: 1 0)?
pddl-1 | name | public domain dedication and license | public domain dedication and license(?: v)?(?: 1 0)?
cc0 | name | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc0 | name | creative commons zero | creative commons zero(?: v)?(?: 1 0)?(?: universal)?
cc-by | name | cc by | cc by [1-4] [05]
cc-by | name | creative commons attribution | creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: license)?
cc-by-sa | name | cc by sa | cc by sa(?: [1-4] [05])?
cc-by-sa | name | creative commons attribution | creative commons attribution share ?alike(?: [1-4] [05])?
cc-by-nd | name | cc by nd | cc by nd(?: [1-4] [05])?
cc-by-nd | name | creative commons attribution | creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?
cc-by-nc | name | cc by nc | cc by nc(?: [1-4] [05])?
cc-by-nc | name | creative commons attribution | creative commons attribution non ?commercial(?: [1-4] [05])?
cc-by-nc-sa | name | cc by nc sa | cc by nc sa(?: [1-4] [05])?
cc-by-nc-sa | name | creative commons attribution | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc-nd | name | cc by nc nd | cc by nc nd(?: [1-4] [05])?
cc-by-nc-nd | name | creative commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?
llama-2 | name | llama 2 community license | llama 2 community license(?: agreement)?
openrail | name | openrail,rail license | (?:openrail(?: m)?|rail license)
gpl | hint | general public license,gpl | (?:gnu )?(?:general public license|gpl)
lgpl | hint | lesser general public license,lgpl | (?:gnu )?(?:lesser general public license|lgpl)
agpl | hint | affero general public license,agpl | (?:gnu )?(?:affero general public license|agpl)
bsd | hint | bsd license | bsd license
apache | hint | apache license | apache license
creative-commons | hint | creative commons license | creative commons license
public-domain | hint | public domain | public domain
proprietary | hint | all rights reserved | all rights reserved
proprietary | hint | proprietary license | proprietary license
unknown-license-reference | hint | license | see (?:the )?license(?: file)?(?: for details)?
"""
#: One of these a lower-cased text must hold, or an acronym as a whole word, for any rule or base phrase to fit.
STEMS = tuple(
    "licen gpl permission warrant redistribut apache endorse advertis misrepresented unencumbered waived openssl managed commons proprietary unauthorized attribution exception bsd domain reserved openrail".split()
)
_EDGE = WORD_CHARS.replace("A-Z", "")
ACRONYMS = rf"(?i)(?<!{_EDGE})(?:cc0?|mpl|epl|cddl|eupl|cecill|odbl|wtfpl|psf|ms|ncsa|mulan)(?!{_EDGE})"


def rules() -> list[dict]:
    """All rules in order: tags of the SPDX list, then the signatures."""
    out = []
    for name in SPDX:
        label = SAME.get(name, re.sub(r"(?<=-\d)\.0$", "", name) if not name.startswith("cc") else re.sub(r"-[1-4]\.[05]$", "", name))
        out.append({"label": label, "level": "tag", "keywords": ["spdx license identifier"], "pattern": f"spdx license identifier {re.sub('[^0-9a-z]+', ' ', name)}(?: only| or later)?"})
    for line in SIGNATURES.strip().splitlines():
        label, level, keywords, pattern = line.split(" | ", 3)
        out.append({"label": label, "level": level, "keywords": keywords.split(","), "pattern": pattern})
    return out


def normalise(text: Column) -> Column:
    """Lower-case words, each between single blanks; a text without words gives one blank."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def admitted(text: Column) -> Column:
    """Whether a raw text holds any stem or acronym."""
    low = F.lower(text)
    out = F.lit(False)
    for stem in STEMS:
        out = out | F.contains(low, F.lit(stem))
    return out | text.rlike(ACRONYMS)


def _index(norm: Column, at: Column) -> Column:
    """The index of the word that begins after the blank at a position (from 1) of a normalised text."""
    before = F.substr(norm, F.lit(1), at)
    return F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))) - 1


def _first(norm: Column, phrase: str) -> Column:
    at = F.instr(norm, F.lit(f" {phrase} "))
    return F.when(at > 0, _index(norm, at))


def _last(norm: Column, phrase: str) -> Column:
    at = F.instr(F.reverse(norm), F.lit(f" {phrase} "[::-1]))
    return F.when(at > 0, _index(norm, F.length(norm) - at - len(phrase)))


def _matches(norm: Column) -> Column:
    """For each rule whose keywords occur: its number, and for each match its length and that of the text between.

    Matches are found by looking ahead from each word, so one may begin within another. A split at the same places
    gives the pieces between their beginnings.
    """
    every = F.array(*(F.struct(F.lit(i).alias("no"), F.array(*(F.lit(f" {k} ") for k in r["keywords"])).alias("keywords"), F.lit(r["pattern"]).alias("pattern")) for i, r in enumerate(rules())))
    tried = F.filter(every, lambda r: F.exists(r["keywords"], lambda k: F.contains(norm, k)))

    def places(r: Column) -> Column:
        found = F.transform(F.regexp_extract_all(norm, F.concat(F.lit("(?<= )(?=("), r["pattern"], F.lit(") )"))), lambda m: F.length(m))
        gaps = F.transform(F.split(norm, F.concat(F.lit("(?<= )(?="), r["pattern"], F.lit(" )")), -1), lambda g: F.length(g))
        return F.struct(r["no"].alias("no"), F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("size")).alias("places"))

    return F.filter(F.transform(tried, places), lambda m: F.size(m["places"]) > 0)


def _of_rule(values: list) -> Column:
    """What stands for a detection's rule in a list; null without a rule."""
    return F.when(F.col("no").isNotNull(), F.element_at(F.array(*map(F.lit, values)), F.col("no") + 1))


def detections(rows: DataFrame, key: str, norm: str, keep: list[str]) -> DataFrame:
    """One row for each detection, (key, keep, no, level, start, stop), and one without a rule for rows without any."""
    found = rows.select(key, *keep, F.explode_outer(F.when(F.col(norm).isNotNull(), _matches(F.col(norm)))).alias("m"))
    found = found.select(key, *keep, F.col("m.no").alias("no"), F.posexplode_outer("m.places").alias("k", "place")).repartition(key)
    so_far = Window.partitionBy(key, "no").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    order = {name: i for i, name in enumerate(LEVELS)}
    level = _of_rule([order[r["level"]] for r in rules()])
    start = F.sum("place.gap").over(so_far)
    return found.select(key, *keep, "no", level.alias("level"), start.alias("start"), (start + F.col("place.size")).alias("stop"))


def suppress(found: DataFrame, key: str) -> DataFrame:
    """Adds ``kept``: whether a detection stays. All windows have one order, so there is one sort."""
    order = Window.partitionBy(key).orderBy("start", F.desc("stop"), "no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = found.withColumn("kept", F.lit(False))
    for i in range(len(LEVELS)):
        # what stays of higher levels and begins before this one, and the next of them that begins after it
        reach = F.max(F.when(F.col("kept"), F.col("stop"))).over(before)
        following = F.expr(f"lead(CASE WHEN kept THEN start END) IGNORE NULLS OVER (PARTITION BY {key} ORDER BY start, stop DESC, no)")
        free = ~F.coalesce(reach > F.col("start"), F.lit(False)) & ~F.coalesce(following < F.col("stop"), F.lit(False))
        rows = rows.withColumn("free", (F.col("level") == i) & free)
        within = F.max(F.when(F.col("free"), F.col("stop"))).over(before) >= F.col("stop")
        rows = rows.withColumn("kept", F.col("kept") | F.coalesce(F.col("free") & ~F.coalesce(within, F.lit(False)), F.lit(False)))
    return rows.drop("free")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), n_rules and score."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("key"),
        docs[id_col].cast("long").alias("doc_id"),
        F.regexp_count(text, F.lit(f"{WORD_CHARS}+")).cast("long").alias("n_words"),
        F.when(admitted(text), normalise(text)).alias("norm"),
    )
    norm = F.col("norm")
    base = {
        "n_base": F.coalesce(sum((F.regexp_count(norm, F.lit(f"(?<= ){p}(?= )")) for p in BASE), F.lit(0)), F.lit(0)).cast("long"),
        "first_word": F.least(*(_first(norm, p) for p in BASE)).cast("long"),
        "last_word": F.greatest(*(_last(norm, p) for p in BASE)).cast("long"),
        "base_labels": F.array_sort(F.array_compact(F.array(*(F.when(F.contains(norm, F.lit(f" {p} ")), F.lit(label)) for p, label in BASE.items())))),
    }
    keep = ["doc_id", "n_words", *base]
    found = suppress(detections(rows.withColumns(base), "key", "norm", keep), "key")
    label, confidence = _of_rule([r["label"] for r in rules()]), _of_rule([LEVELS[r["level"]] for r in rules()])
    kept = lambda x: F.when(F.col("kept"), x)
    out = found.groupBy("key").agg(*(F.first(c).alias(c) for c in keep), F.collect_set(kept(label)).alias("found"), F.count(kept(F.lit(1))).alias("n_rules"), F.max(kept(confidence)).alias("confidence"))
    return out.select(
        *keep, F.array_sort(F.array_union("base_labels", "found")).alias("labels"), "n_rules",
        F.greatest(F.coalesce("confidence", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    """License phrases and signatures of every document."""
    from .common import table

    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def _sql() -> str:
    """The same in SQL, without stems: every rule at every word, and suppression by comparing pairs."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    order = list(LEVELS)
    values = ", ".join(f"({i}, {quoted(r['label'])}, {order.index(r['level'])}, {LEVELS[r['level']]}, [{', '.join(quoted(k) for k in r['keywords'])}], {quoted(r['pattern'])})" for i, r in enumerate(rules()))
    steps, above = "", "(SELECT * FROM d WHERE FALSE)"
    for i in range(len(order)):
        free = f"SELECT * FROM d WHERE level = {i}" + ("" if i == 0 else f" AND NOT EXISTS (SELECT 1 FROM k{i - 1} e WHERE e.doc_id = d.doc_id AND e.start < d.stop AND e.stop > d.start)")
        inside = f"SELECT 1 FROM f{i} e WHERE e.doc_id = f{i}.doc_id AND e.start <= f{i}.start AND e.stop >= f{i}.stop AND (e.start < f{i}.start OR e.stop > f{i}.stop OR e.no < f{i}.no)"
        steps += f"f{i} AS ({free}),\nk{i} AS (SELECT * FROM {above} UNION ALL SELECT * FROM f{i} WHERE NOT EXISTS ({inside})),\n"
        above = f"k{i}"
    return rf"""
WITH n AS (SELECT doc_id, regexp_replace(' ' || translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || ' ', '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g') AS s FROM documents),
rule(no, label, level, confidence, keywords, pattern) AS (VALUES {values}),
base(phrase, label) AS (VALUES ('under the mit license', 'mit'), ('apache license version 2', 'apache-2'), ('cc by nc', 'cc-by-nc')),
w AS (SELECT doc_id, s, CASE WHEN trim(s) = '' THEN [] ELSE string_split(trim(s), ' ') END AS w FROM n),
b AS (SELECT doc_id, label, i - 1 AS pos FROM w, base, unnest(generate_series(1, len(w))) AS u(i)
  WHERE contains(s, ' ' || phrase || ' ') AND array_to_string(w[i : i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
bb AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
t AS (SELECT doc_id, s, w, no, level, pattern FROM w, rule WHERE len(list_filter(keywords, lambda k: contains(s, ' ' || k || ' '))) > 0 AND regexp_matches(s, ' (' || pattern || ') ')),
p AS (SELECT doc_id, no, level, pattern, s, sum(length(x) + 1) OVER (PARTITION BY doc_id, no ORDER BY i) - length(x) AS start FROM (SELECT doc_id, no, level, pattern, s, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t)),
d AS (SELECT doc_id, no, level, start, start + length(m) AS stop FROM (SELECT *, regexp_extract(substr(s, CAST(start AS BIGINT) + 1, 2000), '^(' || pattern || ') ', 1) AS m FROM p) WHERE m <> ''),
{steps}kept AS (SELECT doc_id, list_distinct(list(label)) AS labels, max(confidence) AS confidence FROM {above} JOIN rule USING (no) GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(kept.labels, []), CASE WHEN base_labels IS NULL THEN [] ELSE string_split(base_labels, ',') END))), ',') AS labels,
  CAST(greatest(coalesce(confidence, 0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END) AS DOUBLE) AS score
FROM w LEFT JOIN bb USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


OP4_SQL = _sql()
