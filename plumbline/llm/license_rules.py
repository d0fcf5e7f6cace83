"""Hand-written license signatures.

One line is one rule: label; kind; keyword; pattern. Patterns run over words in lower case with one blank between them
(punctuation is gone: ``Apache-2.0`` reads ``apache 2 0``), and match whole words. A rule is tried only where its keyword is
one of the words, so every match of a rule must hold its keyword. Order matters last: of equal spans and kinds the earlier rule wins.
"""

from __future__ import annotations

# kind: (priority, confidence)
KINDS = {"text": (4, 0.99), "tag": (3, 0.98), "grant": (2, 0.95), "name": (1, 0.8), "hint": (0, 0.4)}

V2, V3 = r"(?:v|version )?2(?: 0)?", r"(?:v|version )?3(?: 0)?"

RULES_TEXT = r"""
mit; text; permission; permission is hereby granted free of charge to any person obtaining a copy of this software
mit; text; substantial; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit; tag; identifier; spdx license identifier mit
mit; grant; mit; (?:licensed|released|distributed|available|published|provided) (?:under|with) (?:the )?(?:terms of )?(?:the )?mit license
mit; grant; mit; (?:is|are) mit licensed
mit; name; mit; (?:the )?mit (?:expat )?license
mit; name; expat; (?:the )?expat license
mit-0; tag; identifier; spdx license identifier mit 0
mit-0; name; attribution; mit no attribution(?: license)?
apache-2.0; text; apache; licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0; text; obtain; you may obtain a copy of the license at https? www apache org licenses license 2 0
apache-2.0; tag; identifier; spdx license identifier apache 2 0
apache-2.0; grant; apache; (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? license(?: version)? 2(?: 0)?
apache-2.0; name; apache; apache(?: software)? license,?(?: version)? 2(?: 0)?
apache-2.0; name; apache; apache 2(?: 0)? licen[sc]ed?
apache-1.1; name; apache; apache(?: software)? license(?: version)? 1 1
apache-1.0; name; apache; apache(?: software)? license(?: version)? 1 0
apache; grant; apache; (?:licensed|released|distributed|available|published|provided) (?:under|with) (?:the )?(?:terms of )?(?:the )?apache(?: software)? license
apache; name; apache; apache(?: software)? license
gpl-3.0-or-later; text; option; either version 3 of the license or at your option any later version
gpl-2.0-or-later; text; option; either version 2 of the license or at your option any later version
gpl-3.0-only; tag; identifier; spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later; tag; identifier; spdx license identifier gpl 3 0 or later
gpl-2.0-only; tag; identifier; spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later; tag; identifier; spdx license identifier gpl 2 0 or later
gpl-1.0; tag; identifier; spdx license identifier gpl 1 0(?: only| or later)?
gpl-3.0; grant; gnu; under the terms of (?:the )?gnu general public license(?: as published by the free software foundation)? version 3
gpl-2.0; grant; gnu; under the terms of (?:the )?gnu general public license(?: as published by the free software foundation)? version 2
gpl-3.0; name; general; (?:gnu )?general public license v?(?:version )?3(?: 0)?
gpl-2.0; name; general; (?:gnu )?general public license v?(?:version )?2(?: 0)?
gpl-1.0; name; general; (?:gnu )?general public license v?(?:version )?1(?: 0)?
gpl-3.0; name; gplv3; (?:gnu )?gplv3(?: 0)?
gpl-2.0; name; gplv2; (?:gnu )?gplv2(?: 0)?
gpl-3.0; name; gpl; (?:gnu )?gpl (?:v|version )?3(?: 0)?
gpl-2.0; name; gpl; (?:gnu )?gpl (?:v|version )?2(?: 0)?
gpl; grant; gnu; (?:redistribute it and or modify it|licensed|released|distributed) under the (?:terms of the )?gnu general public license
gpl; grant; general; (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public license
gpl; name; general; (?:gnu )?general public license
gpl; name; gnu; gnu gpl
lgpl-3.0; text; lesser; gnu lesser general public license as published by the free software foundation either version 3
lgpl-2.1; text; lesser; gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-3.0; tag; identifier; spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.1; tag; identifier; spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.0; tag; identifier; spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-3.0; name; lesser; (?:gnu )?lesser general public license v?(?:version )?3(?: 0)?
lgpl-2.1; name; lesser; (?:gnu )?lesser general public license v?(?:version )?2 1
lgpl-2.0; name; library; (?:gnu )?library general public license(?: v?(?:version )?2(?: 0)?)?
lgpl; name; lesser; (?:gnu )?lesser general public license
lgpl; name; lgpl; (?:gnu )?lgpl(?: license)?
lgpl-3.0; name; lgplv3; (?:gnu )?lgplv3
lgpl-2.1; name; lgplv2; (?:gnu )?lgplv2(?: 1)?
agpl-3.0; text; affero; gnu affero general public license as published by the free software foundation either version 3
agpl-3.0; tag; identifier; spdx license identifier agpl 3 0(?: only| or later)?
agpl-1.0; tag; identifier; spdx license identifier agpl 1 0(?: only| or later)?
agpl-3.0; name; affero; (?:gnu )?affero general public license(?: v?(?:version )?3(?: 0)?)?
agpl-3.0; name; agplv3; (?:gnu )?agplv3
agpl; name; agpl; (?:gnu )?agpl(?: license)?
gfdl-1.3; text; documentation; under the terms of the gnu free documentation license version 1 3
gfdl-1.2; text; documentation; under the terms of the gnu free documentation license version 1 2
gfdl; name; documentation; (?:gnu )?free documentation license
gfdl; tag; identifier; spdx license identifier gfdl 1 [123](?: only| or later)?
bsd; text; redistribution; redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause; text; endorse; neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-4-clause; text; advertising; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause; tag; identifier; spdx license identifier bsd 2 clause
bsd-3-clause; tag; identifier; spdx license identifier bsd 3 clause
bsd-4-clause; tag; identifier; spdx license identifier bsd 4 clause
bsd-0-clause; tag; identifier; spdx license identifier 0bsd
bsd-2-clause; name; bsd; (?:bsd (?:2|two) clause|(?:2|two) clause bsd)(?: license)?
bsd-3-clause; name; bsd; (?:bsd (?:3|three) clause|(?:3|three) clause bsd)(?: license)?
bsd-4-clause; name; bsd; (?:bsd (?:4|four) clause|(?:4|four) clause bsd)(?: license)?
bsd-2-clause; name; simplified; simplified bsd(?: license)?
bsd-3-clause; name; bsd; (?:new|revised|modified) bsd(?: license)?
bsd-0-clause; name; zero; (?:bsd )?zero clause(?: bsd)?(?: license)?
bsd; grant; bsd; (?:licensed|released|distributed|available) under (?:the |a )?(?:terms of )?(?:the )?bsd(?: style)? license
bsd; name; bsd; (?:the )?bsd(?: style)? license
isc; text; permission; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc; text; permission; permission to use copy modify and or distribute this software for any purpose with or without fee
isc; tag; identifier; spdx license identifier isc
isc; name; isc; (?:the )?isc license
mpl-2.0; text; mozilla; this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1; text; mozilla; the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0; tag; identifier; spdx license identifier mpl 2 0
mpl-1.1; tag; identifier; spdx license identifier mpl 1 1
mpl-2.0; name; mozilla; mozilla public license,? (?:v |version )?2(?: 0)?
mpl-1.1; name; mozilla; mozilla public license,? (?:v |version )?1 1
mpl-1.0; name; mozilla; mozilla public license,? (?:v |version )?1 0
mpl; name; mozilla; mozilla public license
epl-2.0; text; eclipse; made available under the terms of the eclipse public license v?(?: |version )?2(?: 0)?
epl-1.0; text; eclipse; made available under the terms of the eclipse public license v?(?: |version )?1(?: 0)?
epl-2.0; tag; identifier; spdx license identifier epl 2 0
epl-1.0; tag; identifier; spdx license identifier epl 1 0
epl-2.0; name; eclipse; eclipse public license (?:v |version )?2(?: 0)?
epl-1.0; name; eclipse; eclipse public license (?:v |version )?1(?: 0)?
epl; name; eclipse; eclipse public license
edl-1.0; name; eclipse; eclipse distribution license(?: (?:v |version )?1(?: 0)?)?
cddl-1.0; text; development; subject to the terms of the common development and distribution license
cddl-1.0; tag; identifier; spdx license identifier cddl 1 0
cddl-1.1; tag; identifier; spdx license identifier cddl 1 1
cddl; name; development; common development and distribution license
cpl-1.0; name; common; common public license(?: (?:v |version )?1(?: 0)?)?
cpal-1.0; name; attribution; common public attribution license(?: (?:v |version )?1(?: 0)?)?
ipl-1.0; name; ibm; ibm public license(?: (?:v |version )?1(?: 0)?)?
apsl-2.0; name; apple; apple public source license(?: (?:v |version )?2(?: 0)?)?
osl-3.0; tag; identifier; spdx license identifier osl 3 0
osl-3.0; name; open; open software license(?: (?:v |version )?3(?: 0)?)?
afl-3.0; tag; identifier; spdx license identifier afl 3 0
afl-3.0; name; academic; academic free license(?: (?:v |version )?3(?: 0)?)?
ecl-2.0; name; educational; educational community license(?: (?:v |version )?2(?: 0)?)?
artistic-2.0; tag; identifier; spdx license identifier artistic 2 0
artistic-1.0; tag; identifier; spdx license identifier artistic 1 0
artistic-2.0; name; artistic; artistic license (?:v |version )?2(?: 0)?
artistic-1.0; name; artistic; (?:the )?artistic license
artistic-1.0; grant; perl; same terms as perl(?: 5)? itself
bsl-1.0; text; boost; distributed under the boost software license version 1 0
bsl-1.0; tag; identifier; spdx license identifier bsl 1 0
bsl-1.0; name; boost; boost software license(?: (?:v |version )?1(?: 0)?)?
busl-1.1; tag; identifier; spdx license identifier busl 1 1
busl-1.1; name; business; business source license(?: (?:v |version )?1 1)?
zlib; text; altered; altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib; tag; identifier; spdx license identifier zlib
zlib; name; zlib; (?:the )?zlib(?: libpng)? license
libpng; name; libpng; (?:the )?libpng license
unlicense; text; unencumbered; this is free and unencumbered software released into the public domain
unlicense; tag; identifier; spdx license identifier unlicense
unlicense; name; unlicense; (?:the )?unlicense
wtfpl; tag; identifier; spdx license identifier wtfpl
wtfpl; name; wtfpl; wtfpl(?: license)?
cc0-1.0; text; waived; to the extent possible under law .{1,120}? waived all copyright and related or neighboring rights
cc0-1.0; tag; identifier; spdx license identifier cc0 1 0
cc0-1.0; name; cc0; (?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication| license)?
cc0-1.0; name; zero; creative commons zero
cc-by-4.0; tag; identifier; spdx license identifier cc by 4 0
cc-by-3.0; tag; identifier; spdx license identifier cc by 3 0
cc-by-sa-4.0; tag; identifier; spdx license identifier cc by sa 4 0
cc-by-sa-3.0; tag; identifier; spdx license identifier cc by sa 3 0
cc-by-nc-4.0; tag; identifier; spdx license identifier cc by nc 4 0
cc-by-nd-4.0; tag; identifier; spdx license identifier cc by nd 4 0
cc-by-nc-sa-4.0; tag; identifier; spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0; tag; identifier; spdx license identifier cc by nc nd 4 0
cc-by-nc-nd; name; attribution; (?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s? ?(?:works )?[1-4]? ?0?(?: international| unported| generic)?(?: license)?
cc-by-nc-nd; name; noderivs; (?:creative commons )?attribution non ?commercial noderivs(?: [1-4] 0)?(?: international| unported| generic)?(?: license)?
cc-by-nc-sa; name; noncommercial; (?:creative commons )?attribution noncommercial share ?alike(?: [1-4] 0)?(?: international| unported| generic)?(?: license)?
cc-by-nc; name; noncommercial; (?:creative commons )?attribution noncommercial(?: [1-4] 0)?(?: international| unported| generic)?(?: license)?
cc-by-sa; name; sharealike; (?:creative commons )?attribution sharealike(?: [1-4] 0)?(?: international| unported| generic)?(?: license)?
cc-by-nd; name; noderivatives; (?:creative commons )?attribution noderivatives(?: [1-4] 0)?(?: international| unported| generic)?(?: license)?
cc-by; name; commons; creative commons attribution(?: [1-4] 0)?(?: international| unported| generic)?(?: license)?
cc-by-nc-nd; grant; nd; (?:licensed|released|available|published) under (?:a |the )?(?:creative commons )?cc by nc nd(?: [1-4] 0)?
cc-by-nc-sa; grant; nc; (?:licensed|released|available|published) under (?:a |the )?(?:creative commons )?cc by nc sa(?: [1-4] 0)?
cc-by-nc; grant; nc; (?:licensed|released|available|published) under (?:a |the )?(?:creative commons )?cc by nc(?: [1-4] 0)?
cc-by-nd; grant; nd; (?:licensed|released|available|published) under (?:a |the )?(?:creative commons )?cc by nd(?: [1-4] 0)?
cc-by-sa; grant; sa; (?:licensed|released|available|published) under (?:a |the )?(?:creative commons )?cc by sa(?: [1-4] 0)?
cc-by; grant; cc; (?:licensed|released|available|published) under (?:a |the )?(?:creative commons )?cc by(?: [1-4] 0)?
cc-by-nc-nd; grant; creativecommons; creativecommons org licenses by nc nd(?: [1-4] 0)?
cc-by-nc-sa; grant; creativecommons; creativecommons org licenses by nc sa(?: [1-4] 0)?
cc-by-nc; grant; creativecommons; creativecommons org licenses by nc(?: [1-4] 0)?
cc-by-nd; grant; creativecommons; creativecommons org licenses by nd(?: [1-4] 0)?
cc-by-sa; grant; creativecommons; creativecommons org licenses by sa(?: [1-4] 0)?
cc-by; grant; creativecommons; creativecommons org licenses by(?: [1-4] 0)?
cc0-1.0; grant; creativecommons; creativecommons org publicdomain zero 1 0
public-domain-mark; grant; creativecommons; creativecommons org publicdomain mark 1 0
creative-commons; hint; commons; creative commons(?: license)?
ofl-1.1; text; sil; licensed under the sil open font license version 1 1
ofl-1.1; tag; identifier; spdx license identifier ofl 1 1
ofl-1.1; name; font; (?:sil )?open font license(?: (?:v |version )?1 1)?
postgresql; tag; identifier; spdx license identifier postgresql
postgresql; name; postgresql; (?:the )?postgresql license
python-2.0; name; license; (?:psf|python software foundation) license(?: agreement)?(?: (?:v |version )?2)?
python-2.0; name; foundation; python software foundation license(?: agreement)?(?: (?:v |version )?2)?
python-2.0; tag; identifier; spdx license identifier (?:python 2 0|psf 2 0)
php-3.01; name; php; php license(?: (?:v |version )?3(?: 0?1)?)?
ruby; name; ruby; ruby license
ruby; tag; identifier; spdx license identifier ruby
openssl; name; openssl; openssl license
openssl; tag; identifier; spdx license identifier openssl
eupl-1.2; tag; identifier; spdx license identifier eupl 1 2
eupl-1.1; tag; identifier; spdx license identifier eupl 1 1
eupl-1.2; name; european; european union public licen[sc]e(?: (?:v |version )?1 2)?
cecill-2.1; name; cecill; cecill(?: free software)? license(?: agreement)?(?: (?:v |version )?2(?: 1)?)?
cecill-2.1; tag; identifier; spdx license identifier cecill 2 1
ms-pl; name; microsoft; microsoft public license
ms-rl; name; microsoft; microsoft reciprocal license
ms-pl; tag; identifier; spdx license identifier ms pl
ms-rl; tag; identifier; spdx license identifier ms rl
ncsa; name; ncsa; (?:university of illinois )?ncsa open source license
ncsa; tag; identifier; spdx license identifier ncsa
upl-1.0; name; universal; universal permissive license(?: (?:v |version )?1(?: 0)?)?
upl-1.0; tag; identifier; spdx license identifier upl 1 0
odbl-1.0; name; database; open (?:data commons open )?database license(?: (?:v |version )?1(?: 0)?)?
odc-by-1.0; name; commons; open data commons attribution license(?: (?:v |version )?1(?: 0)?)?
pddl-1.0; name; dedication; open data commons public domain dedication(?: and)?(?: licen[sc]e)?
sspl-1.0; name; server; server side public license(?: (?:v |version )?1)?
elastic-2.0; name; elastic; elastic license(?: (?:v |version )?2(?: 0)?)?
polyform-noncommercial; name; polyform; polyform noncommercial license(?: 1 0 0)?
llama-community; name; llama; llama [2-4](?: [0-9])? community license(?: agreement)?
openrail-m; name; openrail; (?:creativeml |bigscience )?openrail(?: m(?: license)?| license)
blueoak-1.0.0; name; oak; blue oak model license(?: 1 0 0)?
w3c; name; w3c; w3c software(?: notice and| and document notice and)? license
x11; name; x11; x11 license
hpnd; name; historical; historical permission notice and disclaimer
curl; name; curl; curl license
beerware; name; license; beer ?ware license
sleepycat; name; sleepycat; sleepycat license
vim; name; vim; vim license
qpl-1.0; name; q; q public license(?: (?:v |version )?1(?: 0)?)?
public-domain; grant; domain; (?:released|placed|dedicated|committed) (?:in)?to the public domain
public-domain; name; domain; (?:this work|this file|this software|this document|it) is (?:in )?(?:the )?public domain
proprietary; grant; proprietary; proprietary and confidential
proprietary; text; prohibited; unauthorized copying of this (?:file|software|document) via any medium is strictly prohibited
all-rights-reserved; name; reserved; copyright .{0,60}? all rights reserved
no-warranty; hint; warranty; without warranty of any kind(?: express or implied)?
copyleft; hint; copyleft; copyleft(?: license)?
unknown-license; hint; license; (?:see|read) (?:the )?(?:accompanying )?license (?:file|txt|md) for (?:the )?(?:full |license )?(?:details|terms|information)
unknown-license; hint; under; (?:licensed|released|distributed) under (?:the|a) (?!gnu |mit |apache |bsd |mozilla |eclipse |creative |general |boost |academic |artistic |common )[a-z0-9]+(?: [a-z0-9]+){0,3} licen[sc]e
"""


def rules() -> list[tuple[int, str, int, float, str, str]]:
    """(number, label, priority, confidence, keyword, pattern) of every rule, in order."""
    out = []
    for line in RULES_TEXT.strip().splitlines():
        label, kind, keyword, pattern = (x.strip() for x in line.split(";", 3))
        out.append((len(out), label, *KINDS[kind], keyword, f"(?<= )(?:{pattern})(?= )"))
    return out
