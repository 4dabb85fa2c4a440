"""Licence signature rules: patterns over words in lower case, joined by single blanks, without punctuation."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """A smaller priority goes first. The pattern is tried where a word, or several, of the text begin with the keyword."""

    priority: int
    label: str
    keyword: str
    pattern: str
    confidence: float


#: label | keyword of the name | name | SPDX identifiers | keyword of the address | address; a minus where there is none of its own.
#: Every match of a pattern holds a word, or several, beginning with its keyword; a name without such a keyword is several lines.
_LICENSES = """
mit                | mit         | (?:x11 )?mit(?: x11)? licen[cs]e | mit(?: 0)? | opensource org | opensource org licenses? mit
mit                | expat       | expat(?: x11)? licen[cs]e | - | - | -
apache-2           | apache      | apache(?: software)? licen[cs]e(?: version| v)? 2(?: 0)? | apache 2 0 | apache | apache org licenses license 2 0
apache-1           | apache      | apache(?: software)? licen[cs]e(?: version| v)? 1(?: [01])? | apache 1 [01] | apache | apache org licenses license 1 [01]
gpl-2              | gnu         | gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v) ?2(?: 0)? | - | gnu | gnu org licenses(?: old licenses)? gpl 2 0
gpl-3              | gnu         | gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v) ?3(?: 0)? | - | gnu | gnu org licenses gpl 3 0
gpl-2              | gpl         | (?:gnu )?gpl ?(?:version |v ?)?2(?: 0)?(?: only| or later)? | gpl 2 0(?: only| or later)? | gpl | gpl 2 0 html
gpl-3              | gpl         | (?:gnu )?gpl ?(?:version |v ?)?3(?: 0)?(?: only| or later)? | gpl 3 0(?: only| or later)? | gpl | gpl 3 0 html
gpl                | gnu         | gnu general public licen[cs]e | - | gnu | gnu org copyleft gpl
lgpl-2.1           | lgpl        | (?:gnu )?lgpl ?(?:version |v ?)?2(?: [01])? | lgpl 2 [01](?: only| or later)? | lgpl | licenses lgpl 2 [01]
lgpl-3             | lgpl        | (?:gnu )?lgpl ?(?:version |v ?)?3(?: 0)? | lgpl 3 0(?: only| or later)? | lgpl | licenses lgpl 3 0
lgpl-2.1           | lesser      | gnu lesser general public licen[cs]e(?: version| v) ?2(?: [01])? | - | lesser | gnu org copyleft lesser
lgpl-2.1           | library general | gnu library general public licen[cs]e(?: version| v) ?2(?: [01])? | - | - | -
lgpl-3             | lesser      | gnu lesser general public licen[cs]e(?: version| v) ?3(?: 0)? | - | - | -
lgpl               | lesser      | gnu lesser general public licen[cs]e | - | - | -
agpl-3             | affero      | (?:gnu )?affero general public licen[cs]e(?:(?: version| v) ?3(?: 0)?)? | - | affero | affero org oagpl
agpl-3             | agpl        | (?:gnu )?agpl ?(?:version |v ?)?3(?: 0)? | agpl 3 0(?: only| or later)? | agpl | licenses agpl 3 0
gfdl               | documentation | gnu free documentation licen[cs]e(?:(?: version| v) ?1(?: [123])?)? | - | - | -
gfdl               | gfdl        | (?:gnu )?gfdl ?(?:version |v ?)?1(?: [123])? | gfdl 1 [123](?: (?:no )?invariants)?(?: only| or later)? | - | -
gfdl               | fdl         | (?:gnu )?fdl ?(?:version |v ?)?1(?: [123])? | - | fdl | licenses fdl 1 [123]
bsd-2-clause       | bsd         | (?:(?:simplified|freebsd) bsd|bsd (?:2|two) clause|(?:2|two) clause bsd)(?: licen[cs]e)? | bsd 2 clause(?: patent)? | bsd | opensource org licenses bsd 2 clause
bsd-3-clause       | bsd         | (?:(?:new|modified|revised) bsd|bsd (?:3|three) clause|(?:3|three) clause bsd)(?: licen[cs]e)? | bsd 3 clause(?: clear)? | bsd | opensource org licenses bsd 3 clause
bsd-4-clause       | bsd         | (?:(?:original|old) bsd|bsd (?:4|four) clause|(?:4|four) clause bsd)(?: licen[cs]e)? | bsd 4 clause | bsd | directory fsf org wiki license bsd 4 clause
bsd-0-clause       | bsd         | (?:bsd zero clause|zero clause bsd)(?: licen[cs]e)? | 0bsd | opensource org | opensource org licenses 0bsd
bsd                | bsd         | bsd licen[cs]e | bsd(?: style)? | bsd | opensource org licenses bsd license
bsd                | berkeley software | berkeley software distribution licen[cs]e | - | - | -
isc                | isc         | isc licen[cs]e | isc | isc | opensource org licenses isc
mpl-2              | mozilla     | mozilla public licen[cs]e(?: version| v)? ?2(?: 0)? | - | mozilla | mozilla org mpl 2 0
mpl-1.1            | mozilla     | mozilla public licen[cs]e(?: version| v)? ?1(?: [01])? | mpl 1 [01] | mozilla | mozilla org mpl(?: mpl)? 1 [01]
mpl-2              | mpl         | mpl ?(?:version |v ?)?2(?: 0)? | mpl 2 0(?: no copyleft exception)? | mpl | mpl 2 0 txt
epl-1              | eclipse     | eclipse public licen[cs]e(?: version| v)? ?1(?: 0)? | epl 1 0 | eclipse | eclipse org legal epl v10
epl-2              | eclipse     | eclipse public licen[cs]e(?: version| v)? ?2(?: 0)? | - | eclipse | eclipse org legal epl 2 0
epl-2              | epl         | epl ?(?:version |v ?)?2(?: 0)? | epl 2 0 | epl | epl v20
edl-1              | eclipse     | eclipse distribution licen[cs]e(?: version| v)? ?1(?: 0)? | - | eclipse | eclipse org org documents edl v10
cddl-1             | cddl        | cddl ?(?:version |v ?)?1(?: [01])? | cddl 1 [01] | cddl | opensource org licenses cddl 1 0
cddl-1             | common development | common development and distribution licen[cs]e(?: version| v)?(?: 1(?: [01])?)? | - | sun com | sun com cddl
cpl-1              | common public | common public licen[cs]e(?: version| v)? ?1(?: 0)? | cpl 1 0 | opensource org | opensource org licenses? cpl 1 0
ibm-pl-1           | ibm         | ibm public licen[cs]e(?: version| v)? ?1(?: 0)? | ipl 1 0 | opensource org | opensource org licenses? ipl 1 0
cc0-1              | cc0         | (?:creative commons )?cc0(?: 1 0)?(?: universal)? | cc0 1 0 | creativecommons | creativecommons org publicdomain zero(?: 1 0)?
cc-by              | creative commons | creative commons attribution(?: (?:[1234] 0))?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)? | - | creativecommons | creativecommons org licenses by
cc-by-sa           | creative commons | creative commons attribution share ?alike(?: [1234] 0)?(?: international| unported)?(?: licen[cs]e)? | - | creativecommons | creativecommons org licenses by sa
cc-by-nd           | creative commons | creative commons attribution no ?deriv(?:ative|ativework|ative work)?s?(?: [1234] 0)?(?: international| unported)?(?: licen[cs]e)? | - | creativecommons | creativecommons org licenses by nd
cc-by-nc           | creative commons | creative commons attribution non ?commercial(?: [1234] 0)?(?: international| unported)?(?: licen[cs]e)? | - | creativecommons | creativecommons org licenses by nc
cc-by-nc-sa        | creative commons | creative commons attribution non ?commercial share ?alike(?: [1234] 0)?(?: international| unported)?(?: licen[cs]e)? | - | creativecommons | creativecommons org licenses by nc sa
cc-by-nc-nd        | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative|ativework|ative work)?s?(?: [1234] 0)?(?: international| unported)?(?: licen[cs]e)? | - | creativecommons | creativecommons org licenses by nc nd
cc-by              | cc by       | cc by(?: [1234] 0)?(?: licen[cs]e)? | cc by [1234] [05] | - | -
cc-by-sa           | cc by sa    | cc by sa(?: [1234] 0)?(?: licen[cs]e)? | cc by sa [1234] [05] | - | -
cc-by-nd           | cc by nd    | cc by nd(?: [1234] 0)?(?: licen[cs]e)? | cc by nd [1234] [05] | - | -
cc-by-nc           | cc by nc    | cc by nc(?: [1234] 0)?(?: licen[cs]e)? | cc by nc [1234] [05] | - | -
cc-by-nc-sa        | cc by nc sa | cc by nc sa(?: [1234] 0)?(?: licen[cs]e)? | cc by nc sa [1234] [05] | - | -
cc-by-nc-nd        | cc by nc nd | cc by nc nd(?: [1234] 0)?(?: licen[cs]e)? | cc by nc nd [1234] [05] | - | -
unlicense          | unlicense   | (?:the )?unlicense | unlicense | unlicense | unlicense org
wtfpl              | wtfpl       | wtfpl(?: version 2)? | wtfpl | wtfpl | wtfpl net
zlib               | zlib        | zlib(?: libpng)? licen[cs]e | zlib(?: acknowledgement)? | zlib | zlib net zlib license
libpng             | libpng      | libpng licen[cs]e(?: version 2)? | libpng(?: 2 0)? | libpng | libpng org pub png src libpng license
boost-1            | boost       | boost software licen[cs]e(?:(?: version| v)? ?1(?: 0)?)? | bsl 1 0 | boost | boost org license 1 0
bsl-1.1            | business source | business source licen[cs]e(?: 1 1)? | busl 1 1 | mariadb com | mariadb com bsl11
artistic-2         | artistic    | artistic licen[cs]e(?: version)? 2(?: 0)? | artistic 2 0 | perlfoundation | perlfoundation org artistic licen[cs]e 2 ?0
artistic-1         | artistic    | artistic licen[cs]e(?: 1(?: 0)?)? | artistic 1 0(?: perl)? | artistic | opensource org licenses artistic license 1 0
python-2           | python      | python software foundation licen[cs]e(?:(?: version)? 2)? | (?:python|psf) 2 0 | python | python org psf license
ruby               | ruby        | ruby licen[cs]e | ruby | ruby | ruby lang org en about license
php-3              | php         | php licen[cs]e(?:(?: version| v)? ?3(?: 0[01]?)?)? | php 3 0[01]? | php | php net license 3 01
openssl            | openssl     | openssl(?: ssleay)? licen[cs]e | openssl | openssl | openssl org source license
postgresql         | postgresql  | postgresql licen[cs]e | postgresql | postgresql | postgresql org about licence
ncsa               | ncsa        | (?:university of illinois )?ncsa(?: open source)? licen[cs]e | ncsa | ncsa | opensource org licenses ncsa
afl-3              | academic free | academic free licen[cs]e(?:(?: version| v) ?3(?: 0)?)? | afl 3 0 | opensource org | opensource org licenses? afl 3 0
osl-3              | open software | open software licen[cs]e(?:(?: version| v) ?3(?: 0)?)? | osl 3 0 | opensource org | opensource org licenses? osl 3 0
ecl-2              | educational community | educational community licen[cs]e(?: version)? 2(?: 0)? | ecl 2 0 | opensource org | opensource org licenses? ecl 2 0
eupl-1.2           | european union | european union public licen[cs]e(?:(?: version| v)? ?1(?: [12])?)? | - | joinup | joinup ec europa eu software page eupl
eupl-1.2           | eupl        | eupl(?:(?: version| v)? ?1(?: [12])?)? | eupl 1 [12] | eupl | collection eupl eupl text
cecill-2           | cecill      | cecill(?: [bc])?(?: (?:free software )?licen[cs]e)?(?: (?:agreement|2(?: [01])?))? | cecill (?:2 [01]|[bc]) | cecill | cecill info licences
ms-pl              | microsoft   | microsoft public licen[cs]e(?: ms pl)? | ms pl | opensource org | opensource org licenses? ms pl
ms-rl              | microsoft   | microsoft reciprocal licen[cs]e(?: ms rl)? | ms rl | opensource org | opensource org licenses? ms rl
odbl-1             | open database | open (?:data commons )?open database licen[cs]e|open database licen[cs]e(?: odbl)? | odbl 1 0 | opendatacommons | opendatacommons org licenses odbl
odc-by-1           | open data commons | open data commons attribution licen[cs]e | odc by 1 0 | opendatacommons | opendatacommons org licenses by
pddl-1             | public domain dedication | public domain dedication and licen[cs]e(?: pddl)? | pddl 1 0 | opendatacommons | opendatacommons org licenses pddl
ofl-1.1            | open font   | (?:sil )?open font licen[cs]e(?:(?: version| v)? ?1(?: [01])?)? | ofl 1 [01](?: (?:no )?rfn)? | scripts sil | scripts sil org ofl
lppl-1.3           | latex project | latex project public licen[cs]e(?:(?: version)? 1(?: 3[abc]?)?)? | lppl 1 3[ac]? | latex project | latex project org lppl
sspl-1             | server side public | server side public licen[cs]e(?:(?: version| v)? ?1)? | sspl 1 0 | server side public | mongodb com licensing server side public license
elastic-2          | elastic     | elastic licen[cs]e(?:(?: version| v)? ?2(?: 0)?)? | elastic 2 0 | elastic | elastic co licensing elastic license
upl-1              | universal permissive | universal permissive licen[cs]e(?:(?: version| v)? ?1(?: 0)?)? | upl 1 0 | oss oracle | oss oracle com licenses upl
vim                | vim         | vim licen[cs]e | vim | vim | vimhelp org uganda
zpl-2              | zope        | zope public licen[cs]e(?:(?: version)? 2(?: [01])?)? | zpl 2 [01] | zope | zope org resources zpl
openldap           | openldap    | openldap public licen[cs]e(?: version 2 8)? | oldap 2 8 | openldap | openldap org software release license
qpl-1              | q public    | q public licen[cs]e(?: version 1 0)? | qpl 1 0 | opensource org | opensource org licenses? qpl 1 0
sleepycat          | sleepycat   | sleepycat licen[cs]e | sleepycat | sleepycat | opensource org licenses sleepycat
w3c                | w3c         | w3c(?: software)?(?: notice and)? licen[cs]e | w3c(?: 20150513)? | w3 | w3 org consortium legal(?: 2015)? copyright software
mulan-2            | mulan       | mulan psl(?: v2)?|mulan permissive software licen[cs]e | mulan ?psl 2 0 | mulan | license coscl org cn mulan ?psl ?2?
openrail           | rail        | (?:creativeml |bigscience )?(?:open )?rail(?: [ms]| plus plus)?(?: licen[cs]e) | - | licenses ai | licenses ai
llama              | llama       | llama(?: [23](?: [123])?)? community licen[cs]e(?: agreement)? | llama ?[23] | llama | ai meta com llama license
proprietary        | proprietary | (?:proprietary and confidential|proprietary licen[cs]e) | licenseref proprietary | - | -
all-rights-reserved | reserved    | all rights reserved | licenseref all rights reserved | - | -
public-domain      | public domain | (?:(?:released|dedicated|placed|is) (?:in|in to|into|to) the public domain|public domain dedication) | licenseref public domain | creativecommons | creativecommons org licenses publicdomain
"""

#: label | keyword | passage of the licence's own text
_PASSAGES = """
mit           | hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit           | provided as is | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit           | permission notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
bsd           | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd           | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd           | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd-3-clause  | endorse        | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-4-clause  | advertising    | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2      | applicable law | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2      | obtain a copy  | you may not use this file except in compliance with the license you may obtain a copy of the license
apache-2      | subject to the terms | subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive
gpl           | free software  | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl           | useful         | this program is distributed in the hope that it will be useful but without any warranty
gpl           | received a copy | you should have received a copy of the gnu general public license along with this program
lgpl          | free software  | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
agpl-3        | affero         | you should have received a copy of the gnu affero general public license along with this program
gpl           | everyone is permitted | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
isc           | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd-0-clause  | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
mpl-2         | source code form | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1       | contents of this file | the contents of this file are subject to the mozilla public license version 1 1
epl-2         | accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
epl-1         | accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
cddl-1        | contents of this file | the contents of this file are subject to the terms of the common development and distribution license
zlib          | in no event will | in no event will the authors be held liable for any damages arising from the use of this software
zlib          | altered source | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
boost-1       | organization obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense     | unencumbered   | this is free and unencumbered software released into the public domain
wtfpl         | what the       | you just do what the fuck you want to
cc0-1         | waive          | to the extent possible under law .{1,80}? waived all copyright and related or neighboring rights
cc-by         | creative commons | this work is licensed under a creative commons attribution
ofl-1.1       | font software  | this font software is licensed under the sil open font license
python-2      | psf hereby     | psf hereby grants licensee a nonexclusive royalty free world wide license
artistic-2    | intent         | the intent is that the copyright holder maintains some artistic control
openssl       | openssl        | this product includes software developed by the openssl project
postgresql    | written agreement | without a written agreement is hereby granted provided that the above copyright notice
ncsa          | deal with the software | to deal with the software without restriction including without limitation the rights to use
proprietary   | unauthorized   | unauthorized (?:copying|use|distribution)(?: or distribution)? of this (?:file|software|document)
proprietary   | trade secret   | contains (?:confidential and )?trade secrets?
gpl-3         | gnu            | gnu general public license version 3 29 june 2007
gpl-3         | gnu            | the gnu general public license is a free copyleft license for software and other kinds of works
gpl-2         | gnu            | gnu general public license version 2 june 1991
gpl           | freedom to     | the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change
lgpl-3        | gnu            | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
lgpl-2.1      | lesser         | this is the first released version of the lesser gpl
agpl-3        | remotely       | if your software can interact with users remotely through a (?:computer )?network you should also make sure that it provides a way for users to get its source
gfdl          | gnu            | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
apache-2      | apache         | apache license version 2 0 january 2004
apache-2      | derivative works | you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without modifications
isc           | disclaims      | the software is provided as is and the author disclaims all warranties with regard to this software
mpl-2         | world wide     | each contributor hereby grants you a world wide royalty free non exclusive license
epl-2         | eclipse        | the accompanying program is provided under the terms of this eclipse public license
cc-by         | creative commons | you accept and agree to be bound by the terms and conditions of this creative commons attribution
cc0-1         | jurisdictions  | the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights
zlib          | commercial applications | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
ofl-1.1       | open font      | the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects
wtfpl         | changing it    | copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
artistic-2    | free software  | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
php-3         | php            | this product includes php software freely available from
python-2      | python         | this license agreement is between the python software foundation psf and the individual or organization
unlicense     | compiled binary | anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
boost-1       | entire statement | the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included
ms-pl         | accompanying software | this license governs use of the accompanying software if you use the software you accept this license
odbl-1        | open database  | this .{1,60}? is made available under the open database license
sspl-1        | as a service   | if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available
bsl-1.1       | non production | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
elastic-2     | managed service | you may not provide the software to third parties as a hosted or managed service
llama         | royalty free limited | you are granted a non exclusive worldwide non transferable and royalty free limited license under meta s intellectual property
cecill-2      | cecill         | ce logiciel est r[eé]gi par la licence cecill
w3c           | fee or royalty | permission to copy modify and distribute this (?:work|software and its documentation) with or without modification for any purpose and without fee or royalty is hereby granted
upl-1         | larger works   | subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software .{1,200}? larger works
vim           | vim            | there are no restrictions on distributing unmodified copies of vim
ruby          | verbatim copies | you may make and give away verbatim copies of the source form of the software without restriction
lppl-1.3      | latex project  | this work may be distributed and or modified under the conditions of the latex project public license
sleepycat     | db software    | redistributions in any form must be accompanied by information on how to obtain complete source code for the db software
eupl-1.2      | eupl           | licensed under the eupl
cddl-1        | common development | this file and its contents are supplied under the terms of the common development and distribution license
"""

#: What may stand before a name where a text grants its licence.
_GRANT = r"(?:licen[cs]ed|released|distributed|available|provided|published|offered|redistributed|covered|governed) (?:under|by|with)(?: the| a| an)?(?: terms(?: and conditions)? of)?(?: the| a| an)?"


def rules() -> list[Rule]:
    """All rules in order. Each licence has a grant and a title rule, and an identifier and an address rule where it has its own; passages follow."""
    found = []
    for line in _LICENSES.strip().splitlines():
        label, keyword, name, spdx, place, address = (x.strip() for x in line.split(" | "))
        found += [Rule(20, label, keyword, f"{_GRANT} (?:{name})", 0.95), Rule(50, label, keyword, f"(?:{name})", 0.7)]
        if spdx != "-":
            found.append(Rule(10, label, "spdx", f"spdx license identifier (?:{spdx})", 1.0))
        if address != "-":
            found.append(Rule(30, label, place, f"(?:https? )?(?:www )?(?:{address})", 0.9))
    for line in _PASSAGES.strip().splitlines():
        label, keyword, passage = (x.strip() for x in line.split(" | "))
        found.append(Rule(40, label, keyword, passage, 0.98))
    return sorted(dict.fromkeys(found))
