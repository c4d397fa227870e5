"""Signatures of licences, written by hand: label | keyword | weight | regular expression on lower-cased words, one space apart.

Order is priority. The keyword stands as whole words in every match of its rule, but for those of ``PARTS``, which stand anywhere in one.
In the expressions, LIC is licence in both spellings and UNDER the phrases that say under which terms a thing is given out; those are
asked for where a short identifier is an ordinary word or number too.
"""

from __future__ import annotations

PARTS = ("gpl", "apache2")
LIC = "licen[cs]e"
UNDER = "(?:(?:spdx )?licen[cs]e(?: identifier)?|(?:licensed|released|distributed|published|available|provided|offered) under|subject to|governed by|in accordance with)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?"

TABLE = """
mit | permission | 1.0 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | permission | 0.95 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | permission | 1.0 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
bsd-0-clause | permission | 0.95 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd | permission | 0.95 | permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted
ntp | permission | 0.9 | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
boost-1.0 | permission | 1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
ofl-1.1 | permission | 1.0 | permission is hereby granted free of charge to any person obtaining a copy of the font software
unicode | permission | 1.0 | permission is hereby granted free of charge to any person obtaining a copy of (?:the )?unicode data files
fsfap | permitted | 0.95 | copying and distribution of this file with or without modification are permitted in any medium without royalty
zlib | permission | 1.0 | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
bsd | redistribution | 0.95 | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions | 0.9 | redistributions of source code must retain the above copyright notice
bsd | redistributions | 0.9 | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | permission | 0.95 | the names? of (?:its|the|their) (?:contributors|copyright holders?) may (?:not )?be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | advertising | 0.95 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
warranty-disclaimer | warranty | 0.7 | the software is provided as is without warranty of any kind
warranty-disclaimer | warranty | 0.7 | without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
warranty-disclaimer | warranties | 0.7 | any express or implied warranties including but not limited to the implied warranties of merchantability
apache-2.0 | apache | 1.0 | you may not use this file except in compliance with the LIC you may obtain a copy of the LIC at https? (?:www )?apache org licenses LIC 2 0
apache-2.0 | apache | 0.99 | apache org licenses LIC 2 0(?: txt| html)?
apache-2.0 | applicable law | 0.95 | unless required by applicable law or agreed to in writing software distributed under the LIC is distributed on an as is basis
apache-1.1 | apache | 0.95 | this product includes software developed by the apache (?:software foundation|group)
apache-2.0 | apache | 0.99 | UNDER apache(?: software)? 2(?: 0)?(?: only| or later)?
apache-2.0 | apache | 0.95 | UNDER apache(?: software)? LIC(?: version)? v?2(?: 0)?
apache-2.0 | apache | 0.9 | apache (?:software )?LIC(?: version)? v?2(?: 0)?
apache-1.1 | apache | 0.9 | apache (?:software )?LIC(?: version)? v?1 1
apache-1.0 | apache | 0.9 | apache (?:software )?LIC(?: version)? v?1 0
apache-2.0 | apache2 | 0.85 | apache2(?: 0)? LIC
apache-2.0 | asl | 0.8 | asl 2 0
apache-2.0 | apache | 0.8 | apache 2 0
apache-1.1 | apache | 0.8 | apache 1 1
apache-1.0 | apache | 0.8 | apache 1 0
apache | apache | 0.95 | UNDER apache(?: software)? LIC
apache | apache | 0.8 | apache (?:software )?LIC
llvm-exception | llvm | 0.9 | LIC(?: version)?(?: v?2)?(?: 0)? with llvm exceptions?
mit-0 | mit | 0.99 | UNDER mit 0
mit-0 | mit | 0.9 | mit no attribution LIC
mit | mit | 0.99 | UNDER mit(?: LIC)?(?: only| or later)?
mit | mit | 0.8 | mit(?: style)? LIC
mit | expat | 0.95 | UNDER expat(?: LIC)?
mit | expat | 0.8 | expat LIC
mit | x11 | 0.9 | (?:mit )?x11(?: style)? LIC
mit | consortium | 0.85 | (?:mit )?x consortium LIC
mit-modern | modern variant | 0.9 | mit LIC modern variant
mit-cmu | cmu | 0.85 | (?:mit )?cmu(?: style)? LIC
isc | isc | 0.99 | UNDER isc(?: LIC)?
isc | isc | 0.8 | isc LIC
bsd-0-clause | 0bsd | 0.99 | UNDER 0bsd(?: LIC)?
bsd-0-clause | clause | 0.85 | (?:zero|0) clause bsd(?: LIC)?
bsd-1-clause | clause | 0.85 | (?:one|1) clause bsd(?: LIC)?
bsd-2-clause | clause | 0.95 | UNDER bsd 2 clause
bsd-2-clause | clause | 0.85 | (?:two|2) clause bsd(?: LIC)?
bsd-2-clause | clause | 0.85 | bsd (?:two|2) clause(?: simplified)?(?: LIC)?
bsd-2-clause | simplified | 0.85 | simplified bsd LIC
bsd-2-clause | freebsd | 0.85 | freebsd(?: documentation)? LIC
bsd-2-clause-patent | patent | 0.9 | bsd 2 clause(?: plus)? patent(?: LIC)?
bsd-3-clause | clause | 0.95 | UNDER bsd 3 clause
bsd-3-clause | clause | 0.85 | (?:three|3) clause bsd(?: LIC)?
bsd-3-clause | clause | 0.85 | bsd (?:three|3) clause(?: new| revised)?(?: LIC)?
bsd-3-clause | bsd | 0.85 | (?:new|modified|revised) bsd LIC
bsd-3-clause-clear | clear | 0.9 | bsd 3 clause clear(?: LIC)?
bsd-4-clause | clause | 0.85 | (?:four|4) clause bsd(?: LIC)?
bsd-4-clause | clause | 0.85 | bsd (?:four|4) clause(?: original)?(?: LIC)?
bsd-4-clause | bsd | 0.85 | (?:original|old) bsd LIC
bsd-protection | protection | 0.85 | bsd protection LIC
bsd | bsd | 0.95 | UNDER bsd(?: style)?(?: LIC)?
bsd | bsd | 0.8 | bsd(?: style| type)? LIC
agpl-3.0 | affero | 0.95 | (?:gnu )?affero general public LIC(?: version)? v?3(?: 0)?(?: or (?:any )?later)?
agpl-1.0 | affero | 0.9 | (?:gnu )?affero general public LIC(?: version)? v?1(?: 0)?
agpl | affero | 0.85 | (?:gnu )?affero general public LIC
agpl-3.0 | gpl | 0.9 | agpl 3 0(?: only| or later)
agpl | gpl | 0.8 | (?:gnu )?agpl(?: ?v?3(?: 0)?)?(?: only| or later)?
lgpl-2.1 | lesser | 0.95 | (?:gnu )?lesser general public LIC(?: as published by the free software foundation)?(?: either)?(?: version)? v?2 1(?: or (?:any )?later)?
lgpl-3.0 | lesser | 0.95 | (?:gnu )?lesser general public LIC(?: as published by the free software foundation)?(?: either)?(?: version)? v?3(?: 0)?(?: or (?:any )?later)?
lgpl-2.0 | library | 0.95 | (?:gnu )?library general public LIC(?: version)? v?2(?: 0)?(?: or (?:any )?later)?
lgpl | lesser | 0.85 | (?:gnu )?lesser general public LIC
lgpl | library | 0.85 | (?:gnu )?library general public LIC
lgpl-2.0 | gpl | 0.9 | lgpl 2 0(?: only| or later)
lgpl-2.1 | gpl | 0.9 | lgpl 2 1(?: only| or later)
lgpl-3.0 | gpl | 0.9 | lgpl 3 0(?: only| or later)
lgpl | gpl | 0.8 | (?:gnu )?lgpl(?: ?v?[0-9](?: [0-9])?)?
gfdl-1.3 | documentation | 0.9 | (?:gnu )?free documentation LIC(?: version)? v?1 3
gfdl-1.2 | documentation | 0.9 | (?:gnu )?free documentation LIC(?: version)? v?1 2
gfdl-1.1 | documentation | 0.9 | (?:gnu )?free documentation LIC(?: version)? v?1 1
gfdl | documentation | 0.85 | (?:gnu )?free documentation LIC
gpl-1.0 | general public | 0.95 | (?:gnu )?general public LIC(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?1(?: 0)?
gpl-2.0 | general public | 0.95 | (?:gnu )?general public LIC(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?2(?: 0)?
gpl-3.0 | general public | 0.95 | (?:gnu )?general public LIC(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?3(?: 0)?
gpl-2.0 | general public | 0.95 | (?:gnu )?general public LIC v2(?: 0)?
gpl-3.0 | general public | 0.95 | (?:gnu )?general public LIC v3(?: 0)?
gpl-2.0 | later version | 0.9 | either version 2(?: 0)? of the LIC or (?:at your option )?any later version
gpl-3.0 | later version | 0.9 | either version 3(?: 0)? of the LIC or (?:at your option )?any later version
lgpl-2.1 | later version | 0.9 | either version 2 1 of the LIC or (?:at your option )?any later version
gpl | free software | 0.95 | this (?:program|library|file|software) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser |affero |library )?general public LIC
gpl | general public | 0.9 | you should have received a copy of the gnu (?:lesser |affero |library )?general public LIC
gpl-with-classpath | classpath | 0.9 | (?:gpl|general public LIC)(?: version)?(?: v?2)?(?: 0)? with (?:the )?classpath exception
gpl | general public | 0.8 | (?:gnu )?general public LIC
gpl-1.0 | gpl | 0.85 | gpl 1 0 only
gpl-2.0 | gpl | 0.9 | gpl 2 0 (?:only|or later)
gpl-3.0 | gpl | 0.9 | gpl 3 0 (?:only|or later)
gpl-2.0 | gpl | 0.85 | (?:gnu )?gpl ?(?:version |v ?)?2(?: 0)?
gpl-3.0 | gpl | 0.85 | (?:gnu )?gpl ?(?:version |v ?)?3(?: 0)?
gpl | gpl | 0.95 | UNDER (?:gnu )?gpl
gpl | gpl | 0.75 | (?:gnu )?gpl
mpl-2.0 | mozilla | 1.0 | this source code form is subject to the terms of the mozilla public LIC v ?2 0
mpl-2.0 | mozilla | 0.95 | mozilla public LIC(?: version)? v? ?2(?: 0)?
mpl-1.1 | mozilla | 0.95 | mozilla public LIC(?: version)? v?1 1
mpl-1.0 | mozilla | 0.95 | mozilla public LIC(?: version)? v?1 0
mpl | mozilla | 0.85 | mozilla public LIC
mpl-2.0 | mpl | 0.85 | mpl 2 0
mpl-1.1 | mpl | 0.85 | mpl 1 1
mpl-1.0 | mpl | 0.85 | mpl 1 0
npl-1.1 | netscape | 0.9 | netscape public LIC(?: version)? v?1 1
npl-1.0 | netscape | 0.9 | netscape public LIC(?: version)? v?1 0
npl | netscape | 0.85 | netscape public LIC
epl-2.0 | eclipse | 0.95 | eclipse public LIC(?: version)? v? ?2(?: 0)?
epl-1.0 | eclipse | 0.95 | eclipse public LIC(?: version)? v? ?1(?: 0)?
epl | eclipse | 0.85 | eclipse public LIC
edl-1.0 | eclipse | 0.9 | eclipse distribution LIC(?: version)?(?: v?1 0)?
epl-2.0 | epl | 0.85 | epl 2 0
epl-1.0 | epl | 0.85 | epl 1 0
cddl-1.1 | cddl | 0.9 | cddl 1 1
cddl-1.0 | cddl | 0.9 | cddl 1 0
cddl-1.1 | distribution | 0.9 | common development and distribution LIC(?: cddl)?(?: version)? v?1 1
cddl-1.0 | distribution | 0.85 | common development and distribution LIC(?: cddl)?(?:(?: version)? v?1 0)?
cpl-1.0 | common | 0.9 | common public LIC(?:(?: version)? v?1 0)?
cpl-1.0 | cpl | 0.85 | cpl 1 0
cpal-1.0 | attribution | 0.9 | common public attribution LIC(?:(?: version)? v?1 0)?
ipl-1.0 | ibm | 0.9 | ibm public LIC(?:(?: version)? v?1 0)?
eupl-1.2 | european | 0.9 | european union public LIC(?:(?: version)? v? ?1 2)?
eupl-1.1 | european | 0.9 | european union public LIC(?: version)? v? ?1 1
eupl-1.0 | european | 0.9 | european union public LIC(?: version)? v? ?1 0
eupl-1.2 | eupl | 0.85 | eupl 1 2
eupl-1.1 | eupl | 0.85 | eupl 1 1
cecill-2.1 | cecill | 0.9 | cecill(?: free software)? LIC(?: agreement)?(?: version)? v?2 1
cecill-b | cecill | 0.9 | cecill b LIC
cecill-c | cecill | 0.9 | cecill c LIC
cecill | cecill | 0.85 | cecill(?: free software)? LIC
osl-3.0 | open software | 0.9 | open software LIC(?: version)? v? ?3(?: 0)?
osl-2.1 | open software | 0.9 | open software LIC(?: version)? v? ?2 1
osl-2.0 | open software | 0.9 | open software LIC(?: version)? v? ?2 0
osl-1.0 | open software | 0.9 | open software LIC(?: version)? v? ?1 0
afl-3.0 | academic free | 0.9 | academic free LIC(?: version)? v? ?3(?: 0)?
afl-2.1 | academic free | 0.9 | academic free LIC(?: version)? v? ?2 1
afl-2.0 | academic free | 0.9 | academic free LIC(?: version)? v? ?2 0
afl | academic free | 0.85 | academic free LIC
ecl-2.0 | community | 0.9 | educational community LIC(?:(?: version)? v? ?2 0)?
artistic-2.0 | artistic | 0.95 | (?:the )?artistic LIC(?: version)? v? ?2(?: 0)?
artistic-1.0 | artistic | 0.95 | (?:the )?artistic LIC(?: version)? v? ?1(?: 0)?
artistic-2.0 | artistic | 0.99 | UNDER artistic 2 0
artistic-clarified | clarified | 0.9 | (?:the )?clarified artistic LIC
artistic | artistic | 0.85 | (?:the )?artistic LIC
perl | perl | 0.85 | (?:licensed|LIC) under the same terms as perl(?: 5)? itself
boost-1.0 | boost | 0.95 | boost software LIC(?: version)? v?1 0
boost-1.0 | boost | 0.85 | boost software LIC
boost-1.0 | bsl | 0.8 | bsl 1 0
busl-1.1 | business | 0.9 | business source LIC(?:(?: version)? v?1 1)?
busl-1.1 | busl | 0.85 | busl 1 1
sspl-1.0 | side | 0.9 | server side public LIC(?:(?: version)? v? ?1)?
elastic-2.0 | elastic | 0.9 | elastic LIC(?:(?: version)? v?2(?: 0)?)?
polyform-noncommercial | polyform | 0.9 | polyform non ?commercial LIC(?: 1 0 0)?
polyform-small-business | polyform | 0.9 | polyform small business LIC(?: 1 0 0)?
polyform-shield | polyform | 0.9 | polyform shield LIC(?: 1 0 0)?
commons-clause | commons clause | 0.9 | (?:the )?commons clause LIC(?: condition)?(?: v?1 0)?
prosperity | prosperity | 0.85 | prosperity public LIC
parity | parity | 0.85 | parity public LIC
blueoak-1.0.0 | blue oak | 0.9 | blue oak model LIC(?:(?: version)? 1 0 0)?
zlib | zlib | 0.99 | UNDER zlib(?: LIC)?
zlib | zlib | 0.8 | zlib(?: libpng)? LIC
libpng-2.0 | png | 0.9 | png reference library LIC(?: version)? 2
libpng | libpng | 0.8 | libpng LIC
libtiff | libtiff | 0.8 | libtiff LIC
ijg | independent jpeg | 0.85 | independent jpeg group(?: s)? LIC
info-zip | zip | 0.85 | info zip LIC
bzip2 | bzip2 | 0.85 | bzip2(?: and libbzip2)? LIC
curl | curl | 0.85 | curl(?: project)? LIC
openssl | openssl | 0.85 | openssl(?: project)? LIC
ssleay | ssleay | 0.85 | (?:original )?ssleay LIC
sleepycat | sleepycat | 0.85 | sleepycat LIC
php-3.01 | php | 0.95 | php LIC(?: version)? v?3 01
php-3.0 | php | 0.95 | php LIC(?: version)? v?3 0
php | php | 0.8 | php LIC
zend-2.0 | zend | 0.85 | zend(?: engine)? LIC(?:(?: version)? v?2 0)?
python-2.0 | python | 0.9 | python software foundation LIC(?:(?: version)? v?2)?
python-2.0 | psf | 0.99 | UNDER psf(?: 2 0)?
python-2.0 | python | 0.99 | UNDER python 2 0
python | python | 0.75 | python LIC
cnri-python | cnri | 0.85 | cnri(?: open source)?(?: python)? LIC
ruby | ruby | 0.99 | UNDER ruby(?: LIC)?
ruby | ruby | 0.8 | ruby(?: s)? LIC
postgresql | postgresql | 0.99 | UNDER postgresql(?: LIC)?
postgresql | postgresql | 0.8 | postgresql LIC
tcl | tcl | 0.85 | tcl(?: tk)? LIC
vim | vim | 0.85 | vim LIC
w3c | w3c | 0.85 | w3c (?:software )?(?:notice and )?(?:document )?LIC
unicode | unicode | 0.85 | unicode(?: inc)? LIC(?: agreement)?
icu | icu | 0.85 | icu LIC
ncsa | illinois | 0.9 | (?:university of )?illinois(?: ncsa)?(?: open source)? LIC
ncsa | ncsa | 0.85 | ncsa(?: open source)? LIC
ms-pl | microsoft | 0.9 | microsoft public LIC
ms-rl | microsoft | 0.9 | microsoft reciprocal LIC
ms-rsl | microsoft | 0.85 | microsoft reference source LIC
ms-pl | ms pl | 0.85 | (?:ms pl LIC|LIC ms pl)
intel | intel | 0.8 | intel(?: open source| simplified software)? LIC
apsl-2.0 | apple | 0.9 | apple public source LIC(?:(?: version)? v?2 0)?
apsl-1.0 | apple | 0.9 | apple public source LIC(?: version)? v?1 [0-2]
amd | amd | 0.8 | amd(?: s)? plpa(?: map c)? LIC
nvidia | nvidia | 0.8 | nvidia(?: source code| software)? LIC(?: agreement)?
oracle-upl | universal permissive | 0.9 | universal permissive LIC(?:(?: version)? v?1 0)?
oracle-bcl | binary code | 0.9 | oracle binary code LIC(?: agreement)?
nasa-1.3 | nasa | 0.9 | nasa open source agreement(?: version)? 1 3
nokia | nokia | 0.85 | nokia open source LIC
nosl-1.0 | netizen | 0.85 | netizen open source LIC
qpl-1.0 | q public | 0.9 | (?:the )?q public LIC(?:(?: version)? v?1 0)?
rpl-1.5 | reciprocal | 0.9 | reciprocal public LIC(?:(?: version)? v?1 5)?
rpsl-1.0 | realnetworks | 0.85 | realnetworks public source LIC
sgi-b-2.0 | sgi | 0.9 | sgi free software LIC b(?:(?: version)? v?2 0)?
simpl-2.0 | simple public | 0.85 | simple public LIC(?:(?: version)? v?2 0)?
sissl | industry | 0.85 | sun industry standards source LIC
spl-1.0 | sun public | 0.85 | sun public LIC(?:(?: version)? v?1 0)?
sugarcrm | sugarcrm | 0.85 | sugarcrm public LIC
vsl-1.0 | vovida | 0.85 | vovida software LIC(?:(?: version)? v?1 0)?
watcom-1.0 | watcom | 0.85 | sybase open watcom public LIC
wxwindows | wxwindows | 0.85 | wxwindows(?: library)? LIC
xfree86 | xfree86 | 0.85 | xfree86 LIC(?:(?: version)? v?1 1)?
xnet | x net | 0.85 | x net LIC
ypl-1.1 | yahoo | 0.85 | yahoo public LIC(?:(?: version)? v?1 1)?
zimbra | zimbra | 0.85 | zimbra public LIC
zpl-2.1 | zope | 0.9 | zope public LIC(?: version)? v?2 1
zpl-2.0 | zope | 0.9 | zope public LIC(?: version)? v?2 0
zpl | zope | 0.85 | zope public LIC
lppl-1.3c | latex | 0.9 | latex project public LIC(?: version)? v?1 3c?
lppl | latex | 0.85 | latex project public LIC
erlpl-1.1 | erlang | 0.85 | erlang public LIC(?:(?: version)? v?1 1)?
freetype | freetype | 0.85 | freetype(?: project)? LIC
imagemagick | imagemagick | 0.85 | imagemagick LIC
jasper | jasper | 0.85 | jasper LIC
json | json | 0.8 | json LIC
lucent-1.02 | lucent | 0.85 | lucent public LIC(?:(?: version)? v?1 02)?
mulan-psl-2.0 | mulan | 0.9 | mulan permissive software LIC(?:(?: version)? v?2)?
naumen | naumen | 0.85 | naumen public LIC
opl-1.0 | open public | 0.85 | open public LIC(?:(?: version)? v?1 0)?
openldap-2.8 | openldap | 0.9 | openldap public LIC(?:(?: version)? v?2 8)?
ogl-uk-3.0 | open government | 0.9 | open government LIC(?:(?: version)? v?3(?: 0)?)?
cern-ohl | hardware | 0.9 | cern open hardware LIC(?: version)?(?: v?[12](?: [02])?)?
solderpad | solderpad | 0.85 | solderpad(?: hardware)? LIC
tapr-ohl | tapr | 0.85 | tapr open hardware LIC
beerware | beer | 0.85 | (?:the )?beer ware LIC
beerware | beer | 0.85 | beer LIC
beerware | beerware | 0.85 | (?:the )?beerware LIC
wtfpl | wtfpl | 0.95 | UNDER wtfpl
wtfpl | want | 0.9 | do what the (?:fuck|f|heck) you want to public LIC
unlicense | unlicense | 0.9 | (?:the )?unlicense
unlicense | unencumbered | 0.95 | this is free and unencumbered software released into the public domain
public-domain | domain | 0.9 | (?:released|placed|dedicated) (?:in|in to|into|to) the public domain
public-domain | domain | 0.75 | (?:in|into|to) the public domain
pddl-1.0 | public domain | 0.9 | public domain dedication and LIC
cc0-1.0 | cc0 | 0.9 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc0-1.0 | zero | 0.9 | creative commons zero(?: v?1 0)?(?: universal)?
ofl-1.1 | sil | 0.9 | sil open font LIC(?:(?: version)? v?1 1)?
ofl-1.1 | ofl | 0.85 | ofl 1 1
ofl-1.0 | ofl | 0.85 | ofl 1 0
odbl-1.0 | database | 0.9 | open (?:data commons open )?database LIC(?:(?: version)? v?1 0)?
odbl-1.0 | odbl | 0.85 | odbl 1 0
odc-by-1.0 | data commons | 0.9 | open data commons attribution LIC(?:(?: version)? v?1 0)?
cdla-permissive | community data | 0.9 | community data LIC agreement permissive(?: version)?(?: v?[12] 0)?
cdla-sharing | community data | 0.9 | community data LIC agreement sharing(?: version)?(?: v?1 0)?
openrail | rail | 0.9 | (?:creativeml )?open rail(?: m)? LIC
openrail | openrail | 0.9 | (?:creativeml )?openrail(?: m)? LIC
openrail | responsible | 0.85 | responsible ai LIC
llama | llama | 0.9 | llama [0-9](?: [0-9])? community LIC(?: agreement)?
gemma | gemma | 0.85 | gemma(?: terms of use)? LIC
cc-by-nc-nd-4.0 | cc | 0.95 | cc by nc nd 4 0
cc-by-nc-nd-3.0 | cc | 0.95 | cc by nc nd 3 0
cc-by-nc-nd-2.5 | cc | 0.95 | cc by nc nd 2 5
cc-by-nc-nd-2.0 | cc | 0.95 | cc by nc nd 2 0
cc-by-nc-nd-1.0 | cc | 0.95 | cc by nc nd 1 0
cc-by-nc-sa-4.0 | cc | 0.95 | cc by nc sa 4 0
cc-by-nc-sa-3.0 | cc | 0.95 | cc by nc sa 3 0
cc-by-nc-sa-2.5 | cc | 0.95 | cc by nc sa 2 5
cc-by-nc-sa-2.0 | cc | 0.95 | cc by nc sa 2 0
cc-by-nc-sa-1.0 | cc | 0.95 | cc by nc sa 1 0
cc-by-nc-4.0 | cc | 0.95 | cc by nc 4 0
cc-by-nc-3.0 | cc | 0.95 | cc by nc 3 0
cc-by-nc-2.5 | cc | 0.95 | cc by nc 2 5
cc-by-nc-2.0 | cc | 0.95 | cc by nc 2 0
cc-by-nc-1.0 | cc | 0.95 | cc by nc 1 0
cc-by-nd-4.0 | cc | 0.95 | cc by nd 4 0
cc-by-nd-3.0 | cc | 0.95 | cc by nd 3 0
cc-by-nd-2.0 | cc | 0.95 | cc by nd 2 0
cc-by-sa-4.0 | cc | 0.95 | cc by sa 4 0
cc-by-sa-3.0 | cc | 0.95 | cc by sa 3 0
cc-by-sa-2.5 | cc | 0.95 | cc by sa 2 5
cc-by-sa-2.0 | cc | 0.95 | cc by sa 2 0
cc-by-sa-1.0 | cc | 0.95 | cc by sa 1 0
cc-by-4.0 | cc | 0.95 | cc by 4 0
cc-by-3.0 | cc | 0.95 | cc by 3 0
cc-by-2.5 | cc | 0.95 | cc by 2 5
cc-by-2.0 | cc | 0.95 | cc by 2 0
cc-by-1.0 | cc | 0.95 | cc by 1 0
cc-by-nc-nd | cc | 0.85 | cc by nc nd
cc-by-nc-sa | cc | 0.85 | cc by nc sa
cc-by-nc | cc | 0.85 | cc by nc
cc-by-nd | cc | 0.85 | cc by nd
cc-by-sa | cc | 0.85 | cc by sa
cc-by | cc | 0.8 | cc by
cc-by-nc-nd-4.0 | creative commons | 0.95 | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: international)?(?: public)?(?: LIC)? 4 0(?: international)?
cc-by-nc-sa-4.0 | creative commons | 0.95 | creative commons attribution non ?commercial share ?alike(?: international)?(?: public)?(?: LIC)? 4 0(?: international)?
cc-by-nc-4.0 | creative commons | 0.95 | creative commons attribution non ?commercial(?: international)?(?: public)?(?: LIC)? 4 0(?: international)?
cc-by-nd-4.0 | creative commons | 0.95 | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: international)?(?: public)?(?: LIC)? 4 0(?: international)?
cc-by-sa-4.0 | creative commons | 0.95 | creative commons attribution share ?alike(?: international)?(?: public)?(?: LIC)? 4 0(?: international)?
cc-by-4.0 | creative commons | 0.95 | creative commons attribution(?: international)?(?: public)?(?: LIC)? 4 0(?: international)?
cc-by-nc-nd-3.0 | creative commons | 0.95 | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: LIC)? 3 0(?: unported)?
cc-by-nc-sa-3.0 | creative commons | 0.95 | creative commons attribution non ?commercial share ?alike(?: LIC)? 3 0(?: unported)?
cc-by-nc-3.0 | creative commons | 0.95 | creative commons attribution non ?commercial(?: LIC)? 3 0(?: unported)?
cc-by-nd-3.0 | creative commons | 0.95 | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: LIC)? 3 0(?: unported)?
cc-by-sa-3.0 | creative commons | 0.95 | creative commons attribution share ?alike(?: LIC)? 3 0(?: unported)?
cc-by-3.0 | creative commons | 0.95 | creative commons attribution(?: LIC)? 3 0(?: unported)?
cc-by-nc-nd | creative commons | 0.85 | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
cc-by-nc-sa | creative commons | 0.85 | creative commons attribution non ?commercial share ?alike
cc-by-nc | creative commons | 0.85 | creative commons attribution non ?commercial
cc-by-nd | creative commons | 0.85 | creative commons attribution no ?deriv(?:ative)?s?(?: works)?
cc-by-sa | creative commons | 0.85 | creative commons attribution share ?alike
cc-by | creative commons | 0.8 | creative commons attribution
cc-by | creativecommons | 0.95 | creativecommons org licenses by(?: [1-4] [05])?
creative-commons | creative commons | 0.6 | creative commons LIC
proprietary | proprietary | 0.85 | proprietary and confidential
proprietary | proprietary | 0.8 | proprietary LIC
proprietary | prohibited | 0.85 | unauthorized copying of this (?:file|software) via any medium is strictly prohibited proprietary and confidential
proprietary | end user | 0.85 | end user LIC agreement
proprietary | evaluation | 0.75 | evaluation LIC
proprietary | commercial | 0.75 | commercial LIC
dual-licence | dual | 0.7 | dual licensed under
dual-licence | dually | 0.7 | dually licensed under
dual-licence | dual | 0.7 | dual LIC
copyright | copyright | 0.6 | copyright (?:c )?(?:by )?(?:19|20)[0-9][0-9]
copyleft | copyleft | 0.6 | copyleft LIC
reserved | rights reserved | 0.7 | all rights reserved
reserved | rights reserved | 0.6 | some rights reserved
"""


def table() -> list[tuple[str, str, float, str]]:
    """(label, keyword, weight, expression), in order of priority."""
    out = []
    for line in TABLE.strip().split("\n"):
        label, keyword, weight, pattern = (x.strip() for x in line.split(" | "))
        out.append((label, keyword, float(weight), pattern.replace("UNDER", UNDER).replace("LIC", LIC)))
    return out
