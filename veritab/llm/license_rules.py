"""Signature rules of operator 1, written by hand.

One rule a line: ``label ; priority ; keyword ; regex``. The regex runs over the words of a text joined by single
spaces (lower case, punctuation gone), and has to start and end at word borders. The keyword is a word that every match
holds; a rule is tried only on texts that hold its keyword. Earlier rules win ties. Priority 3: full identification
(licence with version, or a licence tag), 2: wording of a licence body, 1: bare mention or weak hint.
"""

RULES_TEXT = r"""
apache-2.0 ; 3 ; apache ; apache (?:software )?license (?:version )?2(?: 0)?
apache-2.0 ; 3 ; apache ; licensed under the apache license(?: version)? 2(?: 0)?(?: the license)?
apache-2.0 ; 3 ; spdx ; spdx license identifier apache 2 0
apache-2.0 ; 3 ; apache ; (?:https? )?www apache org licenses license 2 0
apache-2.0 ; 2 ; basis ; distributed on an as is basis without warranties or conditions of any kind either express or implied
apache-2.0 ; 2 ; file ; you may not use this file except in compliance with the license
apache-1.1 ; 3 ; apache ; apache (?:software )?license (?:version )?1 1
apache-1.0 ; 3 ; apache ; apache (?:software )?license (?:version )?1 0
apache ; 1 ; apache ; apache (?:software )?license
mit ; 3 ; mit ; (?:the )?mit license(?: mit)?
mit ; 3 ; mit ; licensed under the mit(?: license)?
mit ; 3 ; mit ; released under the (?:terms of the )?mit license
mit ; 3 ; spdx ; spdx license identifier mit
mit ; 3 ; mit ; opensource org licenses mit(?: license)?
mit ; 2 ; hereby ; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit ; 2 ; sublicense ; to use copy modify merge publish distribute sublicense and or sell copies of the software
mit ; 2 ; substantial ; (?:the )?above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 ; 3 ; mit ; mit no attribution(?: license)?
mit-0 ; 3 ; spdx ; spdx license identifier mit 0
x11 ; 3 ; x11 ; x11 license
x11 ; 3 ; consortium ; x consortium license
expat ; 3 ; expat ; expat license
bsd-2-clause ; 3 ; bsd ; (?:simplified|freebsd) bsd license
bsd-2-clause ; 3 ; bsd ; (?:2|two) clause bsd(?: license)?
bsd-2-clause ; 3 ; bsd ; bsd 2 clause(?: license)?
bsd-2-clause ; 3 ; spdx ; spdx license identifier bsd 2 clause
bsd-3-clause ; 3 ; bsd ; (?:new|modified|revised) bsd license
bsd-3-clause ; 3 ; bsd ; (?:3|three) clause bsd(?: license)?
bsd-3-clause ; 3 ; bsd ; bsd 3 clause(?: license)?
bsd-3-clause ; 3 ; spdx ; spdx license identifier bsd 3 clause
bsd-3-clause ; 2 ; endorse ; neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products
bsd-4-clause ; 3 ; bsd ; (?:original|old) bsd license
bsd-4-clause ; 3 ; bsd ; (?:4|four) clause bsd(?: license)?
bsd-4-clause ; 3 ; bsd ; bsd 4 clause(?: license)?
bsd-4-clause ; 2 ; advertising ; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-zero ; 3 ; bsd ; (?:zero clause bsd|bsd zero clause)(?: license)?
bsd-zero ; 3 ; 0bsd ; 0bsd(?: license)?
0bsd ; 3 ; 0bsd ; (?:spdx license identifier )?0bsd(?: license)?
bsd ; 2 ; redistributions ; redistributions of source code must retain the above copyright notice
bsd ; 2 ; redistributions ; redistributions in binary form must reproduce the above copyright notice
bsd ; 2 ; redistribution ; redistribution and use in source and binary forms with or without modification are permitted
bsd ; 1 ; bsd ; bsd (?:style )?licensed?
isc ; 3 ; isc ; (?:the )?isc license
isc ; 3 ; spdx ; spdx license identifier isc
isc ; 2 ; purpose ; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
gpl-1.0 ; 3 ; gpl ; gpl (?:v|version )?1(?: 0)?
gpl-1.0 ; 3 ; gnu ; gnu general public license (?:as published by the free software foundation )?(?:either )?version 1
gpl-2.0 ; 3 ; gnu ; gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?2(?: 0)?
gpl-2.0 ; 3 ; gnu ; gnu gpl (?:version |v)?2(?: 0)?
gpl-2.0 ; 3 ; gplv2 ; gplv2
gpl-2.0 ; 3 ; gpl ; gpl (?:version |v)?2(?: 0)?
gpl-2.0 ; 3 ; spdx ; spdx license identifier gpl 2 0 only
gpl-2.0-or-later ; 3 ; spdx ; spdx license identifier gpl 2 0 or later
gpl-2.0-or-later ; 3 ; later ; gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-2.0-or-later ; 3 ; gplv2 ; gplv2 or (?:any )?later
gpl-3.0 ; 3 ; gnu ; gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?3(?: 0)?
gpl-3.0 ; 3 ; gnu ; gnu gpl (?:version |v)?3(?: 0)?
gpl-3.0 ; 3 ; gplv3 ; gplv3
gpl-3.0 ; 3 ; gpl ; gpl (?:version |v)?3(?: 0)?
gpl-3.0 ; 3 ; spdx ; spdx license identifier gpl 3 0 only
gpl-3.0-or-later ; 3 ; spdx ; spdx license identifier gpl 3 0 or later
gpl-3.0-or-later ; 3 ; later ; gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-3.0-or-later ; 3 ; gplv3 ; gplv3 or (?:any )?later
gpl ; 2 ; gnu ; gnu general public license
gpl ; 2 ; redistribute ; you can redistribute it and or modify it under the terms of the gnu general public license
gpl ; 2 ; merchantability ; without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl ; 2 ; received ; you should have received a copy of the gnu general public license along with this (?:program|file|library)
gpl ; 1 ; general ; general public license
gpl ; 1 ; gpl ; (?:under (?:the )?)?gpl(?: license)?
gpl-classpath ; 3 ; classpath ; (?:gnu )?classpath exception
gpl-gcc-exception ; 3 ; gcc ; gcc runtime library exception
gpl-font-exception ; 3 ; font ; gpl font exception
gpl-linking-exception ; 3 ; linking ; linking exception
gpl-autoconf-exception ; 3 ; autoconf ; autoconf (?:configure script )?exception
gpl-bison-exception ; 3 ; bison ; bison exception
lgpl-2.0 ; 3 ; library ; gnu library general public license(?: version 2(?: 0)?)?
lgpl-2.0 ; 3 ; lgpl ; lgpl (?:version |v)?2 0
lgpl-2.1 ; 3 ; lesser ; gnu lesser general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?2 1
lgpl-2.1 ; 3 ; lgpl ; lgpl (?:version |v)?2 1
lgpl-2.1 ; 3 ; spdx ; spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 ; 3 ; lesser ; gnu lesser general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?3(?: 0)?
lgpl-3.0 ; 3 ; lgpl ; lgpl (?:version |v)?3(?: 0)?
lgpl-3.0 ; 3 ; lgplv3 ; lgplv3
lgpl-3.0 ; 3 ; spdx ; spdx license identifier lgpl 3 0(?: only| or later)?
lgpl ; 2 ; lesser ; (?:gnu )?lesser general public license
lgpl ; 1 ; lgpl ; lgpl(?: license)?
agpl-3.0 ; 3 ; affero ; gnu affero general public license (?:as published by the free software foundation )?(?:either )?(?:version|v) ?3(?: 0)?
agpl-3.0 ; 3 ; agplv3 ; agplv3
agpl-3.0 ; 3 ; agpl ; agpl (?:version |v)?3(?: 0)?
agpl-3.0 ; 3 ; spdx ; spdx license identifier agpl 3 0(?: only| or later)?
agpl-1.0 ; 3 ; affero ; affero general public license version 1
agpl ; 2 ; affero ; (?:gnu )?affero general public license
agpl ; 1 ; agpl ; agpl(?: license)?
gfdl ; 3 ; documentation ; gnu free documentation license(?: version 1 [123])?
gfdl ; 3 ; spdx ; spdx license identifier gfdl 1 [123](?: only| or later)?
gfdl ; 2 ; invariant ; with no invariant sections no front cover texts and no back cover texts
gfdl ; 1 ; gfdl ; gfdl
mpl-1.0 ; 3 ; mozilla ; mozilla public license (?:version |v)?1 0
mpl-1.1 ; 3 ; mozilla ; mozilla public license (?:version |v)?1 1
mpl-1.1 ; 3 ; mpl ; mpl (?:version |v)?1 1
mpl-2.0 ; 3 ; mozilla ; mozilla public license (?:version |v)?2(?: 0)?
mpl-2.0 ; 3 ; mpl ; mpl (?:version |v)?2(?: 0)?
mpl-2.0 ; 3 ; spdx ; spdx license identifier mpl 2 0
mpl-2.0 ; 2 ; source ; this source code form is subject to the terms of the mozilla public license
mpl ; 2 ; mozilla ; mozilla public license
npl ; 3 ; netscape ; netscape public license(?: version 1 [01])?
epl-1.0 ; 3 ; eclipse ; eclipse public license (?:version |v)?1(?: 0)?
epl-2.0 ; 3 ; eclipse ; eclipse public license (?:version |v)?2(?: 0)?
epl-2.0 ; 3 ; spdx ; spdx license identifier epl 2 0
epl-1.0 ; 3 ; spdx ; spdx license identifier epl 1 0
epl ; 2 ; eclipse ; eclipse public license
edl ; 3 ; eclipse ; eclipse distribution license(?: (?:version |v)?1(?: 0)?)?
cpl-1.0 ; 3 ; common ; common public license(?: version 1(?: 0)?)?
ipl-1.0 ; 3 ; ibm ; ibm public license(?: version 1(?: 0)?)?
cddl-1.0 ; 3 ; cddl ; cddl (?:version |v)?1(?: 0)?
cddl-1.0 ; 3 ; common ; common development and distribution license (?:version |v)?1 0
cddl-1.1 ; 3 ; common ; common development and distribution license (?:version |v)?1 1
cddl ; 2 ; common ; common development and distribution license
cddl ; 1 ; cddl ; cddl
cpal-1.0 ; 3 ; attribution ; common public attribution license(?: version 1(?: 0)?)?
osl-3.0 ; 3 ; open ; open software license (?:version |v)?3(?: 0)?
osl ; 2 ; open ; open software license
afl-3.0 ; 3 ; academic ; academic free license (?:version |v)?3(?: 0)?
afl ; 2 ; academic ; academic free license
artistic-1.0 ; 3 ; artistic ; artistic license (?:version )?1(?: 0)?
artistic-2.0 ; 3 ; artistic ; artistic license (?:version )?2(?: 0)?
artistic ; 2 ; artistic ; (?:the )?artistic license
perl ; 2 ; perl ; under the same terms as perl itself
python-2.0 ; 3 ; python ; python software foundation license(?: version 2)?
psf ; 2 ; psf ; psf license(?: agreement)?
ruby ; 3 ; ruby ; ruby s? ?license
php-3.01 ; 3 ; php ; php license (?:version )?3 0?1
php ; 2 ; php ; php license
zend ; 3 ; zend ; zend (?:engine )?license
zlib ; 3 ; zlib ; zlib (?:libpng )?license
zlib ; 3 ; spdx ; spdx license identifier zlib
zlib ; 2 ; misrepresented ; the origin of this software must not be misrepresented
zlib ; 2 ; plainly ; altered source versions must be plainly marked as such
libpng ; 3 ; libpng ; libpng license(?: version 2)?
boost-1.0 ; 3 ; boost ; boost software license(?: version 1(?: 0)?)?
boost-1.0 ; 3 ; spdx ; spdx license identifier bsl 1 0
boost-1.0 ; 3 ; boost ; www boost org license 1 0 txt
unlicense ; 3 ; unlicense ; (?:the )?unlicense
unlicense ; 2 ; unencumbered ; this is free and unencumbered software released into the public domain
wtfpl ; 3 ; wtfpl ; wtfpl(?: version 2)?
wtfpl ; 3 ; want ; do what the fuck you want to public license
public-domain ; 2 ; domain ; (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain ; 2 ; domain ; public domain dedication
public-domain ; 1 ; domain ; (?:in the )?public domain
cc0-1.0 ; 3 ; cc0 ; cc0(?: 1 0)?(?: universal)?
cc0-1.0 ; 3 ; zero ; creative commons zero(?: (?:version )?1 0)?
cc0-1.0 ; 3 ; publicdomain ; creativecommons org publicdomain zero 1 0
cc-by-4.0 ; 3 ; cc ; cc by 4 0
cc-by-3.0 ; 3 ; cc ; cc by 3 0
cc-by-2.5 ; 3 ; cc ; cc by 2 5
cc-by-2.0 ; 3 ; cc ; cc by 2 0
cc-by-sa-4.0 ; 3 ; cc ; cc by sa 4 0
cc-by-sa-3.0 ; 3 ; cc ; cc by sa 3 0
cc-by-sa-2.5 ; 3 ; cc ; cc by sa 2 5
cc-by-sa ; 3 ; cc ; cc by sa
cc-by-nd-4.0 ; 3 ; cc ; cc by nd 4 0
cc-by-nd ; 3 ; cc ; cc by nd
cc-by-nc-4.0 ; 3 ; cc ; cc by nc 4 0
cc-by-nc ; 3 ; cc ; cc by nc
cc-by-nc-sa-4.0 ; 3 ; cc ; cc by nc sa 4 0
cc-by-nc-sa ; 3 ; cc ; cc by nc sa
cc-by-nc-nd-4.0 ; 3 ; cc ; cc by nc nd 4 0
cc-by-nc-nd ; 3 ; cc ; cc by nc nd
cc-by ; 2 ; cc ; cc by
cc-by-4.0 ; 3 ; attribution ; creative commons attribution 4 0(?: international)?(?: (?:public )?license)?
cc-by-3.0 ; 3 ; attribution ; creative commons attribution 3 0(?: unported)?(?: license)?
cc-by-sa-4.0 ; 3 ; sharealike ; creative commons attribution sharealike 4 0(?: international)?(?: (?:public )?license)?
cc-by-sa-3.0 ; 3 ; sharealike ; creative commons attribution sharealike 3 0(?: unported)?(?: license)?
cc-by-sa ; 2 ; sharealike ; creative commons attribution sharealike
cc-by-sa ; 2 ; share ; creative commons attribution share alike(?: license)?
cc-by-nd ; 2 ; noderivatives ; creative commons attribution noderivatives
cc-by-nc ; 2 ; noncommercial ; creative commons attribution noncommercial
cc-by-nc-sa ; 2 ; noncommercial ; creative commons attribution noncommercial sharealike
cc-by-nc-nd ; 2 ; noncommercial ; creative commons attribution noncommercial noderivatives
cc-by ; 2 ; attribution ; creative commons attribution(?: license)?
cc-by ; 3 ; creativecommons ; creativecommons org licenses by [1-4] [05]
cc-by-sa ; 3 ; creativecommons ; creativecommons org licenses by sa [1-4] [05]
cc-by-nd ; 3 ; creativecommons ; creativecommons org licenses by nd [1-4] [05]
cc-by-nc ; 3 ; creativecommons ; creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa ; 3 ; creativecommons ; creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd ; 3 ; creativecommons ; creativecommons org licenses by nc nd [1-4] [05]
cc-any ; 1 ; commons ; creative commons(?: license)?
odbl-1.0 ; 3 ; database ; open database license(?: (?:version |v)?1(?: 0)?)?
odbl-1.0 ; 3 ; odbl ; odbl(?: 1 0)?
odc-by ; 3 ; commons ; open data commons attribution license(?: (?:version |v)?1(?: 0)?)?
pddl ; 3 ; pddl ; (?:odc )?pddl(?: 1 0)?
pddl ; 3 ; domain ; open data commons public domain dedication(?: and license)?
cdla-permissive ; 3 ; community ; community data license agreement permissive(?: (?:version )?[12] 0)?
cdla-sharing ; 3 ; community ; community data license agreement sharing(?: (?:version )?1 0)?
ogl-uk ; 3 ; government ; open government licen[cs]e(?: v?[123](?: 0)?)?
ogl-canada ; 3 ; canada ; open government licen[cs]e canada
etalab ; 3 ; ouverte ; licence ouverte(?: etalab)?(?: [12] 0)?
etalab ; 3 ; etalab ; etalab open license
ofl-1.1 ; 3 ; sil ; sil open font license(?: version 1 [01])?
ofl-1.1 ; 3 ; spdx ; spdx license identifier ofl 1 1
eupl-1.1 ; 3 ; eupl ; eupl (?:version |v)?1 1
eupl-1.2 ; 3 ; eupl ; eupl (?:version |v)?1 2
eupl ; 2 ; european ; european union public licen[cs]e
cecill-2.1 ; 3 ; cecill ; cecill (?:version |v)?2 1
cecill-b ; 3 ; cecill ; cecill b
cecill-c ; 3 ; cecill ; cecill c
cecill ; 2 ; cecill ; cecill
mulan-psl ; 3 ; mulan ; mulan (?:psl|permissive software license)(?: ?v?[12])?
ms-pl ; 3 ; microsoft ; microsoft public license
ms-rl ; 3 ; microsoft ; microsoft reciprocal license
sspl ; 3 ; server ; server side public license(?: (?:version |v)?1)?
sspl ; 3 ; sspl ; sspl(?: 1 0)?
busl-1.1 ; 3 ; business ; business source license(?: 1 1)?
elastic-2.0 ; 3 ; elastic ; elastic license(?: 2(?: 0)?)?
commons-clause ; 3 ; clause ; commons clause(?: license)?(?: condition)?
polyform ; 3 ; polyform ; polyform (?:noncommercial|strict|shield|perimeter|small business|free trial)(?: license)?
openrail ; 3 ; openrail ; (?:creativeml )?openrail(?: m)?
openssl ; 3 ; openssl ; openssl license
ssleay ; 3 ; ssleay ; ssleay license
curl ; 3 ; curl ; curl license
ntp ; 3 ; ntp ; ntp license
postgresql ; 3 ; postgresql ; postgresql licen[cs]e
sqlite-blessing ; 3 ; evil ; may you do good and not evil
json ; 3 ; evil ; the software shall be used for good not evil
json ; 3 ; json ; json license
icu ; 3 ; icu ; icu license
unicode ; 3 ; unicode ; unicode (?:inc )?license agreement
w3c ; 3 ; w3c ; w3c (?:software (?:notice and )?|document )?license
ijg ; 3 ; jpeg ; independent jpeg group s? ?(?:license|software)
freetype ; 3 ; freetype ; freetype (?:project )?license
imagemagick ; 3 ; imagemagick ; imagemagick license
lppl ; 3 ; latex ; latex project public license(?: version 1 3[abc]?)?
qpl ; 3 ; q ; q public license(?: version 1 0)?
sleepycat ; 3 ; sleepycat ; sleepycat license
vim ; 3 ; vim ; vim license
tcl ; 3 ; tcl ; tcl tk license
upl-1.0 ; 3 ; universal ; universal permissive license(?: version 1(?: 0)?)?
blueoak-1.0 ; 3 ; oak ; blue oak model license(?: 1 0 0)?
ecl-2.0 ; 3 ; educational ; educational community license(?: version 2(?: 0)?)?
ncsa ; 3 ; ncsa ; (?:university of illinois )?ncsa open source license
nasa-1.3 ; 3 ; nasa ; nasa open source agreement(?: version 1 3)?
beerware ; 3 ; beer ; beer ware license
fair ; 3 ; fair ; fair license
hpnd ; 3 ; historical ; historical permission notice and disclaimer
proprietary ; 2 ; confidential ; (?:proprietary and confidential|confidential and proprietary)
proprietary ; 2 ; proprietary ; proprietary licen[cs]e
proprietary ; 2 ; unauthorized ; unauthorized (?:copying|reproduction|distribution) (?:\S+ ){0,8}(?:strictly )?prohibited
eula ; 2 ; end ; end user licen[cs]e agreement
eula ; 1 ; eula ; eula
reserved ; 2 ; rights ; all rights reserved
reserved ; 1 ; rights ; some rights reserved
no-commercial ; 2 ; commercial ; (?:not for|no) commercial use
copyright ; 2 ; copyright ; copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
copyright ; 1 ; copyrighted ; copyrighted (?:work|material)
warranty ; 1 ; warranty ; (?:provided )?as is without warranty of any kind
spdx-other ; 1 ; spdx ; spdx license identifier(?: \S+){1,3}
"""
