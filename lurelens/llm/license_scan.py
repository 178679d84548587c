"""License detection by ordered signature rules.

A rule is a label, a regular expression, a priority and the keywords without
which it cannot match.  One automaton finds the keywords of all rules in one
scan of a text; only rules whose keywords occur run their expression, and a text
without any keyword runs none.  Of overlapping detections, one that lies inside
the interval of another of the same or a higher priority is dropped, so a full
name suppresses the short name inside it.

Apart from the rules, four fixed phrases are counted wherever their words stand
consecutively, whatever is between the words.

Nulls and edge cases: a null text is empty, has no words and no labels and
scores 0; empty texts likewise; texts are scanned whole, however long; repeated
rows are scanned row by row; a null id is carried; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import ALNUM, Words, slices

#: Base phrases and their labels; fixed values of the contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Licenses as label | SPDX identifier (expression) | names (expression) | place on the web (expression) | keywords of the names.
#: "-" stands for none; a space in a name is any white space, " ?" one that may be missing, so a keyword holds none.
LICENSES = """
agpl-3.0 | agpl-3\\.0(?:-only|-or-later|\\+)? | (?:gnu )?affero general public license,? (?:version |v)?3(?:\\.0)?|agpl ?v?3 | gnu\\.org/licenses/agpl-3\\.0 | affero agpl
agpl-1.0 | agpl-1\\.0(?:-only|-or-later)? | affero general public license,? (?:version |v)?1(?:\\.0)? | affero\\.org/oagpl | affero
gpl-3.0 | gpl-3\\.0(?:-only|-or-later|\\+)? | gnu general public license,? (?:version |v)3(?:\\.0)?|gpl ?v3 | gnu\\.org/licenses/gpl-3\\.0 | gnu gpl
gpl-2.0 | gpl-2\\.0(?:-only|-or-later|\\+)? | gnu general public license,? (?:version |v)2(?:\\.0)?|gpl ?v2 | gnu\\.org/licenses/(?:old-licenses/)?gpl-2\\.0 | gnu gpl
gpl-1.0 | gpl-1\\.0(?:-only|-or-later|\\+)? | gnu general public license,? (?:version |v)1(?:\\.0)? | gnu\\.org/licenses/(?:old-licenses/)?gpl-1\\.0 | gnu
lgpl-3.0 | lgpl-3\\.0(?:-only|-or-later|\\+)? | (?:gnu )?lesser general public license,? (?:version |v)3(?:\\.0)?|lgpl ?v3 | gnu\\.org/licenses/lgpl-3\\.0 | lesser lgpl
lgpl-2.1 | lgpl-2\\.1(?:-only|-or-later|\\+)? | (?:gnu )?lesser general public license,? (?:version |v)2\\.1|lgpl ?v2\\.1 | gnu\\.org/licenses/(?:old-licenses/)?lgpl-2\\.1 | lesser lgpl
lgpl-2.0 | lgpl-2\\.0(?:-only|-or-later|\\+)? | gnu library general public license | gnu\\.org/licenses/(?:old-licenses/)?lgpl-2\\.0 | library
gfdl-1.3 | gfdl-1\\.3(?:-[a-z-]+)? | gnu free documentation license,? (?:version |v)1\\.3 | gnu\\.org/licenses/fdl-1\\.3 | documentation
gfdl | gfdl-1\\.[12](?:-[a-z-]+)? | gnu free documentation license | gnu\\.org/(?:copyleft|licenses)/fdl | documentation
apache-2.0 | apache-2\\.0 | apache(?: software)? license,? (?:version |v)?2(?:\\.0)? | apache\\.org/licenses/license-2\\.0 | apache
apache-1.1 | apache-1\\.1 | apache software license,? (?:version |v)?1\\.1 | apache\\.org/licenses/license-1\\.1 | apache
apache-1.0 | apache-1\\.0 | apache license,? (?:version |v)?1(?:\\.0)? | apache\\.org/licenses/license-1\\.0 | apache
mit-0 | mit-0 | mit no attribution | opensource\\.org/licenses?/mit-0 | attribution
mit | mit | (?:the |under )?mit license|expat license | opensource\\.org/licenses?/mit | mit expat
x11 | x11 | x11 license|mit/x11 | xfree86\\.org/3\\.3\\.6/copyright2 | x11
bsd-2-clause | bsd-2-clause(?:-[a-z]+)? | (?:simplified|2[- ]clause|two[- ]clause) bsd license|bsd 2[- ]clause|freebsd license | opensource\\.org/licenses?/bsd-2-clause | bsd
bsd-3-clause | bsd-3-clause(?:-[a-z]+)? | (?:new|modified|revised|3[- ]clause|three[- ]clause) bsd license|bsd 3[- ]clause | opensource\\.org/licenses?/bsd-3-clause | bsd
bsd-4-clause | bsd-4-clause(?:-[a-z]+)? | (?:original|old|4[- ]clause|four[- ]clause) bsd license|bsd 4[- ]clause | directory\\.fsf\\.org/wiki/license:bsd_4clause | bsd
0bsd | 0bsd | zero[- ]clause bsd|bsd zero[- ]clause | landley\\.net/toybox/license | clause
bsd | bsd | bsd[- ]style license|bsd licen[sc]e | opensource\\.org/licenses?/bsd-license | bsd
isc | isc | isc license|internet systems consortium license | opensource\\.org/licenses?/isc | isc internet
mpl-2.0 | mpl-2\\.0(?:-no-copyleft-exception)? | mozilla public license,? (?:version |v)?2(?:\\.0)? | mozilla\\.org/mpl/2\\.0 | mozilla
mpl-1.1 | mpl-1\\.1 | mozilla public license,? (?:version |v)?1\\.1 | mozilla\\.org/mpl/(?:mpl-)?1\\.1 | mozilla
mpl-1.0 | mpl-1\\.0 | mozilla public license,? (?:version |v)?1\\.0 | mozilla\\.org/mpl/mpl-1\\.0 | mozilla
epl-2.0 | epl-2\\.0 | eclipse public license,? (?:version |v)?(?:- v )?2(?:\\.0)? | eclipse\\.org/legal/epl-(?:2\\.0|v20) | eclipse
epl-1.0 | epl-1\\.0 | eclipse public license,? (?:version |v)?(?:- v )?1(?:\\.0)? | eclipse\\.org/legal/epl-v10 | eclipse
cddl-1.1 | cddl-1\\.1 | common development and distribution license,? (?:version |v)?1\\.1 | glassfish\\.java\\.net/public/cddl | distribution
cddl-1.0 | cddl-1\\.0 | common development and distribution license(?:,? (?:version |v)?1\\.0)? | opensource\\.org/licenses?/cddl1 | distribution
cpl-1.0 | cpl-1\\.0 | common public license,? (?:version |v)?1\\.0 | opensource\\.org/licenses?/cpl1\\.0 | common
eupl-1.2 | eupl-1\\.2 | european union public licen[cs]e,? (?:version |v)?\\.?1\\.2 | joinup\\.ec\\.europa\\.eu/.{0,60}eupl-?v?1\\.2 | european
eupl-1.1 | eupl-1\\.1 | european union public licen[cs]e,? (?:version |v)?\\.?1\\.1 | joinup\\.ec\\.europa\\.eu/.{0,60}eupl-?v?1\\.1 | european
artistic-2.0 | artistic-2\\.0 | artistic license,? (?:version |v)?2(?:\\.0)? | perlfoundation\\.org/artistic_license_2_0 | artistic
artistic-1.0 | artistic-1\\.0(?:-perl|-cl8)? | artistic license(?:,? (?:version |v)?1(?:\\.0)?)? | opensource\\.org/licenses?/artistic-1\\.0 | artistic
bsl-1.0 | bsl-1\\.0 | boost software license(?:,? (?:version |v)?1\\.0)? | boost\\.org/license_1_0 | boost
unlicense | unlicense | the unlicense|free and unencumbered software released into the public domain | unlicense\\.org | unlicense unencumbered
wtfpl | wtfpl | do what the f[^ ]{1,6} you want to public license | wtfpl\\.net | want
zlib | zlib | zlib(?:/libpng)? license | zlib\\.net/zlib_license | zlib
libpng | libpng(?:-2\\.0)? | png reference library license|libpng license | libpng\\.org/pub/png/src/libpng-license | png
openssl | openssl | openssl license|openssl toolkit license | openssl\\.org/source/license | openssl
php-3.01 | php-3\\.01 | php license,? (?:version |v)?3\\.01 | php\\.net/license/3_01 | php
php-3.0 | php-3\\.0 | php license(?:,? (?:version |v)?3\\.0)? | php\\.net/license/3_0 | php
psf-2.0 | (?:psf|python)-2\\.0 | python software foundation license(?: version 2)? | docs\\.python\\.org/3/license | python
ruby | ruby | ruby license|ruby's license | ruby-lang\\.org/en/about/license | ruby
postgresql | postgresql | postgresql licen[cs]e | postgresql\\.org/about/licen[cs]e | postgresql
ncsa | ncsa | university of illinois/?ncsa open source license | otm\\.illinois\\.edu/uiuc_openSource | illinois
ms-pl | ms-pl | microsoft public license | opensource\\.org/licenses?/ms-pl | microsoft
ms-rl | ms-rl | microsoft reciprocal license | opensource\\.org/licenses?/ms-rl | microsoft
osl-3.0 | osl-3\\.0 | open software license,? (?:version |v)?3\\.0 | opensource\\.org/licenses?/osl-3\\.0 | open
afl-3.0 | afl-3\\.0 | academic free license,? (?:version |v)?3\\.0 | opensource\\.org/licenses?/afl-3\\.0 | academic
qpl-1.0 | qpl-1\\.0 | q public license(?:,? (?:version |v)?1\\.0)? | opensource\\.org/licenses?/qtpl | public
ofl-1.1 | ofl-1\\.1(?:-no-rfn|-rfn)? | sil open font license(?:,? (?:version |v)?1\\.1)? | scripts\\.sil\\.org/ofl | font
cecill-2.1 | cecill-2\\.1 | cecill free software license agreement(?:,? version 2\\.1)? | cecill\\.info/licences/licence_cecill_v2\\.1 | cecill
mulan-2.0 | mulanpsl-2\\.0 | mulan (?:psl|permissive software license),? (?:version |v)?2 | license\\.coscl\\.org\\.cn/mulanpsl2 | mulan
blueoak-1.0 | blueoak-1\\.0\\.0 | blue oak model license(?: 1\\.0\\.0)? | blueoakcouncil\\.org/license/1\\.0\\.0 | oak
sspl-1.0 | sspl-1\\.0 | server side public license(?:,? (?:version |v)?1)? | mongodb\\.com/licensing/server-side-public-license | server
busl-1.1 | busl-1\\.1 | business source license(?:,? (?:version )?1\\.1)? | mariadb\\.com/bsl11 | business
elastic-2.0 | elastic-2\\.0 | elastic license(?:,? (?:version |v)?2(?:\\.0)?)? | elastic\\.co/licensing/elastic-license | elastic
cc0-1.0 | cc0-1\\.0 | cc0(?: 1\\.0)?(?: universal)?|creative commons zero | creativecommons\\.org/publicdomain/zero/1\\.0 | cc0 creative
cc-by-4.0 | cc-by-4\\.0 | cc[ -]by[ -]4(?:\\.0)?|creative commons attribution 4\\.0 international | creativecommons\\.org/licenses/by/4\\.0 | cc creative
cc-by-3.0 | cc-by-3\\.0(?:-[a-z]{2,3})? | cc[ -]by[ -]3(?:\\.0)?|creative commons attribution 3\\.0 | creativecommons\\.org/licenses/by/3\\.0 | cc creative
cc-by-sa-4.0 | cc-by-sa-4\\.0 | cc[ -]by[ -]sa[ -]4(?:\\.0)?|creative commons attribution[- ]sharealike 4\\.0 | creativecommons\\.org/licenses/by-sa/4\\.0 | cc creative
cc-by-sa-3.0 | cc-by-sa-3\\.0(?:-[a-z]{2,3})? | cc[ -]by[ -]sa[ -]3(?:\\.0)?|creative commons attribution[- ]sharealike 3\\.0 | creativecommons\\.org/licenses/by-sa/3\\.0 | cc creative
cc-by-nc-4.0 | cc-by-nc-4\\.0 | cc[ -]by[ -]nc[ -]4(?:\\.0)?|creative commons attribution[- ]noncommercial 4\\.0 | creativecommons\\.org/licenses/by-nc/4\\.0 | cc creative
cc-by-nd-4.0 | cc-by-nd-4\\.0 | cc[ -]by[ -]nd[ -]4(?:\\.0)?|creative commons attribution[- ]noderivatives 4\\.0 | creativecommons\\.org/licenses/by-nd/4\\.0 | cc creative
cc-by-nc-sa-4.0 | cc-by-nc-sa-4\\.0 | cc[ -]by[ -]nc[ -]sa[ -]4(?:\\.0)?|attribution[- ]noncommercial[- ]sharealike 4\\.0 | creativecommons\\.org/licenses/by-nc-sa/4\\.0 | cc attribution
cc-by-nc-nd-4.0 | cc-by-nc-nd-4\\.0 | cc[ -]by[ -]nc[ -]nd[ -]4(?:\\.0)?|attribution[- ]noncommercial[- ]noderivatives 4\\.0 | creativecommons\\.org/licenses/by-nc-nd/4\\.0 | cc attribution
cc-by | cc-by(?:-[12]\\.[05])? | cc[ -]by|creative commons attribution(?: license)? | creativecommons\\.org/licenses/by/[12]\\.[05] | cc creative
odbl-1.0 | odbl-1\\.0 | open (?:data commons open )?database license | opendatacommons\\.org/licenses/odbl | database
odc-by-1.0 | odc-by-1\\.0 | open data commons attribution license | opendatacommons\\.org/licenses/by | commons
pddl-1.0 | pddl-1\\.0 | public domain dedication (?:and|&) license | opendatacommons\\.org/licenses/pddl | dedication
gpl | gpl | gnu general public license|gnu gpl | gnu\\.org/licenses/gpl | gnu
lgpl | lgpl | (?:gnu )?lesser general public license | gnu\\.org/licenses/lgpl | lesser
agpl | agpl | affero general public license | gnu\\.org/licenses/agpl | affero
apache | apache | apache(?: software)? license | apache\\.org/licenses | apache
public-domain | publicdomain | (?:dedicated to|placed in|in) the public domain | creativecommons\\.org/publicdomain | domain
all-rights-reserved | - | all rights reserved | - | reserved
""".strip()

#: Sentences of license texts and notices as label | expression | keyword; those that hold others come first. White space may
#: have marks of comments in it, quotes may be of any kind, and a full stop before a space stands for itself.
BODIES = """
mit-0 | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \\(the "software"\\), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so. | obtaining
ncsa | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \\(the "software"\\), to deal with the software without restriction | obtaining
mit | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files | obtaining
mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software | substantial
mit | the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability | merchantability
mit | in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract | holders
x11 | except as contained in this notice, the name of the x consortium shall not be used in advertising | consortium
bsd | redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met | redistribution
bsd | redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer | redistributions
bsd | redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials | redistributions
bsd | this software is provided by the (?:copyright holders and contributors|regents and contributors|authors?) "?as is"? and any express or implied warranties | warranties
bsd-3-clause | neither the name of .{1,80} nor the names of (?:its |their |other )?contributors may be used to endorse or promote products derived from this software | endorse
bsd-3-clause | the names? of the (?:authors?|copyright holders?|contributors) may not be used to endorse or promote products derived from this software | endorse
bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledge?ment | advertising
0bsd | permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. the software is provided | granted
isc | permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice | granted
isc | the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness | disclaims
zlib | this software is provided ['"]as-is['"], without any express or implied warranty. in no event will the authors be held liable | implied
zlib | the origin of this software must not be misrepresented; you must not claim that you wrote the original software | misrepresented
zlib | altered source versions must be plainly marked as such, and must not be misrepresented as being the original software | misrepresented
apache-2.0 | licensed under the apache license, version 2.0 \\(the "license"\\); you may not use this file except in compliance with the license | apache
apache-2.0 | subject to the terms and conditions of this license, each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license | irrevocable
apache-2.0 | unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis | applicable
apache-2.0 | you must cause any modified files to carry prominent notices stating that you changed the files | prominent
apache-1.1 | this product includes software developed by the apache software foundation | apache
apache-1.0 | this product includes software developed by the apache group for use in the apache http server project | apache
gpl-3.0 | this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license | redistribute
gpl-3.0 | gnu general public license as published by the free software foundation[,;:]? (?:either )?version 3 | gnu
gpl-3.0 | gnu general public license version 3, 29 june 2007 | gnu
gpl-3.0 | the gnu general public license is a free, copyleft license for software and other kinds of works | copyleft
gpl-3.0 | you may convey verbatim copies of the program's source code as you receive it | convey
gpl-2.0 | this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license | redistribute
gpl-2.0 | gnu general public license as published by the free software foundation[,;:]? (?:either )?version 2 | gnu
gpl-2.0 | gnu general public license version 2, june 1991 | gnu
gpl-2.0 | the licenses for most software are designed to take away your freedom to share and change it. by contrast, the gnu general public license is intended to guarantee your freedom | freedom
gpl-2.0 | you may copy and distribute verbatim copies of the program's source code as you receive it | verbatim
gpl-1.0 | gnu general public license as published by the free software foundation[,;:]? (?:either )?version 1 | gnu
gpl | you should have received a copy of the gnu general public license along with | gnu
gpl | this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu general public license | gnu
lgpl-3.0 | gnu lesser general public license as published by the free software foundation[,;:]? (?:either )?version 3 | lesser
lgpl-3.0 | gnu lesser general public license version 3, 29 june 2007 | lesser
lgpl-3.0 | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license | lesser
lgpl-2.1 | gnu lesser general public license as published by the free software foundation[,;:]? (?:either )?version 2\\.1 | lesser
lgpl-2.1 | gnu lesser general public license version 2\\.1, february 1999 | lesser
lgpl-2.1 | this is the first released version of the lesser gpl. it also counts as the successor of the gnu library public license | lesser
lgpl-2.0 | gnu library general public license as published by the free software foundation[,;:]? (?:either )?version 2 | library
lgpl-2.0 | gnu library general public license version 2, june 1991 | library
lgpl | you should have received a copy of the gnu lesser general public license along with | lesser
agpl-3.0 | gnu affero general public license as published by the free software foundation[,;:]? (?:either )?version 3 | affero
agpl-3.0 | gnu affero general public license version 3, 19 november 2007 | affero
agpl-3.0 | is specifically designed to ensure cooperation with the community in the case of network server software | cooperation
agpl | you should have received a copy of the gnu affero general public license along with | affero
gfdl-1.3 | gnu free documentation license, version 1\\.3 or any later version published by the free software foundation | documentation
gfdl | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license | documentation
gfdl | with no invariant sections, no front-cover texts,? and no back-cover texts | invariant
mpl-2.0 | this source code form is subject to the terms of the mozilla public license, v\\. ?2\\.0 | mozilla
mpl-2.0 | if a copy of the mpl was not distributed with this file, you can obtain one at | mpl
mpl-2.0 | this source code form is "incompatible with secondary licenses" | incompatible
mpl-1.1 | the contents of this file are subject to the mozilla public license version 1\\.1 | mozilla
mpl-1.0 | the contents of this file are subject to the mozilla public license version 1\\.0 | mozilla
epl-2.0 | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v\\. ?)?2\\.0 | accompanying
epl-1.0 | this program and the accompanying materials are made available under the terms of the eclipse public license v1\\.0 | accompanying
cddl-1.0 | the contents of this file are subject to the terms of the common development and distribution license | distribution
cddl-1.1 | this software is dual-licensed under the cddl,? version 1\\.1 | cddl
cpl-1.0 | the accompanying program is provided under the terms of this common public license | accompanying
eupl-1.2 | licensed under the eupl,? version 1\\.2 | eupl
eupl-1.1 | licensed under the eupl,? version 1\\.1 | eupl
artistic-2.0 | everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. preamble this license establishes the terms under which a given free software package may be copied | preamble
artistic-1.0 | the intent of this document is to state the conditions under which a package may be copied, such that the copyright holder maintains some semblance of artistic control | artistic
bsl-1.0 | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license | obtaining
bsl-1.0 | distributed under the boost software license, version 1\\.0 | boost
unlicense | this is free and unencumbered software released into the public domain | unencumbered
unlicense | anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose | anyone
wtfpl | you just do what the f[^ ]{1,6} you want to | want
libpng | the png reference library is supplied "as is" | png
openssl | this product includes software developed by the openssl project for use in the openssl toolkit | openssl
php-3.01 | this source file is subject to version 3\\.01 of the php license | php
php-3.0 | this source file is subject to version 3\\.0 of the php license | php
psf-2.0 | psf is making python available to licensee on an "as is" basis | licensee
psf-2.0 | python software foundation license version 2 | python
ruby | you may make and give away verbatim copies of the source form of the software without restriction | verbatim
postgresql | permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted | granted
ms-pl | this license governs use of the accompanying software. if you use the software, you accept this license | accompanying
ms-rl | reciprocal grants- for any file you distribute that contains code from the software | reciprocal
osl-3.0 | licensed under the open software license version 3\\.0 | open
afl-3.0 | licensed under the academic free license version 3\\.0 | academic
qpl-1.0 | you may copy this license document in its entirety, but you may not modify it or distribute it in parts | entirety
ofl-1.1 | this font software is licensed under the sil open font license, version 1\\.1 | font
ofl-1.1 | the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself | font
cecill-2.1 | governed by the cecill license under french law and abiding by the rules of distribution of free software | cecill
mulan-2.0 | you can use this software according to the terms and conditions of the mulan psl v2 | mulan
blueoak-1.0 | this license gives everyone as much permission to work with this software as possible, while protecting contributors from liability | protecting
sspl-1.0 | this program is free software: you can redistribute it and/or modify it under the terms of the server side public license | redistribute
busl-1.1 | the business source license \\(this document, or the "license"\\) is not an open source license | business
busl-1.1 | use of this software is governed by the business source license | business
elastic-2.0 | you may not provide the software to third parties as a hosted or managed service | hosted
cc0-1.0 | has (?:waived|dedicated) all copyright and related (?:or|and) neighboring rights to | neighboring
cc0-1.0 | the person who associated a work with this deed has dedicated the work to the public domain | deed
cc-by-4.0 | this work is licensed under a creative commons attribution 4\\.0 international license | creative
cc-by-3.0 | this work is licensed under (?:a|the) creative commons attribution 3\\.0 (?:unported|united states) license | creative
cc-by-sa-4.0 | this work is licensed under a creative commons attribution[- ]sharealike 4\\.0 international license | creative
cc-by-sa-3.0 | this work is licensed under (?:a|the) creative commons attribution[- ]sharealike 3\\.0 (?:unported|united states) license | creative
cc-by-sa-3.0 | text is available under the creative commons attribution[- ]sharealike license | creative
cc-by-nc-4.0 | this work is licensed under a creative commons attribution[- ]noncommercial 4\\.0 international license | creative
cc-by-nd-4.0 | this work is licensed under a creative commons attribution[- ]noderivatives 4\\.0 international license | creative
cc-by-nc-sa-4.0 | this work is licensed under a creative commons attribution[- ]noncommercial[- ]sharealike 4\\.0 international license | creative
cc-by-nc-nd-4.0 | this work is licensed under a creative commons attribution[- ]noncommercial[- ]noderivatives 4\\.0 international license | creative
odbl-1.0 | this (?:data|database) is made available under the open database license | database
odc-by-1.0 | is made available under the open data commons attribution license | commons
pddl-1.0 | is made available under the public domain dedication and license | dedication
public-domain | (?:this|the) (?:work|file|code|software|program|document) is (?:hereby )?(?:released|placed) (?:in|into) the public domain | domain
public-domain | no copyright is claimed,? and (?:this|the) (?:work|code|software) is in the public domain | claimed
all-rights-reserved | no part of this (?:publication|book|work|document) may be reproduced | reproduced
all-rights-reserved | unauthori[sz]ed (?:copying|reproduction|distribution|use) of this (?:file|material|publication|work),? (?:via any medium )?is strictly prohibited | prohibited
all-rights-reserved | this (?:software|file|document) (?:is|contains) (?:the )?(?:confidential and proprietary|proprietary and confidential) | proprietary
""".strip()

#: Confidence by the way a license was stated.
_SURE = {"tag": 1.0, "body": 0.95, "grant": 0.95, "place": 0.9, "name": 0.8}
_FREE = r"(?<![0-9a-z])", r"(?![0-9a-z])"


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    priority: int
    pattern: re.Pattern
    keywords: tuple[str, ...]


def _sentence(expression: str) -> str:
    """The expression of a sentence of a license text with all spellings of its spaces, quotes and full stops."""
    out = re.sub(r"(?<!\\)\.(?= |$)", r"\\.", expression)
    out = re.sub(r"\[(['\"]+)\]|\"", "\"", out).replace("\"", "[\"'\u2018\u2019\u201c\u201d]{0,2}")
    out = re.sub(r"\[(?: -|- )\]", "(?: |-)", out).replace("[^ ]", r"\S")
    return out.replace(" ?", r"[\s*#;%/]*").replace(" ", r"[\s*#;%/]+")


def rules(table: str = LICENSES, bodies: str = BODIES) -> list[Rule]:
    """The rules in order: each license's tag, the sentences of texts and notices, and its grant under its name, place on the web and bare name.

    Tags outrank sentences, these grants and places, and all of them names;
    earlier lines, which are more specific, outrank later ones of the same kind.
    """
    found = []
    lines = [[x.strip() for x in line.split(" | ")] for line in table.splitlines()]
    gap = lambda names: re.sub(r"\[(?: -|- )\]", r"(?:\\s+|-)", names).replace("[^ ]", r"\S").replace(" ?", r"\s*").replace(" ", r"\s+")
    for order, (label, tag, names, place, words) in enumerate(lines):
        rank, own = len(lines) - order, tuple(words.split())
        forms = (
            ("tag", 3000, rf"spdx-license-identifier:\s*\(?{_FREE[0]}(?:{tag})(?:-with-[0-9a-z.-]+)?(?![0-9a-z]|[-.+][0-9a-z])", ("spdx-license-identifier",)),
            ("grant", 2000, rf"(?:licensed|released|distributed|available|published|covered|shared|provided)\s+under\s+(?:the\s+(?:terms\s+of\s+)?(?:the\s+)?|an?\s+)?(?:{gap(names)}){_FREE[1]}", own),
            ("place", 1500, rf"(?:https?://)?(?:www\.)?(?:{place.lower()}){_FREE[1]}[^\s]*", tuple({place.lower().replace(chr(92), "").split("/")[0].split("(")[0].split(".{")[0]})),
            ("name", 1000, rf"{_FREE[0]}(?:{gap(names)}){_FREE[1]}", own),
        )
        found += [Rule(label, kind, base + rank, re.compile(pattern), keys) for kind, base, pattern, keys in forms if {"tag": tag, "place": place}.get(kind) != "-"]
    sentences = [[x.strip() for x in line.split(" | ")] for line in bodies.splitlines()]
    for order, (label, expression, words) in enumerate(sentences):
        found.append(Rule(label, "body", 2500 + len(sentences) - order, re.compile(_sentence(expression), re.DOTALL), tuple(words.split())))
    return sorted(found, key=lambda r: -r.priority)


class Scanner:
    """All rules with the automaton of their keywords."""

    def __init__(self, own: list[Rule]):
        import ahocorasick

        self.rules = own
        by_word: dict[str, list[int]] = {}
        for i, rule in enumerate(own):
            for word in rule.keywords:
                by_word.setdefault(word, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for word, ids in by_word.items():
            self.automaton.add_word(word, tuple(ids))
        self.automaton.make_automaton()

    def detections(self, text: str) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) of what is left after suppression, by start; the text is in lower case."""
        active: set[tuple[int, ...]] = {ids for _, ids in self.automaton.iter(text)}
        raw = [(m.start(), m.end(), self.rules[i]) for i in sorted({i for ids in active for i in ids}) for m in self.rules[i].pattern.finditer(text)]
        raw.sort(key=lambda d: (d[0], -d[1], -d[2].priority))
        return _suppressed(raw)


def _suppressed(raw: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Drops detections inside one of the same or a higher priority; raw is sorted by start, then longest, then priority."""
    kept: list[tuple[int, int, Rule]] = []
    open_: list[tuple[int, int, Rule]] = []
    for d in raw:
        open_ = [o for o in open_ if o[1] > d[0]]
        if not any(o[1] >= d[1] and o[2].priority >= d[2].priority for o in open_):
            # One that covers exactly what a lower rule covers replaces it.
            for o in [o for o in open_ if o[:2] == d[:2] and o[2].priority < d[2].priority]:
                open_.remove(o)
                kept.remove(o)
            open_.append(d)
            kept.append(d)
    return kept


@functools.cache
def scanner() -> Scanner:
    return Scanner(rules())


_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_BASE = [(label, re.compile(rb"(?<![0-9a-z\x80-\xff])" + _GAP.join(w.encode() for w in phrase.split()) + rb"(?![0-9a-z\x80-\xff])"), phrase.split()[-1].encode()) for phrase, label in PHRASES.items()]
_FIELDS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = scanner()
    fold = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column(1), ALNUM)
            data, rows = words.bytes.tobytes().translate(fold), []
            for row in range(part.num_rows):
                a, z = int(words.offsets[row]), int(words.offsets[row + 1])
                lower = data[a:z]
                places, base = [], set()
                for label, pattern, last in _BASE:
                    if last in lower:
                        at = [m.start() + a for m in pattern.finditer(lower)]
                        places += at
                        base |= {label} if at else set()
                starts = np.searchsorted(words.starts, sorted(places)) - words.rows[row]
                found = own.detections(lower.decode())
                labels = base | {rule.label for _, _, rule in found}
                sure = max([_SURE[rule.kind] for _, _, rule in found] + [_SURE["name"]] * bool(base), default=0.0)
                rows.append((len(starts), int(starts[0]) if len(starts) else None, int(starts[-1]) if len(starts) else None, ",".join(sorted(base)), ",".join(sorted(labels)), sure))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(words.rows).astype(np.int64)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [f.split()[0] for f in _FIELDS.split(", ")])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the confidence of the surest detection: 1 for a license tag, less for a grant, a link or a name, 0 for none.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, _FIELDS)


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per detection: doc_id, label, kind, priority, and start and end in characters of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = {i: i + 32 for i in range(65, 91)}
        for batch in batches:
            for part in slices(batch):
                rows = [(doc, r.label, r.kind, r.priority, a, z) for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for a, z, r in scanner().detections((text or "").translate(fold))]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "label", "kind", "priority", "start", "end"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, label string, kind string, priority long, start long, end long")
