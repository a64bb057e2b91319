"""License scans: ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.llm.common import chunks, same, table, tidied, utf8
from arbor.llm.textnum import LOWER, word_spans
from arbor.session import ship

_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[0x30:0x3A] = _WORD_BYTES[0x61:0x7B] = _WORD_BYTES[0x80:] = True

#: The base phrases and their labels.
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

#: label, SPDX identifier as a pattern, names in prose as patterns, keywords of which one is in any match.
FAMILIES = [
    ("mit", r"mit", [r"mit", r"expat"], ["mit", "expat"]),
    ("mit-0", r"mit-0", [r"mit no attribution"], ["mit"]),
    ("apache-1.1", r"apache-1\.1", [r"apache (?:software )?license,? (?:version )?1\.1"], ["apache"]),
    ("apache-2.0", r"apache-2\.0", [r"apache (?:software )?license,? (?:version )?2(?:\.0)?", r"apache 2(?:\.0)?"], ["apache"]),
    ("gpl-1.0", r"gpl-1\.0(?:-only|-or-later|\+)?", [r"(?:gnu )?general public license,? (?:version |v)1"], ["gpl", "general public"]),
    ("gpl-2.0", r"gpl-2\.0(?:-only|-or-later|\+)?", [r"(?:gnu )?general public license,? (?:version |v)2", r"gpl ?v?2"], ["gpl", "general public"]),
    ("gpl-3.0", r"gpl-3\.0(?:-only|-or-later|\+)?", [r"(?:gnu )?general public license,? (?:version |v)3", r"gpl ?v?3"], ["gpl", "general public"]),
    ("lgpl-2.0", r"lgpl-2\.0(?:-only|-or-later|\+)?", [r"library general public license,? (?:version |v)2"], ["lgpl", "general public"]),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", [r"lesser general public license,? (?:version |v)2\.1", r"lgpl ?v?2\.1"], ["lgpl", "general public"]),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later|\+)?", [r"lesser general public license,? (?:version |v)3", r"lgpl ?v?3"], ["lgpl", "general public"]),
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later|\+)?", [r"affero general public license(?:,? (?:version |v)3)?", r"agpl ?v?3"], ["agpl", "affero"]),
    ("bsd-1-clause", r"bsd-1-clause", [r"1-clause bsd"], ["bsd"]),
    ("bsd-2-clause", r"bsd-2-clause", [r"2-clause bsd", r"simplified bsd", r"freebsd"], ["bsd"]),
    ("bsd-3-clause", r"bsd-3-clause", [r"3-clause bsd", r"new bsd", r"modified bsd"], ["bsd"]),
    ("bsd-4-clause", r"bsd-4-clause", [r"4-clause bsd", r"original bsd"], ["bsd"]),
    ("0bsd", r"0bsd", [r"zero-clause bsd"], ["bsd"]),
    ("isc", r"isc", [r"isc"], ["isc"]),
    ("mpl-1.1", r"mpl-1\.1", [r"mozilla public license,? (?:version |v)?1\.1"], ["mpl", "mozilla"]),
    ("mpl-2.0", r"mpl-2\.0", [r"mozilla public license,? (?:version |v)?2(?:\.0)?"], ["mpl", "mozilla"]),
    ("epl-1.0", r"epl-1\.0", [r"eclipse public license,? (?:- )?(?:version |v ?)?1(?:\.0)?"], ["epl", "eclipse"]),
    ("epl-2.0", r"epl-2\.0", [r"eclipse public license,? (?:- )?(?:version |v ?)?2(?:\.0)?"], ["epl", "eclipse"]),
    ("cddl-1.0", r"cddl-1\.0", [r"common development and distribution license"], ["cddl", "common development"]),
    ("cpl-1.0", r"cpl-1\.0", [r"common public license"], ["cpl", "common public"]),
    ("eupl-1.2", r"eupl-1\.2", [r"european union public licen[cs]e"], ["eupl", "european union"]),
    ("artistic-1.0", r"artistic-1\.0", [r"artistic license,? (?:version )?1(?:\.0)?"], ["artistic"]),
    ("artistic-2.0", r"artistic-2\.0", [r"artistic license,? (?:version )?2(?:\.0)?"], ["artistic"]),
    ("zlib", r"zlib", [r"zlib(?:/libpng)?"], ["zlib"]),
    ("bsl-1.0", r"bsl-1\.0", [r"boost software license"], ["bsl", "boost"]),
    ("busl-1.1", r"busl-1\.1", [r"business source license"], ["busl", "business source"]),
    ("unlicense", r"unlicense", [r"(?:the )?unlicense"], ["unlicense"]),
    ("wtfpl", r"wtfpl", [r"do what the fuck you want to public license"], ["wtfpl", "do what the"]),
    ("psf-2.0", r"psf-2\.0", [r"python software foundation license"], ["psf", "python software"]),
    ("php-3.01", r"php-3\.01", [r"php license"], ["php"]),
    ("ofl-1.1", r"ofl-1\.1", [r"sil open font license"], ["ofl", "open font"]),
    ("openssl", r"openssl", [r"openssl license"], ["openssl"]),
    ("ncsa", r"ncsa", [r"university of illinois/ncsa open source license"], ["ncsa"]),
    ("postgresql", r"postgresql", [r"postgresql license"], ["postgresql"]),
    ("ms-pl", r"ms-pl", [r"microsoft public license"], ["ms-pl", "microsoft public"]),
    ("ms-rl", r"ms-rl", [r"microsoft reciprocal license"], ["ms-rl", "microsoft reciprocal"]),
    ("sspl-1.0", r"sspl-1\.0", [r"server side public license"], ["sspl", "server side"]),
    ("elastic-2.0", r"elastic-2\.0", [r"elastic license"], ["elastic"]),
    ("cc0-1.0", r"cc0-1\.0", [r"cc0", r"creative commons zero"], ["cc0", "creative commons"]),
    ("cc-by-4.0", r"cc-by-4\.0", [r"cc[- ]by(?! ?-?(?:sa|nc|nd))", r"creative commons attribution(?![- ](?:share|non|no))"], ["cc-by", "cc by", "creative commons"]),
    ("cc-by-sa-4.0", r"cc-by-sa-4\.0", [r"cc[- ]by-sa", r"creative commons attribution[- ]sharealike"], ["cc-by", "cc by", "creative commons"]),
    ("cc-by-nc-4.0", r"cc-by-nc-4\.0", [r"cc[- ]by-nc(?!-)", r"creative commons attribution[- ]noncommercial(?![- ](?:share|noderiv))"], ["cc-by", "cc by", "creative commons"]),
    ("cc-by-nd-4.0", r"cc-by-nd-4\.0", [r"cc[- ]by-nd", r"creative commons attribution[- ]noderiv(?:ative)?s"], ["cc-by", "cc by", "creative commons"]),
    ("gfdl-1.3", r"gfdl-1\.3(?:-only|-or-later)?", [r"gnu free documentation license"], ["gfdl", "free documentation"]),
    ("odbl-1.0", r"odbl-1\.0", [r"open database license"], ["odbl", "open database"]),
    ("hpnd", r"hpnd", [r"historical permission notice and disclaimer"], ["hpnd", "historical permission"]),
    ("x11", r"x11", [r"x11 license"], ["x11"]),
    ("afl-3.0", r"afl-3\.0", [r"academic free license"], ["afl", "academic free"]),
    ("osl-3.0", r"osl-3\.0", [r"open software license"], ["osl", "open software"]),
    ("ecl-2.0", r"ecl-2\.0", [r"educational community license"], ["ecl", "educational community"]),
    ("upl-1.0", r"upl-1\.0", [r"universal permissive license"], ["upl", "universal permissive"]),
    ("vim", r"vim", [r"vim license"], ["vim"]),
    ("w3c", r"w3c", [r"w3c software (?:notice and )?license"], ["w3c"]),
]

#: Priority, keyword and pattern for each identifier {spdx} or name {name} of a family, highest first.
FORMS = [
    (90, "spdx-license-identifier", r"spdx-license-identifier:\s*{spdx}(?![\w.+-])"),
    (80, " under ", r"licen[sc]ed? under (?:the )?(?:terms of (?:the )?)?(?:gnu )?{name}\b"),
    (70, " under ", r"(?:released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?{name}\b"),
    (60, "licen", r"\blicen[sc]e\W{{1,4}}{spdx}(?![\w.+-])"),
    (50, "licen", r"\b{name}(?:[- ]style)? licen[sc]e\b"),
]
#: A name that says "license" itself, and how it is mentioned.
_OWN = re.compile(r"licen|public")
PLAIN = r"(?<![\w-])(?<!lesser )(?<!library )(?<!affero ){name}(?![\w]|\.\d)"

#: label, priority, keyword, pattern: texts of the licenses and notices.
SIGNATURES = [
    ("mit", 85, "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("isc", 85, "permission to use", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee"),
    ("bsd-2-clause", 75, "redistribution and use", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-3-clause", 85, "neither the name", r"neither the name of .{1,80}? nor the names of its contributors may be used"),
    ("apache-2.0", 85, "apache.org", r"https?://www\.apache\.org/licenses/license-2\.0"),
    ("gpl", 75, "free software foundation", r"gnu general public license as published by the free software foundation"),
    ("mpl-2.0", 85, "mozilla.org", r"https?://(?:www\.)?mozilla\.org/mpl/2\.0"),
    ("zlib", 85, "as-is", r"provided 'as-is', without any express or implied warranty"),
    ("unlicense", 85, "public domain", r"free and unencumbered software released into the public domain"),
    ("public-domain", 30, "public domain", r"\bpublic domain\b"),
    ("all-rights-reserved", 20, "all rights reserved", r"\ball rights reserved\b"),
    ("proprietary", 40, "proprietary", r"\b(?:proprietary and confidential|proprietary license)\b"),
    ("copyright", 10, "copyright", r"\bcopyright (?:\(c\)|©|\d{4})"),
    ("cc", 35, "creativecommons.org", r"https?://creativecommons\.org/(?:licenses|publicdomain)/[a-z-]+"),
]

#: label, priority, keyword, pattern: where licenses are published, and licenses and terms without a family.
ADDRESSES = [
    ("gpl-1.0", 85, "gnu.org/", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("gpl-2.0", 85, "gnu.org/", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", 85, "gnu.org/", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl", 60, "gnu.org/", r"gnu\.org/(?:licenses|copyleft)/gpl(?:\.html|\.txt)?(?![\w-])"),
    ("lgpl-2.0", 85, "gnu.org/", r"gnu\.org/licenses/old-licenses/lgpl-2\.0"),
    ("lgpl-2.1", 85, "gnu.org/", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", 85, "gnu.org/", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl", 60, "gnu.org/", r"gnu\.org/(?:licenses/lgpl|copyleft/lesser)(?:\.html|\.txt)?(?![\w-])"),
    ("agpl-3.0", 85, "gnu.org/", r"gnu\.org/licenses/agpl(?:-3\.0)?"),
    ("gfdl-1.3", 85, "gnu.org/", r"gnu\.org/licenses/fdl-1\.3"),
    ("mit", 85, "opensource.org/", r"opensource\.org/licenses?/mit(?![\w-])"),
    ("mit-0", 85, "opensource.org/", r"opensource\.org/licenses?/mit-0"),
    ("isc", 85, "opensource.org/", r"opensource\.org/licenses?/isc"),
    ("0bsd", 85, "opensource.org/", r"opensource\.org/licenses?/0bsd"),
    ("bsd-2-clause", 85, "opensource.org/", r"opensource\.org/licenses?/bsd-(?:2-clause|license)"),
    ("bsd-3-clause", 85, "opensource.org/", r"opensource\.org/licenses?/bsd-3-clause"),
    ("apache-2.0", 85, "opensource.org/", r"opensource\.org/licenses?/apache-2\.0"),
    ("mpl-1.1", 85, "mozilla.org/", r"mozilla\.org/mpl/(?:mpl-)?1\.1"),
    ("mpl-2.0", 85, "opensource.org/", r"opensource\.org/licenses?/mpl-2\.0"),
    ("epl-1.0", 85, "eclipse.org/", r"eclipse\.org/(?:legal/epl-v10|org/documents/epl-v10)"),
    ("epl-2.0", 85, "eclipse.org/", r"eclipse\.org/(?:legal/epl-(?:v20|2\.0)|org/documents/epl-2\.0)"),
    ("cddl-1.0", 85, "opensource.org/", r"opensource\.org/licenses?/cddl-1\.0"),
    ("artistic-2.0", 85, "opensource.org/", r"opensource\.org/licenses?/artistic-2\.0"),
    ("zlib", 85, "zlib", r"(?:opensource\.org/licenses?/zlib|zlib\.net/zlib_license)"),
    ("bsl-1.0", 85, "boost.org/", r"boost\.org/license_1_0"),
    ("busl-1.1", 85, "mariadb.com/", r"mariadb\.com/bsl11"),
    ("unlicense", 85, "unlicense.org", r"(?<![\w.])(?:www\.)?unlicense\.org"),
    ("wtfpl", 85, "wtfpl.net", r"wtfpl\.net"),
    ("psf-2.0", 85, "python", r"(?:python\.org/psf/license|docs\.python\.org/3/license)"),
    ("php-3.01", 85, "php.net/", r"php\.net/license/3_01"),
    ("ofl-1.1", 85, "sil.org/", r"scripts\.sil\.org/ofl"),
    ("ofl-1.1", 85, "openfontlicense.org", r"openfontlicense\.org"),
    ("openssl", 85, "openssl.org/", r"openssl\.org/source/license"),
    ("ms-pl", 85, "opensource.org/", r"opensource\.org/licenses?/ms-pl"),
    ("ms-rl", 85, "opensource.org/", r"opensource\.org/licenses?/ms-rl"),
    ("sspl-1.0", 85, "mongodb.com/", r"mongodb\.com/(?:legal/)?licensing/server-side-public-license"),
    ("elastic-2.0", 85, "elastic.co/", r"elastic\.co/licensing/elastic-license"),
    ("odbl-1.0", 85, "opendatacommons.org/", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", 85, "opendatacommons.org/", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", 85, "opendatacommons.org/", r"opendatacommons\.org/licenses/pddl"),
    ("cc0-1.0", 86, "creativecommons.org", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc-by-4.0", 86, "creativecommons.org", r"https?://creativecommons\.org/licenses/by/4\.0"),
    ("cc-by-sa-4.0", 86, "creativecommons.org", r"https?://creativecommons\.org/licenses/by-sa/4\.0"),
    ("cc-by-nc-4.0", 86, "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nc/4\.0"),
    ("cc-by-nd-4.0", 86, "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nd/4\.0"),
    ("cc-by-nc-sa-4.0", 86, "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nc-sa/4\.0"),
    ("cc-by-nc-nd-4.0", 86, "creativecommons.org", r"https?://creativecommons\.org/licenses/by-nc-nd/4\.0"),
    ("gpl", 55, "this program is free software", r"this program is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("lgpl", 55, "this library is free software", r"this library is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("perl", 50, "same terms as perl", r"(?:redistribute|distributed|modify) .{0,40}?under the same terms as perl(?: itself)?"),
    ("beerware", 85, "do whatever you want with this stuff", r"as long as you retain this notice,? you can do whatever you want with this stuff"),
    ("json", 85, "shall be used for good", r"the software shall be used for good, not evil"),
    ("ijg", 85, "independent jpeg group", r"based in part on the work of the independent jpeg group"),
    ("zpl-2.1", 75, "zope public", r"zope public license,? (?:\(zpl\) )?(?:version |v)?2\.1"),
    ("qpl-1.0", 75, "q public license", r"\bq public license,? (?:version |v)?1\.0"),
    ("apsl-2.0", 75, "apple public source", r"apple public source license,? (?:version |v)?2(?:\.0)?"),
    ("cecill-2.1", 75, "cecill", r"\bcecill (?:free software license|v\.? ?2\.1|2\.1)"),
    ("mulanpsl-2.0", 75, "mulan", r"mulan (?:permissive software license,? |psl ?)v(?:ersion )?2"),
    ("blueoak-1.0.0", 75, "blue oak", r"blue oak model license(?: 1\.0\.0)?"),
    ("lppl-1.3c", 75, "latex project public", r"latex project public license,? (?:either )?(?:version |v)?1\.3c?"),
    ("ipl-1.0", 75, "ibm public license", r"ibm public license,? (?:version |v)?1\.0"),
    ("npl-1.1", 75, "netscape public", r"netscape public license,? (?:version |v)?1\.1"),
    ("spl-1.0", 75, "sun public license", r"\bsun public license,? (?:version |v)?1\.0"),
    ("rpl-1.5", 75, "reciprocal public", r"reciprocal public license,? (?:version |v)?1\.5"),
    ("polyform-noncommercial-1.0.0", 75, "polyform", r"polyform noncommercial license(?: 1\.0\.0)?"),
    ("polyform-shield-1.0.0", 75, "polyform", r"polyform shield license(?: 1\.0\.0)?"),
    ("commons-clause", 75, "commons clause", r"commons clause(?:\W{1,3}license condition| restriction| v1\.0)"),
    ("non-commercial", 30, "commercial", r"for (?:personal and )?non-?commercial (?:use|purposes) only"),
    ("dual", 30, "dual", r"\bdual[- ]licen[sc]ed (?:under|as)\b"),
    ("no-reproduction", 40, "without", r"may not be (?:copied|reproduced|redistributed)[^.]{0,80}? without (?:the )?(?:express |prior |written ){1,3}(?:consent|permission)"),
    ("as-is", 15, "without warranty", r"provided [\"'\u2018\u201c]{0,2}as[ -]is[\"'\u2019\u201d]{0,2},? without warrant(?:y|ies) of any kind"),
]

#: Titles and sentences of grants and disclaimers, as the licenses have them, in small letters; " stands for any quote.
#: A title names the license wherever it stands, a sentence stands in its text or notice.
TITLES = {
    "apache-1.1": ["the apache software license, version 1.1"],
    "apache-2.0": ["apache license version 2.0, january 2004"],
    "gpl-1.0": ["gnu general public license version 1, february 1989"],
    "gpl-2.0": ["gnu general public license version 2, june 1991"],
    "gpl-3.0": ["gnu general public license version 3, 29 june 2007"],
    "lgpl-2.0": ["gnu library general public license version 2, june 1991"],
    "lgpl-2.1": ["gnu lesser general public license version 2.1, february 1999"],
    "lgpl-3.0": ["gnu lesser general public license version 3, 29 june 2007"],
    "agpl-3.0": ["gnu affero general public license version 3, 19 november 2007"],
    "mit-0": ["mit no attribution"],
    "bsd-2-clause": ["bsd 2-clause license", "bsd two-clause license"],
    "bsd-3-clause": ["bsd 3-clause license", "bsd three-clause license"],
    "bsd-4-clause": ["bsd 4-clause license"],
    "0bsd": ["bsd zero clause license", "zero-clause bsd"],
    "isc": ["the isc license"],
    "mpl-1.1": ["mozilla public license version 1.1"],
    "mpl-2.0": ["mozilla public license version 2.0", "mozilla public license, v. 2.0"],
    "epl-1.0": ["eclipse public license - v 1.0", "eclipse public license v1.0"],
    "epl-2.0": ["eclipse public license - v 2.0", "eclipse public license v2.0"],
    "cddl-1.0": ["common development and distribution license (cddl) version 1.0"],
    "cpl-1.0": ["common public license version 1.0", "common public license - v 1.0"],
    "eupl-1.2": ["european union public licence v. 1.2"],
    "artistic-1.0": ["the artistic license 1.0"],
    "artistic-2.0": ["the artistic license 2.0"],
    "bsl-1.0": ["boost software license - version 1.0", "boost software license, version 1.0"],
    "busl-1.1": ["business source license 1.1"],
    "wtfpl": ["do what the fuck you want to public license version 2"],
    "psf-2.0": ["python software foundation license version 2"],
    "php-3.01": ["the php license, version 3.01"],
    "ofl-1.1": ["sil open font license version 1.1"],
    "ms-pl": ["microsoft public license (ms-pl)"],
    "ms-rl": ["microsoft reciprocal license (ms-rl)"],
    "sspl-1.0": ["server side public license version 1"],
    "elastic-2.0": ["elastic license 2.0"],
    "cc0-1.0": ["cc0 1.0 universal", "creative commons legal code cc0 1.0"],
    "cc-by-4.0": ["creative commons attribution 4.0 international", "attribution 4.0 international"],
    "cc-by-sa-4.0": ["creative commons attribution-sharealike 4.0 international", "attribution-sharealike 4.0 international"],
    "cc-by-nc-4.0": ["creative commons attribution-noncommercial 4.0 international", "attribution-noncommercial 4.0 international"],
    "cc-by-nd-4.0": ["creative commons attribution-noderivatives 4.0 international", "attribution-noderivatives 4.0 international"],
    "gfdl-1.3": ["gnu free documentation license version 1.3, 3 november 2008"],
    "odbl-1.0": ["open database license (odbl)", "odc open database license"],
    "hpnd": ["historical permission notice and disclaimer"],
    "afl-3.0": ["academic free license version 3.0", 'academic free license ("afl") v. 3.0'],
    "osl-3.0": ["open software license version 3.0", 'open software license ("osl") v. 3.0'],
    "ecl-2.0": ["educational community license, version 2.0"],
    "upl-1.0": ["the universal permissive license (upl), version 1.0"],
    "w3c": ["w3c software notice and license"],
    "ncsa": ["university of illinois/ncsa open source license"],
}
SENTENCES = {
    "mit": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "apache-1.1": ['the names "apache" and "apache software foundation" must not be used to endorse or promote products derived from this software'],
    "apache-2.0": ["subject to the terms and conditions of this license, each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license"],
    "gpl-1.0": ["the license agreements of most software companies try to keep users at the mercy of those companies"],
    "gpl-3.0": ["the gnu general public license is a free, copyleft license for software and other kinds of works"],
    "lgpl-2.0": ["gnu library general public license as published by the free software foundation"],
    "lgpl-2.1": ["either version 2.1 of the license, or (at your option) any later version"],
    "lgpl-3.0": ["incorporates the terms and conditions of version 3 of the gnu general public license, supplemented by the additional permissions listed below"],
    "agpl-3.0": ["gnu affero general public license as published by the free software foundation", "specifically designed to ensure cooperation with the community in the case of network server software"],
    "bsd-4-clause": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "0bsd": ["permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. the software"],
    "mpl-1.1": ["the contents of this file are subject to the mozilla public license version 1.1"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license, v. 2.0"],
    "epl-1.0": ["are made available under the terms of the eclipse public license v1.0"],
    "epl-2.0": ["are made available under the terms of the eclipse public license 2.0"],
    "cddl-1.0": ["the contents of this file are subject to the terms of the common development and distribution license"],
    "cpl-1.0": ["the accompanying program is provided under the terms of this common public license"],
    "eupl-1.2": ["licensed under the eupl, version 1.2"],
    "artistic-1.0": ["the intent of this document is to state the conditions under which a package may be copied"],
    "artistic-2.0": ["this license establishes the terms under which a given free software package may be copied, modified, distributed, and/or redistributed"],
    "zlib": ["altered source versions must be plainly marked as such, and must not be misrepresented as being the original software", "this notice may not be removed or altered from any source distribution"],
    "bsl-1.0": ["permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "busl-1.1": ["the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work"],
    "unlicense": ["anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
    "wtfpl": ["you just do what the fuck you want to"],
    "psf-2.0": ["this license agreement is between the python software foundation"],
    "php-3.01": ["this source file is subject to version 3.01 of the php license", "this product includes php software, freely available from"],
    "ofl-1.1": ["this font software is licensed under the sil open font license", "the font software may be sold as part of a larger software package"],
    "openssl": ["this product includes software developed by the openssl project"],
    "ncsa": ['permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "software"), to deal with the software'],
    "postgresql": ["permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"],
    "ms-rl": ["for any file you distribute that contains code from the software (in source code or binary format), you must provide recipients the source code to that file"],
    "sspl-1.0": ["if you make the functionality of the program or a modified version available to third parties as a service"],
    "elastic-2.0": ["you may not provide the software to third parties as a hosted or managed service"],
    "cc0-1.0": ["to the extent possible under law, the author has waived all copyright and related or neighboring rights", "has dedicated the work to the public domain by waiving all of his or her rights to the work"],
    "cc-by-4.0": ["this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa-4.0": ["this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "cc-by-nc-4.0": ["this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-nd-4.0": ["this work is licensed under a creative commons attribution-noderivatives 4.0 international license"],
    "gfdl-1.3": ["permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"],
    "odbl-1.0": ["is made available under the open database license"],
    "hpnd": ["permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted"],
    "x11": ["except as contained in this notice, the name of the x consortium shall not be used in advertising"],
    "afl-3.0": ["licensed under the academic free license version 3.0"],
    "osl-3.0": ["licensed under the open software license version 3.0"],
    "ecl-2.0": ["licensed under the educational community license, version 2.0"],
    "upl-1.0": ["to any person obtaining a copy of this software, associated documentation and/or data"],
    "vim": ["there are no restrictions on distributing unmodified copies of vim"],
    "w3c": ["by obtaining and/or copying this work, you (the licensee) agree that you have read, understood, and will comply with the following terms and conditions"],
}
#: Words of which each title and sentence has one.
_ANY = ("licen", "permission", "permitted", "distribut", "copyright", "notice", "public", "software", "creative", "international", "attribution", "universal", "rights", "terms", "copies", "clause", "do what the", "work", "package", "products", "program", "vim", "materials", "document")


def phrase(text: str) -> str:
    return r"(?<!\w)" + re.escape(text).replace('"', "[\"'`\u2018\u2019\u201c\u201d]{1,2}").replace(r"\ ", " ") + r"(?!\w|\.\d)"



def rules() -> list[tuple[int, str, tuple[str, ...], str, str]]:
    """(priority, label, keywords of which one is in any match, a keyword that
    is in every match, pattern), highest priority first."""
    out = [(p, label, (key,), key, pattern) for label, p, key, pattern in SIGNATURES + ADDRESSES]
    for priority, texts in ((65, TITLES), (86, SENTENCES)):
        out += [(priority, label, (max(t.split('"'), key=len),), next(k for k in _ANY if k in max(t.split('"'), key=len)), phrase(t)) for label, held in texts.items() for t in held]
    for label, spdx, names, keys in FAMILIES:
        for priority, must, form in FORMS:
            if "{spdx}" in form:
                out.append((priority, label, tuple(keys), must, form.format(spdx=spdx)))
            else:
                # a name that ends in its own "license" isn't followed by another
                out += [(priority, label, tuple(keys), must, (form if priority > 50 or not _OWN.search(name) else PLAIN).format(name=f"(?:{name})")) for name in names]
        out += [(50, label, (key,), key, PLAIN.format(name=f"(?:{name})")) for name in names if re.search(r"\d", name) and not _OWN.search(name) for key in keys if name.startswith(key)]
    return sorted(out, key=lambda r: -r[0])


#: What a notice has between two of its words: white space, and where a line ends the frame or comment sign that
#: closes it and those that begin the next ones.
_LEADER = r"(?:<!--|--+>?|/?\*+/?|//+!?|#+|;+|%+|!+|>+|\|+|(?:dnl|rem|\.\.)(?=[ \t]))"
_GAP = re.compile(rf"(?:[ \t]+(?:\*+|#+|\|+))?[ \t]*[\r\n]\s*(?:{_LEADER}\s*)*|\s+")


def folded(text: str) -> tuple[str, list[int], list[int]]:
    """text with each gap made one blank; where gaps of another length end in
    the new text, and how many characters have gone by then."""
    parts, ends, gone, last, size = [], [], [], 0, 0
    for m in _GAP.finditer(text):
        s, e = m.span()
        if e - s == 1 and text[s] == " ":
            continue
        parts += [text[last:s], " "]
        size += s - last + 1
        last = e
        ends.append(size)
        gone.append(e - size)
    return "".join([*parts, text[last:]]), ends, gone


def uncontained(spans: list[tuple]) -> list[tuple]:
    """Those of spans (start, end, ...) that lie in no earlier one. What an
    earlier suppressed span holds lies in the one that suppressed it too, so it is
    enough to know, of all before, the furthest end by start: a Fenwick tree."""
    places = {s: i for i, s in enumerate(sorted({x[0] for x in spans}), 1)}
    furthest, out = [-1] * (len(places) + 1), []
    for x in spans:
        at, most = places[x[0]], -1
        while at:
            most, at = max(most, furthest[at]), at & (at - 1)
        if most < x[1]:
            out.append(x)
            at = places[x[0]]
            while at < len(furthest):
                furthest[at] = max(furthest[at], x[1])
                at += at & -at
    return out


def detect(text: str, compiled, keywords) -> list[tuple[int, int, str, int]]:
    """Spans, labels and priorities of the rules that match lower-cased text,
    however its lines are wrapped and commented. A detection inside one of
    higher or equal earlier priority is suppressed."""
    text, ends, gone = folded(text)
    near = {k for k in keywords if k in text}
    every = [(m.start(), m.end(), label, priority) for priority, label, keys, must, pattern in (compiled if near else ()) if must in near and not near.isdisjoint(keys) for m in pattern.finditer(text)]
    found = uncontained(every)

    def before(at: int) -> int:
        i = bisect_right(ends, at)
        return at + (gone[i - 1] if i else 0)

    return sorted((before(s), before(e - 1) + 1, *rest) for s, e, *rest in found)


SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_SCAN = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32())])))])


def scan(docs: DataFrame) -> DataFrame:
    """The base phrases and the rules' detections in each row of docs(doc_id, text).

    score is the highest priority found / 100, 0.5 at least where a base phrase
    stands, else 0; starts and ends count characters. A null or empty text has
    no words, null first and last word and empty labels; repeated rows and null
    ids give a row each; other columns are ignored; an empty table gives none."""
    ship(docs.sparkSession)

    def run(batches):
        compiled = [(*rule, re.compile(pattern, re.S)) for *rule, pattern in rules()]
        # a wrapped text may part a keyword's words, not a word
        musts = sorted({max(r[3].split(), key=len) for r in compiled})
        keywords = sorted({k for r in compiled for k in (*r[2], r[3])})
        fold = {c: c + 32 for c in range(65, 91)}
        word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
        for b in batches:
            data, offsets = utf8(b.column("text"))
            for i, j in chunks(offsets):
                low, off = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
                _, _, row = word_spans(low, off, _WORD_BYTES)
                words = np.bincount(row, minlength=j - i)
                raw = low.tobytes()
                out = []
                for k in range(j - i):
                    text = raw[off[k] : off[k + 1]]
                    at, labels, found = [], set(), []
                    text = text.decode("utf-8", "replace")
                    if "license" in text:
                        w = word.findall(text.translate(fold))
                        for x, last in enumerate(w):
                            if last == "license":
                                for phrase, label in BASE.items():
                                    s = x - len(phrase) + 1
                                    if s >= 0 and tuple(w[s : x + 1]) == phrase:
                                        at.append(s)
                                        labels.add(label)
                    if any(k in text for k in musts):
                        found = detect(text, compiled, keywords)
                    every = labels | {label for _, _, label, _ in found}
                    score = max([p / 100 for _, _, _, p in found] + [0.5] * bool(at), default=0.0)
                    out.append((int(words[k]), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), score, [dict(zip(("start", "end", "label", "priority"), f)) for f in found]))
                yield pa.RecordBatch.from_arrays([same(b.column("doc_id"), i, j), *(pa.array(c, f.type) for c, f in zip(zip(*out), list(_SCAN)[1:]))], schema=_SCAN)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), SCAN + ", detections array<struct<start:long,end:long,label:string,priority:int>>")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("detections")
