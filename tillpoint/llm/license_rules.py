"""Signature rules of the license scan, in order.

A rule is (kind, label, keyword, pattern).  Patterns are over a text's words in
lower case, one space between them: ``GPL-2.0`` reads ``gpl 2 0``.  A match is
of whole words and always holds the rule's keyword.  Of two detections the one
of the earlier kind wins; within a kind the longer one, then the earlier rule.

In patterns ``<grant>`` stands for words that put something under a license,
``<v>`` for a version word, ``<spdx>`` for an identifier tag.
"""

from __future__ import annotations

# kind -> confidence, from the strongest.
KINDS = {"text": 1.0, "tag": 0.98, "notice": 0.95, "name": 0.8, "mention": 0.5}

PARTS = {
    "<grant>": r"(?:(?:re)?licen[sc]ed?|released|distributed|available|provided|published|redistributed|covered|governed|"
               r"subject|offered|used|modify it|dedicated) (?:(?:only|solely|either|freely|to you) )?"
               r"(?:under|to|by|in accordance with|according to)(?: the)?(?: terms(?: and conditions)? of)?(?: the| a| an)?",
    "<v>": r"(?:version |ver |v ?)?",
    "<spdx>": r"spdx (?:license|licence|snippet) identifier",
}

# Phrases that are always reported, whatever else is found there.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

RULES = [
    # MIT and its kin
    ("text", "mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("text", "mit", "without restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("text", "mit", "above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("text", "mit-0", "no attribution", r"mit no attribution"),
    ("text", "mit-advertising", "advertising materials", r"must include in advertising materials .{0,80}?mit"),
    ("tag", "mit", "spdx", r"<spdx> mit(?! 0)"),
    ("tag", "mit-0", "spdx", r"<spdx> mit 0"),
    ("notice", "mit", "mit licen", r"<grant> mit licen[sc]e"),
    ("notice", "mit", "expat", r"<grant> expat licen[sc]e"),
    ("name", "mit", "mit license", r"(?:the )?mit license"),
    ("name", "mit", "mit licence", r"(?:the )?mit licence"),
    ("name", "x11", "x11 license", r"(?:mit )?x11 license"),
    ("mention", "mit", "mit licensed", r"mit licensed"),
    # ISC, zlib, Boost and other short permissive ones
    ("text", "isc", "permission to use copy modify", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("tag", "isc", "spdx", r"<spdx> isc"),
    ("notice", "isc", "isc", r"<grant> isc licen[sc]e"),
    ("name", "isc", "isc license", r"(?:the )?isc license"),
    ("tag", "0bsd", "spdx", r"<spdx> 0bsd"),
    ("name", "0bsd", "zero clause bsd", r"zero clause bsd(?: license)?"),
    ("text", "zlib", "as is without any express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("text", "zlib", "origin of this software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("tag", "zlib", "spdx", r"<spdx> zlib"),
    ("notice", "zlib", "zlib", r"<grant> zlib(?: libpng)? licen[sc]e"),
    ("name", "zlib", "zlib license", r"zlib license"),
    ("name", "libpng", "libpng license", r"libpng license(?: <v>2)?"),
    ("text", "bsl-1", "boost software license", r"distributed under the boost software license version 1 0"),
    ("tag", "bsl-1", "spdx", r"<spdx> bsl 1 0"),
    ("notice", "bsl-1", "boost software", r"<grant> boost software license"),
    ("name", "bsl-1", "boost software license", r"boost software license(?: <v>1(?: 0)?)?"),
    ("text", "unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("tag", "unlicense", "spdx", r"<spdx> unlicense"),
    ("notice", "unlicense", "unlicense", r"<grant> unlicense"),
    ("name", "unlicense", "the unlicense", r"the unlicense"),
    ("text", "wtfpl", "do what the fuck", r"do what the fuck you want to(?: public license)?"),
    ("tag", "wtfpl", "spdx", r"<spdx> wtfpl"),
    ("mention", "wtfpl", "wtfpl", r"wtfpl"),
    ("text", "beerware", "beer in return", r"you can buy me a beer in return"),
    ("name", "beerware", "beer", r"beer ?ware license"),
    ("text", "postgresql", "postgresql", r"postgresql database management system formerly known as postgres"),
    ("name", "postgresql", "postgresql licen", r"postgresql licen[sc]e"),
    ("tag", "postgresql", "spdx", r"<spdx> postgresql"),
    ("name", "curl", "curl license", r"curl license"),
    ("tag", "curl", "spdx", r"<spdx> curl"),
    ("text", "ncsa", "university of illinois", r"university of illinois(?: ncsa)? open source license"),
    ("tag", "ncsa", "spdx", r"<spdx> ncsa"),
    ("name", "ncsa", "ncsa open source", r"ncsa open source license"),
    ("text", "hpnd", "historical permission", r"historical permission notice and disclaimer"),
    ("tag", "hpnd", "spdx", r"<spdx> hpnd"),
    ("name", "upl-1", "universal permissive license", r"universal permissive license(?: <v>1(?: 0)?)?"),
    ("tag", "upl-1", "spdx", r"<spdx> upl 1 0"),
    ("name", "mulan-psl-2", "mulan psl", r"mulan psl(?: ?<v>2)?"),
    ("name", "mulan-psl-2", "mulan permissive", r"mulan permissive software license(?: <v>2)?"),
    ("tag", "mulan-psl-2", "spdx", r"<spdx> mulanpsl 2 0"),
    # BSD
    ("text", "bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("text", "bsd-3-clause", "neither the name", r"neither the names? of .{1,120}? nor the names of (?:its|their|the|any) contributors may be used to endorse or promote products derived from this software"),
    ("text", "bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("text", "bsd-2-clause", "those of the authors", r"the views and conclusions contained in the software and documentation are those of the authors"),
    ("text", "bsd", "the copyright holders and contributors", r"this software is provided by the copyright holders and contributors as is"),
    ("text", "bsd", "the regents and contributors", r"this software is provided by the regents and contributors as is"),
    ("tag", "bsd-2-clause", "spdx", r"<spdx> bsd 2 clause(?: patent| views)?"),
    ("tag", "bsd-3-clause", "spdx", r"<spdx> bsd 3 clause(?: clear| lbnl| attribution)?"),
    ("tag", "bsd-4-clause", "spdx", r"<spdx> bsd 4 clause(?: uc)?"),
    ("notice", "bsd-3-clause", "bsd", r"<grant> (?:(?:new|revised|modified|3 clause|three clause) bsd|bsd 3 clause)(?: style)? licen[sc]e"),
    ("notice", "bsd-2-clause", "bsd", r"<grant> (?:(?:simplified|freebsd|2 clause|two clause) bsd|bsd 2 clause)(?: style)? licen[sc]e"),
    ("notice", "bsd", "bsd", r"<grant> bsd(?: style| type)? licen[sc]e"),
    ("notice", "bsd", "a bsd style license", r"use of this source code is governed by a bsd style license"),
    ("name", "bsd-3-clause", "3 clause bsd", r"3 clause bsd(?: license)?"),
    ("name", "bsd-3-clause", "bsd 3 clause", r"bsd 3 clause(?: license)?"),
    ("name", "bsd-3-clause", "new bsd license", r"new bsd license"),
    ("name", "bsd-3-clause", "modified bsd license", r"modified bsd license"),
    ("name", "bsd-2-clause", "2 clause bsd", r"2 clause bsd(?: license)?"),
    ("name", "bsd-2-clause", "bsd 2 clause", r"bsd 2 clause(?: license)?"),
    ("name", "bsd-2-clause", "simplified bsd", r"simplified bsd license"),
    ("name", "bsd-4-clause", "original bsd", r"original bsd license"),
    ("name", "bsd", "bsd license", r"bsd license"),
    ("mention", "bsd", "bsd style", r"bsd style(?: license)?"),
    # Apache
    ("text", "apache-2", "grant of patent license", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you"),
    ("text", "apache-2", "you may not use this file", r"you may not use this file except in compliance with the license"),
    ("text", "apache-2", "unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("text", "apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("tag", "apache-2", "spdx", r"<spdx> apache 2 0"),
    ("tag", "apache-1.1", "spdx", r"<spdx> apache 1 1"),
    ("notice", "apache-2", "apache", r"<grant> apache(?: software)? licen[sc]e <v>2(?: 0)?"),
    ("notice", "apache-1.1", "apache", r"<grant> apache(?: software)? licen[sc]e <v>1 1"),
    ("notice", "apache", "apache", r"<grant> apache(?: software)? licen[sc]e"),
    ("name", "apache-2", "apache license", r"apache license <v>2(?: 0)?"),
    ("name", "apache-2", "apache software license", r"apache software license <v>2(?: 0)?"),
    ("name", "apache-1.1", "apache software license", r"apache software license <v>1 1"),
    ("name", "apache", "apache license", r"apache license"),
    ("mention", "apache-2", "apache 2", r"apache 2 0"),
    ("mention", "apache-2", "asl 2 0", r"asl 2 0"),
    # GPL
    ("text", "gpl", "gnu general public license", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("text", "gpl-2", "gnu general public license", r"either version 2 of the license or at your option any later version .{0,200}?gnu general public license"),
    ("text", "gpl-3", "gnu general public license", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("text", "gpl-2", "freedom to share", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("tag", "gpl-1", "spdx", r"<spdx> gpl 1 0(?: only| or later)?"),
    ("tag", "gpl-2", "spdx", r"<spdx> gpl 2 0(?: only| or later)?"),
    ("tag", "gpl-3", "spdx", r"<spdx> gpl 3 0(?: only| or later)?"),
    ("notice", "gpl-2", "general public license", r"<grant> (?:gnu )?general public license(?: gpl)?(?: as published by the free software foundation)? (?:either )?<v>2(?: 0)?"),
    ("notice", "gpl-3", "general public license", r"<grant> (?:gnu )?general public license(?: gpl)?(?: as published by the free software foundation)? (?:either )?<v>3(?: 0)?"),
    ("notice", "gpl", "general public license", r"<grant> (?:gnu )?general public license"),
    ("notice", "gpl-2", "gpl", r"<grant> (?:gnu )?gpl ?<v>2(?: 0)?"),
    ("notice", "gpl-3", "gpl", r"<grant> (?:gnu )?gpl ?<v>3(?: 0)?"),
    ("notice", "gpl", "gpl", r"<grant> (?:gnu )?gpl"),
    ("name", "gpl-2", "gnu general public license", r"gnu general public license <v>2(?: 0)?"),
    ("name", "gpl-3", "gnu general public license", r"gnu general public license <v>3(?: 0)?"),
    ("name", "gpl", "gnu general public license", r"gnu general public license"),
    ("mention", "gpl-2", "gpl", r"gpl ?(?:version |v ?)2(?: 0)?"),
    ("mention", "gpl-2", "gpl 2", r"gpl 2 0"),
    ("mention", "gpl-3", "gpl", r"gpl ?(?:version |v ?)3(?: 0)?"),
    ("mention", "gpl-3", "gpl 3", r"gpl 3 0"),
    ("mention", "gpl", "gnu gpl", r"gnu gpl"),
    # LGPL
    ("text", "lgpl", "gnu lesser general public license", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("text", "lgpl-2", "gnu library general public license", r"under the terms of the gnu library general public license"),
    ("tag", "lgpl-2", "spdx", r"<spdx> lgpl 2 0(?: only| or later)?"),
    ("tag", "lgpl-2.1", "spdx", r"<spdx> lgpl 2 1(?: only| or later)?"),
    ("tag", "lgpl-3", "spdx", r"<spdx> lgpl 3 0(?: only| or later)?"),
    ("notice", "lgpl-2.1", "lesser general public license", r"<grant> (?:gnu )?lesser general public license(?: lgpl)? <v>2 1"),
    ("notice", "lgpl-3", "lesser general public license", r"<grant> (?:gnu )?lesser general public license(?: lgpl)? <v>3(?: 0)?"),
    ("notice", "lgpl", "lesser general public license", r"<grant> (?:gnu )?lesser general public license"),
    ("notice", "lgpl-2.1", "lgpl", r"<grant> (?:gnu )?lgpl ?<v>2 1"),
    ("notice", "lgpl-3", "lgpl", r"<grant> (?:gnu )?lgpl ?<v>3(?: 0)?"),
    ("notice", "lgpl", "lgpl", r"<grant> (?:gnu )?lgpl"),
    ("name", "lgpl-2.1", "lesser general public license", r"(?:gnu )?lesser general public license <v>2 1"),
    ("name", "lgpl-3", "lesser general public license", r"(?:gnu )?lesser general public license <v>3(?: 0)?"),
    ("name", "lgpl", "lesser general public license", r"(?:gnu )?lesser general public license"),
    ("mention", "lgpl-2.1", "lgpl", r"lgpl ?<v>2 1"),
    ("mention", "lgpl-3", "lgpl", r"lgpl ?<v>3(?: 0)?"),
    ("mention", "lgpl", "gnu lgpl", r"gnu lgpl"),
    # AGPL and server-side copyleft
    ("text", "agpl-3", "affero general public license", r"the gnu affero general public license is a free copyleft license"),
    ("tag", "agpl-1", "spdx", r"<spdx> agpl 1 0(?: only| or later)?"),
    ("tag", "agpl-3", "spdx", r"<spdx> agpl 3 0(?: only| or later)?"),
    ("notice", "agpl-3", "affero general public license", r"<grant> (?:gnu )?affero general public license(?: <v>3(?: 0)?)?"),
    ("name", "agpl-3", "affero general public license", r"(?:gnu )?affero general public license(?: <v>3(?: 0)?)?"),
    ("mention", "agpl-3", "agpl", r"agpl ?<v>3(?: 0)?"),
    ("mention", "agpl-3", "agpl", r"(?:gnu )?agpl"),
    ("text", "sspl-1", "third parties as a service", r"making the functionality of the program .{0,60}?available to third parties as a service"),
    ("tag", "sspl-1", "spdx", r"<spdx> sspl 1 0"),
    ("name", "sspl-1", "server side public license", r"server side public license(?: <v>1)?"),
    ("tag", "busl-1.1", "spdx", r"<spdx> busl 1 1"),
    ("name", "busl-1.1", "business source license", r"business source license(?: <v>1 1)?"),
    ("name", "elastic-2", "elastic license", r"elastic license(?: <v>2(?: 0)?)?"),
    ("tag", "elastic-2", "spdx", r"<spdx> elastic 2 0"),
    ("name", "commons-clause", "commons clause", r"commons clause(?: license condition)?"),
    ("tag", "osl-3", "spdx", r"<spdx> osl 3 0"),
    ("name", "osl-3", "open software license", r"open software license(?: <v>3(?: 0)?)?"),
    ("tag", "afl-3", "spdx", r"<spdx> afl 3 0"),
    ("name", "afl-3", "academic free license", r"academic free license(?: <v>3(?: 0)?)?"),
    # Mozilla, Eclipse and other file-level copyleft
    ("text", "mpl-2", "mozilla public license", r"this source code form is subject to the terms of the mozilla public license <v>2 0"),
    ("text", "mpl-1.1", "mozilla public license", r"the contents of this file are subject to the mozilla public license <v>1 1"),
    ("tag", "mpl-1.1", "spdx", r"<spdx> mpl 1 1"),
    ("tag", "mpl-2", "spdx", r"<spdx> mpl 2 0(?: no copyleft exception)?"),
    ("notice", "mpl-2", "mozilla public license", r"<grant> mozilla public license <v>2(?: 0)?"),
    ("notice", "mpl", "mozilla public license", r"<grant> mozilla public license"),
    ("name", "mpl-2", "mozilla public license", r"mozilla public license <v>2(?: 0)?"),
    ("name", "mpl-1.1", "mozilla public license", r"mozilla public license <v>1 1"),
    ("name", "mpl", "mozilla public license", r"mozilla public license"),
    ("mention", "mpl-2", "mpl 2 0", r"mpl 2 0"),
    ("mention", "mpl-1.1", "mpl 1 1", r"mpl 1 1"),
    ("text", "epl-1", "eclipse public license", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("tag", "epl-1", "spdx", r"<spdx> epl 1 0"),
    ("tag", "epl-2", "spdx", r"<spdx> epl 2 0"),
    ("notice", "epl-2", "eclipse public license", r"<grant> eclipse public license <v>2(?: 0)?"),
    ("notice", "epl-1", "eclipse public license", r"<grant> eclipse public license <v>1(?: 0)?"),
    ("name", "epl-2", "eclipse public license", r"eclipse public license <v>2(?: 0)?"),
    ("name", "epl-1", "eclipse public license", r"eclipse public license(?: <v>1(?: 0)?)?"),
    ("name", "edl-1", "eclipse distribution license", r"eclipse distribution license(?: <v>1(?: 0)?)?"),
    ("tag", "cddl-1", "spdx", r"<spdx> cddl 1 [01]"),
    ("notice", "cddl-1", "common development and distribution", r"<grant> common development and distribution license"),
    ("name", "cddl-1", "common development and distribution", r"common development and distribution license(?: <v>1(?: [01])?)?"),
    ("mention", "cddl-1", "cddl", r"cddl(?: ?<v>1(?: [01])?)?"),
    ("name", "cpl-1", "common public license", r"common public license(?: <v>1(?: 0)?)?"),
    ("tag", "cpl-1", "spdx", r"<spdx> cpl 1 0"),
    ("tag", "ipl-1", "spdx", r"<spdx> ipl 1 0"),
    ("name", "ipl-1", "ibm public license", r"ibm public license(?: <v>1(?: 0)?)?"),
    ("tag", "eupl-1.2", "spdx", r"<spdx> eupl 1 2"),
    ("notice", "eupl-1.2", "european union public", r"<grant> european union public licen[sc]e"),
    ("name", "eupl-1.2", "european union public", r"european union public licen[sc]e(?: <v>1(?: [12])?)?"),
    ("mention", "eupl-1.2", "eupl", r"eupl(?: ?<v>1(?: [12])?)?"),
    ("name", "cecill-2.1", "cecill", r"cecill(?: free software license agreement)?(?: <v>2(?: 1)?)?"),
    ("tag", "cecill-2.1", "spdx", r"<spdx> cecill 2 [01]"),
    ("tag", "ms-pl", "spdx", r"<spdx> ms pl"),
    ("name", "ms-pl", "microsoft public license", r"microsoft public license"),
    ("tag", "ms-rl", "spdx", r"<spdx> ms rl"),
    ("name", "ms-rl", "microsoft reciprocal license", r"microsoft reciprocal license"),
    ("tag", "artistic-1", "spdx", r"<spdx> artistic 1 0(?: perl| cl8)?"),
    ("tag", "artistic-2", "spdx", r"<spdx> artistic 2 0"),
    ("notice", "artistic-2", "artistic license", r"<grant> artistic license <v>2(?: 0)?"),
    ("name", "artistic-2", "artistic license 2", r"artistic license 2(?: 0)?"),
    ("name", "artistic-1", "artistic license", r"(?:perl )?artistic license"),
    ("notice", "artistic-1", "same terms as perl", r"(?:under|redistribute it .{0,20}?under) the same terms as perl(?: itself)?"),
    ("tag", "psf-2", "spdx", r"<spdx> (?:psf|python) 2 0"),
    ("name", "psf-2", "python software foundation license", r"python software foundation license(?: <v>2)?"),
    ("name", "ruby", "ruby license", r"ruby license"),
    ("notice", "php-3", "php license", r"<grant> php license"),
    ("name", "php-3", "php license", r"php license(?: <v>3(?: 0?1)?)?"),
    ("tag", "php-3", "spdx", r"<spdx> php 3 0?1?"),
    ("text", "openssl", "openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("name", "openssl", "openssl license", r"openssl license"),
    ("name", "sleepycat", "sleepycat license", r"sleepycat license"),
    ("name", "vim", "vim license", r"vim license"),
    ("name", "w3c", "w3c software", r"w3c software (?:notice and )?(?:and document )?license"),
    ("tag", "w3c", "spdx", r"<spdx> w3c"),
    ("name", "unicode-dfs", "unicode license", r"unicode license(?: agreement)?"),
    ("name", "ofl-1.1", "sil open font license", r"sil open font license(?: <v>1(?: 1)?)?"),
    ("tag", "ofl-1.1", "spdx", r"<spdx> ofl 1 1"),
    ("notice", "ofl-1.1", "open font license", r"<grant> (?:sil )?open font license"),
    ("name", "qpl-1", "q public license", r"q public license(?: <v>1(?: 0)?)?"),
    # Creative Commons
    ("text", "cc-by", "creative commons", r"by exercising the licensed rights .{0,40}?you accept and agree to be bound by the terms and conditions of this creative commons attribution"),
    ("text", "cc0-1", "waive", r"overtly fully permanently irrevocably and unconditionally waives abandons and surrenders"),
    ("tag", "cc0-1", "spdx", r"<spdx> cc0 1 0"),
    ("tag", "cc-by", "spdx", r"<spdx> cc by [1-4] [05]"),
    ("tag", "cc-by-sa", "spdx", r"<spdx> cc by sa [1-4] [05]"),
    ("tag", "cc-by-nd", "spdx", r"<spdx> cc by nd [1-4] [05]"),
    ("tag", "cc-by-nc", "spdx", r"<spdx> cc by nc [1-4] [05]"),
    ("tag", "cc-by-nc-sa", "spdx", r"<spdx> cc by nc sa [1-4] [05]"),
    ("tag", "cc-by-nc-nd", "spdx", r"<spdx> cc by nc nd [1-4] [05]"),
    ("tag", "cc-by", "creativecommons org", r"creativecommons org licenses by [1-4] [05]"),
    ("tag", "cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa [1-4] [05]"),
    ("tag", "cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd [1-4] [05]"),
    ("tag", "cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc [1-4] [05]"),
    ("tag", "cc-by-nc-sa", "creativecommons org", r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("tag", "cc-by-nc-nd", "creativecommons org", r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("tag", "cc0-1", "creativecommons org", r"creativecommons org publicdomain zero 1 0"),
    ("tag", "public-domain", "creativecommons org", r"creativecommons org publicdomain mark 1 0"),
    ("notice", "cc-by-nc-nd", "creative commons", r"<grant> creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?"),
    ("notice", "cc-by-nc-sa", "creative commons", r"<grant> creative commons attribution non ?commercial share ?alike"),
    ("notice", "cc-by-nc", "creative commons", r"<grant> creative commons attribution non ?commercial"),
    ("notice", "cc-by-nd", "creative commons", r"<grant> creative commons attribution no ?deriv(?:ative)?s(?: works)?"),
    ("notice", "cc-by-sa", "creative commons", r"<grant> creative commons attribution share ?alike"),
    ("notice", "cc-by", "creative commons", r"<grant> creative commons attribution"),
    ("notice", "cc", "creative commons", r"<grant> creative commons(?: license)?"),
    ("name", "cc-by-nc-nd", "attribution non", r"(?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s(?: works)?"),
    ("name", "cc-by-nc-sa", "attribution non", r"(?:creative commons )?attribution non ?commercial share ?alike"),
    ("name", "cc-by-nc", "attribution non", r"(?:creative commons )?attribution non ?commercial(?: [1-4] [05])?"),
    ("name", "cc-by-sa", "attribution share", r"(?:creative commons )?attribution share ?alike(?: [1-4] [05])?"),
    ("name", "cc-by-nd", "attribution no", r"(?:creative commons )?attribution no ?deriv(?:ative)?s(?: works)?"),
    ("name", "cc-by", "creative commons attribution", r"creative commons attribution(?: [1-4] [05])?"),
    ("name", "cc0-1", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("name", "cc", "creative commons license", r"creative commons license"),
    ("mention", "cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: [1-4] [05])?"),
    ("mention", "cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: [1-4] [05])?"),
    ("mention", "cc-by-nc", "cc by nc", r"cc by nc(?: [1-4] [05])?"),
    ("mention", "cc-by-nd", "cc by nd", r"cc by nd(?: [1-4] [05])?"),
    ("mention", "cc-by-sa", "cc by sa", r"cc by sa(?: [1-4] [05])?"),
    ("mention", "cc-by", "cc by", r"cc by [1-4] [05]"),
    # Data, documentation and model licenses
    ("name", "gfdl-1.3", "gnu free documentation license", r"gnu free documentation license(?: <v>1(?: [123])?)?"),
    ("tag", "gfdl-1.3", "spdx", r"<spdx> gfdl 1 [123](?: only| or later)?"),
    ("notice", "gfdl-1.3", "free documentation license", r"<grant> (?:gnu )?free documentation license"),
    ("name", "odbl-1", "open database license", r"open (?:data commons open )?database license(?: <v>1(?: 0)?)?"),
    ("tag", "odbl-1", "spdx", r"<spdx> odbl 1 0"),
    ("mention", "odbl-1", "odbl", r"odbl(?: 1 0)?"),
    ("name", "odc-by-1", "open data commons attribution", r"open data commons attribution license"),
    ("mention", "odc-by-1", "odc by", r"odc by(?: ?<v>1(?: 0)?)?"),
    ("name", "pddl-1", "public domain dedication and license", r"(?:open data commons )?public domain dedication and license"),
    ("name", "cdla-permissive", "community data license", r"community data license agreement permissive(?: <v>[12](?: 0)?)?"),
    ("name", "cdla-sharing", "community data license", r"community data license agreement sharing(?: <v>1(?: 0)?)?"),
    ("name", "ogl", "open government licen", r"open government licen[sc]e(?: <v>[123](?: 0)?)?"),
    ("name", "openrail", "rail", r"(?:creativeml )?(?:open )?rail(?: ?m| plus ?m)? license"),
    ("name", "openrail", "openrail", r"(?:creativeml |bigscience |bigcode )?openrail(?: ?m)?"),
    ("name", "llama-community", "llama", r"llama(?: [234](?: [0-9])?)? community license(?: agreement)?"),
    ("name", "gemma", "gemma terms", r"gemma terms of use"),
    # Public domain, rights kept, other notices
    ("notice", "public-domain", "public domain", r"(?:(?:placed|released|dedicated|put) (?:in|into|to) |(?:is|are) in )the public domain"),
    ("notice", "public-domain", "public domain", r"public domain dedication"),
    ("notice", "proprietary", "all rights reserved", r"all rights reserved"),
    ("notice", "proprietary", "proprietary and confidential", r"proprietary and confidential"),
    ("notice", "proprietary", "unauthori", r"unauthori[sz]ed (?:copying|reproduction|distribution|use) .{0,80}?(?:strictly )?prohibited"),
    ("notice", "proprietary", "may not be reproduced", r"may not be reproduced (?:or|distributed|transmitted) .{0,80}?without .{0,30}?permission"),
    ("notice", "non-commercial", "commercial use", r"(?:for )?(?:personal|academic|research|educational) (?:and|or) non ?commercial use only"),
    ("notice", "non-commercial", "non", r"(?:for |free for )non ?commercial (?:use|purposes)(?: only)?"),
    ("notice", "non-commercial", "commercial use", r"not for commercial use"),
    ("notice", "evaluation-only", "evaluation", r"for evaluation (?:purposes|use) only"),
]
