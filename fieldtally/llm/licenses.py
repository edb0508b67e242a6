"""License scans: ordered signature rules, in DataFrame functions only.

A text becomes its words, A-Z in lower case, each between two spaces.  Rules are
regular expressions over that form: identifiers behind their tag, in an expression, as
they are declared and alone, sentences of the licenses' own texts, and names of
licenses, alone and as they are declared.  A
rule runs only on texts that hold its keyword, which is a part of all that it
matches.  Of detections one of which lies within another, the higher priority
stays, among equals the longer one.

The base is three fixed phrases with their labels; base labels stay whatever
the rules find.

Cases: a null text is an empty text: no words, no labels, score 0.  Texts are
scanned whole, in pieces that overlap by more than any match is long.  Equal
spans of one priority all stay.  Repeated rows are each scanned.  Columns
besides the id and the text are not read, and may have any names.  An empty
table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between the words of a lower-cased text.
NOT_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: Fixed phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: label: (keyword, name). A space stands between words; the keyword is a part of every match of the name.
NAMES = {
    "mit": ("mit", "mit licen[sc]e"),
    "mit-0": ("mit", "mit (?:0|no attribution) licen[sc]e"),
    "mit-x11": ("x11", "(?:mit )?x11 licen[sc]e"),
    "expat": ("expat", "expat licen[sc]e"),
    "apache-2.0": ("apache", "apache (?:software )?licen[sc]e (?:version |v )?(?:2|v2)(?: 0)?"),
    "apache-1.1": ("apache", "apache (?:software )?licen[sc]e (?:version |v )?v?1 1"),
    "apache-1.0": ("apache", "apache (?:software )?licen[sc]e (?:version |v )?v?1 0"),
    "apache": ("apache", "apache (?:software )?licen[sc]e"),
    "gpl-3.0": ("general public", "(?:gnu )?general public licen[sc]e (?:version |v )?(?:3|v3)(?: 0)?"),
    "gpl-2.0": ("general public", "(?:gnu )?general public licen[sc]e (?:version |v )?(?:2|v2)(?: 0)?"),
    "gpl-1.0": ("general public", "(?:gnu )?general public licen[sc]e (?:version |v )?(?:1|v1)(?: 0)?"),
    "gpl": ("general public", "(?:gnu )?general public licen[sc]e"),
    "gplv3": ("gpl", "(?:gnu )?(?:gplv3|gpl (?:version |v )?v?3)(?: 0)?(?: only| or later)?"),
    "gplv2": ("gpl", "(?:gnu )?(?:gplv2|gpl (?:version |v )?v?2)(?: 0)?(?: only| or later)?"),
    "lgpl-3.0": ("lesser general", "(?:gnu )?lesser general public licen[sc]e (?:version |v )?v?3(?: 0)?"),
    "lgpl-2.1": ("lesser general", "(?:gnu )?lesser general public licen[sc]e (?:version |v )?v?2 1"),
    "lgpl-2.0": ("library general", "(?:gnu )?library general public licen[sc]e(?: (?:version |v )?v?2(?: 0)?)?"),
    "lgpl": ("lesser general", "(?:gnu )?lesser general public licen[sc]e"),
    "lgplv3": ("lgpl", "(?:gnu )?(?:lgplv3|lgpl3|lgpl (?:version |v )?v?3)(?: 0)?(?: only| or later)?"),
    "lgplv2": ("lgpl", "(?:gnu )?(?:lgplv2|lgpl2|lgpl (?:version |v )?v?2)(?: 0)?(?: only| or later)?"),
    "lgplv2.1": ("lgpl", "(?:gnu )?(?:lgplv2|lgpl2|lgpl (?:version |v )?v?2) 1(?: only| or later)?"),
    "agpl-3.0": ("affero", "(?:gnu )?affero general public licen[sc]e(?: (?:version |v )?v?3(?: 0)?)?"),
    "agplv3": ("agpl", "agplv3|agpl(?: (?:version |v )?v?3(?: 0)?)?"),
    "gfdl-1.3": ("free documentation", "(?:gnu )?free documentation licen[sc]e (?:version |v )?v?1 3"),
    "gfdl-1.2": ("free documentation", "(?:gnu )?free documentation licen[sc]e (?:version |v )?v?1 2"),
    "gfdl": ("free documentation", "(?:gnu )?free documentation licen[sc]e"),
    "bsd-4-clause": ("bsd", "(?:original|old|4 clause|four clause) bsd licen[sc]e|bsd 4 clause(?: licen[sc]e)?"),
    "bsd-3-clause": ("bsd", "(?:new|modified|revised|3 clause|three clause) bsd licen[sc]e|bsd 3 clause(?: licen[sc]e)?"),
    "bsd-2-clause": ("bsd", "(?:simplified|freebsd|2 clause|two clause) bsd licen[sc]e|bsd 2 clause(?: licen[sc]e)?"),
    "bsd-1-clause": ("bsd", "(?:1 clause|one clause) bsd licen[sc]e|bsd 1 clause(?: licen[sc]e)?"),
    "0bsd": ("bsd", "(?:zero clause|0 clause) bsd(?: licen[sc]e)?|0bsd(?: licen[sc]e)?"),
    "bsd": ("bsd", "bsd(?: style| like)? licen[sc]e"),
    "berkeley": ("berkeley software", "berkeley software distribution(?: style| like)? licen[sc]e"),
    "isc": ("isc", "isc licen[sc]e"),
    "zlib": ("zlib", "zlib(?: libpng)? licen[sc]e"),
    "libpng": ("png", "(?:png|libpng) (?:reference library )?licen[sc]e(?: version 2)?"),
    "mpl-2.0": ("mozilla", "mozilla public licen[sc]e (?:version |v )?v?2(?: 0)?"),
    "mpl-1.1": ("mozilla", "mozilla public licen[sc]e (?:version |v )?v?1 1"),
    "mpl-1.0": ("mozilla", "mozilla public licen[sc]e (?:version |v )?v?1 0"),
    "mpl": ("mozilla", "mozilla public licen[sc]e"),
    "epl-2.0": ("eclipse", "eclipse public licen[sc]e (?:version |v )?v?2(?: 0)?"),
    "epl-1.0": ("eclipse", "eclipse public licen[sc]e (?:version |v )?v?1(?: 0)?"),
    "epl": ("eclipse", "eclipse public licen[sc]e"),
    "edl-1.0": ("eclipse", "eclipse distribution licen[sc]e(?: (?:version |v )?v?1(?: 0)?)?"),
    "eupl-1.2": ("european union", "european union public licen[sc]e (?:version |v )?v?1 2"),
    "eupl": ("european union", "european union public licen[sc]e"),
    "cddl-1.1": ("distribution licen", "common development and distribution licen[sc]e (?:version |v )?v?1 1"),
    "cddl-1.0": ("distribution licen", "common development and distribution licen[sc]e(?: (?:version |v )?v?1 0)?"),
    "cpl-1.0": ("common public", "common public licen[sc]e(?: (?:version |v )?v?1(?: 0)?)?"),
    "ipl-1.0": ("ibm public", "ibm public licen[sc]e(?: (?:version |v )?v?1(?: 0)?)?"),
    "artistic-2.0": ("artistic", "(?:perl )?artistic licen[sc]e (?:version |v )?v?2(?: 0)?"),
    "artistic-1.0": ("artistic", "(?:perl )?artistic licen[sc]e(?: (?:version |v )?v?1(?: 0)?)?"),
    "bsl-1.0": ("boost", "boost software licen[sc]e(?: (?:version |v )?v?1(?: 0)?)?"),
    "busl-1.1": ("business source", "business source licen[sc]e(?: (?:version |v )?v?1 1)?"),
    "sspl-1.0": ("server side", "server side public licen[sc]e(?: (?:version |v )?v?1(?: 0)?)?"),
    "elastic-2.0": ("elastic", "elastic licen[sc]e(?: (?:version |v )?v?2(?: 0)?)?"),
    "unlicense": ("unlicen", "(?:the )?unlicen[sc]e"),
    "wtfpl": ("want to public", "do what the fuck you want to public licen[sc]e|do what the f you want to public licen[sc]e"),
    "python-2.0": ("python", "python (?:software foundation )?licen[sc]e(?: (?:version |v )?v?2(?: 0)?)?"),
    "php-3.0": ("php", "php licen[sc]e(?: (?:version |v )?v?3(?: 0[01]?)?)?"),
    "ruby": ("ruby", "ruby licen[sc]e"),
    "openssl": ("openssl", "openssl(?: ssleay)? licen[sc]e"),
    "openldap": ("openldap", "openldap public licen[sc]e(?: (?:version |v )?v?2 [0-9])?"),
    "postgresql": ("postgresql", "postgresql licen[sc]e"),
    "vim": ("vim", "vim licen[sc]e"),
    "ofl-1.1": ("open font", "(?:sil )?open font licen[sc]e(?: (?:version |v )?v?1 [01])?"),
    "odbl-1.0": ("open database", "open (?:data commons open )?database licen[sc]e(?: (?:version |v )?v?1(?: 0)?)?"),
    "odc-by-1.0": ("data commons", "open data commons attribution licen[sc]e(?: (?:version |v )?v?1(?: 0)?)?"),
    "ecl-2.0": ("educational", "educational community licen[sc]e(?: (?:version |v )?v?2(?: 0)?)?"),
    "ncsa": ("illinois", "(?:university of illinois|illinois) (?:ncsa )?open source licen[sc]e"),
    "ms-pl": ("microsoft public", "microsoft public licen[sc]e"),
    "ms-rl": ("microsoft reciprocal", "microsoft reciprocal licen[sc]e"),
    "apsl-2.0": ("apple public", "apple public source licen[sc]e(?: (?:version |v )?v?2(?: 0)?)?"),
    "qpl-1.0": ("q public", "q public licen[sc]e(?: (?:version |v )?v?1(?: 0)?)?"),
    "afl-3.0": ("academic free", "academic free licen[sc]e(?: (?:version |v )?v?3(?: 0)?)?"),
    "osl-3.0": ("open software", "open software licen[sc]e(?: (?:version |v )?v?3(?: 0)?)?"),
    "upl-1.0": ("universal permissive", "universal permissive licen[sc]e(?: (?:version |v )?v?1(?: 0)?)?"),
    "cecill-2.1": ("cecill", "cecill(?: free software)? licen[sc]e(?: (?:version |v )?v?2(?: [01])?)?"),
    "cc0-1.0": ("cc0", "cc0(?: 1 0)?(?: universal)?"),
    "cc-by-nc-nd": ("cc by nc nd", "cc by nc nd(?: [1-4] [05])?"),
    "cc-by-nc-sa": ("cc by nc sa", "cc by nc sa(?: [1-4] [05])?"),
    "cc-by-nc": ("cc by nc", "cc by nc(?: [1-4] [05])?"),
    "cc-by-nd": ("cc by nd", "cc by nd(?: [1-4] [05])?"),
    "cc-by-sa": ("cc by sa", "cc by sa(?: [1-4] [05])?"),
    "cc-by": ("cc by", "cc by(?: [1-4] [05])?"),
    "cc-attribution-noncommercial": ("creative commons", "creative commons attribution (?:noncommercial|non commercial)(?: noderivatives| noderivs| no derivatives| sharealike| share alike)?(?: [1-4] [05])?"),
    "cc-attribution-sharealike": ("creative commons", "creative commons attribution (?:sharealike|share alike)(?: [1-4] [05])?"),
    "cc-attribution": ("creative commons", "creative commons attribution(?: [1-4] [05])?"),
    "creative-commons": ("creative commons", "creative commons(?: public)? licen[sc]e"),
    "public-domain": ("public domain", "(?:in|into|to) the public domain|public domain dedication"),
    "proprietary": ("reserved", "all rights (?:are )?reserved"),
    "copyright": ("copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]"),
    "copyleft": ("copyleft", "copyleft"),
    "agpl": ("affero", "affero (?:gpl|licen[sc]e)"),
    "gplv1": ("gpl", "(?:gnu )?(?:gplv1|gpl (?:version |v )?v?1)(?: 0)?"),
    "gnu-gpl": ("gpl", "(?:gnu )?gpl"),
    "gnu-lgpl": ("lgpl", "(?:gnu )?lgpl"),
    "gnu-all-permissive": ("all permissive", "gnu all permissive licen[sc]e"),
    "gpl-classpath": ("classpath exception", "(?:gnu )?classpath exception"),
    "llvm-exception": ("llvm exception", "llvm exceptions?"),
    "gcc-exception": ("runtime library exception", "gcc runtime library exception"),
    "cc-attribution-noderivatives": ("creative commons", "creative commons attribution (?:noderivatives|noderivs|no derivatives)(?: [1-4] [05])?"),
    "cc0": ("creative commons", "creative commons (?:zero|cc0)"),
    "pddl-1.0": ("dedication", "(?:open data commons )?public domain dedication and licen[sc]e"),
    "cdla-permissive": ("community data", "community data licen[sc]e agreement(?: permissive)?"),
    "cdla-sharing": ("community data", "community data licen[sc]e agreement sharing"),
    "ogl-uk": ("open government", "open government licen[sc]e(?: (?:version |v )?v?[1-3](?: 0)?)?"),
    "ogl-roleplay": ("open game", "open game(?:ing)? licen[sc]e(?: (?:version |v )?v?1 0a?)?"),
    "openrail": ("openrail", "(?:creativeml |bigscience |bigcode )?openrail(?: m)?"),
    "rail": ("responsible ai", "responsible ai licen[sc]es?"),
    "llama-community": ("community license", "llama [234](?: [0-9])? community license(?: agreement)?"),
    "bsl-mariadb": ("bsl", "(?:mariadb )?bsl 1 1"),
    "commons-clause": ("commons clause", "commons clause(?: licen[sc]e)?"),
    "polyform": ("polyform", "polyform (?:noncommercial|small business|shield|strict|internal use|free trial) licen[sc]e(?: 1 0 0)?"),
    "parity": ("parity public", "parity public licen[sc]e(?: 7 0 0)?"),
    "prosperity": ("prosperity public", "prosperity public licen[sc]e(?: 3 0 0)?"),
    "blue-oak-1.0.0": ("blue oak", "blue oak model licen[sc]e(?: 1 0 0)?"),
    "mulan-psl": ("mulan", "mulan (?:permissive software|psl) licen[sc]e(?: 2(?: 0)?)?"),
    "mulan-publ": ("mulan", "mulan public licen[sc]e(?: 2(?: 0)?)?"),
    "curl": ("curl", "curl licen[sc]e"),
    "ijg": ("jpeg", "independent jpeg group(?: licen[sc]e)?"),
    "libtiff": ("libtiff", "libtiff licen[sc]e"),
    "freetype": ("freetype", "freetype(?: project)? licen[sc]e"),
    "imagemagick": ("imagemagick", "imagemagick licen[sc]e"),
    "info-zip": ("info zip", "info zip licen[sc]e"),
    "bzip2": ("bzip2", "bzip2(?: libbzip2)? licen[sc]e"),
    "unicode": ("unicode", "unicode (?:data files and software |terms of use |v3 )?licen[sc]e(?: agreement)?"),
    "icu": ("icu", "icu licen[sc]e"),
    "tcl": ("tcl", "tcl(?: tk)? licen[sc]e"),
    "zpl-2.1": ("zope", "zope public licen[sc]e(?: (?:version |v )?v?2 [01])?"),
    "w3c": ("w3c", "w3c (?:software |document )?(?:notice and )?licen[sc]e"),
    "sleepycat": ("sleepycat", "sleepycat(?: public)? licen[sc]e"),
    "watcom-1.0": ("watcom", "sybase open watcom public licen[sc]e(?: (?:version |v )?v?1 0)?"),
    "nasa-1.3": ("nasa", "nasa open source agreement(?: (?:version |v )?v?1 3)?"),
    "netscape-1.1": ("netscape", "netscape public licen[sc]e(?: (?:version |v )?v?1 [01])?"),
    "nokia": ("nokia", "nokia open source licen[sc]e"),
    "intel": ("intel", "intel (?:open source|simplified software) licen[sc]e"),
    "nvidia": ("nvidia", "nvidia (?:source code|software) licen[sc]e(?: agreement)?"),
    "oracle-upl": ("oracle", "oracle (?:technology network|binary code) licen[sc]e(?: agreement)?"),
    "adobe": ("adobe", "adobe (?:source libraries|glyph list) licen[sc]e"),
    "lppl-1.3c": ("latex", "latex project public licen[sc]e(?: (?:version |v )?v?1 [0-3][ac]?)?"),
    "gust-font": ("gust font", "gust font(?: source)? licen[sc]e"),
    "bitstream-vera": ("bitstream", "bitstream vera(?: font)? licen[sc]e"),
    "ubuntu-font": ("ubuntu font", "ubuntu font licen[sc]e(?: (?:version |v )?v?1 0)?"),
    "sil-ofl": ("ofl", "sil ofl(?: (?:version |v )?v?1 [01])?"),
    "cern-ohl": ("cern open", "cern open hardware licen[sc]e(?: (?:version |v )?v?[12](?: [0-2])?)?"),
    "solderpad": ("solderpad", "solderpad hardware licen[sc]e(?: (?:version |v )?v?[02] [0-9])?"),
    "tapr-ohl": ("tapr", "tapr open hardware licen[sc]e"),
    "liliq-p": ("liliq", "liliq (?:p|r|rplus)(?: 1 1)?"),
    "etalab": ("etalab", "etalab(?: open licen[sc]e)?(?: 2 0)?"),
    "dl-de-by": ("deutschland", "datenlizenz deutschland(?: namensnennung| zero)?(?: 2 0)?"),
    "hippocratic": ("hippocratic", "hippocratic licen[sc]e(?: (?:version |v )?v?[123] [01])?"),
    "anti-996": ("996", "anti 996 licen[sc]e(?: (?:version |v )?v?1 0)?"),
    "beerware": ("beer", "(?:beerware|beer ware) licen[sc]e"),
    "jsonlicense": ("json", "json licen[sc]e"),
    "x-consortium": ("x consortium", "x consortium licen[sc]e"),
    "naist": ("naist", "naist 2003 licen[sc]e"),
    "rpl-1.5": ("reciprocal public", "reciprocal public licen[sc]e(?: 1 [15])?"),
    "cpal-1.0": ("common public attribution", "common public attribution licen[sc]e(?: (?:version |v )?v?1 0)?"),
    "cua-opl": ("cua office", "cua office public licen[sc]e"),
    "sugarcrm": ("sugarcrm", "sugarcrm public licen[sc]e"),
    "spl-1.0": ("sun public", "sun public licen[sc]e(?: (?:version |v )?v?1 0)?"),
    "sissl": ("sun industry", "sun industry standards source licen[sc]e"),
    "vsl-1.0": ("vovida", "vovida software licen[sc]e(?: (?:version |v )?v?1 0)?"),
    "xnet": ("x net", "x net licen[sc]e"),
    "eiffel-2": ("eiffel", "eiffel forum licen[sc]e(?: (?:version |v )?v?[12])?"),
    "fair": ("fair", "fair licen[sc]e"),
    "ecos-2.0": ("ecos", "ecos licen[sc]e(?: (?:version |v )?v?2 0)?"),
    "shareware": ("shareware", "shareware"),
    "freeware": ("freeware", "freeware licen[sc]e"),
    "eula": ("end user", "end user licen[sc]e agreement"),
    "terms-of-service": ("terms of", "terms of (?:service|use) agreement"),
    "non-commercial": ("commercial", "(?:non commercial|noncommercial) use only|for (?:non commercial|noncommercial) (?:use|purposes)"),
    "research-only": ("research", "for research purposes only|research use only"),
}
#: (label, keyword, sentence): what stands in the texts of licenses themselves.
NOTICES = (
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "above copyright notice", "the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", "without restriction", "to deal in the software without restriction including without limitation the rights"),
    ("mit", "noninfringement", "merchantability fitness for a particular purpose and noninfringement"),
    ("isc", "hereby granted", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "author disclaims", "the author disclaims all warranties with regard to this software"),
    ("bsd", "source and binary", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote", "may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "apache", "licen[sc]ed under the apache licen[sc]e version 2 0 the licen[sc]e"),
    ("apache-2.0", "except in compliance", "you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2.0", "as is basis", "distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", "apache org", "www apache org licen[sc]es licen[sc]e 2 0"),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it"),
    ("gpl", "free software", "this file is free software you can redistribute it and or modify it"),
    ("gpl", "hope that it will be useful", "in the hope that it will be useful but without any warranty"),
    ("gpl", "you should have received", "you should have received a copy of the gnu general public licen[sc]e"),
    ("gpl", "free software foundation", "as published by the free software foundation"),
    ("gpl-2.0", "either version 2", "either version 2 of the licen[sc]e or at your option any later version"),
    ("gpl-3.0", "either version 3", "either version 3 of the licen[sc]e or at your option any later version"),
    ("lgpl", "this library is", "this library is free software you can redistribute it and or modify it"),
    ("lgpl", "you should have received", "you should have received a copy of the gnu lesser general public licen[sc]e"),
    ("agpl-3.0", "you should have received", "you should have received a copy of the gnu affero general public licen[sc]e"),
    ("gfdl", "granted to copy", "permission is granted to copy distribute and or modify this document"),
    ("gfdl", "invariant sections", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl-2.0", "mozilla org", "mozilla org mpl 2 0"),
    ("mpl-1.1", "contents of this file", "the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("cddl-1.0", "contents of this file", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("epl-1.0", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("zlib", "in no event", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "must not be misrepresented", "the origin of this software must not be misrepresented"),
    ("bsl-1.0", "boost", "distributed under the boost software licen[sc]e version 1 0"),
    ("bsl-1.0", "boost", "boost org licen[sc]e 1 0 txt"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense", "unlicense org"),
    ("cc0-1.0", "dedicated the work", "has dedicated the work to the public domain"),
    ("cc0-1.0", "publicdomain zero", "creativecommons org publicdomain zero 1 0"),
    ("cc-by-nc-nd", "by nc nd", "creativecommons org licen[sc]es by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "by nc sa", "creativecommons org licen[sc]es by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "by nc", "creativecommons org licen[sc]es by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "by nd", "creativecommons org licen[sc]es by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "by sa", "creativecommons org licen[sc]es by sa(?: [1-4] [05])?"),
    ("cc-by", "creativecommons", "creativecommons org licen[sc]es by(?: [1-4] [05])?"),
    ("creative-commons", "creative commons", "this work is licen[sc]ed under a creative commons"),
    ("artistic-2.0", "artistic", "under the terms of the artistic licen[sc]e"),
    ("python-2.0", "python software foundation", "python software foundation all rights reserved"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("ofl-1.1", "font software", "this font software is licen[sc]ed under the sil open font licen[sc]e"),
    ("ofl-1.1", "reserved font name", "with reserved font name"),
    ("proprietary", "proprietary and", "proprietary and confidential"),
    ("proprietary", "confidential and", "confidential and proprietary"),
    ("proprietary", "prohibited", "unauthori[sz]ed copying of this file via any medium is strictly prohibited"),
    ("proprietary", "without permission", "(?:may not|must not|no part may) be (?:reproduced|copied|distributed) without permission"),
    ("copyright", "copyright", "copyright notice"),
    ("copyright", "copyright all rights", "copyright all rights reserved"),
    ("public-domain", "public domain", "dedicated to the public domain"),
    ("public-domain", "public domain", "this (?:work|file|code|software|text) is in the public domain"),
    ("public-domain", "waives all", "waives all (?:copyright|rights)"),
    ("copyleft", "share alike", "share alike(?: licen[sc]e)?"),
    ("no-derivatives", "derivative", "no derivative works"),
    ("non-commercial", "commercial", "not for commercial use"),
    ("permission", "used with permission", "used with permission"),
    ("permission", "reprinted", "reprinted (?:with|by) permission"),
    ("trademark", "trademarks", "all trademarks are the property of their respective owners"),
)
#: Identifiers of the SPDX list as they stand behind a tag.
IDENTIFIERS = """0BSD AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause
BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CDDL-1.0 CDDL-1.1
CECILL-2.1 CPL-1.0 ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 ICU IJG ImageMagick ISC JSON LGPL-2.0 LGPL-2.1 LGPL-3.0
Libpng LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL NCSA ODbL-1.0 OFL-1.0 OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SSPL-1.0
Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1""".split()
#: Labels of names that are other names of a license, and the one label that it gets; versions of Creative Commons licenses are one.
SYNONYMS = {
    "gplv1": "gpl-1.0", "gplv2": "gpl-2.0", "gplv3": "gpl-3.0", "lgplv2": "lgpl-2.0", "lgplv2.1": "lgpl-2.1", "lgplv3": "lgpl-3.0", "agplv3": "agpl-3.0", "gnu-gpl": "gpl", "gnu-lgpl": "lgpl", "expat": "mit",
    "mit-x11": "x11", "berkeley": "bsd", "sil-ofl": "ofl-1.1", "cc0": "cc0-1.0", "bsl-mariadb": "busl-1.1", "jsonlicense": "json", "psf-2.0": "python-2.0", "php-3.01": "php-3.0", "cc-attribution": "cc-by",
    "cc-attribution-sharealike": "cc-by-sa", "cc-attribution-noderivatives": "cc-by-nd", "cc-attribution-noncommercial": "cc-by-nc",
}
#: Identifiers that are words or products too: alone, and one beside the other, they tell nothing.
PRODUCTS = frozenset("0BSD ICU IJG ImageMagick ISC JSON Libpng MIT MIT-0 NCSA OpenSSL PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 Ruby Unlicense Vim W3C X11 Zlib MS-PL MS-RL Elastic-2.0 BSL-1.0".split())
#: Those of them that a choice of two licenses may consist of.
CHOSEN = frozenset("0BSD ISC MIT MIT-0 Unlicense X11 Zlib".split())
#: Parts of words of which each match of a rule holds one, but for those of PAIRS; so a text without them has no detection, whatever stands between its words.
ROOTS = (
    "licen", "permission", "gpl", "redistrib", "commons", "public", "bsd", "reserved", "confidential", "commercial", "warrant", "copyright", "exception",
    "noninfring", "misrepresent", "deutschland", "restriction", "advertis", "foundation", "prohibited", "derivative", "respective", "shareware",
    "invariant", "openssl", "trademark", "copyleft", "openrail", "endorse", "mozilla", "affero", "etalab", "waives", "jpeg", "liliq", "alike", "llvm",
    "cc0", "bsl", "agreement", "research", "event", "wtfpl",
)
#: Two short words that count only one after the other.
PAIRS = (("cc", "by"), ("sil", "ofl"))
#: Beginnings of identifiers that count before a number, wherever no root stands.
HEADS = "afl|apache|apsl|artistic|blueoak|busl|cc0|cddl|cecill|cpl|ecl|efl|epl|eupl|gfdl|lppl|mpl|odbl|ofl|osl|qpl|sspl|upl|zpl"
#: (priority, sentence): how a name is declared; the bare name comes last, notices and tags stand between and above.
SENTENCES = (
    (80, "(?:this (?:work|file|code|software|program|text|document|project) is )?(?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:{})"),
    (60, "(?:{})"),
)
TAG, DECLARED, NOTICE, BARE = 90, 85, 70, 55
#: Words of a piece of a text, and words of the longest match at most.
CORE, REACH = 256, 32


def identifier_rules() -> list[tuple[int, str, str, str]]:
    """Identifiers behind the tag, as parts of an expression, as they are declared, and alone where they can't mean anything else."""
    words = {i: " ".join(re.findall("[a-z0-9]+", i.lower())) for i in IDENTIFIERS}
    label = lambda i: re.sub(r"^(cc-by\S*?)-[0-9.]+$", r"\1", i.lower())
    any_of = lambda ids: "|".join(sorted((words[i] for i in ids), key=len, reverse=True))
    every, plain = any_of(IDENTIFIERS), any_of(i for i in IDENTIFIERS if i not in PRODUCTS or i in CHOSEN)
    certain = any_of(i for i in IDENTIFIERS if i not in PRODUCTS)
    end = "(?: only| or later)?"
    out = []
    for i, w in words.items():
        out += [(TAG, label(i), f"identifier {w}", f"spdx licen[sc]e identifier {w}{end}"), (DECLARED, label(i), w, f"licen[sc]e[sd]?(?: under| is| as)?(?: the)? {w}{end}")]
        before = every if i not in PRODUCTS else plain if i in CHOSEN else certain
        out += [(TAG, label(i), f"{both} {w}", f"(?:{before}){end} {both} {w}{end}") for both in ("and", "or")]
        if i in CHOSEN:
            out += [(TAG, label(i), f"{w} {both}", f"{w} {both} (?:{certain}){end}") for both in ("and", "or")]
        if i not in PRODUCTS:
            out.append((BARE, label(i), w, f"{w}{end}"))
    return out


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, pattern), by priority; in patterns and keywords every word stands between two spaces of its own."""
    single = identifier_rules()
    single += [(NOTICE, label, keyword, sentence) for label, keyword, sentence in NOTICES]
    single += [(priority, label, keyword, sentence.format(name)) for priority, sentence in SENTENCES for label, (keyword, name) in NAMES.items()]
    double = lambda t: t.replace(" ", "  ")
    return sorted(((p, SYNONYMS.get(label, label), double(k), f" (?:{double(x)}) ") for p, label, k, x in single), key=lambda r: -r[0])


def gate(lower: Column) -> Column:
    """False only for lower-cased texts without a detection."""
    held = F.lit(False)
    for root in ROOTS:
        held |= F.contains(lower, F.lit(root))
    for first, second in PAIRS:
        held |= F.contains(lower, F.lit(first)) & F.rlike(lower, F.lit(f"{first}{NOT_WORD}{second}"))
    return held | F.rlike(lower, F.lit(f"(?:{HEADS}){NOT_WORD}v?[0-9]"))


def base_places(words: Column) -> Column:
    """(at, label) of every place where a phrase's words stand consecutively; words from 0."""
    starts = F.sequence(F.lit(0), F.size(words) - 1)

    def label_at(i: Column) -> Column:
        out = None
        for phrase, label in PHRASES.items():
            here = None
            for j, word in enumerate(phrase.split(" ")):
                same = F.get(words, i + j) == word
                here = same if here is None else here & same
            out = F.when(here, label) if out is None else out.when(here, label)
        return out

    return F.filter(F.transform(starts, lambda i: F.struct(i.alias("at"), label_at(i).alias("label"))), lambda p: p["label"].isNotNull())


def _matches(text: Column) -> Column:
    """Every match of every rule whose keyword a short text in normal form holds: (priority, label, start, end)."""
    table = F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(label).alias("label"), F.lit(k).alias("keyword"), F.lit(x).alias("pattern")) for p, label, k, x in rules()])

    def of_rule(rule: Column) -> Column:
        found = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
        # The k-th match ends after the first k pieces between matches and the first k matches.
        pairs = F.arrays_zip(F.split(text, rule["pattern"]).alias("before"), found.alias("match"))
        pairs = F.filter(pairs, lambda x: x["match"].isNotNull())
        none = F.array().cast("array<struct<end:int,size:int>>")
        ends = F.aggregate(pairs, none, lambda ends, x: F.concat(ends, F.array(F.struct((F.coalesce(F.try_element_at(ends, F.lit(-1))["end"], F.lit(0)) + F.length(x["before"]) + F.length(x["match"])).alias("end"), F.length(x["match"]).alias("size")))))
        return F.transform(ends, lambda e: F.struct(rule["priority"].alias("priority"), rule["label"].alias("label"), (e["end"] - e["size"]).alias("start"), e["end"].alias("end")))

    return F.flatten(F.transform(F.filter(table, lambda r: F.contains(text, r["keyword"])), of_rule))


def unsuppressed(found: Column) -> Column:
    """The detections that lie in none of higher priority, and in no longer one of the same."""
    wider = lambda a, b: (b["start"] <= a["start"]) & (b["end"] >= a["end"])
    size = lambda a: a["end"] - a["start"]
    over = lambda a, b: (b["priority"] > a["priority"]) | ((b["priority"] == a["priority"]) & (size(b) > size(a)))
    return F.filter(found, lambda a: ~F.exists(found, lambda b: wider(a, b) & over(a, b)))


def detections(words: Column) -> Column:
    """The unsuppressed matches of all rules in a text's words: (priority, label, first_word, end_word), by their first word.

    A match has at most REACH words, so the text is scanned in pieces of CORE
    words with as many words around them as a match, and one that it lies in,
    can reach; a piece gives the matches that begin in its core.  So the time
    grows with the text, however many matches it holds.
    """

    def span(start: Column, stop: Column) -> Column:
        low = F.greatest(start, F.lit(0))
        part = F.slice(words, low + 1, F.greatest(stop - low, F.lit(0)))
        return F.when(F.size(part) > 0, F.concat(F.lit(" "), F.array_join(part, "  "), F.lit(" "))).otherwise("")

    def piece(i: Column) -> Column:
        at = i * CORE
        before, near = span(at - 2 * REACH, at - REACH), span(at - REACH, at)
        core, after = span(at, at + CORE), span(at + CORE, at + CORE + REACH)
        return F.struct(F.greatest(at - 2 * REACH, F.lit(0)).alias("word"), F.length(before).alias("near"), (F.length(before) + F.length(near)).alias("core"), (F.length(before) + F.length(near) + F.length(core)).alias("after"), F.concat(before, near, core, after).alias("text"))

    def in_piece(p: Column) -> Column:
        # One element each, so that the piece and its matches have names and are made once.
        found = F.transform(F.array(_matches(p["text"])), lambda all_: F.filter(all_, lambda d: (d["start"] >= p["near"]) & (d["start"] < p["after"])))
        own = F.flatten(F.transform(found, lambda near: F.filter(unsuppressed(near), lambda d: d["start"] >= p["core"])))
        place = lambda at: p["word"] + ((at - F.length(F.replace(F.substring(p["text"], F.lit(1), at), F.lit(" "), F.lit("")))) / 2).cast("int")  # noqa: E731  two spaces a word
        return F.transform(own, lambda d: F.struct(d["priority"].alias("priority"), d["label"].alias("label"), place(d["start"]).alias("first_word"), place(d["end"]).alias("end_word")))

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / CORE).cast("int")), piece)
    return F.when(F.size(words) > 0, F.array_sort(F.flatten(F.transform(pieces, in_piece)), lambda a, b: F.when(a["first_word"] != b["first_word"], a["first_word"] - b["first_word"]).otherwise(b["priority"] - a["priority"])))


def licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, base, detections) of every row; no shuffle.

    ``base`` holds (at, label) of the fixed phrases, ``detections`` what the
    rules found and suppression left.  Rows that the gate holds back have neither.
    """
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(F.col(id_col).alias("doc_id"), lower.alias("lower")).select("doc_id", (F.size(F.split(F.concat(F.lit(" "), "lower", F.lit(" ")), NOT_WORD)) - 2).cast("long").alias("n_words"), F.when(gate(F.col("lower")), F.trim(F.regexp_replace("lower", NOT_WORD, " "))).alias("plain"))
    words = F.when(F.coalesce("plain", F.lit("")) != "", F.split("plain", " "))
    return rows.select("doc_id", "n_words", words.alias("words")).select("doc_id", "n_words", base_places(F.col("words")).alias("base"), detections(F.col("words")).alias("detections"))


def license_digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, first and last base place, labels and a score: the highest priority in a hundred, 0.5 for a base phrase alone."""
    none = F.array().cast("array<string>")
    base_labels = F.array_sort(F.array_distinct(F.coalesce(F.transform("base", lambda p: p["label"]), none)))
    found = F.coalesce(F.transform("detections", lambda d: d["label"]), none)
    score = F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])) / 100, F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0))
    return licenses(docs, id_col=id_col, text_col=text_col).select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["at"])).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.array_distinct(found))), ",").alias("labels"),
        score.alias("score"),
    )
