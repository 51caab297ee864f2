"""Signature rules of the license scan: fixed values, in their order of priority within each table.

All are written over normalised text: lower case, words with one blank between. Each has a label, a
keyword that stands in every match, and a regex of whole words.
"""

from __future__ import annotations

#: Words of an SPDX identifier after its tag. A regex, since a version may follow.
SPDX = [
    ("mit", "mit"),
    ("mit-0", "mit 0"),
    ("apache-1.1", "apache 1 1"),
    ("apache-2.0", "apache 2 0"),
    ("isc", "isc"),
    ("x11", "x11"),
    ("bsd-0-clause", "0bsd"),
    ("bsd-2-clause", "bsd 2 clause(?: patent)?"),
    ("bsd-3-clause", "bsd 3 clause(?: clear)?"),
    ("bsd-4-clause", "bsd 4 clause"),
    ("gpl-1.0", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "gpl 3 0(?: only| or later)?"),
    ("lgpl-2.0", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lgpl 3 0(?: only| or later)?"),
    ("agpl-1.0", "agpl 1 0(?: only| or later)?"),
    ("agpl-3.0", "agpl 3 0(?: only| or later)?"),
    ("gfdl", "gfdl 1 [123](?: (?:no )?invariants)?(?: only| or later)?"),
    ("mpl-1.0", "mpl 1 0"),
    ("mpl-1.1", "mpl 1 1"),
    ("mpl-2.0", "mpl 2 0(?: no copyleft exception)?"),
    ("epl-1.0", "epl 1 0"),
    ("epl-2.0", "epl 2 0"),
    ("cddl", "cddl 1 [01]"),
    ("cpl-1.0", "cpl 1 0"),
    ("eupl", "eupl 1 [012]"),
    ("cecill", "cecill(?: [12] [01]| [bc])"),
    ("artistic", "artistic 1 0(?: perl| cl8)?"),
    ("artistic-2.0", "artistic 2 0"),
    ("boost-1.0", "bsl 1 0"),
    ("bsl-1.1", "busl 1 1"),
    ("zlib", "zlib"),
    ("libpng", "libpng(?: 2 0)?"),
    ("unlicense", "unlicense"),
    ("wtfpl", "wtfpl"),
    ("cc0-1.0", "cc0 1 0"),
    ("cc-by-nc-nd", "cc by nc nd [1234] [05]"),
    ("cc-by-nc-sa", "cc by nc sa [1234] [05]"),
    ("cc-by-nc", "cc by nc [1234] [05]"),
    ("cc-by-nd", "cc by nd [1234] [05]"),
    ("cc-by-sa", "cc by sa [1234] [05]"),
    ("cc-by", "cc by [1234] [05]"),
    ("odbl", "odbl 1 0"),
    ("odc-by", "odc by 1 0"),
    ("pddl", "pddl 1 0"),
    ("ofl-1.1", "ofl 1 1(?: (?:no )?rfn)?"),
    ("psf-2.0", "(?:psf|python) 2 0(?: 1)?"),
    ("php-3.0", "php 3 01?"),
    ("ruby", "ruby"),
    ("postgresql", "postgresql"),
    ("openssl", "openssl"),
    ("ncsa", "ncsa"),
    ("w3c", "w3c"),
    ("ms-pl", "ms pl"),
    ("ms-rl", "ms rl"),
    ("upl-1.0", "upl 1 0"),
    ("sspl-1.0", "sspl 1 0"),
    ("elastic-2.0", "elastic 2 0"),
    ("afl-3.0", "afl 3 0"),
    ("blueoak-1.0.0", "blueoak 1 0 0"),
    ("curl", "curl"),
    ("vim", "vim"),
]
#: Fixed value: the tag before an SPDX identifier.
SPDX_TAG = "spdx licen[cs]e identifier "
#: Fixed value: what stands before a further identifier of an SPDX expression; not for identifiers that are also common words.
SPDX_NEXT = "(?:[0-4]|mit|isc|x11|0bsd|zlib|clause|only|later|unlicense|wtfpl|ncsa|exception) (?:or|and) "
ALSO_WORDS = ["ruby", "postgresql", "openssl", "w3c", "curl", "vim"]

#: Label, keyword, regex of a sentence or a fixed part of the licence's own text or notice.
TEXTS = [
    # MIT and its relatives
    ("ncsa", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal with the software without restriction"),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)?(?: to deal in the software without restriction)?"),
    ("mit", "without limitation the rights to use", "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "shall be included in all copies", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", "in no event shall the authors or copyright", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise"),
    ("boost-1.0", "permission is hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boost-1.0", "machine executable object code", "solely in the form of machine executable object code generated by a source language processor"),
    ("ofl-1.1", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("ofl-1.1", "font software", "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("ofl-1.1", "reserved font name", "no modified version of the font software may use the reserved font name"),
    ("postgresql", "without a written agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("isc", "with or without fee is hereby granted", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice(?: and this permission notice appear in all copies)?"),
    ("bsd-0-clause", "with or without fee is hereby granted", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("isc", "disclaims all warranties", "the software is provided as is and(?: the author| isc) disclaims all warranties with regard to this software"),
    ("x11", "x consortium shall not be used", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("ntp", "without express or implied warranty", "it is provided as is without express or implied warranty"),
    ("mit-0", "deal in the software without restriction", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is"),
    # BSD
    ("bsd", "in source and binary forms", "redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?(?: provided that the following conditions are met)?"),
    ("bsd", "redistributions of source code must", "redistributions of source code must retain the above copyright notice(?: this list of conditions and the following disclaimer)?"),
    ("bsd", "redistributions in binary form must", "redistributions in binary form must reproduce the above copyright notice(?: this list of conditions and the following disclaimer)?"),
    ("bsd-2-clause", "materials provided with the distribution", "materials provided with the distribution this software is provided by"),
    ("bsd-3-clause", "endorse or promote products derived", "(?:neither the names? of [^ ]+(?: [^ ]+){0,12} )?may (?:not )?be used to endorse or promote products derived from this software(?: without specific prior written permission)?"),
    ("bsd-4-clause", "must display the following", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause-clear", "express or implied licenses to any", "no express or implied licenses to any party s patent rights are granted by this licen[cs]e"),
    ("bsd-2-clause-patent", "patent licen", "each copyright holder and contributor hereby grants to those receiving rights under this licen[cs]e a perpetual worldwide non exclusive no charge royalty free irrevocable(?: [^ ]+){0,10} patent licen[cs]e"),
    ("bsd", "loss of use data or profits", "procurement of substitute goods or services loss of use data or profits or business interruption"),
    # Apache
    ("apache-2.0", "licensed under the apache licen", "licensed under the apache licen[cs]e version 2 0(?: the licen[cs]e)?(?: you may not use this file except in compliance with the licen[cs]e)?"),
    ("apache-2.0", "you may not use this file except", "you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", "www apache org licenses", "you may obtain a copy of the licen[cs]e at https? www apache org licenses licen[cs]e 2 0"),
    ("apache-2.0", "apache org licenses", "apache org licenses licen[cs]e 2 0"),
    ("apache-2.0", "use reproduction and distribution", "terms and conditions for use reproduction and distribution"),
    ("apache-2.0", "specific language governing permissions", "see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e"),
    ("apache-2.0", "one or more contributor", "licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements"),
    ("apache-2.0", "each contributor hereby grants to you", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable(?: except as stated in this section)? (?:copyright|patent) licen[cs]e"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    # GNU
    ("gpl-2.0", "guarantee your freedom to share", "the gnu general public licen[cs]e is intended to guarantee your freedom to share and change free software"),
    ("gpl-3.0", "free copyleft licen", "the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works"),
    ("agpl-3.0", "free copyleft licen", "the gnu affero general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works"),
    ("gpl-2.0", "either version 2", "gnu general public licen[cs]e as published by the free software foundation either version 2(?: of the licen[cs]e)?(?: or at your option any later version)?"),
    ("gpl-3.0", "either version 3", "gnu general public licen[cs]e as published by the free software foundation either version 3(?: of the licen[cs]e)?(?: or at your option any later version)?"),
    ("gpl-2.0", "free software foundation version 2", "gnu general public licen[cs]e(?: version 2)? as published by the free software foundation version 2(?: of the licen[cs]e)?"),
    ("gpl-3.0", "free software foundation version 3", "gnu general public licen[cs]e as published by the free software foundation version 3(?: of the licen[cs]e)?"),
    ("gpl-2.0", "general public licen", "gnu general public licen[cs]e version 2(?: 0)? (?:only )?as published by the free software foundation"),
    ("lgpl-2.1", "either version 2 1", "gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1(?: of the licen[cs]e)?(?: or at your option any later version)?"),
    ("lgpl-3.0", "either version 3", "gnu lesser general public licen[cs]e as published by the free software foundation either version 3(?: of the licen[cs]e)?(?: or at your option any later version)?"),
    ("lgpl-2.0", "either version 2", "gnu library general public licen[cs]e as published by the free software foundation either version 2(?: of the licen[cs]e)?(?: or at your option any later version)?"),
    ("agpl-3.0", "either version 3", "gnu affero general public licen[cs]e as published by the free software foundation either version 3(?: of the licen[cs]e)?(?: or at your option any later version)?"),
    ("agpl-3.0", "remote network interaction", "remote network interaction use with the gnu general public licen[cs]e"),
    ("lgpl-3.0", "lesser general public licen", "this version of the gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3 of the gnu general public licen[cs]e"),
    ("lgpl-2.1", "first released version of the lesser", "this is the first released version of the lesser gpl it also counts as the successor of the gnu library public licen[cs]e"),
    ("gpl", "gnu org licenses", "you should have received a copy of the gnu general public licen[cs]e along with this (?:program|file|library)(?: if not see https? www gnu org licenses) ?"),
    ("gpl", "a copy of the gnu general public licen", "you should have received a copy of the gnu general public licen[cs]e along with"),
    ("lgpl", "a copy of the gnu lesser general public", "you should have received a copy of the gnu lesser general public licen[cs]e along with"),
    ("agpl", "a copy of the gnu affero general public", "you should have received a copy of the gnu affero general public licen[cs]e along with"),
    ("gfdl", "free documentation licen", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    # Mozilla, Eclipse, Sun and others with files of their own notices
    ("mpl-2.0", "mozilla public licen", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-2.0", "mozilla org mpl 2 0", "you can obtain one at https? (?:www )?mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla public licen", "subject to the mozilla public licen[cs]e version 1 1(?: the licen[cs]e)?"),
    ("mpl-1.1", "www mozilla org mpl", "you may obtain a copy of the licen[cs]e at http www mozilla org mpl"),
    ("mpl-2.0", "incompatible with secondary licenses", "incompatible with secondary licenses as defined by the mozilla public licen[cs]e"),
    ("epl-2.0", "eclipse org legal epl", "(?:available at|found at) https? www eclipse org legal epl 2 0"),
    ("epl-1.0", "eclipse org legal epl v10", "https? www eclipse org legal epl v10"),
    ("epl-2.0", "eclipse public licen", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v|version )?2 0"),
    ("epl-1.0", "eclipse public licen", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v(?:ersion )?1 0"),
    ("cddl", "common development and distribution licen", "the contents of this file are subject to the terms of(?: either)? the common development and distribution licen[cs]e"),
    ("cpl-1.0", "common public licen", "under the terms of this common public licen[cs]e agreement any use reproduction or distribution"),
    ("eupl", "european union public licen", "licensed under the eupl version 1 [012] or as soon they will be approved by the european commission(?: [^ ]+){0,12} european union public licen[cs]e"),
    ("eupl", "licensed under the eupl", "licensed under the eupl(?: version)?(?: v)? ?1 [012]"),
    ("cecill", "cecill", "governed by the cecill(?: [abc])? licen[cs]e under french law"),
    ("sspl-1.0", "available to third parties", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("bsl-1.1", "on the change date", "effective on the change date or the fourth anniversary of the first publicly available distribution"),
    ("elastic-2.0", "hosted or managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("upl-1.0", "subject to the condition set forth below", "permission is hereby granted(?: [^ ]+){0,20} subject to the condition set forth below"),
    ("ms-pl", "use of the accompanying software", "this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e"),
    # short permissive texts
    ("zlib", "must not be misrepresented", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "origin of this software must not", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng", "png reference library", "the png reference library is supplied as is"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "publish use compile sell or distribute", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "do what the fuck you want to", "you just do what the fuck you want to"),
    ("beerware", "buy me a beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("artistic", "may be copied", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "copyright holder maintains", "the intent is that the copyright holder maintains some artistic control over the development of that package"),
    ("psf-2.0", "python software foundation", "this licen[cs]e agreement is between the python software foundation"),
    ("python", "beopen com", "this licen[cs]e agreement is between beopen com"),
    ("openssl", "openssl project", "this product includes software developed by the openssl project"),
    ("php-3.0", "includes php software", "this product includes php software freely available from"),
    ("ruby", "you may make and give away", "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("w3c", "you the licensee agree", "obtained using and or copying this work you the licensee agree that you have read understood and will comply with"),
    ("curl", "daniel stenberg", "copyright(?: and permission notice)? c [^ ]+(?: [^ ]+){0,4} daniel stenberg"),
    ("afl-3.0", "academic free licen", "licensed under the academic free licen[cs]e version 3 0"),
    ("blueoak-1.0.0", "blue oak model licen", "blue oak model licen[cs]e"),
    # Creative Commons and data
    ("cc0-1.0", "overtly fully permanently irrevocably", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("cc0-1.0", "associated a work with this deed", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1.0", "publicdomain zero 1 0", "creativecommons org publicdomain zero 1 0"),
    ("cc-by-nc-nd", "creativecommons org licenses", "creativecommons org licenses by nc nd [1234] [05]"),
    ("cc-by-nc-sa", "creativecommons org licenses", "creativecommons org licenses by nc sa [1234] [05]"),
    ("cc-by-nc", "creativecommons org licenses", "creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nd", "creativecommons org licenses", "creativecommons org licenses by nd [1234] [05]"),
    ("cc-by-sa", "creativecommons org licenses", "creativecommons org licenses by sa [1234] [05]"),
    ("cc-by", "creativecommons org licenses", "creativecommons org licenses by [1234] [05]"),
    ("cc-by", "you must give appropriate credit", "you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made"),
    ("cc-by-sa", "under the same licen", "if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e as the original"),
    ("cc-by-nc", "for commercial purposes", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "distribute the modified material", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("odbl", "open database licen", "this [^ ]+(?: [^ ]+){0,6} is made available under the open database licen[cs]e"),
    ("pddl", "public domain dedication and licen", "is made available under the public domain dedication and licen[cs]e v1 0"),
]

#: Label, keyword, regex of the licence's name, which may stand in a frame.
NAMES = [
    ("agpl-3.0", "affero general public licen", "(?:gnu )?affero general public licen[cs]e(?: v| version)? ?3(?: 0)?"),
    ("agpl", "affero general public licen", "(?:gnu )?affero general public licen[cs]e"),
    ("agpl-3.0", "agpl", "agpl ?v?3(?: 0)?(?: only| or later)?"),
    ("agpl", "agpl", "agpl"),
    ("lgpl-2.1", "lesser general public licen", "gnu lesser general public licen[cs]e v(?:ersion )?2 1"),
    ("lgpl-3.0", "lesser general public licen", "gnu lesser general public licen[cs]e(?: v| version) ?3(?: 0)?"),
    ("lgpl", "lesser general public licen", "gnu lesser general public licen[cs]e"),
    ("lgpl", "library general public licen", "gnu library general public licen[cs]e"),
    ("lgpl-2.1", "lgpl", "lgpl ?v?2 1(?: only| or later)?"),
    ("lgpl-2.0", "lgpl", "lgpl ?v?2(?: 0)?(?: only| or later)?"),
    ("lgpl-3.0", "lgpl", "lgpl ?v?3(?: 0)?(?: only| or later)?"),
    ("lgpl", "lgpl", "lgpl"),
    ("gpl-2.0", "general public licen", "gnu general public licen[cs]e(?: v| version) ?2(?: 0)?"),
    ("gpl-3.0", "general public licen", "gnu general public licen[cs]e(?: v| version) ?3(?: 0)?"),
    ("gpl", "general public licen", "gnu general public licen[cs]e"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl ?v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl ?v?3(?: 0)?(?: only| or later)?"),
    ("gpl", "gnu gpl", "gnu gpl"),
    ("gfdl", "free documentation licen", "gnu free documentation licen[cs]e(?: version 1 [123])?"),
    ("apache-2.0", "apache", "apache(?: software)? licen[cs]e(?: version)? ?v?2(?: 0)?"),
    ("apache-1.1", "apache", "apache(?: software)? licen[cs]e(?: version)? 1 1"),
    ("apache", "apache", "apache(?: software)? licen[cs]e"),
    ("mit", "mit licen", "(?:the )?mit licen[cs]e"),
    ("mit", "expat licen", "expat licen[cs]e"),
    ("mit-0", "mit no attribution", "mit no attribution"),
    ("x11", "x11 licen", "x11 licen[cs]e"),
    ("isc", "isc licen", "isc licen[cs]e"),
    ("bsd-2-clause", "bsd", "(?:simplified|2 clause) bsd(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", "(?:new|revised|modified|3 clause) bsd(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", "(?:original|old|4 clause) bsd(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd 2 clause", "bsd 2 clause(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd 3 clause", "bsd 3 clause(?: licen[cs]e)?"),
    ("bsd-0-clause", "0bsd", "0bsd"),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e"),
    ("mpl-1.1", "mozilla public licen", "mozilla public licen[cs]e(?: version)? v?1 1"),
    ("mpl-2.0", "mozilla public licen", "mozilla public licen[cs]e(?: version)? v?2(?: 0)?"),
    ("mpl", "mozilla public licen", "mozilla public licen[cs]e"),
    ("epl-1.0", "eclipse public licen", "eclipse public licen[cs]e(?: version)? v?1 0"),
    ("epl-2.0", "eclipse public licen", "eclipse public licen[cs]e(?: version| v)? ?v?2 0"),
    ("epl", "eclipse public licen", "eclipse public licen[cs]e"),
    ("edl-1.0", "eclipse distribution licen", "eclipse distribution licen[cs]e"),
    ("cddl", "cddl", "cddl(?: 1 [01])?"),
    ("cddl", "common development and distribution licen", "common development and distribution licen[cs]e(?: version 1 [01])?"),
    ("cpl-1.0", "common public licen", "common public licen[cs]e(?: version 1 0)?"),
    ("eupl", "european union public licen", "european union public licen[cs]e(?: v(?:ersion )?1 [012])?"),
    ("eupl", "eupl", "eupl(?: v?1 [012])?"),
    ("cecill", "cecill", "cecill(?: [abc])?(?: licen[cs]e)?"),
    ("artistic-2.0", "artistic licen", "artistic licen[cs]e(?: version)? 2(?: 0)?"),
    ("artistic", "artistic licen", "artistic licen[cs]e"),
    ("boost-1.0", "boost software licen", "boost software licen[cs]e(?: version 1 0)?"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("libpng", "libpng licen", "libpng licen[cs]e"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("wtfpl", "do what the fuck you want to", "do what the fuck you want to public licen[cs]e"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc by", "cc by nc nd(?: [1234] 0)?"),
    ("cc-by-nc-sa", "cc by", "cc by nc sa(?: [1234] 0)?"),
    ("cc-by-nc", "cc by", "cc by nc(?: [1234] 0)?"),
    ("cc-by-nd", "cc by", "cc by nd(?: [1234] 0)?"),
    ("cc-by-sa", "cc by", "cc by sa(?: [1234] 0)?"),
    ("cc-by", "cc by", "cc by(?: [1234] 0)?"),
    ("cc-by-nc-nd", "creative commons attribution", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?"),
    ("cc-by-nc-sa", "creative commons attribution", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "creative commons attribution", "creative commons attribution non ?commercial"),
    ("cc-by-nd", "creative commons attribution", "creative commons attribution no ?deriv(?:ative)?s?"),
    ("cc-by-sa", "creative commons attribution", "creative commons attribution share ?alike"),
    ("cc-by", "creative commons attribution", "creative commons attribution"),
    ("odbl", "open database licen", "open database licen[cs]e"),
    ("odc-by", "open data commons attribution licen", "open data commons attribution licen[cs]e"),
    ("pddl", "public domain dedication and licen", "public domain dedication and licen[cs]e"),
    ("public-domain", "the public domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("ofl-1.1", "sil open font licen", "sil open font licen[cs]e(?: version 1 1)?"),
    ("psf-2.0", "python software foundation licen", "python software foundation licen[cs]e(?: version 2)?"),
    ("php-3.0", "php licen", "php licen[cs]e(?: version 3 0(?:1)?)?"),
    ("ruby", "ruby licen", "ruby licen[cs]e"),
    ("postgresql", "postgresql licen", "postgresql licen[cs]e"),
    ("openssl", "openssl licen", "openssl licen[cs]e"),
    ("ncsa", "ncsa open source licen", "(?:university of illinois )?ncsa open source licen[cs]e"),
    ("w3c", "w3c software", "w3c software (?:notice and )?licen[cs]e"),
    ("ms-pl", "microsoft public licen", "microsoft public licen[cs]e"),
    ("ms-rl", "microsoft reciprocal licen", "microsoft reciprocal licen[cs]e"),
    ("upl-1.0", "universal permissive licen", "universal permissive licen[cs]e"),
    ("sspl-1.0", "server side public licen", "server side public licen[cs]e"),
    ("bsl-1.1", "business source licen", "business source licen[cs]e(?: 1 1)?"),
    ("elastic-2.0", "elastic licen", "elastic licen[cs]e(?: v?2(?: 0)?)?"),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge"),
    ("proprietary", "all rights reserved", "all rights reserved"),
]
#: Fixed value: words before a name that state what it is the licence of.
FRAME = "(?:(?:licen[cs]ed |released |distributed |published |available |provided |redistributable )?under (?:the )?(?:(?:terms|conditions) (?:and conditions )?of (?:the )?)?)?"
#: Weights of a tag, a text, a name in a frame with and without a verb, a bare name and a further identifier.
TAG, TEXT, STATED, FRAMED, BARE, NEXT = 1.0, 0.95, 0.95, 0.85, 0.6, 0.6
#: Substrings of which one stands in every match of a rule, looked for before any rule.
GATE = ["licen", "gpl", "bsd", "spdx", "hereby granted", "org mpl", "org legal", "eclipse org", "creativecommons", "creative commons", "cc by", "cc0", "public domain", "rights reserved", "cddl", "eupl", "cecill", "wtfpl", "fuck", "mit no attribution", "copyright", "software", "redistribution", "reproduction and distribution", "business interruption", "libpng", "buy me a beer", "beopen", "curl", "appropriate credit", "commercial purposes", "modified material", "x consortium", "express or implied", "display the following", "remote network", "available to third parties", "change date", "reference library", "a package may", "maintains some artistic", "associated a work", "unconditionally waives", "machine executable", "condition set forth"]
