"""The signatures of the licence scan: hand-written patterns over normalised words, in order of priority.

A text is normalised to its words in lower case, one space apart, so a pattern needs no punctuation. Each licence has its own
patterns for its name; the ways in which a name is written into a file (tag, grant, header, bare mention) are patterns too,
written once and joined with every name.
"""

from __future__ import annotations

#: The phrases and labels that a scan reports at least.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

_V = r"(?: version| v)?"
_GNU = r"(?:gnu )?"

#: label, keywords of which any text with a match contains one (parted by |), pattern of the name, pattern of the tag. Later versions and narrower names first.
LICENCES = (
    ("agpl-3.0", "general public", rf"{_GNU}affero general public licen[cs]e{_V} ?3(?: 0)?", r"agpl 3 0(?: only| or later)?"),
    ("agpl", "general public", rf"{_GNU}affero general public licen[cs]e", r"agpl(?: only| or later)?"),
    ("lgpl-3.0", "general public", rf"{_GNU}(?:lesser|library) general public licen[cs]e{_V} ?3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "general public", rf"{_GNU}(?:lesser|library) general public licen[cs]e{_V} ?2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-2.0", "general public", rf"{_GNU}(?:lesser|library) general public licen[cs]e{_V} ?2(?: 0)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl", "general public", rf"{_GNU}(?:lesser|library) general public licen[cs]e", r"lgpl(?: only| or later)?"),
    ("gpl-3.0", "general public", rf"{_GNU}general public licen[cs]e{_V} ?3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("gpl-2.0", "general public", rf"{_GNU}general public licen[cs]e{_V} ?2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-1.0", "general public", rf"{_GNU}general public licen[cs]e{_V} ?1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gfdl-1.3", "free documentation", rf"{_GNU}free documentation licen[cs]e{_V} ?1 3", r"gfdl 1 3(?: only| or later)?"),
    ("gfdl-1.2", "free documentation", rf"{_GNU}free documentation licen[cs]e{_V} ?1 2", r"gfdl 1 2(?: only| or later)?"),
    ("gfdl", "free documentation", rf"{_GNU}free documentation licen[cs]e", r"gfdl(?: only| or later)?"),
    ("gpl", "general public", r"gnu general public licen[cs]e|general public licen[cs]e", r"gpl(?: only| or later)?"),
    ("apache-2.0", "apache", rf"apache(?: software)? licen[cs]e{_V} ?2(?: 0)?", r"apache 2 0"),
    ("apache-1.1", "apache", rf"apache(?: software)? licen[cs]e{_V} ?1 1", r"apache 1 1"),
    ("apache-1.0", "apache", rf"apache(?: software)? licen[cs]e{_V} ?1 0", r"apache 1 0"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e", r"apache"),
    ("cc-by-nc-nd-4.0", "cc by", r"cc by nc nd 4 0", r"cc by nc nd 4 0"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa-4.0", "cc by", r"cc by nc sa 4 0", r"cc by nc sa 4 0"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-4.0", "cc by", r"cc by nc 4 0", r"cc by nc 4 0"),
    ("cc-by-nc", "cc by", r"cc by nc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd-4.0", "cc by", r"cc by nd 4 0", r"cc by nd 4 0"),
    ("cc-by-nd", "cc by", r"cc by nd", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa-4.0", "cc by", r"cc by sa 4 0", r"cc by sa 4 0"),
    ("cc-by-sa-3.0", "cc by", r"cc by sa 3 0", r"cc by sa 3 0"),
    ("cc-by-sa", "cc by", r"cc by sa", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-4.0", "cc by", r"cc by 4 0", r"cc by 4 0"),
    ("cc-by-3.0", "cc by", r"cc by 3 0", r"cc by 3 0"),
    ("cc-by", "cc by", r"cc by", r"cc by(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?", r"cc by nc nd"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike", r"cc by nc sa"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial", r"cc by nc"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s?(?: works)?", r"cc by nd"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike", r"cc by sa"),
    ("cc-by", "creative commons", r"creative commons attribution", r"cc by"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc0-1.0", "creative commons", r"creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?", r"mit 0"),
    ("mit", "mit|expat|x11", r"(?:the )?(?:mit|expat|x11) licen[cs]e", r"mit"),
    ("bsd-4-clause", "bsd", r"(?:original |old )bsd licen[cs]e|bsd (?:4|four) clause(?: licen[cs]e)?|(?:4|four) clause bsd(?: licen[cs]e)?", r"bsd 4 clause"),
    ("bsd-3-clause", "bsd", r"(?:new |revised |modified )bsd licen[cs]e|bsd (?:3|three) clause(?: licen[cs]e)?|(?:3|three) clause bsd(?: licen[cs]e)?", r"bsd 3 clause"),
    ("bsd-2-clause", "bsd", r"(?:simplified |freebsd )bsd licen[cs]e|bsd (?:2|two) clause(?: licen[cs]e)?|(?:2|two) clause bsd(?: licen[cs]e)?", r"bsd 2 clause"),
    ("0bsd", "bsd|zero clause", r"(?:zero clause |bsd zero clause )(?:bsd )?(?:licen[cs]e)?|0bsd", r"0bsd"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", r"bsd"),
    ("isc", "isc", r"isc licen[cs]e", r"isc"),
    ("mpl-2.0", "mozilla", rf"mozilla public licen[cs]e{_V} ?2(?: 0)?", r"mpl 2 0"),
    ("mpl-1.1", "mozilla", rf"mozilla public licen[cs]e{_V} ?1 1", r"mpl 1 1"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", r"mpl"),
    ("epl-2.0", "eclipse", rf"eclipse public licen[cs]e{_V} ?2(?: 0)?", r"epl 2 0"),
    ("epl-1.0", "eclipse", rf"eclipse public licen[cs]e{_V} ?1(?: 0)?", r"epl 1 0"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e", r"edl 1 0"),
    ("cddl-1.0", "common development", r"common development and distribution licen[cs]e", r"cddl 1 [01]"),
    ("cpl-1.0", "common public", r"common public licen[cs]e", r"cpl 1 0"),
    ("eupl-1.2", "european union", rf"european union public licen[cs]e{_V} ?1 2", r"eupl 1 2"),
    ("eupl", "european union", r"european union public licen[cs]e", r"eupl(?: 1 [01])?"),
    ("artistic-2.0", "artistic", rf"artistic licen[cs]e{_V} ?2(?: 0)?", r"artistic 2 0"),
    ("artistic-1.0", "artistic", r"(?:perl )?artistic licen[cs]e", r"artistic 1 0(?: perl)?"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e", r"bsl 1 0"),
    ("busl-1.1", "business source", r"business source licen[cs]e", r"busl 1 1"),
    ("sspl-1.0", "server side", r"server side public licen[cs]e", r"sspl 1 0"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e", r"elastic 2 0"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", r"zlib"),
    ("unlicense", "unlicen", r"(?:the )?unlicen[cs]e", r"unlicense"),
    ("wtfpl", "do what the f", r"do what the f\w* you want to public licen[cs]e", r"wtfpl"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e", r"ofl 1 1"),
    ("odbl-1.0", "open database|open data commons", r"open (?:data commons )?(?:open )?database licen[cs]e", r"odbl 1 0"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[cs]e", r"odc by 1 0"),
    ("pddl-1.0", "public domain", r"public domain dedication and licen[cs]e", r"pddl 1 0"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", r"ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", r"ms rl"),
    ("python-2.0", "python", r"python software foundation licen[cs]e", r"(?:python|psf) 2 0"),
    ("php-3.01", "php", r"php licen[cs]e", r"php 3 01?"),
    ("ruby", "ruby", r"ruby licen[cs]e", r"ruby"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql"),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl"),
    ("ncsa", "illinois", r"university of illinois ncsa(?: open source)? licen[cs]e", r"ncsa"),
    ("afl-3.0", "academic free", r"academic free licen[cs]e", r"afl 3 0"),
    ("osl-3.0", "open software", r"open software licen[cs]e", r"osl 3 0"),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[cs]e", r"w3c"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[cs]e", r"upl 1 0"),
    ("bsd-protection", "bsd", r"bsd protection licen[cs]e", r"bsd protection"),
    ("openrail", "rail|responsible ai", r"(?:open|big\w+ open) rail(?: m)? licen[cs]e|responsible ai licen[cs]e", r"openrail"),
    ("llama-community", "llama", r"llama(?: \d)*(?: community)? licen[cs]e", r"llama\d?"),
)

#: Ways of naming a licence: priority, weight, the keyword they need besides the licence's own, and the frame.
FORMS = (
    (1, 0.99, "spdx", "spdx licen[cs]e identifier {tag}"),
    (2, 0.95, "under", r"(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:{name})"),
    (3, 0.85, "icen", r"(?:licen[cs]e|licen[cs]ing)(?: is)?(?: the)? (?:{name})"),
    (4, 0.7, "", "(?:{name})"),
)

#: Clauses that show a licence without its name: label, keyword, pattern, weight.
CLAUSES = (
    ("mit", "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("mit", "without restriction", r"to deal in the software without restriction", 0.9),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose", 0.9),
    ("bsd", "source and binary", r"redistribution and use in source and binary forms", 0.9),
    ("bsd-3-clause", "neither the name", r"neither the names? of .{1,80}? may be used to endorse or promote", 0.9),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software", 0.9),
    ("gpl", "redistribute it", r"you can redistribute it and or modify it under the terms of the gnu", 0.9),
    ("gpl-3.0-or-later", "3 of the license", r"either version 3 of the licen[cs]e or at your option any later version", 0.95),
    ("gpl-2.0-or-later", "2 of the license", r"either version 2 of the licen[cs]e or at your option any later version", 0.95),
    ("apache-2.0", "except in compliance", r"you may not use this file except in compliance with the licen[cs]e", 0.95),
    ("apache-2.0", "org licenses", r"apache org licenses license 2 0", 0.95),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e", 0.95),
    ("zlib", "implied warranty", r"this software is provided as is without any express or implied warranty", 0.7),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain", 0.95),
    ("public-domain", "public domain", r"(?:placed|released|dedicated) (?:in|into|to) the public domain", 0.8),
    ("cc-by", "creativecommons", r"creativecommons org licenses by \d", 0.9),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa", 0.9),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc", 0.9),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero", 0.95),
    ("proprietary", "all rights reserved", r"all rights reserved", 0.4),
    ("proprietary", "proprietary", r"proprietary and confidential|confidential and proprietary", 0.7),
    ("non-commercial", "commercial use", r"for non ?commercial use only|not for commercial use", 0.7),
)


def rules() -> list[tuple[int, str, str, str, str, float]]:
    """rank, label, first keyword, second keyword, pattern, weight; a lower rank has priority. Several hundred.

    A rule with more than one keyword comes once for each; the same place found twice counts once.
    """
    out, rank = [], 0
    for _, weight, needs, frame in FORMS:
        for label, keyword, name, tag in LICENCES:
            # A tag stands for the name, so only the frame's own keyword is sure to be there.
            for first in [needs] if "{tag}" in frame else keyword.split("|"):
                out.append((rank, label, first, needs, frame.format(name=name, tag=tag), weight))
            rank += 1
    for label, keyword, pattern, weight in CLAUSES:
        out.append((rank, label, keyword.replace("license", "licen"), "", pattern, weight))
        rank += 1
    return out
