"""Licence recognition by sentences and ordered rules, in DataFrame functions only.

A text is lower-cased and cut into sentences: at punctuation before white space, and at lines without letters or digits. Other line breaks,
comment markers and indents are part of a sentence, so wrapped licences and headers in comments are read like plain ones; but a known
sentence may also begin and end at the ends of lines, as titles and notices do among other lines. Known sentences become their identifiers, and a licence
rule is a sequence of identifiers, each at most ``GAP`` sentences after the one before. Of the rules that match, those go whose sequence is part of
another one's, so the longest wins. The tables of sentences and rules are literals of the plan, so nothing is shuffled, and texts without any of
the words that every known sentence has one of are only searched for these.

Defined results: a null or empty text recognises nothing and matches no rule; repeated rows get equal rows; an empty table
gives an empty result; texts of any length are read whole; other columns of the input play no part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, text_or_empty

GAP = 8

# Sentences of licences and their usual notices, by a name for each; where several are given, they count as the same.
SENTENCES: dict[str, tuple[str, ...]] = {
    "rights-reserved": ("All rights reserved",),
    "mit-title": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    ),
    "mit0-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    ),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "mit-warranty": (
        'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement',
    ),
    "json-good": ("The Software shall be used for Good, not Evil",),
    "apache-title": ("Apache License",),
    "apache-version": ("Version 2.0, January 2004",),
    "apache-licensed": ('Licensed under the Apache License, Version 2.0 (the "License")',),
    "not-except": ("you may not use this file except in compliance with the License",),
    "copy-at": ("You may obtain a copy of the License at",),
    "unless-required": (
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    ),
    "see-license": ("See the License for the specific language governing permissions and limitations under the License",),
    "gpl-title": ("GNU General Public License",),
    "lgpl-title": ("GNU Lesser General Public License",),
    "lgpl2-title": ("GNU Library General Public License",),
    "agpl-title": ("GNU Affero General Public License",),
    "gfdl-title": ("GNU Free Documentation License",),
    "v1-february-1989": ("Version 1, February 1989",),
    "v2-june-1991": ("Version 2, June 1991",),
    "v2.1-february-1999": ("Version 2.1, February 1999",),
    "v3-june-2007": ("Version 3, 29 June 2007",),
    "v3-november-2007": ("Version 3, 19 November 2007",),
    "v1.2-november-2002": ("Version 1.2, November 2002",),
    "v1.3-november-2008": ("Version 1.3, 3 November 2008",),
    "free-software": ("This program is free software", "This library is free software", "This file is free software", "This software is free software"),
    "gpl2-later": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2, or (at your option) any later version",
    ),
    "gpl3-later": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3, or (at your option) any later version",
    ),
    "gpl2-only": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 of the License",
    ),
    "gpl3-only": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3",
    ),
    "lgpl2-later": (
        "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    ),
    "lgpl2.1-later": (
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version",
    ),
    "lgpl3-later": (
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "agpl3-later": (
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "agpl3-only": (
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3 of the License",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3",
    ),
    "hope-useful": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    ),
    "bsd-intro": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistribution and use in source and binary forms, with or without modification, are permitted (subject to the limitations in the disclaimer below) provided that the following conditions are met",
    ),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions of source code must retain the above copyright notice, this list of conditions, and the following disclaimer",
    ),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    ),
    "bsd-names": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Neither the name of the copyright holders nor the names of any contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Neither the name of the project nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "bsd-advertising": ("All advertising materials mentioning features or use of this software must display the following acknowledgement",),
    "bsd-patent": ("No express or implied licenses to any party's patent rights are granted by this license",),
    "isc-title": ("ISC License", "The ISC License"),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "0bsd-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "author-disclaims": (
        'The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness',
    ),
    "hpnd-grant": (
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation",
    ),
    "postgresql-grant": (
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    ),
    "mpl2-form": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    "mpl2-terms": ("This Source Code Form is subject to the terms of the Mozilla Public License, v",),
    "mpl2-copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    "mpl2-title": ("Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"),
    "mpl1.1-contents": ('The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License")',),
    "npl1.1-contents": ('The contents of this file are subject to the Netscape Public License Version 1.1 (the "License")',),
    "epl1-title": ("Eclipse Public License - v 1.0", "Eclipse Public License v1.0"),
    "epl2-title": ("Eclipse Public License - v 2.0", "Eclipse Public License v2.0"),
    "epl1-terms": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",),
    "epl2-terms": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "cddl-title": ("Common Development and Distribution License (CDDL) Version 1.0", "Common Development and Distribution License (CDDL)"),
    "cddl-terms": ('The contents of this file are subject to the terms of the Common Development and Distribution License (the "License")',),
    "cpl-title": ("Common Public License Version 1.0", "Common Public License - v 1.0"),
    "unlicense-free": ("This is free and unencumbered software released into the public domain",),
    "unlicense-anyone": (
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ),
    "cc-code": ("Creative Commons Legal Code",),
    "cc0-title": ("CC0 1.0 Universal",),
    "zlib-as-is": ("This software is provided 'as-is', without any express or implied warranty",),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
    "zlib-origin": ("The origin of this software must not be misrepresented",),
    "bsl-title": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "bsl-terms": ("Distributed under the Boost Software License, Version 1.0",),
    "bsl-grant": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',
    ),
    "wtfpl-title": ("Do What The Fuck You Want To Public License",),
    "wtfpl-copy": ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",),
    "artistic2-title": ("The Artistic License 2.0", "Artistic License 2.0"),
    "ofl-terms": ("This Font Software is licensed under the SIL Open Font License, Version 1.1",),
    "ofl-title": ("SIL Open Font License Version 1.1 - 26 February 2007",),
    "psf-title": ("Python Software Foundation License Version 2",),
    "ncsa-title": ("University of Illinois/NCSA Open Source License",),
    "eupl-terms": ("Licensed under the EUPL, Version 1.2", "Licensed under the EUPL"),
    "beerware-title": ("The Beer-Ware License",),
    "zpl-title": ("Zope Public License (ZPL) Version 2.1",),
    "mulan-terms": ("You can use this software according to the terms and conditions of the Mulan PSL v2",),
    "upl-title": ("The Universal Permissive License (UPL), Version 1.0",),
    "afl-terms": ("Licensed under the Academic Free License version 3.0",),
    "osl-terms": ("Licensed under the Open Software License version 3.0",),
    "vim-title": ("Vim License",),
    "openssl-title": ("OpenSSL License",),
    "ms-pl-title": ("Microsoft Public License (Ms-PL)", "Microsoft Public License (MS-PL)"),
    "odbl-title": ("Open Database License (ODbL) v1.0", "ODC Open Database License (ODbL)"),
}
# Licence rules, each a name and its sentences in order.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("proprietary-notice", ("rights-reserved",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT-titled", ("mit-title", "mit-grant", "mit-notice")),
    ("JSON", ("mit-grant", "mit-notice", "json-good")),
    ("MIT-0", ("mit0-grant", "mit-warranty")),
    ("Apache-2.0-text", ("apache-title", "apache-version")),
    ("Apache-2.0", ("apache-licensed", "not-except", "copy-at", "unless-required", "see-license")),
    ("GPL-1.0-text", ("gpl-title", "v1-february-1989")),
    ("GPL-2.0-text", ("gpl-title", "v2-june-1991")),
    ("GPL-3.0-text", ("gpl-title", "v3-june-2007")),
    ("LGPL-2.0-text", ("lgpl2-title", "v2-june-1991")),
    ("LGPL-2.1-text", ("lgpl-title", "v2.1-february-1999")),
    ("LGPL-3.0-text", ("lgpl-title", "v3-june-2007")),
    ("AGPL-3.0-text", ("agpl-title", "v3-november-2007")),
    ("GFDL-1.2-text", ("gfdl-title", "v1.2-november-2002")),
    ("GFDL-1.3-text", ("gfdl-title", "v1.3-november-2008")),
    ("GPL-2.0-or-later", ("free-software", "gpl2-later", "hope-useful")),
    ("GPL-3.0-or-later", ("free-software", "gpl3-later", "hope-useful")),
    ("GPL-2.0-only", ("free-software", "gpl2-only", "hope-useful")),
    ("GPL-3.0-only", ("free-software", "gpl3-only", "hope-useful")),
    ("LGPL-2.0-or-later", ("free-software", "lgpl2-later", "hope-useful")),
    ("LGPL-2.1-or-later", ("free-software", "lgpl2.1-later", "hope-useful")),
    ("LGPL-3.0-or-later", ("free-software", "lgpl3-later", "hope-useful")),
    ("AGPL-3.0-or-later", ("free-software", "agpl3-later", "hope-useful")),
    ("AGPL-3.0-only", ("free-software", "agpl3-only", "hope-useful")),
    ("BSD-1-Clause", ("bsd-intro", "bsd-source")),
    ("BSD-2-Clause", ("bsd-intro", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-intro", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-3-Clause-Clear", ("bsd-intro", "bsd-source", "bsd-binary", "bsd-names", "bsd-patent")),
    ("BSD-4-Clause", ("bsd-intro", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names")),
    ("ISC", ("isc-grant",)),
    ("ISC-titled", ("isc-title", "isc-grant")),
    ("0BSD", ("0bsd-grant", "author-disclaims")),
    ("HPND", ("hpnd-grant",)),
    ("PostgreSQL", ("postgresql-grant",)),
    ("MPL-2.0", ("mpl2-form",)),
    ("MPL-2.0", ("mpl2-terms", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-form", "mpl2-copy")),
    ("MPL-2.0-text", ("mpl2-title",)),
    ("MPL-1.1", ("mpl1.1-contents", "not-except")),
    ("NPL-1.1", ("npl1.1-contents", "not-except")),
    ("EPL-1.0-text", ("epl1-title",)),
    ("EPL-2.0-text", ("epl2-title",)),
    ("EPL-1.0", ("epl1-terms",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("CDDL-1.0-text", ("cddl-title",)),
    ("CDDL-1.0", ("cddl-terms", "not-except")),
    ("CPL-1.0", ("cpl-title",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("CC0-1.0-text", ("cc-code", "cc0-title")),
    ("Zlib", ("zlib-as-is", "zlib-grant", "zlib-origin")),
    ("BSL-1.0", ("bsl-terms",)),
    ("BSL-1.0-text", ("bsl-title", "bsl-grant")),
    ("WTFPL", ("wtfpl-title", "wtfpl-copy")),
    ("Artistic-2.0", ("artistic2-title",)),
    ("OFL-1.1", ("ofl-terms",)),
    ("OFL-1.1-text", ("ofl-title",)),
    ("Python-2.0", ("psf-title",)),
    ("NCSA", ("ncsa-title", "mit0-grant")),
    ("NCSA", ("ncsa-title", "mit-grant")),
    ("EUPL-1.2", ("eupl-terms",)),
    ("Beerware", ("beerware-title",)),
    ("ZPL-2.1", ("zpl-title",)),
    ("MulanPSL-2.0", ("mulan-terms",)),
    ("UPL-1.0", ("upl-title",)),
    ("AFL-3.0", ("afl-terms",)),
    ("OSL-3.0", ("osl-terms",)),
    ("Vim", ("vim-title",)),
    ("OpenSSL", ("openssl-title",)),
    ("MS-PL", ("ms-pl-title",)),
    ("ODbL-1.0", ("odbl-title",)),
]
# Licences named in one-line notices, with the forms of their names.
NOTICES = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-clause BSD License"),
    "ISC": ("ISC License",),
    "MPL-2.0": ("Mozilla Public License 2.0",),
    "EPL-2.0": ("Eclipse Public License 2.0",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal license"),
    **{
        f"CC-BY{short}-4.0": (f"CC BY{short} 4.0", f"Creative Commons Attribution{long} 4.0 International License")
        for short, long in (("", ""), ("-SA", "-ShareAlike"), ("-NC", "-NonCommercial"), ("-ND", "-NoDerivatives"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives"))
    },
}
# Openings of one-line notices.
OPENINGS = ("Released under the", "Licensed under the", "Distributed under the", "Available under the", "This work is licensed under the", "This project is licensed under the", "This software is licensed under the", "This file is licensed under the")
# Licence identifiers that may follow an SPDX tag.
TAGS = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 "
    "CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only "
    "GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later "
    "LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby Sleepycat SSPL-1.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()
SPDX = "spdx-license-identifier"
#: Every known sentence has one of these.
SIGNS = ("licen", "permi", "copyright", "redistribut", "rights reserved", "warranty", "free software", "public domain", "software", "mpl", "version", "creative commons", "cc0", "used for good", "under ", "anyone is free")


def words_of(sentence: str) -> str:
    """Lower-case letters and digits in words parted by single blanks."""
    return " ".join(re.findall("[a-z0-9]+", sentence.lower()))


def _tables() -> tuple[dict[str, int], list[tuple[str, tuple[int, ...]]]]:
    """Identifiers (counted from 1) of the known sentences in words, and rules over them."""
    number, known, rules = {}, {}, []
    for name, forms in SENTENCES.items():
        number[name] = len(number) + 1
        for form in forms:
            known.setdefault(words_of(form), number[name])
    rules += [(name, tuple(number[s] for s in own)) for name, own in RULES]
    for name, forms in NOTICES.items():
        number[f"notice {name}"] = own = len(number) + 1
        for form in forms:
            for opening in OPENINGS:
                short = opening.removesuffix(" the")
                for told in (f"{opening} {form}", f"{short} {form}"):
                    known.setdefault(words_of(told), own)
            if form.startswith("Creative"):
                known.setdefault(words_of(f"This work is licensed under a {form}"), own)
        rules.append((f"{name}-notice", (own,)))
    for tag in TAGS:
        number[f"tag {tag}"] = known[words_of(f"{SPDX} {tag}")] = len(number) + 1
        rules.append((f"{tag}-tag", (number[f"tag {tag}"],)))
    return known, rules


KNOWN, NUMBERED_RULES = _tables()


def sentence_pattern() -> str:
    """A pattern for any known sentence between ends of lines; by first words, and of those that begin alike the longest first."""
    by_first: dict[str, list[str]] = {}
    for s in sorted(KNOWN, key=lambda s: (-len(s), s)):
        first, _, rest = s.partition(" ")
        by_first.setdefault(first, []).append(f" {rest}".rstrip().replace(" ", f" (?:{LINE_END} )*+"))
    return f"(?<={LINE_END} )(?:" + "|".join(f"{first}(?:{'|'.join(rests)})" for first, rests in sorted(by_first.items())) + f")(?= {LINE_END})"


def _part_of(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    rest = iter(b)
    return len(a) < len(b) and all(x in rest for x in a)


def rule_pattern(ids: tuple[int, ...], gap: int) -> str:
    """A pattern for the identifiers in order in a line of sentences; each sentence ends with a semicolon, unknown ones are empty."""
    return ";" + f";(?:[0-9]*;){{0,{gap}}}".join(map(str, ids)) + ";"


def _gap(name: str) -> int:
    return 0 if name.endswith("-text") else GAP


SENTENCE_END, LINE_END = "\x01", "\x02"
PUNCTUATION = r"[.!?;:]+([ \t\n\r\f\x0B]|\z)"
BLANK_LINE = r"\n[^a-z0-9\n]*\n"


def marked_text(text: Column) -> Column:
    """Words in lower case, with marks between sentences and between lines of a sentence. What follows an SPDX tag is of its sentence."""
    out = F.translate(ascii_lower(text), SENTENCE_END + LINE_END, "  ")
    out = F.replace(out, F.lit(f"{SPDX}:"), F.lit(f"{SPDX} "))
    out = F.regexp_replace(out, PUNCTUATION, f" {SENTENCE_END}$1")
    out = F.regexp_replace(out, BLANK_LINE, f" {SENTENCE_END} ")
    out = F.regexp_replace(out, r"[\n\r]+", f" {LINE_END} ")
    return F.regexp_replace(out, f"[^a-z0-9{SENTENCE_END}{LINE_END}]+", " ")


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = GAP) -> DataFrame:
    """doc_id, n_recognised, sentence_ids (in order, comma-joined) and licenses (names by rule order, comma-joined)."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    low = F.lower("text")
    signs = F.lit(False)
    for s in SIGNS:
        signs = signs | F.contains(low, F.lit(s))
    pattern = sentence_pattern()
    known = F.create_map(*[F.lit(x) for s, k in KNOWN.items() for x in (s, str(k))])
    plain = lambda found: F.element_at(known, F.regexp_replace(found, f" ({LINE_END} )+", " "))
    of_sentence = lambda s: F.array_join(F.transform(F.regexp_extract_all(F.concat(F.lit(f"{LINE_END} "), F.trim(s), F.lit(f" {LINE_END}")), F.lit(pattern), F.lit(0)), plain), ";")
    line = F.concat(F.lit(";"), F.array_join(F.transform(F.split(marked_text(F.col("text")), SENTENCE_END), of_sentence), ";"), F.lit(";"))
    rows = rows.select("doc_id", F.when(signs, line).otherwise(F.lit(";")).alias("line"))
    ids = F.filter(F.split("line", ";"), lambda x: x != "")
    matched = F.array_compact(F.array(*[F.when(F.rlike("line", F.lit(rule_pattern(own, min(gap, _gap(name))))), F.lit(k)) for k, (name, own) in enumerate(NUMBERED_RULES)]))
    matched = F.when(F.rlike("line", F.lit("[0-9]")), matched).otherwise(F.array().cast("array<int>"))
    rows = rows.select("doc_id", ids.alias("ids"), matched.alias("matched"))
    beaten = [[j for j, (_, b) in enumerate(NUMBERED_RULES) if _part_of(a, b)] for _, a in NUMBERED_RULES]
    longer = F.array(*[F.array(*map(F.lit, own)).cast("array<int>") for own in beaten])
    names = F.array(*[F.lit(name) for name, _ in NUMBERED_RULES])
    best = F.filter("matched", lambda k: ~F.arrays_overlap(F.element_at(longer, k + 1), F.col("matched")))
    licenses = F.array_distinct(F.transform(best, lambda k: F.element_at(names, k + 1)))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_recognised"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(licenses, ",").alias("licenses"))


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    """Known sentences are looked up among all runs of lines of every sentence, and rules by joining places; no pattern of either is used."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(s)}, {k})" for s, k in KNOWN.items())
    rules = ", ".join(f"({r}, {quoted(name)}, {n}, {k}, {_gap(name)}, {len(own)})" for r, (name, own) in enumerate(NUMBERED_RULES) for n, k in enumerate(own, 1))
    beats = ", ".join(f"({a}, {b})" for a, (_, x) in enumerate(NUMBERED_RULES) for b, (_, y) in enumerate(NUMBERED_RULES) if _part_of(x, y))
    longest = max(len(s.split()) for s in KNOWN)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    end, line = SENTENCE_END, LINE_END
    lower = f"replace(translate(coalesce(text, ''), '{upper}{end}{line}', '{upper.lower()}  '), '{SPDX}:', '{SPDX} ')"
    return rf"""
WITH RECURSIVE known(s, id) AS (VALUES {known}), rules(r, name, n, id, gap, size) AS (VALUES {rules}), beats(a, b) AS (VALUES {beats}),
  cut AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace({lower}, '[.!?;:]+([ \t\n\r\f\x0B]|\z)', ' {end}\1', 'g'),
            '\n[^a-z0-9\n]*\n', ' {end} ', 'g'), '[\n\r]+', ' {line} ', 'g'), '[^a-z0-9{end}{line}]+', ' ', 'g'), '{end}') AS parts FROM documents),
  sentences AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS k, unnest(parts) AS s FROM cut),
  lines AS (SELECT doc_id, k, list_filter([trim(x) FOR x IN string_split(s, '{line}')], lambda x: x <> '') AS l FROM sentences),
  begins AS (SELECT doc_id, k, l, unnest(range(1, len(l) + 1)) AS i FROM lines),
  runs AS (SELECT doc_id, k, l, i, unnest(range(i, least(i + {longest}, len(l) + 1))) AS j FROM begins),
  hits AS (SELECT doc_id, k, i, max(j) AS j, arg_max(id, j) AS id FROM runs JOIN known ON array_to_string(l[i:j], ' ') = known.s GROUP BY doc_id, k, i),
  found AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits g WHERE g.doc_id = h.doc_id AND g.k = h.k AND g.i < h.i AND g.j >= h.i)),
  slots AS (SELECT l.doc_id, l.k, f.i, f.id FROM lines l LEFT JOIN found f ON f.doc_id = l.doc_id AND f.k = l.k),
  placed AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) AS pos FROM slots),
  steps AS (SELECT p.doc_id, r.r, r.n, p.pos FROM placed p JOIN rules r ON r.id = p.id AND r.n = 1
      UNION SELECT s.doc_id, s.r, r.n, p.pos FROM steps s JOIN rules r ON r.r = s.r AND r.n = s.n + 1 JOIN placed p ON p.doc_id = s.doc_id AND p.id = r.id AND p.pos > s.pos AND p.pos <= s.pos + 1 + r.gap),
  matched AS (SELECT DISTINCT s.doc_id, s.r, r.name FROM steps s JOIN rules r ON r.r = s.r AND r.n = s.n WHERE s.n = r.size),
  best AS (SELECT doc_id, min(r) AS r, name FROM matched m WHERE NOT EXISTS (SELECT 1 FROM beats b JOIN matched o ON o.r = b.b WHERE b.a = m.r AND o.doc_id = m.doc_id) GROUP BY doc_id, name),
  told AS (SELECT doc_id, string_agg(name, ',' ORDER BY r) AS licenses FROM best GROUP BY doc_id),
  ids AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS ids FROM placed WHERE id IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, coalesce(i.n, 0) AS n_recognised, coalesce(i.ids, '') AS sentence_ids, coalesce(t.licenses, '') AS licenses
FROM documents d LEFT JOIN ids i ON i.doc_id = d.doc_id LEFT JOIN told t ON t.doc_id = d.doc_id
"""


QUERIES = {"op6_license_rules": op6_license_rules}
ORACLES = {"op6_license_rules": _oracle()}
