"""Licences as they are published: wrapped at 80 columns, with comment marks, in one line a paragraph."""

import random
import re

import __spark_entry__ as entry
import pytest
from wayfare.llm import licenses

from . import brute

MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
BSD2 = """Copyright (c) 2020, Jane Doe

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = (
    BSD2
    + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
)
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.
"""
GPL2_ONLY = GPL2.replace("; either version 2\nof the License, or (at your option) any later version.", "; version 2 of the License.")
LGPL21 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
"""
LGPL3 = GPL.replace("GNU General", "GNU Lesser General")
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU Affero General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
EPL2 = """Copyright (c) 2019 Some Foundation

This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/
"""
EPL1 = """Copyright (c) 2009 Some Corporation and others.
All rights reserved. This program and the accompanying materials
are made available under the terms of the Eclipse Public License v1.0
which accompanies this distribution, and is available at
http://www.eclipse.org/legal/epl-v10.html
"""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part.
"""
BOOST_NOTE = """Distributed under the Boost Software License, Version 1.0.
(See accompanying file LICENSE_1_0.txt or copy at
http://www.boost.org/LICENSE_1_0.txt)
"""
ISC = """ISC License

Copyright (c) 2004-2010 by Some Consortium

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE.
"""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
2. Altered source versions must be plainly marked as such.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
MIT0 = MIT.replace("MIT License", "MIT No Attribution").replace(", subject to the following conditions:", ".").replace("The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n", "")
BSD2_RESERVED = BSD2.replace("Jane Doe\n", "Jane Doe\nAll rights reserved.\n")
BSD4 = BSD2 + """
3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by the organization.

4. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE_BODY = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.

   2. Grant of Copyright License. Subject to the terms and conditions of
      this License, each Contributor hereby grants to You a perpetual,
      worldwide, non-exclusive, no-charge, royalty-free, irrevocable
      copyright license to reproduce, prepare Derivative Works of,
      publicly display, publicly perform, sublicense, and distribute the
      Work and such Derivative Works in Source or Object form.

   END OF TERMS AND CONDITIONS

   APPENDIX: How to apply the Apache License to your work.

""" + re.sub("(?m)^(?=.)", "   ", APACHE)
GPL3_BODY = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.

  13. Use with the GNU Affero General Public License.

  Notwithstanding any other provision of this License, you have
permission to link or combine any covered work with a work licensed
under version 3 of the GNU Affero General Public License into a single
combined work, and to convey the resulting work.

            How to Apply These Terms to Your New Programs

    <one line to give the program's name and a brief idea of what it does.>
    Copyright (C) <year>  <name of author>

""" + re.sub("(?m)^(?=.)", "    ", GPL) + """
The GNU General Public License does not permit incorporating your program
into proprietary programs.  If this is what you want to do, use the GNU Lesser General
Public License instead of this License.
"""
GPL2_BODY = """                    GNU GENERAL PUBLIC LICENSE
                       Version 2, June 1991

 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

  9. If the Program specifies a version number of this License which applies to it and "any
later version", you have the option of following the terms and conditions
either of that version or of any later version published by the Free
Software Foundation.

""" + re.sub("(?m)^(?=.)", "    ", GPL2)
LGPL21_BODY = "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n" + LGPL21
MPL_BODY = "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n\nExhibit A - Source Code Form License Notice\n\n" + re.sub("(?m)^(?=.)", "  ", MPL)
TEXTS = {
    "mit": (MIT, {"MIT"}),
    "mit0": (MIT0, {"MIT-0"}),
    "apache": (APACHE, {"Apache-2.0"}),
    "apache_body": (APACHE_BODY, {"Apache-2.0"}),
    "bsd2": (BSD2, {"BSD-2-Clause"}),
    "bsd2_reserved": (BSD2_RESERVED, {"BSD-2-Clause"}),
    "bsd3": (BSD3, {"BSD-3-Clause"}),
    "bsd_of_university": (BSD3.replace("the copyright holder", "the University of Somewhere"), {"BSD-3-Clause"}),
    "bsd_of_company": (BSD3.replace("the copyright holder", "Some Inc."), {"BSD-3-Clause"}),
    "bsd_both": (BSD3 + "\n" + BSD2, {"BSD-2-Clause", "BSD-3-Clause"}),
    "bsd4": (BSD4, {"BSD-4-Clause"}),
    "gpl3": (GPL, {"GPL-3.0"}),
    "gpl3_body": (GPL3_BODY, {"GPL-3.0"}),
    "gpl2": (GPL2, {"GPL-2.0"}),
    "gpl2_only": (GPL2_ONLY, {"GPL-2.0"}),
    "gpl2_body": (GPL2_BODY, {"GPL-2.0"}),
    "gpl_any": ("This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License.\n", {"GPL"}),
    "lgpl21": (LGPL21, {"LGPL-2.1"}),
    "lgpl21_body": (LGPL21_BODY, {"LGPL-2.1"}),
    "lgpl3": (LGPL3, {"LGPL-3.0"}),
    "agpl": (AGPL, {"AGPL-3.0"}),
    "mpl": (MPL, {"MPL-2.0"}),
    "mpl_body": (MPL_BODY, {"MPL-2.0"}),
    "epl1": (EPL1, {"EPL-1.0"}),
    "epl2": (EPL2, {"EPL-2.0"}),
    "boost": (BOOST, {"BSL-1.0"}),
    "boost_note": (BOOST_NOTE, {"BSL-1.0"}),
    "isc": (ISC, {"ISC"}),
    "isc_and": (ISC.replace("and/or", "and"), {"ISC"}),
    "zero_bsd": (ZERO_BSD, {"0BSD"}),
    "zlib": (ZLIB, {"Zlib"}),
    "unlicense": (UNLICENSE, {"Unlicense"}),
    "cc": ("This work is licensed under a Creative Commons\nAttribution-NonCommercial-ShareAlike 4.0 International License.\n", {"CC-BY-NC-SA-4.0"}),
    "reserved": ("Copyright 2020 Jane Doe. All rights reserved.\n", {"proprietary"}),
}
SPDX = {
    "// SPDX-License-Identifier: MIT": {"MIT"},
    "/* SPDX-License-Identifier: GPL-2.0-or-later */": {"GPL-2.0"},
    "# SPDX-License-Identifier: (MIT OR Apache-2.0)": {"MIT", "Apache-2.0"},
    "# spdx-license-identifier: LGPL-2.1+ AND BSD-3-Clause": {"LGPL-2.1", "BSD-3-Clause"},
    "x = 1 # SPDX-License-Identifier: GPL-3.0-only WITH Classpath-exception-2.0": {"GPL-3.0"},
    "SPDX-License-Identifier: 0BSD": {"0BSD"},
    "All rights reserved.\nSPDX-License-Identifier: MPL-2.0\nmore": {"MPL-2.0"},
    "SPDX-License-Identifier: LicenseRef-own\nnot MIT": set(),
    "The SPDX-License-Identifier is a line": set(),
}
FORMS = {
    "plain": lambda s: s,
    "lead": lambda s: "first line of a file\n" + s,
    "crlf": lambda s: s.replace("\n", "\r\n"),
    "block": lambda s: "/*\n" + re.sub("(?m)^", " * ", s) + "*/\nint x;",
    "hash": lambda s: re.sub("(?m)^", "# ", s),
    "slashes": lambda s: re.sub("(?m)^", "// ", s),
    "lisp": lambda s: re.sub("(?m)^", ";; ", s),
    "dnl": lambda s: re.sub("(?m)^", "dnl ", s),
    "unwrapped": lambda s: re.sub(r"(?<!\n)\n(?!\n)\s*", " ", s),
    "narrow": lambda s: re.sub(r"(?<=\w) +(?=\w)", "\n", s),
}


@pytest.fixture(scope="module")
def found(docs_of):
    names = [(t, f) for t in TEXTS for f in FORMS]
    got = {n: set() for n in names}
    for r in licenses.scan(docs_of([(i, FORMS[f](TEXTS[t][0])) for i, (t, f) in enumerate(names)])).collect():
        got[names[r["doc_id"]]].add(r["license"])
    return got


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("text", TEXTS)
def test_published_text(found, text, form):
    assert found[(text, form)] == TEXTS[text][1]


def test_mention_is_no_licence(docs_of):
    rows = [(1, "Permission is hereby granted\nto nobody at all.\n\nThis program is free\n\nsoftware"), (2, "a copy of this software and\nassociated documentation files")]
    assert licenses.scan(docs_of(rows)).collect() == []


def test_identifier_lines(docs_of):
    got = {i: set() for i in range(len(SPDX))}
    for r in licenses.scan(docs_of(list(enumerate(SPDX)))).collect():
        got[r["doc_id"]].add(r["license"])
    assert dict(zip(SPDX, got.values(), strict=True)) == SPDX


def test_every_rule_is_made_of_sentences():
    assert {x for rules in licenses.RULES.values() for rule in rules for x in rule} <= set(licenses.SENTENCES)
    forms = [licenses.plain(x) for forms in licenses.SENTENCES.values() for x in forms]
    assert len(forms) == len(set(forms))


def test_whole_table_with_notices(spark, data, documents, docs_of):
    """Against a plain form, on whole sf0.01 and on texts that hold one notice or two among other lines."""
    got = sorted(map(tuple, entry.queries()["op2_license_scan"](spark, f"{data}/sf0.01").collect()))
    assert got == sorted(brute.licences(documents.items()))
    assert len(got) > 20
    plain = [t for t in documents.values() if t][:200]
    names, rng = list(TEXTS), random.Random(4)
    docs = []
    for i in range(300):
        a, b = rng.choice(names), rng.choice(names)
        cut = rng.choice(plain)
        docs.append((i, "\n".join([cut[:300], FORMS[rng.choice(list(FORMS))](TEXTS[a][0]), cut[300:600], TEXTS[b][0] if i % 2 else ""])))
    assert sorted(map(tuple, licenses.scan(docs_of(docs)).collect())) == sorted(brute.licences(docs))
