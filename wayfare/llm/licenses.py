"""Licence scan by sentence rules.

A text is cut into sentences, each is normalised, and known licence sentences are told by an equi-join with a
small constant table of sentence identifiers. Line ends cut too, but lines that may begin a known sentence are also
tried together with the lines after them, up to a sentence mark or a blank line: texts may be wrapped or commented. A document's identifiers, in the order of the text, are then held
against ordered rules: a rule names the identifiers that must follow one another (others may stand between).

Only DataFrame functions run here. Both constant tables are bounded by this module's text, so they are broadcast;
only documents' few known sentences are grouped.

Defined results: null or empty texts hold no licence and give no row; texts are taken whole at any length; a null id
is an id like any other; rows that repeat an id are told apart by their text, and equal rows give equal results once;
of rules of a licence that hold, the one with most sentences counts, then the one that begins first; a licence whose
rules are part of another's counts only where the other doesn't hold; an empty table
gives no rows; other columns are ignored. One row per document and licence.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

MIT_RIGHTS = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
GNU_TERMS = "you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation"
ISC_RIGHTS = "Permission to use, copy, modify, {}distribute this software for any purpose with or without fee is hereby granted"
#: Names of the Creative Commons licences, by code.
CREATIVE_COMMONS = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}


def gnu_terms(name: str, version: str) -> tuple[str, ...]:
    """The forms of a GNU grant that names a version in the same sentence."""
    terms = GNU_TERMS.format(name=name)
    ends = (f"either version {version} of the License, or (at your option) any later version", f"version {version}", f"version {version} of the License")
    return (*(f"{terms}, {end}" for end in ends), GNU_TERMS.format(name=f"{name} version {version}"))


def later_version(version: str) -> tuple[str, ...]:
    """The forms of a sentence of its own that names the version."""
    return (f"either version {version} of the License, or (at your option) any later version", f"either version {version}, or (at your option) any later version", f"version {version} of the License", f"version {version}")


#: Identifiers of licence sentences, and the forms in which each is written, up to its end mark.
SENTENCES = {
    "mit_release": ("Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License"),
    "mit_title": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "mit_grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", f"{MIT_RIGHTS}, subject to the following conditions"),
    "mit0_grant": (MIT_RIGHTS,),
    "mit_notice": (
        "The above copyright notice and this permission notice shall be included in all copies",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software",
    ),
    "apache_title": ("Apache License Version 2.0, January 2004",),
    "apache_release": (
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License")',
        'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License")',
        'This file is licensed to You under the Apache License, Version 2.0 (the "License")',
    ),
    "apache_terms": ("you may not use this file except in compliance with the License",),
    "apache_copy": ("You may obtain a copy of the License at", "You may obtain a copy of the License at http", "You may obtain a copy of the License at https"),
    "gpl3_title": ("GNU General Public License Version 3, 29 June 2007",),
    "gpl2_title": ("GNU General Public License Version 2, June 1991",),
    "lgpl21_title": ("GNU Lesser General Public License Version 2.1, February 1999",),
    "lgpl3_title": ("GNU Lesser General Public License Version 3, 29 June 2007",),
    "agpl3_title": ("GNU Affero General Public License Version 3, 19 November 2007",),
    "gpl3_release": ("This work is licensed under the GNU General Public License, version 3",),
    "gnu_free": ("This program is free software", "This library is free software", "This file is free software", "This is free software"),
    "gpl_terms": ("you can redistribute it and/or modify it under the terms of the GNU General Public License", GNU_TERMS.format(name="General Public License")),
    "gpl2_terms": gnu_terms("General Public License", "2"),
    "gpl3_terms": gnu_terms("General Public License", "3"),
    "lgpl_terms": (GNU_TERMS.format(name="Lesser General Public License"),),
    "lgpl21_terms": gnu_terms("Lesser General Public License", "2.1"),
    "lgpl3_terms": gnu_terms("Lesser General Public License", "3"),
    "agpl_terms": (GNU_TERMS.format(name="Affero General Public License"),),
    "agpl3_terms": gnu_terms("Affero General Public License", "3"),
    "version_2": later_version("2"),
    "version_21": later_version("2.1"),
    "version_3": later_version("3"),
    "mpl_title": ("Mozilla Public License Version 2.0",),
    # the full stop of "v." ends it
    "mpl_subject": ("This Source Code Form is subject to the terms of the Mozilla Public License, v", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    "mpl_copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at", "If a copy of the MPL was not distributed with this file, You can obtain one at http", "If a copy of the MPL was not distributed with this file, You can obtain one at https"),
    "epl1_title": ("Eclipse Public License - v 1.0",),
    "epl2_title": ("Eclipse Public License - v 2.0",),
    "epl1_available": tuple(f"This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0{end}" for end in ("", " which accompanies this distribution", " which accompanies this distribution, and is available at", " which accompanies this distribution, and is available at http", " which accompanies this distribution, and is available at https")),
    "epl2_available": tuple(f"This program and the accompanying materials are made available under the terms of the Eclipse Public License {v}{end}" for v in ("2.0", "v2.0") for end in ("", " which is available at", " which is available at http", " which is available at https", " which accompanies this distribution, and is available at https")),
    "boost_title": ("Boost Software License - Version 1.0 - August 17th, 2003",),
    "boost_release": ("Distributed under the Boost Software License, Version 1.0", "Use, modification and distribution are subject to the Boost Software License, Version 1.0"),
    "boost_grant": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',
    ),
    "isc_title": ("ISC License", "The ISC License"),
    "isc_grant": tuple(f"{ISC_RIGHTS.format(x)}, provided that the above copyright notice and this permission notice appear in all copies" for x in ("and/or ", "and ")),
    "zero_bsd_grant": tuple(ISC_RIGHTS.format(x) for x in ("and/or ", "and ")),
    "zlib_as_is": ("This software is provided 'as-is', without any express or implied warranty",),
    "zlib_grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
    "zlib_origin": ("The origin of this software must not be misrepresented", "1. The origin of this software must not be misrepresented"),
    "unlicense_release": ("This is free and unencumbered software released into the public domain",),
    "unlicense_grant": ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",),
    "cc0_release": ("Released under CC0 1.0", "CC0 1.0 Universal"),
    "bsd_grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "bsd_keep": (
        "Redistributions of source code must retain the above copyright notice",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    ),
    "bsd_advert": ("All advertising materials mentioning features or use of this software must display the following acknowledgement", "All advertising materials mentioning features or use of this software must display the following acknowledgment"),
    "bsd_names": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        # what is left after a name that ends in a full stop
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "rights_reserved": ("All rights reserved",),
} | {
    f"cc_{code}": (f"Licensed under CC {code} 4.0", *(f"This work is licensed under {a} Creative Commons {name} 4.0 International License" for a in ("a", "the")), f"Creative Commons {name} 4.0 International Public License")
    for code, name in CREATIVE_COMMONS.items()
}
#: Licences, and identifiers that must follow one another in a text. More parts make a surer match.
RULES = {
    "MIT": (("mit_release",), ("mit_title", "mit_grant"), ("mit_grant", "mit_notice")),
    "MIT-0": (("mit0_grant",),),
    "Apache-2.0": (("apache_title",), ("apache_release",), ("apache_release", "apache_terms"), ("apache_release", "apache_copy")),
    "GPL-2.0": (("gpl2_title",), ("gnu_free", "gpl2_terms"), ("gnu_free", "gpl_terms", "version_2")),
    "GPL-3.0": (("gpl3_title",), ("gpl3_release",), ("gnu_free", "gpl3_terms"), ("gnu_free", "gpl_terms", "version_3")),
    "GPL": (("gnu_free", "gpl_terms"),),
    "LGPL-2.1": (("lgpl21_title",), ("gnu_free", "lgpl21_terms"), ("gnu_free", "lgpl_terms", "version_21")),
    "LGPL-3.0": (("lgpl3_title",), ("gnu_free", "lgpl3_terms"), ("gnu_free", "lgpl_terms", "version_3")),
    "LGPL": (("gnu_free", "lgpl_terms"),),
    "AGPL-3.0": (("agpl3_title",), ("gnu_free", "agpl3_terms"), ("gnu_free", "agpl_terms", "version_3")),
    "MPL-2.0": (("mpl_title",), ("mpl_subject",), ("mpl_subject", "mpl_copy")),
    "EPL-1.0": (("epl1_title",), ("epl1_available",)),
    "EPL-2.0": (("epl2_title",), ("epl2_available",)),
    "BSL-1.0": (("boost_title",), ("boost_release",), ("boost_grant",), ("boost_title", "boost_grant")),
    "ISC": (("isc_grant",), ("isc_title", "isc_grant")),
    "0BSD": (("zero_bsd_grant",),),
    "Zlib": (("zlib_grant", "zlib_origin"), ("zlib_as_is", "zlib_grant", "zlib_origin")),
    "Unlicense": (("unlicense_release",), ("unlicense_release", "unlicense_grant")),
    "CC0-1.0": (("cc0_release",),),
    "BSD-4-Clause": (("bsd_grant", "bsd_keep", "bsd_advert"),),
    "BSD-3-Clause": (("bsd_grant", "bsd_keep", "bsd_names"),),
    "BSD-2-Clause": (("bsd_grant", "bsd_keep"),),
    "proprietary": (("rights_reserved",),),
} | {f"CC-{code}-4.0": ((f"cc_{code}",),) for code in CREATIVE_COMMONS}
#: Licences whose rules are part of others': they count only where none of those holds; "proprietary" only alone.
YIELDS = {"GPL": ("GPL-2.0", "GPL-3.0"), "LGPL": ("LGPL-2.1", "LGPL-3.0"), "BSD-3-Clause": ("BSD-4-Clause",), "proprietary": tuple(x for x in RULES if x != "proprietary")}
#: A line of identifiers; each name of a licence in it, by itself, is a sentence behind these words.
SPDX = "spdx license identifier"
NO_SPDX = ("GPL", "LGPL", "proprietary")
SPDX_ENDS = ("", "-only", "-or-later")
for _name in RULES:
    if _name not in NO_SPDX:
        SENTENCES[f"spdx_{_name}"] = tuple(f"{SPDX} {_name}{end}" for end in SPDX_ENDS)
        RULES[_name] = ((f"spdx_{_name}",), *RULES[_name])
#: Ends of sentences: line ends, semicolons and colons, and full stops that white space or the end follows.
SENTENCE_END = r"[\n;:!?]+|\.+(?=[\x20\x09-\x0D]|$)"
#: A line end alone, which may only wrap a sentence; a comment's marks may follow. The part after it begins with SOFT.
SOFT = "\x01"
LINE_END = r"(?<![\n;:!?])\n(?:[;!]+(?=[\x20\x09]))?(?![\n;:!?])"
#: Words before which a comment's line begins.
COMMENT_WORDS = r"^ ?(?:dnl|rem) "
#: What stands between the names of an identifier's line, once it is normalised.
SPDX_JOINTS = " (?:and|with|or(?! later)) "
#: A sentence of a named holder, and the form that stands for it in the table.
NAMED = (r"^neither the name of .+ nor the names of its contributors", "neither the name of the copyright holder nor the names of its contributors")


def normalized(sentence: Column) -> Column:
    """Lower case, with everything but ASCII letters and digits as single spaces."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "), COMMENT_WORDS, ""))


def plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def beginnings() -> str:
    """A pattern of parts that may begin a known sentence: they hold its first words, or end within them."""
    gap = "[^a-z0-9]"
    # an identifier stands in one line

    def from_word(found: list[str]) -> str:
        return found[0] + (f"(?:{gap}*$|{gap}+{from_word(found[1:])})" if len(found) > 1 else f"(?:{gap}|$)")

    heads = {tuple(plain(x).split()[:4]) for name, forms in SENTENCES.items() if not name.startswith("spdx_") for x in forms}
    return rf"^{gap}*(?:(?:dnl|rem){gap}+)?(?:{'|'.join(from_word(list(h)) for h in sorted(heads))})"


def known_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), pos and sentence_id of each known sentence.

    A known sentence is one part of the text, or parts that only line ends divide; a blank line ends a sentence.
    """
    spark = docs.sparkSession
    forms = [(name, plain(x)) for name, all_forms in SENTENCES.items() for x in all_forms]
    table = spark.createDataFrame(forms, "sentence_id string, sentence string")
    longest, most_words = max(len(x) for _, x in forms), max(len(x.split()) for _, x in forms)
    # what follows the colon of an identifier's line stays with it
    text = F.regexp_replace(text_or_empty(), r"(?i)SPDX-License-Identifier\s*:[\x20\t]*", "\nSPDX-License-Identifier ")
    parts = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("row"), F.split(F.regexp_replace(text, LINE_END, f"\n{SOFT}"), SENTENCE_END, -1).alias("parts"))

    def with_rest(part: Column, i: Column) -> Column:
        """The part and, where it may begin a wrapped sentence, as many of the next parts as a known sentence has words."""
        wrapped = F.coalesce(F.startswith(F.get("parts", i + 1), F.lit(SOFT)), F.lit(False)) & F.rlike(F.lower(part), F.lit(beginnings()))
        return F.struct(part.alias("part"), F.when(wrapped, F.slice("parts", i + 2, most_words)).alias("rest"))

    cut = parts.select("doc_id", "row", F.posexplode(F.transform("parts", with_rest)).alias("pos", "p")).select("doc_id", "row", "pos", "p.part", "p.rest")
    # a sentence can shrink by normalisation, but one of known length holds no more letters and digits than that
    near = cut.filter((F.char_length("part") >= 8) | F.col("rest").isNotNull()).select("doc_id", "row", "pos", normalized(F.col("part")).alias("sentence"), "rest")
    lines = F.transform("rest", lambda x: F.when(F.startswith(x, F.lit(SOFT)), normalized(x)).otherwise(""))
    upto = F.coalesce(F.array_position("lines", ""), F.lit(0))
    soft = F.when(upto > 0, F.slice("lines", F.lit(1), (upto - 1).cast("int"))).otherwise(F.coalesce("lines", F.array().cast("array<string>")))
    # the part alone, and with each number of lines after it
    runs = F.transform(F.sequence(F.lit(0), F.size("lines")), lambda n: F.concat_ws(" ", F.col("sentence"), F.slice("lines", F.lit(1), n)))
    joined = near.withColumn("lines", F.when(F.col("rest").isNotNull(), lines)).withColumn("lines", soft).withColumn("sentence", F.explode(F.when(F.size("lines") > 0, runs).otherwise(F.array("sentence"))))
    named = F.when(F.startswith("sentence", F.lit("neither the name of ")), F.regexp_replace("sentence", *map(F.lit, NAMED))).otherwise(F.col("sentence"))
    names = F.split(F.substring("sentence", F.lit(len(SPDX) + 2), F.char_length("sentence")), SPDX_JOINTS)
    each = F.when(F.startswith("sentence", F.lit(SPDX)), F.transform(names, lambda x: F.concat(F.lit(f"{SPDX} "), x))).otherwise(F.array("sentence"))
    short = joined.filter((F.char_length("sentence") <= longest) | F.startswith("sentence", F.lit(SPDX))).select("doc_id", "row", "pos", named.alias("sentence"))
    met = short.select("doc_id", "row", "pos", F.explode(each).alias("sentence"))
    return met.join(F.broadcast(table), "sentence").select("doc_id", "row", "pos", "sentence_id")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, license, n_sentences (in the fullest rule that holds), first_sentence (its position): one row per licence found."""
    spark = docs.sparkSession
    rules = spark.createDataFrame([(name, rule[0], list(rule)) for name, all_rules in RULES.items() for rule in all_rules], "license string, begins string, rule array<string>")
    per_doc = known_sentences(docs).groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("pos", "sentence_id"))).alias("seen"))
    known = F.explode(F.array_distinct(F.transform("seen", lambda x: x["sentence_id"])))
    first = per_doc.withColumn("begins", known).join(F.broadcast(rules), "begins")

    def follow(at: Column, want: Column) -> Column:
        """Position of the first wanted sentence after ``at``; null once one is missing."""
        later = F.filter("seen", lambda x: (x["pos"] > at) & (x["sentence_id"] == want))
        return F.when(at.isNotNull() & (F.size(later) > 0), later[0]["pos"])

    start = F.array_min(F.transform(F.filter("seen", lambda x: x["sentence_id"] == F.col("rule")[0]), lambda x: x["pos"]))
    held = first.withColumn("first_sentence", start).withColumn("end", F.aggregate(F.slice("rule", F.lit(2), F.size("rule")), F.col("first_sentence"), follow)).filter("end is not null")
    # a text of three clauses holds those of two: two alone are a grant that no clause on names follows before the next grant
    clauses = F.array_join(F.transform(F.filter("seen", lambda x: x["sentence_id"].isin("bsd_grant", "bsd_names", "bsd_advert")), lambda x: x["sentence_id"]), " ")
    held = held.filter((F.col("license") != "BSD-2-Clause") | F.rlike(clauses, F.lit("bsd_grant(?! bsd_names| bsd_advert)")))
    among = held.select("doc_id", "row", "license").groupBy(F.col("doc_id").alias("doc_id_"), F.col("row").alias("row_")).agg(F.collect_set("license").alias("all"))
    held = held.join(among, F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("row") == F.col("row_")))
    for name, others in YIELDS.items():
        held = held.filter((F.col("license") != name) | ~F.arrays_overlap("all", F.array(*map(F.lit, others))))
    best = held.groupBy("doc_id", "row", "license").agg(F.max(F.struct(F.size("rule").alias("n"), (-F.col("first_sentence")).alias("at"))).alias("best"))
    return best.select("doc_id", "license", F.col("best.n").cast("long").alias("n_sentences"), (-F.col("best.at")).cast("long").alias("first_sentence"))
