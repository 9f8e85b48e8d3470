"""Licence recognition by rules over sentences.

Each text is normalised: lower-case words of letters and digits, with a mark
where a sentence or line ends. Known sentences become identifiers; a licence is
found where the identifiers, in the order of the text, hold its rule's
identifiers as a subsequence.

Long sentences, those of licence texts, are found wherever their words stand one
after another, whatever line ends, comment signs and stops are between. Notices
("Released under the MIT License, see below.", "License: MIT", "Code is MIT
licensed.") count from a mark to a mark, those that grant under a licence also
to a comma, with line ends inside. An SPDX identifier line names all licences of
its expression (AND, OR, WITH, brackets, -only and -or-later forms). Where two
rules hold and one has all identifiers of the other, the longer one wins. All of
it is one projection of built-in functions, with sentences, notices and rules as
constants.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, unused

# Sentences of licence texts by identifier, as normalised() leaves them.
SENTENCES = {
    "afl": "licensed under the academic free license version 3 0",
    "agpl": "gnu affero general public license as published by the free software foundation either version 3",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-grant": "licensed under the apache license version 2 0 the license",
    "artistic": "you may distribute your modified version as source either gratis or for a distributor fee",
    "beerware": "as long as you retain this notice you can do whatever you want with this stuff",
    "boost": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-retain": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "cddl": "subject to the terms of the common development and distribution license",
    "ecl": "licensed under the educational community license version 2 0",
    "epl1": "made available under the terms of the eclipse public license v1 0",
    "epl2": "made available under the terms of the eclipse public license 2 0",
    "epl2-v": "made available under the terms of the eclipse public license v2 0",
    "eupl": "licensed under the eupl version 1 2",
    "gpl-warranty": "but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl2-plain": "gnu general public license version 2 as published by the free software foundation",
    "gpl2-version": "gnu general public license as published by the free software foundation either version 2",
    "gpl3-plain": "gnu general public license version 3 as published by the free software foundation",
    "gpl3-version": "gnu general public license as published by the free software foundation either version 3",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-notice": "provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl21-version": "gnu lesser general public license as published by the free software foundation either version 2 1",
    "lgpl3-version": "gnu lesser general public license as published by the free software foundation either version 3",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mpl1": "the contents of this file are subject to the mozilla public license version 1 1",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "ms-pl": "this license governs use of the accompanying software if you use the software you accept this license",
    "odbl": "this database is made available under the open database license",
    "ofl": "this font software is licensed under the sil open font license version 1 1",
    "osl": "licensed under the open software license version 3 0",
    "postgresql": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",
    "psf": "this license agreement is between the python software foundation",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "wtfpl": "do what the fuck you want to public license",
    "zlib": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
}
# Names by which notices tell a licence, by the licence.
NAMES = {
    "AGPL-3.0": ["gnu affero general public license version 3", "gnu agplv3", "agpl 3 0", "agplv3"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0"],
    "Artistic-2.0": ["artistic license 2 0", "artistic license version 2 0"],
    "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd"],
    "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international"],
    "CC-BY-3.0": ["cc by 3 0", "creative commons attribution 3 0 unported"],
    "CC-BY-SA-3.0": ["cc by sa 3 0", "creative commons attribution sharealike 3 0 unported"],
    "CC0-1.0": ["cc0 1 0", "cc0", "creative commons zero"],
    "EPL-2.0": ["eclipse public license 2 0", "eclipse public license version 2 0"],
    "GPL-2.0": ["gnu general public license version 2", "gnu gplv2", "gpl 2 0", "gplv2"],
    "GPL-3.0": ["gnu general public license version 3", "gnu gplv3", "gpl 3 0", "gplv3"],
    "ISC": ["isc"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "lgpl 2 1", "lgplv2 1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgpl 3 0", "lgplv3"],
    "MIT": ["mit"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "ODbL-1.0": ["open database license", "odbl 1 0"],
    "OFL-1.1": ["sil open font license version 1 1", "sil open font license"],
    "PostgreSQL": ["postgresql"],
    "Unlicense": ["unlicense"],
    "WTFPL": ["wtfpl"],
    "Zlib": ["zlib"],
}
# Notices that name a licence without granting under it.
PHRASES = {
    "mit license": "MIT", "the mit license": "MIT", "isc license": "ISC", "apache license version 2 0": "Apache-2.0", "bsd 3 clause license": "BSD-3-Clause", "bsd 2 clause license": "BSD-2-Clause",
    "this work is dedicated to the public domain under cc0 1 0": "CC0-1.0", "this work is in the public domain": "public-domain", "this file is in the public domain": "public-domain", "released into the public domain": "public-domain",
    "all rights reserved": "reserved",
}
#: Identifiers of notices: the licence they name.
NOTICES = {name: licence for licence, names in NAMES.items() for name in names} | PHRASES
_gap = r" (?:\| \| |~ )?"
_any = lambda options: "(?:" + "|".join(o.replace(" ", _gap) for o in options) + ")"
_subject = f"(?:{_any(['this', 'the', 'our'])}{_gap}{_any(['work', 'software', 'project', 'program', 'file', 'code', 'document', 'package', 'library', 'text', 'dataset', 'content'])}{_gap}{_any(['is', 'are'])}{_gap})?"
_verb = f"{_any(['licensed', 'released', 'distributed', 'published', 'provided', 'available', 'made available'])}{_gap}under{_gap}(?:{_any(['the terms of'])}{_gap})?(?:{_any(['the', 'a', 'an'])}{_gap})?"
_names = _any(sorted((n for names in NAMES.values() for n in names), key=lambda n: (-len(n), n)))
_form = f"(?:{_gap}{_any(['or later', 'only', 'or any later version'])})?"
_phrases = _any(sorted(PHRASES, key=lambda n: (-len(n), n)))
_things = _any(["code", "software", "project", "program", "library", "package", "work", "file", "source"])
#: What a notice looks like in a normalised text. One of GROUPS holds its licence's name, or one of PHRASES.
NOTICE = rf"[|~] (?:(?:{_subject}{_verb}|license{_gap})({_names}){_form}(?:{_gap}license)? [|~]|({_phrases}) \||(?:{_any(['this', 'the', 'our', 'all'])}{_gap})?{_things}{_gap}{_any(['is', 'are'])}{_gap}({_names}){_form}{_gap}licensed [|~])"
GROUPS = (1, 2, 3)
# Ordered rules, licence by identifiers that must follow one another.
RULES = [
    ("AFL-3.0", ["afl"]),
    ("AGPL-3.0", ["agpl"]),
    ("Apache-2.0", ["apache-grant"]),
    ("Apache-2.0", ["apache-comply", "apache-copy"]),
    ("Artistic-2.0", ["artistic"]),
    ("Beerware", ["beerware"]),
    ("BSL-1.0", ["boost"]),
    ("BSD-4-Clause", ["bsd-retain", "bsd-binary", "bsd-advertising"]),
    ("BSD-3-Clause", ["bsd-retain", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-retain", "bsd-binary"]),
    ("CDDL-1.0", ["cddl"]),
    ("ECL-2.0", ["ecl"]),
    ("EPL-1.0", ["epl1"]),
    ("EPL-2.0", ["epl2"]),
    ("EPL-2.0", ["epl2-v"]),
    ("EUPL-1.2", ["eupl"]),
    ("GPL-2.0", ["gpl2-version", "gpl-warranty"]),
    ("GPL-2.0", ["gpl2-plain"]),
    ("GPL-3.0", ["gpl3-version", "gpl-warranty"]),
    ("GPL-3.0", ["gpl3-plain"]),
    ("ISC", ["isc-grant", "isc-notice"]),
    ("LGPL-2.1", ["lgpl21-version", "gpl-warranty"]),
    ("LGPL-3.0", ["lgpl3-version", "gpl-warranty"]),
    ("MIT", ["mit-grant"]),
    ("MPL-1.1", ["mpl1"]),
    ("MPL-2.0", ["mpl2"]),
    ("MS-PL", ["ms-pl"]),
    ("ODbL-1.0", ["odbl"]),
    ("OFL-1.1", ["ofl"]),
    ("OSL-3.0", ["osl"]),
    ("PostgreSQL", ["postgresql"]),
    ("PSF", ["psf"]),
    ("Unlicense", ["unlicense"]),
    ("WTFPL", ["wtfpl"]),
    ("Zlib", ["zlib"]),
]
#: For each rule the rules that hold all its identifiers and more.
LONGER = [[other for _, other in RULES if set(other) > set(rule)] for _, rule in RULES]
# SPDX: each licence's own identifier, as normalised() leaves it.
SPDX_NAMES = {" ".join(re.findall("[a-z0-9]+", n.lower())): n for n in sorted({*NAMES, *(n for n, _ in RULES)})}
#: An identifier line in a normalised text: its expression is the group. JOINS part it, in a text of doubled blanks.
SPDX = r" spdx license identifier (?:\| \| )?([a-z0-9 ]+)"
JOINS = " (and|or|with|only|later) "
#: What a text of reserved rights without any licence has.
RESERVED = ("proprietary", "reserved")
# In a normalised text each word stands between two blanks, and each end of a sentence is two marks.
SENTENCE_END = r"\n+|[.!?;:][\x20\x09\x0B-\x0D]+"
#: What doesn't stand in a normalised text; a comma is a mark of its own.
NEITHER = "[^a-z0-9|~]+"
#: Words of which each known sentence and each notice has one, so that a text without them needs no normalising. They have no k, which other scripts' signs become in lower case.
HINTS = "spdx license licensed released distributed published provided available domain reserved permission redistributions advertising warranty misrepresented distributor notice".split()
#: Identifiers in a text whose sentences have been replaced by them.
IDENTIFIER = r"<([a-z0-9-]+)>"


def normalised(text: Column) -> Column:
    ends = F.replace(F.regexp_replace(F.lower(text), SENTENCE_END, " | | "), F.lit(","), F.lit(" ~ "))
    return F.regexp_replace(F.concat(F.lit(" | | "), ends, F.lit(" | | ")), NEITHER, " ")


def long_sentences() -> list[tuple[str, str]]:
    """Known sentences, longest first, with each word between two blanks, and their identifiers between signs that no word has."""
    ordered = sorted(SENTENCES.items(), key=lambda x: (-len(x[1]), x[0]))
    return [(" " + "  ".join(sentence.split()) + " ", f" <{name}> ") for name, sentence in ordered]


def scan(docs: DataFrame, ids: str = "sentence_ids", licenses: str = "licenses") -> DataFrame:
    """docs with the known sentences of its texts and the licences whose rules they satisfy, in two last columns.

    Sentences of licence texts come first, in the text's order, then the licences
    that notices name, in the text's order, then those of SPDX expressions. Licences are in the rules' order, then those of notices;
    reserved rights alone make a text proprietary, beside a licence they don't. A null or empty
    text has none. Equal rows get equal results; a null doc_id and columns of any
    other name are handed on, those of the results' names are replaced; an empty
    table gives an empty one. Texts of any length are read whole.
    """
    form = normalised(F.coalesce(F.col("text"), F.lit("")))

    def found(marked: Column) -> Column:
        whole = F.regexp_replace(F.regexp_replace(marked, "[|~]", " "), " +", "  ")
        for sentence, name in long_sentences():
            whole = F.replace(whole, F.lit(sentence), F.lit(name))
        sentences = F.regexp_extract_all(whole, F.lit(IDENTIFIER), F.lit(1))
        notices = F.regexp_extract_all(marked, F.lit(NOTICE), F.lit(0))
        named = lambda n: F.concat(*(F.regexp_extract(n, NOTICE, g) for g in GROUPS))
        bare = F.transform(notices, lambda n: F.regexp_replace(named(n), "[|~ ]+", " "))
        table = F.create_map(*(F.lit(x) for pair in NOTICES.items() for x in pair))
        expressions = F.transform(F.regexp_extract_all(marked, F.lit(SPDX), F.lit(1)), lambda e: F.replace(F.concat(F.lit(" "), e, F.lit(" ")), F.lit(" "), F.lit("  ")))
        pieces = F.flatten(F.transform(expressions, lambda e: F.split(F.regexp_replace(e, JOINS, "|"), r"\|")))
        known = F.create_map(*(F.lit(x) for pair in SPDX_NAMES.items() for x in pair))
        one = F.filter(F.transform(pieces, lambda n: F.element_at(known, F.btrim(F.replace(n, F.lit("  "), F.lit(" "))))), lambda n: n.isNotNull())
        return F.struct(sentences.alias("sentences"), F.concat(F.transform(bare, lambda n: F.element_at(table, n)), one).alias("notices"))

    def judged(x: Column) -> Column:
        def satisfied(rule: list[str]) -> Column:
            step = F.aggregate(x["sentences"], F.lit(0), lambda at, s: F.when(s == F.element_at(F.array(*map(F.lit, [*rule, ""])), at + 1), at + 1).otherwise(at))
            return step == len(rule)

        def chosen(rule: list[str], longer: list[list[str]]) -> Column:
            return reduce(lambda a, b: a & ~satisfied(b), longer, satisfied(rule))

        ruled = F.filter(F.array(*(F.when(chosen(rule, longer), F.lit(name)) for (name, rule), longer in zip(RULES, LONGER, strict=True))), lambda r: r.isNotNull())
        ruled = F.when(F.size(x["sentences"]) > 0, ruled).otherwise(F.array().cast("array<string>"))
        granted = F.array_distinct(F.concat(ruled, F.filter(x["notices"], lambda n: n != RESERVED[1])))
        reserved = F.when(F.array_contains(x["notices"], RESERVED[1]), F.array(F.lit(RESERVED[0]))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.concat(x["sentences"], x["notices"]).alias("ids"), F.when(F.size(granted) > 0, granted).otherwise(reserved).alias("licenses"))

    name = unused(docs.columns, "found")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (ids.lower(), licenses.lower())]
    nothing = F.array().cast("array<string>")
    hinted = F.col("text").rlike("(?i)" + "|".join(HINTS))
    judgement = docs.withColumn(name, F.when(hinted, let(let(form, found), judged)).otherwise(F.struct(nothing.alias("ids"), nothing.alias("licenses"))))
    return judgement.select(*kept, F.col(name)["ids"].alias(ids), F.col(name)["licenses"].alias(licenses))
