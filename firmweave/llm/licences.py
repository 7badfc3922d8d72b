"""License scans by ordered signature rules (native DataFrame functions only).

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased.  A
rule is a regular expression over a text's words joined by single spaces.  The
rules are the base phrases; ``BODIES``, written by hand from the wording of licence texts
and of the notices that files bear; and for every name of ``LICENCES`` the forms of
``TEMPLATES`` from the surest (an SPDX tag) to the vaguest (its bare name), each with a
priority and a confidence.  Most texts name no licence: a keyword prefilter decides which texts
are normalised at all, and which licences' rules are tried on them.

A detection is an interval of words.  It is suppressed if one of higher priority
contains it, or one of equal priority that is longer or, for equal intervals,
comes first.  Base phrases are counted and labelled whatever suppresses them.

Detections leave their row as small rows (no text) and meet again by a row number
for the running sums and maxima that place and suppress them; a group is what one
text holds.

Defined cases: missing or empty text -> no words, labels ''; rows that repeat an
id are scanned one by one; a text of one very long word is one word; extra columns
do not matter; empty table -> no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SEPARATOR = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# label, SPDX words, keywords (parts of the joined words, one must occur), name, whether the name alone is telling
LICENCES = (
    ("mit", "mit", " mit | expat ", "(?:mit(?: x11)?|expat)", False),
    ("apache-2", "apache 2 0", "apache", "apache(?: software)?(?: licen[cs]e)?(?: version)? (?:v )?(?:2|v2)(?: 0)?", True),
    ("apache-1.1", "apache 1 1", "apache", "apache(?: software)?(?: licen[cs]e)?(?: version)? 1 1", True),
    ("apache-1.0", "apache 1 0", "apache", "apache(?: software)?(?: licen[cs]e)?(?: version)? 1 0", True),
    ("gpl-3", "gpl 3 0(?: only| or later)?", " gpl|general public", "(?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?v?3(?: 0)?", True),
    ("gpl-2", "gpl 2 0(?: only| or later)?", " gpl|general public", "(?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?v?2(?: 0)?", True),
    ("gpl-1", "gpl 1 0(?: only| or later)?", " gpl|general public", "(?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?v?1(?: 0)?", True),
    ("lgpl-3", "lgpl 3 0(?: only| or later)?", " lgpl|general public", "(?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: version| v)? ?v?3(?: 0)?", True),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", " lgpl|general public", "(?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: version| v)? ?v?2 1", True),
    ("lgpl-2", "lgpl 2 0(?: only| or later)?", " lgpl|general public", "(?:gnu )?(?:lgpl|library general public licen[cs]e)(?: version| v)? ?v?2(?: 0)?", True),
    ("agpl-3", "agpl 3 0(?: only| or later)?", " agpl|affero", "(?:gnu )?(?:agpl|affero general public licen[cs]e)(?: version| v)? ?v?3(?: 0)?", True),
    ("agpl-1", "agpl 1 0", " agpl|affero", "(?:gnu )?(?:agpl|affero general public licen[cs]e)(?: version| v)? ?v?1(?: 0)?", True),
    ("gfdl-1.3", "gfdl 1 3", "free documentation", "(?:gnu )?free documentation licen[cs]e(?: version)? 1 3", True),
    ("gfdl-1.2", "gfdl 1 2", "free documentation", "(?:gnu )?free documentation licen[cs]e(?: version)? 1 2", True),
    ("bsd-2", "bsd 2 clause", "bsd", "(?:(?:2|two) clause bsd|simplified bsd|freebsd|bsd 2 clause)", True),
    ("bsd-3", "bsd 3 clause", "bsd", "(?:(?:3|three) clause bsd|(?:new|modified|revised) bsd|bsd 3 clause)", True),
    ("bsd-4", "bsd 4 clause", "bsd", "(?:(?:4|four) clause bsd|original bsd|bsd 4 clause)", True),
    ("bsd-0", "0bsd", "bsd", "(?:0bsd|(?:0|zero) clause bsd)", True),
    ("bsd", "bsd", "bsd", "bsd(?: style)?", False),
    ("mpl-2", "mpl 2 0", " mpl|mozilla", "(?:mpl|mozilla public licen[cs]e)(?: version| v)? ?v?2(?: 0)?", True),
    ("mpl-1.1", "mpl 1 1", " mpl|mozilla", "(?:mpl|mozilla public licen[cs]e)(?: version| v)? ?v?1 1", True),
    ("mpl-1.0", "mpl 1 0", " mpl|mozilla", "(?:mpl|mozilla public licen[cs]e)(?: version| v)? ?v?1 0", True),
    ("epl-2", "epl 2 0", " epl|eclipse", "(?:epl|eclipse public licen[cs]e)(?: version| v)? ?v?2(?: 0)?", True),
    ("epl-1", "epl 1 0", " epl|eclipse", "(?:epl|eclipse public licen[cs]e)(?: version| v)? ?v?1(?: 0)?", True),
    ("cddl-1.1", "cddl 1 1", " cddl|common development", "(?:cddl|common development and distribution licen[cs]e)(?: version| v)? ?v?1 1", True),
    ("cddl-1.0", "cddl 1 0", " cddl|common development", "(?:cddl|common development and distribution licen[cs]e)(?: version| v)? ?v?1 0", True),
    ("eupl-1.2", "eupl 1 2", " eupl|european union", "(?:eupl|european union public licen[cs]e)(?: version| v)? ?v?1 2", True),
    ("eupl-1.1", "eupl 1 1", " eupl|european union", "(?:eupl|european union public licen[cs]e)(?: version| v)? ?v?1 1", True),
    ("isc", "isc", " isc ", "isc", False),
    ("zlib", "zlib", "zlib", "(?:zlib(?: libpng)?|libpng zlib)", False),
    ("libpng", "libpng", "libpng", "libpng", False),
    ("boost-1", "bsl 1 0", "boost", "boost software licen[cs]e(?: version)?(?: 1 0)?", True),
    ("busl-1.1", "busl 1 1", "business source", "business source licen[cs]e(?: version)?(?: 1 1)?", True),
    ("unlicense", "unlicense", "unlicense", "unlicense", True),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl", True),
    ("artistic-2", "artistic 2 0", "artistic", "artistic licen[cs]e(?: version)? 2(?: 0)?", True),
    ("artistic-1", "artistic 1 0", "artistic", "artistic licen[cs]e(?: version)? 1(?: 0)?", True),
    ("perl", "artistic 1 0 perl", "perl itself", "same terms as perl itself", True),
    ("python-2", "(?:python|psf) 2 0", "python software", "python software foundation licen[cs]e(?: version)?(?: 2)?", True),
    ("ruby", "ruby", " ruby ", "ruby", False),
    ("php-3", "php 3 01", " php ", "php licen[cs]e(?: version)?(?: 3 01| 3 0)?", True),
    ("openssl", "openssl", "openssl", "openssl", False),
    ("postgresql", "postgresql", "postgresql", "postgresql", False),
    ("ncsa", "ncsa", " ncsa ", "(?:university of illinois )?ncsa(?: open source)?", False),
    ("ms-pl", "ms pl", " ms pl |microsoft public", "(?:ms pl|microsoft public licen[cs]e)", True),
    ("ms-rl", "ms rl", " ms rl |reciprocal", "(?:ms rl|microsoft reciprocal licen[cs]e)", True),
    ("osl-3", "osl 3 0", "open software", "open software licen[cs]e(?: version)? ?v?3(?: 0)?", True),
    ("afl-3", "afl 3 0", "academic free", "academic free licen[cs]e(?: version)? ?v?3(?: 0)?", True),
    ("ofl-1.1", "ofl 1 1", "open font", "(?:sil )?open font licen[cs]e(?: version)?(?: 1 1)?", True),
    ("odbl-1", "odbl 1 0", " odbl|database", "(?:odbl|open(?: data commons open)? database licen[cs]e)(?: version| v)?(?: 1 0)?", True),
    ("odc-by-1", "odc by 1 0", " odc |data commons", "(?:odc by|open data commons attribution licen[cs]e)(?: v?1 0)?", True),
    ("pddl-1", "pddl 1 0", " pddl|domain dedication", "(?:pddl|open data commons public domain dedication)(?: and licen[cs]e)?", True),
    ("cc0-1", "cc0 1 0", " cc0 | cc zero ", "(?:creative commons )?(?:cc0|cc zero)(?: 1 0)?(?: universal)?", True),
    ("cc-by-nc-nd", "cc by nc nd [1-4] [05]", "cc by nc nd", "(?:creative commons )?cc by nc nd(?: [1-4] [05])?", True),
    ("cc-by-nc-sa", "cc by nc sa [1-4] [05]", "cc by nc sa", "(?:creative commons )?cc by nc sa(?: [1-4] [05])?", True),
    ("cc-by-nc", "cc by nc [1-4] [05]", "cc by nc", "(?:creative commons )?cc by nc(?: [1-4] [05])?", True),
    ("cc-by-nd", "cc by nd [1-4] [05]", "cc by nd", "(?:creative commons )?cc by nd(?: [1-4] [05])?", True),
    ("cc-by-sa", "cc by sa [1-4] [05]", "cc by sa", "(?:creative commons )?cc by sa(?: [1-4] [05])?", True),
    ("cc-by", "cc by [1-4] [05]", "cc by", "(?:creative commons )?cc by(?! nc| nd| sa)(?: [1-4] [05])?", True),
    ("cc-by-nc-nd", "cc by nc nd", "noderiv", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?", True),
    ("cc-by-nc-sa", "cc by nc sa", "commons attribution", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", True),
    ("cc-by-nc", "cc by nc", "commons attribution", "creative commons attribution non ?commercial(?: [1-4] [05])?", True),
    ("cc-by-sa", "cc by sa", "commons attribution", "creative commons attribution share ?alike(?: [1-4] [05])?", True),
    ("cc-by", "cc by", "commons attribution", "creative commons attribution(?: [1-4] [05])?", True),
    ("public-domain", "cc pddc", "public domain", "(?:in(?:to)?|to) the public domain", True),
    ("all-rights-reserved", "none", "rights reserved", "all rights reserved", True),
    ("proprietary", "licenseref proprietary", "proprietary", "proprietary(?: and confidential)?(?: software)?", False),
    ("bigscience-rail", "bigscience openrail m", " rail | openrail", "(?:bigscience )?(?:open ?)?rail(?: m)?", False),
)

GIVEN = "(?:licen[cs]ed|released|distributed|available|provided|published|offered|covered|redistributed)"
TERMS = "(?:the |a |an )?(?:terms (?:and conditions )?of (?:the )?)?"
# priority, confidence, pattern around {spdx} and {name}, whether the name alone must be telling
TEMPLATES = (
    (0, 1.0, "spdx licen[cs]e identifier {spdx}", False),
    (1, 0.95, GIVEN + " (?:under|by|with|according to) " + TERMS + "{name}(?: public)?(?: licen[cs]e)?", False),
    (2, 0.9, "(?:under|subject to|pursuant to|governed by) " + TERMS + "{name}(?: public)? licen[cs]e", False),
    (3, 0.8, "{name}(?: public| style)? licen[cs]e", False),
    (4, 0.6, "{name}", True),
)
BASE_PRIORITY, BASE_CONFIDENCE = 1, 0.95

# Wording of licence texts and of the notices that files bear, in joined words.
# label, keyword, pattern
BODIES = (
    ("mit", " hereby granted ", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("ncsa", " hereby granted ", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions redistributions"),
    ("json", " not evil ", "the software shall be used for good not evil"),
    ("isc", " hereby granted ", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("bsd-0", " hereby granted ", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", " hereby granted ", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("postgresql", " hereby granted ", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("boost-1", " hereby granted ", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2", "reproduce the above copyright", "in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided"),
    ("bsd-3", "reproduce the above copyright", "in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution (?:3 )?neither the names?"),
    ("bsd-4", "reproduce the above copyright", "in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution (?:3 )?all advertising materials"),
    ("apache-2", "in compliance with the license", "you may not use (?:this file|these files|this work|this software|this project) except in compliance with the license"),
    ("apache-2", "on an as is basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "terms and conditions for use", "apache license version 2 0 january 2004(?: https? www apache org licenses)? terms and conditions for use reproduction and distribution"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("openssl", "openssl project", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("gpl-3", "general public", "gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "general public", "gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-1", "general public", "gnu general public license as published by the free software foundation either version 1"),
    ("gpl-3", "general public", "gnu general public license version 3(?: only)? as published by the free software foundation"),
    ("gpl-2", "general public", "gnu general public license version 2(?: only)? as published by the free software foundation"),
    ("gpl-3", "copyleft license", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2", "general public", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license"),
    ("lgpl-3", "general public", "gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2.1", "general public", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-2", "general public", "gnu (?:library|lesser) general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl-3", "general public", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("lgpl-2.1", " lesser gpl ", "this is the first released version of the lesser gpl it also counts as the successor of the gnu library public license version 2"),
    ("agpl-3", "affero", "gnu affero general public license as published by the free software foundation(?: either)? version 3"),
    ("agpl-3", "affero", "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("gfdl-1.3", "free documentation", "modify this document under the terms of the gnu free documentation license version 1 3"),
    ("gfdl-1.2", "free documentation", "modify this document under the terms of the gnu free documentation license version 1 2"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "mozilla", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("epl-2", "eclipse", "materials are made available under the terms of the eclipse public license (?:v|version )? ?2 0"),
    ("epl-1", "eclipse", "materials are made available under the terms of the eclipse public license v ?1 0"),
    ("epl-2", "eclipse", "the accompanying program is provided under the terms of this eclipse public license"),
    ("cddl-1.0", "common development", "the contents of this file are subject to the terms of (?:either the gnu general public license version 2 only gpl or )?the common development and distribution license"),
    ("zlib", "held liable", "this software is provided as is without any express or implied warranty in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "verbatim", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("artistic-2", "free software package", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("artistic-1", "artistic control", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("python-2", "python software", "this license agreement is between the python software foundation"),
    ("php-3", "php license", "this source file is subject to version 3 (?:0|01|0 1) of the php license"),
    ("ms-pl", "accompanying software", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ofl-1.1", "open font", "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects"),
    ("odbl-1", "database", "the open database license odbl is a license agreement intended to allow users to freely share modify and use this database"),
    ("cc0-1", "dedicated the work", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", "licensed rights", "agree to be bound by the terms and conditions of this creative commons attribution 4 0 international public license"),
    ("cc-by-sa", "licensed rights", "agree to be bound by the terms and conditions of this creative commons attribution sharealike 4 0 international public license"),
    ("cc-by-nd", "licensed rights", "agree to be bound by the terms and conditions of this creative commons attribution noderivatives 4 0 international public license"),
    ("cc-by-nc", "licensed rights", "agree to be bound by the terms and conditions of this creative commons attribution noncommercial 4 0 international public license"),
    ("cc-by-nc-sa", "licensed rights", "agree to be bound by the terms and conditions of this creative commons attribution noncommercial sharealike 4 0 international public license"),
    ("cc-by-nc-nd", "licensed rights", "agree to be bound by the terms and conditions of this creative commons attribution noncommercial noderivatives 4 0 international public license"),
    ("busl-1.1", "non production", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2", "managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "licensor", "the software is provided to you by the licensor under the license as defined below subject to the following condition"),
    ("beerware", "retain this notice", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("cecill", "cecill", "this software is governed by the cecill(?: [abc])? license under french law"),
)
BODY_PRIORITY, BODY_CONFIDENCE = 1, 0.95


def rules() -> list[tuple[int, bool, str, str, int, float, str]]:
    """(order, base, label, keyword, priority, confidence, pattern) of every rule."""
    found = [
        (True, label, " " + phrase + " ", BASE_PRIORITY, BASE_CONFIDENCE, phrase)
        for label, phrase in BASE_PHRASES
    ]
    found += [
        (False, label, keyword, BODY_PRIORITY, BODY_CONFIDENCE, pattern) for label, keyword, pattern in BODIES
    ]
    for label, spdx, keyword, name, telling in LICENCES:
        for priority, confidence, pattern, needs in TEMPLATES:
            if needs and not telling:
                continue
            key = " spdx " if priority == 0 else keyword
            found.append((False, label, key, priority, confidence, pattern.format(spdx=spdx, name=name)))
    return [(k, *rule[:-1], f"(?<= )(?:{rule[-1]})(?= )") for k, rule in enumerate(found)]


def _gate(text: Column) -> Column:
    """True for every text that some rule could match.

    Phrases whose parts may be separated by anything are met by their rarest word.
    """
    low = F.lower(text)
    words = (
        "licen", "apache", "spdx", "gpl", "wtfpl", "eupl", "cddl", "odbl", "pddl", "cc0", "bsd",
        # a rare word of each body that needs none of these
        "hereby", "redistribution", "binary", "unencumbered", "openssl", "warranty", "evil",
        "semblance", "dedicated", "hosted", "stuff",
    )
    hit = F.contains(low, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(low, F.lit(word))
    loose = (
        r"(?i)cc[" + SEPARATOR + r"]+(?:by|zero)(?![^" + SEPARATOR + r"])"
        r"|(?<![^" + SEPARATOR + r"])(?:[me]pl|odc|commons|perl|ms)(?![^" + SEPARATOR + r"])"
        r"|(?<![^" + SEPARATOR + r"])(?:released|distributed|available|provided|published|offered"
        r"|covered|redistributed|governed)[" + SEPARATOR + r"]+(?:under|by|with|according)"
        r"|(?:subject|pursuant)[" + SEPARATOR + r"]+to"
        r"|public[" + SEPARATOR + r"]+domain|rights[" + SEPARATOR + r"]+reserved"
    )
    return hit | F.regexp_like(text, F.lit(loose))


def _spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def _rule_array() -> Column:
    return F.array(*[
        F.struct(
            F.lit(order).alias("order"), F.lit(base).alias("base"), F.lit(label).alias("label"),
            F.array(*[F.lit(k) for k in keyword.split("|")]).alias("keywords"), F.lit(priority).alias("priority"),
            F.lit(confidence).alias("confidence"), F.lit(pattern).alias("pattern"),
        )
        for order, base, label, keyword, priority, confidence, pattern in rules()
    ])


def detections(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, base, label, priority, confidence, start, end), and one
    row without a label for a text in which no rule found anything.

    ``start`` and ``end`` are words from 0, the end exclusive.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("doc_id"), text.alias("text")
    )
    between = f"[{SEPARATOR}]+"
    words = F.array_remove(F.split(F.translate("text", UPPER, LOWER), between), "")
    joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    counted = texts.select(
        "row", "doc_id",
        F.size(F.array_remove(F.split("text", between), "")).cast("long").alias("n_words"),
        F.when(_gate(F.col("text")), joined).alias("joined"),
    )
    joined = F.col("joined")
    tried = counted.select(
        "row", "doc_id", "n_words", "joined",
        F.explode_outer(
            F.when(
                joined.isNotNull(),
                F.filter(
                    _rule_array(),
                    lambda r: F.exists(r["keywords"], lambda k: F.contains(joined, k))
                    & F.regexp_like(joined, r["pattern"]),
                ),
            )
        ).alias("rule"),
    )
    pattern = F.col("rule.pattern")
    found = tried.select(
        "row", "doc_id", "n_words", "rule.order", "rule.base", "rule.label", "rule.priority",
        "rule.confidence",
        F.posexplode_outer(
            F.when(
                pattern.isNotNull(),
                F.arrays_zip(
                    F.transform(F.split(joined, pattern, -1), _spaces).alias("gap"),
                    F.transform(F.regexp_extract_all(joined, pattern, F.lit(0)), _spaces).alias("own"),
                ),
            )
        ).alias("place", "hit"),
    ).where("hit.own IS NOT NULL OR place IS NULL")
    # the rows of one text meet once; both windows and the last sums use that deal
    dealt = found.repartition("row")
    so_far = Window.partitionBy("row", "order").orderBy("place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    start = F.sum(F.col("hit.gap") + F.col("hit.own")).over(so_far) - F.col("hit.own") - 1
    return dealt.select(
        "row", "doc_id", "n_words", "order", "base", "priority", "confidence",
        F.when(F.col("hit.own").isNotNull(), F.col("label")).alias("label"),
        start.cast("long").alias("start"),
        (start + F.col("hit.own") + 1).cast("long").alias("end"),
    )


def surviving(found: DataFrame) -> DataFrame:
    """``found`` with the mark ``kept`` on detections that nothing suppresses."""
    by_start = Window.partitionBy("row").orderBy("start")
    upto = by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    in_level = (
        Window.partitionBy("row", "priority").orderBy("start", F.desc("end"), "order")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    levels = sorted({t[0] for t in TEMPLATES})
    held = F.lit(False)
    for level in levels[:-1]:
        reach = F.max(F.when(F.col("priority") == level, F.col("end"))).over(upto)
        held = held | ((F.col("priority") > level) & F.coalesce(reach >= F.col("end"), F.lit(False)))
    same = F.coalesce(F.max("end").over(in_level) >= F.col("end"), F.lit(False))
    return found.withColumn("kept", F.col("label").isNotNull() & ~held & ~same)


def _labels(condition: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score."""
    marked = surviving(detections(docs))
    base = F.col("base") & F.col("label").isNotNull()
    return marked.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        _labels(base).alias("base_labels"),
        _labels(base | F.col("kept")).alias("labels"),
        F.coalesce(F.max(F.when(base | F.col("kept"), F.col("confidence"))), F.lit(0.0)).alias("score"),
    ).drop("row")
