import re

import pytest

from firmweave.llm import licences
from tests.llm.samples import SF, awkward, none

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RULES = [(order, base, label, priority, confidence, re.compile(pattern))
         for order, base, label, _, priority, confidence, pattern in licences.rules()]
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def plain(text):
    """Base counts from word lists, labels from all rules without any prefilter."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    places, labels = [], set()
    for label, phrase in PHRASES.items():
        parts = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += own
        labels |= {label} if own else set()
    joined = f" {' '.join(words)} "
    found = []
    for order, base, label, priority, confidence, pattern in RULES:
        for m in pattern.finditer(joined):
            start = joined[: m.start()].count(" ") - 1
            found.append((priority, start, start + m.group().count(" ") + 1, order, base, label, confidence))
    kept = [
        d for d in found
        if d[4] or not any(
            e[1] <= d[1] and e[2] >= d[2] and (
                e[0] < d[0] or (e[0] == d[0] and (e[2] - e[1] > d[2] - d[1] or (e[1:3] == d[1:3] and e[3] < d[3]))))
            for e in found)
    ]
    every = labels | {d[5] for d in kept}
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(labels)), ",".join(sorted(every)), max((d[6] for d in kept), default=0.0),
    )


TEXTS = [
    "Released under the MIT License.\nwords", "under the\tmit--license under THE MIT license!",
    "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0 and cc-by-nc-sa 4.0, CC BY",
    "This work is licensed under the GNU General Public License, version 3.",
    "SPDX-License-Identifier: LGPL-2.1-or-later and GPLv3 or gpl v2", "BSD 3-Clause License; the 3-clause BSD license",
    "mit license mit licence MIT", "not a cc by ncx nor underthe mit license", "released under ISC; (0BSD)",
    "in the public domain. All rights reserved", "available under zlib", "MPL 2.0, EPL-1.0", "cc0 CC zero 1.0 universal",
    "wordé under the mit license", "éunder the mit license", "mozilla public license version 1.1", "ms-pl ms rl",
    "governed by the ruby license", "creative commons attribution-noncommercial-noderivs 3.0",
    "cc by nc " * 30, "apache license version 2 under the mit license apache license version 2",
]


def check(docs):
    want = {}
    for r in docs.select("doc_id", "text").collect():
        want.setdefault(r.doc_id, []).append(plain(r.text))
    got = licences.scan(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r[1:]) in want[r.doc_id], (r, want[r.doc_id])


# notices and first paragraphs as they stand in files, with the labels they must give
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\n of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("ncsa", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: * Redistributions of source code"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-0", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\""),
    ("bsd", "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:"),
    ("bsd-2", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY"),
    ("bsd-3", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n3. Neither the name of the copyright holder nor"),
    ("bsd-4", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. All advertising materials mentioning"),
    ("apache-2", "you may not use this file except in compliance with the License."),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software\n// distributed under the License is distributed on an \"AS IS\" BASIS,"),
    ("gpl-3", "it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2", "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or"),
    ("gpl-2", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("lgpl-2.1", "the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("lgpl-3", "the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl-2", "the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("agpl-3", "the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gfdl-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("epl-1", "All rights ... materials are made available under the terms of the Eclipse Public License v1.0"),
    ("cddl-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License (the"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("boost-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("artistic-2", "This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed."),
    ("artistic-1", "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control"),
    ("python-2", "1. This LICENSE AGREEMENT is between the Python Software Foundation (\"PSF\")"),
    ("php-3", "This source file is subject to version 3.01 of the PHP license,"),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("hpnd", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("ms-pl", "This license governs use of the accompanying software. If you use the software, you accept this license."),
    ("ofl-1.1", "The goals of the Open Font License (OFL) are to stimulate worldwide development of collaborative font projects"),
    ("cc0-1", "The person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by-sa", "You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License, by exercising the Licensed Rights"),
    ("json", "The Software shall be used for Good, not Evil."),
    ("openssl", "This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit"),
    ("beerware", "As long as you retain this notice you can do whatever you want with this stuff."),
    ("elastic-2", "You may not provide the software to third parties as a hosted or managed service,"),
    ("commons-clause", "The Software is provided to you by the Licensor under the License, as defined below, subject to the following condition."),
]
#: labels that a notice rightly gives beside its own: what it names in passing
BESIDE = {"unlicense": {"public-domain"}, "cc0-1": {"public-domain"}, "bsd-2": {"bsd"}, "bsd-3": {"bsd"}, "bsd-4": {"bsd"}}


def test_notices_and_first_paragraphs(spark):
    rows = [(k, f"some words first. {text} and words after", "a") for k, (_, text) in enumerate(NOTICES)]
    docs = awkward(spark, rows).where("n_chars IS NOT NULL")
    check(docs)
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for k, (label, text) in enumerate(NOTICES):
        labels = set(got[k].labels.split(","))
        assert label in labels and labels - {label} <= BESIDE.get(label, set()), (label, labels, text)
        assert got[k].n_base == 0 and got[k].score >= 0.9
    assert len({label for label, _ in NOTICES}) >= 35


def test_clean_texts_name_no_licence(spark):
    texts = ["permission was granted and hereby ends", "redistribution of land and binary stars", "stuff is hosted here, warranty void",
             "the software shall be used", "free of charge to any person", "dedicated to my parents"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.labels for r in licences.scan(docs).collect()} == {""}


def test_hundreds_of_ordered_rules():
    assert len(licences.BODIES) >= 60
    assert len(licences.rules()) >= 200
    assert {p for p, *_ in licences.TEMPLATES} == {0, 1, 2, 3, 4}


def test_awkward_texts(spark):
    check(awkward(spark, [(100 + k, t, "a") for k, t in enumerate(TEXTS)]))
    assert licences.scan(none(spark)).count() == 0


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_given_documents(spark, folder):
    check(spark.read.parquet(f"{folder}/documents.parquet"))
