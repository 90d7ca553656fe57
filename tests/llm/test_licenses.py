import re

from quotelock.llm import licenses
from quotelock.llm.licenses import find_licenses, scan
from quotelock.llm.queries import op8

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND."""

CASES = {
    "": [],
    "A permission and a license of no kind.": [],
    MIT: ["MIT"],
    "# SPDX-License-Identifier: GPL-2.0-only\nint x;": ["GPL-2.0-ONLY"],
    "Intro.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.": ["MIT", "CC-BY-NC-4.0"],
    "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"],
    "Licensed under the Apache License, Version 2.0 (the 'License');\nyou may not use this file except in compliance "
    "with the License.\nYou may obtain a copy of the License at\nhttp://x": ["Apache-2.0"],
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
    "by the Free Software Foundation, either version 2.1 of the License": ["LGPL-2.1-or-later"],
}


def test_statements():
    for text, licenses in CASES.items():
        assert find_licenses(text)[0] == licenses, text


def test_sentences_without_a_rule_are_unknown():
    assert find_licenses("It is licensed under the Foo Bar licence.") == ([], [], 1)
    assert find_licenses("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.")[2] == 1


def test_odd_rows(odd_docs, no_docs):
    rows = scan(odd_docs).collect()
    assert len(rows) == 10 and not any(row["licenses"] for row in rows)
    assert scan(no_docs).count() == 0


def test_query_finds_the_lines_in_the_table(spark, folder):
    lines = {
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "MIT": "Released under the MIT License.",
        "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
        "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    }
    texts = {row["doc_id"]: row["text"] or "" for row in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for row in op8.build(spark, folder).collect():
        text = texts[row["doc_id"]]
        want = {name for name, line in lines.items() if re.search(rf"(?m)^{re.escape(line)}$", text)}
        assert set(filter(None, row["licenses"].split(","))) == want


#: One text for each pattern of SENTENCES, in their order, with nothing else in it.
STATEMENTS = (
    "SPDX-License-Identifier: MIT",
    "Provided under the Apache License, Version 2.0",
    "You may not use this file except in compliance with the License",
    "You may obtain a copy of the License at",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
    "on an AS IS basis",
    "Released under the MIT License",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software",
    "The software is provided as is, without warranty of any kind",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
    "The software is provided as is and the author disclaims all warranties",
    "Licensed under the 3 clause BSD license",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met",
    "Redistributions of source code must retain the above copyright notice",
    "Redistributions in binary form must reproduce the above copyright notice",
    "The name of Example Labs may not be used to endorse or promote products",
    "This software is provided by the authors as is and any express or implied warranties",
    "Covered under the GNU General Public License, version 3",
    "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
    "Software Foundation, either version 2",
    "Distributed in the hope that it will be useful, but without any warranty",
    "You should have received a copy of the GNU General Public License",
    "Subject to the terms of the Mozilla Public License, v 2.0",
    "Available under the Mozilla Public License, version 2.0",
    "This article is available under CC BY-SA 4.0.",
    "Released under CC0 1.0.",
    "Placed in the public domain",
    "This is free and unencumbered software released into the public domain",
    "All rights reserved",
)


def test_every_sentence_is_found_alone():
    assert len(STATEMENTS) == len(licenses.SENTENCES)
    for text, (name, pattern) in zip(STATEMENTS, licenses.SENTENCES, strict=True):
        assert re.search(pattern, licenses.normalise(text)), name
        for shape in (text, text.upper(), text.replace(" ", "\n"), text.replace(" ", " * ")):
            assert licenses.hinted(shape), shape
        assert len(find_licenses(text)[1]) == 1, name


def test_references_without_the_word_licence():
    assert find_licenses("This article is available under CC BY-SA 4.0.")[0] == ["CC-BY-SA-4.0"]
    assert find_licenses("Provided under Creative Commons BY 4.0")[0] == ["CC-BY-4.0"]
    assert find_licenses("Dedicated to Creative Commons Zero.")[0] == ["CC0-1.0"]
    assert find_licenses("Placed in the public\ndomain by its authors.")[0] == ["Public-Domain"]
