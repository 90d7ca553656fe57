"""Licence statements by sentences and ordered rules.

Texts are cut to sentences and normalised. Sentences that a licence is known to consist of
get an identifier. Rules are sequences of identifiers: at each place the first rule whose
sequence is there, other text between its sentences allowed within a few sentences, names
a licence and uses its sentences up. Identifiers that no rule uses, and sentences that
only look like a licence, are counted as unknown.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelock.llm.buffers import slices

#: Sentences of other text that may stand between two sentences of one rule.
GAP = 3

#: Normalised sentences of public licences. Groups become part of the identifier.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("spdx:{}", r"\bspdx license identifier ([a-z0-9][a-z0-9.+ -]*[a-z0-9+])$"),
    ("apache-ref:{}", r"\b(?:licensed|released|distributed|available|provided) under (?:the terms of )?(?:the )?apache licen[sc]e,? version ([0-9.]+)"),
    ("apache-except", r"\byou may not use this file except in compliance with the licen[sc]e"),
    ("apache-copy", r"\byou may obtain a copy of the licen[sc]e at"),
    ("apache-as-is", r"\bunless required by applicable law or agreed to in writing,? software distributed under the licen[sc]e is distributed on an as is basis"),
    ("mit-ref", r"\b(?:licensed|released|distributed|available|provided) under (?:the terms of )?(?:the )?(?:mit|expat|x11)(?:/expat)? licen[sc]e\b"),
    ("mit-grant", r"\bpermission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice", r"\bthe above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is-software", r"\bthe software is provided as is,? without warranty of any kind"),
    ("isc-grant", r"\bpermission to use,? copy,? modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-as-is", r"\bthe software is provided as is and the author disclaims all warranties"),
    ("bsd-ref:{}", r"\b(?:licensed|released|distributed|available|provided) under (?:the terms of )?(?:the |a )?(?:(2|3|4) clause |(?:simplified |modified |new ))?bsd licen[sc]e\b"),
    ("bsd-grant", r"\bredistribution and use in source and binary forms,? with or without modification,? are permitted provided that the following conditions are met"),
    ("bsd-source", r"\bredistributions of source code must retain the above copyright notice"),
    ("bsd-binary", r"\bredistributions in binary form must reproduce the above copyright notice"),
    ("bsd-names", r"\b(?:neither the name of .{1,120} nor the names of its contributors|the names? of .{1,80}) may (?:not )?be used to endorse or promote products"),
    ("bsd-as-is", r"\bthis software is provided by .{1,120} as is and any express or implied warranties"),
    ("gpl-ref:{}:{}", r"\b(?:licensed|released|distributed|available|provided|covered) under (?:the terms of )?(?:the )?(?:gnu )?((?:lesser |affero |library )?)general public licen[sc]e,?(?: as published by the free software foundation)?[;,]?(?: either)?(?: version|,? v)? ?([0-9][0-9.]*)?"),
    ("gpl-redistribute:{}:{}", r"\byou can redistribute it and/or modify it under the terms of the gnu ((?:lesser |affero |library )?)general public licen[sc]e as published by the free software foundation[;,]? (?:either )?version ([0-9.]+)"),
    ("gpl-hope", r"\bdistributed in the hope that it will be useful,? but without any warranty"),
    ("gpl-copy", r"\byou should have received a copy of the gnu (?:lesser |affero |library )?general public licen[sc]e"),
    ("mpl-ref:{}", r"\bsubject to the terms of the mozilla public licen[sc]e,? (?:v|version) ?([0-9.]+)"),
    ("mpl-ref:{}", r"\b(?:licensed|released|distributed|available|provided) under (?:the terms of )?(?:the )?mozilla public licen[sc]e,? (?:v|version) ?([0-9.]+)"),
    ("cc-ref:{}:{}", r"\b(?:licensed|released|distributed|available|provided) under (?:the terms of )?(?:the |a )?(?:creative commons|cc)[ -](by(?:[ -](?:nc|sa|nd))*)[ -]([0-9.]+)"),
    ("cc0-ref", r"\b(?:licensed|released|dedicated|available|provided) (?:under|to) (?:the )?(?:cc0|creative commons zero)"),
    ("public-domain", r"\b(?:released|placed|dedicated) (?:in|into|to) the public domain\b"),
    ("unlicense-free", r"\bthis is free and unencumbered software released into the public domain"),
    ("all-rights", r"\ball rights reserved$"),
)

#: Rules by precedence, longer statements before the references they contain.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("{}", ("spdx:{}",)),
    ("Unlicense", ("unlicense-free",)),
    ("Apache-{}", ("apache-ref:{}", "apache-except", "apache-copy", "apache-as-is")),
    ("Apache-{}", ("apache-ref:{}",)),
    ("MIT", ("mit-grant", "mit-notice", "as-is-software")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-ref",)),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-{}-Clause", ("bsd-ref:{}",)),
    ("{}GPL-{}-or-later", ("gpl-redistribute:{}:{}", "gpl-hope", "gpl-copy")),
    ("{}GPL-{}-or-later", ("gpl-redistribute:{}:{}",)),
    ("{}GPL-{}", ("gpl-ref:{}:{}", "gpl-hope", "gpl-copy")),
    ("{}GPL-{}", ("gpl-ref:{}:{}",)),
    ("MPL-{}", ("mpl-ref:{}",)),
    ("CC-{}-{}", ("cc-ref:{}:{}",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("Public-Domain", ("public-domain",)),
)

_KNOWN = [(name, re.compile(pattern)) for name, pattern in SENTENCES]
#: Every pattern of SENTENCES and _LIKELY needs one of these, or ``cc`` as the
#: start of a word. Parts of single words, since line ends and marks stand between words.
_HINTS = ("licens", "licenc", "spdx", "permission", "redistribut", "warrant", "endorse", "creative", "domain", "reserved")
_CC = re.compile(r"(?<![a-z0-9])cc(?![a-z])")
_LIKELY = re.compile(r"\blicen[sc]ed? under\b|\bunder the .{0,60}licen[sc]e\b|\bpermission is (?:hereby )?granted\b|\bspdx\b")
_ENDS = re.compile(r"(?<=[.!?;])\s+|\n+")
_DROP = re.compile(r"[\"'`“”‘’()<>*#_=|\[\]{}]|//+|--+")
_SPACE = re.compile(r"\s+")
_VARIANT = {"": "", "lesser": "L", "library": "L", "affero": "A"}


def hinted(text: str) -> bool:
    plain = text.lower()
    return any(hint in plain for hint in _HINTS) or _CC.search(plain) is not None


def normalise(sentence: str) -> str:
    plain = _SPACE.sub(" ", _DROP.sub(" ", sentence.lower())).replace("spdx-license-identifier:", "spdx license identifier")
    return plain.strip(" .,;:!?-")


def sentences(text: str) -> list[str]:
    """Normalised sentences and lines, without empty ones."""
    return [part for part in (normalise(piece) for piece in _ENDS.split(text)) if part]


def identify_sentence(sentence: str) -> str | None:
    for name, pattern in _KNOWN:
        if found := pattern.search(sentence):
            groups = [(group or "").strip().rstrip(".") for group in found.groups()]
            return name.format(*groups) if groups else name
    return None


def _wrapped(text: str) -> Iterator[str | None]:
    """Identifiers of the sentences in order, None for others.

    A line is taken alone if it is known, else with up to five lines after it.
    """
    lines = sentences(text)
    at = 0
    while at < len(lines):
        name, used = identify_sentence(lines[at]) if hinted(lines[at]) or len(lines[at]) < 120 else None, 1
        if name is None:
            joined = lines[at]
            for extra in range(1, 6):
                if at + extra >= len(lines) or len(joined) > 600:
                    break
                joined = f"{joined} {lines[at + extra]}"
                found = hinted(joined) and identify_sentence(joined)
                if found and identify_sentence(lines[at + extra]) is None:
                    name, used = found, extra + 1
                    break
                if found:
                    break
        yield name if name else ("?" if _LIKELY.search(lines[at]) else None)
        at += used


def _matches(rule: tuple[str, ...], names: list[str | None], at: int) -> tuple[list[str], list[int]] | None:
    values: list[str] = []
    places: list[int] = []
    for part in rule:
        stop = at + 1 if not places else min(len(names), places[-1] + 2 + GAP)
        for place in range(at if not places else places[-1] + 1, stop):
            name = names[place]
            if name is not None and name.split(":")[0] == part.split(":")[0]:
                values += name.split(":")[1:]
                places.append(place)
                break
        else:
            return None
    return values, places


def find_licenses(text: str) -> tuple[list[str], list[str], int]:
    """Licences in order of place, the identifiers of all known sentences, number of unknown ones."""
    if not hinted(text):
        return [], [], 0
    names = list(_wrapped(text))
    found, unknown, used = [], 0, set()
    for at, name in enumerate(names):
        if name is None or at in used:
            continue
        for license_name, rule in RULES:
            if match := _matches(rule, names, at):
                values, places = match
                used.update(places)
                found.append(_named(license_name, values))
                break
        else:
            unknown += name not in ("all-rights",)
    return found, [name for name in names if name not in (None, "?")], unknown


def _named(license_name: str, values: list[str]) -> str:
    if "GPL" in license_name:
        variant, version = values[:2]
        version = f"{version}.0" if version and "." not in version else version
        return license_name.format(_VARIANT.get(variant, ""), version).rstrip("-")
    if license_name.startswith("CC-"):
        return license_name.format(values[0].upper().replace(" ", "-"), values[1])
    if license_name.startswith("BSD-{}"):
        return license_name.format(values[0] or "3")
    if license_name == "{}":
        return values[0].replace(" ", "-").upper()
    return license_name.format(*values)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``licenses``, ``sentences`` (identifiers), ``n_unknown``.

    Licences are in order of place and can repeat. NULL and empty texts have none. Other
    columns are ignored.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                rows = [find_licenses(value or "") for value in part.column(1).to_pylist()]
                lists = [pa.array([row[i] for row in rows], pa.list_(pa.string())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *lists, pa.array([row[2] for row in rows], pa.int64())],
                    names=["key", "licenses", "sentences", "n_unknown"],
                )

    return source.mapInArrow(
        run, f"key {kind}, licenses array<string>, sentences array<string>, n_unknown bigint"
    ).withColumnRenamed("key", key)
