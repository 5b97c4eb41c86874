"""Licence scanning by sentence rules.

Texts are cut into sentences, which may run over several lines; their lines are normalised
(lower case, marks and runs of space to one space, so that comment marks go) and whole lines
are mapped to the identifier of a known licence sentence, if they are one. The
sequence of a document's identifiers is then matched against ordered rules, the most
specific first; a rule takes the identifiers that it matches, so that later rules see what
is left (the approach of German, Manabe and Inoue, 2010). Sentences that are known but
taken by no rule are reported as UNKNOWN, except copyright lines.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismgrid.llm import textvec as tv
from prismgrid.llm.common import texts_of

# Known licence sentences, as patterns over whole lines of normalised sentences. The first that fits gives the identifier.
# A space is also a line end, but not after .*, which stays on its line; (?s:...) goes over lines. _SUBJECT is what is licensed.
_SUBJECT = r"(?:(?:.* )?(?:is|are) )?"
# What may stand before a sentence that is known by its beginning, where a text has been put on one line.
_AFTER = r"(?:.* )?"
_GNU = r"gnu (?P<family{0}>lesser |library |affero )?general public license"
SENTENCES = (
    ("spdx", r"(?:.* )?spdx license identifier (?P<spdx>[a-z0-9. +]+)"),
    ("apache2", _SUBJECT + r"(?:licensed|released|distributed) under (?:the )?(?:terms of the )?apache license,? version 2(?:\.0)?(?: the license)?"),
    ("apache_limits", r"you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache_title", r"apache license version 2\.0 january 2004"),
    ("apache_asis", _AFTER + r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("mit", _SUBJECT + r"(?:licensed|released|distributed) under (?:the )?(?:terms of the )?mit license"),
    ("mit_grant", _AFTER + r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.*"),
    ("mit_notice", _AFTER + r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc_grant", _AFTER + r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("asis", _AFTER + r"the software is provided as is(?: without warranty of any kind)?.*"),
    ("bsd_grant", _AFTER + r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd_source", r"(?:\d )?redistributions of source code must retain the above copyright notice.*"),
    ("bsd_binary", r"(?:\d )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd_endorse", r"(?:\d )?neither the name of (?s:.*?) may be used to endorse or promote products.*"),
    ("bsd", _SUBJECT + r"(?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?P<bsd>[23]) clause bsd license"),
    ("gpl", _SUBJECT + r"(?:licensed|released|distributed) under (?:the )?(?:terms of the )?gnu general public license,? version (?P<gpl>[23])(?:\.0)?(?P<gplplus> or(?: any)? later(?: version)?)?"),
    ("lgpl", _SUBJECT + r"(?:licensed|released|distributed) under (?:the )?(?:terms of the )?gnu lesser general public license,? version (?P<lgpl>2\.1|3)(?:\.0)?"),
    ("agpl", _SUBJECT + r"(?:licensed|released|distributed) under (?:the )?(?:terms of the )?gnu affero general public license,? version 3(?:\.0)?"),
    ("gnu_header", _AFTER + r"under the terms of the " + _GNU.format(1) + r" as published by the free software foundation (?:either )?version (?P<version1>\d(?:\.\d)?)(?: of the license)?(?P<plus1> or at your option any later version)?"),
    ("gnu_terms", _AFTER + r"under the terms of the " + _GNU.format(2) + r" as published by the free software foundation"),
    ("gnu_version", r"(?:either )?version (?P<version2>\d(?:\.\d)?) of the license(?P<plus2> or at your option any later version)?"),
    ("gnu_title", _GNU.format(3) + r" version (?P<version3>\d(?:\.\d)?) \d{1,2} \w+ \d{4}"),
    ("or_later", r"or at your option any later version"),
    ("mpl_title", r"mozilla public license version 2\.0"),
    ("mpl", _AFTER + r"this source code form is subject to the terms of the mozilla public license v 2\.0"),
    ("cc", _SUBJECT + r"(?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:a )?(?:cc|creative commons) (?:(?P<cc>by(?: nc| nd| sa)*|0)|attribution(?P<ccnc> non ?commercial)?(?P<ccnd> no ?deriv(?:ative)?s)?(?P<ccsa> share ?alike)?)(?: (?P<ccv>\d\.\d))?(?: international| unported)?(?: public)?(?: license)?"),
    ("public_domain", r"(?:(?:.* )?(?:is|are) |released into |dedicated to )(?:in )?the public domain"),
    ("reserved", r"(?:copyright .* )?all rights reserved"),
    ("copyright", r"copyright (?:c )?\d{4}.*"),
    ("any_licence", _SUBJECT + r"(?:licensed|released|distributed) under (?s:.*?)(?:licen[sc]e|cc by).*"),
)
# Ordered rules, (licence, identifiers in order). A name in braces is what the sentence's pattern took.
RULES = (
    ("{spdx}", ("spdx",)),
    ("Apache-2.0", ("apache2", "apache_limits", "apache_asis")),
    ("Apache-2.0", ("apache2",)),
    ("MIT", ("mit_grant", "mit_notice", "asis")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("MIT", ("mit",)),
    ("ISC", ("isc_grant", "asis")),
    ("ISC", ("isc_grant",)),
    ("BSD-3-Clause", ("reserved", "bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("reserved", "bsd_grant", "bsd_source", "bsd_binary")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("BSD-{bsd}-Clause", ("bsd",)),
    ("GPL-{gpl}.0-or-later", ("gpl", "or_later")),
    ("GPL-{gpl}.0{gplplus}", ("gpl",)),
    ("LGPL-{lgpl}", ("lgpl",)),
    ("AGPL-3.0", ("agpl",)),
    ("{gnu}", ("gnu_header",)),
    ("{gnu}", ("gnu_terms", "gnu_version")),
    ("{gnu}", ("gnu_title",)),
    ("Apache-2.0", ("apache_title",)),
    ("MPL-2.0", ("mpl",)),
    ("MPL-2.0", ("mpl_title",)),
    ("CC-{cc}{ccv}", ("cc",)),
    ("Public-Domain", ("public_domain",)),
    ("Proprietary", ("reserved",)),
)
# Fixed value: every known sentence has one of these.
HINT = r"(?i)licen[sc]|copyright|permission|rights[\W_]+reserved|redistribution|public[\W_]+domain|as[\W_]+is|may[\W_]+not[\W_]+use[\W_]+this|neither[\W_]+the[\W_]+name|later[\W_]+version|spdx|cc[\W_]+(?:by|0)|creative[\W_]+commons"
# The GNU licences by what stands before "general public license".
_FAMILY = {"": "GPL", "lesser": "LGPL", "library": "LGPL", "affero": "AGPL"}
# Known sentences of which only the beginning is given: they go on to the end of the sentence, or to the next that is known.
OPEN = ("apache_asis", "mit_grant", "isc_grant", "asis", "bsd_source", "bsd_binary", "bsd_endorse")

_CUT = re.compile(r"(?<=[.!?;:])(?<!Identifier:)(?<!\b[vV]\.)\s+|[\n\r]+")
_WORD, _VERSION = re.compile(r"[^\W_]"), re.compile(r"\b[vV]\.\Z")
_LIST = re.compile(r"[^\w\n\r(]*\(?(?:\d{1,2}|[a-uw-zA-UW-Z])[.)](?:\s|\Z)|[ \t]*[-+\u2022]\s")
_DROP = re.compile(r"[^\w.+]+|_+|(?<!\d)\.|\.(?!\d)")
_LINES = re.compile(r"(\[[^\]]*\]|\.\* )| ")
_HINTED = re.compile(HINT)
_KNOWN = tuple((name, re.compile(f"^(?:{_LINES.sub(lambda m: m[1] or '[ \n]', p)})$", re.M)) for name, p in SENTENCES)


@dataclass(frozen=True)
class Found:
    """A known sentence: its identifier, its place in the text and what its pattern took."""

    name: str
    start: int
    stop: int
    took: dict


def normalised(sentence: str) -> str:
    """Lower case, words by single spaces; a point stays between digits only."""
    return _DROP.sub(" ", sentence.lower()).strip()


def _joined(text: str) -> list[list[tuple[int, int]]]:
    """The sentences of a text, each as the places of its lines.

    Sentences end at a mark before space, at an empty line (or one of marks alone), and before
    a list mark; not at other line ends, where a text may have been wrapped.
    """
    out, a, on = [], 0, False
    for stop, after in [*((m.start(), m.end()) for m in _CUT.finditer(text)), (len(text), len(text))]:
        if not _WORD.search(text, a, stop):
            on = False
        else:
            if not on or _LIST.match(text, a, stop):
                out.append([])
            out[-1].append((a, stop))
            gap = text[stop:after]
            on = (text[stop - 1] not in ".!?;:" or bool(_VERSION.search(text, max(a, stop - 2), stop))) and gap.count("\n") < 2 and gap.count("\r") < 2
        a = after
    return out


def _in_sentence(text: str, lines: list[tuple[int, int]]) -> list[Found]:
    """The known sentences among the lines of one sentence."""
    norm = [re.sub(r"\s+", " ", normalised(text[a:b])) for a, b in lines]
    s, starts, stops, at = "\n".join(norm), {}, {}, 0
    for i, line in enumerate(norm):
        starts[at], stops[at + len(line)] = i, i
        at += len(line) + 1
    free, found = [(0, len(s))], []
    for name, pattern in _KNOWN:
        left = []
        for a, b in free:
            for m in pattern.finditer(s, a, b):
                found.append((starts[m.start()], stops[m.end()], name, m.groupdict()))
                if m.start() > a:
                    left.append((a, m.start() - 1))
                a = m.end() + 1
            if a < b:
                left.append((a, b))
        free = left
    found.sort(key=lambda f: f[0])
    out = []
    for (i, j, name, took), (after, *_) in zip(found, [*found[1:], (len(lines),)], strict=False):
        stop = lines[after - 1 if name in OPEN else j][1]
        out.append(Found(name, lines[i][0], stop, {k: v and v.replace("\n", " ") for k, v in took.items()}))
    return out


def sentences(text: str) -> list[Found]:
    """The known licence sentences of a text, in order. A sentence may be wrapped; it has whole lines, or what marks leave of them."""
    out = []
    for lines in _joined(text):
        if _HINTED.search(text, lines[0][0], lines[-1][1]):
            out += _in_sentence(text, lines)
    return out


def _name(rule: str, parts: list[Found]) -> str:
    took: dict = {}
    for p in parts:
        took |= {k: v for k, v in p.took.items() if v}
    plus = "-or-later" if took.get("gplplus") else ""
    cc = took.get("cc", "").upper().replace(" ", "-") or "-".join(["BY", *(x.upper() for x in ("nc", "nd", "sa") if took.get(f"cc{x}"))])
    one = lambda name: next((took[f"{name}{i}"] for i in (1, 2, 3) if f"{name}{i}" in took), "").strip()
    gnu = _FAMILY[one("family")] + f"-{one('version')}{'' if '.' in one('version') else '.0'}" + ("-or-later" if one("plus") else "")
    version = f"-{took['ccv']}" if took.get("ccv") else ""
    return rule.format(spdx=took.get("spdx", "").strip(), bsd=took.get("bsd"), gpl=took.get("gpl"), gplplus=plus, lgpl=took.get("lgpl"), gnu=gnu, cc=cc, ccv=version)


def licences(found: list[Found]) -> list[tuple[int, str]]:
    """(place in the sequence, licence) by the ordered rules; UNKNOWN for a known sentence that no rule takes, but for copyright lines."""
    free, out = [True] * len(found), []
    for rule, names in RULES:
        i = 0
        while i < len(found):
            j, k = i, 0
            took = []
            while j < len(found) and k < len(names) and (free[j] or not took):
                if free[j] and found[j].name == names[k]:
                    took.append(j)
                    k += 1
                elif not took or found[j].name != "copyright":
                    break
                j += 1
            if k == len(names):
                for t in took:
                    free[t] = False
                out.append((took[0], _name(rule, [found[t] for t in took])))
                i = j
            else:
                i += 1
    out += [(i, "UNKNOWN") for i, f in enumerate(found) if free[i] and f.name != "copyright"]
    return sorted(out)


_OUT = "sentences array<struct<name:string,start:int,stop:int>>, licences array<string>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentences (identifier, place in code points) and licences, in order of the text.

    A null text counts as empty; empty texts have neither. Every row gives one row, also
    with repeated or null ids. Columns other than doc_id and text are ignored. A very long
    text is read whole, sentence by sentence.
    """
    kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        for batch in batches:
            for piece in tv.slices(batch):
                text = piece.column("text")
                hinted = pc.match_substring_regex(text, HINT).to_pylist()
                found = [sentences(text[i].as_py()) if h else [] for i, h in enumerate(hinted)]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array([[{"name": f.name, "start": f.start, "stop": f.stop} for f in x] for x in found], kind),
                        pa.array([[name for _, name in licences(x)] for x in found], pa.list_(pa.string())),
                    ],
                    ["doc_id", "sentences", "licences"],
                )

    return texts_of(docs, "doc_id").mapInArrow(run, f"doc_id long, {_OUT}")


def op9_licences(spark, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    spans = F.transform("sentences", lambda s: F.concat_ws(":", s["name"], s["start"], s["stop"]))
    return out.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join(spans, ",").alias("sentences"), F.array_join("licences", ",").alias("licences"))
