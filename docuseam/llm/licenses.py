"""License scans with ordered signature rules, with built-in functions only.

Texts are read as words: lower-cased runs of letters and digits. A keyword
prefilter finds the few texts that may mention a license; only those get their
words joined by single spaces and the rules applied. A rule runs only if one
of its own keywords occurs, which are derived from its pattern. Detections are intervals of that word text. A detection
whose interval lies inside another one's is suppressed; of equal intervals the
rule with the higher priority (the earlier one) stays. The base phrases are
found word by word beside the rules and are never suppressed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh_name
from .secrets import strings_of
from .spans import match_spans

#: What separates words; a word is a run of all other characters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose places count, with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label, regular expression of the name in word text, further hand-written
#: signatures of the license's own wording
_LICENSES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("mit", r"(?:the )?(?:mit|expat|x11 mit)(?: x11)?", (
        r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        r"the software is provided as is without warranty of any kind express or implied")),
    ("mit-0", r"mit (?:no attribution|0)", ()),
    ("x11", r"x11", (r"except as contained in this notice the name of the x consortium shall not be used",)),
    ("apache-1", r"apache(?: software)? (?:license )?(?:v|version )?1(?: [01])?", (r"this product includes software developed by the apache (?:group|software foundation)",)),
    ("apache-2", r"(?:the )?(?:apache|asl)(?: software)?(?: public)?(?: license)?(?: v| version)? ?2(?: 0)?", (
        r"you may not use this file except in compliance with the license",
        r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        r"www apache org licenses license 2 0")),
    ("bsd-2", r"(?:2 clause|two clause|simplified|freebsd) bsd|bsd 2(?: clause)?", (r"redistributions in binary form must reproduce the above copyright notice",)),
    ("bsd-3", r"(?:3 clause|three clause|new|modified|revised) bsd|bsd 3(?: clause)?", (r"neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products",)),
    ("bsd-4", r"(?:4 clause|four clause|original|old) bsd|bsd 4(?: clause)?", (r"all advertising materials mentioning features or use of this software must display",)),
    ("bsd-0", r"(?:zero clause|0 clause) bsd|0bsd|bsd 0(?: clause)?", (r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",)),
    ("bsd", r"(?:the )?bsd(?: style| type)?", (r"redistribution and use in source and binary forms with or without modification are permitted",)),
    ("isc", r"(?:the )?isc", (r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted",)),
    ("gpl-1", r"(?:gnu )?(?:gpl|general public license)(?: v| version)? ?1(?: 0)?(?: only| or later)?", ()),
    ("gpl-2", r"(?:gnu )?(?:gpl|general public license)(?: v| version)? ?2(?: 0)?(?: only| or later)?", (
        r"either version 2 of the license or at your option any later version", r"gnu general public license version 2")),
    ("gpl-3", r"(?:gnu )?(?:gpl|general public license)(?: v| version)? ?3(?: 0)?(?: only| or later)?", (
        r"either version 3 of the license or at your option any later version", r"gnu general public license version 3")),
    ("gpl", r"(?:the )?(?:gnu )?(?:gpl|general public license)", (
        r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",)),
    ("lgpl-2", r"(?:gnu )?(?:lgpl|library general public license)(?: v| version)? ?2(?: 0)?(?: only| or later)?", ()),
    ("lgpl-2.1", r"(?:gnu )?(?:lgpl|lesser general public license)(?: v| version)? ?2 1(?: only| or later)?", (r"either version 2 1 of the license or at your option any later version",)),
    ("lgpl-3", r"(?:gnu )?(?:lgpl|lesser general public license)(?: v| version)? ?3(?: 0)?(?: only| or later)?", ()),
    ("lgpl", r"(?:the )?(?:gnu )?(?:lgpl|(?:lesser|library) general public license)", (
        r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license",)),
    ("agpl-3", r"(?:gnu )?(?:agpl|affero general public license|affero gpl)(?: v| version)? ?3(?: 0)?(?: only| or later)?", ()),
    ("agpl", r"(?:the )?(?:gnu )?(?:agpl|affero general public license|affero gpl)", (r"under the terms of the gnu affero general public license",)),
    ("fdl", r"(?:gnu )?(?:gfdl|free documentation license)(?: v| version)? ?(?:1 [123])?", (r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",)),
    ("mpl-1", r"(?:mozilla public license|mpl)(?: v| version)? ?1(?: [01])?", ()),
    ("mpl-2", r"(?:mozilla public license|mpl)(?: v| version)? ?2(?: 0)?", (r"this source code form is subject to the terms of the mozilla public license v 2 0",)),
    ("mpl", r"(?:the )?(?:mozilla public license|mpl)", ()),
    ("epl-1", r"(?:eclipse public license|epl)(?: v| version)? ?1(?: 0)?", ()),
    ("epl-2", r"(?:eclipse public license|epl)(?: v| version)? ?2(?: 0)?", (r"this program and the accompanying materials are made available under the terms of the eclipse public license",)),
    ("cddl", r"(?:the )?(?:common development and distribution license|cddl)(?: v| version)?(?: 1 [01])?", (r"the contents of this file are subject to the terms of the common development and distribution license",)),
    ("cpl", r"common public license(?: v| version)?(?: 1 0)?", ()),
    ("eupl", r"(?:european union public licen[cs]e|eupl)(?: v| version)?(?: 1 [012])?", (r"licensed under the eupl",)),
    ("cecill", r"cecill(?: [abc]| [12](?: [01])?)?", ()),
    ("artistic-2", r"artistic(?: license)?(?: v| version)? ?2(?: 0)?", ()),
    ("artistic", r"(?:the )?(?:perl )?artistic", (r"under the same terms as perl itself",)),
    ("boost", r"(?:the )?boost software(?: license)?(?: version| v)?(?: 1 0)?|bsl 1 0", (r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software",)),
    ("zlib", r"(?:the )?zlib(?: libpng)?", (r"this software is provided as is without any express or implied warranty in no event will the authors be held liable",)),
    ("libpng", r"libpng(?: 2 0)?", ()),
    ("unlicense", r"(?:the )?unlicense", (r"this is free and unencumbered software released into the public domain",)),
    ("wtfpl", r"(?:the )?wtfpl|do what the fuck you want to public license", (r"you just do what the fuck you want to",)),
    ("cc0", r"(?:creative commons |cc )?(?:cc0|cc zero|zero)(?: v| version)?(?: 1 0)?(?: universal)?", (r"waives? all (?:of )?(?:his or her|its|their) rights to the work worldwide under copyright law",)),
    ("cc-by", r"(?:cc by|creative commons attribution)(?: [1-4] [05])?(?: international| unported| generic)?", ()),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])?(?: international| unported| generic)?", ()),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)(?: [1-4] [05])?(?: international| unported| generic)?", ()),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] [05])?(?: international| unported| generic)?", (r"not be used for commercial purposes under this license",)),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])?(?: international| unported| generic)?", ()),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)(?: [1-4] [05])?(?: international| unported| generic)?", ()),
    ("odbl", r"(?:open database license|odbl)(?: v| version)?(?: 1 0)?", ()),
    ("odc-by", r"(?:open data commons attribution license|odc by)(?: v| version)?(?: 1 0)?", ()),
    ("pddl", r"(?:public domain dedication and license|pddl)(?: v| version)?(?: 1 0)?", ()),
    ("ofl", r"(?:sil )?(?:open font license|ofl)(?: v| version)?(?: 1 [01])?", (r"this font software is licensed under the sil open font license",)),
    ("python", r"(?:python software foundation|psf|python)(?: license)?(?: v| version)?(?: 2(?: 0)?)?", (r"psf is making python available to licensee on an as is basis",)),
    ("openssl", r"openssl(?: ssleay)?", (r"this product includes software developed by the openssl project",)),
    ("postgresql", r"(?:the )?postgresql", (r"permission to use copy modify and distribute this software and its documentation for any purpose without fee",)),
    ("ms-pl", r"(?:microsoft public|ms pl)", ()),
    ("ms-rl", r"(?:microsoft reciprocal|ms rl)", ()),
    ("ecl-2", r"educational community(?: license)?(?: v| version)?(?: 2 0)?", ()),
    ("upl", r"universal permissive(?: license)?(?: v| version)?(?: 1 0)?", (r"subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software",)),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?", ()),
    ("afl-3", r"academic free(?: license)?(?: v| version)?(?: [123] [01])?", ()),
    ("osl-3", r"open software license(?: v| version)?(?: [123] [01])?", ()),
    ("sspl", r"(?:server side public|sspl)(?: license)?(?: v| version)?(?: 1)?", ()),
    ("busl", r"(?:business source license|busl)(?: v| version)?(?: 1 1)?", (r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use",)),
    ("elastic-2", r"elastic(?: license)?(?: v| version)?(?: 2 0)?", ()),
    ("mulan-psl", r"mulan psl(?: v| version)?(?: [12])?", ()),
    ("vim", r"(?:the )?vim", ()),
    ("ruby", r"(?:the )?ruby(?: s)?", ()),
    ("php", r"(?:the )?php(?: v| version)?(?: 3 0[01]?)?", (r"this product includes php software freely available",)),
    ("public-domain", r"public domain", (r"(?:placed|released|dedicated|put) (?:in|into|to) the public domain", r"no rights reserved")),
    ("all-rights-reserved", r"proprietary", (r"all rights reserved", r"may not be reproduced(?: \S+){0,6} without (?:the )?(?:prior )?(?:written )?permission")),
)

#: How a grant starts; its words need not hold any other word of a license.
_GRANT = r"(?:licensed|released|distributed|available|provided|covered|published|shared|issued|offered|governed)(?: to you)? (?:by|under|with) "

#: (form, confidence); {n} is the name. Earlier forms have the higher priority.
_FORMS: tuple[tuple[str, float], ...] = (
    (r"spdx license identifier {n}(?: license)?", 1.0),
    (_GRANT + r"(?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{n})(?: licen[cs]e)?", 0.95),
    (r"(?:licen[cs]e|licensing) (?:type |is |text )?(?:the )?(?:{n})", 0.8),
    (r"(?:{n}) (?:software )?(?:public )?licen[cs]e", 0.7),
)

#: Names that say a license by themselves, without the word.
_STANDALONE = frozenset("cc0 cc-by cc-by-sa cc-by-nd cc-by-nc cc-by-nc-sa cc-by-nc-nd gpl-2 gpl-3 lgpl-2.1 lgpl-3 agpl-3 wtfpl unlicense odbl".split())
#: One of these, a word that is cc or starts with cc0, or the start of a grant is in the word text of every detection.
_GATE = ("licen", "copyright", "permission", "redistribut", "spdx", "domain", "commons", "gpl", "wtfpl", "odbl", "warrant", "includes", "reserved", "perl", "reproduce", "contributors", "advertising", "purpose", "waive", "fuck", "provided", "version", "python", "compliance", "consortium", " zero ")


def keywords(pattern: str) -> tuple[str, ...]:
    """Literals of which every match of the pattern contains one: those of its most telling part."""
    best: tuple[str, ...] = ()
    run = {""}

    def told(strings: set[str]) -> tuple[str, ...]:
        least = sorted({x.strip() for x in strings}, key=lambda x: (len(x), x))
        return tuple(x for i, x in enumerate(least) if not any(y in x for y in least[:i]))

    for item in [*re._parser.parse(pattern), None]:  # type: ignore[attr-defined]
        more = None if item is None else strings_of(item)
        if more is not None and len(run) * len(more) <= 64:
            run = {a + b for a in run for b in more}
            continue
        some = told(run)
        if some and min(map(len, some)) > min(map(len, best), default=0):
            best = some
        run = more or {""}
    return best


def build_rules() -> list[tuple[str, tuple[str, ...], str, float]]:
    """(label, keywords, pattern, confidence) in order of priority. A rule for a name runs where a word of the name occurs."""
    out = [(label, keywords(p), p, 0.98) for label, _, more in _LICENSES for p in more]
    for form, sure in _FORMS:
        out += [(label, keywords(name), form.replace("{n}", f"(?:{name})"), sure) for label, name, _ in _LICENSES]
    out += [(label, keywords(name), f"(?:{name})", 0.6) for label, name, _ in _LICENSES if label in _STANDALONE]
    return [(label, words, f"(?<= )(?:{p})(?= )", sure) for label, words, p, sure in out]


def _may_mention(words: Column) -> Column:
    """Keyword prefilter on word text."""
    out = F.contains(words, F.lit(" cc ")) | F.contains(words, F.lit(" cc0"))
    for word in _GATE:
        out = out | F.contains(words, F.lit(word))
    return out | F.rlike(words, F.lit(f" {_GRANT}"))


def _detections(norm: Column, rules: list[tuple[str, tuple[str, ...], str, float]]) -> Column:
    """All rules' matches in word text as (start, -end, order, label, sure), sorted."""
    table = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(a).alias("label"), F.array(*[F.lit(x) for x in w]).alias("words"), F.lit(p).alias("pattern"), F.lit(float(c)).alias("sure")) for i, (a, w, p, c) in enumerate(rules)])
    able = F.filter(table, lambda r: F.exists(r["words"], lambda w: F.contains(norm, w)) & F.rlike(norm, r["pattern"]))

    def spans(r):
        pieces = F.transform(F.split(norm, r["pattern"], -1), F.length)
        found = F.transform(F.regexp_extract_all(norm, r["pattern"], F.lit(0)), F.length)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,back:int,order:int,label:string,sure:double>>").alias("out"))

        def step(acc, x):
            at = acc["at"] + x["gap"]
            end = at + F.coalesce(x["len"], F.lit(0))
            one = F.array(F.struct(at.alias("start"), (-end).alias("back"), r["order"].alias("order"), r["label"].alias("label"), r["sure"].alias("sure")))
            return F.struct(end.alias("at"), F.when(x["len"].isNotNull(), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(F.arrays_zip(pieces.alias("gap"), found.alias("len")), start, step, lambda a: a["out"])

    return F.array_sort(F.flatten(F.transform(able, spans)))


def _uncontained(found: Column) -> Column:
    """Sorted by start, then longest, then priority: one lies in an earlier one iff its end is not beyond all earlier ends."""
    start = F.struct(F.lit(-1).alias("end"), F.array().cast("array<struct<start:int,end:int,label:string,sure:double>>").alias("out"))

    def step(acc, d):
        end = -d["back"]
        one = F.array(F.struct(d["start"].alias("start"), end.alias("end"), d["label"].alias("label"), d["sure"].alias("sure")))
        return F.struct(F.greatest(acc["end"], end).alias("end"), F.when(end > acc["end"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(found, start, step, lambda a: a["out"])


def scan_licenses(docs: DataFrame, text: str = "text", rules: list[tuple[str, tuple[str, ...], str, float]] | None = None) -> DataFrame:
    """Add ``n_words``, ``base`` and ``detections`` to every row.

    ``base``: array of (at, label), the word numbers (from 0) at which a base
    phrase starts. ``detections``: array of (start, end, label, sure), intervals
    of the text's words joined by single spaces, in code points, with a space
    before and after. Null and empty texts have no words and empty arrays. All
    input columns stay, those of the three names are replaced.
    """
    rules = build_rules() if rules is None else rules
    norm = fresh_name(docs, "_word_text")
    low = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    joined = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, F.lit(GAP), F.lit(" "))), F.lit(" "))
    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    body = F.col(norm)
    rows = docs.withColumn(norm, joined)
    rows = rows.withColumn("n_words", F.when(body == "  ", F.lit(0)).otherwise(spaces(body) - 1).cast("long"))
    rows = rows.withColumn(norm, F.when(_may_mention(body), body))
    places = []
    for phrase, label in BASE:
        places.append(_places(body, phrase, label, spaces))
    none = "array<struct<at:long,label:string>>"
    rows = rows.withColumn("base", F.when(body.isNull(), F.array().cast(none)).otherwise(F.array_sort(F.concat(*places)).cast(none)))
    kind = "array<struct<start:int,end:int,label:string,sure:double>>"
    rows = rows.withColumn("detections", F.when(body.isNull(), F.array().cast(kind)).otherwise(_uncontained(_detections(body, rules))))
    return rows.drop(norm)


def _places(body: Column, phrase: str, label: str, spaces) -> Column:
    pattern = f"(?<= ){phrase}(?= )"
    spans = F.when(F.contains(body, F.lit(f" {phrase} ")), match_spans(body, pattern)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    return F.transform(spans, lambda s: F.struct((spaces(F.substring(body, F.lit(1), s["start"])) - 1).cast("long").alias("at"), F.lit(label).alias("label")))


def license_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the confidence that the text states a license: the surest
    detection, at least 0.9 with a base phrase, 0 with none.
    """
    rows = scan_licenses(docs.select("doc_id", "text"))
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    of_base, of_rules = F.transform("base", lambda b: b["label"]), F.transform("detections", lambda d: d["label"])
    surest = F.coalesce(F.array_max(F.transform("detections", lambda d: d["sure"])), F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["at"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["at"])).alias("last_word"),
        names(of_base).alias("base_labels"),
        names(F.concat(of_base, of_rules)).alias("labels"),
        F.greatest(surest, F.when(F.size("base") > 0, 0.9).otherwise(0.0)).alias("score"),
    )
