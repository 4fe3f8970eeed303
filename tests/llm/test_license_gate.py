"""The license prefilters let every rule's matches through."""

import re
from re import _parser

from pyspark.sql import functions as F

from docuseam.llm import licenses


def variants(parsed):
    """Texts that the pattern matches: the shortest, and each branch or optional part once with the rest at its shortest."""
    parts = []
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            parts.append([chr(arg)])
        elif name == "ANY":
            parts.append(["x"])
        elif name == "SUBPATTERN":
            parts.append(variants(arg[-1]))
        elif name == "BRANCH":
            parts.append([v for branch in arg[1] for v in variants(branch)])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, _, inner = arg
            some = variants(inner)
            parts.append(["", *some] if low == 0 else [v * low for v in some])
        elif name == "IN":
            kind, what = arg[0]
            parts.append(["x"] if str(kind) == "CATEGORY" else [chr(what if str(kind) == "LITERAL" else what[0])])
        else:
            assert name in ("ASSERT", "AT"), name
    first = [min(p, key=len) for p in parts]
    return list(dict.fromkeys("".join([*first[:i], v, *first[i + 1 :]]) for i, p in enumerate(parts) for v in p))


def test_prefilters_pass_every_rule(spark):
    rows = []
    for label, words, pattern, _ in licenses.build_rules():
        assert words and all(map(str.strip, words)), label
        for text in variants(_parser.parse(pattern)):
            text = f" {text} "
            assert re.search(pattern, text) and any(w in text for w in words), (label, words, text)
            rows.append((label, text))
    frame = spark.createDataFrame(rows, "label string, words string")
    missed = frame.where(~licenses._may_mention(F.col("words"))).collect()
    assert not missed, missed[:20]


def test_grant_alone_is_labelled(spark):
    texts = ["Released under MIT.", "distributed under the terms of the BSD", "available under ISC", "published under Mulan PSL v2"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_report(frame).collect()}
    assert all(got[k][0] and got[k][1] == 0.95 for k in range(4)), got
