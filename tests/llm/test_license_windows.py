"""License statements anywhere in a text, against all windows of its words."""

import math
import random
import textwrap

import pytest

from junctura.llm import licenses
from junctura.llm.license_texts import TEMPLATES

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above"


def scanned(spark, rows):
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(2)
    return {r.doc_id: r for r in licenses.scan(docs).collect()}


def test_wrapped_statements(spark):
    rows, want = [], []
    for label, text in (("mit", MIT), ("bsd", BSD), ("isc", ISC)):
        for width, mark in ((80, ""), (72, "# "), (30, " * "), (10, "")):
            rows.append(f"Copyright 2020 Some One\n\n{textwrap.fill(text, width, initial_indent=mark, subsequent_indent=mark, break_long_words=False)}\n\nmore text")
            want.append((label, 1))
    rows += [f"{MIT}\n{textwrap.fill(BSD, 60)}", "Released under the MIT\nLicense, and again\nunder the MIT license.", "the license\nof a town\nwas not of MIT", MIT, "Licensed under the\nApache License,\nVersion 2.0."]
    want += [("bsd,mit", 2), ("mit", 2), ("", 0), ("mit", 1), ("apache,apache-2.0", 1)]
    got = scanned(spark, rows)
    assert [(got[i].labels, got[i].n_blocks) for i in range(len(rows))] == want


def test_scattered_words_are_no_statement(spark):
    got = scanned(spark, ["she left mit without a driver license", "reserved seats all human rights", "this is a license by cc under apache", "", None])
    assert all(r.labels == "" and r.score == 0 and r.n_blocks == 0 for r in got.values())


@pytest.mark.parametrize("label, text", TEMPLATES, ids=[f"{k}-{label}" for k, (label, _) in enumerate(TEMPLATES)])
def test_each_template_is_found(label, text):
    given = licenses.templates()
    join = licenses.Join(given, dict.fromkeys(frozenset().union(*(t.tokens for t in given)), 0))
    random.seed(len(text))
    words = text.split()
    if len(words) > 60:
        words[random.randrange(10, 40)] = "changed"
    text = "before it\n" + textwrap.fill(" ".join(words), 50, initial_indent="// ", subsequent_indent="// ") + "\nafter it"
    assert label in {given[k].label for k, *_ in join.matches(licenses.WORD.findall(text.encode().lower()))}


def test_short_statements_are_no_prose(spark):
    got = scanned(spark, ["an apache license plate on the MIT license exam, a BSD license", "// SPDX-License-Identifier: MIT", "used under the apache license"])
    assert [got[k].labels for k in range(3)] == ["", "mit", "apache"]
    assert min(t.words for t in licenses.templates()) >= 4


def test_long_licenses_with_changed_words(spark):
    """Whole licenses with one word in thirty changed are found among words that are as common, with both filters at work."""
    random.seed(8)
    long = [(label, text) for label, text in TEMPLATES if len(text.split()) > 600]
    assert {label for label, _ in long} == {"apache-2.0", "cc0", "gpl", "lgpl", "mpl-2.0"} and len(long) == 7
    rows, every = [], [w for _, text in long for w in text.split()]
    for _, text in long:
        words = text.split()
        for k in range(0, len(words) - 30, 30):
            words[k + random.randrange(30)] = f"w{k}x"
        rows.append(" ".join(random.choices(every, k=3000)) + "\n" + textwrap.fill(" ".join(words), 60) + "\n" + " ".join(random.choices(every, k=3000)))
    halves = [" ".join(text.split()[: len(text.split()) // 2]) for _, text in long]
    got = scanned(spark, rows + halves)
    for k, (label, _) in enumerate(long):
        assert label in got[k].labels.split(",") and got[k].score >= 0.9
    given = licenses.templates()
    texts = [licenses.WORD.findall(t.encode().lower()) for t in rows + halves]
    vocabulary = frozenset().union(*(t.tokens for t in given))
    counts = licenses.Counter(p for t in texts for p in licenses.pairs_of(t))
    join = licenses.Join(given, {p: counts[p] for p in vocabulary})
    whole = {k for k, t in enumerate(given) if t.words > 600}
    for i, t in enumerate(texts):
        met = {k for k, *_ in join.matches(t)} & whole
        want = set()
        for k in whole:  # the windows of the whole text, without any filter
            tokens, span, held, left = given[k].tokens, int(given[k].words / 0.9 + 1e-9) - 1, licenses.Counter(), 0
            for at, pair in enumerate(licenses.pairs_of(t)):
                held[pair] += pair in tokens
                if at >= span:
                    gone = (t[at - span], t[at - span + 1])
                    held[gone] -= gone in tokens
                    if held[gone] == 0:
                        del held[gone]
                if not held[pair]:
                    del held[pair]
                if len(held) >= math.ceil(0.9 * len(tokens) - 1e-9):
                    want.add(k)
                    break
        assert met == want, i
    assert join.pruned["length"] and join.pruned["position"] and join.pruned["verified"]


def test_against_all_windows():
    random.seed(6)
    given = licenses.templates([("w", "a b c d e f g h i j"), ("x", "a b"), ("y", "c a c b d"), ("z", "d e a b b a c e f g h a")])
    letters = [bytes([c]) for c in b"abcdefghijq"]
    vocabulary = frozenset().union(*(t.tokens for t in given))
    pruned = licenses.Counter()
    for threshold in (0.5, 0.7, 0.9):
        join = licenses.Join(given, {p: random.randint(0, 9) for p in vocabulary}, threshold)
        for turn in range(400):
            words = [random.choice(letters) for _ in range(random.randint(0, 40))]
            if turn % 2:  # a template with some changes
                part = random.choice([b"a b c d e f g h i j", b"c a c b d", b"d e a b b a c e f g h a"]).split()
                for _ in range(random.randint(0, 2)):
                    part[random.randrange(len(part))] = random.choice(letters)
                spot = random.randint(0, len(words))
                words[spot:spot] = part
            best = {}
            for k, t in enumerate(given):
                size = int(t.words / threshold + 1e-9)
                for a in range(len(words)):
                    n = len(set(licenses.pairs_of(words[a : a + size])) & t.tokens)
                    if n >= math.ceil(threshold * len(t.tokens) - 1e-9):
                        best[k] = max(best.get(k, 0), n / len(t.tokens))
            got = {}
            for k, part, first, last in join.matches(words):
                got[k] = max(got.get(k, 0), part)
                assert len(set(licenses.pairs_of(words[first : last + 1])) & given[k].tokens) / len(given[k].tokens) == part
            assert got == best
        pruned += join.pruned
    assert pruned["length"] and pruned["position"] and pruned["verified"]
