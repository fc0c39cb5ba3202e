import random
import re

import pytest

from ratingmill.llm import licenses
from ratingmill.llm.licenses import Template


def regex(regions):
    out = ""
    for x in regions:
        if x[0] == "word":
            out += " (?:" + "|".join(re.escape(w.decode()) for w in x[1]) + ")"
        elif x[0] == "optional":
            out += f"(?:{regex(x[1])})?"
        else:
            out += f"(?: [^ ]+){{{x[1]},{x[2]}}}"
    return out


def brute(templates, words):
    """All (template, nearest start, end), by trying every start and end."""
    out = []
    for k, t in enumerate(templates):
        p = re.compile(regex(licenses.parse(t.markup)))
        for e in range(len(words) + 1):
            for s in range(e - 1, -1, -1):
                if p.fullmatch(" " + " ".join(words[s:e])):
                    out.append((k, s, e))
                    break
    return sorted(out, key=lambda x: (x[2], x[0]))


MARKUPS = ("a b", "a [b] c", "a <0-3> c", "[a] b <1-2> a|c [b [a] <2-2>] c", "b <1-4> [c a] b", "a a", "c <0-0> b", "<1-1>", "[b]", "a <3-1> b", "a [b", "a ] b", "a [b]")


def test_automaton_against_brute_force():
    templates = [Template(f"t{i}", f"l{i}", m) for i, m in enumerate(MARKUPS[:7])]
    scanner, r = licenses.Scanner(templates), random.Random(3)
    for _ in range(300):
        words = r.choices("abcd", [5, 4, 4, 1], k=r.randrange(14))
        assert scanner.spans([w.encode() for w in words]) == brute(templates, words)
    for bad in MARKUPS[7:]:
        with pytest.raises(ValueError):
            licenses.parse(bad)


def test_states_are_bounded(monkeypatch):
    templates = [Template("t", "l", "a <0-9> b"), Template("u", "m", "a b")]
    want = licenses.Scanner(templates)
    words = [w.encode() for w in random.Random(5).choices("abc", [6, 1, 6], k=3000)]
    whole = want.spans(words)
    monkeypatch.setattr(licenses, "MOST_STATES", 10)
    few = licenses.Scanner(templates)
    assert few.spans(words) == whole and len(few.all.states) <= 11 < len(want.all.states)


def filled(markup, r, keep_optional):
    out = []
    for x in licenses.parse(markup) if isinstance(markup, str) else markup:
        if x[0] == "word":
            out.append(r.choice(x[1]).decode())
        elif x[0] == "any":
            out += [f"name{i}" for i in range(r.randint(x[1], x[2]))]
        elif keep_optional:
            out += filled(x[1], r, keep_optional)
    return out


def test_every_template_is_found_in_its_own_wording_and_not_without_a_mandatory_word():
    scanner, r = licenses.Scanner(licenses.TEMPLATES), random.Random(7)
    for k, t in enumerate(licenses.TEMPLATES):
        for keep in (True, False):
            words = [w.encode() for w in ["x", *filled(t.markup, r, keep), "y"]]
            assert any(a == k for a, _, _ in scanner.spans(words)), t.name
        regions = licenses.parse(t.markup)
        at = r.choice([i for i, x in enumerate(regions) if x[0] == "word"])
        changed = filled(regions[:at] + [("word", (b"other",))] + regions[at + 1 :], r, False)
        assert not any(a == k for a, _, _ in scanner.spans([w.encode() for w in changed])), t.name


def test_scan_and_odd_rows(spark):
    rows = [
        (1, "Released UNDER\tthe MIT-License; under the mit license.", "x"),
        (2, "Licensed under the Apache License, Version 2.0", "x"),
        (2, "Licensed under the Apache License, Version 2.0", "x"),
        (3, None, "x"),
        (4, "", "x"),
        (5, "CC BY\nNC cc by nc", "x"),
        (6, "under the GNU General Public License, version 3. émit under the mité license", "x"),
        (None, "éÉ cc0 1.0 Universal", None),
        (7, "word " * 200_000 + "CC-BY-NC", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string").selectExpr("label as spans", "*", "label as score")
    got = sorted((tuple(r) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted(
        [
            (1, 9, 2, 1, 5, "mit", "mit", 0.5),
            (2, 8, 1, 3, 3, "apache-2", "apache-2", 0.5),
            (2, 8, 1, 3, 3, "apache-2", "apache-2", 0.5),
            (3, 0, 0, None, None, "", "", 0.0),
            (4, 0, 0, None, None, "", "", 0.0),
            (5, 6, 2, 0, 3, "cc-by-nc", "cc-by-nc", 3 / 7),
            (6, 13, 0, None, None, "", "gpl-3", 8 / 12),
            (None, 5, 0, None, None, "", "cc0", 0.5),
            (7, 200_003, 1, 200_000, 200_000, "cc-by-nc", "cc-by-nc", 3 / 7),
        ],
        key=str,
    )
    assert licenses.scan(df.limit(0)).count() == 0
    text_ids = df.selectExpr("cast(doc_id as string) as doc_id", "text")
    assert licenses.find(text_ids).schema["doc_id"].dataType.simpleString() == "string" and licenses.find(text_ids).count() == 9
    left = licenses.without(df, ["mit", "cc-by-nc"])
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == ["2", "2", "3", "4", "6", "None"]
