"""Operator 10 against plain Python."""

import re
from collections import Counter

from quern.llm import quality


def brute(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    fives = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {i + k for i in range(len(w) - 4) if fives[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)


def test_features_equal_brute_force(table, rng):
    words = ["a", "bb", "été", "#*", "漢字", "x|y", "\n", "\t"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(200)]
    docs += [(500, None), (501, ""), (502, "one two three four five " * 4000), (None, "\n\n \n"), (503, "same line of words\n" * 3), (503, "same line of words\n" * 3)]
    got = sorted(repr((r["doc_id"], *list(r)[1:7])) for r in quality.quality_report(table(docs)).collect())
    assert got == sorted(repr((d, *brute(t))) for d, t in docs)


def test_order_never_changes_the_verdict(table, rng):
    docs = table([(i, " ".join(rng.choices(["word", "other", "#", "##", "x" * 40, "a"], k=rng.randint(0, 40)))) for i in range(100)])
    orders = [list(quality.RULES), list(reversed(quality.RULES)), quality.rule_order(docs)]
    kept = [sorted(r["doc_id"] for r in quality.filter_quality(docs, o).collect()) for o in orders]
    assert kept[0] == kept[1] == kept[2]
    assert kept[0] == sorted(r["doc_id"] for r in quality.quality_report(docs).where("kept").collect())
    assert quality.filter_quality(docs).columns == docs.columns and quality.filter_quality(table([])).count() == 0
