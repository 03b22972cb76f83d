import random

import numpy as np

from phasewright.llm.toxicity import Matcher, Model, Term, choose_terms, edits_allowed, fit_logistic, score, toxicity_scores, best_window, words_of

DOCS = "doc_id long, text string, score string, _id int, held_out string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, z in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != z)))
    return row[-1]


def test_automaton_against_edit_distances():
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    terms = [Term(t, False, 3.0 - i / 100) for i, t in enumerate(sorted({make(rng.randrange(2, 11)) for _ in range(40)}))]
    terms += [Term(t, True, 1.0) for t in ("abca", "dddd")]
    for size in (50_000, 20):
        m = Matcher(terms, most_states=size)
        for word in [make(rng.randrange(1, 13)) for _ in range(2000)] + [t.text for t in terms] + ["", "zz", "abcaz", "abczad"]:
            want = min([(distance(word, t.text), -t.weight, i) for i, t in enumerate(terms) if not t.stem and distance(word, t.text) <= edits_allowed(len(t.text))] + [(0, -t.weight, i) for i, t in enumerate(terms) if t.stem and word.startswith(t.text)], default=None)
            got = m.match(word)
            assert (got is None) == (want is None) and (got is None or (got[1], -terms[got[0]].weight) == want[:2]), word


def test_windows_tell_quotation_from_abuse():
    m = Matcher([Term("idiot", False, 4.0, 2.0), Term("worthless", False, 3.0, 2.0), Term("lowei", True, 3.0)])
    f = lambda t: best_window(t, m)
    assert f("such an idiot here") == 4 and f("you are an idiot") == 5 and f("an 1diot here") == 2
    assert f('they read "an idiot" here') == 1 and f("the word idiot is old") == 2 and f("«an idiot» he") == 1
    assert f('"fine" idiot "well"') == 4 and f("it's an idiot's idiot") == 6 and f("loweischaft") == 3
    assert f("an idiot and worthles") > 4 and f("worthlss") == 2 and not f("wort idt") and not f(None) and not f("")
    assert words_of("St*pid!!! a-b c3po$$$ _x_ É") == ["st*pid", "a", "b", "c3po", "x", "é"] and f("x" * 10**6) == 0


def test_terms_and_weights():
    words = [("loser", 90), ("losesx", 2), ("losesy", 1), *((f"lowei{c}", 4) for c in "abcdefg"), ("the", 100), ("odd", 2)]
    from collections import Counter

    toxic = Counter({"lose*": 93, "loses*": 3, "lowe*": 25, "lowei*": 25})
    clean = Counter({"lose*": 40, "loses*": 40, "the": 900, "low": 50})
    got = {(t.text, t.stem) for t in choose_terms(words, (clean, toxic), 100, 900, terms=400)}
    assert got == {("loser", False), ("lowei", True)}
    x = np.array([[3.0], [2.5], [0.1], [0.0]] * 50)
    w = fit_logistic(x, np.array([1.0, 1.0, 0.0, 0.0] * 50), np.array([1.0, -2.0]))
    assert w[0] > 1 and 1 / (1 + np.exp(-(3 * w[0] + w[1]))) > 0.95


INSULTS = ["idiot", "moron", "worthless", "pathetic", "stupid"]


def text_of(i, rng, bad):
    words = [rng.choice("the river runs past old town and over many hills of green grass while people walk home".split()) for _ in range(60)]
    if bad:
        words.insert(rng.randrange(60), bad)
    return " ".join(words)


def test_table(spark):
    rng = random.Random(3)
    rows = [(i, text_of(i, rng, rng.choice(INSULTS) if i % 5 == 0 else None), "x", 1, "s") for i in range(900)]
    rows += [(1000, text_of(0, rng, "pathetlc"), "", 1, ""), (1001, None, "", 1, ""), (1002, "", None, None, None), (None, text_of(0, rng, "moron"), "", 1, ""), (1003, "fine things " * 40_000 + "moron", "", 1, ""), (1004, text_of(1, rng, None) + ' someone once wrote "moron" on a wall', "", 1, "")]
    docs = spark.createDataFrame([*rows, rows[5]], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(700)] + [(None, 1, 1), (5, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity_scores(docs, labels).collect()
    assert len(got) == 907 and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.7) for g in got)
    of = {g.doc_id: g for g in got}
    assert all(of[i].predicted == (i % 5 == 0) for i in range(900))
    assert of[1000].predicted and of[None].predicted and of[None].held_out is False and of[1003].predicted
    assert not of[1001].predicted and of[1001].score == of[1002].score and of[1004].score < of[0].score
    assert toxicity_scores(docs.limit(0), labels).count() == 0
    assert len({g.score for g in toxicity_scores(docs, labels.limit(0)).collect()}) == 1
    assert len({g.score for g in toxicity_scores(docs, labels.where("toxic = 0")).collect()}) == 1
    assert score(docs, Model([], 0.0, 0.0)).first().score == 0.5
