import re

from phasewright.llm.licenses import BASE_PHRASES, TEMPLATES, Index, inverse_frequencies, licence_scan, licence_words, vocabulary

DOCS = "doc_id long, text string, labels string, n_words int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    places, labels = [], set()
    for phrase, label in BASE_PHRASES:
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [
    None, "", "  ", "MIT License", "mit-license, the MIT\nLicense; Apache License 2.0 general public licence", "GNU General Public License, general PUBLIC license",
    "émit license mit licensed mit  license", "license mit mit license license", "İMIT LICENSE K", "word " * 5000 + "Apache License" + " word" * 5000,
    "Apache Apache License License", "This work is licensed under CC BY-NC 4.0.", "All rights reserved.",
]


def test_against_brute_force(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "MIT License", None, None), (3, "MIT License", "x", 1)]
    got = {}
    out = licence_scan(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows)
    for r in out:
        got[r.doc_id] = tuple(r)[1:]
    for i, t in enumerate(TEXTS):
        assert got[i][:5] == brute(t), t
        assert set(filter(None, got[i][4].split(","))) <= set(filter(None, got[i][5].split(","))) and 0 <= got[i][6] <= 1
    assert got[11][5] == "cc-by-nc-4.0" and got[12][5] == "all-rights-reserved" and got[None][4] == "mit"
    assert licence_scan(spark.createDataFrame([], DOCS)).count() == 0


def test_notices_are_found_and_need_their_keys(spark):
    idf = inverse_frequencies(spark.createDataFrame([(1, "the of and", "", 0)], DOCS))
    assert set(idf) == set(vocabulary())
    index = Index(idf)
    for t in TEMPLATES:
        assert t.label in index.scan(f"Some file. {t.text} and so on")[5].split(",")
        broken = " ".join(w.decode() for w in licence_words(t.text)).replace(t.keys[-1], "something else entirely")
        assert t.label not in index.scan(broken)[5].split(",") or t.label in [x for p, x in BASE_PHRASES if p in broken]
    assert index.scan("software is granted without a person")[5] == ""
