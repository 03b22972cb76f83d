import random
import re
from collections import Counter

from phasewright.llm.decontamination import RADIUS, contaminated, drop_contaminated, within_radius

DOCS = "doc_id long, text string, item_id string, w int"
ITEMS = "item_id long, text string, doc_id string"
WORD = re.compile(r"[^\W_]+")


def bags(words, k, size, at):
    return Counter(tuple(words[i : i + k]) for i in range(at, at + size - k + 1))


def brute(docs, items, k=5, percent=80):
    best = {}
    for d, t in docs:
        words = WORD.findall((t or "").lower())
        for i, x in items:
            item = WORD.findall((x or "").lower())
            if not item:
                continue
            s, n = min(k, len(item)), len(item)
            want = bags(item, s, n, 0)
            for at in range(len(words) - n + 1):
                have = bags(words, s, n, at)
                common, union = sum((have & want).values()), sum((have | want).values())
                if 100 * common >= percent * union:
                    score = (common / union, -at)
                    best[d, i] = max(best.get((d, i), score), score)
    return {k: (v[0], -v[1]) for k, v in best.items()}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(r.choice((1, 3, 5, 12, 20, 40, 60))))) for i in range(12)]
    items += [(50, None), (51, " .. "), (None, " ".join(word() for _ in range(30))), (52, items[4][1]), (53, "ha " * 40)]
    docs = []
    for d in range(40):
        words = [word() for _ in range(r.randint(0, 80))]
        if r.random() < 0.7:
            x = (r.choice([x for _, x in items if x and x.strip(". ")])).split()
            for _ in range(r.choice((0, 0, 1, 2, 4))):
                at = r.randrange(len(x))
                x = r.choice((x[:at] + [word()] + x[at + 1 :], x[:at] + x[at + 1 :], [*x[:at], word(), *x[at:]])) or ["q"]
            at = r.randint(0, len(words))
            words[at:at] = x
        docs.append((d, r.choice((" ", ", ", "\n")).join(words).title()))
    return docs, items


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs, items = corpus(seed)
        docs += [(None, docs[3][1]), (100, None), (101, ""), docs[5], (102, items[11][1] + " " + "w " * 20_000), (103, "ha " * 60)]
        table = spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS)
        bench = spark.createDataFrame([(*r, "x") for r in items], ITEMS)
        found = contaminated(table, bench).collect()
        got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in found}
        assert len(got) == len(found)
        want = brute(docs, items)
        assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
        bad = {d for d, _ in want}
        kept = drop_contaminated(table, bench)
        assert kept.columns == table.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in bad), key=str)
    none = bench.limit(0)
    assert contaminated(table, none).count() == 0 and drop_contaminated(table, none).count() == len(docs)
    assert contaminated(table.limit(0), bench).count() == 0


def test_every_fingerprint_within_the_radius(spark):
    r = random.Random(9)
    to_long = lambda x: x - (1 << 64) if x >> 63 else x
    base = [r.getrandbits(64) for _ in range(12)]
    near = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 26))) for b in base for _ in range(30)]
    left = spark.createDataFrame([(i, 7, to_long(x)) for i, x in enumerate(near)], "win long, w int, fp long")
    right = spark.createDataFrame([(i, 7, to_long(x)) for i, x in enumerate(base)], "item long, w int, fp long")
    want = {(i, j, (x ^ b).bit_count()) for i, x in enumerate(near) for j, b in enumerate(base) if (x ^ b).bit_count() <= RADIUS}
    assert {tuple(x) for x in within_radius(left, right, ["w"]).collect()} == want


def test_documents_shorter_than_the_item(spark):
    r = random.Random(3)
    some = lambda n: ["".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(n)]
    long, short = some(60), some(7)
    docs = [(1, " ".join(long[:-1])), (2, " ".join(long[4:-3])), (3, " ".join(long[:40])), (4, " ".join(short[:6])), (5, " ".join(long[:30] + long[31:])), (6, " ".join(long[:3]))]
    table = spark.createDataFrame([(*x, "x", 1) for x in docs], DOCS)
    bench = spark.createDataFrame([(0, " ".join(long), "x"), (1, " ".join(short), "x")], ITEMS)
    want = {}
    for d, t in docs:
        for i, x in ((0, long), (1, short)):
            words = t.split()
            have, item = bags(words, 5, len(words), 0), bags(x, 5, len(x), 0)
            share = sum((have & item).values()) / sum((have | item).values())
            if share >= 0.8:
                want[d, i] = (0, len(words), round(share, 9))
    assert {(1, 0), (2, 0), (5, 0)} <= want.keys()
    got = {(g.doc_id, g.item_id): (g.start_word, g.n_words, round(g.similarity, 9)) for g in contaminated(table, bench).collect()}
    assert got == want
    assert {g.doc_id for g in drop_contaminated(table, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}
