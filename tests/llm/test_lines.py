import random

from phasewright.llm.line_dedup import block_levels, dedup_lines, line_sequences, longest_copies, repeated_blocks

DOCS = "doc_id long, text string, idx int, pos string, gone int"


def brute(rows, min_lines=2, min_words=8):
    seqs, seen = [], set()
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if (d, t) not in seen:
            seen.add((d, t))
            raw = (t or "").split("\n")
            seqs.append((d, t, raw, [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate(raw) if x.strip(" \t\r\x0b\x0c")]))
    first, out = set(), {}
    singles = set()
    for d, t, raw, lines in seqs:
        gone = set()
        text = [x for _, x in lines]
        for i in range(len(text)):
            if text[i] in singles and len(text[i].split()) >= min_words:
                gone.add(i)
            singles.add(text[i])
            block = tuple(text[i : i + min_lines])
            if len(block) == min_lines:
                if block in first:
                    gone.update(range(i, i + min_lines))
                first.add(block)
        dropped = {lines[i][0] for i in gone}
        out[d, t] = (len(lines), len(gone), None if t is None else "\n".join(x for i, x in enumerate(raw) if i not in dropped))
    return sorted([(d, *out[d, t]) for d, t in rows], key=str)


def check(spark, rows, **how):
    docs = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], DOCS)
    got = dedup_lines(docs, **how)
    assert got.columns == [*docs.columns, "_n_lines", "_n_deleted", "_longest_run"]
    assert sorted([(r.doc_id, r._n_lines, r._n_deleted, r.text) for r in got.collect()], key=str) == brute(rows, **how)


def test_against_brute_force(spark):
    r = random.Random(3)
    pool = [" ".join(r.choice("abcde") * 3 for _ in range(r.choice((1, 3, 9, 12)))) for _ in range(14)]
    rows = [(i, "\n".join(r.choice((*pool, "", "  ", f"own {i} line {r.random()}")) + r.choice(("", " ", "\r")) for _ in range(r.randint(0, 9)))) for i in range(60)]
    rows += [(None, rows[3][1]), (100, None), (101, ""), (102, rows[5][1]), (102, rows[5][1]), (102, "x y\nz w"), (103, "same\n" * 2000)]
    rows = [(d, t) for d, t in rows]
    check(spark, rows)
    check(spark, rows[:30], min_lines=4, min_words=100)
    check(spark, rows, min_lines=3, min_words=100)
    empty = spark.createDataFrame([], DOCS)
    assert dedup_lines(empty).count() == 0


def test_blocks_are_intervals_of_the_suffix_array(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ne\ny"), (3, "b\nc")]
    seq = line_sequences(spark.createDataFrame([(*r, 1, "p", 2) for r in rows], DOCS))
    lines = {r.pos: r for r in seq.collect()}
    text = {(d, i): x for d, t in rows for i, x in enumerate(t.split("\n"))}
    found = {(lines[b.pos].doc_id, lines[b.pos].idx, b.level): lines[b.name] for b in repeated_blocks(seq).collect()}
    want = {}
    for level in range(4):
        size, groups = 2**level, {}
        for d, t in rows:
            n = len(t.split("\n"))
            for i in range(n - size + 1):
                groups.setdefault(tuple(text[d, i + k] for k in range(size)), []).append((d, i))
        for places in groups.values():
            if len(places) > 1:
                want |= {(*p, level): min(places) for p in places}
    assert {k: (v.doc_id, v.idx) for k, v in found.items()} == want


def test_longest_earlier_runs(spark):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choice("abc") for _ in range(r.randint(1, 12)))) for i in range(30)] + [(40, "a\n" * 37), (41, "a\n" * 20 + "b")]
    seq = line_sequences(spark.createDataFrame([(*x, 1, "p", 2) for x in rows], DOCS))
    lines = sorted(seq.collect())
    text = {(d, i): x for d, t in rows for i, x in enumerate(t.split("\n"))}
    docs = {}
    for x in lines:
        docs.setdefault(x.doc_id, []).append((x.pos, text[x.doc_id, x.idx]))
    suffixes = sorted((p, tuple(t for _, t in docs[d][i:])) for d in docs for i, (p, _) in enumerate(docs[d]))
    want = {}
    for k, (p, s) in enumerate(suffixes):
        for q, t in suffixes[:k]:
            n = next((i for i, (x, y) in enumerate(zip(s, t, strict=False)) if x != y), min(len(s), len(t)))
            if n > want.get(p, (0, 0))[0]:
                want[p] = (n, q)
    assert {x.pos: (x.run, x["first"]) for x in longest_copies(block_levels(seq)).collect()} == want


def test_names_of_columns_that_clash(spark):
    rows = [(i, "one line\nand the next\nlast %d" % i) for i in range(4)]
    docs = spark.createDataFrame([(*x, 7, 8, 9) for x in rows], "doc_id long, text string, _d int, _h int, _n_deleted int")
    got = dedup_lines(docs)
    assert got.columns[:5] == docs.columns and sorted((r["doc_id"], r["_d"], r["_h"], r["_n_deleted"], r["__n_deleted"]) for r in got.collect()) == [(0, 7, 8, 9, 0), *[(i, 7, 8, 9, 2) for i in (1, 2, 3)]]
