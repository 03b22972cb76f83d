"""N-gram Jaccard join by token-combination prefixes."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import checkpoint, map_texts, mix, release, settled, small_side, table, utf8, without, word_grams
from .graph import ROWS_A_TASK, components

#: A token of at least so many sets may count as frequent, ...
FREQUENT = 24
#: ... but only the most frequent ones, so that the table has a fixed bound (2 MB).
MOST_FREQUENT = 1 << 18
#: Pairs within frequent keys that are listed without another round.
_FEW_PAIRS = 200_000
#: Rows of 32 bytes that are sent to all tasks at most.
_MOST_SENT = 200_000
#: Sets by size: (classes that frequent tokens are dealt into, largest size). The
#: smallest sets use single tokens only. Linked sets are of one range or of two
#: neighbours; a set near an edge is of both.
RANGES = ((0, 13), (8, 1000), (64, 8000), (512, 1 << 62))


@dataclass(frozen=True)
class Rule:
    """Words in a shingle and the least similarity in hundredths."""

    words: int = 4
    percent: int = 85

    def spare(self, n: int) -> int:
        """Tokens of a set of ``n`` that a linked set may lack."""
        return n - -(-self.percent * n // 100)

    def common(self, n: int, m: int) -> int:
        """Tokens that linked sets of ``n`` and ``m`` have in common at least."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def ranges(self, n: int) -> list[tuple[int, int]]:
        """(number, classes) of the ranges of a set of ``n``."""
        out, low = [], 0
        for i, (classes, high) in enumerate(RANGES):
            if low * self.percent <= n * 100 and n <= high:
                out.append((i, classes))
            low = high
        return out


def shingles(text: str | None, words: int) -> np.ndarray:
    """Distinct shingle hashes of a whole text, ascending, as positive 63-bit numbers."""
    return np.unique(word_grams(utf8(text).lower().split(), words) >> np.uint64(1)).astype(np.int64)


def low_part(tokens: np.ndarray, rule: Rule) -> np.ndarray:
    """The tokens of least hash, as many as a prefix needs if few of them are frequent."""
    n = len(tokens)
    return tokens[: rule.spare(n) + 1 + max(c for _, c in rule.ranges(n))] if n > 40 else tokens


def _among(tokens: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which tokens are in ``known``, which is ascending and may be much longer."""
    if not len(known):
        return np.zeros(len(tokens), bool)
    return known[np.minimum(np.searchsorted(known, tokens), len(known) - 1)] == tokens


def signatures(tokens: np.ndarray, n: int, frequent: np.ndarray, rule: Rule) -> np.ndarray | None:
    """Index keys of a set; None if more of its tokens are needed than given.

    Tokens are ordered rare before frequent, then by hash. A prefix of single
    rare tokens covers one lacking token each. Frequent tokens are of several
    classes; with ``m`` of a class in the prefix, all its pairs are keys and cover
    ``m - 1``. The prefix is extended until it covers one more than a linked set
    may lack, so that two linked sets share a key. A rare token is its own key.
    """
    need, complete, out = rule.spare(n) + 1, len(tokens) == n, []
    hot = _among(tokens, frequent)
    rare = tokens[~hot]
    if len(rare) < need and not complete:
        return None
    out.append(rare[:need])
    missing = need - len(rare)
    if missing > 0:
        for number, classes in rule.ranges(n):
            if not classes:
                out.append((mix(tokens[hot][:missing].astype(np.uint64)) >> np.uint64(1)).astype(np.int64))
                continue
            members: dict[int, list[int]] = {}
            left = missing
            for token in tokens[hot].tolist():
                group = members.setdefault(token % classes, [])
                left -= bool(group)
                group.append(token)
                if left <= 0:
                    break
            for group in members.values():
                if len(group) > 1:
                    i, j = np.triu_indices(len(group), 1)
                    g = np.array(group, np.uint64)
                    out.append((mix(mix(g[i] + np.uint64(number)) ^ g[j]) >> np.uint64(1)).astype(np.int64))
    return np.unique(np.concatenate(out))


def _shingled(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, h, n, key, low) of every document; the key stands for the whole set."""

    def work(x: dict[str, list]) -> dict[str, object]:
        sets = [shingles(t, rule.words) for t in x["_text"]]
        return {"doc_id": x["_id"], "h": x["_h"], "n": list(map(len, sets)), "key": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "low": [low_part(s, rule) for s in sets]}

    return map_texts(docs, ["_id", "_h", "_text"], "doc_id long, h long, n long, key binary, low array<long>", work)


def _signed(nodes: list, sizes: list, tokens: list[np.ndarray], frequent: np.ndarray, rule: Rule) -> dict[str, list]:
    keys = [signatures(t, n, frequent, rule) for t, n in zip(tokens, sizes, strict=True)]
    # how far a set is from the middle of its group: rare tokens among those that decide
    rare = [int((~_among(t[: rule.spare(n) + 1], frequent)).sum()) / (rule.spare(n) + 1) for t, n in zip(tokens, sizes, strict=True)]
    return {"node": nodes, "n": sizes, "sigs": keys, "rare": rare}


_SIGNED = "node long, n long, sigs array<long>, rare double"


def _whole_sets(docs: DataFrame, nodes: DataFrame, rule: Rule, frequent: np.ndarray | None = None) -> DataFrame:
    """(node, n, tokens) of the given nodes, cut anew from one text of each; with ``frequent`` their keys instead."""

    def work(x: dict[str, list]) -> dict[str, object]:
        sets = [shingles(t, rule.words) for t in x["_text"]]
        same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == k for s, k in zip(sets, x["key"], strict=True)]
        node, n, sets = ([v for v, ok in zip(values, same, strict=True) if ok] for values in (x["node"], list(map(len, sets)), sets))
        return {"node": node, "n": n, "tokens": sets} if frequent is None else _signed(node, n, sets, frequent, rule)

    def cut(wanted: DataFrame) -> DataFrame:
        wanted = wanted.select(F.xxhash64("rep").alias("_j"), "rep", "node", "key")
        schema = "node long, n long, tokens array<long>" if frequent is None else _SIGNED
        if wanted.count() > _MOST_SENT:
            chosen = docs.join(wanted, F.col("_id").eqNullSafe(F.col("rep"))).select("node", "key", "_text")
            return map_texts(chosen, ["node", "key", "_text"], schema, work)
        # a few MB of numbers, sent to the tasks as arrays: tables to join by hash would take the driver many times that
        sent = wanted.select("_j", "node", "key").toArrow()
        j, node, key = sent.column(0).to_numpy(), sent.column(1).to_numpy(), np.array(sent.column(2).to_pylist(), object)
        order = np.argsort(j, kind="stable")
        j, node, key = j[order], node[order], key[order]

        def look(x: dict[str, list]) -> dict[str, object]:
            ids = np.array(x["_j"], np.int64)
            first, last = np.searchsorted(j, ids), np.searchsorted(j, ids, "right")
            hits = [(i, k) for i in np.flatnonzero(last > first).tolist() for k in range(first[i], last[i])]
            return work({"_text": [x["_text"][i] for i, _ in hits], "node": [int(node[k]) for _, k in hits], "key": [key[k] for _, k in hits]})

        return map_texts(docs.select(F.xxhash64("_id").alias("_j"), "_text"), ["_j", "_text"], schema, look)

    repeated = nodes.where("copies > 1")
    once = cut(nodes.where("copies = 1"))
    return once if repeated.isEmpty() else once.unionByName(cut(repeated).dropDuplicates(["node"]))


def _signature_rows(sets: DataFrame, tokens: str, frequent: np.ndarray, rule: Rule) -> DataFrame:
    """(node, n, sigs) with the keys of each set, null for a set that lacks tokens."""

    def work(x: dict[str, list]) -> dict[str, object]:
        return _signed(x["node"], x["n"], x[tokens], frequent, rule)

    return map_texts(sets, ["node", "n", tokens], _SIGNED, work)


def _pairs_where(pairs: DataFrame, sets: DataFrame, column: str, test) -> DataFrame:
    """The pairs (a, b) whose tokens in ``column`` pass ``test(x, y, size of a, size of b)``."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("n").alias(f"_n{k}"), F.col(column).alias(f"_t{k}"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x, y, n, m = (batch.column(i) for i in range(2, 6))
            keep = [test(x[i].values.to_numpy(), y[i].values.to_numpy(), n[i].as_py(), m[i].as_py()) for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "_ta", "_tb", "_na", "_nb").mapInArrow(run, "a long, b long")


def _may_link(rule: Rule):
    """Whether the tokens of least hash leave room for a link; never false for linked sets."""

    def test(x: np.ndarray, y: np.ndarray, n: int, m: int) -> bool:
        last = min(x[-1] if len(x) < n else np.iinfo(np.int64).max, y[-1] if len(y) < m else np.iinfo(np.int64).max)
        x, y = x[: np.searchsorted(x, last, "right")], y[: np.searchsorted(y, last, "right")]
        shared, least = len(np.intersect1d(x, y, assume_unique=True)), rule.common(n, m)
        return len(x) - shared <= n - least and len(y) - shared <= m - least

    return test


def _links(rule: Rule):
    def test(x: np.ndarray, y: np.ndarray, n: int, m: int) -> bool:
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * shared >= rule.percent * (n + m - shared)

    return test


def _near_sizes(a: str, b: str, rule: Rule):
    return (F.col(a) * 100 >= F.col(b) * rule.percent) & (F.col(b) * 100 >= F.col(a) * rule.percent)


@dataclass(frozen=True)
class Beyond:
    """What a set has beside the core of its group, as far as links within the group go."""

    shared: int  # tokens of the core
    place: int | None  # where the set stands by size if a link may rest on the core's tokens alone
    reach: tuple[int, ...]  # places of the sets it may link with in that way
    keys: np.ndarray  # index keys among its other tokens


def _place(n: int) -> int:
    return int(math.log(n) * 50)


def beyond(x: np.ndarray, core: np.ndarray, name: int, least: int, frequent: np.ndarray, rule: Rule) -> Beyond:
    """Keys by which a set meets those of its group that it is linked to.

    Of the tokens that ``x`` has in common with a linked set, at most ``shared``
    are the core's. A linked set has ``low`` tokens or more (``least`` is the
    smallest size of the group), so at least ``common(n, low) - shared`` of them
    are not. If that is above 0, two linked sets share a token among the first
    few (rare before frequent, then by hash) of those that the core lacks. If
    not, they may also share the core's tokens only; then each of them has
    ``common(n, m)`` of these. Any set of tokens may be the core.
    """
    n = len(x)
    inside = _among(x, core)
    other, shared = x[~inside], int(inside.sum())
    low = max(-(-rule.percent * n // 100), least)
    need = rule.common(n, low) - shared
    hot = _among(other, frequent)
    other = np.concatenate((other[~hot], other[hot]))[: max(0, len(other) - max(need, 1) + 1)]
    keys = (mix(mix(other.astype(np.uint64)) ^ mix(np.array([name], np.uint64))) >> np.uint64(1)).astype(np.int64)
    high = (100 + rule.percent) * shared // rule.percent - n
    if need > 0 or high < low:
        return Beyond(shared, None, (), keys)
    return Beyond(shared, _place(n), tuple(range(_place(low), _place(high) + 1)), keys)


def _cores(members: DataFrame) -> DataFrame:
    """(grp, core, least): the tokens that more than half of a group's sets have, and the smallest size.

    Counted by group and token, so that no group is gathered; a core has at most
    twice as many tokens as its sets have on average.
    """
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("_g"), F.min("n").alias("least"))
    counts = members.select("grp", F.explode("tokens").alias("token")).groupBy("grp", "token").agg(F.count(F.lit(1)).alias("_c"))
    most = counts.join(small_side(sizes), "grp").where("2 * _c > _g").groupBy("grp").agg(F.sort_array(F.collect_list("token")).alias("core"))
    return sizes.join(most, "grp", "left").select("grp", F.coalesce("core", F.array().cast("array<long>")).alias("core"), "least")


def _compared(members: DataFrame, frequent: np.ndarray, rule: Rule) -> DataFrame:
    """(node, n, rare, grp, core_size, shared, place, reach, keys) of the members (node, n, rare, grp, tokens) of groups."""

    def work(x: dict[str, list]) -> dict[str, object]:
        found = [beyond(t, core, g, least, frequent, rule) for t, core, g, least in zip(x["tokens"], x["core"], x["grp"], x["least"], strict=True)]
        return {k: x[k] for k in ("node", "n", "rare", "grp")} | {"core_size": list(map(len, x["core"]))} | {k: [getattr(f, k) for f in found] for k in ("shared", "place", "reach", "keys")}

    cores = checkpoint(_cores(members))
    # at most 32 MB of cores are sent to all
    rows, tokens = cores.agg(F.count(F.lit(1)), F.sum(F.size("core"))).first()
    known = F.broadcast(cores) if rows * 16 + (tokens or 0) * 8 <= 1 << 25 else cores
    return map_texts(members.join(known, "grp"), ["node", "n", "rare", "grp", "tokens", "core", "least"], "node long, n long, rare double, grp long, core_size long, shared long, place long, reach array<long>, keys array<long>", work)


def _frequent_tokens(counts: DataFrame, have: np.ndarray | None = None) -> np.ndarray:
    """The tokens (token, c) of most sets, at most ``MOST_FREQUENT``, ascending."""
    counts = counts.where(F.col("c") >= FREQUENT).withColumn("level", F.floor(F.log2("c") * 8))
    levels = sorted(((r["level"], r["k"]) for r in counts.groupBy("level").agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    total, least = len(have) if have is not None else 0, None
    for level, k in levels:
        total += k
        if total > MOST_FREQUENT:
            break
        least = level
    found = [] if least is None else counts.where(F.col("level") >= least).select("token").toArrow().column(0).to_numpy()
    return np.unique(np.concatenate([np.asarray(found, np.int64), have if have is not None else np.empty(0, np.int64)]))


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3) -> DataFrame:
    """Shingle count and component of every document.

    Equal sets are one node. Keys made by ``signatures`` find candidates; a pair
    is a link only after its whole sets are compared. The sets of a frequent key
    are a group, whose core are the tokens that most of them have. Sets with
    enough of the core are linked for certain; each set gets new keys among the
    tokens that the core lacks (``beyond``). Frequent new keys make groups of
    their own, for ``rounds`` rounds. Every pair of different components
    within a key of few sets, or of one that is frequent after all rounds, is
    compared. So no link between different components is lost, while a group of
    near copies costs a few pairs a set.
    Pairs are compared by their tokens of least hash first, which may rule a link
    out; only the others' whole sets are cut again from their texts.

    A null or empty text has no shingles and is its own component; a text of
    fewer words than a shingle is one shingle. A null id takes part but names no
    component (its component is null if no other id is in it). Repeated rows are
    one node and are returned each. An empty table gives no rows; other columns
    are not read.
    """
    return _component_rows(docs, rule, id_col, text_col, rounds).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, rule: Rule = Rule(5, 80), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents less all but one of each component of near-duplicates, with all their columns.

    The document of the smallest id stays; of texts that share this id, the one
    of the least hash; of rows repeated whole, one. Documents without shingles
    stay, and so do components in which no document has an id. An empty table
    gives none; columns may have any names.
    """
    rows = _component_rows(docs, rule, id_col, text_col, 3).where("n_shingles > 0 AND component_id IS NOT NULL").select("doc_id", "h", "component_id")
    rows = checkpoint(rows)
    stays = rows.where(F.col("doc_id") == F.col("component_id")).groupBy("component_id").agg(F.min("h").alias("_stays"), F.count(F.lit(1)).alias("_c"))
    judged = rows.join(stays, "component_id").withColumn("_kept", F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("h") == F.col("_stays")))
    gone = checkpoint(judged.where(~F.col("_kept")).select("doc_id", F.col("h").alias("text_hash")).distinct())
    twice = checkpoint(judged.where(F.col("_kept")).groupBy("doc_id", F.col("h").alias("text_hash")).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c"))
    left = without(docs, gone, id_col=id_col, text_col=text_col)
    if twice.isEmpty():
        return left
    once = without(left, twice, id_col=id_col, text_col=text_col, how="left_semi").dropDuplicates([id_col, text_col])
    return without(left, twice, id_col=id_col, text_col=text_col).unionByName(once)


def _component_rows(docs: DataFrame, rule: Rule, id_col: str, text_col: str, rounds: int) -> DataFrame:
    """(doc_id, h, n_shingles, component_id) of every row; h is the text's hash."""
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_text"))
    rows = checkpoint(_shingled(docs, rule))
    ids = rows.where("n > 0").groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n"))
    classes = ids.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.coalesce(F.min_by("c", "doc_id"), F.lit(2)).alias("copies"))
    held = rows.select(F.col("key").alias("_k"), F.col("doc_id").alias("_d"), "low").join(classes, (F.col("key") == F.col("_k")) & F.col("_d").eqNullSafe(F.col("rep"))).select("key", "rep", "n", "copies", "low")
    held = held.where("copies = 1").union(held.where("copies > 1").dropDuplicates(["key"])) if not ids.where("c > 1").isEmpty() else held
    nodes = checkpoint(held.withColumn("node", F.monotonically_increasing_id()))

    counts = checkpoint(nodes.select(F.explode("low").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    frequent = _frequent_tokens(counts)
    keyed = checkpoint(_signature_rows(nodes, "low", frequent, rule))
    lacking = keyed.where("sigs is null").select("node")
    if not lacking.isEmpty():
        # sets full of frequent tokens: count all their tokens, then take whole sets for those that still lack some
        all_tokens = _whole_sets(docs, nodes.join(lacking, "node", "left_semi"), rule).select(F.explode("tokens").alias("token"))
        more = _frequent_tokens(checkpoint(all_tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= FREQUENT)), frequent)
        if len(more) > len(frequent):
            frequent = more
            keyed = checkpoint(_signature_rows(nodes, "low", frequent, rule))
            lacking = keyed.where("sigs is null").select("node")
        whole = _whole_sets(docs, nodes.join(lacking, "node", "left_semi"), rule, frequent)
        keyed = keyed.where("sigs is not null").unionByName(checkpoint(whole))
    keys = keyed.select(F.explode("sigs").alias("sig"), "node", "n", "rare")
    shared = keys.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    # s: how many keys of its set come at or after a key, the rarest first
    later = W.partitionBy("node").orderBy(F.col("c").desc(), F.col("sig").desc())
    members = settled(keys.join(shared, "sig").withColumn("s", F.row_number().over(later)))

    comps = members.select("node").distinct().withColumn("comp", F.col("node"))
    parts = max(6, math.ceil(comps.count() / ROWS_A_TASK))
    comps = settled(comps.coalesce(parts))
    del keys, shared, counts
    release(docs.sparkSession)

    def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
        """``comps`` after the links (a, b)."""
        if links.isEmpty():
            return comps
        tag = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"_c{c}"))
        links = links.join(tag("a"), "a").join(tag("b"), "b").select(F.col("_ca").alias("a"), F.col("_cb").alias("b")).where("a <> b").distinct()
        new = components(links).select(F.col("node").alias("comp"), F.col("comp").alias("_new"))
        return settled(comps.join(new, "comp", "left").select("node", F.coalesce("_new", "comp").alias("comp")).coalesce(parts))

    def open_keys(rows: DataFrame) -> DataFrame:
        """The rows whose key is in several components."""
        known = rows.join(comps, "node")
        several = known.groupBy("sig").agg(F.min("comp").alias("_least"), F.max("comp").alias("_most")).where("_least <> _most").select("sig")
        return known.drop("comp").join(several, "sig")

    # a key of many sets makes them a group: by its core, those near it are linked without being compared, and
    # the others meet by new keys among the tokens that the core lacks
    share = lambda n, m: F.ceil(rule.percent * (F.col(n) + F.col(m)) / (100 + rule.percent))
    few, borders = [members.where(F.col("c") < FREQUENT).select("sig", "node", "n", "s")], []
    many = members.where(F.col("c") >= FREQUENT).select("sig", "node", "n", "rare")
    for _ in range(rounds):
        many = settled(open_keys(many).coalesce(parts))
        by_key = many.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") * F.col("c"))).first()[0]
        if (by_key or 0) <= _FEW_PAIRS:
            few.append(many.select("sig", "node", "n", F.lit(1 << 30).alias("s")))
            break  # listed at once more cheaply than by another round
        # the sets of a key go by the one of fewest rare tokens, so that keys of one family make one group
        named = many.groupBy("sig").agg(F.min_by("node", F.struct("rare", F.xxhash64("node"))).alias("grp"))
        pairs = settled(many.join(named, "sig").select("node", "n", "rare", "grp").distinct().coalesce(parts))
        if pairs.isEmpty():
            break
        sets = _whole_sets(docs, nodes.join(small_side(pairs.select("node").distinct()), "node", "left_semi"), rule).select("node", "tokens")
        seen = checkpoint(_compared(checkpoint(sets.join(small_side(pairs), "node")), frequent, rule).coalesce(parts))
        # two sets have at least as many tokens in common as both have of the core, less the core
        nearest = seen.groupBy("grp").agg(F.max_by(F.struct("node", "n", "shared"), F.struct(F.col("shared") * 2 - F.col("n"), "node")).alias("_b"))
        seen = seen.join(small_side(nearest), "grp").withColumn("_m", F.col("_b.n")).withColumn("nearest", F.col("_b.node"))
        comps = merged(comps, seen.where((F.col("node") != F.col("nearest")) & (F.col("shared") + F.col("_b.shared") - F.col("core_size") >= share("n", "_m"))).select(F.col("node").alias("a"), F.col("nearest").alias("b")))
        borders.append(seen.where("place IS NOT NULL").select("node", "n", "grp", "nearest", "shared", "place", "reach"))
        keys = seen.select("node", "n", "rare", F.explode("keys").alias("sig")).distinct()
        shared = keys.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        again = settled(keys.join(shared, "sig").coalesce(parts))
        del sets, keys, shared, pairs, named
        release(docs.sparkSession)
        few.append(again.where(F.col("c") < FREQUENT).select("sig", "node", "n", F.lit(1 << 30).alias("s")))
        many = again.where(F.col("c") >= FREQUENT).select("sig", "node", "n", "rare")
    else:
        few.append(open_keys(many).select("sig", "node", "n", F.lit(1 << 30).alias("s")))

    # every pair of different components within a key of few sets. Linked sets share so many keys that at the first
    # of them both have as many left
    common = share("_na", "_nb")
    enough = F.least("_sa", "_sb") > common - F.ceil(rule.percent * F.greatest("_na", "_nb") / 100)
    side = lambda rows, k, *of: rows.select(*of, F.col("node").alias(k), F.col("comp").alias(f"_c{k}"), F.col("n").alias(f"_n{k}"))
    apart = (F.col("_ca") != F.col("_cb")) & _near_sizes("_na", "_nb", rule)
    listed = reduce(DataFrame.unionByName, few).join(comps, "node")
    pairs = side(listed, "a", "sig", F.col("s").alias("_sa")).join(side(listed, "b", "sig", F.col("s").alias("_sb")), "sig").where((F.col("a") < F.col("b")) & enough & apart).select("a", "b")
    if borders:
        # sets near a core that aren't of the component of the nearest one, with those of sizes that they may link with
        border = reduce(DataFrame.unionByName, borders).join(comps, "node")
        outside = border.join(comps.select(F.col("node").alias("nearest"), F.col("comp").alias("_nc")), "nearest").where("comp <> _nc")
        mine = side(outside.withColumn("place", F.explode("reach")), "a", "grp", "place", F.col("shared").alias("_ta"))
        theirs = side(border, "b", "grp", "place", F.col("shared").alias("_tb"))
        pairs = pairs.union(mine.join(theirs, ["grp", "place"]).where(apart & (F.least("_ta", "_tb") >= common)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    near = settled(_pairs_where(pairs.distinct(), nodes, "low", _may_link(rule)))
    del pairs
    release(docs.sparkSession)
    ends = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    links = settled(_pairs_where(near, _whole_sets(docs, nodes.join(ends, "node", "left_semi"), rule), "tokens", _links(rule)))
    comps = merged(comps, links)

    grouped = nodes.select("key", "node", "rep").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = grouped.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = grouped.join(least, "comp").select("key", "component_id")
    out = rows.select("doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("key")).alias("key"))
    return out.join(named, "key", "left").select("doc_id", "h", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` by 4-word shingles at a similarity of 0.85."""
    return jaccard_components(table(spark, sf_dir, "documents"))
