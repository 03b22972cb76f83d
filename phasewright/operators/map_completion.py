"""Completion of genetic maps: gates put in one after the other, in batches that leave the same maps as one by one."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import flip
from .lineage import checkpoint, stored
from .pattern_pairs import Planes, pair_scores

#: Slots whose patterns are fetched for a batch.
FETCHED = 1 << 18
#: Slots that are listed for the gates of a pattern; a batch ends where one needs more.
KEPT = 16
#: Places at the head of each map that are looked through first, beside those filled before, and slots of different patterns among them.
PLACES, HEAD = 1 << 17, 1 << 15
#: Slots that a task scores together, and scores that it holds at once.
SLOTS, SCORES = 100_000, 1 << 22
#: Bytes of scores that the driver keeps.
BYTES_KEPT = 1 << 28
#: Bits of a position, and that of a slot that is taken.
BITS = 61
TAKEN = np.iinfo(np.int64).max

Kind = tuple[str | None, str]


@dataclass
class Completed:
    """``maps``: group, ord, contig, side, pattern, swap and score (null for markers that were there); ``unplaced``: gates left over."""

    maps: DataFrame
    unplaced: DataFrame


class _Group:
    """A map as the batch sees it: its size, first markers, old markers met, and the open slots that the batch made.

    A new slot is its position (that of its left marker) and the numbers of the patterns beside it; ``of`` is the slot right of a marker.
    """

    def __init__(self, name: str) -> None:
        self.name, self.size, self.added, self.head = name, 0, 0, -1
        self.first: tuple | None = None
        self.old: dict[int, int] = {}
        self.touched: dict[int, int] = {}
        self.pos, self.x, self.y, self.n = np.zeros(64, np.int64), np.zeros(64, np.int32), np.zeros(64, np.int32), 0
        self.left: list[int] = []
        self.sort()
        self.best: dict[int, tuple] = {}

    def open(self, left: int, position: int, x: int, y: int) -> int:
        if self.n == len(self.pos):
            self.pos, self.x, self.y = (np.concatenate((v, np.zeros_like(v))) for v in (self.pos, self.x, self.y))
        self.pos[self.n], self.x[self.n], self.y[self.n] = position, x, y
        self.left.append(left)
        self.n += 1
        return self.n - 1

    def sort(self) -> None:
        """Slots that are open, by position."""
        some = np.flatnonzero(self.pos[: self.n] < TAKEN)
        self.sorted = some[self.pos[some].argsort()]
        self.places, self.sx, self.sy, self.at = self.pos[self.sorted], self.x[self.sorted], self.y[self.sorted], self.n

    def moved(self, low: int, high: int) -> None:
        """Positions between two have changed, their order has not."""
        i, j = self.places.searchsorted((low, high)).tolist()
        now = self.pos[self.sorted[i:j]]
        self.places[i:j] = np.maximum.accumulate(np.where(now == TAKEN, low, now))

    def search(self, row: np.ndarray, score: int, start: int, end: int) -> int:
        """The first open slot of a score at a position from ``start`` and before ``end``, or -1."""
        if self.n - self.at > max(512, len(self.sorted) // 16):
            self.sort()
        found = -1
        i, last = self.places.searchsorted((start, end)).tolist()
        wide = 64
        while i < last:
            stop = min(i + wide, last)
            same = np.flatnonzero(row[self.sx[i:stop]] + row[self.sy[i:stop]] == score)
            if same.size:
                same = self.sorted[i + same]
                same = same[self.pos[same] < TAKEN]
                if same.size:
                    found = int(same[0])
                    end = int(self.pos[found])
                    break
            i, wide = stop, min(4 * wide, 1 << 14)
        late = self.pos[self.at : self.n]
        some = np.flatnonzero((late < end) & (late >= start))
        if some.size:
            some += self.at
            some = some[row[self.x[some]] + row[self.y[some]] == score]
            if some.size:
                found = int(some[self.pos[some].argmin()])
        return found


class _Patterns:
    """Patterns by number, their scores with all others; rows of scores are kept up to ``BYTES_KEPT``."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.rows: dict[int, np.ndarray] = {}

    def number(self, pattern: str) -> int:
        return self.numbers.setdefault(pattern.upper(), len(self.numbers))

    def close(self) -> None:
        """No further pattern comes."""
        names = list(self.numbers)
        self.planes, self.n = Planes.read(names), len(names[0]) if names else 0
        bits = lambda p, letters: int("0" + "".join("1" if x in letters else "0" for x in p), 2)
        self.bits = [(bits(p, "P"), bits(p, "M"), bits(p, set(p) - {"U"})) for p in names]
        self.dtype = np.int16 if self.n < 8000 else np.int32
        self.most = max(16, BYTES_KEPT // max(1, len(names) * np.dtype(self.dtype).itemsize))

    def row(self, p: int) -> np.ndarray:
        """Scores of a pattern with all."""
        row = self.rows.get(p)
        if row is None:
            if len(self.rows) >= self.most:
                del self.rows[next(iter(self.rows))]
            row = self.rows[p] = pair_scores(self.planes[[p]], self.planes, scale=True)[0].astype(self.dtype)
        return row

    def score(self, p: int, q: int) -> int:
        """``pair_scores`` of two patterns."""
        (ap, am, ak), (bp, bm, bk) = self.bits[p], self.bits[q]
        points = 2 * ((ap & bp).bit_count() + (am & bm).bit_count()) - (ap & bm).bit_count() - (am & bp).bit_count()
        value = points * 1.0 / max((ak & bk).bit_count(), 1) * self.n
        return int(abs(value) + 0.5) * (1 if value >= 0 else -1)


@dataclass
class _Best:
    """The best slots of a kind of gate: score, group, swap, ord, best first; ``all``: there are no others."""

    slots: list[tuple[int, str, bool, int]] = field(default_factory=list)
    all: bool = False
    at: int = 0


class _Fold:
    """Maps with the gates of a batch put in one by one: linked markers, of which those from before come in as they are met.

    Markers are numbers into lists. ``before`` and ``after`` are markers beside one, -1 at an end and -2 where
    no gate of the batch has come between. ``line`` is the old slot of a new marker, ``position`` orders the markers of a map.
    """

    def __init__(self, patterns: _Patterns, most: int) -> None:
        self.patterns, self.perfect = patterns, 4 * patterns.n
        self.shift = BITS - max(most + 2, 2).bit_length()
        self.step = 1 << self.shift // 2  # between neighbours of a line that grows at one end
        self.groups: dict[str, _Group] = {}
        self.pattern: list[int] = []
        self.contig: list[str] = []
        self.before: list[int] = []
        self.after: list[int] = []
        self.line: list[int] = []
        self.position: list[int] = []
        self.of: list[int] = []
        self.gate: list[int] = []

    def group(self, name: str) -> _Group:
        if name not in self.groups:
            self.groups[name] = _Group(name)
        return self.groups[name]

    def _marker(self, pattern: int, contig: str, before: int, after: int, line: int, position: int, gate: int) -> int:
        for values, value in ((self.pattern, pattern), (self.contig, contig), (self.before, before), (self.after, after), (self.line, line), (self.position, position), (self.of, -1), (self.gate, gate)):
            values.append(value)
        return len(self.gate) - 1

    def old(self, group: _Group, o: int, contig: str, pattern: int) -> int:
        """The marker that was at ``o``."""
        e = group.old.get(o)
        if e is None:
            e = group.old[o] = self._marker(pattern, contig, -2, -2, o, o << self.shift, -1)
        return e

    def insert(self, group: _Group, i: int, a: int, b: int, pattern: int, contig: str, gate: int) -> int:
        """A new marker between ``a`` and ``b`` (-1: an end) of the old slot ``i``."""
        low = self.position[a] if a >= 0 else 0
        high = self.position[b] if b >= 0 and self.gate[b] >= 0 else (i + 1) << self.shift
        if high - low < 2:
            self._spread(group, i, a, b)
            low = self.position[a] if a >= 0 else 0
            high = self.position[b] if b >= 0 and self.gate[b] >= 0 else (i + 1) << self.shift
        middle = (low + high) // 2
        if b >= 0 and self.gate[b] >= 0 and (a < 0 or self.gate[a] < self.gate[b]):
            middle = max(high - self.step, middle)  # a line that grows to the left
        elif a >= 0 and self.gate[a] >= 0:
            middle = min(low + self.step, middle)
        e = self._marker(pattern, contig, a, b, i, middle, gate)
        if a >= 0:
            if self.of[a] >= 0:
                group.pos[self.of[a]] = TAKEN
            self.after[a] = e
            self.of[a] = group.open(a, low, self.pattern[a], pattern) if self.contig[a] != contig else -1
        if b >= 0:
            self.before[b] = e
            if self.contig[b] != contig:
                self.of[e] = group.open(e, middle, pattern, self.pattern[b])
        if a < 0:
            group.head = e
        if a < 0 or self.gate[a] < 0:
            group.touched[i] = e
        group.added += 1
        return e

    def _spread(self, group: _Group, i: int, a: int, b: int) -> None:
        """Positions around a place between ``a`` and ``b`` anew, evenly: of so many markers of the line that they get room."""
        new = lambda e: e >= 0 and self.gate[e] >= 0
        left, right, wide = [], [], 32
        while True:
            while new(a) and len(left) < wide:
                left.append(a)
                a = self.before[a]
            while new(b) and len(right) < wide:
                right.append(b)
                b = self.after[b]
            low = self.position[a] if a >= 0 else 0
            high = self.position[b] if new(b) else (i + 1) << self.shift
            room = (high - low) // (len(left) + len(right) + 1)
            if room >= 1 << self.shift // 3 or not new(a) and not new(b):
                break
            wide *= 4
        if room < 2:
            raise ValueError(f"no room for {len(left) + len(right)} markers in one slot")
        for k, e in enumerate((*reversed(left), *right), 1):
            self.position[e] = low + k * room
            if self.of[e] >= 0:
                group.pos[self.of[e]] = self.position[e]
        group.best = {p: (slot, seen, low if low < floor <= high else floor) for p, (slot, seen, floor) in group.best.items()}
        group.moved(low, high)

    def of_line(self, group: _Group, i: int):
        """New markers of an old slot, in order."""
        e = group.touched[i]
        while e >= 0 and self.gate[e] >= 0:
            yield e
            e = self.after[e]

    def new_slot(self, group: _Group, p: int, score: int, position: int) -> tuple[int, int]:
        """The best slot that the batch made, and its score, if that is above ``score`` or as high at a lesser position; else -1."""
        slot = self._perfect(group, p, position if score == self.perfect else TAKEN)
        if slot >= 0 or score == self.perfect:
            return slot, self.perfect
        some = np.flatnonzero(group.pos[: group.n] < TAKEN)
        if some.size:
            row = self.patterns.row(p)
            both = row[group.x[some]] + row[group.y[some]]
            most = int(both.max())
            if most >= max(score, 1):
                some = some[both == most]
                first = int(some[group.pos[some].argmin()])
                if most > score or group.pos[first] < position:
                    return first, most
        return -1, score

    def _perfect(self, group: _Group, p: int, limit: int) -> int:
        """The first slot that the batch made with the highest score there is, if it lies before ``limit``.

        Of the slots that were seen at the last call none before ``floor`` has it, but the one found then.
        """
        pos, n = group.pos, group.n
        slot, seen, floor = group.best.get(p, (-1, 0, 0))
        if slot >= 0 and pos[slot] == TAKEN:
            slot = -1
        if slot >= 0:
            if pos[slot] < limit:
                limit = int(pos[slot])
            else:
                slot = -1
        done = slot >= 0
        if seen < n:
            some = np.flatnonzero(pos[seen:n] < limit)
            if some.size:
                some += seen
                row = self.patterns.row(p)
                some = some[row[group.x[some]] + row[group.y[some]] == self.perfect]
                if some.size:
                    slot = int(some[pos[some].argmin()])
                    limit = int(pos[slot])
        if not done and limit > floor:
            found = group.search(self.patterns.row(p), self.perfect, floor, limit)
            if found >= 0:
                slot, limit = found, int(pos[found])
        group.best[p] = (slot, n, limit)
        return slot


def _flipped(pattern: str) -> str:
    return "".join({"P": "M", "M": "P"}.get(x, "u") for x in pattern)


def completed_maps(gmap: DataFrame, gates: DataFrame, *, group: str = "group_id", order: str = "ord", batch_rows: int = 1 << 20, compat: bool = False) -> Completed:
    """Maps with gates put in by order of contig and side, each into the maps that those before it have left.

    ``gmap``: group, ord, contig, side (left or right), pattern. ``gates``: group
    (null: of no group), contig, side, pattern.

    - A gate of a group whose other end is on that group's map goes beside it:
      before it if that is the map's first marker, after it if it is the last,
      else to the neighbour it matches better; of equal ones, left before right.
      Its score is twice its length.
    - Another gate of a group goes to the slot (two neighbours of different
      contigs) with the highest sum of scores; the first of equal ones. If none
      is above 0 it goes behind the map's first marker, with score 0.
    - A gate of no group is tried in every group in order, as it is and then
      flipped, and only a score above all before counts. Without one above 0 it is
      left over, as are gates of groups without a map of two markers.

    Later gates meet a flipped gate's flipped pattern; with ``compat`` its pattern
    as it was. Gates that are on a map already are passed over; of repeated gates
    the least row counts. All patterns must be of one length.

    One gate's place depends on all before it, yet each insertion takes away one
    slot and gives two. So tasks list the ``KEPT`` best slots that are there for a batch
    of the next gates, once for gates of one group and pattern; the driver then places
    the batch, with scores of new slots from the few patterns beside them. Most lists
    end near the head of a map, where slots as good as can be come first; whole maps
    are scored for the others only. A gate whose listed slots are all taken, where
    those that aren't listed could be better than the new ones, begins the next batch.
    The driver holds a batch, its lists and at most ``FETCHED`` slots' patterns;
    maps stay distributed.
    """
    text = lambda df, *more: df.select(F.col(group).cast("string").alias("group"), *more, *[F.col(c).cast("string").alias(c) for c in ("contig", "side", "pattern")])
    start = text(gmap, F.col(order).alias("_o"))
    state = _in_order(start.select("*", F.lit(False).alias("swap"), F.lit(None).cast("long").alias("score")), "_o", "contig", "side")
    once = text(gates).groupBy("contig", "side").agg(F.min(F.struct(F.col("group").isNull().alias("_u"), "group", "pattern")).alias("_g")).select("contig", "side", "_g.group", "_g.pattern")
    waiting = once.join(state.select("contig", "side").distinct(), ["contig", "side"], "left_anti")
    waiting = stored(waiting.select(F.concat_ws("\t", "contig", "side").alias("key"), "*").sort("key"))
    lengths = [r[0] for r in state.select(F.length("pattern")).union(waiting.select(F.length("pattern"))).distinct().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError(f"patterns of {lengths[0]} and of {lengths[1]} places")
    # files hold ranges of keys: some of them are enough for a batch
    parts = sorted((r["k"], r["n"]) for r in waiting.groupBy(F.input_file_name()).agg(F.max("key").alias("k"), F.count(F.lit(1)).alias("n")).collect())
    last = None
    while True:
        left = [(k, n) for k, n in parts if last is None or k > last]
        enough = np.cumsum([0, *(n for _, n in left[1:])]) >= batch_rows
        rest = waiting.where(F.col("key") <= left[int(enough.argmax())][0]) if enough.any() and left else waiting
        batch = (rest if last is None else rest.where(F.col("key") > last)).orderBy("key").limit(batch_rows).toArrow()
        if not len(batch):
            break
        done, added = _placed(state, batch, compat)
        last = batch["key"][done - 1].as_py()
        if len(added):
            state = _with(state, added)
    unplaced = waiting.join(state.select("contig", "side"), ["contig", "side"], "left_anti")
    pattern = F.when(F.col("swap"), flip("pattern")).otherwise(F.col("pattern")) if compat else F.col("pattern")
    maps = state.select(F.col("group").alias(group), F.col("ord").cast("int").alias(order), "contig", "side", pattern.alias("pattern"), "swap", "score")
    return Completed(maps, unplaced.select(F.col("group").alias(group), "contig", "side", "pattern"))


def _in_order(rows: DataFrame, *by: str) -> DataFrame:
    """Maps by place from 1, each marker with the contig and pattern of both neighbours."""
    w = W.partitionBy("group").orderBy(*by)
    place = {"ord": F.row_number().over(w).cast("long")}
    beside = {f"{name}_{c}": of(c).over(w) for name, of in (("last", F.lag), ("next", F.lead)) for c in ("contig", "pattern")}
    return stored(rows.select("group", "contig", "side", "pattern", "swap", "score", *[v.alias(k) for k, v in (place | beside).items()]))


def _with(state: DataFrame, added: pa.Table) -> DataFrame:
    new = state.sparkSession.createDataFrame(added)
    columns = ["group", F.col("ord").alias("_o"), "contig", "side", "pattern", "swap", "score"]
    return _in_order(state.select(*columns, F.lit(0).alias("_k")).unionByName(new.withColumnRenamed("ord", "_o")), "_o", "_k")


def _open(state: DataFrame) -> DataFrame:
    """Slots with the patterns beside them, in order as their sum is the same."""
    x, y = F.upper("pattern"), F.upper("next_pattern")
    return state.where(F.col("contig") != F.col("next_contig")).select("group", "ord", F.least(x, y).alias("pattern"), F.greatest(x, y).alias("_y"))


def _first_of(slots: DataFrame) -> DataFrame:
    """The first ``KEPT`` slots of a group and two patterns: no gate's list holds others."""
    w = W.partitionBy("group", "pattern", "_y").orderBy("ord")
    return slots.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= KEPT).drop("_r")


def _head_slots(state: DataFrame, kinds: list[Kind], first: str | None, places: int) -> dict[int, list[int]]:
    """Places of the first ``KEPT`` slots of the highest score there is, for the kinds of gate that have these among the first ``places``.

    A gate of no group has them in the map ``first``, as it is. What comes later is no better.
    """
    slots = _first_of(_open(state.where(F.col("ord") <= places)))
    slots = slots.withColumn("_n", F.row_number().over(W.partitionBy("group").orderBy("ord"))).where(F.col("_n") <= HEAD)
    of_group: dict[str, list[int]] = {}
    for j, (g, _) in enumerate(kinds):
        if (g or first) is not None:
            of_group.setdefault(first if g is None else g, []).append(j)
    patterns = [p for _, p in kinds]

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ord", kind="stable")
        ords = part["ord"].to_numpy()
        number, different = pd.factorize(np.concatenate((part["pattern"].to_numpy(), part["_y"].to_numpy())))
        x, y, known = number[: len(part)], number[len(part) :], Planes.read(list(different))
        js, out = np.array(of_group.get(part["group"].iloc[0], []), np.int64), []
        wide = max(1, SCORES // max(1, len(different)))
        for at in range(0, len(js), wide):
            some = js[at : at + wide]
            top = pair_scores(Planes.read([patterns[j] for j in some]), known, scale=True) == 2 * known.n
            have, lists = np.zeros(len(some), np.int64), [[] for _ in some]
            for s in range(0, len(part), 1024):
                wait = np.flatnonzero(have < KEPT)
                if not len(wait):
                    break
                row, column = np.nonzero(top[np.ix_(wait, x[s : s + 1024])] & top[np.ix_(wait, y[s : s + 1024])])
                edges = np.searchsorted(row, np.arange(len(wait) + 1))
                for k, i in enumerate(wait):
                    found = ords[s + column[edges[k] : edges[k + 1]][: KEPT - have[i]]]
                    lists[i] += found.tolist()
                    have[i] += len(found)
            out += [(int(j), found) for j, found in zip(some, lists, strict=True) if len(found) == KEPT]
        return pd.DataFrame(out, columns=["j", "ords"])

    rows = slots.groupBy("group").applyInPandas(work, "j int, ords array<long>").toArrow()
    return dict(zip(rows["j"].to_pylist(), rows["ords"].to_pylist(), strict=True))


def _best_slots(state: DataFrame, kinds: list[Kind]) -> list[list[tuple[int, str, bool, int]]]:
    """(score, group, swap, ord) of the ``KEPT`` best slots of each kind of gate, best first."""
    if not kinds:
        return []
    spark = state.sparkSession
    slots = checkpoint(_first_of(_open(state)))
    tasks = max(spark.sparkContext.defaultParallelism, -(-slots.count() // SLOTS))
    slots = slots.repartition(tasks, "group", "ord")
    of_group: dict[str | None, list[int]] = {}
    for j, (g, _) in enumerate(kinds):
        of_group.setdefault(g, []).append(j)
    patterns = [p for _, p in kinds]

    def tops(js: list[int], names: np.ndarray, ords: np.ndarray, x: np.ndarray, y: np.ndarray, known: Planes, free: bool):
        n = len(ords)
        number = pd.factorize(names)[0]
        turn = np.lexsort((np.tile(np.arange(n), 2), np.repeat([0, 1], n), np.tile(number, 2))) if free else np.arange(n)  # a group as it is, then flipped
        size = len(turn)
        most, step = min(KEPT, size), max(1, SCORES // max(size, len(known.p)))
        for at in range(0, len(js), step):
            some = np.array(js[at : at + step])
            own = Planes.read([patterns[j] for j in some])
            both = [v[:, x] + v[:, y] for v in (pair_scores(z, known, scale=True) for z in ((own, own.flipped()) if free else (own,)))]
            both = np.concatenate(both, axis=1)[:, turn]
            top = np.argpartition(np.arange(size) - both * size, most - 1, axis=1)[:, :most]
            score = np.take_along_axis(both, top, axis=1)
            row, column = np.nonzero(score > 0)
            to = turn[top[row, column]]
            yield pd.DataFrame({"j": some[row], "score": score[row, column], "group": names[to % n], "swap": to >= n, "ord": ords[to % n]})

    def work(parts):
        parts = [part for part in parts if not part.empty]  # a task has some ``SLOTS`` rows
        if not parts:
            return
        part = pd.concat(parts).sort_values(["group", "ord"], kind="stable")
        names, ords = part["group"].to_numpy(), part["ord"].to_numpy()
        number, different = pd.factorize(np.concatenate((part["pattern"].to_numpy(), part["_y"].to_numpy())))
        x, y, known = number[: len(part)], number[len(part) :], Planes.read(list(different))
        for g, js in of_group.items():
            at = np.arange(len(part)) if g is None else np.flatnonzero(names == g)
            if len(at):
                yield from tops(js, names[at], ords[at], x[at], y[at], known, g is None)

    found = slots.mapInPandas(work, "j int, score long, group string, swap boolean, ord long")
    order = W.partitionBy("j").orderBy(F.col("score").desc(), "group", "swap", "ord")
    rows = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= KEPT).toArrow().sort_by([("j", "ascending"), ("_r", "ascending")])
    best: list[list] = [[] for _ in kinds]
    for j, *slot in zip(*(rows.column(c).to_pylist() for c in ("j", "score", "group", "swap", "ord")), strict=True):
        best[j].append(tuple(slot))
    return best


def _lists(state: DataFrame, kinds: list[Kind], places: int) -> list[_Best]:
    """The best slots of each kind; a pattern without known places has none."""
    scored = [j for j, (_, p) in enumerate(kinds) if p.strip("U")]
    first = state.where(F.col("contig") != F.col("next_contig")).agg(F.min("group")).first()[0]
    head = _head_slots(state, [kinds[j] for j in scored], first, places)
    top = 4 * len(kinds[0][1])
    lists = [_Best(all=True) for _ in kinds]
    for k, ords in head.items():
        j = scored[k]
        g = kinds[j][0]
        lists[j] = _Best([(top, first if g is None else g, False, o) for o in ords])
    others = [j for k, j in enumerate(scored) if k not in head]
    for j, slots in zip(others, _best_slots(state, [kinds[j] for j in others]), strict=True):
        lists[j] = _Best(slots, len(slots) < KEPT)
    return lists


def _placed(state: DataFrame, batch: pa.Table, compat: bool) -> tuple[int, pa.Table]:
    """How many gates of the batch are done, and the rows to put into the maps."""
    spark = state.sparkSession
    contigs, sides, groups, patterns = (batch[c].to_pylist() for c in ("contig", "side", "group", "pattern"))
    kinds: dict[Kind, int] = {}
    kind = [kinds.setdefault((g, p.upper()), len(kinds)) for g, p in zip(groups, patterns, strict=True)]
    most, filled = state.agg(F.max("ord"), F.count("score")).first()
    most = most or 0
    lists = _lists(state, list(kinds), PLACES + filled)
    # old slots that the batch may need, the best of each list first
    wanted: dict[tuple[str, int], None] = {}
    for rank in range(KEPT):
        for best in lists:
            if rank < len(best.slots) and len(wanted) < FETCHED:
                wanted.setdefault(best.slots[rank][1::2])
    numbers = _Patterns()
    number = numbers.number
    known = {}
    if wanted:
        names, ords = zip(*wanted, strict=True)
        near = F.broadcast(spark.createDataFrame(pa.table({"group": pa.array(names, pa.string()), "ord": pa.array(ords, pa.int64())})))  # FETCHED slots
        rows = state.where(F.col("ord") <= max(ords)).join(near, ["group", "ord"]).select("group", "ord", "contig", "pattern", "next_contig", "next_pattern").toArrow().to_pydict()
        for g, o, c, p, d, q in zip(*rows.values(), strict=True):
            known[g, o] = (c, number(p), d, number(q))
    # other ends on the maps, with their neighbours
    grouped = [r for r, g in enumerate(groups) if g is not None]
    mates: dict[int, tuple] = {}
    sizes: dict[str, tuple] = {}
    if grouped:
        pairs = pa.table({"r": pa.array(grouped, pa.int64()), "group": pa.array([groups[r] for r in grouped], pa.string()), "contig": pa.array([contigs[r] for r in grouped], pa.string()), "side": pa.array(["left" if sides[r] == "right" else "right" for r in grouped], pa.string())})
        beside = ("contig", "pattern", "last_contig", "last_pattern", "next_contig", "next_pattern")
        rows = state.join(spark.createDataFrame(pairs), ["group", "contig", "side"]).select("r", "ord", *beside).toArrow().to_pydict()
        for r, o, c, p, a, x, b, y in zip(*rows.values(), strict=True):
            mates[r] = (o, c, number(p), a, None if x is None else number(x), b, None if y is None else number(y))
        asked = F.broadcast(spark.createDataFrame(pa.table({"group": pa.array(sorted({groups[r] for r in grouped}), pa.string())})))  # groups of a batch
        ends = state.join(asked, "group").groupBy("group").agg(F.max("ord").alias("n"), F.min(F.when(F.col("ord") == 1, F.struct(*beside))).alias("f"))
        for r in ends.collect():
            f = r["f"]
            sizes[r["group"]] = (r["n"], f["contig"], number(f["pattern"]), f["next_contig"], None if f["next_pattern"] is None else number(f["next_pattern"]))
    of_kind = [(number(p), number(_flipped(p))) for _, p in kinds]
    numbers.close()
    fold = _Fold(numbers, most)
    for name, (n, *first) in sizes.items():
        fold.group(name).size, fold.group(name).first = n, first
    codes = pd.factorize(np.array(contigs, object))[0].tolist()
    new = [-1] * (2 * len(batch))  # by contig and side
    here: list[_Group | None] = []  # of each new marker's gate
    gates, scores, swaps = [], [], []
    in_order: list[_Group] = []
    done = 0
    for r, g in enumerate(groups):
        side, best = sides[r], lists[kind[r]]
        keep, swap = of_kind[kind[r]]
        end = 2 * codes[r] + (side == "right") if side in ("left", "right") else -1
        at = None
        if g is None:
            group = None
        else:
            group = fold.groups.get(g)
            if group is None or group.size < 1:
                done += 1
                continue
            e = new[2 * codes[r] + (side != "right")]
            if e >= 0 and here[fold.gate[e]] is not group:
                e = -1
            if e < 0 and r in mates:
                o, c, p, *_ = mates[r]
                e = fold.old(group, o, c, p)
            if e >= 0:
                at = _beside(fold, group, e, mates.get(r), keep, side != "right")
                score, turned = 2 * len(patterns[r]), False
        if at is None:
            found = _best_place(fold, best, group, keep, swap, in_order)
            if found is None:
                break
            if not found:
                if group is None or group.size + group.added < 2:
                    done += 1
                    continue
                at, score, turned = _behind_first(fold, group), 0, False
            else:
                score, group, turned, i, a = found
                if a < 0:
                    two = known.get((group.name, i))
                    if two is None:
                        break
                    at = (i, fold.old(group, i, *two[:2]), fold.old(group, i + 1, *two[2:]))
                else:
                    at = (fold.line[a], a, fold.after[a])
        if not group.added:
            in_order.append(group)
            in_order.sort(key=lambda x: x.name)
        e = fold.insert(group, *at, swap if turned and not compat else keep, contigs[r], len(gates))
        here.append(group)
        gates.append(r)
        scores.append(score)
        swaps.append(turned)
        if end >= 0:
            new[end] = e
        done += 1
    where = {"group": [], "ord": [], "_k": [], "at": []}
    for group in fold.groups.values():
        for i in group.touched:
            for k, e in enumerate(fold.of_line(group, i), 1):
                for name, value in zip(where, (group.name, i, k, fold.gate[e]), strict=True):
                    where[name].append(value)
    at = where.pop("at")
    rows = [gates[k] for k in at]
    put = [_flipped(patterns[r]) if swaps[k] and not compat else patterns[r] for k, r in zip(at, rows, strict=True)]
    added = pa.table({
        "group": pa.array(where["group"], pa.string()), "ord": pa.array(where["ord"], pa.int64()), "_k": pa.array(where["_k"], pa.int32()), "contig": batch["contig"].take(pa.array(rows, pa.int64())).cast(pa.string()), "side": batch["side"].take(pa.array(rows, pa.int64())).cast(pa.string()),
        "pattern": pa.array(put, pa.string()), "swap": pa.array([swaps[k] for k in at], pa.bool_()), "score": pa.array([scores[k] for k in at], pa.int64()),
    })
    return max(done, 1), added


def _beside(fold: _Fold, group: _Group, e: int, mate: tuple | None, pattern: int, mate_right: bool) -> tuple[int, int, int]:
    """The slot before or after a gate's other end: old slot, and the markers on both sides."""
    a, b = fold.before[e], fold.after[e]
    if a == -2:
        _, _, _, c, p, *_ = mate
        a = -1 if c is None else fold.old(group, fold.line[e] - 1, c, p)
    if b == -2:
        *_, c, p = mate
        b = -1 if c is None else fold.old(group, fold.line[e] + 1, c, p)
    if a < 0 or b < 0:
        first = a < 0
    else:
        x, y = fold.patterns.score(pattern, fold.pattern[a]), fold.patterns.score(pattern, fold.pattern[b])
        first = x > y or x == y and mate_right
    line = fold.line[e]
    return (line - 1 if fold.gate[e] < 0 else line, a, e) if first else (line, e, b)


def _behind_first(fold: _Fold, group: _Group) -> tuple[int, int, int]:
    """The slot behind a map's first marker."""
    if group.head >= 0:
        return 0, group.head, fold.after[group.head]
    contig, pattern, next_contig, next_pattern = group.first
    e = fold.old(group, 1, contig, pattern)
    b = fold.after[e]
    if b == -2:
        b = -1 if next_contig is None else fold.old(group, 2, next_contig, next_pattern)
    return 1, e, b


def _best_place(fold: _Fold, best: _Best, own: _Group | None, keep: int, swap: int, groups: list[_Group]) -> tuple | None:
    """Score, group, whether flipped, old slot and marker before (-1 for a slot that is as it was) of the best place of a gate.

    Empty if no score is above 0; none if slots that aren't listed could be better.
    """
    if not fold.patterns.bits[keep][2]:
        return ()  # nothing known: no score is above 0
    slots = best.slots
    while best.at < len(slots):
        _, name, _, i = slots[best.at]
        if name not in fold.groups or i not in fold.groups[name].touched:
            break
        best.at += 1
    # (-score, group, flipped, position)
    top, marker = None, -1
    if best.at < len(slots):
        s, name, turned, i = slots[best.at]
        top = (-s, name, turned, i << fold.shift)
    for group in (groups if own is None else (own,)):
        for turned in (False, True) if own is None else (False,):
            place = (group.name, turned)
            if top is None:
                score, limit = 0, TAKEN
            else:
                score = -top[0]
                limit = top[3] if place == top[1:3] else TAKEN if place < top[1:3] else -1
                if limit < 0 and score == fold.perfect:
                    break
            slot, high = fold.new_slot(group, swap if turned else keep, score, limit)
            if slot >= 0:
                top = (-high, group.name, turned, int(group.pos[slot]))
                marker = slot
    if not best.all and best.at == len(slots):
        s, name, turned, i = slots[-1]
        if top is None or (*top[:3], top[3] >> fold.shift) > (-s, name, turned, i):
            return None
    if top is None:
        return ()
    group = fold.group(top[1])
    return -top[0], group, top[2], top[3] >> fold.shift, group.left[marker] if marker >= 0 else -1
