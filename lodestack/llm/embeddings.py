"""Near-duplicate embeddings: spherical k-means cells and blocked cosines.

Equal vectors become one class first, so a group of exact copies is one row.
k-means deals classes to cells; a class also visits cells whose centre is
nearly as close as its own. Cosines are products of blocks of bounded size,
and what a block gives back is a count for each row and links that join what
is connected, never all pairs.

A large group of near copies lies in one cell, close around its centre. Vectors
within half the threshold's angle of a centre are all linked with each other
without a product, and only vectors within one and a half times that angle can
link with them: such a group costs as its size, not as its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.components import connected_components
from lodestack.llm.rows import spread_join
from lodestack.plans.storage import Scratch


@dataclass(frozen=True)
class CellPlan:
    """How vectors are dealt and compared.

    threshold: the least cosine of a link.
    spread: a class visits each cell whose centre is at most ``slack`` less
        similar than its own cell's. A linked pair differs in its preference
        between two cells by ``deviation`` in its usual size; it is only missed
        if both lie on their own side by more than the slack, so 2 * slack is
        ``spread`` deviations. slack itself may be given; 2 makes the search
        exhaustive.
    cell_rows, block_rows: rows aimed at in a cell, and most in a block.
    fit_rows, fit_bytes, most_cells, rounds: bounds of the k-means fit; four
        rows for each cell, fit_rows at least. Up to most_cells * cell_rows
        classes (8 million), cells grow with the table and keep their size.
    merged: centres at least this similar become one, so that no group of near
        copies is dealt over many cells that all visit each other.
    """

    threshold: float = 0.95
    spread: float = 3.0
    slack: float | None = None
    cell_rows: int = 500
    block_rows: int = 1024
    fit_rows: int = 20_000
    fit_bytes: int = 1 << 28
    most_cells: int = 16_384
    rounds: int = 8
    merged: float = 0.9

    def slack_of(self, width: int) -> float:
        """The slack for vectors of ``width`` components."""
        deviation = math.sqrt((1 - self.threshold**2) * 2 / max(width, 1))
        return self.spread * deviation / 2 if self.slack is None else self.slack

    @property
    def tight(self) -> float:
        """Cosine to a centre from which on two vectors surely link."""
        return math.cos(math.acos(self.threshold) / 2 - 1e-6)

    @property
    def middle(self) -> float:
        """Cosine to a centre below which no vector links with a tight one."""
        return math.cos(min(1.5 * math.acos(self.threshold) + 1e-6, math.pi))


def unit_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v, h1, h2) of every row: the vector of length one in double
    precision and 128 bits of its hash. ``v`` is null for null and zero vectors,
    those with a null or non-finite component and those without a vec_id."""

    def unit(x: np.ndarray) -> np.ndarray | None:
        most = np.abs(x).max() if len(x) else 0
        if not 0 < most < np.inf:  # not so for NaN, which a null component is by now
            return None
        # Scaled by the largest component first: squares then neither overflow nor vanish. Adding zero makes -0 zero.
        x = x / most + 0.0
        return x / np.sqrt(np.add.reduce(x * x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            fine = np.asarray(lists.is_valid()) & np.asarray(batch.column(0).is_valid())
            found = [unit(flat[i:j]) if ok else None for i, j, ok in zip(ends, ends[1:], fine)]
            data = [None if x is None else x.tobytes() for x in found]
            hashes = [pa.array([None if x is None else xxhash.xxh64_intdigest(x, seed) - (1 << 63) for x in data], pa.int64()) for seed in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64())), *hashes], ["vec_id", "v", "h1", "h2"])

    return rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, v array<double>, h1 long, h2 long")


def fit_centres(classes: DataFrame, plan: CellPlan) -> np.ndarray:
    """Centres in single precision by spherical k-means over a bounded sample of
    classes, fitted in a task: the driver only gets the centres.

    The number of cells follows the number of classes; one cell needs no fit.
    Vectors of other lengths than the most common one share no cell with it.
    """
    widths = classes.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if widths is None:
        return np.zeros((0, 0), np.float32)
    width, n = widths["width"], widths["count"]
    cells = int(min(plan.most_cells, max(1, n // plan.cell_rows)))
    rows = min(max(plan.fit_rows, 4 * cells), plan.fit_bytes // (8 * width))
    share = min(1.0, 1.3 * rows / n) * 2.0**52

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Cut from the batches one by one: the sample is never held twice.
        parts = [batch.column(0).flatten().to_numpy().reshape(-1, width) for batch in batches]
        if parts:
            x = np.concatenate(parts)
            del parts
            centres = _centres(x, min(cells, len(x)), plan)
            yield pa.RecordBatch.from_arrays([pa.array(list(centres), pa.list_(pa.float32()))], ["c"])

    def fitted(sample: DataFrame, most: int) -> np.ndarray:
        # Ordered and limited rows are one partition, so one task fits them.
        chosen = sample.orderBy("h1", "h2").limit(most).select(F.col("v").cast("array<float>").alias("v"))
        found = chosen.mapInArrow(run, "c array<float>").toArrow().column("c")
        return np.concatenate([np.zeros(0, np.float32), *(c.flatten().to_numpy() for c in found.chunks)]).reshape(-1, width)

    alike = classes.filter(F.size("v") == width)
    centres = fitted(alike.filter(F.shiftrightunsigned(F.xxhash64("h1"), 12) <= share), int(rows))
    return centres if len(centres) else fitted(alike, 1)  # a small table may have no hash that low


def _centres(x: np.ndarray, cells: int, plan: CellPlan) -> np.ndarray:
    """Centres of at most ``cells`` cells; no two are ``plan.merged`` similar
    before they move once more."""
    random = np.random.default_rng(7)
    centres = x[random.choice(len(x), cells, replace=False)]
    for _ in range(plan.rounds if cells > 1 else 1):
        centres = _moved(x, centres)
    kept, n = np.empty_like(centres), 0
    for start in range(0, len(centres), 256):
        block = centres[start : start + 256]
        if n:
            block = block[(block @ kept[:n].T).max(axis=1) < plan.merged]
        alike = block @ block.T >= plan.merged
        mine: list[int] = []
        for i in range(len(block)):
            if not alike[i, mine].any():
                mine.append(i)
        kept[n : n + len(mine)] = block[mine]
        n += len(mine)
    return _moved(x, kept[:n])


def _moved(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Centres moved to the mean direction of their vectors; empty ones stay."""
    step = max(1, (1 << 22) // len(centres))
    own = np.concatenate([(x[i : i + step] @ centres.T).argmax(axis=1) for i in range(0, len(x), step)])
    sums = np.zeros_like(centres)
    np.add.at(sums, own, x)
    norms = np.linalg.norm(sums, axis=1)
    return np.where(norms[:, None] > 1e-6, sums / np.maximum(norms, 1e-6)[:, None], centres)


def assign(classes: DataFrame, centres: np.ndarray, plan: CellPlan) -> DataFrame:
    """(rep, n, v, home, near, visits, visits_near): a class's cell, its cosine
    to the centre, and the same of the cells it also visits.

    ``home`` is -1 less the vector's length if that is not the centres' length,
    so that vectors of one other length share one cell.
    """
    sent = classes.sparkSession.sparkContext.broadcast(centres)  # at most most_cells vectors
    slack = plan.slack_of(centres.shape[1])
    fields = [("rep", pa.int64()), ("n", pa.int64()), ("v", pa.list_(pa.float64())), ("home", pa.int32()), ("near", pa.float64()), ("visits", pa.list_(pa.int32())), ("visits_near", pa.list_(pa.float64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value.astype(np.float64)
        centres /= np.maximum(np.linalg.norm(centres, axis=1), 1e-9)[:, None]
        step = max(1, min(4096, (1 << 22) // max(1, len(centres))))
        for batch in batches:
            home, near, visits, visits_near = [], [], [], []
            for start in range(0, batch.num_rows, step):
                rows = batch.column(2).slice(start, step).to_pylist()
                same = [i for i, v in enumerate(rows) if centres.size and len(v) == centres.shape[1]]
                cell, best = np.array([-1 - len(v) for v in rows]), np.zeros(len(rows))
                others: list[np.ndarray] = [np.empty(0, np.int64)] * len(rows)
                sims = list(others)
                if same:
                    s = np.array([rows[i] for i in same]) @ centres.T
                    cell[same] = own = s.argmax(axis=1)
                    best[same] = top = s[np.arange(len(s)), own]
                    s[np.arange(len(s)), own] = -9
                    for i, row, t in zip(same, s, top):
                        others[i] = np.flatnonzero(row >= t - slack)
                        sims[i] = row[others[i]]
                home += cell.tolist()
                near += best.tolist()
                visits += [x.tolist() for x in others]
                visits_near += [x.tolist() for x in sims]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, t) for x, (_, t) in zip((home, near, visits, visits_near), fields[3:]))], [f for f, _ in fields])

    return classes.select("rep", "n", "v").mapInArrow(run, "rep long, n long, v array<double>, home int, near double, visits array<int>, visits_near array<double>")


_PRODUCT = "array<struct<kind:int,i:int,j:int,side:int>>"


def deal(assigned: DataFrame, plan: CellPlan) -> DataFrame:
    """Rows (cell, kind, i, j, side, rep, n, v, home, visits) of every product of blocks.

    A cell's rows are dealt to blocks by a hash: its loose members, its tight
    members, those members that may link with tight ones, and visitors. Kind 0
    is loose members with each other, i <= j; kind 1 loose members and
    visitors; kind 2 tight members and the members in between; kind 3 tight
    members and the visitors in between. ``side`` tells which block of the
    product a row belongs to.
    """
    seat = F.concat(F.array(F.struct(F.col("home").alias("cell"), F.col("near").alias("near"))), F.transform("visits", lambda c, i: F.struct(c.alias("cell"), F.get("visits_near", i).alias("near"))))
    seats = assigned.select("rep", "n", "v", "home", "visits", F.explode(seat).alias("s")).select("*", "s.cell", "s.near")
    member = F.col("cell") == F.col("home")
    tight, middle = member & (F.col("near") >= plan.tight), F.col("near") >= plan.middle
    blocks_of = lambda which: F.ceil(F.sum(which.cast("long")) / plan.block_rows).cast("int")
    blocks = seats.groupBy("cell").agg(blocks_of(member & ~tight).alias("loose"), blocks_of(tight).alias("tight"), blocks_of(member & ~tight & middle).alias("between"), blocks_of(~member).alias("guests"), blocks_of(~member & middle).alias("between_guests"))
    seats = seats.join(F.broadcast(blocks), "cell")  # a row for each cell: bounded by most_cells
    spot = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(n, F.lit(1))).cast("int")
    none = F.array().cast(_PRODUCT)

    def products(kind: int, side: int, own: str, other: str) -> Column:
        """This row's block of ``own`` blocks with every block of ``other`` ones."""
        mine = spot(F.col(own))
        pair = lambda k: F.struct(F.lit(kind).alias("kind"), (mine if side == 0 else k).alias("i"), (k if side == 0 else mine).alias("j"), F.lit(side).alias("side"))
        return F.when(F.col(other) > 0, F.transform(F.sequence(F.lit(0), F.col(other) - 1), pair)).otherwise(none)

    b = spot(F.col("loose"))
    pair = lambda i, j, side: F.struct(F.lit(0).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    up = F.transform(F.sequence(b, F.col("loose") - 1), lambda j: pair(b, j, 0))
    down = F.when(b > 0, F.transform(F.sequence(F.lit(0), b - 1), lambda i: pair(i, b, 1))).otherwise(none)
    loose = F.concat(up, down, products(1, 0, "loose", "guests"), F.when(middle, products(2, 1, "between", "tight")).otherwise(none))
    bound = F.concat(products(2, 0, "tight", "between"), products(3, 0, "tight", "between_guests"))
    guest = F.concat(products(1, 1, "guests", "loose"), F.when(middle, products(3, 1, "between_guests", "tight")).otherwise(none))
    where = F.when(tight, bound).when(member, loose).otherwise(guest)
    return seats.select("cell", "rep", "n", "v", "home", "visits", F.explode(where).alias("p")).select("cell", "p.kind", "p.i", "p.j", "p.side", "rep", "n", "v", "home", "visits")


def tight_links(assigned: DataFrame, plan: CellPlan) -> DataFrame:
    """(a, b, links) as from ``compare``, of tight members with each other: all
    of a cell's are linked, so a sum and a least id for each cell say it all."""
    rows = assigned.filter(F.col("near") >= plan.tight).select("rep", "n", "home")
    cells = rows.groupBy("home").agg(F.sum("n").alias("all"), F.min("rep").alias("least"))
    each = rows.join(F.broadcast(cells), "home")  # bounded by most_cells
    counts = each.select(F.col("rep").alias("a"), F.col("rep").alias("b"), (F.col("all") - F.col("n")).alias("links"))
    return counts.unionAll(each.filter("rep <> least").select("rep", "least", F.lit(0).cast("long")))


def compare(table: pa.Table, threshold: float) -> pa.Table:
    """One product of blocks: (a, b, links): for a = b, how many vectors of
    other classes the class ``a`` links to here; else a link."""
    cell = table.column("cell")[0].as_py()
    kind, i, j = (table.column(c)[0].as_py() for c in ("kind", "i", "j"))
    within = kind == 0 and i == j
    side = table.column("side").to_numpy()
    rep, n, home = (table.column(c).to_numpy() for c in ("rep", "n", "home"))
    v = np.array(table.column("v").to_pylist())
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if within:
        right = left
    if not len(left) or not len(right):
        return _result([], [], [])
    hit = v[left] @ v[right].T >= threshold
    if within:
        np.fill_diagonal(hit, False)
    elif kind in (1, 3):
        # The pair also meets in the visitor's own cell if the member visits it:
        # it counts where the cell's number is smaller.
        visits = table.column("visits").to_pylist()
        for other in np.unique(home[right]):
            if other < cell:
                guests = home[right] == other
                there = np.array([other in visits[k] for k in left])
                hit[np.ix_(there, guests)] = False
    counts: dict[int, int] = {}
    for rows, sums in ((left, hit @ n[right]), (right, n[left] @ hit)):
        for k in np.flatnonzero(sums):
            counts[rep[rows[k]]] = counts.get(rep[rows[k]], 0) + int(sums[k])
        if within:
            break
    a, b = _forest(hit, rep[left], rep[right], within)
    ids = list(counts)
    return _result(ids + a, ids + b, list(counts.values()) + [0] * len(a))


def _forest(hit: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[list[int], list[int]]:
    """Links that join whatever ``hit`` connects, fewer than there are rows."""
    a, b = [], []
    rows, columns = hit.any(axis=1), hit.any(axis=0)
    while rows.any():
        start = int(rows.argmax())
        todo_rows, todo_columns = [start], []
        rows[start] = False
        if same:
            columns[start] = False
        while todo_rows or todo_columns:
            if todo_rows:
                r = todo_rows.pop()
                found = np.flatnonzero(hit[r] & columns)
                columns[found] = False
                a += [int(left[r])] * len(found)
                b += right[found].tolist()
                if same:
                    rows[found] = False
                    todo_rows += found.tolist()
                else:
                    todo_columns += found.tolist()
            else:
                c = todo_columns.pop()
                found = np.flatnonzero(hit[:, c] & rows)
                rows[found] = False
                a += [int(right[c])] * len(found)
                b += left[found].tolist()
                todo_rows += found.tolist()
    return a, b


def _result(a: list[int], b: list[int], links: list[int]) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(links, pa.int64())})


def near_duplicates(rows: DataFrame, plan: CellPlan = CellPlan()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``rows`` (vec_id,
    embedding).

    Vectors that have no direction (see unit_vectors) link with nothing and
    are their own component. Rows with a null vec_id come back with no link, no
    component and not kept. Rows of equal vec_id count as vectors of their own,
    each with the links of its own vector; other columns are not read; an empty
    table gives an empty result.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "embeddings")
    units = scratch.table(unit_vectors(rows), "units")
    equal = units.filter("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    # A class's number, not its smallest vec_id, names it: two classes may share that.
    classes = scratch.table(equal.withColumn("rep", F.monotonically_increasing_id()), "classes")
    centres = fit_centres(classes, plan)
    assigned = scratch.table(assign(classes, centres, plan), "cells")
    threshold = plan.threshold
    found = deal(assigned, plan).groupBy("cell", "kind", "i", "j").applyInArrow(lambda t: compare(t, threshold), "a long, b long, links long")
    found = scratch.table(found.unionAll(tight_links(assigned, plan)), "found")
    links = found.filter("a = b").groupBy(F.col("a").alias("_c")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("a <> b").select("a", "b"), scratch)
    named = classes.select("rep", "h1", "h2", "least", "n").join(links, F.col("rep") == F.col("_c"), "left").join(parts, F.col("rep") == F.col("node"), "left")
    named = scratch.table(named.select("h1", "h2", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("part")), "named")
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    told = spread_join(named, least, ["part"], F.col("h1")).select("h1", "h2", "n_links", "component_id")
    # Copies of one vector may be a third of all rows.
    out = spread_join(units.filter("v is not null").select("vec_id", "h1", "h2"), told, ["h1", "h2"], F.col("vec_id")).select("vec_id", "n_links", "component_id")
    out = out.unionAll(units.filter("v is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
