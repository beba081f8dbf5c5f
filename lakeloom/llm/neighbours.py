"""Nearest neighbours by inner product, over a graph built by NN-descent.

Nodes are numbered along pivots, so that a unit of numbers is a neighbourhood. Lists of links travel
as one value a node; a task has the lists of a unit, and each vector that they name comes to it once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import arrow_map, batch
from lakeloom.session import Scratch

EVERY, NEAREST = 20, 20
#: First graph: rounds of sorting nodes along pivots, and pivots a round.
SEED_ROUNDS, PIVOTS = 4, 128
#: Nodes of a unit, whose lists one task joins, and queries of one.
UNIT, ASKED = 4_096, 512
#: Descents go on until at most this share of the graph's links is new, or so many rounds were made.
SETTLED, DESCENTS = 0.01, 12
#: Rounds of search.
SEARCHES = 4
#: Lengths differ at most twofold in a band, unless that took more than BANDS.
BANDS = 32
#: Proposals of one node for each of its neighbours in a descent, and about so many are put in order at once.
PROPOSED, AT_ONCE = 16, 2_000_000

LINK = np.dtype([("b", "<i8"), ("s", "<f4"), ("new", "u1")])
LISTS = "node long, links binary"
#: A link proposed to the node with that place in its unit; what one unit proposes to the nodes of another is one value.
PROPOSAL = np.dtype([("place", "<u2"), ("b", "<i8"), ("s", "<f4")])
PROPOSALS = "part long, proposed binary"
#: A node's place in its unit; rows are told to parts in batches of about so many bytes.
PLACE, ANSWERED = np.dtype("<u2"), 4 << 20
#: Links that may have been there before, said for the whole value.
TURNED = f"{PROPOSALS}, new int"
#: Below all scores.
LEAST = -1e9
#: A node in a query's beam.
SEEN = np.dtype([("node", "<i8"), ("s", "<f4"), ("band", "u1"), ("expanded", "u1")])
BEAMS = "part long, q long, beam binary"


def degree(nodes: int) -> int:
    """Neighbours kept for a node and reverse ones joined with them: 4 for each doubling of the nodes, 32 at least."""
    return max(32, round(4 * math.log2(max(2, nodes))))


def block_size(nodes: int) -> int:
    """Nodes compared with each other in the first graph: four times the root of all, 2,048 at most."""
    return min(2_048, math.ceil(4 * math.sqrt(nodes)))


def entry_count(nodes: int) -> int:
    """Nodes of a band that every query is compared with: the root of its nodes and 8, 16,384 at most."""
    return min(16_384, 8 + math.isqrt(nodes))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (array<double>): without null or zero vectors, nor those that hold a null or no finite number."""
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id is not null and vec is not null and size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("vec", lambda x: x != 0))


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(dtype) if n else np.zeros((0, 0), dtype=dtype)


def _packed(b: pa.Array) -> np.ndarray:
    """Shapes as rows of a matrix: a scale, the added coordinate, and the others as bytes in units of that scale."""
    rows = np.frombuffer(b"".join(b.to_pylist()), dtype=np.uint8).reshape(len(b), -1)
    head = np.ascontiguousarray(rows[:, :8]).view(np.float32)
    return np.hstack([rows[:, 8:].view(np.int8) * head[:, :1], head[:, 1:]])


def _shape(nodes: DataFrame) -> DataFrame:
    """node, band and shape: the vector scaled to the longest of its band, with a coordinate that makes all alike in length.

    Products of shapes order the neighbours in a band as on a sphere. They serve to build and walk the
    graph; the scores returned are those of the original vectors. A band holds like lengths and each
    vector has a scale of its own, so that no long vector takes the others' digits away.
    """
    largest = F.array_max(F.transform("vec", F.abs))
    # divided by its largest value first, as squares could overflow
    square = F.aggregate(F.transform("vec", lambda x: x / largest), F.lit(0.0), lambda a, x: a + x * x)
    known = nodes.withColumn("length", F.log2(largest) + F.log2(square) / 2)
    row = known.agg(F.max("length"), F.min("length")).first()
    longest, shortest = (x or 0.0 for x in row)
    width = max(1.0, (longest - shortest) / (BANDS - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            band = np.floor((longest - b.column("length").to_numpy()) / width).clip(0, BANDS - 1).astype(np.int64)
            v = _matrix(b.column("vec"))
            if len(v):
                # powers of two taken off in halves, as 2**-top alone could overflow
                half = np.exp2((band * width - longest) / 2)[:, None]
                v = v * half * half
            rest = np.sqrt(np.maximum(0, 1 - (v * v).sum(1))) if len(v) else np.zeros(0)
            scale = np.abs(v).max(1) / 127 if len(v) else np.zeros(0)
            scale = np.maximum(scale.astype(np.float32), np.float32(1e-37))
            whole = np.rint(v / scale[:, None]).clip(-127, 127).astype(np.int8) if len(v) else v
            head = np.stack([scale, rest.astype(np.float32)], axis=1)
            yield batch(node=b.column("node"), band=pa.array(band), shape=([h.tobytes() + w.tobytes() for h, w in zip(head, whole, strict=True)], pa.binary()))

    return arrow_map(known.select("node", "vec", "length"), run, "node long, band long, shape binary")


def band_sizes(shapes: DataFrame) -> dict[int, int]:
    """Nodes of each band, at most BANDS rows."""
    return {r["band"]: r["count"] for r in shapes.groupBy("band").count().orderBy("band").collect()}


def numbered(rows: DataFrame, by: list[str], name: str, scratch: Scratch) -> DataFrame:
    """rows and `number`, their place from 0 in the order of `by`, which tells all rows apart.

    Sorted in ranges; only the ranges' sizes, one for each partition of a shuffle, go to all tasks.
    """
    ranges = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    kept = scratch.save(name, ranges.withColumn("__at", F.monotonically_increasing_id())).withColumn("__range", F.shiftright("__at", 33))
    sizes = kept.groupBy("__range").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__range", before.alias("__before"))
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(starts), "__range").withColumn("number", F.col("__before") + within).drop("__at", "__range", "__before")


def _unpacked(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The row that each packed item is of, and the items."""
    held = column.to_pylist()
    items = np.frombuffer(b"".join(held), dtype=dtype)
    return np.repeat(np.arange(len(held)), [len(h) // dtype.itemsize for h in held]), items


def _starts(owner: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, dtype=np.int64)


def _lists(owner: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Sorted owners and the packed items of each."""
    starts = _starts(owner)
    ends = np.concatenate([starts, [len(owner)]]).astype(np.int32) * np.int32(items.dtype.itemsize)
    packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(items.tobytes())])
    return owner[starts], packed


def _places(owner: np.ndarray) -> np.ndarray:
    starts = _starts(owner)
    return np.arange(len(owner)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(owner)]])))


def _best(owner: np.ndarray, links: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The best `most` different links of each owner, sorted; a link that was there before isn't new."""
    if not len(owner):
        return owner, links
    # by owner and target in one integer, where it holds both
    base, other = owner.min(), links["b"].min()
    width = int(links["b"].max() - other) + 1
    if (int(owner.max() - base) + 1) * width < 1 << 61:
        order = np.argsort(((owner - base) * width + (links["b"] - other)) * 2 + links["new"])
    else:
        order = np.lexsort((links["new"], links["b"], owner))
    owner, links = owner[order], links[order]
    first = np.ones(len(owner), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (links["b"][1:] != links["b"][:-1])
    owner, links = owner[first], links[first]
    # then by owner, counted from 0, and nearness
    bits = links["s"].copy().view(np.int32)
    nearness = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64)
    turn = np.cumsum(np.concatenate([[0], owner[1:] != owner[:-1]])).astype(np.int64)
    order = np.argsort((turn << 32) - nearness, kind="stable")
    owner, links = owner[order], links[order]
    keep = _places(owner) < most
    return owner[keep], links[keep]


def _links(a: np.ndarray, b: np.ndarray, s: np.ndarray, new: int | np.ndarray = 1) -> tuple[np.ndarray, np.ndarray]:
    links = np.zeros(len(a), dtype=LINK)
    links["b"], links["s"], links["new"] = b, s, new
    return a, links


def unit(node: str) -> Column:
    return F.expr(f"{node} div {UNIT}").alias("part")


def merged(lists: DataFrame, most: int, proposals: DataFrame | None = None) -> DataFrame:
    """The best links of each node out of all its lists, and of what units propose to its unit. Both are cut a few at a time,
    so that a node in very many lists is no burden."""

    def few(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Proposals are long values, lists short ones."""
        size = np.cumsum(pa.compute.binary_length(b.column("proposed")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // (PROPOSAL.itemsize * AT_ONCE)
        starts = _starts(size)
        for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows], strict=True):
            yield b.slice(begin, end - begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, links = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=LINK)
        for b in (part for whole in batches for part in few(whole)):
            lists, proposed = b.filter(b.column("proposed").is_null()), b.filter(b.column("proposed").is_valid())
            row, items = _unpacked(lists.column("links"), LINK)
            at, offers = _unpacked(proposed.column("proposed"), PROPOSAL)
            fresh = proposed.column("new").to_numpy()[at]
            to, offered = _links(proposed.column("part").to_numpy()[at] * UNIT + offers["place"], offers["b"], offers["s"], fresh)
            owner, links = _best(np.concatenate([owner, lists.column("node").to_numpy()[row], to]), np.concatenate([links, items, offered]), most)
            if len(owner) and (cut := int(np.searchsorted(owner, b.column("from")[-1].as_py()))):
                node, packed = _lists(owner[:cut], links[:cut])
                yield batch(node=pa.array(node), links=packed)
                owner, links = owner[cut:], links[cut:]
        if len(owner):
            node, packed = _lists(owner, links)
            yield batch(node=pa.array(node), links=packed)

    rows = lists.select(unit("node"), "node", "links", F.lit(None).cast("binary").alias("proposed"), F.lit(1).alias("new"), F.col("node").alias("from"))
    if proposals is not None:
        new = F.col("new") if "new" in proposals.columns else F.lit(1)
        rows = rows.unionByName(proposals.withColumns({"new": new, "from": F.col("part") * UNIT}), allowMissingColumns=True)
    return arrow_map(rows.repartition("part").sortWithinPartitions("from"), run, LISTS)


def placed(shapes: DataFrame, key: str, r: int) -> DataFrame:
    """shapes and `place`, along a chain of pivots; these are a bounded sample that comes to the driver."""
    rows = shapes.orderBy(F.xxhash64(key, F.lit(r)), key).limit(PIVOTS).select("shape").toArrow()
    pivots = _packed(rows["shape"].combine_chunks()) if rows.num_rows else np.zeros((0, 1), dtype=np.float32)
    chain, left = [], list(range(len(pivots)))
    while left:  # each pivot next to one near it
        at = max(left, key=lambda k: float(pivots[k] @ pivots[chain[-1]])) if chain else left[0]
        chain.append(at)
        left.remove(at)
    pivots = pivots[chain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = _packed(b.column("shape")) @ pivots.T
                place = s.argmax(1) + 1 / (2 + np.exp(np.clip(s.max(1), -50, 50))).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place)], [*b.schema.names, "place"])

    kept = shapes.select(key, "band", "shape")
    return arrow_map(kept, run, f"{key} long, band long, shape binary, place double")


def first_graph(shapes: DataFrame, sizes: dict[int, int], scratch: Scratch) -> DataFrame:
    """node and links: nodes that lie next to each other when sorted by their nearest of some pivots.

    Blocks are runs of that order within a band, so a dense region is only cut into more of them, and
    depend on the nodes alone, whatever the number of partitions is.
    """
    nodes = sum(sizes.values())
    most, size = max(1, degree(nodes) // 2), block_size(nodes)

    def compare(block: pa.Table) -> pa.Table:
        block = block.sort_by("node")
        ids = block["node"].to_numpy()
        v = _packed(block["shape"].combine_chunks())
        s = v @ v.T
        np.fill_diagonal(s, -np.inf)
        k = min(most, len(ids) - 1)
        if k < 1:
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.binary())})
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        node, packed = _lists(*_best(*_links(np.repeat(ids, k), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel()), k))
        return pa.table({"node": pa.array(node), "links": packed})

    out = None
    for r in range(SEED_ROUNDS):
        order = shapes.withColumn("number", F.col("node")) if not r else numbered(placed(shapes, "node", r), ["band", "place", "node"], "order", scratch)
        at, first = F.lit(None).cast("long"), 0
        for band, held in sizes.items():  # at most BANDS
            blocks = max(1, held // size)
            at = F.when(F.col("band") == band, F.least(F.expr(f"(number - {first}) div {size}"), F.lit(blocks - 1)) + (band << 40)).otherwise(at)
            first += held
        lists = scratch.save(f"seeds{r}", order.select("node", "shape", at.alias("block")).groupBy("block").applyInArrow(compare, LISTS))
        out = lists if out is None else out.unionByName(lists)
    return scratch.save("graph", merged(out, degree(nodes)))


def turned(graph: DataFrame, most: int) -> DataFrame:
    """The nearest reverse links of each node, so that a node that is everybody's neighbour joins no more than others.

    What a task turns for the nodes of a unit is one value of new links and one of others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, links = _unpacked(b.column("links"), LINK)
            back = links.copy()
            back["b"] = b.column("node").to_numpy()[row]
            node, back = _best(links["b"], back, most)
            for new in (0, 1):
                to, held = node[back["new"] == new], back[back["new"] == new]
                offers = np.zeros(len(to), dtype=PROPOSAL)
                offers["place"], offers["b"], offers["s"] = to % UNIT, held["b"], held["s"]
                part, packed = _lists(to // UNIT, offers)
                yield batch(part=pa.array(part), proposed=packed, new=pa.array(np.full(len(part), new, dtype=np.int32)))

    return merged(graph.limit(0), most, arrow_map(graph, run, TURNED))


def gathered(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """part, unit, places and rows: of the nodes that a part's lists name, once, those of a unit as one value.

    Wanted has part, items (packed numbers), table has node, row (bytes, all of one width). What a batch of lists names of a
    unit is one value, too: rows for each pair of part and node grew with the square of the nodes until a part named them all.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, items = _unpacked(b.column("items"), np.dtype("<i8"))
            part = b.column("part").to_numpy()[row]
            for p in np.unique(part).tolist():
                node = np.unique(items[part == p])
                of, places = _lists(node // UNIT, (node % UNIT).astype(PLACE))
                yield batch(unit=pa.array(of), part=pa.array(np.full(len(of), p)), value=places)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows as values that begin with their place; they come before all that is asked of their unit."""
        for b in batches:
            node = b.column("node").to_numpy()
            value = [at.tobytes() + row for at, row in zip((node % UNIT).astype(PLACE), b.column("row").to_pylist(), strict=True)]
            yield batch(unit=pa.array(node // UNIT), part=pa.array(np.full(len(node), -1)), value=(value, pa.binary()))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, by, rows, asked, out, size = None, None, [], [], [], 0

        def told() -> Iterator[tuple[int, int, bytes, bytes]]:
            nonlocal rows
            if asked:
                if isinstance(rows, list):  # of this unit nothing was asked so far
                    rows = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1) if rows else np.zeros((0, PLACE.itemsize), dtype=np.uint8)
                    rows = rows[np.argsort(np.ascontiguousarray(rows[:, : PLACE.itemsize]).view(PLACE).ravel())]
                places = np.ascontiguousarray(rows[:, : PLACE.itemsize]).view(PLACE).ravel()
                at = np.flatnonzero(np.isin(places, np.frombuffer(b"".join(asked), dtype=PLACE)))
                yield by, of, places[at].tobytes(), rows[at, PLACE.itemsize :].tobytes()

        def put() -> pa.RecordBatch:
            part, of, places, rows = zip(*out, strict=True)
            return batch(part=pa.array(part), unit=pa.array(of), places=(places, pa.binary()), rows=(rows, pa.binary()))

        for b in batches:
            unit, part, value = b.column("unit").to_numpy(), b.column("part").to_numpy(), b.column("value").to_pylist()
            first = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (part[1:] != part[:-1])])).tolist() if len(unit) else []
            for i, j in zip(first, [*first[1:], len(unit)], strict=True):
                if (unit[i], part[i]) != (of, by):
                    for x in told():
                        out.append(x)
                        size += len(x[-1])
                    asked = []
                    if unit[i] != of:
                        rows = []
                    of, by = int(unit[i]), int(part[i])
                    if size > ANSWERED:
                        yield put()
                        out, size = [], 0
                (rows if by < 0 else asked).extend(value[i:j])
        out.extend(told())
        if out:
            yield put()

    shape = "unit long, part long, value binary"
    rows = arrow_map(table.select("node", "row"), own, shape).unionByName(arrow_map(wanted.select("part", "items"), ask, shape))
    return arrow_map(rows.repartition("unit").sortWithinPartitions("unit", "part"), answer, "part long, unit long, places binary, rows binary")


def _given(right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that a part was given, in order, and their rows as a matrix of bytes."""
    right = right.sort_by("unit")
    row, places = _unpacked(right["places"].combine_chunks(), PLACE)
    node = right["unit"].to_numpy()[row] * UNIT + places
    rows = np.frombuffer(b"".join(right["rows"].to_pylist()), dtype=np.uint8)
    return node, rows.reshape(len(node), -1) if len(node) else np.zeros((0, 0), dtype=np.uint8)


def _shapes_of(rows: np.ndarray, head: int) -> tuple[np.ndarray, pa.Array]:
    """The first bytes of rows, and the shapes that follow."""
    n, width = rows.shape[0], max(0, rows.shape[1] - head)
    ends = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    shapes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows[:, head:].tobytes())])
    return np.ascontiguousarray(rows[:, :head]), shapes


def _meet(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of the lists of a unit and the vectors that they name: the neighbours of one node propose each other, if near
    enough to be of use; those that both were there before have met already. A row for each unit proposed to."""
    none = pa.table({"part": pa.array([], pa.int64()), "proposed": pa.array([], pa.binary())})
    if not left.num_rows or not right.num_rows:
        return none
    right = right.sort_by("node")
    ids, v = right["node"].to_numpy(), _packed(right["shape"].combine_chunks())
    worst = right["worst"].to_numpy()
    row, links = _unpacked(left["links"].combine_chunks(), LINK)
    owner = left["node"].to_numpy()[row]
    order = np.lexsort((1 - links["new"].astype(np.int8), links["b"], owner))
    owner, b, fresh = owner[order], links["b"][order], links["new"][order] > 0
    once = np.ones(len(owner), dtype=bool)
    once[1:] = (owner[1:] != owner[:-1]) | (b[1:] != b[:-1])
    owner, b, fresh = owner[once], np.searchsorted(ids, b[once]), fresh[once]
    starts = _starts(owner).tolist()
    most = right["most"][0].as_py()
    found, held, parts, packed = [], 0, [], []

    def put() -> None:
        a, links = _links(*(np.concatenate([f[k] for f in found]) for k in range(3)))
        a, links = _best(a, links, most)
        offers = np.zeros(len(a), dtype=PROPOSAL)
        offers["place"], offers["b"], offers["s"] = ids[a] % UNIT, ids[links["b"]], links["s"]
        part, lists = _lists(ids[a] // UNIT, offers)
        parts.append(part)
        packed.append(lists)

    for i, j in zip(starts, [*starts[1:], len(owner)], strict=True):
        new = fresh[i:j]
        if j - i < 2 or not new.any():
            continue
        at = b[i:j]
        s = v[at] @ v[at].T
        np.fill_diagonal(s, -np.inf)
        if not new.all():
            old = np.flatnonzero(~new)
            s[np.ix_(old, old)] = -np.inf
        k = min(PROPOSED, j - i - 1)
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(s, top, 1)
        x, y = np.nonzero(value > worst[at][:, None])
        found.append((at[x], at[top[x, y]], value[x, y]))
        held += len(x)
        if held > AT_ONCE:
            put()
            found, held = [], 0
    if found:
        put()
    if not parts:
        return none
    return pa.table({"part": pa.chunked_array([pa.array(n) for n in parts]), "proposed": pa.chunked_array(packed)})


def descend(graph: DataFrame, shapes: DataFrame, nodes: int, scratch: Scratch) -> DataFrame:
    """One round of NN-descent: neighbours and reverse neighbours of a node are joined with each other.

    A node's worst score comes along with its vector, so only what improves a list is proposed, and what
    a task proposes to a node is cut to what its list holds.
    """
    most = degree(nodes)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, links = _unpacked(b.column("links"), LINK)
            starts = _starts(row)
            full = np.diff(np.concatenate([starts, [len(row)]])) >= most
            worst = np.where(full, np.minimum.reduceat(links["s"], starts) if len(starts) else np.zeros(0), LEAST)
            yield batch(node=b.column("node"), worst=([x.tobytes() for x in worst.astype(np.float32)], pa.binary()))

    def wants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, links = _unpacked(b.column("links"), LINK)
            part = b.column("node").to_numpy()[row] // UNIT
            order = np.argsort(part, kind="stable")
            part, items = _lists(part[order], links["b"][order])
            yield batch(part=pa.array(part), items=items)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        node, rows = _given(right)
        worst, shape = _shapes_of(rows, 4)
        return _meet(left, pa.table({"node": node, "shape": shape, "worst": worst.view("<f4").ravel(), "most": np.full(len(node), most)}))

    around = scratch.save("around", graph.unionByName(turned(graph, most)))
    known = shapes.select("node", "shape").join(arrow_map(graph, floors, "node long, worst binary"), "node", "left")
    known = known.select("node", F.concat(F.coalesce("worst", F.lit(bytearray(np.float32(LEAST).tobytes()))), "shape").alias("row"))
    named = gathered(arrow_map(around, wants, "part long, items binary"), known)
    proposals = around.groupBy(unit("node")).cogroup(named.groupBy("part")).applyInArrow(meet, PROPOSALS)
    met = arrow_map(graph, _met, LISTS)
    return scratch.save("graph", merged(met, most, proposals))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, links = _unpacked(b.column("links"), LINK)
        links = links.copy()
        links["new"] = 0
        yield batch(node=b.column("node"), links=_lists(row, links)[1])


def fresh_share(graph: DataFrame) -> float:
    """The share of the graph's links that are new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links = _unpacked(b.column("links"), LINK)[1]
            yield batch(new=pa.array([int(links["new"].sum())]), links=pa.array([len(links)]))

    row = arrow_map(graph, run, "new long, links long").agg(F.sum("new"), F.sum("links")).first()
    return (row[0] or 0) / max(1, row[1] or 0)


def entries(asked: DataFrame, shapes: DataFrame, sizes: dict[int, int], most: int) -> DataFrame:
    """part, q, beam: in every band, the best for each query of a sample of the band's nodes, which goes to all tasks."""
    order = Window.partitionBy("band").orderBy(F.xxhash64("node"), "node")
    count = F.lit(0)
    for band, held in sizes.items():
        count = F.when(F.col("band") == band, entry_count(held)).otherwise(count)
    rows = shapes.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= count).drop("turn").toArrow()
    of, ids = rows["band"].to_numpy(), rows["node"].to_numpy()
    held = rows["shape"].combine_chunks() if rows.num_rows else pa.array([], pa.binary())
    shared = shapes.sparkSession.sparkContext.broadcast([(k, ids[of == k], held.filter(pa.array(of == k)).to_pylist()) for k in sorted(sizes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = [(k, ids, _packed(pa.array(held, pa.binary()))[:, :-1]) for k, ids, held in shared.value]
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                b = whole.slice(at, 1_000)
                mine, n, found = _packed(b.column("shape"))[:, :-1], b.num_rows, []
                for k, ids, v in bands:
                    s = mine @ v.T
                    kept = min(most, len(ids))
                    top = np.argpartition(-s, kept - 1, axis=1)[:, :kept]
                    seen = np.zeros(top.shape, dtype=SEEN)
                    seen["node"], seen["s"], seen["band"] = ids[top], np.take_along_axis(s, top, 1), k
                    found.append(seen)
                beams = np.concatenate(found, axis=1)
                packed = _lists(np.repeat(np.arange(n), beams.shape[1]), beams.ravel())[1]
                yield batch(part=b.column("part"), q=b.column("q"), beam=packed)

    return arrow_map(asked, run, BEAMS)


def _turn(beam: np.ndarray, expanded: int) -> np.ndarray:
    """Which nodes of a beam are expanded next: in each band the best that were not yet."""
    open_ = np.flatnonzero(beam["expanded"] == 0)
    order = open_[np.lexsort((beam["node"][open_], -beam["s"][open_], beam["band"][open_]))]
    return order[_places(beam["band"][order]) < expanded]


def search(queries: DataFrame, graph: DataFrame, shapes: DataFrame, sizes: dict[int, int], scratch: Scratch) -> DataFrame:
    """part, q and beam: the best nodes of each query node in each band, by greedy search of the graph.

    In its own band a search begins at the node itself, in every band at the best of a sample. Each
    round expands the best nodes of a query's beam that were not expanded yet: their neighbours,
    in both directions, are scored and the best kept. A query's product leaves the added coordinate out.
    Queries are dealt to parts; each vector that a part's queries reach comes to it once.
    """
    nodes = sum(sizes.values())
    most = degree(nodes)
    wide, expanded = 2 * most, max(8, most // 4)

    def targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, links = _unpacked(b.column("links"), LINK)
            node, packed = _lists(b.column("node").to_numpy()[row], links["b"])
            yield batch(node=pa.array(node), items=packed)

    links = scratch.save("links", arrow_map(merged(graph.unionByName(turned(graph, 2 * most)), 3 * most), targets, "node long, items binary"))
    asked = numbered(queries.join(shapes, queries["q"] == shapes["node"]).select("q", "shape"), ["q"], "parts", scratch)
    asked = asked.select(F.expr(f"number div {ASKED}").alias("part"), "q", "shape")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            beams = [np.frombuffer(x, dtype=SEEN) for x in b.column("beam").to_pylist()]
            turns = [x["node"][_turn(x, expanded)] for x in beams]
            if turns:
                row = np.repeat(np.arange(len(turns)), [len(x) for x in turns])
                yield batch(part=pa.array(b.column("part").to_numpy()[row]), q=pa.array(b.column("q").to_numpy()[row]), node=pa.array(np.concatenate(turns)))

    def itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(part=b.column("part"), q=b.column("q"), items=_lists(np.arange(b.num_rows), b.column("q").to_numpy())[1])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, rows = _given(right)
        bands, shape = _shapes_of(rows, 1)
        v, bands = _packed(shape)[:, :-1], bands.ravel()
        left = left.sort_by("q")
        qs = left["q"].to_numpy()
        beams, items = left["beam"].to_pylist(), left["items"].to_pylist()
        starts = _starts(qs).tolist()
        out = []
        for i, j in zip(starts, [*starts[1:], len(qs)], strict=True):
            beam = np.frombuffer(b"".join(x for x in beams[i:j] if x), dtype=SEEN).copy()
            beam["expanded"][_turn(beam, expanded)] = 1
            named = np.unique(np.frombuffer(b"".join(x for x in items[i:j] if x), dtype="<i8"))
            named = np.setdiff1d(named, beam["node"], assume_unique=False)
            at = np.searchsorted(ids, named)
            fresh = np.zeros(len(at), dtype=SEEN)
            fresh["node"], fresh["band"] = named, bands[at]
            fresh["s"] = v[at] @ v[np.searchsorted(ids, qs[i])]
            beam = np.concatenate([beam, fresh])
            beam = beam[np.lexsort((beam["node"], -beam["s"], beam["band"]))]
            out.append(beam[_places(beam["band"]) < wide])
        owner = np.repeat(np.arange(len(out)), [len(x) for x in out])
        packed = _lists(owner, np.concatenate(out))[1]
        return pa.table({"part": pa.array(np.full(len(out), left["part"][0].as_py())), "q": pa.array(qs[starts]), "beam": packed})

    known = shapes.select("node", F.concat(F.unhex(F.lpad(F.hex("band"), 2, "0")), "shape").alias("row"))
    own = arrow_map(asked, itself, "part long, q long, items binary")  # its vector is needed, and it is among its neighbours
    beam = scratch.save("beam", entries(asked, shapes, sizes, wide))
    for r in range(SEARCHES):
        turn = arrow_map(beam, expand, "part long, q long, node long")
        if not r:  # a node's own list is where its search begins
            turn = turn.unionByName(asked.select("part", "q", F.col("q").alias("node")))
        reached = scratch.save("reached", turn.distinct().join(links, "node").select("part", "q", "items").unionByName(own))
        named = gathered(reached.select("part", "items"), known)
        left = beam.withColumn("items", F.lit(None).cast("binary")).unionByName(reached.withColumn("beam", F.lit(None).cast("binary")))
        beam = scratch.save("beam", left.groupBy("part").cogroup(named.groupBy("part")).applyInArrow(score, BEAMS))
    return beam


def exact_scores(beams: DataFrame, vectors: DataFrame, kept: int) -> DataFrame:
    """q, node and s, the inner product of the original vectors in double precision, for the best `kept` of a beam in each band."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, beam = _unpacked(b.column("beam"), SEEN)
            order = np.lexsort((beam["node"], -beam["s"], beam["band"], row))
            row, beam = row[order], beam[order]
            few = _places(row * 256 + beam["band"]) < kept
            row, node = row[few], beam["node"][few]
            q = b.column("q").to_numpy()
            row, node = np.concatenate([row, np.arange(len(q))]), np.concatenate([node, q])  # its own vector is needed too
            order = np.argsort(row, kind="stable")
            yield batch(part=b.column("part"), q=b.column("q"), items=_lists(row[order], node[order])[1])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, rows = _given(right)
        v = rows.view("<f8")
        qs, out = left["q"].to_numpy(), []
        for q, items in zip(qs.tolist(), left["items"].to_pylist(), strict=True):
            node = np.unique(np.frombuffer(items, dtype="<i8"))
            s = (v[np.searchsorted(ids, node)] * v[np.searchsorted(ids, q)]).sum(1)
            out.append((np.full(len(node), q), node, s))
        q, node, s = (np.concatenate([o[k] for o in out]) for k in range(3))
        return pa.table({"q": q, "node": node, "s": s})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(node=b.column("node"), row=([x.tobytes() for x in _matrix(b.column("vec"), "<f8")], pa.binary()))

    pairs = arrow_map(beams, chosen, "part long, q long, items binary")
    named = gathered(pairs, arrow_map(vectors.select("node", "vec"), whole, "node long, row binary"))
    return pairs.groupBy("part").cogroup(named.groupBy("part")).applyInArrow(score, "q long, node long, s double")


def nearest(vectors: DataFrame, every: int = EVERY, most: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score: the nearest rows of each row whose vec_id is divisible by `every`.

    Equal vectors are one node of the graph, so thousands of copies neither crowd lists nor meet in a
    task; in the end each node found gives its smallest ids. All rows are indexed. Ids are
    compared, not counted on: gaps don't matter. Recall is measured in the tests.

    Cases: unusable vectors take no part; products exist between vectors of one length alone, so each
    length has a graph of its own; repeated rows of one vec_id and vector are one row; fewer
    candidates than `most` are all returned; no rows give no rows; other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "neighbours")
    rows = scratch.save("rows", usable(vectors).distinct())
    lengths = [r["n"] for r in rows.groupBy(F.size("vec").alias("n")).count().orderBy("n").collect()]
    parts = [_nearest(rows if len(lengths) == 1 else rows.where(F.size("vec") == n), every, most) for n in lengths or [0]]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _nearest(rows: DataFrame, every: int, most: int) -> DataFrame:
    scratch = Scratch(rows.sparkSession, "neighbours")
    nodes = scratch.save("nodes", rows.groupBy("vec").agg(F.min("vec_id").alias("node")))
    drawn = scratch.save("drawn", _shape(nodes))
    order = numbered(placed(drawn, "node", 0), ["band", "place", "node"], "order0", scratch)
    shapes = scratch.save("shapes", order.select(F.col("number").alias("node"), F.col("node").alias("first_id"), "band", "shape"))
    sizes = band_sizes(shapes)
    count = sum(sizes.values())
    graph = first_graph(shapes, sizes, scratch)
    for _ in range(DESCENTS):
        graph = descend(graph, shapes, count, scratch)
        if fresh_share(graph) <= SETTLED:
            break
    vectors = scratch.save("vectors", nodes.withColumnRenamed("node", "first_id").join(shapes.select("first_id", "node"), "first_id").select("node", "vec"))
    owned = scratch.save("owned", rows.join(vectors, "vec").select("vec_id", "node"))
    by_id = Window.partitionBy("node").orderBy("vec_id")
    members = owned.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= most + 1).drop("place")
    asked = scratch.save("asked", owned.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")))
    beams = search(asked.select("q").distinct(), graph, shapes, sizes, scratch)
    found = exact_scores(beams, vectors, 3 * most)
    # one more than asked for each node, as a query leaves itself out
    listed = found.join(members, "node").withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "vec_id"))).where(F.col("place") <= most + 1)
    each = asked.join(listed, "q").where("vec_id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where(F.col("rank") <= most)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("s").alias("score"))
