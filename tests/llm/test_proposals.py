"""What the units of the neighbours' graph propose to each other, and how that is merged."""

import numpy as np
import pyarrow as pa

from lakeloom.llm import neighbours as N


def lists_of(links: dict[int, list[tuple[int, float, int]]]) -> tuple[list[int], list[bytes]]:
    return list(links), [np.array(x, dtype=N.LINK).tobytes() for x in links.values()]


def test_a_unit_proposes_to_another_in_one_row():
    """Not in a row for each node: those grew with nodes times units."""
    rng = np.random.default_rng(5)
    ids = np.arange(0, 5 * N.UNIT, 37)
    shapes = pa.array([np.float32([0.02, 0.0]).tobytes() + rng.integers(-100, 100, 8).astype(np.int8).tobytes() for _ in ids], pa.binary())
    v = N._packed(shapes)
    node, links = lists_of({n: [(int(b), 0.0, int(k % 3 > 0)) for k, b in enumerate(rng.choice(ids, 12, replace=False))] for n in range(200)})
    left = pa.table({"node": pa.array(node), "links": pa.array(links, pa.binary())})
    right = pa.table({"part": pa.array(np.zeros(len(ids), dtype=np.int64)), "node": pa.array(ids), "shape": shapes, "worst": pa.array(np.full(len(ids), 0.5001, dtype=np.float32)), "most": pa.array([1_000] * len(ids))})
    made = N._meet(left, right)
    assert made.num_rows == 5
    got = {}
    for part, held in zip(made["part"].to_pylist(), made["proposed"].to_pylist()):
        for place, b, s in np.frombuffer(held, dtype=N.PROPOSAL).tolist():
            got[part * N.UNIT + place, b] = s
    at = {int(n): x for n, x in zip(ids, v)}
    want = {}
    for held in links:
        items = np.frombuffer(held, dtype=N.LINK).tolist()
        for a, _, new in items:
            for b, _, also in items:
                if a != b and (new or also) and float(at[a] @ at[b]) > 0.5001:
                    want[a, b] = float(at[a] @ at[b])
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_proposals_are_merged_with_the_lists(spark):
    rng = np.random.default_rng(6)
    nodes = [0, 1, 5, N.UNIT - 1, N.UNIT, N.UNIT + 7, 3 * N.UNIT, 3 * N.UNIT + 9]
    near = lambda n, b: float(np.float32((n * 31 + b * 17) % 101 / 101))
    links = {n: [(int(b), near(n, int(b)), 0) for b in rng.choice(50, 4, replace=False)] for n in nodes}
    offers, offered = [], {n: [] for n in nodes}
    for _ in range(6):
        for part in (0, 1, 3):
            mine = [(n % N.UNIT, b := int(100 + rng.integers(40)), near(n, b)) for n in nodes if n // N.UNIT == part]
            offers.append((part, bytearray(np.array(mine, dtype=N.PROPOSAL).tobytes())))
            for place, b, s in mine:
                offered[part * N.UNIT + place].append((b, s, 1))
    lists = spark.createDataFrame([(n, bytearray(np.array(x, dtype=N.LINK).tobytes())) for n, x in links.items()], N.LISTS)
    got = {r["node"]: np.frombuffer(bytes(r["links"]), dtype=N.LINK).tolist() for r in N.merged(lists, 5, spark.createDataFrame(offers, N.PROPOSALS).repartition(3)).collect()}
    assert sorted(got) == nodes
    for n in nodes:
        best = sorted({s for _, s, _ in links[n] + offered[n]}, reverse=True)
        assert len(got[n]) == 5 and [s for _, s, _ in got[n]] == sorted((s for _, s, _ in got[n]), reverse=True)
        assert {(b, s, new) for b, s, new in got[n]} <= set(links[n] + offered[n]) and got[n][0][1] == best[0]


def test_a_unit_hands_its_rows_to_a_part_in_one_value(spark):
    """Not in a row for each pair of part and node: those grew with the square of the nodes until a part named them all."""
    rng = np.random.default_rng(7)
    nodes, units = np.arange(0, 4 * N.UNIT, 41), 4
    row = {int(n): rng.bytes(9) for n in nodes}
    lists = [(p, rng.choice(nodes, 70)) for p in range(5) for _ in range(30)] + [(7, nodes[:1]), (8, nodes[:0])]
    wanted = spark.createDataFrame([(p, bytearray(held.astype("<i8").tobytes())) for p, held in lists], "part long, items binary").repartition(3)
    table = spark.createDataFrame([(n, bytearray(r)) for n, r in row.items()], "node long, row binary").repartition(5)
    made = N.gathered(wanted, table).toArrow()
    assert made.num_rows == 5 * units + 1
    want = {p: sorted({int(n) for q, held in lists if q == p for n in held}) for p in range(9)}
    for p in range(9):
        node, rows = N._given(made.filter(np.array(made["part"]) == p))
        assert node.tolist() == want[p] and [r.tobytes() for r in rows] == [row[n] for n in want[p]]
