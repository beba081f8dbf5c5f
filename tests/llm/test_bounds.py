"""What operators move."""

import numpy as np

from lakeloom.llm import neighbours as N
from lakeloom.llm import repeats


def test_only_rows_that_may_meet_are_joined_by_anchor(spark, monkeypatch):
    """Joins with few anchors, as those of large groups, shuffled the surroundings of all others along."""
    monkeypatch.setattr(repeats, "GROUP", 4)
    rng = np.random.default_rng(8)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(n))
    shared, pairs = words(120), [words(120) for _ in range(20)]
    texts = [f"{words(60)} {p} {words(60)}" for p in [*[shared] * 8, *pairs, *pairs]]
    seen, join = [], repeats.skewed_join

    def spied(rows, other, keys, hot):
        if keys == ["anchor"]:
            seen.append((rows.count(), rows.join(other.select("anchor").distinct(), "anchor", "left_semi").count()))
        return join(rows, other, keys, hot)

    monkeypatch.setattr(repeats, "skewed_join", spied)
    cut = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert all(r["n_removed"] >= 700 or len(pairs[0]) < 700 for r in cut if r["doc_id"] < 8) and all(r["n_spans"] for r in cut)
    assert len(seen) == 3 and all(moved <= 1.05 * met + 2 for moved, met in seen), seen


def test_reverse_links_go_in_a_row_for_each_unit(spark, monkeypatch):
    """Not in a row for each node: those grew with nodes times units."""
    rng = np.random.default_rng(7)
    nodes = [n for n in range(0, 6 * N.UNIT, 61)]
    links = {n: [(int(b), float(np.float32((n * 31 + int(b) * 17) % 1009 / 1009)), int(k % 2)) for k, b in enumerate(rng.choice(nodes, 12, replace=False))] for n in nodes}
    graph = spark.createDataFrame([(n, bytearray(np.array(x, dtype=N.LINK).tobytes())) for n, x in links.items()], N.LISTS).coalesce(1)
    made, merged = [], N.merged

    def spied(lists, most, proposals=None):
        made.append((lists if proposals is None else proposals).count())
        return merged(lists, most, proposals)

    monkeypatch.setattr(N, "merged", spied)
    got = {r["node"]: np.frombuffer(bytes(r["links"]), dtype=N.LINK).tolist() for r in N.turned(graph, 5).collect()}
    assert made[0] <= 2 * 6, made
    back = {}
    for n, held in links.items():
        for b, s, new in held:
            back.setdefault(b, []).append((n, s, new))
    assert sorted(got) == sorted(back)
    for b, held in back.items():
        assert set(got[b]) <= set(held) and [s for _, s, _ in got[b]] == sorted((s for _, s, _ in held), reverse=True)[:5]
