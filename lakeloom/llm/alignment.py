"""Alignment of two tokenizers over whole texts, and which tokens of one stand for which of the other."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import arrow_map, batch, texts
from lakeloom.llm.packing import Encoder, byte_alphabet
from lakeloom.session import Scratch

#: Units whose alignment a worker keeps, and the bytes of text that are aligned at once.
CACHED_UNITS, BLOCK_BYTES = 500_000, 4 << 20
STEP = 4096
MARK = "▁"
#: What a block of documents may take in DuckDB, within one task.
MEMORY = "400MB"

#: Both tokenizers' tokens of distinct units come as intervals of bytes; the units lie one behind the other, so that
#: no token of one unit overlaps with any of another.
LINK = """
CREATE TEMP TABLE links AS
WITH begun AS (          -- the B token in which each A token begins
  SELECT a.ord, a.unit, a.id, a.start, a.stop, b.ord AS from_ord FROM a ASOF JOIN b ON a.start >= b.start
), spans AS (            -- and the one in which it ends
  SELECT t.*, b.ord AS to_ord FROM (SELECT *, stop - 1 AS final FROM begun) t ASOF JOIN b ON t.final >= b.start
), meets AS (            -- all pairs of tokens that share bytes
  SELECT s.unit, s.ord AS a_ord, b.ord AS b_ord, s.id AS a_id, b.id AS b_id, s.stop AS a_stop, b.stop AS b_stop
  FROM spans s JOIN b ON b.ord BETWEEN s.from_ord AND s.to_ord
)
SELECT unit, a_ord, b_ord, a_id, b_id FROM meets WHERE a_stop = b_stop
"""
#: Tokens up to the same cut are one group: the cuts before a token are its number.
GROUP = """
SELECT coalesce(sum(CASE WHEN l.{side}_ord IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY t.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS grp
FROM {side} t LEFT JOIN links l ON l.{side}_ord = t.ord ORDER BY t.ord
"""


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and all pairs that can ever be linked.

    Linked tokens end at the same byte, so one's bytes are the end of the other's. There are at most as many such
    pairs as the two vocabularies have bytes; they are numbered here, from the files alone.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        encoder = Encoder(a_path)
        self.a, self.fast = encoder.tokenizer, encoder.fast
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = t.encode() if t in special else bytes(alphabet[c] for c in t)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_len, self.b_len = (np.array([len(x) for x in y], dtype=np.int64) for y in (self.a_bytes, self.b_bytes))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        #: no piece goes on beyond a space that follows another sign, so texts can be cut there
        self.separable = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        pairs = set(self._ending(self.a_bytes, self.b_bytes)) | {(a, b) for b, a in self._ending(self.b_bytes, self.a_bytes)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.keys = self.pairs[:, 0] * len(self.b_bytes) + self.pairs[:, 1]

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:-1], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else self.b.id_to_piece(i).replace(MARK, " ").encode()

    def encode_a(self, strings: list[str]) -> list[list[int]]:
        """The A tokens of strings, through tiktoken where it gives the same ids (see packing.Encoder)."""
        if self.fast:
            return [self.fast.encode_ordinary(s) for s in strings]
        # in steps, as each encoding holds much besides its ids
        return [e.ids for k in range(0, len(strings), STEP) for e in self.a.encode_batch(strings[k : k + STEP], add_special_tokens=False)]

    @staticmethod
    def _ending(long: list[bytes], short: list[bytes]) -> Iterator[tuple[int, int]]:
        """(i, j) where short[j] is an end of long[i]."""
        ids: dict[bytes, list[int]] = {}
        for j, s in enumerate(short):
            if s:
                ids.setdefault(s, []).append(j)
        for i, s in enumerate(long):
            for k in range(len(s)):
                for j in ids.get(s[k:], ()):
                    yield i, j

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of linked pairs of ids."""
        return np.searchsorted(self.keys, a * len(self.b_bytes) + b).astype(np.int32)

    def units(self, text: str) -> list[str]:
        """A text cut before each space that follows another sign than white space; the space itself is left out.

        Neither tokenizer joins signs across such a place, nor looks back across it, so that a unit with a space before
        it has the tokens that it has within the text.
        """
        if not self.separable:
            return [text]
        return text.split(" ") if not _AWKWARD.search(text) else _CUT.split(text)


_AWKWARD = re.compile(r"\s |^ | \Z")
_CUT = re.compile(r"(?<=\S) (?!\Z)")


def shared_aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process, with the units it has met: kept beside the library, as this module's own
    globals would be shipped anew with each task."""
    import lakeloom.llm as home

    kept = home.__dict__.setdefault("_alignments", {})
    if (a_path, b_path) not in kept:
        kept[a_path, b_path] = Aligner(Vocabularies(a_path, b_path))
    return kept[a_path, b_path]


class Aligner:
    """Aligns the distinct units of blocks of documents; what is known of a unit is kept."""

    def __init__(self, vocabularies: Vocabularies):
        self.v = vocabularies
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.groups: list[str] = []
        self.n_a, self.n_b, self.n_links = (np.zeros(0, dtype=np.int32) for _ in range(3))
        self.from_, self.links = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def _encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of units with a space before each; none where a tokenizer changes the bytes."""
        v = self.v
        spaced = [" " + u for u in units]
        a = v.encode_a(spaced)
        b = v.b.encode(units, num_threads=1)
        data = [s.encode() for s in spaced]
        whole = b"".join(data)
        if not all(b"".join([of[i] for x in ids for i in x]) == whole for ids, of in ((a, v.a_bytes), (b, v.b_bytes))):
            for k, d in enumerate(data):
                if not b"".join([v.a_bytes[i] for i in a[k]]) == d == b"".join([v.b_bytes[i] for i in b[k]]):
                    a[k] = b[k] = []
        return a, b

    @staticmethod
    def _intervals(ids: list[list[int]], lengths: np.ndarray) -> pa.Table:
        n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(n.sum()))
        # units are covered gaplessly, so a running sum of lengths gives all ends
        stop = np.cumsum(lengths[flat])
        return pa.table({"unit": np.repeat(np.arange(len(ids)), n), "ord": np.arange(len(flat)), "id": flat, "start": stop - lengths[flat], "stop": stop})

    def _written(self, a: pa.Table, b: pa.Table, a_grp: np.ndarray, b_grp: np.ndarray) -> list[str]:
        """All tokens as text, in the order in which groups are written: a1,a2|b1;a3|b2,b3."""
        groups = int(a_grp[-1]) + 1 if len(a_grp) else 0
        out = np.empty(len(a_grp) + len(b_grp), dtype=object)
        b_before = np.searchsorted(b_grp, np.arange(groups))
        a_upto = np.searchsorted(a_grp, np.arange(groups), side="right")
        last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, dtype=bool)
        for grp, table, at, (inner, outer) in ((a_grp, a, np.arange(len(a_grp)) + b_before[a_grp], ",|"), (b_grp, b, np.arange(len(b_grp)) + a_upto[b_grp], ",;")):
            ids, end = table.column("id").to_numpy(), last(grp)
            seen, of = np.unique(ids * 2 + end, return_inverse=True)
            names = np.array([f"{x >> 1}{outer if x & 1 else inner}" for x in seen.tolist()] or [""], dtype=object)
            out[at] = names[of]
        return out.tolist()

    def learn(self, units: list[str]) -> None:
        """Token intervals of new units, joined in DuckDB to links and groups."""
        import duckdb

        v = self.v
        a_ids, b_ids = self._encode(units)
        a, b = self._intervals(a_ids, v.a_len), self._intervals(b_ids, v.b_len)
        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY}) as db:
            db.register("a", a)
            db.register("b", b)
            db.execute(LINK)
            links = db.sql("SELECT unit, a_id, b_id FROM links ORDER BY a_ord").to_arrow_table()
            a_grp, b_grp = (db.sql(GROUP.format(side=side)).to_arrow_table().column("grp").to_numpy() for side in "ab")
        n_a, n_b, n_links = (np.bincount(t.column("unit").to_numpy(), minlength=len(units)) for t in (a, b, links))
        written = self._written(a, b, a_grp, b_grp)
        upto = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        known = len(self.numbers)
        self.numbers.update(zip(units, range(known, known + len(units))))
        self.groups += ["".join(written[s:e]) for s, e in zip(upto, upto[1:])]
        more = lambda old, new: np.concatenate([old, new.astype(old.dtype)])
        self.from_ = more(self.from_, len(self.links) + np.cumsum(n_links) - n_links)
        self.n_a, self.n_b, self.n_links = more(self.n_a, n_a), more(self.n_b, n_b), more(self.n_links, n_links)
        self.links = more(self.links, v.number(links.column("a_id").to_numpy(), links.column("b_id").to_numpy()))

    def align(self, block: list[str]) -> dict:
        """What the columns of `align` hold, for the texts of a block."""
        cut = [self.v.units(t) if t else [] for t in block]
        n = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        new = set().union(*cut) - self.numbers.keys()
        if len(self.numbers) + len(new) > CACHED_UNITS:
            self.clear()
            new = set().union(*cut)
        if new:
            self.learn(list(new))
        flat = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(n.sum()))
        upto = np.concatenate([[0], np.cumsum(n)])
        per_doc = lambda values: np.diff(np.concatenate([[0], np.cumsum(values[flat])])[upto])
        # every unit has tokens unless a tokenizer changes it
        whole = (per_doc(self.n_a > 0) == n) & (n > 0)
        counts = {k: per_doc(v) * whole for k, v in (("n_a", self.n_a), ("n_b", self.n_b), ("n_links", self.n_links))}
        # links of units, gathered in the order of the texts
        long = self.n_links[flat] * np.repeat(whole, n)
        start = np.repeat(self.from_[flat] - (np.cumsum(long) - long), long)
        links = self.links[start + np.arange(len(start))]
        groups = self.groups
        written = [groups[u] for u in flat.tolist()]
        # each group ends with its sign; the last one's goes
        text = ["".join(written[s:e])[:-1] if w else "" for s, e, w in zip(upto.tolist(), upto[1:].tolist(), whole.tolist())]
        ends = np.cumsum(counts["n_links"])
        raw = links.astype("<i4").tobytes()
        parts = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), counts["n_links"].tolist())]
        return counts | {"groups": text, "links": parts}


ALIGNED = "doc_id long, text_hash long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def align(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> DataFrame:
    """Token groups and links of every whole text: n_a, n_b, n_groups, n_links, groups_sha256 and links.

    A text, with a space before it, is encoded by both tokenizers without special tokens. Where tokens of both
    end at the same byte the text is cut into groups, and the two tokens that end there are linked. `links` holds
    the linked pairs in order, as little-endian 32-bit numbers of Vocabularies.pairs; with `keep_groups`
    the column `groups` holds the groups as text, `a1,a2|b1;a3|b2,b3`.

    A task takes its texts in blocks of 4 MB. Their distinct units (see Vocabularies.units), as far as the worker
    doesn't know them yet, are encoded to tables of token intervals; DuckDB finds the B tokens in which each A token
    begins and ends by ASOF joins, all overlaps by a range join, and the groups by window sums. No shuffle.

    Cases: null and empty texts and those that a tokenizer changes have no tokens: zeros, no links, an empty string
    for the hash; a very long text without spaces is one unit; repeated rows are aligned alike; other columns are
    ignored, whatever their names; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = shared_aligner(a_path, b_path)

        def rows(ids: list, hashes: list, held: list[str]) -> pa.RecordBatch:
            got = aligner.align(held)
            sha = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in got["groups"]]
            more = {"groups": (got["groups"], pa.string())} if keep_groups else {}
            return batch(
                doc_id=(ids, pa.int64()),
                text_hash=(hashes, pa.int64()),
                n_a=pa.array(got["n_a"]),
                n_b=pa.array(got["n_b"]),
                n_groups=pa.array(got["n_links"]),  # each cut ends one group and links the two tokens that end there
                n_links=pa.array(got["n_links"]),
                groups_sha256=(sha, pa.string()),
                links=(got["links"], pa.binary()),
                **more,
            )

        ids, hashes, held, size = [], [], [], 0
        for b in batches:
            for doc_id, text_hash, text in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), b.column("text")):
                ids.append(doc_id)
                hashes.append(text_hash)
                held.append(text.as_py())
                size += len(held[-1])
                if size >= BLOCK_BYTES or len(ids) >= 10_000:
                    yield rows(ids, hashes, held)
                    ids, hashes, held, size = [], [], [], 0
        if ids:
            yield rows(ids, hashes, held)

    return arrow_map(texts(docs), run, ALIGNED + (", groups string" if keep_groups else ""))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Batches in smaller ones, as the links of a batch are unfolded at once."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def _links(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All links of a batch, and where each row's end."""
    parts = b.column("links").to_pylist()
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4)
    return np.frombuffer(b"".join(parts), dtype="<i4"), ends


def pair_counts(aligned: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, a_id, b_id, n): how many links of `align`'s table hold each pair. Each task counts its own first, to a row a pair; Spark merges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = shared_aligner(a_path, b_path)
        aligner.clear()  # the texts are aligned, and only the pairs' numbers are needed from here on
        pairs = aligner.v.pairs
        total = np.zeros(len(pairs), dtype=np.int64)
        for b in _slices(batches):
            total += np.bincount(_links(b)[0], minlength=len(pairs))
        seen = np.flatnonzero(total)
        yield batch(pair=pa.array(seen, pa.int64()), a_id=pa.array(pairs[seen, 0]), b_id=pa.array(pairs[seen, 1]), n=pa.array(total[seen]))

    counted = arrow_map(aligned.select("links"), run, "pair long, a_id long, b_id long, n long")
    return counted.groupBy("pair", "a_id", "b_id").agg(F.sum("n").alias("n"))


def score_links(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """`align`'s table with n_best, the links whose count is the highest that their B token has, and count_sum.

    `counts` is a table of pair_counts. It has at most one row for each pair of Vocabularies, which is bounded by the
    bytes of the vocabularies whatever the texts are, so it goes to every task.
    """
    table = counts.select("pair", "b_id", "n").toArrow()
    pair, b_id, n = (table.column(c).to_numpy().astype(np.int64) for c in ("pair", "b_id", "n"))
    size = int(pair.max()) + 1 if len(pair) else 1
    highest = np.zeros(int(b_id.max()) + 1 if len(b_id) else 1, dtype=np.int64)
    np.maximum.at(highest, b_id, n)
    count, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    count[pair], best[pair] = n, n == highest[b_id]
    sent = aligned.sparkSession.sparkContext.broadcast((count, best))
    kept = [c for c in aligned.columns if c != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = sent.value
        for b in _slices(batches):
            links, ends = _links(b)
            of = lambda values: np.diff(np.concatenate([[0], np.cumsum(values[links])])[np.concatenate([[0], ends])])
            yield batch(**{c: b.column(c) for c in kept}, n_best=pa.array(of(best), pa.int64()), count_sum=pa.array(of(count), pa.int64()))

    return aligned.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in aligned.dtypes if c != "links") + ", n_best long, count_sum long")


def token_alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Alignment of every text with the corpus-wide counts of its links: doc_id, text_hash, n_a, n_b, n_groups,
    n_links, n_best, count_sum, groups_sha256.

    The aligned texts are written once, as ids of linked pairs; their counts and the sums over them read that table.
    Cases as in `align`.
    """
    aligned = Scratch(docs.sparkSession, "alignment").save("aligned", align(docs, a_path, b_path))
    return score_links(aligned, pair_counts(aligned, a_path, b_path))
