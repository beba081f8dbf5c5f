"""Order-preserving packing of token sequences by dynamic programming."""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lakeloom.llm.common import arrow_map, batch, raw

WINDOW = 1024
END_ID = 0
#: Costs, in tokens of padding, of cutting a document after a sentence, and elsewhere.
SENTENCE_COST, ANYWHERE_COST = 3, 8
#: Cuts elsewhere are tried at each multiple of so many tokens.
GRID = 16
#: A block of documents is planned at once; its last window is carried into the next block.
BLOCK_TOKENS = 1 << 18
CACHED_UNITS = 600_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 as it is, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts by a byte-level BPE file, with a cache of units.

    A unit is a stretch from one space to the next. In this kind of tokenizer no piece holds a space
    behind another character, and no rule looks back, so a text is encoded unit by unit as long as
    each space follows a character that isn't white space. Other texts, and those that hold a special
    token's string, are encoded whole. Where ids rise with the merges, as in the public file, new
    units go through tiktoken with the same vocabulary, which gives the same ids faster.
    """

    #: How this kind of tokenizer splits a text, a fixed value.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, sorted(special)))) if special else None
        self.spaced = any(" " in t for t in special)
        self.units: dict[str, bytes | None] = {}
        vocab = self.tokenizer.get_vocab()
        # ids after which a sentence may end
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if re.fullmatch(r"[^\w\s]*[.!?][^\w\s]*Ċ*|[^\w]*Ċ+", t)]] = True
        self.fast = self._ranked({t: i for t, i in vocab.items() if t not in special})

    def _ranked(self, vocab: dict[str, int]):
        import json

        import tiktoken

        model = json.loads(self.tokenizer.to_str())
        splits = model.get("pre_tokenizer") or {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"].get("merges", ())]
        merged = [vocab.get(a + b, -1) for a, b in merges]
        bytes_of = byte_alphabet()
        if splits.get("type") != "ByteLevel" or splits.get("add_prefix_space") or model.get("normalizer") or len(merged) + 256 != len(vocab) or merged != sorted(merged) or merged[0] < 256:
            return None
        ranks = {bytes(bytes_of[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _unit(self, text: str) -> bytes:
        return array("I", self.fast.encode_ordinary(text)).tobytes() if self.fast else self._plain(text)

    def _apart(self, unit: str) -> bool:
        """Whether a stretch between spaces can be encoded on its own."""
        return bool(unit) and not unit[-1].isspace() and not (self.special and self.special.search(unit))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        first, *rest = text.split(" ")
        if self.spaced or not self._apart(first):
            return self._plain(text)
        units = self.units
        if len(units) > CACHED_UNITS:
            units.clear()
        try:
            return self._unit(first) + b"".join([units[u] for u in rest])
        except KeyError:
            for u in rest:
                if u not in units:
                    units[u] = self._unit(" " + u) if self._apart(u) else None
        except TypeError:  # a unit that can't stand alone
            return self._plain(text)
        return self._plain(text) if None in (parts := [units[u] for u in rest]) else self._unit(first) + b"".join(parts)


def shared_encoder(path: str) -> Encoder:
    """One encoder for each worker process, with the units it has met: kept beside the library, as this module's
    own globals are shipped anew with each task."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_lakeloom_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def plan_cuts(places: list[int], costs: list[int], window: int = WINDOW) -> list[int]:
    """Indices of the cheapest windows' ends.

    places: where cuts may be, ascending, the first 0, none over a window from the next. costs: of a
    cut at each place. A window (i, j] costs the padding, window - (places[j] - places[i]), or none
    where its length is a power of two, and the cost of cutting at j. As padding is linear in both
    ends, the best i for each j is the least best[i] + places[i] in a sliding range: the head of a
    monotone queue.
    """
    n = len(places)
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (best + place, index), least first
    powers = [1 << k for k in range(window.bit_length() - 3, window.bit_length()) if 1 << k < window]
    at = {0: 0}
    for j in range(1, n):
        p, cost = places[j], costs[j]
        low = p - window
        while places[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        value += window - p
        if not cost:
            for q in powers:
                if (k := at.get(p - q)) is not None and best[k] < value:
                    value, i = best[k], k
        best[j], back[j] = value = value + cost, i
        value = best[j]
        at[p] = j
        key = value + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts may be in a block of ids, and their costs: ends of documents, of sentences, and a grid."""
    cost = np.full(len(ids) + 1, -1, dtype=np.int8)
    cost[GRID::GRID] = ANYWHERE_COST
    cost[np.flatnonzero(ends[ids]) + 1] = SENTENCE_COST
    cost[doc_ends] = 0
    cost[0] = cost[-1] = 0
    places = np.flatnonzero(cost >= 0)
    return places, cost[places]


def powers_of_two(length: int) -> list[int]:
    """A length as a sum of powers of two, the largest first: a rest without padding."""
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


class Packer:
    """Packs a stream of documents, block by block, with one open window between blocks."""

    def __init__(self, sequence_from: int, ends: np.ndarray):
        self.sequence, self.ends = sequence_from, ends
        self.parts: list[bytes] = []  # ids of each document, or of its rest
        self.docs: list[tuple[int | None, int, int, int]] = []  # doc_id, ids before the part, ids in it, ids of the document
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> pa.RecordBatch | None:
        n = len(ids) // 4
        self.parts.append(ids)
        self.docs.append((doc_id, 0, n, n))
        self.held += n
        return self.pack() if self.held >= BLOCK_TOKENS else None

    def pack(self, last: bool = False) -> pa.RecordBatch:
        data = b"".join(self.parts)
        ids = np.frombuffer(data, dtype="<u4")
        lengths = np.array([d[2] for d in self.docs], dtype=np.int64)
        doc_ends = np.cumsum(lengths)
        places, costs = candidates(ids, doc_ends, self.ends)
        cuts = places[plan_cuts(places.tolist(), costs.tolist())] if len(ids) else np.zeros(0, dtype=np.int64)
        if last and len(cuts):
            open_from = int(cuts[-2]) if len(cuts) > 1 else 0
            tail = [] if int(cuts[-1]) - open_from == WINDOW else powers_of_two(int(cuts[-1]) - open_from)
            cuts = np.concatenate([cuts[: len(cuts) - bool(tail)], open_from + np.cumsum(tail, dtype=np.int64)]).astype(np.int64)
        else:
            cuts = cuts[:-1]
        made, upto = self._pieces(data, doc_ends - lengths, doc_ends, cuts)
        kept = [(k, d) for k, d in enumerate(self.docs) if doc_ends[k] > upto]
        parts, docs = [], []
        for k, (doc_id, before, n, whole) in kept:
            gone = max(0, upto - int(doc_ends[k] - lengths[k]))
            parts.append(self.parts[k][4 * gone :])
            docs.append((doc_id, before + gone, n - gone, whole))
        self.parts, self.docs, self.held = parts, docs, sum(d[2] for d in docs)
        return made

    def _pieces(self, data: bytes, begins: np.ndarray, doc_ends: np.ndarray, cuts: np.ndarray) -> tuple[pa.RecordBatch, int]:
        upto = int(cuts[-1]) if len(cuts) else 0
        bounds = np.union1d(cuts, doc_ends[doc_ends <= upto]).astype(np.int64)
        froms = np.concatenate([[0], bounds[:-1]]).astype(np.int64) if len(bounds) else bounds
        which = np.searchsorted(doc_ends, froms, side="right")
        inside = np.searchsorted(cuts, froms, side="right")
        opens = np.concatenate([[0], cuts]).astype(np.int64)[inside]
        sequences = self.sequence + inside
        self.sequence += len(cuts)
        view = memoryview(data)
        docs = [self.docs[k] for k in which.tolist()]
        return batch(
            doc_id=([d[0] for d in docs], pa.int64()),
            start=pa.array(np.array([d[1] for d in docs], dtype=np.int64) + froms - begins[which], pa.int64()),
            length=pa.array(bounds - froms, pa.int64()),
            ids_crc32=([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(froms.tolist(), bounds.tolist(), strict=True)], pa.int64()),
            doc_tokens=([d[3] for d in docs], pa.int64()),
            sequence_id=pa.array(sequences, pa.int64()),
            offset=pa.array(froms - opens, pa.int64()),
        ), upto


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pack all documents, in the order in which each task reads them, into windows of 1,024 ids.

    A document's ids are those of its text, then id 0. Each task streams its documents: no shuffle,
    memory for one block (at least 2^18 ids, and one document). Windows are cut at ends of documents
    or sentences, or else on a grid of 16 ids, so as to minimise padding plus the costs of cuts; the
    last window of a task is cut into powers of two, which need no padding. Sequence ids are the
    task's number times 2^40 plus a running number.

    Cases: a null or empty text has the one id 0; repeated rows are packed each; very long texts
    span windows; no rows give no rows.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 40, encoder.ends)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                if made := packer.add(doc_id, encoder.encode(text.as_py().decode()) + end):
                    yield made
        if packer.held:
            yield packer.pack(last=True)

    return arrow_map(raw(docs).select("doc_id", "text"), pack, SCHEMA)
