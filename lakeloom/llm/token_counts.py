"""Token counts under a unigram tokenizer, by dynamic programming over a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lakeloom.llm.common import arrow_map, batch, raw

#: Zipf-Mandelbrot shift of the scores, see piece_scores.
SHIFT = 10
#: Score of a byte where no piece fits, below every piece of the vocabulary.
BYTE_SCORE = -20.0
CACHED_WORDS, GROUP_WORDS = 500_000, 300_000
MARK = "▁"


def piece_scores(path: str) -> dict[str, float]:
    """Unigram log scores of a public piece vocabulary.

    The file holds pieces by rank, without probabilities; a Zipf-Mandelbrot law over ranks gives them.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + SHIFT) for r in range(len(pieces))))
    return {p: -math.log(r + SHIFT) - total for r, p in enumerate(pieces)}


class Trie:
    """Terminal counts of pre-tokens.

    The trie of a set of new pre-tokens is walked depth first, which is the order of the sorted
    words: the nodes on the way to a word are a stack, and what a word shares with the one before
    stays on it. Each node, a distinct prefix, gets its forward score once: the best score of a way to
    split the prefix into pieces, and the pieces of that way (fewer win ties).
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.counts: dict[bytes, int] = {}
        self.nodes = 0

    def insert(self, words: Iterable[bytes]) -> None:
        scores, longest = self.scores, self.longest
        path = ""
        stack: list[tuple[float, int]] = [(0.0, 0)]  # forward score and minus the pieces, by depth
        for word, key in sorted((MARK + w.decode("utf-8", "replace"), w) for w in words):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del stack[shared + 1 :]
            path = word
            for d in range(shared + 1, len(word) + 1):
                n = len(word[d - 1].encode("utf-8", "replace"))
                value, less = stack[d - 1]
                best = (value + BYTE_SCORE * n, less - n)
                for start in range(max(0, d - longest), d):
                    score = scores.get(word[start:d])
                    if score is not None:
                        value, less = stack[start]
                        if (value := value + score) > best[0] or value == best[0] and less - 1 > best[1]:
                            best = (value, less - 1)
                stack.append(best)
            self.nodes += len(word) - shared
            self.counts[key] = -stack[len(word)][1]

    def count(self, groups: list[list[bytes]]) -> list[int]:
        """Pieces of each list of words."""
        counts = self.counts
        new = set().union(*groups) - counts.keys()
        if len(counts) + len(new) > CACHED_WORDS:
            counts.clear()
            new = set().union(*groups)
        self.insert(new)
        return [sum(map(counts.__getitem__, words)) for words in groups]


def count_tokens(docs: DataFrame, pieces_path: str) -> DataFrame:
    """doc_id, n_bytes, n_words and n_tokens of every whole text; no shuffle.

    Pre-tokens are runs without ASCII white space, each with a word mark before it. A task inserts
    the distinct pre-tokens that it meets in its trie, in groups of about 300,000 words, and keeps
    the terminal counts of up to 500,000.

    Cases: null, empty and blank texts have 0 words and tokens; letters outside the vocabulary count
    their bytes; repeated rows are counted each; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(piece_scores(pieces_path))
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            held: list[tuple[int | None, int, list[bytes]]] = []
            words = 0
            for k, doc_id in enumerate(ids):
                text = texts[k].as_py()
                held.append((doc_id, len(text), text.split()))
                words += len(held[-1][2])
                if words >= GROUP_WORDS or k == len(ids) - 1:
                    yield batch(
                        doc_id=([h[0] for h in held], pa.int64()),
                        n_bytes=([h[1] for h in held], pa.int64()),
                        n_words=([len(h[2]) for h in held], pa.int64()),
                        n_tokens=(trie.count([h[2] for h in held]), pa.int64()),
                    )
                    held, words = [], 0

    return arrow_map(raw(docs).select("doc_id", "text"), run, "doc_id long, n_bytes long, n_words long, n_tokens long")
