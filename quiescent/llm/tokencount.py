"""Token counts of a unigram vocabulary by count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary entries in a text; dynamic
programming over their ends carries the best score and the number of pieces on the
path that has it. Ties, unknown characters and byte fallback follow the public
``tokenizers`` implementation of the unigram model: of equal scores the piece that
starts first stays, an unknown character costs the smallest score less ten, and
falls back to one piece for each of its bytes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files of public tokenizers are; a parameter of every function that reads one.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Segments whose counts a worker keeps, and the longest that is kept.
CACHE = 500_000
LONGEST = 48


def load_pieces(path: str = MODEL_PATH) -> tuple[list[tuple[str, float]], int]:
    """(piece, score) of a vocabulary file without its control pieces, the unknown piece first; and its index.

    The file orders its pieces from frequent to rare, but its scores are those
    places, not probabilities. Scores here are the log-probabilities that Zipf's law
    gives the places, byte pieces last. They are an estimate: counts are those of
    the unigram model with these pieces and scores, not of the file's own tokenizer.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not sp.is_control(i) and not sp.is_unknown(i)]
    ids.sort(key=lambda i: (sp.is_byte(i), -sp.get_score(i), i))
    total = math.log(sum(1 / (k + 1) for k in range(len(ids))))
    return [("<unk>", 0.0)] + [(sp.id_to_piece(i), -math.log(k + 1) - total) for k, i in enumerate(ids)], 0


class Counter:
    """Counts pieces of texts under one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0) -> None:
        self.automaton = ahocorasick.Automaton()
        for text, score in pieces:
            if text:
                self.automaton.add_word(text, (len(text), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        names = {t for t, _ in pieces}
        self.bytes = all(f"<0x{i:02X}>" in names for i in range(256))
        # pieces that hold a space mark only at their start cannot cross the start of another run of them
        self.splits = SPACE in names and not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in names)
        self.cache: dict[str, int] = {}

    def viterbi(self, s: str) -> int:
        """Pieces on the best path over ``s``."""
        n = len(s)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        lone = [False] * (n + 1)  # whether the best path to here ends in an unknown character
        known = [True] + [False] * n  # whether the character before here is an entry of its own
        settled = 1

        def settle(upto: int) -> None:
            # all entries that end at these places have been seen; an unknown character starts last
            for end in range(settled, upto):
                if not known[end]:
                    score = best[end - 1] + self.unknown
                    if best[end] is None or score > best[end]:
                        step = len(s[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else int(not lone[end - 1])
                        best[end], count[end], lone[end] = score, count[end - 1] + step, True

        for last, (length, value) in self.automaton.iter(s):
            end = last + 1
            if end > settled:
                settle(end)
                settled = end
            # at one end the longest entry, which starts first, comes first
            score = best[end - length] + value
            if best[end] is None or score > best[end]:
                best[end], count[end], lone[end] = score, count[end - length] + 1, False
            if length == 1:
                known[end] = True
        settle(n + 1)
        return count[n]

    def segment(self, s: str) -> int:
        """Pieces of a run of space marks and what follows up to the next run."""
        got = self.cache.get(s)
        if got is None:
            got = self.viterbi(s)
            if len(s) <= LONGEST:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[s] = got
        return got

    def count(self, text: str | None) -> int:
        """Pieces of a text whose spaces are read as marks, with one put in front; null and empty have none."""
        if not text:
            return 0
        s = text.replace(" ", SPACE)
        s = s if s[0] == SPACE else SPACE + s
        if not self.splits:
            return self.viterbi(s)
        if SPACE * 2 in s:
            return sum(map(self.segment, re.findall(f"{SPACE}+[^{SPACE}]*", s)))
        return sum([self.segment(SPACE + w) for w in s[1:].split(SPACE)])


def count_tokens(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_tokens)``, a row for each row.

    Null and empty texts have 0 tokens. Every executor reads the vocabulary at
    ``path``. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*load_pieces(path))
        for b in batches:
            n = [counter.count(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long")
