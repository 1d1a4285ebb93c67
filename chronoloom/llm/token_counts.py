"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton over the vocabulary enumerates the pieces that end at each character; dynamic programming
carries, for each place, the best score and the number of pieces of the path that has it, and nothing else. Ties fall as
in the tokenizers library's unigram model: a later candidate replaces an earlier one only if its score is higher, and
candidates for a place come longest first, the unknown character last. Unknown characters are counted by their UTF-8
bytes (byte fallback), or a run of them as one.

The vocabulary is that of a sentencepiece file. Its own scores are merge ranks, so by default a piece of rank r gets the
score of Zipf's law, -ln(r * H), H being the harmonic sum; ``scores="file"`` takes the scores of the file.

A text is split before each space as the metaspace rule does (a leading space is added); each part is a Viterbi problem
of its own, and each Python worker remembers the results of up to twice ``MEMO`` parts of up to ``SHORT`` characters. Only the last ``longest`` places of a part
are kept, so a part of any length takes little memory.

Defined results: a null or empty text has 0 tokens. Repeated rows are counted each. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import as_long, as_text
from .tokens import FOLDER

SPACE_MARK = "▁"
MEMO, SHORT = 400_000, 64
#: Fixed value: what the score of an unknown character lies below the lowest score of the vocabulary.
UNKNOWN_PENALTY = 10.0


def vocabulary(path: str, scores: str = "zipf") -> list[tuple[str, float]]:
    """(piece, score) in the order of ids, control pieces left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not sp.is_control(i)]
    if scores == "file":
        return [(sp.id_to_piece(i), sp.get_score(i)) for i in ids]
    h = math.fsum(1 / r for r in range(1, len(ids) + 1))
    return [(sp.id_to_piece(i), -math.log(r * h)) for r, i in enumerate(ids, 1)]


class Unigram:
    def __init__(self, vocab: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max(len(piece) for piece, _ in vocab)
        self.unknown = min(score for _, score in vocab) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.memo: dict[str, tuple[int, float]] = {}
        self.older: dict[str, tuple[int, float]] = {}

    def part(self, s: str) -> tuple[int, float]:
        """Pieces and score of the best path over one part."""
        size = self.longest + 1
        score, pieces, after_unknown = [0.0] * size, [0] * size, [False] * size  # rings over the last places
        at = 0

        def close(end: int, found: list[tuple[int, float]]) -> None:
            best, n, unk, single = -math.inf, 0, False, False
            for length, value in sorted(found, reverse=True):
                single |= length == 1
                if (total := value + score[(end - length) % size]) > best:
                    best, n, unk = total, pieces[(end - length) % size] + 1, False
            if not single and (total := self.unknown + score[(end - 1) % size]) > best:
                before = (end - 1) % size
                own = len(s[end - 1].encode("utf-8", "surrogatepass")) if self.byte_fallback else int(not after_unknown[before])
                best, n, unk = total, pieces[before] + own, True
            score[end % size], pieces[end % size], after_unknown[end % size] = best, n, unk

        found: list[tuple[int, float]] = []
        for last, match in self.automaton.iter(s):
            if last + 1 != at:
                if at:
                    close(at, found)
                for gap in range(at + 1, last + 1):
                    close(gap, [])
                at, found = last + 1, []
            found.append(match)
        if at:
            close(at, found)
        for gap in range(at + 1, len(s) + 1):
            close(gap, [])
        return pieces[len(s) % size], score[len(s) % size]

    def remembered(self, s: str) -> tuple[int, float]:
        """The same for a part without its mark. A full memo becomes the older half, from which parts that come again are taken over."""
        if (got := self.memo.get(s)) is not None:
            return got
        if (got := self.older.get(s)) is None:
            got = self.part(SPACE_MARK + s)
        if len(s) <= SHORT:
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[s] = got
        return got

    def count(self, text: str | None) -> tuple[int, float]:
        """Tokens and score of a text."""
        if not text:
            return 0, 0.0
        marked = text.replace(" ", SPACE_MARK)
        if marked[0] != SPACE_MARK:
            marked = SPACE_MARK + marked
        n, total, memo = 0, 0.0, self.memo
        for part in marked.split(SPACE_MARK)[1:]:
            got = memo.get(part)
            if got is None:
                got, memo = self.remembered(part), self.memo
            n += got[0]
            total += got[1]
        return n, total


@functools.lru_cache(maxsize=1)
def unigram(path: str, scores: str = "zipf", byte_fallback: bool = True) -> Unigram:
    return Unigram(vocabulary(path, scores), byte_fallback)


def count_tokens(docs: DataFrame, path: str = f"{FOLDER}/piece_bpe_32k.model", scores: str = "zipf", byte_fallback: bool = True) -> DataFrame:
    """doc_id, n_tokens and score of every document; one pass, no shuffle."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = unigram(path, scores, byte_fallback)
        for pdf in batches:
            rows = [model.count(t) for t in pdf["text"]]
            out = pd.DataFrame(rows, columns=["n_tokens", "score"])
            out.insert(0, "doc_id", pdf["doc_id"].array)
            yield out

    return as_long(docs.select(as_text("doc_id"), "text").mapInPandas(counted, "doc_id string, n_tokens long, score double"), "doc_id")
