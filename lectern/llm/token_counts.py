"""Token counts under a unigram tokenizer, without making tokens.

The tokenizer is the unigram model over the pieces and scores of a vocabulary file, with byte
fallback: blanks become ``\\u2581``, one more is put in front, and the best-scored cover of the text by
pieces wins. Aho-Corasick lists all pieces that end at each place; the dynamic program keeps only the
best score and its number of tokens per place. Tie rules are those of the ``tokenizers`` library's
``Unigram``: scores add in double precision from the left, an equal score does not replace, and
candidates for a place come by ascending start, so the longest last piece wins a tie. A character that
is no piece itself may be an unknown, at the lowest score less 10, and counts its UTF-8 bytes.

A piece never holds a mark after another character (checked when the vocabulary is read), so no piece
crosses from one blank-separated word into the next: words are counted one by one, and a worker
remembers the counts of words it has seen. With a vocabulary for which this does not hold, texts are
counted whole.

Defined results: null or empty text has 0 tokens; a very long text is counted whole, and a very long word is not remembered; rows that repeat are counted each on their own; a
null ``doc_id`` stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.workers import Remembered, map_arrow, own

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 500_000
MAX_VOCABULARY = 1_000_000
COUNTS = "doc_id long, n_tokens long"


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in the order of their ids."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=Path(path).read_bytes())
    if p.vocab_size() > MAX_VOCABULARY:
        raise ValueError(f"{p.vocab_size()} pieces; at most {MAX_VOCABULARY} are sent to executors")
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.vocab_size())]


class Counter:
    """Counts tokens of texts; remembers a bounded number of words."""

    def __init__(self, vocabulary: list[tuple[str, float]], cache_words: int = CACHE_WORDS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", piece) for piece, _ in vocabulary)
        self.remembered = Remembered(self.count_marked, cache_words)

    def count_marked(self, text: str) -> int:
        """Tokens of a text in which marks stand for blanks."""
        n = len(text)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for last, found in self.automaton.iter(text):
            ending[last].append(found)
        best, tokens = [0.0], [0]
        for end, pieces in enumerate(ending, 1):
            top, number, single = float("-inf"), 0, False
            for length, score in sorted(pieces, reverse=True) if len(pieces) > 1 else pieces:
                candidate = score + best[end - length]
                if candidate > top:
                    top, number = candidate, tokens[end - length] + 1
                single = single or length == 1
            if not single and self.unknown + best[end - 1] > top:
                top, number = self.unknown + best[end - 1], tokens[end - 1] + len(text[end - 1].encode())
            best.append(top)
            tokens.append(number)
        return tokens[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_word:
            return self.count_marked(MARK + text.replace(" ", MARK))
        words = text.split(" ")
        if "" in words or MARK in text:  # a run of marks belongs to the word after it
            marked = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK))
        else:
            marked = [MARK + x for x in words]
        return sum(map(self.remembered.__getitem__, marked))


_counters: dict[int, Counter] = {}


def _worker_counter(key: int, vocabulary: list[tuple[str, float]]) -> Counter:
    own("counts", _counters.clear)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(vocabulary)
    return _counters[key]


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Tokens of every whole text of ``docs`` (doc_id, text)."""
    pieces = read_vocabulary(vocabulary_path)
    key, vocabulary = hash(tuple(pieces)), docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _worker_counter(key, vocabulary.value)
        for batch in batches:
            counts = [counter.count(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return map_arrow(docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text"), run, COUNTS)
