"""Token counts: how many greedy word pieces a text has, without building them.

A linear longest-match automaton (Song et al., Fast WordPiece Tokenization, 2021):
a trie over the vocabulary with failure links; the number of pieces that a failure
pops is precomputed, so a word costs time linear in its length and only a counter
is kept. Words recur, so each worker remembers the counts of recent words.

Null and empty texts have no words and no pieces. A word that the vocabulary cannot
cover counts as one unknown piece. Null ids are kept; repeated rows are counted again, and
each alike. Very long texts and words are counted whole; an empty table gives an empty
result; other columns, whatever their names, are left out first. There are no ties: the
longest piece is one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from concord.llm._common import Interner, kept, map_texts

#: Words of letters, digits and marks, or single other characters; the rest is white space.
WORD = re.compile(r"\w+|[^\w\s]|_")


def load_vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Pieces that may begin a word and pieces that may continue one, from a
    sentencepiece file: pieces marked with U+2581 begin words, others continue them,
    and single characters may do both. Control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first, later = set(), set()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        if piece.startswith("▁"):
            first.add(piece[1:])
        else:
            later.add(piece)
            if len(piece) == 1:
                first.add(piece)
    return sorted(first - {""}), sorted(later - {""})


class PieceCounter:
    """States: 0 is the root of word beginnings, 1 that of continuations."""

    def __init__(self, first: list[str], later: list[str]):
        step: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                state = root
                for c in piece:
                    if c not in step[state]:
                        step[state][c] = len(step)
                        step.append({})
                        ends.append(False)
                    state = step[state][c]
                ends[state] = True
        fail, popped = [-1] * len(step), [0] * len(step)
        queue = [0, 1]
        for state in queue:
            for c, below in step[state].items():
                queue.append(below)
                if ends[below]:
                    fail[below], popped[below] = 1, 1
                    continue
                to, count = fail[state], popped[state]
                while to >= 0 and c not in step[to]:
                    count, to = count + popped[to], fail[to]
                if to >= 0:
                    fail[below], popped[below] = step[to][c], count
        self.step, self.fail, self.popped = step, fail, popped

    def count(self, word: str) -> int:
        """The number of pieces; 0 if the word cannot be covered."""
        step, fail, popped = self.step, self.fail, self.popped
        state, pieces = 0, 0
        for c in word:
            while c not in step[state]:
                if fail[state] < 0:
                    return 0
                pieces, state = pieces + popped[state], fail[state]
            state = step[state][c]
        while state > 1:
            if fail[state] < 0:
                return 0
            pieces, state = pieces + popped[state], fail[state]
        return pieces if state == 1 else 0


def counts_for(key: int, vocabulary: tuple[list[str], list[str]]) -> Interner:
    """The counts of recent words of this worker, shared by all its tasks because they call it by name."""
    return kept(("wordpiece", key), lambda: Interner(PieceCounter(*vocabulary).count))


def piece_counts(docs: DataFrame, vocabulary: tuple[list[str], list[str]], id_col: str = "doc_id", text_col: str = "text", lower: bool = False) -> DataFrame:
    """(id, n_words, n_pieces, n_unknown) of every whole text. ``n_pieces`` counts an
    unknown word as one piece."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)  # bounded: a tokenizer's vocabulary
    key = hash((tuple(vocabulary[0]), tuple(vocabulary[1])))

    def count(ids, texts):
        known = counts_for(key, shared.value).__getitem__
        words, pieces, unknown = [], [], []
        for text in texts:
            found = WORD.findall(text.lower() if lower else text) if text else []
            each = list(map(known, found))
            missing = each.count(0)
            words.append(len(found))
            unknown.append(missing)
            pieces.append(sum(each) + missing)
        return {"id": ids, "n_words": words, "n_pieces": pieces, "n_unknown": unknown}

    return map_texts(docs, id_col, text_col, "id bigint, n_words bigint, n_pieces bigint, n_unknown bigint", count)
