"""Token counts: a unigram segmentation whose forward scores are shared along a trie.

A word (with the word-start mark before it) is cut into vocabulary pieces so that the
sum of the pieces' scores is greatest; of equal sums the one with fewer pieces counts.
Characters no piece covers cost one byte token for each UTF-8 byte. The distinct words
of a slice of texts are visited in order, which is a walk of their trie: forward scores
of a shared prefix are computed once and kept on the path, and a word's count is stored
where it ends. Counts go to no other task, so nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from phrasestream.llm import words as W

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words whose counts a task keeps between slices; others are computed again.
MEMO = 400_000


def load_pieces(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces and scores of a sentencepiece vocabulary; not its control or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        model.id_to_piece(i): model.get_score(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }


def trie_counts(found, pieces: dict[str, float], longest: int, byte_score: float) -> dict[bytes, int]:
    """Tokens of each distinct word (bytes of UTF-8)."""
    counts: dict[bytes, int] = {}
    path = MARK
    # Along the path of the trie: best score and fewest pieces up to each character.
    best, fewest = [0.0], [0]
    get = pieces.get

    def step(i, j):
        """Forward score of the prefix that ends at j; i: its last character."""
        low = max(0, j - longest)
        top, few = best[i] + byte_score * len(path[i].encode("utf-8", "replace")), fewest[i] + len(path[i].encode("utf-8", "replace"))
        for k in range(low, j):
            score = get(path[k:j])
            if score is not None:
                score += best[k]
                if score > top or score == top and fewest[k] + 1 < few:
                    top, few = score, fewest[k] + 1
        best.append(top)
        fewest.append(few)

    step(0, 1)
    for raw in sorted(found):
        word = MARK + raw.decode("utf-8", "replace")
        shared, most = 0, min(len(path), len(word))
        if path[:most] == word[:most]:
            shared = most
        else:
            while path[shared] == word[shared]:
                shared += 1
        path = word
        del best[shared + 1 :], fewest[shared + 1 :]
        for j in range(shared + 1, len(word) + 1):
            step(j - 1, j)
        counts[raw] = fewest[-1]
    return counts


def token_counts(docs: DataFrame, pieces: dict[str, float]) -> DataFrame:
    """`docs` with _words and _tokens (long). A null or empty text has none of either.
    All other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # one vocabulary, tens of thousands of pieces

    def run(batches):
        table = shared.value
        longest = max(map(len, table), default=1)
        byte_score = min(table.values(), default=0.0) - 10.0
        memo: dict[bytes, int] = {}
        for part in W.slices(batches):
            texts = [Counter((t or "").encode("utf-8").split()) for t in part.column("text").to_pylist()]
            new = set().union(*texts) - memo.keys()
            if len(memo) + len(new) > MEMO:
                memo = {}
                new = set().union(*texts)
            memo |= trie_counts(new, table, longest, byte_score)
            tokens = [sum(n * memo[w] for w, n in t.items()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([t.total() for t in texts], pa.int64()), pa.array(tokens, pa.int64())],
                [*part.schema.names, "_words", "_tokens"])

    source = docs.drop("_words", "_tokens")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return source.mapInArrow(run, f"{fields}, _words long, _tokens long")
