"""Word error counts for batches of word-list pairs (numpy, inside a task)."""

from __future__ import annotations

import numpy as np


def word_errors(references: list[list[str]], hypotheses: list[list[str]]) -> np.ndarray:
    """Rows of (substitutions, deletions, insertions, distance), one per pair.

    Pairs are put in length order and aligned a group at a time, so that one
    numpy operation serves a whole group; memory grows with the hypothesis
    length, not with the product of the two lengths.
    """
    result = np.zeros((len(references), 4), dtype=np.int64)
    order = sorted(range(len(references)), key=lambda i: (len(references[i]), len(hypotheses[i])))
    at = 0
    while at < len(order):
        # Groups shrink as texts grow: about a million cells per row of work.
        widest, group = 0, []
        while at < len(order):
            width = max(widest, len(hypotheses[order[at]]) + 1)
            if group and width * (len(group) + 1) > 65_536:
                break
            widest = width
            group.append(order[at])
            at += 1
        result[group] = _align([references[i] for i in group], [hypotheses[i] for i in group])
    return result


def _encode(words: list[list[str]], ids: dict[str, int], filler: int) -> np.ndarray:
    width = max((len(w) for w in words), default=0)
    out = np.full((len(words), width), filler, dtype=np.int64)
    for row, text in enumerate(words):
        out[row, : len(text)] = [ids.setdefault(word, len(ids)) for word in text]
    return out


def _align(references: list[list[str]], hypotheses: list[list[str]]) -> np.ndarray:
    ids: dict[str, int] = {}
    ref, hyp = _encode(references, ids, -1), _encode(hypotheses, ids, -2)
    pairs, m = hyp.shape
    ref_n = np.array([len(r) for r in references])
    hyp_n = np.array([len(h) for h in hypotheses])
    column = np.arange(m + 1)
    # cost[p, j]: distance between the reference words so far and hyp[:j];
    # edits[k, p, j]: substitutions, deletions, insertions on the chosen path.
    cost = np.tile(column, (pairs, 1))
    edits = np.zeros((3, pairs, m + 1), dtype=np.int64)
    edits[2] = cost
    out = np.zeros((pairs, 4), dtype=np.int64)
    rows = np.arange(pairs)

    def keep(done):
        out[done, :3] = edits[:, done, hyp_n[done]].T
        out[done, 3] = cost[done, hyp_n[done]]

    keep(np.flatnonzero(ref_n == 0))
    for i in range(ref.shape[1]):
        same = ref[:, i, None] == hyp
        replaced, removed = cost[:, :-1] + ~same, cost[:, 1:] + 1
        best = np.empty_like(cost)
        best[:, 0] = i + 1
        best[:, 1:] = np.where(same, replaced, np.minimum(replaced, removed))
        # An insertion continues the cell to its left: a running minimum.
        reached = np.minimum.accumulate(best - column, axis=1) + column
        inserted = reached < best
        inserted[:, 1:] &= ~same
        fresh = np.empty_like(edits)
        fresh[:, :, 0] = edits[:, :, 0]
        diagonal = same | (replaced <= removed)
        fresh[:, :, 1:] = np.where(diagonal, edits[:, :, :-1], edits[:, :, 1:])
        fresh[0, :, 1:] += diagonal & ~same
        fresh[1, :, 1:] += ~diagonal
        fresh[1, :, 0] += 1
        # Where the path arrives by insertions, take the counts of the cell
        # the run of insertions started from.
        origin = np.maximum.accumulate(np.where(inserted, 0, column), axis=1)
        edits = fresh[:, rows[:, None], origin]
        edits[2] += column - origin
        cost = reached
        keep(np.flatnonzero(ref_n == i + 1))
    return out
