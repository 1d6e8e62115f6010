"""Pairing the rows of one answer table with its golden table, as numpy on match matrices.

Spark groups the rows; a call sees one (run, question) whose size was checked to equal
the golden table's. Column order and row order are free, so a pairing is a column
permutation plus a row assignment.
"""

from __future__ import annotations

import itertools

import numpy as np

from landledger.functions.cells import (
    ABS_TOL, FALSE_WORDS, GEOM_INT_SHARE, GEOM_INT_SLACK, GEOM_REL_TOL, NEAR_MISS_FACTOR, REL_TOL, TRUE_WORDS,
)

# Up to so many columns every order is tried; wider tables take the best assignment of columns.
FREE_COLUMNS = 6
WORDS = {**dict.fromkeys(TRUE_WORDS, 1.0), **dict.fromkeys(FALSE_WORDS, 0.0)}


class Columns:
    """The cells of one table column by column, as arrays ready for comparison."""

    def __init__(self, rows: list[list[dict]], codes: dict[str, int]):
        self.width = len(rows[0])
        columns = list(zip(*rows))
        folded = [[c["s"].casefold() for c in col] for col in columns]
        self.is_text = [np.array([c["kind"] == "s" for c in col]) for col in columns]
        self.is_int = [np.array([c["kind"] == "i" for c in col]) for col in columns]
        self.number = [np.array([np.nan if c["d"] is None else c["d"] for c in col]) for col in columns]
        self.spelled = [np.array([-1 if c["n"] is None else codes.setdefault(f"#{c['n']}", len(codes)) for c in col]) for col in columns]
        self.text = [np.array([codes.setdefault(t, len(codes)) for t in col]) for col in folded]
        self.word = [
            np.array([WORDS.get(t, np.nan) for t in texts]) if text.any() else np.full(len(texts), np.nan)
            for texts, text in zip(folded, self.is_text)
        ]
        self.truth = [
            np.where(i & ((w == 0) | (w == 1)), w.astype(float), word)
            for i, w, word in zip(self.is_int, self.number, self.word)
        ]
        self.worded = [not np.isnan(word).all() for word in self.word]
        self.numeric = [not text.all() for text in self.is_text]
        self._rounded: dict[int, list[tuple[int, np.ndarray]]] = {}

    def rounded_to(self, j: int) -> list[tuple[int, np.ndarray]]:
        """Decimal places that numbers of column j are written with, and which."""
        if j not in self._rounded:
            places = np.array([_places(v) for v in self.number[j].tolist()])
            self._rounded[j] = [(k, places == k) for k in set(places.tolist()) if k >= 0]
        return self._rounded[j]


def _places(value: float) -> int:
    """Decimal places a float is written with, -1 in exponent form."""
    text = repr(float(value))
    return -1 if "e" in text or not np.isfinite(value) else len(text.partition(".")[2])


def match_matrix(a: Columns, i: int, g: Columns, j: int, geometry: bool, slack: float) -> np.ndarray:
    """[answer row, golden row] of whether answer column i matches golden column j."""
    both_text = a.is_text[i][:, None] & g.is_text[j][None, :]
    out = both_text & (a.text[i][:, None] == g.text[j][None, :])
    if not a.worded[i] and not g.worded[j] and not (a.numeric[i] and g.numeric[j]):
        return out
    both_num = ~a.is_text[i][:, None] & ~g.is_text[j][None, :]
    if both_num.any():
        an, gn = a.number[i][:, None], g.number[j][None, :]
        rounded = np.broadcast_to(an, both_num.shape).copy()
        for places, those in g.rounded_to(j):
            rounded[:, those] = np.round(an, places)
        with np.errstate(invalid="ignore"):
            gap = np.abs(rounded - gn)
            rel = slack * (GEOM_REL_TOL if geometry else REL_TOL)
            room = np.maximum(rel * np.maximum(np.abs(rounded), np.abs(gn)), ABS_TOL)
            near = (rounded == gn) | (np.isfinite(rounded) & np.isfinite(gn) & (gap <= room))
        out = np.where(both_num, near, out)
        both_int = a.is_int[i][:, None] & g.is_int[j][None, :]
        if both_int.any():
            if geometry or slack > 1:
                with np.errstate(invalid="ignore"):
                    whole = np.abs(an - gn) <= slack * np.maximum(GEOM_INT_SLACK, GEOM_INT_SHARE * np.abs(gn))
            else:
                whole = a.spelled[i][:, None] == g.spelled[j][None, :]
            out = np.where(both_int, whole, out)
    if a.worded[i] or g.worded[j]:
        worded = ~np.isnan(a.word[i])[:, None] | ~np.isnan(g.word[j])[None, :]
        at, gt = a.truth[i][:, None], g.truth[j][None, :]
        out = np.where(worded & ~np.isnan(at) & ~np.isnan(gt), at == gt, out)
    return out


def both_columns(answer: list, golden: list) -> tuple[Columns, Columns]:
    codes: dict[str, int] = {}
    return Columns(answer, codes), Columns(golden, codes)


def grid_of(a: Columns, g: Columns, geometry: bool, slack: float, known: list[list[np.ndarray]] | None = None) -> list[list[np.ndarray]]:
    """Match matrices of every answer column with every golden column. ``known`` is the grid under another slack, which
    holds for columns without two numbers to compare."""

    def matrix(i: int, j: int) -> np.ndarray:
        if known is not None and not (a.numeric[i] and g.numeric[j]):
            return known[i][j]
        return match_matrix(a, i, g, j, geometry, slack)

    return [[matrix(i, j) for j in range(g.width)] for i in range(a.width)]


def match_grid(answer: list, golden: list, geometry: bool, slack: float) -> list[list[np.ndarray]]:
    return grid_of(*both_columns(answer, golden), geometry, slack)


def _assign(rows: np.ndarray) -> bool:
    """Each answer row in turn takes the first golden row still free that it matches."""
    free = np.ones(rows.shape[1], dtype=bool)
    for row in rows:
        hit = np.flatnonzero(row & free)
        if not len(hit):
            return False
        free[hit[0]] = False
    return True


def same_table(grid: list[list[np.ndarray]]) -> bool:
    """Some column permutation under which every row finds a partner.

    Columns are placed one at a time; a partial placement that already leaves a row
    without any partner is given up, so most permutations are never formed.
    """
    width = len(grid)

    def place(j: int, left: frozenset, rows: np.ndarray) -> bool:
        if j == width:
            return _assign(rows)
        for i in sorted(left):
            both = rows & grid[i][j]
            if both.any(axis=1).all() and both.any(axis=0).all() and place(j + 1, left - {i}, both):
                return True
        return False

    return place(0, frozenset(range(width)), np.ones(grid[0][0].shape, dtype=bool))


def _assignment(cost: np.ndarray) -> tuple[int, ...]:
    """For each column of ``cost`` the row given to it, with the least total (shortest augmenting paths)."""
    n = len(cost)
    u, v, owner = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0], at = row, 0
        least, seen, came = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=int)
        while owner[at]:
            seen[at] = True
            open_ = ~seen
            open_[0] = False
            reduced = np.r_[np.inf, cost[owner[at] - 1] - u[owner[at]] - v[1:]]
            better = open_ & (reduced < least)
            least[better], came[better] = reduced[better], at
            nearest = int(np.argmin(np.where(open_, least, np.inf)))
            step = least[nearest]
            u[owner[seen]] += step
            v[seen] -= step
            least[open_] -= step
            at = nearest
        while at:
            owner[at], at = owner[came[at]], came[at]
    return tuple(int(r) - 1 for r in owner[1:])


def _orders(misses: list[list[np.ndarray]]):
    """Column orders worth trying: all of a narrow table; of a wide one the given order and the best assignment
    by the golden cells that no answer cell of a column matches."""
    identity = tuple(range(len(misses)))
    if len(identity) <= FREE_COLUMNS:
        return itertools.permutations(identity)
    lonely = np.array([[m.min(axis=0).sum() for m in row] for row in misses], dtype=float)
    return [identity, _assignment(lonely)]


def best_alignment(grid: list[list[np.ndarray]]) -> tuple[tuple, list[tuple[int, int]]]:
    """Permutation and row pairs with the fewest differing cells, rows paired greedily."""
    width = len(grid)
    misses = [[(~m).astype(np.int64) for m in row] for row in grid]
    best = None
    for order in _orders(misses):
        cost = sum(misses[i][j] for j, i in enumerate(order)).T
        if best is not None and cost.min(axis=1).sum() >= best[0]:
            continue  # no pairing of rows differs in fewer cells
        taken = np.zeros(cost.shape[1], dtype=bool)
        pairs, total = [], 0
        for k, row in enumerate(cost):
            pick = int(np.argmin(np.where(taken, width + 1, row)))
            taken[pick] = True
            pairs.append((k, pick))
            total += int(row[pick])
        if best is None or total < best[0]:
            best = (total, order, pairs)
        if total == 0:
            break
    return best[1], best[2]


def cell_differences(
    answer: list, golden: list, strict: list[list[np.ndarray]], near: list[list[np.ndarray]], header: list[str]
) -> list[dict]:
    """One record per differing cell of the best alignment."""
    order, pairs = best_alignment(strict)
    out = []
    for g_row, a_row in pairs:
        for j, i in enumerate(order):
            if strict[i][j][a_row, g_row]:
                continue
            got, want = answer[a_row][i], golden[g_row][j]
            numeric = got["kind"] != "s" and want["kind"] != "s" and want["d"] != 0
            out.append({
                "kind": "cell", "row": g_row,
                "column": header[j] if j < len(header) else f"col{j}",
                "golden": want["s"], "answer": got["s"],
                "rel_error": round(abs(got["d"] - want["d"]) / abs(want["d"]), 6) if numeric else None,
                "near_miss": bool(near[i][j][a_row, g_row]),
            })
    return out
