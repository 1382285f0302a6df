"""Groups of rows inside Arrow batches: many small groups a call instead of a call a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def turns(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Positions at which a new group of ``keys`` starts, the first row apart."""
    own = rows[keys].to_numpy()
    return np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by ``keys``, cut so that no group spans two of them."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        at = turns(rest, keys)
        if len(at):
            yield rest.iloc[: at[-1]].reset_index(drop=True)
            rest = rest.iloc[at[-1] :].reset_index(drop=True)
    if rest is not None:
        yield rest


def pairs_within(rows: pd.DataFrame, keys: list[str], at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b), a before b, of the pairs inside each group, about ``at_once`` at a time."""
    n = len(rows)
    ends = np.append(turns(rows, keys), n)
    partners = np.repeat(ends, np.diff(np.concatenate(([0], ends)))) - np.arange(n) - 1
    total = np.cumsum(partners)
    first = 0
    while first < n:
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + at_once, side="right")))
        own = partners[first:last]
        a = np.repeat(np.arange(first, last), own)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own)
        first = last
        yield a, b
