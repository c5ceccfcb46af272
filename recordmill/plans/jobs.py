"""A declarative job: filter, first-wins dedupe, only-new, cap, and the next state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..operators import ordered, state


@dataclass(frozen=True)
class Job:
    """key: identity of a row; order: arrival; keep: predicate; mark: fingerprint column; most: cap; by: group of the cap."""

    key: list[str]
    order: list
    keep: Column | None = None
    mark: str | None = None
    most: int | None = None
    by: list[str] | None = None
    remembered: int = 50_000

    def run(self, source: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows to emit, seen set of the next run: key, time and mark; the first ordering column is the time).

        What was known before and is listed again stays recent.  Rows that are new but were cut off by the cap are
        not remembered, so that the next run emits them.
        """
        rows = source if self.keep is None else source.where(self.keep)
        listed = ordered.first_wins(rows, self.key, self.order)
        rows = state.only_new(listed, seen, self.key, self.mark)
        if self.most is not None:
            rows = ordered.top_per_group(rows, self.by, self.order, self.most) if self.by else rows.orderBy(*self.order).limit(self.most)
        columns = [*self.key, self.order[0], *([self.mark] if self.mark else [])]
        known = listed.select(*columns).join(seen.select(*self.key, *([self.mark] if self.mark else [])).distinct(), [*self.key, *([self.mark] if self.mark else [])], "left_semi")
        return rows, state.next_seen(rows.select(*columns).unionByName(known.select(*columns)), seen, self.key, self.order[0], self.remembered, mark=self.mark)
