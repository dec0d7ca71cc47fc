"""Counters of a run, taken in the pass that writes its rows (AG9, AG10, 2.17 run metrics).

``Dataset.observe`` adds the counters to the job that writes a plan or a review, as the last step before the files, so nothing is read
again to be counted, and a task that is repeated after a lost executor counts once. A stream reports the counters of each
batch to a listener, which keeps them by batch: a replayed batch replaces its own.

Cases: an empty plan has zeros; rows without a note, review or skipped checks count in none of these; kinds of calls that aren't known are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Checks that were wanted and couldn't be made, and what a warning says of them.
SKIPPED = {
    "reading": "decided without reading the text: its reader had stopped",
    "images": "decided without reading images: their reader had stopped",
    "covers": "covers not compared: no reader of images",
    "years": "years not checked again: readings are off",
    "scans": "scanned pages not read: no reader of images",
}
#: What is asked of readers, and how an answer may come about.
CALLS = {"read": ("asked", "cached"), "cover": ("asked", "cached", "identical"), "embedded": ("asked", "cached", "identical"), "author": ("asked", "cached"), "year": ("asked",)}


def _n(when: Column) -> Column:
    return F.coalesce(F.count_if(when), F.lit(0))


def plan_counters(columns: list[str]) -> dict[str, Column]:
    """AG9: counters over PLAN rows; those of skipped checks if there is a column ``skipped`` of their names."""
    why, review, notes = F.col("why"), F.coalesce("review", F.lit("")), F.coalesce("notes", F.array().cast("array<string>"))
    said = lambda text: F.exists(notes, lambda x: x.contains(text))
    out = {
        "records": F.count(F.lit(1)),
        "moved": _n(F.col("action") == "move"), "trashed": _n(F.col("action") == "trash"), "left": _n(F.col("action") == "leave"), "selected": _n(F.col("selected")),
        "swapped": _n(said("title and author were swapped")), "identical_files": _n(why == "same file"), "same_text": _n(why == "same text"),
        "by_cover": _n(why.contains("same cover")), "no_edition": _n(why == "nothing tells them apart"), "held": _n(why.startswith("held")), "empty": _n(why == "no formats"),
        "unreadable": _n(said("unreadable") | (why == "no format that opens")), "other_language": F.coalesce(F.sum(F.size(F.filter(notes, lambda x: x.contains("is in another language")))), F.lit(0)),
        "to_review": _n(review != ""), "overruled": _n(F.col("override")),
    }
    if "skipped" in columns:
        out |= {f"skipped_{k}": _n(F.array_contains("skipped", k)) for k in SKIPPED}
    return out


def review_counters() -> dict[str, Column]:
    """AG10: counters over reviewed records (``found``: was it read, ``cached``, ``changes`` and ``left_out``: numbers of them)."""
    read = F.col("found")
    return {"reviewed": F.count(F.lit(1)), "changed": _n(F.col("changes") > 0), "left_out": F.coalesce(F.sum("left_out"), F.lit(0)), "not_read": _n(~read), "read": _n(read & ~F.col("cached")), "read_cached": _n(read & F.col("cached"))}


def call_counters() -> dict[str, Column]:
    """Counters over ``calls(kind, how)`` of readers."""
    return {k if how == "asked" else f"{k}_{how}": _n((F.col("kind") == k) & (F.col("how") == how)) for k, hows in CALLS.items() for how in hows}


def written_counting(df: DataFrame, path: str, counters: Mapping[str, Column]) -> dict[str, int]:
    """Writes ``df`` and gives its counters, from the same pass."""
    seen = Observation(f"counters-{uuid.uuid4().hex}")
    df.observe(seen, *(c.cast("bigint").alias(k) for k, c in counters.items())).write.parquet(path)
    # a plan that turns out to be empty may be replaced as a whole, and its counters with it
    return dict(seen.get) if df.sparkSession.read.parquet(path).limit(1).count() else dict.fromkeys(counters, 0)


def summary(counts: Mapping[str, int]) -> tuple[str, list[str]]:
    """One line of what was done, without what didn't occur, and the warnings."""
    n = lambda k: counts.get(k, 0)
    parts = [
        (n("read") + n("read_cached"), f"{n('read')} pages read ({n('read_cached')} from earlier runs)"),
        (n("cover") + n("cover_cached") + n("cover_identical"), f"{n('cover') + n('cover_cached') + n('cover_identical')} covers compared ({n('cover')} asked, {n('cover_cached')} from earlier runs, {n('cover_identical')} of one file)"),
        (n("embedded") + n("embedded_cached") + n("embedded_identical"), f"{n('embedded') + n('embedded_cached') + n('embedded_identical')} covers inside files compared ({n('embedded')} asked)"),
        (n("author") + n("author_cached"), f"{n('author')} names of authors asked ({n('author_cached')} from earlier runs)"),
        (n("year"), f"{n('year')} years checked again"),
        (n("swapped"), f"{n('swapped')} with title and author swapped"),
        (n("identical_files"), f"{n('identical_files')} duplicates by their files"),
        (n("same_text"), f"{n('same_text')} duplicates by their text"),
        (n("no_edition"), f"{n('no_edition')} duplicates that nothing tells apart"),
        (n("held"), f"{n('held')} held: to put right first"),
        (n("empty"), f"{n('empty')} without a file"),
        (n("to_review"), f"{n('to_review')} to look at"),
        (n("other_language"), f"{n('other_language')} copies in another language"),
    ]
    return " | ".join(text for k, text in parts if k) or "nothing was read", [f"{n(f'skipped_{k}')} records {text}" for k, text in SKIPPED.items() if n(f"skipped_{k}")]


class StreamCounters(StreamingQueryListener):
    """Keeps the counters that the batches of a stream observe under ``name``."""

    def __init__(self, name: str) -> None:
        self.name, self.by_batch = name, {}

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.by_batch[event.progress.batchId] = row.asDict()

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        pass

    def totals(self) -> dict[str, int]:
        """Sums over all batches."""
        names = dict.fromkeys(k for row in self.by_batch.values() for k in row)
        return {k: sum(row.get(k) or 0 for row in self.by_batch.values()) for k in names}
