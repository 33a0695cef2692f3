"""Street facts merged from a stream of pages: a page that is delivered again takes back its earlier share.

State is a map by page for each street, so a street's pages are rows of their own in the state store, read and written
one at a time. A delivery counts if it is newer than what the page has; replays and late retries change nothing. What a street
amounts to is given anew, with a rising revision, whenever one of its pages has changed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridlume.runtime import ship

_LISTS = ("locations", "incident_ids", "types")
_FIRST = ("label", "name", "city", "postcode")
_OUT = "key {kind}, revision long, pages long, households double, " + ", ".join(f"{c} string" for c in _FIRST) + ", " + ", ".join(f"{c} array<string>" for c in _LISTS)


def page_fact(households: Column, **fields: Column) -> Column:
    """A page's share of a street as JSON: households, and any of label, name, city, postcode, locations, incident_ids and types."""
    return F.to_json(F.struct(households.cast("double").alias("households"), *(v.alias(k) for k, v in fields.items())))


class PageFacts(StatefulProcessor):
    """The shares of a street's pages, by page."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "page long", "version long, fact string")
        self.revision = handle.getValueState("revision", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        changed, newest = False, {}
        for frame in rows:
            for page, version, fact in zip(frame["page"].tolist(), frame["version"].tolist(), frame["fact"].tolist(), strict=True):
                if page not in newest or newest[page][0] < version:
                    newest[page] = (int(version), fact)
        # a page's newest delivery of the batch alone meets the state, each look at which is a round trip
        for page, own in newest.items():
            at = (int(page),)
            if not self.pages.containsKey(at) or self.pages.getValue(at)[0] < own[0]:
                self.pages.updateValue(at, own)
                changed = True
        if changed:
            n = 1 + (self.revision.get()[0] if self.revision.exists() else 0)
            self.revision.update((n,))
            yield pd.DataFrame([(key[0], n, *self._merged())], columns=["key", "revision", "pages", "households", *_FIRST, *_LISTS])

    def _merged(self) -> tuple:
        shares = [json.loads(v[1]) for _, v in sorted(((k[0], v) for k, v in self.pages.iterator()), key=lambda x: x[0])]
        first = shares[0] if shares else {}
        lists = ([*dict.fromkeys(v for s in shares for v in s.get(c) or [] if v)] for c in _LISTS)
        return (len(shares), float(sum(s.get("households") or 0 for s in shares)), *(first.get(c) for c in _FIRST), *lists)

    def close(self) -> None:
        pass


def street_facts_stream(pages: DataFrame) -> DataFrame:
    """``key, revision, pages, households, label, ..., types`` of a stream of ``key, page, version, fact`` (``page_fact``); the row of the
    greatest revision of a key holds. A null page or version counts as -1."""
    kind = dict(pages.dtypes)["key"]
    ship(pages.sparkSession)
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c)
    return pages.select("key", whole("page"), whole("version"), "fact").groupBy("key").transformWithStateInPandas(PageFacts(), _OUT.format(kind=kind), "Append", "None")


def latest_facts(revisions: DataFrame) -> DataFrame:
    """The facts that hold: of each key the greatest revision."""
    rest = [c for c in revisions.columns if c not in ("key", "revision")]
    return revisions.groupBy("key").agg(F.max_by(F.struct(*rest), "revision").alias("r")).select("key", "r.*")
