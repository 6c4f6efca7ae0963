"""Page-to-page context over a stream: each page gets the tail and outline of the pages before it.

Pages of a document may arrive in any order and batch; a page is emitted once all before it have come,
or once it has waited ``patience`` for them.  State of a document, each in a variable of its own, so
that a page touches only what it changes:

* ``held``: a map from page number to text, of pages that wait; one is read only when its turn comes;
* ``headings``: a list, the last headings of the pages emitted;
* ``cursor``: the number that comes next, the end of the page before, how many pages were passed over,
  and the timer that runs.

While a page waits a timer runs.  When it expires, the page with the least number goes out although
those before it never came (``lost`` counts them in its row), and so do those that follow it.  A lost
page that comes after all, and a page that comes again, change nothing.  A page without a number is
left out; a null text is an empty page.

The state store must be RocksDB (``use_state_variables``), which keeps a variable's entries apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators.stitching import CONVERT_TAIL, OUTLINE_HEADINGS

OUT = "doc_id string, page_num int, md string, prev_tail string, outline string, lost int"
#: milliseconds that a page waits for those before it
PATIENCE = 3_600_000


def use_state_variables(spark: SparkSession) -> None:
    """Choose the state store that keeps state variables; before a stream is started."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Carry(StatefulProcessor):
    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "page_num int", "md string")
        self.headings = handle.getListState("headings", "heading string")
        self.cursor = handle.getValueState("cursor", "following int, tail string, timer long")

    def _known(self) -> tuple[int, str, int]:
        return self.cursor.get() if self.cursor.exists() else (0, "", 0)

    def _emitted(self, doc: str, following: int, tail: str, lost: int = 0) -> tuple[list[Row], int, str]:
        """The held pages whose turn has come, with the number and the tail that come next."""
        out, known = [], None
        while self.held.containsKey((following,)):
            (md,) = self.held.getValue((following,))
            self.held.removeKey((following,))
            known = [h for (h,) in self.headings.get()] if known is None else known
            out.append(Row(doc_id=doc, page_num=following, md=md, prev_tail=tail, outline="\n".join(known), lost=lost))
            known = (known + [x for x in md.split("\n") if re.match("#{1,4} ", x)])[-OUTLINE_HEADINGS:]
            tail, following, lost = md[-CONVERT_TAIL:], following + 1, 0
        if known is not None:
            self.headings.put([(h,) for h in known]) if known else self.headings.clear()
        return out, following, tail

    def _settle(self, following: int, tail: str, timer: int, now: int, moved: bool) -> None:
        """Keep the cursor, and a timer while pages wait: it starts anew when something went out."""
        waits = next(iter(self.held.keys()), None) is not None
        if timer and (moved or not waits):
            self.handle.deleteTimer(timer)
            timer = 0
        if waits and not timer:
            timer = now + self.patience
            self.handle.registerTimer(timer)
        self.cursor.update((following, tail, timer))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        following, tail, timer = self._known()
        for row in rows:
            n = row["page_num"]
            if n is not None and n >= following and not self.held.containsKey((n,)):
                self.held.updateValue((n,), (row["md"] or "",))
        out, following, tail = self._emitted(key[0], following, tail)
        self._settle(following, tail, timer, timerValues.getCurrentProcessingTimeInMs(), bool(out))
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        following, tail, timer = self._known()
        if timer == expiredTimerInfo.getExpiryTimeInMs():  # else it was one of before
            least = min((n for (n,) in self.held.keys()), default=following)
            out, following, tail = self._emitted(key[0], least, tail, least - following)
            self._settle(following, tail, 0, timerValues.getCurrentProcessingTimeInMs(), False)
            yield from out


def with_context(pages: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """A streaming ``pages`` (doc_id string, page_num int, md string) with prev_tail, outline and lost."""
    rows = pages.select("doc_id", "page_num", "md").filter("doc_id is not null")
    return rows.groupBy("doc_id").transformWithState(Carry(patience), OUT, "Append", "ProcessingTime")
