"""Clusters by leaders: each row joins the nearest earlier leader of its group that is near enough, or becomes one.

The result hangs on the order of rows, so a group is one stream: rows are dealt to tasks by group and sorted, and a task holds the leaders of the
group at hand only, never its rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the kinds of events that a title may name, by their words
EVENT_TERMS = {
    "earnings": r"실적|매출|영업이익|순이익|적자|흑자",
    "contract": r"수주|공급계약|판매계약|계약체결",
    "capital_action": r"배당|자사주|자기주식|소각|분할|병합|감자",
    "financing": r"유상증자|회사채|전환사채|차입|자금조달",
    "m_and_a": r"인수|합병|매각|기업결합",
    "litigation": r"소송|판결|수사|기소|중재",
    "regulatory": r"과징금|제재|허가|승인|규제",
    "labor": r"파업|노조|노사|임금협상",
    "product": r"출시|신제품|개발|특허",
    "supply_chain": r"생산중단|공급중단|물류|원재료",
    "market_move": r"주가|상한가|하한가|급등|급락|신고가|신저가",
}
_TERMS = {k: re.compile(v) for k, v in EVENT_TERMS.items()}
_NUMBER = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)?(?![0-9])")


def marks(title: str | None) -> tuple[frozenset, frozenset]:
    """(numbers but for years, kinds of events) of a title."""
    numbers = frozenset(n for n in _NUMBER.findall(title or "") if not (len(n) == 4 and 1900 <= int(float(n)) <= 2099))
    return numbers, frozenset(k for k, r in _TERMS.items() if r.search((title or "").lower()))


def compatible(a: tuple[frozenset, frozenset], b: tuple[frozenset, frozenset]) -> bool:
    """Numbers of one title are among the other's, and kinds of events meet, wherever both have some."""
    (n, e), (m, f) = a, b
    return not (n and m and not (n <= m or m <= n)) and not (e and f and not e & f)


class Leaders:
    """The leaders of one group in the order of their coming."""

    def __init__(self, threshold: float):
        self.threshold, self.ids, self.marks, self.vectors = threshold, [], [], None

    def assign(self, row_id, vector: np.ndarray, mark: tuple) -> tuple:
        """(leader, cosine): the nearest compatible leader, the earlier of equals; the row itself, which leads from now on, if none is near."""
        n = len(self.ids)
        if n:
            near = self.vectors[:n] @ vector
            for i in np.argsort(-near, kind="stable"):
                if near[i] < self.threshold:
                    break
                if compatible(mark, self.marks[i]):
                    return self.ids[i], float(near[i])
        if self.vectors is None or n == len(self.vectors):
            grown = np.zeros((max(16, 2 * n), len(vector)), dtype=np.float32)
            if n:
                grown[:n] = self.vectors
            self.vectors = grown
        self.vectors[n] = vector
        self.ids.append(row_id)
        self.marks.append(mark)
        return row_id, 1.0


def leader_clusters(rows: DataFrame, group: list[str], order: list, key: str, vector: str, title: str, threshold: float) -> DataFrame:
    """(group, key, leader, similarity) of every row, rows of a group in ``order``. Vectors are brought to length 1 in single precision; rows whose vector
    is null, nil or not finite lead themselves, and vectors of different lengths are not compared."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*group, key])
    key_kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, by_length = None, {}
        for pdf in frames:
            out = []
            for *g, k, v, t in pdf[[*group, key, "_v", "_t"]].itertuples(index=False):
                g = tuple(None if x is None or x != x else x for x in g)
                if g != now:
                    now, by_length = g, {}
                v = None if v is None else np.asarray(v, dtype=np.float32)
                size = 0.0 if v is None or not len(v) else float(np.linalg.norm(v))
                if not np.isfinite(size) or size == 0:
                    out.append((*g, k, k, 1.0))
                    continue
                led = by_length.setdefault(len(v), Leaders(threshold))
                out.append((*g, k, *led.assign(k, v / np.float32(size), marks(t))))
            yield pd.DataFrame(out, columns=[*group, key, "leader", "similarity"])

    some = rows.withColumns({"_v": F.col(vector), "_t": F.col(title)})
    dealt = some.repartition(*group).sortWithinPartitions(*group, *order).select(*group, key, "_v", "_t")
    return dealt.mapInPandas(run, f"{kinds}, leader {key_kind}, similarity double")
