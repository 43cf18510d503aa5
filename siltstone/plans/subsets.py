"""Row ids of recently used filters, kept for the next search with them."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable, Mapping
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class Subsets:
    """The ``most`` last used subsets of a corpus, persisted on the executors; the oldest goes when one more comes."""

    def __init__(self, most: int = 16):
        self.most = most
        self.kept: OrderedDict[str, DataFrame] = OrderedDict()

    def of(self, filters: Mapping[str, Any], make: Callable[[], DataFrame]) -> DataFrame:
        """What make() gives for these filters; equal filters in any order are one subset."""
        key = json.dumps(filters, sort_keys=True, ensure_ascii=False, default=str)
        if key not in self.kept:
            self.kept[key] = make().persist(StorageLevel.MEMORY_AND_DISK)
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)[1].unpersist()
        self.kept.move_to_end(key)
        return self.kept[key]

    def clear(self) -> None:
        while self.kept:
            self.kept.popitem()[1].unpersist()
