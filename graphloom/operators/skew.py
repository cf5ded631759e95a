"""Joins whose hot keys can be split."""

from __future__ import annotations

from pyspark.sql import DataFrame


def own_shuffle(keyed: DataFrame) -> DataFrame:
    """A keyed side (an aggregate or distinct of the join key) that no longer carries its partitioning.

    Such a side would otherwise join where it lies, without a shuffle of its own, and adaptive
    execution could not split a hot key of the other side. The key's rows are few, so dealing them
    out once more is cheap beside a hot key in one task.
    """
    return keyed.hint("rebalance")
