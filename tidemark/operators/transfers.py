"""Moves between accounts: by words in the text, and by equal amounts in two accounts."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce
from heapq import heappop, heappush
from itertools import batched, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import any_of
from ..session import drop_stash, stash
from ..sources.keywords import TRANSFERS


def is_transfer(original: Column, place: Column | None = None, keywords: list[str] = TRANSFERS) -> Column:
    text = F.upper(F.coalesce(original, place) if place is not None else original)
    return F.coalesce(any_of(text, keywords), F.lit(False))


def transfer_pairs(ledger: DataFrame, days: int = 2, account: str = "statement") -> DataFrame:
    """Pairs of rows with the same positive amount in two accounts, at most `days` apart.

    ledger: txn_id, txn_date, amount and an account. Rows meet by amount and by stretches of days, so a frequent
    amount is dealt out over time. Returns id1 < id2, amount, days_apart, and both accounts and dates.
    """
    step = days + 1
    rows = ledger.where("amount > 0 and txn_date is not null").select("txn_id", "txn_date", "amount", F.col(account).alias("account"))
    rows = rows.withColumn("stretch", F.floor(F.unix_date("txn_date") / step))
    a = rows.select(F.col("txn_id").alias("id1"), F.col("txn_date").alias("date1"), "amount", F.col("account").alias("account1"), F.explode(F.sequence(F.col("stretch") - 1, F.col("stretch") + 1)).alias("stretch"))
    b = rows.select(F.col("txn_id").alias("id2"), F.col("txn_date").alias("date2"), "amount", F.col("account").alias("account2"), "stretch")
    apart = F.abs(F.date_diff("date1", "date2"))
    return a.join(b, ["amount", "stretch"]).where((F.col("id1") < F.col("id2")) & (F.col("account1") != F.col("account2")) & (apart <= days)).select(
        "id1", "id2", "amount", apart.alias("days_apart"), "account1", "account2", "date1", "date2"
    )


def mutual_first(pairs: DataFrame) -> DataFrame:
    """The pairs where each row is the other's first partner: a set-based choice without order."""
    one = F.row_number().over(Window.partitionBy("id1").orderBy("id2"))
    two = F.row_number().over(Window.partitionBy("id2").orderBy("id1"))
    return pairs.withColumns({"rank1": one, "rank2": two}).where("rank1 = 1 and rank2 = 1").select("id1", "id2")


def greedy_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs taken when all are tried by (id1, id2) and a row serves once.

    By rounds: a pair that comes first among the pairs that are left of both its rows is taken,
    whatever happens elsewhere; the other pairs of its rows go. No group is walked, so a frequent
    amount is as good as any; as many rounds are needed as pairs wait for one another in a chain.
    """
    left, taken = stash(pairs.select("id1", "id2"), "pairs"), []
    while True:
        votes = left.select(F.explode(F.array("id1", "id2")).alias("row"), F.struct("id1", "id2").alias("pair")).groupBy("row").agg(F.min("pair").alias("pair"))
        won = stash(votes.groupBy("pair").agg(F.count("*").alias("n")).where("n = 2").select("pair.id1", "pair.id2"), "taken")
        taken.append(won)
        used = won.select(F.explode(F.array("id1", "id2")).alias("row"))
        rest = stash(left.join(used.withColumnRenamed("row", "id1"), "id1", "left_anti").join(used.withColumnRenamed("row", "id2"), "id2", "left_anti").select("id1", "id2"), "pairs")
        drop_stash(left)
        left = rest
        if left.isEmpty():
            return reduce(DataFrame.unionByName, taken)


def _rows(ledger: DataFrame, account: str) -> DataFrame:
    """The rows that may be a side of a transfer: amount, id, day (a number) and account."""
    rows = ledger.where(F.col("txn_id").isNotNull() & (F.col("amount") > 0) & F.col("txn_date").isNotNull() & F.col(account).isNotNull())
    return rows.select("amount", F.col("txn_id").alias("id"), F.unix_date("txn_date").alias("day"), F.col(account).alias("account"))


def _partners(rows: DataFrame, others: DataFrame, days: int) -> DataFrame:
    """id and other: rows and those of the others with the same amount, in another account, at most `days` apart."""
    near = F.explode(F.sequence(F.col("day") - days, F.col("day") + days))
    others = others.select("amount", F.col("id").alias("other"), F.col("account").alias("other_account"), near.alias("day"))
    return rows.join(others, ["amount", "day"]).where(F.col("account") != F.col("other_account")).select("id", "other")


def mutual_transfers(ledger: DataFrame, days: int = 2, account: str = "statement") -> DataFrame:
    """id1 and id2: mutual_first() of transfer_pairs(), without listing the pairs, whose number grows with the square of a group.

    Among the rows of an amount and day, the smallest id in another account is the day's smallest of all, or the
    smallest that isn't in that one's account. Only these two rows of each day can be the first partner of a
    larger id, so only they are joined with all rows.
    """
    rows = _rows(ledger, account)
    each = rows.groupBy("amount", "day", "account").agg(F.min("id").alias("id"))
    rank = F.row_number().over(Window.partitionBy("amount", "day").orderBy("id", "account"))
    two = each.withColumn("rank", rank).where("rank <= 2").select("id").distinct()
    heads = stash(rows.join(two.hint("merge"), "id", "left_semi"), "heads")
    after = _partners(rows, heads, days).where("other < id").groupBy(F.col("other").alias("id1")).agg(F.min("id").alias("id2"))
    after = stash(after, "after")
    met = rows.join(after.select(F.col("id2").alias("id")).distinct().hint("merge"), "id", "left_semi")
    before = _partners(met, heads, days).where("other < id").groupBy(F.col("id").alias("id2")).agg(F.min("other").alias("id1"))
    return after.join(before.hint("merge"), ["id1", "id2"])


class _Day:
    """The free rows of a day by their numbers: a queue for each account, and a heap of the queues' heads."""

    def __init__(self) -> None:
        self.queues: dict[object, deque[int]] = {}
        self.heads: list[tuple[int, object]] = []

    def add(self, n: int, account: object) -> None:
        queue = self.queues.setdefault(account, deque())
        queue.append(n)
        if len(queue) == 1:
            heappush(self.heads, (n, account))

    def _drop_used(self, free: dict) -> None:
        while self.heads and self.heads[0][0] not in free:
            _, account = heappop(self.heads)
            queue = self.queues[account]
            queue.popleft()
            if queue:
                heappush(self.heads, (queue[0], account))

    def first(self, account: object, free: dict) -> int | None:
        """The first free row of another account."""
        self._drop_used(free)
        if not self.heads or self.heads[0][1] != account:
            return self.heads[0][0] if self.heads else None
        own = heappop(self.heads)
        self._drop_used(free)
        found = self.heads[0][0] if self.heads else None
        heappush(self.heads, own)
        return found


def _walk(days: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """id1 and id2, from rows (amount, id, day, account) in the order of amounts and ids."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for _, same in groupby(rows, itemgetter(0)):
            free: dict[int, object] = {}
            pool: dict[int, _Day] = {}
            for n, (id_, sides) in enumerate(groupby(same, itemgetter(1))):
                sides = [(day, account) for _, _, day, account in sides]  # one, unless an id repeats
                found = (pool[d].first(account, free) for day, account in sides for d in range(day - days, day + days + 1) if d in pool)
                first = min((m for m in found if m is not None), default=None)
                if first is not None:
                    yield free.pop(first), id_
                    continue
                free[n] = id_
                for day, account in sides:
                    pool.setdefault(day, _Day()).add(n, account)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batched(pairs(batches), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*part)], names=["id1", "id2"])

    return walk


def greedy_transfers(ledger: DataFrame, days: int = 2, account: str = "statement") -> DataFrame:
    """id1 and id2: greedy_pairs() of transfer_pairs(), without listing the pairs, whose number grows with the square of a group.

    Both orders of trying, by (id1, id2) and by (id2, id1), put the pairs of any one row in the order of its
    partners, so they take the same pairs. By (id2, id1), each row takes the first free one before it: rows are
    dealt by amount and pass once in the order of ids. Only rows that are still free are held, by day and account.
    """
    rows = _rows(ledger, account)
    dealt = rows.withColumn("amount", F.col("amount").cast("string")).repartition("amount").sortWithinPartitions("amount", "id")
    kind = rows.schema["id"].dataType.simpleString()
    return stash(dealt.mapInArrow(_walk(days), f"id1 {kind}, id2 {kind}"), "taken")


def without_pairs(ledger: DataFrame, chosen: DataFrame) -> DataFrame:
    """The ledger without both rows of each chosen pair."""
    gone = chosen.select(F.explode(F.array("id1", "id2")).alias("txn_id"))
    return ledger.join(gone.hint("merge"), "txn_id", "left_anti")  # as many as rows, so not to be broadcast
