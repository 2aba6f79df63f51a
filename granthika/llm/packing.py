"""Filling fixed-capacity containers with items.

Method: minimum bin slack. For each container, the largest item left is put in, and a subset-sum dynamic program over the
lengths that are left, held as the bits of one number, finds the fullest combination that fits beside it; it is removed
and the next container begins. Items larger than the capacity are cut: full pieces fill containers of their own, and the
rest is an item.

Items are spread by hash over shards of a bounded number of items, which tasks pack independently; a shard leaves about
one container that isn't full. Copies of one length count as one length with a multiplicity.

Defined results: null and empty texts have no tokens and need no container; equal lengths are taken in order of id.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that one task packs at once, on average; the shard number grows with the items.
ITEMS_PER_SHARD = 20_000
PACKED = "target_id long, capacity_tokens int, kind string, shard long, container_no long, item_id long, piece_no int, first_token long, n_tokens long"


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, copies) of a combination with the largest sum up to ``room``; ``lengths`` rise, ``counts`` has their copies."""
    reach, mask, goal = 1, (1 << (room + 1)) - 1, 1 << room
    steps: list[tuple[int, int, int]] = []
    for i in range(bisect_left(lengths, room + 1) - 1, -1, -1):
        size = lengths[i]
        left, bundle = min(counts[size], room // size), 1
        while left > 0 and not reach & goal:
            k = min(bundle, left)
            steps.append((size, k, reach))
            reach |= (reach << (size * k)) & mask
            left -= k
            bundle *= 2
        if reach & goal:
            break
    best, chosen = reach.bit_length() - 1, []
    for size, k, before in reversed(steps):
        if not before >> best & 1:
            chosen.append((size, k))
            best -= size * k
    return chosen


def fill(counts: dict[int, int], capacity: int) -> Iterator[list[tuple[int, int]]]:
    """Containers as lists of (length, copies), until no item is left; empties ``counts``."""
    lengths = sorted(counts)
    while lengths:
        largest = lengths[-1]
        counts[largest] -= 1
        if not counts[largest]:
            lengths.pop()
        chosen = fullest(lengths, counts, capacity - largest)
        for size, k in chosen:
            counts[size] -= k
            if not counts[size]:
                del lengths[bisect_left(lengths, size)]
        yield [(largest, 1), *chosen]


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """Container numbers of one shard's pieces."""
    pdf = pdf.sort_values(["n_tokens", "item_id", "piece_no"], ignore_index=True)
    rows: dict[int, list[int]] = {}
    for i, size in enumerate(pdf["n_tokens"].tolist()):
        rows.setdefault(size, []).append(i)
    for own in rows.values():
        own.reverse()
    place = [0] * len(pdf)
    for number, container in enumerate(fill({size: len(own) for size, own in rows.items()}, int(pdf["capacity_tokens"].iloc[0]))):
        for size, k in container:
            for _ in range(k):
                place[rows[size].pop()] = number
    return pdf.assign(container_no=place)


def pieces(items: DataFrame, targets: DataFrame) -> DataFrame:
    """Every item (item_id, n_tokens) for every target (target_id, capacity_tokens), cut where it exceeds the capacity."""
    each = items.where("n_tokens > 0").select("item_id", "n_tokens", F.explode(_as_array(targets)).alias("t")).select("item_id", "n_tokens", "t.*")
    number = F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))
    cut = each.select("target_id", "capacity_tokens", "item_id", "n_tokens", F.explode(F.sequence(F.lit(0), (number - 1).cast("int"))).alias("piece_no"))
    first = F.col("piece_no").cast("long") * F.col("capacity_tokens")
    return cut.withColumns({"first_token": first, "n_tokens": F.least(F.col("capacity_tokens").cast("long"), F.col("n_tokens") - first)})


def _as_array(targets: DataFrame):
    """The targets as a constant; they are a handful of settings."""
    rows = targets.where("target_id is not null and capacity_tokens > 0").select("target_id", "capacity_tokens").distinct().orderBy("target_id", "capacity_tokens").collect()
    kind = "array<struct<target_id:bigint,capacity_tokens:int>>"
    return F.array(*[F.struct(F.lit(r[0]).cast("long").alias("target_id"), F.lit(r[1]).cast("int").alias("capacity_tokens")) for r in rows]).cast(kind) if rows else F.expr(f"cast(array() as {kind})")


def pack(items: DataFrame, targets: DataFrame, items_per_shard: int = ITEMS_PER_SHARD) -> DataFrame:
    """target_id, capacity_tokens, kind, shard, container_no, item_id, piece_no, first_token, n_tokens.

    A container is (target_id, kind, shard, container_no). Full pieces of larger items need no search: each is a container
    of kind ``full`` (its shard is the item, its number the piece); the others are of kind ``packed``. ``items`` is read
    twice: to count it, and to pack it.
    """
    shards = max(1, -(-items.count() // items_per_shard))
    cut = pieces(items, targets)
    columns = [c.split()[0] for c in PACKED.split(", ")]
    whole = F.col("n_tokens") == F.col("capacity_tokens")
    part = cut.where(~whole).withColumns({"kind": F.lit("packed"), "shard": F.pmod(F.xxhash64("item_id"), F.lit(shards))})
    loose = part.groupBy("target_id", "shard").applyInPandas(lambda pdf: _pack(pdf)[columns], PACKED)
    full = cut.where(whole).withColumns({"kind": F.lit("full"), "shard": F.col("item_id"), "container_no": F.col("piece_no").cast("long")})
    return loose.unionByName(full.select(*columns))


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens, fill and the least possible number of containers of each target."""
    per_container = packed.groupBy("target_id", "capacity_tokens", "kind", "shard", "container_no").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n_pieces"))
    return per_container.groupBy("target_id", "capacity_tokens").agg(
        F.count("*").alias("n_containers"), F.sum("n_pieces").alias("n_pieces"), F.sum("used").alias("n_tokens"),
        F.ceil(F.sum("used") / F.col("capacity_tokens")).alias("least_containers"), (F.sum("used") / (F.count("*") * F.col("capacity_tokens"))).alias("fill"),
    )
