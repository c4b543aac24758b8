"""Best-fit packing of documents into training sequences of several permitted lengths.

Variable-capacity best-fit, longest first: a piece goes to the open bin that it fills best. Where none has room, the
bin size is opened that costs least for what will fill it: its cost over the piece and as much of the rest of the bin
as the shorter pieces still to come, less the room already open, can use. At the end each bin is cut down to the
smallest permitted length that holds its contents.

Documents are packed in groups, by hash or in the order in which they come; a group holds ids and lengths only, and ends
with a few bins that are not full.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import in_order, read

LENGTHS = (512, 1024, 2048, 4096, 8192)
GROUP_ROWS = 20_000


def cost(length: int) -> float:
    """Of training on one sequence: its tokens, attention that grows with their square, and a fixed part."""
    return length + length * length / 32768 + 64


def best_fit(lengths: np.ndarray, sizes: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity) for each piece; each length from 1 to the largest size."""
    sizes = tuple(sorted(sizes))
    price = {s: cost(s) for s in sizes}
    top = sizes[-1]
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    tail = np.zeros(top + 2, np.int64)  # tokens in pieces still to come, by length; prefix sums are made from it now and then
    np.add.at(tail, lengths, lengths)
    below = np.cumsum(tail)  # tokens in pieces up to each length
    bins, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    filled: list[int] = []
    opened: list[int] = []
    by_room: dict[int, list[int]] = {}
    mask, room_open, done = 0, 0, 0
    total = int(lengths.sum())
    for k in order.tolist():
        need = int(lengths[k])
        found = mask >> need
        if found:
            room = need + ((found & -found).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
            room_open -= room
        else:
            b, best, left_total = len(filled), None, total - done - need
            for s in sizes:
                if s >= need:
                    usable = min(s - need, max(0, min(left_total, int(below[min(s - need, top)])) - room_open))
                    worth = price[s] / (need + usable)
                    if best is None or worth < best[0]:
                        best = (worth, s)
            room = best[1]
            filled.append(0)
            opened.append(room)
        bins[k], offset[k] = b, filled[b]
        filled[b] += need
        done += need
        rest = room - need
        if rest:
            by_room.setdefault(rest, []).append(b)
            mask |= 1 << rest
            room_open += rest
    final = np.array(sizes)[np.searchsorted(sizes, filled)] if filled else np.zeros(0, np.int64)
    return bins, offset, final[bins] if n else np.zeros(0, np.int64)


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def pack(df: DataFrame, id_col: str, length: Column, sizes: tuple[int, ...] = LENGTHS, group_rows: int = GROUP_ROWS, ordered: bool = False) -> DataFrame:
    """(id_col, piece, start, length, bin_id, offset, capacity).

    A document longer than the largest size gives several pieces, start being where each begins in it; whole documents
    are packed, nothing is cut away. A document without length (null, empty, below 0) has one row with null bin, offset and
    capacity. Repeated rows are packed each for itself, null ids as any other; an empty table gives no rows. Other columns
    of df, whatever their names, are left out. A group holds ids and lengths of about group_rows rows; rows of the same id
    and length share one.

    A bin's id is its group's number and its own in the group. Where df's rows are ordered, each group is a run of group_rows
    of them, groups are numbered as the rows follow each other, and the bins of a group by the first row in each: sequences
    taken by these numbers keep df's order, but for what best fit moves within a group.
    """
    top = max(sizes)
    own = {"id": F.col(f"`{id_col}`"), "n": F.greatest(F.coalesce(length.cast("bigint"), F.lit(0)), F.lit(0))}
    if ordered:
        items = in_order(df, **own).withColumn("pack_group", F.floor(F.col("place") / group_rows).cast("bigint"))
    else:
        groups = max(1, -(-df.count() // group_rows))
        items = df.select(*[c.alias(n) for n, c in own.items()]).withColumn("pack_group", F.pmod(F.xxhash64("id", "n"), F.lit(groups)).cast("int"))
    second = "place" if ordered else "id"
    kind = dict(items.dtypes)["id"]
    named = items.withColumn("id", F.col("id").cast("string"))  # pandas would make a double of a bigint with nulls

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", second], ascending=[False, True], kind="stable")  # the same bins however the rows came
        n = pdf["n"].to_numpy(np.int64)
        parts = np.maximum(1, -(-n // top))
        at = np.repeat(np.arange(len(n)), parts)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(n[at] - piece * top, top)
        bins, offset, capacity = best_fit(size, sizes)
        if ordered and len(bins):
            rank = np.empty(len(bins), np.int64)
            rank[np.lexsort((piece, pdf["place"].to_numpy(np.int64)[at]))] = np.arange(len(bins))
            first = np.full(int(bins.max()) + 1, len(bins))
            np.minimum.at(first, bins, rank)
            bins = np.argsort(np.argsort(first))[bins]
        names = np.char.add(f"{int(key[0])}-", bins.astype(str))
        return pd.DataFrame({"id": pdf["id"].iloc[at].to_numpy(), "piece": piece, "start": piece * top, "length": size, "bin_id": names, "offset": offset, "capacity": capacity})

    packed = named.where("n > 0").groupBy("pack_group").applyInPandas(one, "id string, piece bigint, start bigint, length bigint, bin_id string, offset bigint, capacity bigint").withColumn("id", F.col("id").cast(kind))
    none = items.where("n = 0").selectExpr("id", "0L piece", "0L start", "0L length", "cast(null as string) bin_id", "cast(null as bigint) offset", "cast(null as bigint) capacity")
    return packed.unionByName(none).withColumnRenamed("id", id_col)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), "doc_id", words(F.col("text")))
