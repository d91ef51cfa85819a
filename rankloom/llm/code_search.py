"""Exact top-k search in binary codes by incremental multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, table

#: Bits of a segment; a code of d bits has ceil(d / 16) of them.
SEGMENT = 16
#: Rows of an index block, and queries that meet it at a time.
BLOCK_ROWS, CHUNK_QUERIES = 16_384, 1_024


@lru_cache(maxsize=SEGMENT + 1)
def masks(weight: int) -> np.ndarray:
    """All segment values with so many bits set."""
    return np.array([sum(1 << i for i in bits) for bits in combinations(range(SEGMENT), weight)], np.uint16)


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, code``: bit j is set if component j is above 0; as little-endian segments.

    Null vectors have no code and drop out; a null component is not above 0; an empty vector is one segment without a bit. Repeated rows
    and null ids stay; other columns are ignored, whatever their names.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for v in batch.column(1).to_pylist():
                bits = np.array([x is not None and x > 0 for x in v], bool)
                bits = np.pad(bits, (0, -len(bits) % SEGMENT or (0 if len(bits) else SEGMENT)))
                codes.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], names=["id", "code"])

    return rows.mapInArrow(run, "id long, code binary")


class MultiIndex:
    """Buckets of a block of codes by the value of each segment."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        self.ids, self.codes = ids, codes
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, s], np.arange((1 << SEGMENT) + 1)) for s, o in enumerate(self.order)]

    def nearest(self, query: np.ndarray, k: int, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the ``k`` nearest codes by (distance, id), without the row ``skip``.

        Segment by segment the search radius grows by one. Once the first a + 1 of m segments
        have been searched to radius r and the others to r - 1, a code not met yet differs
        by at least r + 1 in each of the former and r in each of the latter, so all
        codes within m r + a have been met; the search ends when the k-th distance is.
        """
        m = len(query)
        met = np.zeros(len(self.ids), bool)
        if skip is not None:
            met[self.ids == skip] = True
        best = np.zeros(0, np.int64)
        far = np.zeros(0, np.int64)
        for radius in range(SEGMENT + 1):
            for s in range(m):
                buckets = query[s] ^ masks(radius)
                lo, hi = self.starts[s][buckets], self.starts[s][buckets.astype(np.int64) + 1]
                size = hi - lo
                total = int(size.sum())
                if total:
                    spots = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(total)
                    rows = self.order[s][spots]
                    rows = rows[~met[rows]]
                    met[rows] = True
                    distance = np.bitwise_count(self.codes[rows] ^ query).sum(axis=1).astype(np.int64)
                    best, far = np.concatenate([best, rows]), np.concatenate([far, distance])
                    if len(best) > k:
                        keep = np.lexsort((self.ids[best], far))[:k]
                        best, far = best[keep], far[keep]
                if len(best) >= k and far.max() <= m * radius + s:
                    return far, self.ids[best]
        keep = np.lexsort((self.ids[best], far))[:k]
        return far[keep], self.ids[best[keep]]


def _matrix(codes: pa.ChunkedArray, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), "<u2").reshape(-1, m)


def top_k(codes: DataFrame, queries: Column, k: int = 10, block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """``query_id, rank, id, distance``: for every row of ``codes`` (``id, code``) that satisfies ``queries``, its ``k`` nearest other rows.

    Order is by Hamming distance, then id. The query set meets all rows in blocks: rows are
    dealt by hash into index blocks and queries into chunks, and each pair of a chunk and a
    block is searched in a task by multi-index hashing, which proves its answer complete
    within the block. The best k of all blocks are then the best of all rows. A task
    holds one block and one chunk, whatever the size of the table; equal codes are
    spread by their ids.

    A row is not its own neighbour, and rows with its id are not either. Rows with a null
    id are left out. Codes of different lengths are not compared. A repeated row counts once; an id with several codes is
    searched by each of them and can be found by each. With fewer than k other rows, all are
    returned. No rows give no result.
    """
    rows = checkpoint(codes.select("id", "code").where("id is not null and code is not null").distinct())
    wanted = rows.where(queries)
    n, q = rows.count(), wanted.count()
    blocks, chunks = max(1, -(-n // block_rows)), max(1, -(-q // chunk_queries))
    deal = F.xxhash64("id", F.lit(3))
    size = F.octet_length("code").alias("size")
    left = wanted.select("id", "code", size, F.pmod(deal, F.lit(chunks)).cast("long").alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    right = rows.select("id", "code", size, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), F.pmod(deal, F.lit(blocks)).cast("long").alias("block"))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.int64())])

    def search(asked: pa.Table, stored: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if asked.num_rows and stored.num_rows:
            m = len(asked.column("code")[0].as_py()) // 2
            index = MultiIndex(stored.column("id").to_numpy(), _matrix(stored.column("code"), m))
            for number, query in zip(asked.column("id").to_pylist(), _matrix(asked.column("code"), m)):
                far, ids = index.nearest(query, k, number)
                out[0] += [number] * len(ids)
                out[1] += ids.tolist()
                out[2] += far.tolist()
        return pa.table([pa.array(c, pa.int64()) for c in out], schema=schema)

    # A stated number of partitions: few bytes are much work here, so small partitions must not be put together.
    keys = ("chunk", "block", "size")
    left, right = (df.repartition(blocks * chunks, *keys) for df in (left, right))
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, id long, distance long")
    # At most k rows of each block come in; a repeated query row must not repeat its answers.
    lists = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "id"))), 1, k).alias("best"))
    return lists.select("query_id", F.posexplode("best").alias("i", "b")).select("query_id", (F.col("i") + 1).cast("long").alias("rank"), F.col("b.id").alias("id"), F.col("b.distance").alias("distance"))


def op8_code_search(spark, sf_dir):
    """Sign codes of all embeddings; queries are the rows whose id is divisible by 20."""
    return top_k(sign_codes(table(spark, sf_dir, "embeddings")), F.col("id") % 20 == 0)


OP8_SQL = """
WITH e AS (
  SELECT vec_id AS id, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
), p AS (
  SELECT q.id AS query_id, e.id AS id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: CASE WHEN (q.v[i] > 0) <> (e.v[i] > 0) THEN 1 ELSE 0 END)) AS BIGINT) AS distance
  FROM e AS q, e WHERE q.id % 20 = 0 AND q.id <> e.id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p
)
SELECT query_id, rank, id, distance FROM r WHERE rank <= 10
"""
