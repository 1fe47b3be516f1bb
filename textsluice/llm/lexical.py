"""Ranked lexical search over an index of documents stratified by length.

Documents of one length normaliser m form a stratum, cut into chunks of a
bounded number of documents.  A chunk holds its postings by term, and those of
a term by tf, highest first; all of them have one impact, computed once.  The
highest impacts bound what a stratum can score, which orders the visits.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from textsluice.llm.common import as_bytes, bytes_of, from_bytes, kept, map_in_arrow, portions, sliced, word_slices
from textsluice.session import ensure_checkpoint_dir

TOP = 50
#: Documents and postings of a chunk, of which one longer document may hold more.
CHUNK_DOCS, CHUNK_POSTINGS = 1024, 1 << 17
#: Bytes of terms and counts in a piece of a stratum.
PIECE_BYTES = 1 << 22
#: Queries searched for at a time, which bounds what tasks are sent.
BLOCK = 256
#: Cells of the table of scores that is filled at a time.
CELLS = 1 << 20

#: Bytes of terms as themselves, A-Z in lower case, all others as a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FORWARD = "row long, doc_id long, n long, terms binary, tfs binary"
INDEX = "m long, n_docs int, body binary"


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    for batch in (part for batch in batches for part in portions(batch, 1)):
        terms, tfs, sizes = [], [], []
        for text in batch.column(1).to_pylist():
            found = Counter()
            for part in word_slices(text.translate(TERM_BYTES)):
                found.update(part.split())
            terms.append(b" ".join(found))
            tfs.append(np.fromiter(found.values(), "<u4", len(found)).tobytes())
            sizes.append(found.total())
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(row, row + batch.num_rows)), batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()),
            pa.array(tfs, pa.binary())], names=["row", "doc_id", "n", "terms", "tfs"])
        row += batch.num_rows


def term_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, n, terms, tfs) of every row: its terms, once each and joined
    by spaces, with their counts as unsigned 32-bit numbers; n is their sum.  A
    null text has none."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), bytes_of(text).alias("text"))
    return map_in_arrow(rows, _terms, FORWARD)


def _chunk(m: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    docs = pa.chunked_array([p.column("doc_id") for p in parts]).combine_chunks()
    split = [t.split() for p in parts for t in p.column("terms").to_pylist()]
    sizes = np.array([len(t) for t in split])
    coded = pa.array([t for terms in split for t in terms], pa.string()).dictionary_encode()
    tf = np.frombuffer(b"".join(t for p in parts for t in p.column("tfs").to_pylist()), "<u4").astype(np.int64)
    term, doc = coded.indices.to_numpy(), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    order = np.lexsort((doc, -tf, term))
    term, tf, doc = term[order], tf[order], doc[order]
    stops = np.flatnonzero(np.append((term[1:] != term[:-1]) | (tf[1:] != tf[:-1]), True)) + 1
    columns = {"docs": docs, "terms": coded.dictionary, "group_term": pa.array(term[stops - 1].astype(np.int32)), "group_tf": pa.array(tf[stops - 1]),
               "group_stop": pa.array(stops), "at": pa.array(doc.astype(np.int32))}
    lists = [pa.ListArray.from_arrays([0, len(a)], a) for a in columns.values()]
    body = as_bytes(pa.RecordBatch.from_arrays(lists, names=list(columns)))
    return pa.RecordBatch.from_arrays([pa.array([m], pa.int64()), pa.array([len(sizes)], pa.int32()), pa.array([body], pa.binary())],
                                      names=["m", "n_docs", "body"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, docs, postings, current = [], 0, 0, None
    for batch in batches:
        m = batch.column("m").to_numpy()
        ends = np.cumsum(pc.binary_length(batch.column("tfs")).to_numpy().astype(np.int64) // 4)
        at = 0
        while at < len(m):
            if held and (m[at] != current or docs >= CHUNK_DOCS or postings >= CHUNK_POSTINGS):
                yield _chunk(current, held)
                held, docs, postings = [], 0, 0
            current, before = int(m[at]), int(ends[at - 1]) if at else 0
            same = at + int(np.argmax(np.append(m[at:] != current, True)))
            room = int(np.searchsorted(ends, before + CHUNK_POSTINGS - postings)) + 1
            to = min(same, room, at + CHUNK_DOCS - docs)
            held.append(batch.slice(at, to - at))
            docs, postings, at = docs + to - at, postings + int(ends[to - 1]) - before, to
    if held:
        yield _chunk(current, held)


class Index:
    """Chunks of strata, with the number of documents that have a term."""

    def __init__(self, chunks: DataFrame, n: int):
        self.chunks, self.n = chunks, n


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of all documents with a term.

    A stratum is dealt out in pieces of at most about ``PIECE_BYTES``, so neither
    one that holds much of the table nor those of long documents make a large
    task.  Rows with null or repeated ids are documents of their own.
    """
    rows = kept(term_counts(docs, doc_id, text).where("n > 0"), "terms")
    n, length = rows.agg(F.count("*"), F.sum("n")).first()
    m = F.expr(f"50 + (50L * n * {n}L) div {length or 1}L")
    rows = rows.withColumn("m", m)
    size = F.octet_length("terms").cast("long") + F.octet_length("tfs")
    pieces = rows.groupBy("m").agg(F.ceil(F.sum(size) / PIECE_BYTES).alias("pieces"))
    dealt = (rows.join(pieces, "m").withColumn("piece", F.pmod(F.xxhash64("row"), "pieces")).repartition("m", "piece")
             .sortWithinPartitions("m", "piece", "row").select("m", "doc_id", "terms", "tfs"))
    return Index(kept(map_in_arrow(dealt, _chunks, INDEX), "strata"), n)


class _Queries:
    """A block of queries: terms numbered, and of each term the queries that have it."""

    def __init__(self, rows):
        self.ids = [r["doc_id"] for r in rows]
        numbers: dict[str, int] = {}
        pairs = [(numbers.setdefault(t, len(numbers)), q) for q, r in enumerate(rows) for t in map(bytes.decode, r["terms"].split())]
        self.terms = list(numbers)
        term, query = np.array(pairs, np.int64).reshape(-1, 2).T
        order = np.lexsort((query, term))
        self.term, self.query = term[order], query[order]
        self.start = np.searchsorted(self.term, np.arange(len(self.terms) + 1))
        self.weight = np.zeros(len(self.terms), np.int64)

    def weigh(self, n: int, df: np.ndarray) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    """What one use count adds to a score per unit of a term's weight."""
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class _Chunk:
    """What a chunk holds of the terms of a block of queries."""

    def __init__(self, batch: pa.RecordBatch, terms: pa.Array):
        body = from_bytes(batch.column("body")[0].as_buffer())
        get = lambda name: body.column(name).flatten()
        self.m, self.n = batch.column("m")[0].as_py(), batch.column("n_docs")[0].as_py()
        number = pc.index_in(get("terms"), value_set=terms)
        number = pc.fill_null(number, -1).to_numpy()[get("group_term").to_numpy()]
        stop = get("group_stop").to_numpy()
        start = np.concatenate([[0], stop[:-1]])
        mine = number >= 0
        self.term, self.tf, self.start, self.stop = number[mine].astype(np.int64), get("group_tf").to_numpy()[mine], start[mine], stop[mine]
        self.first = np.append(True, self.term[1:] != self.term[:-1])[:len(self.term)]      # a term's highest tf
        self.body = body

    def postings(self) -> tuple[np.ndarray, np.ndarray]:
        return self.body.column("docs").flatten().to_numpy(zero_copy_only=False), self.body.column("at").flatten().to_numpy()


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is from."""
    size = stop - start
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + start[which], which


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1)


def _statistics(queries: _Queries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pa.array(queries.terms, pa.string())
        for batch in _one_by_one(batches):
            chunk = _Chunk(batch, terms)
            at = np.flatnonzero(chunk.first)
            df = np.add.reduceat(chunk.stop - chunk.start, at) if len(at) else np.zeros(0, np.int64)
            yield from sliced([np.full(len(at), chunk.m), chunk.term[at], chunk.tf[at].astype(np.int64), df], ["m", "term", "tf", "df"])
    return run


class _Best:
    """The best documents per query that a task has seen."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least = k, least
        self.found = [np.zeros(0, np.int64)] * 3

    def add(self, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        query, doc, score = (np.concatenate(x) for x in zip(self.found, (query, doc, score)))
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        start = np.searchsorted(query, np.arange(len(self.least) + 1))
        rank = np.arange(len(query)) - start[query]
        best = rank < self.k
        self.found = [query[best], doc[best], score[best]]
        last = rank == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])


def _visit(queries: _Queries, least: np.ndarray, first: dict[int, set[int]], now: bool, k: int):
    """Scores chunks: those of the strata that each query visits first, or all
    others that may still hold one of its best."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, best = pa.array(queries.terms, pa.string()), _Best(k, least.copy())
        for batch in _one_by_one(batches):
            m = batch.column("m")[0].as_py()
            allowed = np.full(len(least), not now)
            allowed[list(first.get(m, ()))] = now
            if allowed.any():
                _score(_Chunk(batch, terms), queries, allowed, best)
        query, doc, score = best.found
        if len(query):
            known = doc != _NO_ID
            yield from sliced([query, pa.array(np.where(known, doc, 0), pa.int64(), mask=~known), score], ["query", "doc_id", "score"])
    return run


_NO_ID = np.iinfo(np.int64).min         # documents without an id come first among equal scores


def _score(chunk: _Chunk, queries: _Queries, allowed: np.ndarray, best: _Best) -> None:
    impact = impacts(chunk.tf, chunk.m)                 # once per term and tf
    at, group = _ranges(queries.start[chunk.term], queries.start[chunk.term + 1])
    query, worth = queries.query[at], impact[group] * queries.weight[chunk.term[group]]
    top = chunk.first[group]
    bound = np.zeros(len(allowed), np.int64)
    np.add.at(bound, query[top], worth[top])
    wanted = np.flatnonzero(allowed & (bound >= np.maximum(best.least, 1)))
    if not len(wanted):
        return
    docs, places = chunk.postings()
    docs = np.where(np.isnan(docs), _NO_ID, docs).astype(np.int64) if docs.dtype.kind == "f" else docs
    for k in range(0, len(wanted), max(1, CELLS // chunk.n)):
        some = wanted[k:k + max(1, CELLS // chunk.n)]
        line = np.full(len(allowed), -1)
        line[some] = np.arange(len(some))
        mine = np.flatnonzero((line[query] >= 0) & (worth > 0))
        scores = np.zeros(len(some) * chunk.n, np.int64)
        sizes = np.cumsum((chunk.stop - chunk.start)[group[mine]])
        for lo in range(0, len(mine), 4096):
            part = mine[lo:lo + 4096]
            if len(part) and sizes[min(lo + 4096, len(mine)) - 1] - (sizes[lo - 1] if lo else 0) > 4 * CELLS:
                for one in part:                        # long postings one by one
                    cell = line[query[one]] * chunk.n + places[chunk.start[group[one]]:chunk.stop[group[one]]]
                    scores[cell] += worth[one]
            else:
                posting, which = _ranges(chunk.start[group[part]], chunk.stop[group[part]])
                np.add.at(scores, line[query[part]][which] * chunk.n + places[posting], worth[part][which])
        scores = scores.reshape(len(some), chunk.n)
        q, d = np.nonzero(scores >= np.maximum(best.least[some], 1)[:, None])
        if len(q):
            best.add(some[q], docs[d], scores[q, d])


def _search_block(ix: Index, rows: list, k: int) -> DataFrame:
    spark, queries = ix.chunks.sparkSession, _Queries(rows)
    stats = kept(map_in_arrow(ix.chunks, _statistics(queries), "m long, term long, tf long, df long"), "stratum-terms")
    df = np.zeros(len(queries.terms), np.int64)
    for r in stats.groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():      # at most the terms of a block
        df[r["term"]] = r["df"]
    queries.weigh(ix.n, df)
    # the most that a document of a stratum can score, and per query the best
    # strata that together hold k documents
    pairs = spark.createDataFrame(pa.table({"term": queries.term, "query": queries.query, "w": queries.weight[queries.term]}))
    highest = stats.groupBy("m", "term").agg(F.max("tf").alias("tf"))
    bounds = highest.join(pairs, "term").groupBy("query", "m").agg(F.sum(F.expr("w * ((1000000000L * tf) div (1000L * tf + 20L * m))")).alias("bound"))
    sizes = ix.chunks.groupBy("m").agg(F.sum("n_docs").alias("docs"))
    before = W.partitionBy("query").orderBy(F.desc("bound"), "m").rowsBetween(W.unboundedPreceding, -1)
    chosen = (bounds.where("bound > 0").join(sizes, "m").withColumn("before", F.coalesce(F.sum("docs").over(before), F.lit(0)))
              .where(F.col("before") < k).select("query", "m"))
    first: dict[int, set[int]] = {}
    for r in chosen.collect():                          # at most k strata a query
        first.setdefault(r["m"], set()).add(r["query"])
    found_schema, least = "query long, doc_id long, score long", np.zeros(len(rows), np.int64)
    strata = spark.createDataFrame([(m,) for m in first], "m long")
    begun = kept(map_in_arrow(ix.chunks.join(F.broadcast(strata), "m", "left_semi"), _visit(queries, least, first, True, k), found_schema), "first-visits")
    best = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    for r in begun.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query", "score").collect():
        least[r["query"]] = r["score"]
    rest = map_in_arrow(ix.chunks, _visit(queries, least, first, False, k), found_schema)
    ranked = begun.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(queries.ids)), "query long, item_id long")
    return ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")


def search(ix: Index, items: DataFrame, k: int = TOP, item_id: str = "item_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item,
    those with a score above 0, equal scores by ascending doc_id.

    Items are taken in blocks of about ``block``, each against the whole index:
    first each query visits the strata with the highest bounds, then only chunks
    whose bound reaches the score of its k-th document so far.  An item without
    terms, a null text or an empty table gives no rows; rows with null or
    repeated item ids are ranked each; documents without an id come first among
    equal scores.
    """
    spark = ix.chunks.sparkSession
    asked = kept(term_counts(items, item_id, text).where("n > 0").select("row", "doc_id", "terms"), "queries")
    blocks = math.ceil(asked.count() / block)
    out = f"{ensure_checkpoint_dir(spark)}/ranked-{uuid.uuid4().hex}"
    schema = "item_id long, rank int, doc_id long, score long"
    if not blocks:
        return spark.createDataFrame([], schema)
    number = F.pmod(F.xxhash64("row"), F.lit(blocks))
    found = []
    for b in range(blocks):
        rows = asked.where(number == b).orderBy("row").collect()
        if rows:
            found.append(_search_block(ix, rows, k))
    if len(found) == 1:
        return found[0]
    for one in found:
        one.write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)
