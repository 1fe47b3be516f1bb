"""Passages that repeat across documents: equal windows of words, and similar spans around shared anchors."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from textsluice.llm.common import bitmap, bytes_of, forget, in_bitmap, kept, marked, mixed, rolled, sliced, text_map, word_slices

#: Words of a shingle, and the Jaccard similarity of passages that are the same.
SHINGLE, SIMILAR = 5, 0.8
#: A passage of so many words or more is a repeat.
LEAST_WORDS = 50
#: Words of an anchor, and the neighbouring starts of which the least hash is one: equal
#: stretches of GRAM + WINNOW - 1 words share an anchor.  Two similar passages of
#: LEAST_WORDS share such a stretch, as one replaced word in about 45 is allowed.
GRAM, WINNOW = 13, 12
#: Anchors of two texts follow each other within so many words, shifted by so many at most.
APART, DRIFT = 128, 16
#: Words around a chain of anchors that are compared as well, and shifts tried there.
MARGIN, SHIFTS = 64, 2
#: Bits of the map of shared anchors, and words compared at a time.
MAP_BITS, AT_ONCE = 26, 1 << 18
#: Bytes of text whose words, and whose bytes, are hashed at a time: work arrays hold
#: several times 8 bytes for each.
HASHED_WORDS, HASHED_BYTES = 1 << 20, 1 << 17

_GAP = LEAST_WORDS + 2
_STEP, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_NONE = np.uint64(2**64 - 1)


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTE = mixed(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(1))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of a text, A-Z lower-cased."""
    at, starts, hashes = 0, [], []
    for part in word_slices(text, HASHED_BYTES):
        raw = np.frombuffer(part, np.uint8)
        space = np.concatenate([[True], _SPACE[raw], [True]])
        edge = np.flatnonzero(space[1:] != space[:-1])
        start, stop = edge[::2], edge[1::2]
        power = np.full(len(raw) + 1, _STEP, np.uint64)
        power[0] = 1
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * np.cumprod(power)[:-1], out=total[1:])
        power[1:] = _BACK
        hashes.append(mixed((total[stop] - total[start]) * np.cumprod(power)[start]))
        starts.append(start + at)
        at += len(part)
    return np.concatenate(starts), np.concatenate(hashes)


class Words:
    """Word hashes of a batch of texts, with gaps of zeros between them."""

    def __init__(self, texts: list[bytes]):
        starts, hashes = word_hashes(b" ".join(texts))
        first = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts[:-1]])]).astype(np.int64)
        doc = np.searchsorted(first, starts, side="right") - 1
        self.counts = np.bincount(doc, minlength=len(texts))
        self.begins = np.cumsum(self.counts + _GAP) - self.counts
        self.h = np.zeros(len(starts) + _GAP * (len(texts) + 1), np.uint64)
        self.h[np.arange(len(starts)) + _GAP * (doc + 1)] = hashes | np.uint64(1)

    def whole(self, n: int) -> np.ndarray:
        """Whether the ``n`` words from a position on lie in one text."""
        gaps = np.concatenate([[0], np.cumsum(self.h == 0)])
        return gaps[n:] == gaps[:-n]

    def least(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the anchor from every position on, and the least of ``WINNOW``
        neighbours from it on, zero where they do not lie in one text."""
        grams = rolled(self.h, GRAM)
        grams[~self.whole(GRAM)] = _NONE
        two = np.minimum(grams[:-1], grams[1:])
        four = np.minimum(two[:-2], two[2:])
        eight = np.minimum(four[:-4], four[4:])
        least = np.minimum(eight[:-4], four[8:])
        least[~self.whole(GRAM + WINNOW - 1)] = 0
        return grams, least

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash): a least of neighbours, of equal ones nearby the first."""
        grams, least = self.least()
        n = len(least)
        chosen = np.zeros(len(grams), bool)
        for d in range(WINNOW):
            chosen[d:d + n] |= grams[d:d + n] == least
        at = np.flatnonzero(chosen)
        values, again = grams[at], np.zeros(len(at), bool)
        for d in range(1, WINNOW):
            again[d:] |= (at[d:] - at[:-d] < WINNOW) & (values[d:] == values[:-d])
        return at[~again], mixed(values[~again])

    def windows(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of ``LEAST_WORDS`` words all of whose anchors may be shared.

        A window's own anchors, those least of neighbours inside it, are the same
        wherever it stands; others do not count.
        """
        _, least = self.least()
        new = np.concatenate([[True], least[1:] != least[:-1]])         # neighbours mostly have the same one
        known = in_bitmap(shared, mixed(least[new]), MAP_BITS)[np.cumsum(new) - 1]
        bad = np.concatenate([[0], np.cumsum(~known)])
        n = LEAST_WORDS - GRAM - WINNOW + 2
        at = np.flatnonzero((bad[n:] == bad[:-n]) & self.whole(LEAST_WORDS)[:len(bad) - n])
        size = len(self.h)
        up, down = np.full(size + 1, _STEP, np.uint64), np.full(size + 1, _BACK, np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(self.h) * up[:size])])
        return at, mixed((total[at + LEAST_WORDS] - total[at]) * down[at])

    def placed(self, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The text of each position and the number of its word."""
        doc = np.searchsorted(self.begins, at, side="right") - 1
        return pa.array(doc), (at - self.begins[doc]).astype(np.int32)


def _tag(name: str = "text"):
    return F.hash(F.coalesce(F.col(name), F.lit("")))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), _tag().alias("tag"), bytes_of("text").alias("text"))


def _hashed(docs: DataFrame, of) -> DataFrame:
    """(hash, doc_id, tag, pos) of what ``of`` finds in the words of the texts."""
    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        words = Words(batch.column(2).to_pylist())
        at, value = of(words)
        take, pos = words.placed(at)
        yield from sliced([value.view(np.int64), batch.column(0).take(take), batch.column(1).take(take), pos], ["hash", "doc_id", "tag", "pos"])

    return text_map(_rows(docs), run, "hash long, doc_id long, tag int, pos int", 2, HASHED_WORDS)


def _shared(every: DataFrame) -> DataFrame:
    """(hash, kept_doc_id): hashes of several documents and the first of those."""
    both = every.groupBy("hash").agg(F.min("doc_id").alias("kept_doc_id"), F.max("doc_id").alias("_hi"))
    return both.where("kept_doc_id != _hi").drop("_hi")


def _hits(found: DataFrame) -> DataFrame:
    """(doc_id, tag, pos, kept_doc_id, kept_tag, lag): occurrences ``found`` of shared hashes in
    later documents, and how far behind the first one in the first document they stand."""
    place = F.shiftleft(F.col("tag").cast("long"), 32).bitwiseOR(F.col("pos").cast("long"))
    first = found.where("doc_id = kept_doc_id").groupBy("hash").agg(F.min(place).alias("_place"))
    return (found.where("doc_id != kept_doc_id").join(first, "hash")
            .select("doc_id", "tag", "pos", "kept_doc_id", F.shiftright("_place", 32).cast("int").alias("kept_tag"),
                    (F.col("pos") - F.col("_place").bitwiseAND(F.lit(0xFFFFFFFF))).cast("int").alias("lag")))


def equal_passages(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(doc_id, tag, start_word, end_word, kept_doc_id): runs of windows of ``LEAST_WORDS``
    words, each compared with the first document that holds the same window."""
    seen = docs.sparkSession.sparkContext.broadcast(bitmap(shared, "hash", MAP_BITS))
    every = kept(_hashed(docs, lambda words: words.windows(seen.value)), "windows")
    found = kept(every.join(_shared(every), "hash"), "equal-windows")
    forget(every)
    along = ["doc_id", "tag", "kept_doc_id", "kept_tag", "lag"]
    run = F.col("pos") - F.row_number().over(W.partitionBy(*along).orderBy("pos"))
    runs = _hits(found).withColumn("run", run).groupBy(*along, "run")
    return (runs.agg(F.min("pos").alias("start_word"), (F.max("pos") + LEAST_WORDS).alias("end_word"))
            .select("doc_id", "tag", "start_word", "end_word", "kept_doc_id"))


def chains(hits: DataFrame) -> DataFrame:
    """(doc_id, tag, kept_doc_id, kept_tag, start, stop, kept_start, kept_stop, lags): anchors
    that follow each other in both documents, with the words around them."""
    pair = ["doc_id", "tag", "kept_doc_id", "kept_tag"]
    order = W.partitionBy(*pair).orderBy("pos")
    new = (F.col("pos") - F.lag("pos").over(order) > APART) | (F.abs(F.col("lag") - F.lag("lag").over(order)) > DRIFT)
    cut = hits.withColumn("_new", F.coalesce(new.cast("int"), F.lit(0))).withColumn("_chain", F.sum("_new").over(order))
    kept_pos = F.col("pos") - F.col("lag")
    down, up = (lambda c: F.greatest(F.floor((c - MARGIN) / MARGIN) * MARGIN, F.lit(0)).cast("int")), (lambda c: (F.ceil((c + GRAM + MARGIN) / MARGIN) * MARGIN).cast("int"))
    return cut.groupBy(*pair, "_chain").agg(
        down(F.min("pos")).alias("start"), up(F.max("pos")).alias("stop"), down(F.min(kept_pos)).alias("kept_start"), up(F.max(kept_pos)).alias("kept_stop"),
        F.collect_set("lag").alias("lags")).drop("_chain")


def _with_lists(docs: DataFrame, wanted: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, tag, text, asked) of the texts that ``wanted`` names, each once."""
    lists = wanted.groupBy("doc_id", "tag").agg(F.collect_list(F.struct(*fields)).alias("asked"))
    near = marked(_rows(docs), F.col("doc_id"), wanted, F.col("doc_id")).where("_near").drop("_near")
    return near.dropDuplicates(["doc_id", "tag"]).join(lists, ["doc_id", "tag"]).select("doc_id", "tag", "text", "asked")


def stretches(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, tag, start, stop, words): 32 bits of the hashes of the words ``wanted``
    (doc_id, tag, start, stop; distinct)."""
    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        words = Words(batch.column(2).to_pylist())
        h = words.h.astype(np.uint32).view(np.int32)
        for k, asked in enumerate(batch.column(3).to_pylist()):
            at, n = words.begins[k], words.counts[k]
            size = len(asked)
            lists = pa.array([h[at + x["start"]:at + min(x["stop"], n)] for x in asked], pa.list_(pa.int32()))
            yield from sliced([pa.array([batch.column(0)[k].as_py()] * size, pa.int64()), pa.array([batch.column(1)[k].as_py()] * size, pa.int32()),
                               pa.array([x["start"] for x in asked], pa.int32()), pa.array([x["stop"] for x in asked], pa.int32()), lists],
                              ["doc_id", "tag", "start", "stop", "words"])

    return text_map(_with_lists(docs, wanted, ["start", "stop"]), run, "doc_id long, tag int, start int, stop int, words array<int>", 2, HASHED_WORDS)


def path(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs (begin, kept begin, shingles) that rise in both texts; long ones first,
    others as far as they fit between."""
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(runs, key=lambda r: (-r[2], r[0], r[1])):
        at = bisect_left(out, (i, j, n))
        if at:
            a, b, m = out[at - 1]
            lost = max(0, a + m - i, b + m - j)
            i, j, n = i + lost, j + lost, n - lost
        if at < len(out):
            n = min(n, out[at][0] - i, out[at][1] - j)
        if n > 0:
            out.insert(at, (i, j, n))
    return out


def similar_spans(runs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """[start, end) of the longest stretches between runs of a ``path`` whose shingles,
    matched in order, have at least the Jaccard similarity asked, and so many words."""
    if not runs:
        return []
    i, j, n = (np.array(x, np.int64) for x in zip(*runs))
    total = np.concatenate([[0], np.cumsum(n)])
    best = (LEAST_WORDS - SHINGLE, 0, 0)
    for a in range(len(runs)):
        own, other, both = i[a:] + n[a:] - i[a], j[a:] + n[a:] - j[a], total[a + 1:] - total[a]
        fit = np.flatnonzero((both >= SIMILAR * (own + other - both) - 1e-9) & (own > best[0]))
        if len(fit):
            best = (int(own[fit].max()), a, a + int(fit[own[fit].argmax()]))
    size, a, b = best
    if size <= LEAST_WORDS - SHINGLE:
        return []
    return [*similar_spans(runs[:a]), (runs[a][0], runs[a][0] + size + SHINGLE - 1), *similar_spans(runs[b + 1:])]


def matched_runs(own: np.ndarray, start: np.ndarray, stop: np.ndarray, other: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, begin, shingles): runs of shingles in ``own[start:stop]`` that ``other`` holds ``shift`` before."""
    size = np.maximum(stop - start, 0)
    piece = np.repeat(np.arange(len(size)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)
    same = np.concatenate([[False], own[at] == other[at - shift[piece]], [False]])
    same[1:-1] &= own[at] != 0
    new = np.concatenate([[True], piece[1:] != piece[:-1]]) if len(piece) else np.zeros(0, bool)
    begins = same[1:-1] & (~same[:-2] | new)
    ends = same[1:-1] & (~same[2:] | np.concatenate([new[1:], [True]])[:len(new)])
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
    long = end - begin + 1 >= SHINGLE
    return piece[begin[long]], at[begin[long]], (end - begin + 2 - SHINGLE)[long]


def similar_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, tag, start_word, end_word, kept_doc_id) of the ``chains`` found: spans
    around them that are as similar as asked."""
    other = found.select(F.col("kept_doc_id").alias("doc_id"), F.col("kept_tag").alias("tag"), F.col("kept_start").alias("start"), F.col("kept_stop").alias("stop")).distinct()
    there = stretches(docs, other).withColumnsRenamed({"doc_id": "kept_doc_id", "tag": "kept_tag", "start": "kept_start", "stop": "kept_stop"})
    ready = found.join(there, ["kept_doc_id", "kept_tag", "kept_start", "kept_stop"])
    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        words = Words(batch.column(2).to_pylist())
        h = words.h.astype(np.uint32).view(np.int32)
        group, size = [], 0
        lists = batch.column(3)
        for k in range(batch.num_rows):
            for x in lists[k].values if lists[k].is_valid else ():
                there = x["words"].values.to_numpy(zero_copy_only=False)
                lags = {lag + d for lag in x["lags"].as_py() for d in range(-SHIFTS, SHIFTS + 1)}
                start, stop, kept_start = x["start"].as_py(), min(x["stop"].as_py(), int(words.counts[k])), x["kept_start"].as_py()
                group.append((k, start, stop, kept_start, there, sorted(lags), x["kept_doc_id"].as_py()))
                size += (stop - start) * len(lags)
                if size >= AT_ONCE:
                    yield from spans(batch, words, h, group)
                    group, size = [], 0
        if group:
            yield from spans(batch, words, h, group)

    def spans(batch: pa.RecordBatch, words: Words, h: np.ndarray, group: list) -> Iterable[pa.RecordBatch]:
        base, pieces = 0, []
        for c, (k, start, stop, kept_start, there, lags, _) in enumerate(group):
            begin = int(words.begins[k])
            for lag in lags:                    # word w of the text stands against word w - lag of the other
                low, high = max(start, kept_start + lag), min(stop, kept_start + len(there) + lag)
                pieces.append((c, begin + low, begin + high, begin + lag + kept_start - base, lag))
            base += len(there)
        chain, low, high, shift, lag = (np.array(x, np.int64) for x in zip(*pieces))
        piece, at, n = matched_runs(h, low, high, np.concatenate([x[4] for x in group]), shift)
        # the other passage may be the shorter one: all its shingles can be matched ones
        enough = np.bincount(chain[piece], n, minlength=len(group)) >= SIMILAR * (LEAST_WORDS - SHINGLE + 1) - 1e-6
        use = enough[chain[piece]]
        piece, at, n = piece[use], at[use], n[use]
        runs: dict[int, list] = {}
        for c, i, d, m in zip(chain[piece].tolist(), at.tolist(), lag[piece].tolist(), n.tolist()):
            i -= int(words.begins[group[c][0]])
            runs.setdefault(c, []).append((i, i - d, m))
        out = [(group[c][0], s, e, group[c][6]) for c, r in runs.items() for s, e in similar_spans(path(r))]
        take = pa.array([x[0] for x in out], pa.int64())
        yield from sliced([batch.column(0).take(take), batch.column(1).take(take), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32()),
                           pa.array([x[3] for x in out], pa.int64())], ["doc_id", "tag", "start_word", "end_word", "kept_doc_id"])

    fields = ["start", "stop", "kept_start", "words", "lags", "kept_doc_id"]
    return text_map(_with_lists(docs, ready, fields), run, "doc_id long, tag int, start_word int, end_word int, kept_doc_id long", 2, HASHED_WORDS)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, start_word, end_word, n_words, kept_doc_id): passages to remove.

    Of texts, anchors are taken so that equal stretches of 24 words share one.  All
    windows of ``LEAST_WORDS`` words whose anchors stand in several documents are
    grouped by hash, so that every repeated window is compared with the first
    document that holds it; windows that follow each other are one passage.
    Anchors that follow each other in a document and in the first document that
    holds them are chained over edited words; around a chain, the longest spans of
    at least ``LEAST_WORDS`` words are passages whose five-word shingles, matched in
    order, have a Jaccard similarity of 0.8 (words by 32 bits of their hashes).
    Shorter lines that many documents share therefore stay.  An edited passage is
    compared with the first document of each anchor only.

    Documents are told apart by doc_id and a hash of the text, so repeated rows are
    one document.  Rows without an id, null and empty texts repeat nothing; an
    empty table gives no rows.  Groups are never gathered: they are taken with
    partial minima and joined.
    """
    every = kept(_hashed(docs, Words.anchors), "anchors")
    shared = kept(_shared(every), "shared-anchors")
    hits = kept(every.join(shared, "hash"), "anchor-hits")
    forget(every)
    found = kept(chains(_hits(hits)), "chains")
    forget(hits)
    spans = equal_passages(docs, shared).unionByName(similar_passages(docs, found)).distinct()
    before = F.max("end_word").over(W.partitionBy("doc_id", "tag", "kept_doc_id").orderBy("start_word", F.desc("end_word")).rowsBetween(W.unboundedPreceding, -1))
    return (spans.withColumn("_before", before).where("_before is null or end_word > _before")
            .select("doc_id", "tag", F.col("start_word").cast("long").alias("start_word"), F.col("end_word").cast("long").alias("end_word"),
                    (F.col("end_word") - F.col("start_word")).cast("long").alias("n_words"), "kept_doc_id"))


WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without words [start, end) of the spans and the white space after them."""
    at = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, last = [], 0
    for start, end in sorted(spans):
        if at[start] > last:
            out.append(text[last:at[start]])
        last = max(last, at[end])
    return b"".join([*out, text[last:]]).strip() if spans else text


def removed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the passages ``spans`` (of ``repeats``); ``n_chars``, where it is a
    column, follows the text.  Documents of which nothing is left go."""
    names = docs.columns
    near = marked(docs, F.col("doc_id"), spans, F.col("doc_id"))
    lists = spans.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start_word", "end_word")).alias("_spans")).withColumnsRenamed({"doc_id": "_id", "tag": "_tag"})
    hit = near.where("_near").drop("_near").withColumn("_key", _tag())
    joined = hit.join(lists, (hit.doc_id == lists["_id"]) & (hit["_key"] == lists["_tag"]), "left").select(*names, "_spans")

    def run(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        texts, cuts = batch.column(names.index("text")), batch.column(len(names)).to_pylist()
        new = [t if c is None else without(t.encode(), [(s["start_word"], s["end_word"]) for s in c]).decode() for t, c in zip(texts.to_pylist(), cuts)]
        columns = [pa.array(new, pa.string()) if n == "text" else
                   pa.array([old if c is None else len(t) for old, c, t in zip(batch.column(k).to_pylist(), cuts, new)], batch.column(k).type) if n == "n_chars" else
                   batch.column(k) for k, n in enumerate(names)]
        keep = pa.array([c is None or bool(t) for c, t in zip(cuts, new)])
        yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)

    same = near.where("not _near").select(names)
    return same.unionByName(text_map(joined, run, docs.schema, names.index("text")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """Documents with repeated passages taken out; the first copy of each stays."""
    return removed(docs, kept(repeats(docs), "passages"))
