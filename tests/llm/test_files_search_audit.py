"""Token files, ranked search and the filter audit against brute force, with odd rows."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from textsluice.llm import common, filteraudit, lexical, tokenfile

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
# extra columns bear the names that the operators use inside
SCHEMA = ("doc_id long, text string, lang string, m long, row long, part string, flags int, tie string, place string, shard long, "
          "digest string, n long, terms string, body string")


def texts() -> dict:
    r = random.Random(5)
    some = ["".join(r.choice("abcdeé漢") for _ in range(r.randint(1, 4))) for _ in range(300)]
    rows = {i: " ".join(r.choices(some, k=r.randint(1, 300))) for i in range(40)}
    rows |= {40: rows[3], 41: rows[3], 42: None, 43: "", 44: " \n\t ", 45: "SHOUT LOUD " * 60, 46: "100 % & #x", 47: "a\x0bb\x0cc d A-B a_b 'Tis",
             48: " ".join(r.choices(some, k=30_000)), 49: "<|endoftext|> it's 12½ 漢字", 50: "same " * 5000, 51: "", 52: "Ⅷ É é"}
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    pad = (1, 2, "p", 3, "t", "q", 4, "d", 5, "x", "b")
    rows = [(i, t, None if i % 7 == 0 else ["en", "de"][i % 2], *pad) for i, t in texts().items()]
    rows += [rows[5], rows[5], (None, texts()[6], None, *[None] * 11), (None, None, "en", *[None] * 11)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("ids", [
    [], [0], [7] * 10_000, list(range(5000)), [2**60 - 1, 2**60, 2**64 - 1, 0, 1], [1] * 59 + [2**40], [0] * 4097, [2**32] * 500,
    [random.Random(1).randrange(1 << random.Random(k).randrange(1, 65)) for k in range(9000)]])
def test_words_hold_all_ids(ids):
    want = np.array(ids, np.uint64)
    words, offsets, escapes = tokenfile.encoded(want)
    assert (tokenfile.decoded(words, escapes) == want).all() and len(offsets) == -(-len(ids) // tokenfile.BLOCK)
    for k, at in enumerate(offsets):        # a block decodes without those before it
        stop = offsets[k + 1] if k + 1 < len(offsets) else len(words)
        assert (tokenfile.decoded(words[at:stop], escapes) == want[k * tokenfile.BLOCK:(k + 1) * tokenfile.BLOCK]).all()


def test_words_are_few():
    assert len(tokenfile.encoded(np.ones(4096, np.uint64))[0]) == 1                                     # a run
    assert len(tokenfile.encoded(np.arange(4096, dtype=np.uint64) % 2)[0]) == 4096 // 60 + 2      # 68 words of 60, one of 15, one of 1
    assert len(tokenfile.encoded(np.arange(32768, 32768 + 3000, dtype=np.uint64))[0]) == 1000


def test_any_span_of_a_file_can_be_read():
    r, file, every = np.random.default_rng(3), tokenfile.Writer(), []
    for doc in range(700):
        ids = r.integers(0, 50_000, r.integers(0, 2000)).astype("<u4")
        file.add(None if doc == 5 else doc, ids)
        every.append(ids)
    read, flat = tokenfile.Reader(file.body(3, 4) + b"\n"), np.concatenate(every)
    assert (read.part, read.number, read.n) == (3, 4, len(flat))
    for a, b in ((0, 1), (4095, 4097), (100_000, 300_000), (len(flat) - 1, len(flat)), (9, 9)):
        assert (read.ids(a, b) == flat[a:b]).all()
    found = list(read.documents())
    assert [d for d, _, _ in found] == [None if d == 5 else d for d in range(700)] and all((a == b).all() for (_, _, a), b in zip(found, every))
    with pytest.raises(ValueError):
        tokenfile.Reader(file.body(3, 4))       # cut short


def test_token_files(spark, docs, nothing, tmp_path):
    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    rows = [(r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in docs.collect()]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    path = str(tmp_path / "ids")
    tokenfile.write_ids(docs, TOKENIZER, path, part_bytes=40_000, file_ids=9_000)
    found = tokenfile.with_starts(tokenfile.read_documents(spark, path, with_ids=True)).collect()
    assert len({(r["part"], r["number"]) for r in found}) > 3
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == collections.Counter((d, len(i), crc(i)) for d, i in rows)
    assert all(crc(r["ids"]) == r["ids_crc32"] for r in found)
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    assert tokenfile.round_trip(docs, TOKENIZER, str(tmp_path / "again")).count() == len(rows)
    assert tokenfile.round_trip(nothing, TOKENIZER, str(tmp_path / "none")).count() == 0


def brute_search(rows: list, items: list, k: int) -> set:
    term = lambda t: re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
    found = [(d, collections.Counter(term(t))) for d, t in rows]
    n_docs, total = sum(bool(c) for _, c in found), sum(c.total() for _, c in found)
    df = collections.Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in found:
            m = 50 + 50 * c.total() * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in set(term(text)) if c[t])
            if score > 0:
                scored.append((-score, d is not None, d or 0))
        out += [(item, rank, d if known else None, -s) for rank, (s, known, d) in enumerate(sorted(scored)[:k], 1)]
    return collections.Counter(out)


@pytest.mark.parametrize("k,block", [(5, 256), (50, 3)])
def test_search(spark, docs, nothing, monkeypatch, k, block):
    monkeypatch.setattr(lexical, "CHUNK_DOCS", 4)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(i, texts()[i]) for i in (1, 2, 3, 45, 47, 49, 50, 52)] + [(100, None), (101, "?!"), (102, "unheard"), (None, "a b"), (1, "é"), (103, texts()[48])]
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, m long, query long")
    ix = lexical.index(docs)
    found = lexical.search(ix, asked, k=k, block=block)
    assert collections.Counter(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect())) == brute_search(rows, items, k)
    assert lexical.search(ix, asked.limit(0)).count() == 0 and lexical.search(lexical.index(nothing), asked).count() == 0


def test_chunks_are_bounded(docs, monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK_DOCS", 2)
    chunks = lexical.index(docs).chunks.collect()
    stops = [common.from_bytes(c["body"]).column("group_stop")[0].as_py() for c in chunks]
    assert max(c["n_docs"] for c in chunks) == 2 and all(s == sorted(set(s)) for s in stops)


def brute_audit(rows: list, labels: list) -> set:
    def fails(d, t):
        words = re.findall("[^\x20\x09-\x0D]+", t)
        return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and any(o is not None and o < d and u == t for o, u, _ in rows)}
    rows = [(d, t or "", p or "") for d, t, p in rows]
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    out, per = {}, {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for p in {p for _, _, p in rows}:
            for step in range(1, 6):
                out[p, order, step] = [0] * 6
    for d, t, p in rows:
        f = fails(d, t)
        for order in map("".join, itertools.permutations("ABCDE")):
            first = next((k for k, x in enumerate(order) if f[x]), 9)
            for k, x in enumerate(order):
                o = out[p, order, k + 1]
                o[0] += k < first
                o[1] += k == first
                o[2] += f[x] and k > first
                o[3] += f[x] and sum(f.values()) == 1
                o[4] += k == first and d in good
                o[5] += k == first and d in toxic
    for (p, order, step), o in out.items():
        per[p, order[step - 1]] = per.get((p, order[step - 1]), 0) + o[1]
    return {(p, order, step, *o, per[p, order[step - 1]]) for (p, order, step), o in out.items()}


def test_filter_audit(spark, docs, nothing, monkeypatch):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    marks = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 52, 2)] + [(5, 1, None), (5, 0, 1), (None, 1, 1), (7, None, None), (999, 1, 1)]
    labels = spark.createDataFrame([(*x, "n") for x in marks], "doc_id long, quality int, toxic int, part string")
    found = filteraudit.audited(docs, labels)
    want = brute_audit(rows, marks)
    assert set(map(tuple, found.collect())) == want and found.count() == len(want)
    assert filteraudit.audited(nothing, labels).count() == 0
    assert set(map(tuple, filteraudit.audited(docs, labels.limit(0)).collect())) == brute_audit(rows, [])


def test_matrix_is_the_same_in_many_shards(docs):
    def counts(shards):
        ids, out = {}, collections.Counter()
        for s in shards:
            stops = [0, *s["row_stop"]]
            for k, doc in enumerate(s["doc_id"]):
                out[doc, tuple(sorted(zip(s["indices"][stops[k]:stops[k + 1]], s["data"][stops[k]:stops[k + 1]])))] += 1
        return out
    assert counts(filteraudit.matrix(docs).collect()) == counts(filteraudit.matrix(docs.repartition(17)).collect())
