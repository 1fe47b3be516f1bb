"""Operators for training data against brute force, on small tables with odd rows."""

from __future__ import annotations

import collections
import html
import random
import re
import tracemalloc
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
import xxhash
from pyspark.sql import functions as F

from textsluice.llm import bpe, common, components, decontam, extract, packing, quality, shards, simhash, substrings, tokencount, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, root long, tag string, key string"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def words(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdeimnorstu") for _ in range(r.randint(2, 9))) for _ in range(n)]


def prose(n: int, seed: int) -> str:
    w = words(n, seed)
    return "\n".join(" ".join(w[i:i + 12]) + "." for i in range(0, n, 12))


PASSAGE = " ".join(words(70, 99))
LEAK = " ".join(words(30, 98))


@pytest.fixture(scope="module")
def texts() -> dict:
    rows = {i: prose(150, i) for i in range(30)}
    rows |= {30: rows[3], 31: rows[3], 32: rows[4].replace("a", "a", 1) + " zz", 33: None, 34: "", 35: "word", 36: " \n ", 37: prose(20_000, 1007),
             38: prose(60, 41) + " " + PASSAGE + " " + prose(60, 42), 39: prose(80, 43) + " x " + PASSAGE + " y " + prose(20, 44),
             40: prose(60, 45) + " " + LEAK + " " + prose(60, 46), 41: "<|endoftext|> it's 12½ \x1c 漢字 don't  two\t\n", 42: "SHOUT!! " * 90}
    rows |= {43: prose(70, 47) + " " + " ".join("new" if i in (4, 12) else w for i, w in enumerate(LEAK.split()[:16])) + " " + prose(50, 48)}
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), 1, "t", None) for i, t in texts.items()]
    rows += [rows[5], (None, texts[6], None, None, None, None, None, None)]      # a repeated row, a row without an id
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_portions_keep_rows_whole_and_in_order():
    texts = [b"a" * 10, None, b"b" * 95, b"", b"c" * 40, b"d" * 60, b"e", b"f" * 500]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.binary())], ["k", "text"])
    parts = list(common.portions(batch, 1, 100))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1], [2, 3], [4, 5], [6], [7]]
    assert pa.Table.from_batches(parts).column(1).to_pylist() == texts
    assert list(common.portions(batch.slice(0, 0), 1)) == []


def test_components(spark):
    r = random.Random(1)
    links = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    got = {n: x for n, x in components.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in root if find(n) != n}


def slow_print(text: str) -> int:
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_groups(docs, nothing, texts):
    got = simhash.near_groups(docs).collect()
    assert len(got) == docs.count()
    prints = {i: slow_print(t) for i, t in texts.items()}
    group = {i: i for i in prints}
    for _ in prints:
        for i, j in combinations(prints, 2):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                group[i] = group[j] = min(group[i], group[j])
    assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in got if r.doc_id is not None} == {i: (prints[i], group[i]) for i in prints}
    assert [r.component_id for r in got if r.doc_id is None] == [6]
    kept = [r.doc_id for r in simhash.one_of_each(docs).collect()]
    assert sorted(kept, key=str) == sorted([*{g for g in group.values()}, None], key=str)
    assert simhash.one_of_each(docs).columns == docs.columns
    assert simhash.near_groups(nothing).count() == 0


def test_no_task_of_near_groups_runs_two_python_workers(docs, monkeypatch):
    plans = []

    def planned(df, what):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.kept(df, what)

    monkeypatch.setattr(components, "kept", planned)
    monkeypatch.setattr(simhash, "kept", planned)
    simhash.near_groups(docs).collect()
    stages = [part for plan in plans for part in plan.split("Exchange")]
    assert max(len(re.findall("MapInArrow|MapGroupsInArrow", s)) for s in stages) == 1


def test_ball_links_are_those_within_three_bits():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    prints = [int(b) for b in base]
    for b in base[:25]:
        for n in (1, 2, 3, 3, 4):
            prints.append(int(b) ^ sum(1 << int(k) for k in r.choice(64, n, replace=False)))
    prints = np.unique(np.array(prints, np.uint64))
    held, flips = [], []
    for p in prints:
        n = len(simhash.FLIPS) if int(p).bit_count() % 2 else simhash.SHORT
        held += [p] * n
        flips += range(n)
    a, b = simhash.hub_links(np.array(held, np.uint64), np.array(flips, np.uint16))
    assert (np.bitwise_count(a ^ b) <= 3).all()
    nodes, roots = components.local_roots(a, b)
    x, y = zip(*((p, q) for p, q in combinations(prints, 2) if int(p ^ q).bit_count() <= 3))
    want = components.local_roots(np.array(x), np.array(y))
    assert dict(zip(nodes, roots)) == dict(zip(*want))


def test_sharding(spark, docs, nothing, texts, tmp_path):
    got = shards.sharded(docs, 4).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    for k in range(4):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert shards.sharded(nothing, 4).count() == 0
    recs = shards.records(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abcdefghij").alias("text")))
    loads = shards.slot_bytes(recs)
    first = shards.first_map(loads, 4)
    path = str(tmp_path / "maps")
    shards.save_map(first, path)
    shards.save_map(shards.rebalanced(shards.load_map(spark, path), loads, 5), path)
    old, new = ({r.vslot: r.shard for r in shards.load_map(spark, path, v).collect()} for v in (1, 2))
    assert len(old) == len(new) == shards.SLOTS and all(new[s] in (old[s], 4) for s in old)
    size = collections.Counter()
    for r in loads.collect():
        size[new[r.vslot]] += r.bytes
    assert max(size.values()) < 1.2 * min(size.values()) and len(size) == 5


def test_repeated_passages(docs, nothing, texts):
    spans = substrings.repeats(docs)
    got = spans.collect()
    pairs = {(r.doc_id, r.kept_doc_id) for r in got}
    assert {(30, 3), (31, 3), (32, 4), (39, 38)} <= pairs
    assert {d for d, _ in pairs} == {30, 31, 32, 39}
    for r in got:
        own, kept = (texts[d].lower().split() for d in (r.doc_id, r.kept_doc_id))
        assert " ".join(own[r.start_word:r.end_word]) in " ".join(kept) and r.n_words >= 50
    left = {r.doc_id: r for r in substrings.deduplicated(docs).collect()}
    assert PASSAGE in left[38].text and PASSAGE not in left[39].text and len(left[39].text.split()) <= 104
    assert left[39].n_chars == len(left[39].text) and left[10].text == texts[10] and 30 not in left
    assert substrings.repeats(nothing).count() == 0 and substrings.deduplicated(nothing).count() == 0


def found_of(spark, rows: dict) -> dict:
    """Words of each document that the passages found cover."""
    covered = collections.defaultdict(set)
    for r in substrings.repeats(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)).collect():
        covered[r.doc_id] |= set(range(r.start_word, r.end_word))
    return covered


def test_passages_with_spread_edits_repeat(spark):
    rows, want = {}, {}
    for k, (n, edits) in enumerate(((54, 1), (100, 2), (150, 3), (200, 4), (400, 8))):
        for trial in range(6):
            key = 100 * k + trial
            passage = words(n, 5000 + key)
            other = ["edited%d" % i if any(i == (e + 1) * n // (edits + 1) for e in range(edits)) else w for i, w in enumerate(passage)]
            rows[key] = " ".join([*words(60, 6000 + key), *passage, *words(40, 7000 + key)])
            rows[10_000 + key] = " ".join([*words(33, 8000 + key), *other, *words(70, 9000 + key)])
            want[10_000 + key] = set(range(33, 33 + n))
    got = found_of(spark, rows)
    assert set(got) == set(want) and all(want[d] <= got[d] <= set(range(28, 38 + len(want[d]))) for d in want)


def test_passages_whose_parts_stand_in_earlier_documents_repeat(spark):
    rows, want = {}, {}
    for k in range(20):
        passage = words(60, 300 + k)
        for d, part in ((1, passage[:45]), (2, passage[15:]), (10, passage), (20, passage)):
            rows[1000 * k + d] = " ".join([*words(40, 1000 * k + d), *part, *words(40, 1000 * k + 500 + d)])
        want[1000 * k + 20] = set(range(40, 100))
    assert found_of(spark, rows) == want


def test_passages_longer_than_the_kept_one_repeat(spark):
    """Two words put into 48: 40 of 46 and 44 shingles are common, a Jaccard similarity of just 0.8."""
    rows, want = {}, {}
    for k in range(8):
        passage = words(48, 500 + k)
        other = [*passage[:24], f"put{k}", f"in{k}", *passage[24:]]
        rows[k], rows[100 + k] = (" ".join([*words(70, 60 * k + s), *p, *words(70, 60 * k + s + 1)]) for s, p in ((5, passage), (7, other)))
        want[100 + k] = set(range(70, 120))
    assert found_of(spark, rows) == want


def test_word_hashes_are_of_lower_cased_words():
    texts = [b"", b" A b\tB  a ", "z\x0b\u00c9 \u00e9".encode(), b""]
    words = substrings.Words(texts)
    assert words.begins.tolist() == [52, 104, 160, 215] and words.counts.tolist() == [0, 4, 3, 0] and len(words.h) == 267
    a, b, b2, a2 = words.h[104:108].tolist()
    assert a == a2 and b == b2 and len({0, a, b, *words.h[160:163].tolist()}) == 6 and (words.h > 0).sum() == 7


@pytest.mark.parametrize("of", [substrings.Words.anchors, lambda w: w.windows(np.full(1 << substrings.MAP_BITS - 6, 2**64 - 1, np.uint64))])
def test_hashing_words_takes_little_memory(spark, monkeypatch, of):
    """Work arrays do not follow the size of the batch."""
    monkeypatch.setattr(common, "map_in_arrow", lambda df, fn, schema: fn)
    text = " ".join(words(300, 1)).encode()
    n = (3 << 20) // len(text)
    batch = pa.record_batch([pa.array(range(n)), pa.array([0] * n, pa.int32()), pa.array([text] * n)], ["doc_id", "tag", "text"])
    run = substrings._hashed(spark.createDataFrame([], "doc_id long, text string"), of)
    tracemalloc.start()
    rows = sum(out.num_rows for out in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    one = sum(out.num_rows for out in run(iter([batch.slice(0, 1)])))
    assert rows == n * one > 0 and peak < 32 << 20


def test_passages_that_repeat_themselves_are_found(spark):
    period = ["a", "b", "c", "d", "e", "f"]
    rows, want = {}, {}
    for k, passage in enumerate((period * 10, period * 100, ["-"] * 60, ["0", "."] * 300)):
        passage = [f"{w}{k}" for w in passage]
        rows[k], rows[10 + k] = (" ".join([*words(80, 20 * k + s), *passage, *words(80, 20 * k + s + 1)]) for s in (1, 3))
        want[10 + k] = set(range(80, 80 + len(passage)))
    assert found_of(spark, rows) == want


PAGES = "page_id long, url string, html string, text string, digest string"


@pytest.fixture(scope="module")
def pages(spark):
    body = "<p>" + "same words here " * 20 + "</p>"
    rows = [(3, "http://a.org/x", body), (1, "http://a.org/y\nz", body), (7, None, body), (7, None, body), (2, "http://b.org", None), (4, "http://b.org", ""),
            (5, "http://b.org", "short"), (6, "http://c.org", "short"), (6, "http://c.org", "short"), (8, "u", "WARC/1.0\r\n\r\nContent-Length: 9\r\n\r\n" * 9),
            (None, "http://n.org", "x" * 150)]
    return spark.createDataFrame([(*r, "extra", "d") for r in rows], PAGES).repartition(3)


def test_warc_round_trip(spark, pages, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_warc(pages, path)
    captures = warc.read_captures(spark, path)
    assert captures.where("request is null or size(metadata) != 1").count() == 0
    found = warc.resolved(captures).collect()
    ids = {r.record_id: r.page_id for r in found}
    got = collections.Counter((r.page_id, r.record_type, ids.get(r.refers_to)) for r in found)
    assert got == collections.Counter([(1, "response", None), (3, "revisit", 1), (7, "revisit", 1), (7, "revisit", 1), (2, "response", None), (4, "response", None),
                                       (5, "response", None), (6, "response", None), (6, "response", None), (8, "response", None), (None, "response", None)])
    payloads = {(r.target_uri, bytes(r.payload)) for r in captures.where("record_type = 'response'").collect()}
    assert payloads >= {(r.url, (r.html or "").encode()) for r in pages.where("page_id in (2, 4, 5, 6, 8) or page_id is null").collect()}
    empty = str(tmp_path / "none")
    warc.write_warc(pages.limit(0), empty)
    assert warc.read_captures(spark, empty).count() == 0


def test_benchmark_overlaps(spark, docs, nothing):
    items = spark.createDataFrame([(1, LEAK.upper()), (1, LEAK.upper()), (2, " ".join(words(40, 1234))), (3, None), (4, ""), (5, "word"), (6, " ".join(words(10, 55))), (None, LEAK)],
                                  "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, items).collect()} == {(40, 1), (43, 1), (35, 5)}
    left = decontam.clean(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - 3
    assert decontam.overlaps(nothing, items).count() == 0 and decontam.overlaps(docs, items.limit(0)).count() == 0


def test_masks_find_every_overlap():
    for n in range(decontam.SPAN, decontam.OVERLAP + 1):
        for bad in combinations(range(n), n - decontam.needed(n)):
            assert any(all(m[i] == "0" or o + i not in bad for i in range(decontam.SPAN)) for m in decontam.MASKS for o in range(n - decontam.SPAN + 1))


def test_packing(docs, nothing, texts):
    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    ids = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in texts.items()}
    got = packing.packed(docs, TOKENIZER).collect()
    used, covered = collections.defaultdict(list), collections.Counter()
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None:
            covered[r.doc_id] += r.length
            assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
    assert covered == collections.Counter({i: len(x) * (2 if i == 5 else 1) for i, x in ids.items()})
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.packed(nothing, TOKENIZER).count() == 0


def test_packing_fills_and_balances():
    r = np.random.default_rng(2)
    lengths = np.concatenate([r.integers(1, 900, 500), [5000, 2048, 1]])
    pieces = packing.balanced(lengths)
    total = collections.Counter()
    for _, _, n, s, _ in pieces:
        total[s] += n
    assert sum(total.values()) == lengths.sum() and len(total) == -(-(lengths % 2048).sum() // 2048) + (lengths // 2048).sum()
    assert packing.balanced(np.zeros(0, np.int64)) == []


def test_nearest_codes(spark):
    r = np.random.default_rng(4)
    centre = r.normal(size=(5, 64))
    rows = [(i, (centre[i % 5] + r.normal(size=64) * 0.5).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(2000, None), (2001, [1.0, -1.0]), (None, rows[0][1])]
    codes = topk.codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    code = {r.vec_id: r.code % 2**64 for r in codes.where("vec_id is not null").collect()}
    got = topk.nearest(codes, codes.where("vec_id % 20 = 0")).collect()
    for q in (v for v in code if v % 20 == 0):
        want = sorted(((code[q] ^ c).bit_count(), v) for v, c in code.items())[:topk.K]
        assert [(r.distance, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert topk.nearest(codes.limit(0), codes).count() == 0
    few = codes.where("vec_id < 3")
    assert topk.nearest(few, few).count() == 9


def test_quality(spark, docs, nothing):
    good = [(i, prose(60 + i % 40, i)) for i in range(200)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in words(50 + i % 30, i))) for i in range(120)]
    rows = spark.createDataFrame([(i, t, 0.5, "x") for i, t in good + bad], "doc_id long, text string, score double, y string")
    marks = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad] + [(9999, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(rows, marks)
    got = quality.scored(rows, model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(got) == 320 and len(held) > 30 and np.mean([r.predicted == (r.doc_id < 1000) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.scored(docs, model).count() == docs.count() and quality.scored(nothing, model).count() == 0
    none = quality.fit(docs, marks.limit(0))
    assert {round(r.score, 1) for r in quality.scored(docs, none).collect()} == {0.5}
    at, level = quality.isotonic(np.arange(4.0), np.array([0.0, 2, 1, 3]), np.array([2.0, 2, 2, 3]))
    assert list(at) == [0, 1.5, 3] and list(level) == [0, 0.75, 1]


def test_token_counts(docs, nothing, texts):
    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts.items()}
    for head in (tokencount.HEAD, 3):
        got = tokencount.token_counts(docs, TOKENIZER, head=head).collect()
        assert len(got) == docs.count()
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got if r.doc_id is not None} == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert tokencount.token_counts(nothing, TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        bpe.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))


ARTICLE = "<article><h1>Head &amp; line</h1><p>One  <b>two</b>\n three<p>four<br>five &eacute;</article>"


@pytest.mark.parametrize("page, text", [
    (f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=x>m</a></nav><div class='ad'>buy</div>{ARTICLE}<footer>f</footer></body></html>",
     "Head & line One two three four five é"),
    ("<body><header>site</header><div id='sidebar'>side</div><main><p>text a</p><form><p>f</p></form><section class='comments'>no</section><p>b</p></main></body>", "text a b"),
    ("<div class='cookie-notice'>ok</div><div class='content'><p>only</p><script>var t='</p>';</script><p>this</p></div>", "only this"),
    ("plain text &lt;here", "plain text <here"), ("", ""), ("<!-- <p>x</p> -->", ""), ("<nav>menu</nav>", ""), ("<p 'x <p>a", "<p 'x a"),       # a tag whose quote never closes is text
])
def test_page_text(page, text):
    assert extract.main_text(page, None) == text


def test_host_paths_decide(spark):
    odd = "<body><div class='story12'><p>" + "w " * 30 + "</p></div><div class='extra'><p>" + "z " * 60 + "</p></div></body>"
    usual = "<body><div class='story7'><p>" + "w " * 90 + "</p></div><div class='extra'><p>z</p></div></body>"
    rows = [(i, "http://H.org/%d" % i, usual) for i in range(5)] + [(9, "http://h.org/9", odd), (10, None, None), (10, None, None), (None, "x", ARTICLE)]
    got = collections.Counter((r.page_id, r.text) for r in extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect())
    assert got[(9, " ".join("w" * 30))] == 1 and got[(10, "")] == 2 and got[(None, "Head & line One two three four five é")] == 1
    assert extract.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_all_containers_of_the_winning_path_are_taken(spark):
    one, two, three = ("<div class='text'><p>" + f"{w} " * n + "</p></div>" for w, n in (("one", 150), ("two", 100), ("three", 150)))
    advert = "<div class='advert'>buy</div>"
    wrapped, bare = f"<body><div>{one}{advert}{two}</div></body>", f"<body>{one}{advert}{two}{three}</body>"
    assert extract.main_text(wrapped, None) == " ".join(["one"] * 150 + ["two"] * 100)
    assert extract.main_text(bare, None) == " ".join(["one"] * 150 + ["two"] * 100 + ["three"] * 150)
    pages = spark.createDataFrame([(i, "http://h.org/%d" % i, wrapped) for i in range(3)] + [(3, "http://g.org", bare)], "page_id long, url string, html string")
    assert {r.page_id: len(r.text.split()) for r in extract.extracted(pages).collect()} == {0: 250, 1: 250, 2: 250, 3: 400}
    story = "<div class='story'><p>" + "w " * 90 + "</p></div>"                   # two halves outweigh one longer block of another path
    halves = "<body><div class='post'><p>" + "p " * 60 + "</p></div>" + story.replace("w ", "v ") + "<div class='post'><p>" + "q " * 60 + "</p></div></body>"
    assert extract.main_text(halves, None) == " ".join(["p"] * 60 + ["q"] * 60)


def test_pages_of_the_tables(spark):
    def article(page: str) -> str:
        inside = page[page.index("<article>"):page.index("</article>")]
        return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inside)).split())

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in extract.extracted(pages).collect()} == want


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == before.columns
        texts = {r.doc_id: r.text for r in before.collect()}
        kept = [r.doc_id for r in docs.collect()]
        assert len(set(kept)) == len(kept) and set(kept) <= set(texts) and len(kept) >= 0.7 * len(texts), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}
