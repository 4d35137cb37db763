"""Archives, search, mixing, packing, toxicity, main text and the pipeline against brute force, round trips and held-out rows."""

import base64
import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sourceloom.llm import bpe, html_text, mixing, packing, topk, toxicity, warc

BPE = public_tokenizers.path("byte_bpe_50k.json")


# ----- archives ---------------------------------------------------------------------------------------------------

PAGES = [(1, "http://a/1", "<p>one"), (2, "http://a/2", "<p>one"), (3, None, None), (4, "u\r\nWARC-Type: x", ""), (5, "é: ü", "é" * 70_000), (6, "", "é" * 70_000), (None, "n", "<p>one"), (None, "m", "alone"), (7, "dup", "seven"), (7, "dup", "seven"), (8, "r", "WARC/1.1\r\n\r\n\r\n\r\n")]


@pytest.mark.parametrize("least", [0, 100])
def test_archive_round_trip(spark, least):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id bigint, url string, html string, hash string, first int")
    folder = warc.archive_folder(spark)
    index = warc.write_archive(pages.repartition(3), folder, least=least)
    got = sorted(((r.page_id, r.url, r.payload and bytes(r.payload), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(index, folder).collect()), key=str)
    want = []
    for i, url, page in PAGES:
        payload = (page or "").encode()
        equal = [k for k, _, p in PAGES if (p or "") == (page or "") and k is not None]
        first = min(equal, default=None)
        revisit = len(payload) >= least and first is not None and first != i
        url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
        want.append((i, url, None if revisit else payload, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    blank = [tuple(v if v != b"" else None for v in x) for x in got]
    assert sorted(blank, key=str) == sorted((tuple(v if v != b"" else None for v in x) for x in want), key=str)
    some = warc.read_records(index.where("page_id in (5, 8)"), folder)
    assert sorted(r.page_id for r in some.collect()) == [5, 8]
    assert warc.read_records(warc.write_archive(pages.limit(0), folder), folder).count() == 0


def test_reads_are_coalesced():
    ranges = [(0, 10), (10, 10), (25, 5), (100, 50), (150, 900)]
    assert warc.coalesced(ranges, gap=5, span=1000) == [(0, 30, 3), (100, 950, 2)]
    assert warc.coalesced(ranges, gap=1000, span=60) == [(0, 30, 3), (100, 50, 1), (150, 900, 1)]
    assert warc.coalesced([], 1, 1) == []


# ----- search -----------------------------------------------------------------------------------------------------


def top_by_hand(rows, k, scale, asks):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vectors.setdefault(i, []).append([int(np.floor(scale * np.float64(np.float32(x)))) for x in v])
    out = []
    for q, own in vectors.items():
        if asks(q):
            scores = sorted((-sum(a * b for a, b in zip(own[0], v)), i) for i, vs in vectors.items() for v in vs if i != q and len(v) == len(own[0]))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale, blocks", [(64.0, (50, 7)), (1.0, (8192, 1024)), (1e6, (1000, 10))])
def test_top_k(spark, monkeypatch, scale, blocks):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(200)]
    rows += [(200 + i, rows[i][1]) for i in range(30)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, rows[0][1]), (304, [1.0, 2.0]), (310, [3.0, 4.0]), (320, []), (5, rows[5][1])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, id int, width string")
    monkeypatch.setattr(topk, "CANDIDATES", blocks[0])
    monkeypatch.setattr(topk, "QUERIES", blocks[1])
    got = topk.top_k(frame.repartition(3), F.col("vec_id") % 10 == 0, k=6, scale=scale)
    assert sorted(map(tuple, got.collect())) == top_by_hand(rows, 6, scale, lambda q: q % 10 == 0)


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_k(none, F.col("vec_id") % 10 == 0).count() == 0


def test_reading_stops_early():
    """Clear winners are resolved before the lists are read to the end."""
    rng = np.random.default_rng(5)
    values = rng.integers(-3, 4, (4000, 16)).astype(np.int64)
    values[:20] = 60
    lists = topk.SortedLists(np.arange(4000), values)
    depths = []
    plain = lists.bounds
    lists.bounds = lambda p, n, depth, kind: (depths.append(depth), plain(p, n, depth, kind))[1]
    query, found, score = topk.block_top(np.array([9999]), np.full((1, 16), 50), lists, 20)
    assert depths == [2000] and sorted(found) == list(range(20)) and set(score) == {16 * 60 * 50}


# ----- mixing -----------------------------------------------------------------------------------------------------


def level(children, budget):
    """Budgets of (capacity, weight) children: repeated rounds by weight among those that still have room."""
    given, open_ = [0.0] * len(children), [k for k, (c, w) in enumerate(children) if c > 0 and w > 0]
    left = min(budget, sum(children[k][0] for k in open_))
    while open_ and left > 1e-9:
        total = sum(children[k][1] for k in open_)
        step = min(left, min((children[k][0] - given[k]) / children[k][1] for k in open_) * total)
        for k in open_:
            given[k] += step * children[k][1] / total
        left -= step
        open_ = [k for k in open_ if children[k][0] - given[k] > 1e-9]
    return given


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(k, " ".join("w" for _ in range(rng.choice([0, 1, 5, 50]))), rng.choice(["en", "en", "de", None]), f"s{min(rng.randrange(9), 3)}") for k in range(600)]
    rows += [(700, None, "en", "s0"), (701, "w " * 4000, "de", None), (None, "w w w", "en", "s1"), (5, rows[5][1], rows[5][2], rows[5][3])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, lang string, source string, whole int, place string")
    mix = mixing.Mix(domains={"even": 3.0, "odd": 1.0}, languages={"en": 2.0, "de": 1.0}, sources={"s0": 0.0}, tokens=9000, max_epochs=3, seed=8)
    domain = F.when(F.col("source").isin("s0", "s2"), "even").otherwise("odd")
    got = mixing.mixed_documents(docs.repartition(4), mix, domain)
    assert got.columns == [*docs.columns, "epoch", "tokens", "domain"]
    got = got.collect()

    tokens = lambda t: len((t or "").split())
    leaves = collections.Counter()
    members = collections.defaultdict(list)
    for i, t, lang, source in rows:
        leaf = ("even" if source in ("s0", "s2") else "odd", lang or "", source or "")
        leaves[leaf] += tokens(t)
        members[leaf].append((i, tokens(t)))
    leaves = {k: v for k, v in leaves.items() if v}
    cap = lambda prefix: sum(3 * v for k, v in leaves.items() if k[: len(prefix)] == prefix and mix.sources.get(k[2], 1.0) > 0)
    budget = {(): min(9000, cap(()))}
    for depth, weights in enumerate((mix.domains, mix.languages, mix.sources), 1):
        for parent in [p for p in budget if len(p) == depth - 1]:
            names = sorted({k[:depth] for k in leaves if k[: depth - 1] == parent})  # without weight: no capacity
            shares = level([(cap(n), weights.get(n[-1], 1.0)) for n in names], budget[parent])
            budget.update(zip(names, shares, strict=True))
    want = collections.Counter()
    for leaf, total in leaves.items():
        whole, rest = divmod(int(budget[leaf] + 1e-6), total)
        place = lambda i: (hashlib.md5(f"8:{whole}:{'' if i is None else i}".encode()).hexdigest(), str(i))  # noqa: B023, E731
        for i, _ in members[leaf]:
            for epoch in range(whole):
                want[i, epoch] += 1
        sizes = collections.Counter()
        for i, n in members[leaf]:
            sizes[i] += n
        upto, inside = 0, set()
        for i in sorted(sizes, key=place):
            upto += sizes[i]
            if upto <= rest and rest > 0:
                inside.add(i)
        for i, _ in members[leaf]:
            if i in inside:
                want[i, whole] += 1
    assert collections.Counter((r.doc_id, r.epoch) for r in got) == want
    assert sum(r.tokens for r in got) <= 9000
    assert mixing.mixed_documents(docs.limit(0), mix, domain).count() == 0


# ----- packing ----------------------------------------------------------------------------------------------------


def test_token_ids_by_arrays():
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    rng = random.Random(6)
    signs = ["'", "s", "t", "re", "'ve", "'ll", "'d", " ", "  ", "\n", "\t", "1", "²", "é", "a", "!", "?!", "　", "Z", "½", "😀", "中", "<|endoftext|>", "\x1c", "\xa0"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(800)] + ["", " ", "a" * 5000]
    ids, ends = bpe.Encoder(BPE, limit=2000).encode(texts)
    starts = np.concatenate([[0], ends[:-1]])
    for text, a, b, want in zip(texts, starts, ends, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[a:b].tolist() == want.ids, text


def test_pieces_with_one_hash_have_their_own_ids():
    """Two words that sums over powers modulo 2^64 cannot tell apart."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    encoder = bpe.Encoder(BPE)
    ids, ends = encoder.encode([a, b])
    want = [e.ids for e in encoder.tokenizer.encode_batch([a, b], add_special_tokens=False)]
    assert want[0] != want[1] and [ids[: ends[0]].tolist(), ids[ends[0] :].tolist()] == want


def test_every_token_and_every_character():
    """Merges by ranks give each token of the file back; characters newer than the tokenizer's tables are read by it."""
    encoder = bpe.Encoder(BPE)
    assert encoder.by_ranks is not None
    tokens = [encoder.tokenizer.decode([k]) for k in range(50256)]
    texts = [t for t in tokens if "\ufffd" not in t]
    signs = [chr(c) for c in (*range(0x80, 0x3000, 7), *range(0xA700, 0xA800), *range(0x10780, 0x107C0), *range(0x1E000, 0x1F000, 3)) if not 0xD800 <= c < 0xE000]
    texts += [f"a{x}{x}1{x} {x}!{x}" for x in signs]
    ids, ends = encoder.encode(texts)
    for text, a, b, want in zip(texts, [0, *ends[:-1]], ends, encoder.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[a:b].tolist() == want.ids, text


def test_packing(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 1, 3, 20, 60])))) for k in range(150)]
    rows += [(200, None), (201, ""), (202, "x y " * 900), (203, "same text"), (203, "same text"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, part int")
    got = packing.pack(docs.repartition(4), BPE, capacity=64).collect()
    tokenizer = Tokenizer.from_file(BPE)
    want, total = collections.Counter(), 0
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        first = len(ids) % 64 or 64 if len(ids) > 64 else len(ids)
        cuts = [0, *range(first, len(ids), 64), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.05 * total / 64 + 2
    assert packing.pack(docs.limit(0), BPE).count() == 0


def test_plan_matches_large_items_best():
    """For items of over a third of the capacity the greedy matching is as good as any matching."""
    rng = random.Random(8)
    for _ in range(40):
        sizes = sorted(rng.randrange(11, 31) for _ in range(rng.randrange(1, 9)))
        counts = np.bincount(sizes, minlength=31)

        def best(left):
            if not left:
                return 0
            head, rest = left[0], left[1:]
            return 1 + min([best(rest), *(best(rest[:k] + rest[k + 1 :]) for k in range(len(rest)) if head + rest[k] <= 30)])

        runs = packing.plan(counts, 30)
        used = max(int(r[2]) + n for r, n in zip(runs, _sizes(runs, counts), strict=True))
        assert used == best(tuple(sizes))


def _sizes(runs, counts):
    """Pieces of each run."""
    ends = [int(b[1]) if b is not None and b[0] == a[0] else int(counts[a[0]]) for a, b in zip(runs, [*runs[1:], None], strict=True)]
    return [e - int(r[1]) for e, r in zip(ends, runs, strict=True)]


# ----- toxicity ---------------------------------------------------------------------------------------------------


def test_segments():
    def by_hand(scores):
        best = None
        for i in range(len(scores)):
            total = 0.0
            for j in range(i, len(scores)):
                total += scores[j]
                if total > 0 and (best is None or total > best[0] + 1e-12):
                    best = (total, i, j + 1)
        return [*by_hand(scores[: best[1]]), best[1:], *((a + best[2], b + best[2]) for a, b in by_hand(scores[best[2] :]))] if best else []

    rng = np.random.default_rng(9)
    for _ in range(150):
        scores = rng.normal(-0.2, 1, rng.integers(0, 20))
        assert [s[1:] for s in toxicity.segments(scores)] == by_hand(scores)


def test_held_out_toxicity(spark):
    rng = random.Random(10)
    bad = [f"zug{x}" for x in ("an", "er", "il", "os", "um", "ta", "re")]
    rows, labels = [], []
    for k in range(900):
        text = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(20, 200))]
        toxic = rng.random() < 0.2
        for _ in range(3 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame([*rows, (2000, None), (2001, ""), (2002, "zugneu Zugxx"), (2003, "v1 " * 50_000), (None, "zuger")], "doc_id bigint, text string").withColumn("toxicity_", F.lit(1))
    truth = dict(labels)
    known = spark.createDataFrame([*[x for x in labels if x[0] % 3], (1, 0), (2000, None), (None, 1), (2001, 7)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, known)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    held = [k for k in truth if k % 3 == 0]
    assert sum((got[k].toxicity >= 0.5) == truth[k] for k in held) >= 0.97 * len(held)
    assert got[2000].toxicity == got[2001].toxicity < 0.5 and got[2003].toxicity < 0.5
    assert got[2002].toxicity > got[2000].toxicity  # words never seen, by their beginning
    hit = next(k for k in held if truth[k])
    text = dict(rows)[hit].encode()
    assert any(text[p.first_byte :].startswith(b"zug") for p in got[hit].toxic_passages)
    none = known.limit(0)
    assert {r.toxicity for r in toxicity.scored(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    assert toxicity.scored(docs.limit(0), model).count() == 0


# ----- main text --------------------------------------------------------------------------------------------------


def test_lines_of_pages():
    page = """<!DOCTYPE html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="nav-page"><nav><ul><li>Menu</li></ul></nav>
    <!-- <p>no</p> --><div class='ad'>Buy &amp; go</div><header>Top</header><article><h1>A &lt;b&gt;</h1><p>one<br>two <b>th</b>ree<p>four&nbsp;five
    <aside>side</aside><form>f</form></p><div id="comments"><p>I say</p></div><p title="a > b">six</article><footer>&copy;</footer>"""
    found, kinds = html_text.lines(page)
    text = [line for line, kind in zip(found, kinds, strict=True) if kind & html_text.ARTICLE and not kind & html_text.BOILERPLATE]
    assert text == ["A <b>", "one two three", "four five", "six"]
    assert {"Menu", "Buy & go", "Top", "©", "I say", "side", "f"} == set(found) - set(text)
    assert html_text.lines("") == ([], b"") and html_text.lines("<script>x") == ([], b"")
    assert html_text.lines("a < b <c")[0] == ["a < b <c"]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = np.random.default_rng(12)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(0, 12)) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        found = html_text.shared_lines(a, b)
        rest = iter(b.tolist())
        assert len(found) == table[-1, -1] and all(x in rest for x in a[found].tolist())


@pytest.mark.parametrize("tasks", [1, 7])
def test_differencing_without_a_marked_article(spark, tasks):
    """Template lines go, own lines stay; the same for any number of ranges."""
    rows = []
    for k in range(40):
        own = [f"own {k} {j}" for j in range(k % 4)]
        body = "".join(f"<p>{x}</p>" for x in ["Site name", *own, "All rights"])
        rows.append((k, f"http://h{k % 3}/a/{k // 3:02d}", body))
    rows += [(100, None, "<p>x</p>"), (101, "bad url", None), (102, "http://only/", "<p>kept</p>"), (7, rows[7][1], rows[7][2]), (None, "http://x/", "<article><p>t &amp; u</article>")]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "page_id bigint, url string, html string, edge string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        got = [(r.page_id, r.text) for r in html_text.main_texts(frame).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = [(k, "\n\n".join(f"own {k} {j}" for j in range(k % 4))) for k in range(40) if k != 7]
    want += [(100, "x"), (101, ""), (102, "kept"), (None, "t & u")]
    want += [(7, "own 7 0\n\nown 7 1\n\nown 7 2")] * 2  # a repeated page is no partner of its own
    assert sorted(got, key=str) == sorted(want, key=str)
    assert html_text.main_texts(frame.limit(0)).count() == 0


@pytest.mark.parametrize("tasks", [1, 7])
def test_copies_keep_their_text(spark, tasks):
    """Copies and near copies at neighbouring URLs are no partners; pages of a host with copies only keep all."""
    wrap = lambda *own: "".join(f"<p>{x}</p>" for x in ["Site name", *own, "All rights"])
    long = [f"line {j} of a text with some length" for j in range(20)]
    rows = [(k, f"http://h/a?utm={k:02d}", wrap(*long)) for k in range(12)]
    rows += [(20 + k, f"http://h/b?print={k}", wrap(*long[:10], f"near {k}", *long[10:])) for k in range(3)]
    rows += [(30, "http://h/c", wrap("other text")), *[(40 + k, f"http://only/{k}", wrap("alone")) for k in range(2)], (50, "http://h/c", wrap("other text"))]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        got = {r.page_id: r.text.split("\n\n") for r in html_text.main_texts(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(got[k] == long for k in range(12))
    assert all(got[20 + k] == [*long[:10], f"near {k}", *long[10:]] for k in range(3))
    assert got[30] == got[50] == ["other text"] and got[40] == got[41] == ["Site name", "alone", "All rights"]


def test_names_and_small_articles_do_not_empty_a_page(spark):
    """Comments as article elements, wrappers with chrome-like names, sections and headings of an article."""
    text = "".join(f"<p>{x} of a text that is long enough</p>" for x in ("one", "two", "three"))
    own = [f"{x} of a text that is long enough" for x in ("one", "two", "three")]
    bodies = {
        1: f"<div>{text}</div><section id=comments><article>I say</article></section>",
        2: f"<div>{text}</div><article class=comment>I say</article><article class=comment>So do I</article>",
        3: f'<div class="has-sidebar"><article>{text}</article></div>',
        4: f'<div class="container header-fixed"><div>{text}</div></div>',
        5: f'<article><section id="related-work">{text}</section></article>',
        6: f'<article><section id="discussion">{text}</section></article>',
        7: f'<div id="search"><article>{text}</article></div><div class=ad>Buy</div>',
        8: f'<article><p>three of a text that is long enough</p></article><div>{text}</div>',
    }
    want = dict.fromkeys(range(1, 8), own) | {8: [own[2], *own]}
    frame = spark.createDataFrame([(k, f"http://h{k}/", x) for k, x in bodies.items()], "page_id bigint, url string, html string")
    assert {r.page_id: r.text.split("\n\n") for r in html_text.main_texts(frame).collect()} == want


def test_main_text_of_the_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {r.page_id: r.text for r in html_text.main_texts(pages).collect()}
    for row in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", row.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert texts[row.page_id] == "\n\n".join(x for x in blocks if x)


# ----- pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf_dir = str(tmp_path)
    docs.withColumn("rank", F.lit(1)).union(docs.limit(2).withColumn("rank", F.lit(2))).unionByName(spark.createDataFrame([(10**6, None, None, None, None, 1), (None, "", "en", "src0", 0, 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint, rank int")).write.parquet(f"{sf_dir}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{sf_dir}/labels.parquet")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, sf_dir)
        out.write.parquet(f"{sf_dir}/{k}")
        after = spark.read.parquet(f"{sf_dir}/{k}")
        if k < 4:
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in rows.select("doc_id").collect()}, name
        rows = after
    assert corpus_pipeline.run(spark, sf_dir).count() == rows.count() > 0
