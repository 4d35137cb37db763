"""Exact, near, line and passage deduplication against brute force on small tables with odd rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourceloom.llm import common, exactdup, linededup, neardup, substring

SCHEMA = "doc_id bigint, text string, keep_id string, hash int, node int, root int, place string"


def table(spark, rows):
    """(id, text) rows with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "y") for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# ----- exact ------------------------------------------------------------------------------------------------------

EXACT = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " \x0b\x0c"), (7, "ab "), (None, "zz"), (8, "z z"), (9, "x" * 200_000), (10, "x" * 200_000), (10, "x" * 200_000)]


def exact_by_hand(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[norm], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(spark, weak):
    """With a hash of two bits all groups collide, and the bytes decide."""
    hash_ = (lambda c: F.unhex(F.md5(c)).substr(1, 1)) if weak else common.digest128
    if weak:
        hash_ = lambda c: F.pmod(F.length(c), F.lit(2))
    got = exactdup.exact_duplicates(table(spark, EXACT), content_hash=hash_).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(exact_by_hand(EXACT), key=key)


def test_empty_tables(spark):
    none = table(spark, [])
    assert exactdup.exact_duplicates(none).count() == 0
    assert neardup.near_duplicates(none).count() == 0
    assert neardup.first_of_class(none).count() == 0
    assert linededup.dedup_lines(none).count() == 0
    assert substring.without_repeats(none).count() == 0


# ----- lines ------------------------------------------------------------------------------------------------------


def lines_by_hand(rows, least):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
    seen = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


LINES = [(1, "Home\nown 1\n\n"), (2, " home \nown 2\nHOME"), (3, "hoMe\t\nÉ"), (4, None), (5, ""), (6, "é\nhome\x0c"), (6, "é\nhome\x0c"), (None, "own 7\r\nÉ"), (8, "\n" * 1000 + "own 1"), (9, "É\n" * 3)]


@pytest.mark.parametrize("least", [2, 3, 5])
def test_line_dedup(spark, least):
    got = linededup.dedup_lines(table(spark, LINES), min_docs=least)
    assert got.columns[:2] == ["doc_id", "text"] and got.columns[2] == "keep_id"
    order = lambda x: tuple(map(str, x))
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=order)
    assert got == sorted(lines_by_hand(LINES, least), key=order)


def test_line_store_is_reversible(spark):
    first, second = (linededup.document_keys(table(spark, rows)) for rows in (LINES[:6], LINES[6:]))
    store = linededup.LineStore.empty(spark, min_docs=3, shards=3).insert(first)
    grown = store.insert(second)
    back = grown.delete(second)
    rows = lambda s: sorted(map(tuple, s.counts.select("high", "low", "refs").collect()))
    held = lambda s: sorted(tuple(r) for r in s.dropped_keys(first.union(second)).collect())
    assert rows(back) == rows(store) and held(back) == held(store)
    assert len(held(grown)) > len(held(store))
    whole = linededup.LineStore.empty(spark, min_docs=3, shards=3).insert(first.union(second))
    assert rows(grown) == rows(whole) and held(grown) == held(whole)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**62), 2**62, 40_000)
    shard = linededup.CuckooFilter()
    shard.insert(keys)
    assert len(shard.tables) > 1 and shard.may_hold(keys).all()
    assert shard.may_hold(rng.integers(-(2**62), 2**62, 20_000)).mean() < 0.01
    shard.delete(keys[:30_000])
    again = linededup.CuckooFilter(shard.blob())
    assert again.may_hold(keys[30_000:]).all() and again.may_hold(keys[:30_000]).mean() < 0.01


# ----- near -------------------------------------------------------------------------------------------------------


def near_by_hand(rows, threshold=0.8, level=0.01):
    shingles = {}
    for k, (_, t) in enumerate(rows):
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", t or "")]
        runs = [tuple(found[j : j + 5]) for j in range(len(found) - 4)] if len(found) >= 5 else [tuple(found)] if found else []
        shingles[k] = collections.Counter(runs)
    df = collections.Counter(s for c in shingles.values() for s in c)
    weight = {k: {s: n * (1 + math.log((1 + len(rows)) / (1 + max(df[s], level * len(rows))))) for s, n in c.items()} for k, c in shingles.items()}
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common_ = sum(min(w, weight[b].get(s, 0)) for s, w in weight[a].items())
            total = sum(weight[a].values()) + sum(weight[b].values()) - common_
            if (rows[a][1] or "") == (rows[b][1] or "") or total and common_ / total >= threshold:
                parent[find(a)] = find(b)
    classes = collections.defaultdict(list)
    for k in range(len(rows)):
        classes[find(k)].append(rows[k][0])
    return sorted(((rows[k][0], min((i for i in classes[find(k)] if i is not None), default=None), len(classes[find(k)])) for k in range(len(rows))), key=str)


def near_rows():
    rng = random.Random(5)
    rows = []
    for _ in range(25):
        base = words(rng, rng.randrange(40, 400))
        rows.append(base)
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, len(base) // 8])):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
            rows.append(copy)
    texts = [" ".join(r) for r in rows] + ["", None, "...", "one two", "One, two!", "one", "é É", "w " * 3000]
    rows = list(enumerate(texts, 1))
    return [*rows, (None, texts[0]), (3, texts[2]), (None, "all alone")]


def test_near_duplicates(spark):
    rows = near_rows()
    got = neardup.near_duplicates(table(spark, rows).repartition(3))
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got.collect()), key=str) == near_by_hand(rows)
    got = neardup.near_duplicates(table(spark, rows), settings=neardup.Settings(level=0.05))
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got.collect()), key=str) == near_by_hand(rows, level=0.05)
    first = neardup.first_of_class(table(spark, rows))
    want = {c for _, c, _ in near_by_hand(rows)}
    assert first.columns == table(spark, []).columns
    assert collections.Counter(r.doc_id for r in first.select("doc_id").collect()) == collections.Counter(want)


def test_large_group_of_near_copies(spark):
    """A chain of classes is found from few pairs: far fewer than all pairs of the group."""
    rng = random.Random(9)
    base = words(rng, 300)
    rows = []
    for k in range(120):
        copy = list(base)
        copy[rng.randrange(300)] = f"x{k}"
        rows.append((k, " ".join(copy)))
    got = neardup.near_duplicates(table(spark, rows)).collect()
    assert {r.class_id for r in got} == {0} and {r.class_size for r in got} == {120}


def test_pairs_of_a_group_of_copies_grow_with_its_texts(spark, monkeypatch):
    """Copies of one text, most of them less like each other than like it: the text is the centre, so few pairs are compared."""
    rng = random.Random(13)
    base = words(rng, 200)
    rows = [(0, " ".join(base))]
    for k in range(1, 160):
        copy = list(base)
        for j in rng.sample(range(200), rng.randrange(3, 9)):
            copy[j] = f"x{k}y{j}"
        rows.append((k, " ".join(copy)))
    rows += [(1000 + k, " ".join(words(rng, 200))) for k in range(40)]
    compared, linked = [], neardup._linked
    monkeypatch.setattr(neardup, "_linked", lambda pairs, *more: compared.append(pairs.count()) or linked(pairs, *more))
    got = neardup.near_duplicates(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=str) == near_by_hand(rows)
    assert sum(compared) < 3 * len(rows)


def test_pairs_hidden_in_a_large_bucket_of_unlike_pages(spark):
    """Pages on one template, 0.71 alike, with a few pairs of 0.81 among them."""
    rng = random.Random(11)
    base = words(rng, 80)

    def page(one, two):
        copy = list(base)
        copy[20], copy[66], copy[69] = one, two, two
        return " ".join(copy)

    rows = [(k, page(f"x{k}", f"y{k}")) for k in range(400)]
    rows += [(2000 + 2 * k + j, page(f"z{k}", f"v{k}x{j}")) for k in range(14) for j in range(2)]
    want = near_by_hand(rows, level=1.0)
    assert collections.Counter(n for _, _, n in want) == {1: 400, 2: 28}
    got = neardup.near_duplicates(table(spark, rows), settings=neardup.Settings(level=1.0))
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got.collect()), key=str) == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = common.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r.node: r.root for r in got.collect()} == {x: find(x) for x in parent}


# ----- passages ---------------------------------------------------------------------------------------------------


def passages_by_hand(rows, length):
    split = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, (_, t) in enumerate(rows)}
    order = lambda i: (i is None, i or 0)
    first = {}
    for k, w in split.items():
        for j in range(len(w) - length + 1):
            key = tuple(w[j : j + length])
            first[key] = min(first.get(key, order(rows[k][0])), order(rows[k][0]))
    out = []
    for k, w in split.items():
        gone = set()
        for j in range(len(w) - length + 1):
            if first[tuple(w[j : j + length])] < order(rows[k][0]):
                gone.update(range(j, j + length))
        out.append((rows[k][0], " ".join(x for j, x in enumerate(w) if j not in gone), len(w), len(gone)))
    return sorted(out, key=str)


def test_repeated_passages(spark):
    rng = random.Random(11)
    passages = [words(rng, n) for n in (10, 12, 13, 40, 90)]
    rows = []
    for k in range(60):
        text = []
        for _ in range(rng.randrange(5)):
            text += words(rng, rng.randrange(30)) + rng.choice(passages)[rng.randrange(4) :]
        rows.append((1000 - k, rng.choice([" ", "\n", " \t"]).join(text)))
    rows += [(2000, rows[0][1]), (2001, None), (2002, ""), (2003, "a " * 5000), (2004, "a " * 300), (2005, "Ä b " * 40), (2005, "Ä b " * 40), (None, rows[1][1])]
    got = substring.without_repeats(table(spark, rows).repartition(4), length=12, seed=5)
    assert got.columns == [*table(spark, []).columns, "n_words", "n_removed"]
    assert sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in got.collect()), key=str) == passages_by_hand(rows, 12)


def test_spans_name_their_source(spark):
    rng = random.Random(12)
    shared = words(rng, 40)
    rows = [(1, " ".join(words(rng, 7) + shared)), (2, " ".join(words(rng, 3) + shared + words(rng, 5)))]
    spans = substring.repeated_spans(substring.with_keys(table(spark, rows)), length=20, seed=6).collect()
    assert [(r.id, r.start, r.words, r.owner, r.owner_start) for r in spans] == [(2, 3, 40, 1, 7)]
