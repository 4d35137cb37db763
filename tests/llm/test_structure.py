"""Conversation repair, SentencePiece ids and the Merkle manifest, against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sourceloom.llm import dialogue, merkle, pieces, queries, ranks

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


# ----- places -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("tasks", [1, 7])
def test_places(spark, tasks):
    rng = random.Random(tasks)
    rows = [(rng.choice([None, "a", "b", "hot", "hot", "hot", "hot"]), rng.choice([None, *range(30)])) for _ in range(900)]
    rows += [("hot", 5)] * 300 + [(None, None)] * 40 + [("z", 1)]
    frame = spark.createDataFrame(rows, "g string, v int").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        got = [(r.g, r.place, r.v) for r in ranks.placed(frame, "g", [F.col("v").asc_nulls_first()]).collect()]
        assert ranks.placed(frame.limit(0), "g", []).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = []
    for g in {r[0] for r in rows}:
        values = sorted((r[1] for r in rows if r[0] == g), key=lambda v: (v is not None, v or 0))
        want += [(g, k, v) for k, v in enumerate(values)]
    assert sorted(got, key=str) == sorted(want, key=str)


# ----- conversations ----------------------------------------------------------------------------------------------


def damaged(rows):
    for conv, turn, role, text in rows:
        key = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if key == 0:
            continue
        if key == 1:
            text = ""
        if key == 2:
            text = re.sub("[.!?]", "", text)
        if key == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (2 if key == 3 else 1)


def faults(rows):
    """Initials and faults of one conversation's rows in order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "b" if not end else "d" if (role, text) in seen else "k" if end[-1] in ".!?" else "t"
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def cheapest(symbols):
    """(cost, audit, roles) by trying every sequence of edits, with up to two insertions in each gap."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    choices = []
    for initial, fault in symbols:
        options = [(4, "D", "")]
        if fault in "kt":
            more = 3 if fault == "t" else 0
            options += [(more, "K", initial or "?"), (3 + more, "R", "u"), (3 + more, "R", "a")]
        choices += [[(3 * len(g), "I" * len(g), g) for g in gaps], options]
    choices.append([(3 * len(g), "I" * len(g), g) for g in gaps])
    for edits in itertools.product(*choices):
        if re.fullmatch("(s?(ua)+)?", "".join(e[2] for e in edits)):
            found = (sum(e[0] for e in edits), "".join(e[1] for e in edits), edits)
            best = found if best is None or found[:2] < best[:2] else best
    return best


def test_weights_by_trying_all_edits():
    rng = random.Random(11)
    bits = 3 * 2 * 4
    for _ in range(150):
        symbols = [(rng.choice("suua-"), rng.choice("kkktbd")) for _ in range(rng.randrange(1, 4))]
        cost, audit, _ = cheapest([("?" if i == "-" else i, f) for i, f in symbols])
        weights = dialogue.segment_weights("".join(i + f for i, f in symbols), bits)[dialogue.START]
        found = [
            ((w >> bits) + 3 * dialogue.CLOSING[t], dialogue.letters(w & ((1 << bits) - 1), bits) + "I" * dialogue.CLOSING[t])
            for t, w in enumerate(weights)
            if w is not None
        ]
        assert min(found) == (cost, audit)


def by_graph(symbols):
    """(cost, audit) by a search over (rows done, state, letters), for long conversations."""
    level = {dialogue.START: (0, "")}
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    for initial, fault in symbols:
        wide = dict(level)
        for s, (cost, audit) in level.items():
            for r in "ua":
                t = moves.get((s, r))
                if t is not None:
                    wide.setdefault((t, "i"), (cost + 3, audit + "I"))
                    wide[t, "i"] = min(wide[t, "i"], (cost + 3, audit + "I"))
        after = {}
        for key, (cost, audit) in wide.items():
            s = key[0] if isinstance(key, tuple) else key
            options = [(s, 4, "D")]
            if fault in "kt":
                more = 3 if fault == "t" else 0
                options += [(moves[s, initial], more, "K")] if (s, initial) in moves else []
                options += [(moves[s, r], 3 + more, "R") for r in "ua" if (s, r) in moves]
            for t, more, letter in options:
                found = (cost + more, audit + letter)
                after[t] = min(after.get(t, found), found)
        level = after
    ends = [level[s] for s in (0, 3) if s in level] + [(c + 3, a + "I") for s, (c, a) in level.items() if s == 2]
    return min(ends)


def expected(rows):
    rows = list(rows)
    groups = {}
    for row in damaged(rows):
        groups.setdefault(row[0], []).append(row)
    out = {}
    for conv in {r[0] for r in rows}:
        found = sorted(groups.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        symbols = faults(found)
        turns = [r[1] for r in found if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[0] + b[0] for a, b in itertools.pairwise(symbols)]
        cost, audit = by_graph(symbols)
        lines, state, at = [], 0, 0
        for letter in audit:
            row = None if letter == "I" else found[at]
            at += letter != "I"
            if letter == "D":
                continue
            initial = row[2][0] if letter == "K" else {0: "u", 1: "u", 2: "a", 3: "u"}[state]
            role = row[2] if letter == "K" else {"u": "user", "a": "assistant"}[initial]
            state = {"s": 1, "u": 2, "a": 3}[initial]
            lines.append(f"{role}:{'' if row is None else row[3]}")
        count = lambda f: sum(x[1] == f for x in symbols)
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out[conv] = (gaps, count("b"), count("d"), count("t"), illegal, cost, audit, sha("\n".join(lines)))
    return out


def conversations(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for conv, n in sizes:
        for turn in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""])
            text = rng.choice(["Yes.", "No!", "Why?  ", "cut off", "", None, " \n", f"x{turn}.", f"é{turn}?\t", "a.b"])
            rows.append((conv, rng.choice([turn, turn, turn, turn // 2, None]), role, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment", [2, 128])
def test_repair_of_conversations(spark, tmp_path, monkeypatch, segment):
    """Segments of two rows and of the usual size give the repairs of a search that knows no segments."""
    monkeypatch.setattr(dialogue, "SEGMENT", segment)
    rows = conversations(segment, [(None, 7), *((k, k % 9) for k in range(60)), (1000, 300)])
    folder = written(spark, tmp_path, "conversations", [(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, place string")
    got = {r.conv_id: r for r in queries.op11_conversation_repair(spark, folder).collect()}
    want = expected(rows)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert {k: tuple(r[n] for n in names) for k, r in got.items()} == want
    assert re.fullmatch("[DIKR]+", want[1000][6]) and len(want) == 55


def test_search_over_long_conversations_is_that_over_all_edits():
    rng = random.Random(3)
    for _ in range(60):
        symbols = [(rng.choice("suua?"), rng.choice("kkktbd")) for _ in range(rng.randrange(0, 4))]
        assert by_graph(symbols) == cheapest(symbols)[:2]


def test_repair_of_no_conversations(spark, tmp_path):
    folder = written(spark, tmp_path, "conversations", [], "conv_id bigint, turn bigint, role string, text string")
    assert queries.op11_conversation_repair(spark, folder).count() == 0


# ----- SentencePiece ----------------------------------------------------------------------------------------------


def piece_texts():
    rng = random.Random(12)
    signs = list(" \n\t▁aeé.,<>/_0") + ["  ", "the", " of", "<s>", "</s>", "　", "﻿", "🙂", "<0x0A>", "\x00", "\r\n", " \n ", "▁▁"]
    made = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    return [None, "", " ", "\n", "▁", "  a", "a ", "x" * 3000, "word " * 4000, *made, *made[:20]]


@pytest.mark.parametrize("limit", [1, 50, 1 << 18])
def test_pieces_are_those_of_the_library(spark, limit, monkeypatch):
    monkeypatch.setattr(pieces, "TASK_CHUNKS", 40)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = piece_texts()
    frame = spark.createDataFrame([(k, t, "i") for k, t in enumerate(texts)], "doc_id int, text string, ids string").repartition(3)
    ids = pieces.encoded(frame, MODEL, limit=limit)
    assert ids.columns == ["doc_id", "ids"]
    got = {r.doc_id: (r.ids, r.text) for r in pieces.decoded(ids, MODEL).collect()}
    for k, text in enumerate(texts):
        want = library.encode(text or "", add_eos=True)
        assert got[k] == (want, library.decode(want)), text


def test_piece_query(spark, tmp_path):
    texts = piece_texts()
    folder = written(spark, tmp_path, "documents", [(k // 2, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for k, text in enumerate(texts):
        ids = library.encode(text or "", add_eos=True)
        want.append((k // 2, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    out = queries.op12_sentencepiece(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_whole_texts_where_chunks_are_not_shown_apart():
    segmenter = pieces.Segmenter(MODEL)
    assert segmenter.splits and segmenter.chunks(b"a  b\nc") == [b" a", b"  b", b"\nc"]
    segmenter.splits = False
    assert segmenter.ids(segmenter.chunks(b"a  b\nc")) == [segmenter.library.encode("a  b\nc")]


def test_no_pieces(spark):
    none = spark.createDataFrame([], "doc_id int, text string")
    assert pieces.decoded(pieces.encoded(none, MODEL), MODEL).count() == 0


# ----- Merkle manifest --------------------------------------------------------------------------------------------


def tree(leaves, fanout=3):
    """(root, siblings of each leaf from below) by building every level."""
    paths = [[] for _ in leaves]
    at, nodes = list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k in range(len(leaves)):
            first = at[k] // fanout * fanout
            run = nodes[first : first + fanout]
            paths[k].append((run[: at[k] - first], run[at[k] - first + 1 :]))
            at[k] //= fanout
        nodes = [sha("".join(nodes[f : f + fanout])) for f in range(0, len(nodes), fanout)]
    return nodes[0], paths


def manifest_rows(docs):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda doc, text: sha("".join(map(field, (doc[0], doc[3], doc[2], doc[4], text))))
    groups = {}
    for doc in docs:
        text = doc[1].replace("\n", "") if doc[1] and doc[0] is not None and zlib.crc32(str(doc[0]).encode()) % 2 == 0 else doc[1]
        groups.setdefault(doc[3], []).append((doc[0], leaf(doc, doc[1]), leaf(doc, text)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    below = {}
    for source in order:
        groups[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        below[source] = tree([r[1] for r in groups[source]])
    root, tops = tree([below[s][0] for s in order])
    out = []
    for source, top in zip(order, tops, strict=True):
        for (doc_id, own, found), path in zip(groups[source], below[source][1], strict=True):
            proof, node = [], found
            for left, right in path + top:
                proof += left + right
                node = sha("".join([*left, node, *right]))
            out.append((doc_id, own, below[source][0], root, sha("".join(proof)), node, node == root))
    return out


@pytest.mark.parametrize("levels", [1, 2, 6])
@pytest.mark.parametrize("sizes", [[1], [3], [2, 9, 1], [1, 28, 5, 82, 4], [244], [3] * 11])
def test_manifest(spark, tmp_path, monkeypatch, levels, sizes):
    rng = random.Random(levels)
    docs, k = [], 0
    for g, n in enumerate(sizes):
        for _ in range(n):
            docs.append((k if rng.random() > 0.1 else None, rng.choice([None, "", "a\nb", f"é {k}\n"]), rng.choice([None, "en"]), [None, "", "b", "ü", "a"][g] if len(sizes) < 9 else f"s{g}", k))
            k += 1
    docs += docs[:2]
    if levels != 6:
        whole = merkle.manifest
        monkeypatch.setattr(merkle, "manifest", lambda *a, **o: whole(*a, **o, levels=levels))
    folder = written(spark, tmp_path, "documents", [(*d, "x") for d in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string")
    out = queries.op13_merkle_manifest(spark, folder)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(manifest_rows(docs), key=str)


def test_no_manifest(spark, tmp_path):
    folder = written(spark, tmp_path, "documents", [], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert queries.op13_merkle_manifest(spark, folder).count() == 0


def test_proofs_fold_to_the_root(spark):
    rows = spark.createDataFrame([(k, f"g{k % 4}", f"t{k}") for k in range(50)], "i int, g string, t string")
    for r in merkle.manifest(rows, ["i", "t"], "g", "i", fanout=2, levels=2).collect():
        assert merkle.fold(r.leaf, [(s.before, s.after) for s in r.proof]) == r.root == r.folded
