"""The operators as named queries over the driver tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm import dialogue, exactdup, html_text, linededup, merkle, mixing, neardup, packing, pieces, substring, topk, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    index = warc.write_archive(table(spark, sf_dir, "pages"), folder, least=0)
    return warc.read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(table(spark, sf_dir, "documents"))


#: Target weights of the domains (the numbers of the sources, in four groups) and languages; sources weigh the same.
DOMAINS = ("web", "books", "code", "reference")
MIX = mixing.Mix(
    domains={"web": 0.4, "books": 0.3, "code": 0.2, "reference": 0.1},
    languages={"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
    max_epochs=2,
    seed=20240601,
)


def domain_of_source() -> Column:
    group = F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d+)$", 1).try_cast("int") % len(DOMAINS)
    return F.coalesce(F.element_at(F.array(*map(F.lit, DOMAINS)), group + 1), F.lit(DOMAINS[0]))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mixed_documents(docs, MIX, domain_of_source()).select("doc_id", "epoch", "domain", "lang", "source", "tokens")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.scored(docs, model)
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        F.size("toxic_passages").alias("n_passages"),
    )


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.main_texts(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = substring.without_repeats(docs, length=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.dedup_lines(docs, min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults by the hash of (conv_id, turn): rows lost, emptied, cut short, repeated or of a wrong role."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(name) % 20
    text = F.coalesce("text", space)
    return rows.where(fault != 0).select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ordered = dialogue.ordered(damaged(rows))
    plans = dialogue.plan(ordered)
    report = dialogue.repair_report(plans)
    hashes = dialogue.digests(dialogue.repaired(ordered, plans)).withColumnRenamed("conv", "of")
    ids = rows.select("conv_id").distinct()
    found = ids.join(report, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    ids = ids.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"))
    texts = pieces.decoded(ids, model)
    return texts.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    text = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    proven = merkle.manifest(docs, columns, group_col="source", id_col="doc_id", fanout=3, tampered=[*map(F.col, columns[:-1]), text])
    return proven.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        merkle.proof_hash(F.col("proof")).alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_top_k": op2_top_k,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing": op5_mixing,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_toxicity": op7_toxicity,
    "op8_html_text": op8_html_text,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def crc32_sql(text: str) -> str:
    """DuckDB expression for the unsigned crc32 of an ASCII text: eight shifts for each character."""
    codes = f"list_transform(regexp_extract_all({text}, '.'), lambda x: ord(x)::BIGINT)"
    byte = "list_reduce(list_prepend(xor(c, x), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, x: {byte}), 4294967295::BIGINT)"


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


SQL: dict[str, str] = {
    "op2_top_k": r"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS values FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.values, c.values)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.values) = len(c.values) WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
""",
    "op4_exact_dedup": r"""
WITH t AS (
    SELECT doc_id, length(coalesce(text, '')) AS points,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
    FROM documents
), k AS (
    SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
           first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS keep_id
    FROM t
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM k
""",
    "op5_mixing": r"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, lang AS lang0, source AS source0,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens,
           coalesce(['web', 'books', 'code', 'reference'][try_cast(regexp_extract(coalesce(source, ''), '(\d+)$', 1) AS INTEGER) % 4 + 1], 'web') AS domain
    FROM documents
), leaves AS (
    SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0
), l1 AS (
    SELECT domain, sum(tokens) * 2 AS cap, any_value(CASE domain WHEN 'web' THEN 0.4 WHEN 'books' THEN 0.3 WHEN 'code' THEN 0.2 ELSE 0.1 END)::DOUBLE AS w,
           (SELECT sum(tokens) FROM leaves)::DOUBLE AS up FROM leaves GROUP BY domain
), b1 AS (
    SELECT domain, least(cap::DOUBLE, w * max(lev) OVER ()) AS budget FROM (
        SELECT *, (up - (sum(cap) OVER o - cap)) / sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
        FROM l1 WINDOW o AS (ORDER BY cap / w, domain ROWS UNBOUNDED PRECEDING))
), l2 AS (
    SELECT domain, lang, sum(tokens) * 2 AS cap, any_value(CASE lang WHEN 'en' THEN 0.55 WHEN 'de' THEN 0.15 WHEN 'fr' THEN 0.15 WHEN 'es' THEN 0.15 ELSE 1 END)::DOUBLE AS w,
           any_value(budget) AS up FROM leaves JOIN b1 USING (domain) GROUP BY domain, lang
), b2 AS (
    SELECT domain, lang, least(cap::DOUBLE, w * max(lev) OVER (PARTITION BY domain)) AS budget FROM (
        SELECT *, (up - (sum(cap) OVER o - cap)) / sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
        FROM l2 WINDOW o AS (PARTITION BY domain ORDER BY cap / w, lang ROWS UNBOUNDED PRECEDING))
), l3 AS (
    SELECT domain, lang, source, tokens, tokens * 2 AS cap, 1.0::DOUBLE AS w, budget AS up FROM leaves JOIN b2 USING (domain, lang)
), b3 AS (
    SELECT domain, lang, source, tokens, floor(least(cap::DOUBLE, w * max(lev) OVER (PARTITION BY domain, lang)) + 1e-6)::BIGINT AS budget FROM (
        SELECT *, (up - (sum(cap) OVER o - cap)) / sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
        FROM l3 WINDOW o AS (PARTITION BY domain, lang ORDER BY cap / w, source ROWS UNBOUNDED PRECEDING))
), plan AS (
    SELECT domain, lang, source, budget // tokens AS whole, budget % tokens AS rest FROM b3
), each AS (
    SELECT d.*, whole, rest, sum(d.tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('20240601:' || whole || ':' || coalesce(doc_id::VARCHAR, '')), doc_id) AS upto
    FROM d JOIN plan USING (domain, lang, source)
)
SELECT doc_id, unnest(range(0, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS epoch, domain, lang0 AS lang, source0 AS source, tokens
FROM each
""",
    "op9_substring_dedup": r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT doc_id, p, array_to_string(words[p:p + 49], ' ') AS win
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS p FROM w WHERE len(words) >= 50)
), owned AS (
    SELECT doc_id, p, min(doc_id) OVER (PARTITION BY win) AS owner FROM windows
), hit AS (
    SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM owned WHERE owner < doc_id
), each AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w
), kept AS (
    SELECT each.doc_id, count(*) FILTER (hit.p IS NOT NULL) AS n_removed,
           string_agg(word, ' ' ORDER BY each.p) FILTER (hit.p IS NULL) AS text
    FROM each LEFT JOIN hit ON each.doc_id = hit.doc_id AND each.p = hit.p GROUP BY each.doc_id
)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
""",
    "op10_line_dedup": r"""
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
    FROM documents
), k AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM l
), often AS (
    SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
    SELECT k.*, often.key IS NOT NULL AS gone FROM k LEFT JOIN often ON k.key = often.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op11_conversation_repair": rf"""
WITH RECURSIVE d AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
           CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
           unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
    FROM (SELECT *, {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fault FROM conversations) WHERE fault <> 0
), o AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS place, left(role, 1) AS initial,
           right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS last
    FROM d
), f AS (
    SELECT *, lag(initial) OVER w AS before, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv,
           CASE WHEN last = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'd'
                WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault
    FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY place)
), moves(state, initial, follows, role) AS (
    VALUES (0, 's', 1, NULL), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (3, 'u', 2, 'user'), (2, 'a', 3, 'assistant')
), best AS (
    SELECT conv, 0::BIGINT AS place, 0 AS state, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}} AS w FROM f GROUP BY conv
    UNION ALL
    SELECT conv, place, state, min(w) FROM (
        SELECT f.conv, f.place, e.state,
               {{'cost': b.w.cost + e.cost + CASE WHEN f.fault = 't' AND e.letter <> 'D' THEN 3 ELSE 0 END, 'audit': b.w.audit || e.letter,
                 'lines': CASE e.letter WHEN 'D' THEN b.w.lines ELSE list_append(b.w.lines, coalesce(e.role, f.role) || ':' || f.text) END}} AS w
        FROM (
            SELECT conv, place, state, w FROM best
            UNION ALL
            SELECT conv, place, follows, {{'cost': w.cost + 3, 'audit': w.audit || 'I', 'lines': list_append(w.lines, role || ':')}}
            FROM best JOIN moves ON best.state = moves.state WHERE role IS NOT NULL
        ) b JOIN f ON f.conv = b.conv AND f.place = b.place + 1
        JOIN (
            SELECT state AS since, state, 'D' AS letter, 4 AS cost, NULL AS role, NULL AS initial FROM range(4) t(state)
            UNION ALL SELECT state, follows, 'K', 0, NULL, initial FROM moves
            UNION ALL SELECT state, follows, 'R', 3, role, NULL FROM moves WHERE role IS NOT NULL
        ) e ON e.since = b.state AND (e.letter = 'D' OR f.fault IN ('k', 't')) AND (e.initial IS NULL OR e.initial = f.initial)
    ) GROUP BY conv, place, state
), done AS (
    SELECT b.conv, min(CASE WHEN state = 2 THEN {{'cost': w.cost + 3, 'audit': w.audit || 'I', 'lines': list_append(w.lines, 'assistant:')}} ELSE w END) AS w
    FROM best b JOIN (SELECT conv, max(place) AS n FROM f GROUP BY conv) z ON b.conv = z.conv AND b.place = z.n WHERE state <> 1 GROUP BY b.conv
), report AS (
    SELECT conv_id, any_value(conv) AS conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
           count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
           count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM f GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(w.cost, 0) AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN report ON c.conv_id IS NOT DISTINCT FROM report.conv_id LEFT JOIN done ON report.conv = done.conv
""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, sha256({" || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
           sha256({" || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars")))} || {_field_sql("CASE WHEN " + crc32_sql("doc_id::VARCHAR") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS found
    FROM documents
), l AS (
    SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
    FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)
), low AS (
    SELECT tree, 0 AS level, place, n, leaf AS node FROM l
    UNION ALL
    SELECT tree, level + 1, place // 3, (any_value(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY place))
    FROM low WHERE n > 1 GROUP BY tree, level, place // 3
), sub AS (
    SELECT tree, max(level) AS height, arg_max(node, level) AS subroot FROM low GROUP BY tree
), top AS (
    SELECT 0 AS level, tree AS place, (SELECT count(*) FROM sub) AS n, subroot AS node FROM sub
    UNION ALL
    SELECT level + 1, place // 3, (any_value(n) + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY level, place // 3
), steps AS (
    SELECT l.tree, l.place, low.level AS level,
           coalesce(string_agg(low.node, '' ORDER BY low.place) FILTER (low.place < l.place // (3 ** low.level)::BIGINT), '') AS before,
           coalesce(string_agg(low.node, '' ORDER BY low.place) FILTER (low.place > l.place // (3 ** low.level)::BIGINT), '') AS after
    FROM l JOIN low ON l.tree = low.tree AND low.n > 1 AND low.place // 3 = l.place // (3 ** (low.level + 1))::BIGINT
    GROUP BY l.tree, l.place, low.level
), upper AS (
    SELECT sub.tree, sub.height + top.level AS level,
           coalesce(string_agg(top.node, '' ORDER BY top.place) FILTER (top.place < sub.tree // (3 ** top.level)::BIGINT), '') AS before,
           coalesce(string_agg(top.node, '' ORDER BY top.place) FILTER (top.place > sub.tree // (3 ** top.level)::BIGINT), '') AS after
    FROM sub JOIN top ON top.n > 1 AND top.place // 3 = sub.tree // (3 ** (top.level + 1))::BIGINT
    GROUP BY sub.tree, sub.height, top.level
), path AS (
    SELECT * FROM steps UNION ALL
    SELECT l.tree, l.place, level, before, after FROM l JOIN upper ON l.tree = upper.tree
), fold AS (
    SELECT tree, place, 0 AS level, found AS node FROM l
    UNION ALL
    SELECT fold.tree, fold.place, fold.level + 1, sha256(before || node || after)
    FROM fold JOIN path ON fold.tree = path.tree AND fold.place = path.place AND fold.level = path.level
), folded AS (
    SELECT tree, place, arg_max(node, level) AS folded_root FROM fold GROUP BY tree, place
), proof AS (
    SELECT tree, place, sha256(string_agg(before || after, '' ORDER BY level)) AS proof_sha256 FROM path GROUP BY tree, place
)
SELECT l.doc_id, l.leaf, subroot, (SELECT arg_max(node, level) FROM top) AS root,
       coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = (SELECT arg_max(node, level) FROM top) AS verified
FROM l JOIN sub ON l.tree = sub.tree JOIN folded ON l.tree = folded.tree AND l.place = folded.place
LEFT JOIN proof ON l.tree = proof.tree AND l.place = proof.place
""",
}
