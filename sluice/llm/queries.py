"""The operators' queries over whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe, decontaminate, divergence, embed_dedup, line_dedup, quality, simhash, substring_dedup, token_rollup, toxicity, url_filter, vector_codes, warc
from sluice.llm.shared import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The place of the public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_groups(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), distance=4)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), width=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counter = token_rollup.tiktoken_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ledger = token_rollup.refresh(spark, fresh_path(spark, "tokens"), table(spark, sf_dir, "documents"), counter, "byte_bpe_50k")
    return ledger.totals()


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.grades_of(table(spark, sf_dir, "labels")), sample=8192)
    return toxicity.score(docs, model)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), vocabulary()))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), sample=2048)
    return quality.judge(docs, model, threshold=0.5).drop("probability")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return found.withColumn("code", F.lower(F.hex("code")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), least=10, top=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_url_filter": op7_url_filter,
    "op8_line_dedup": op8_line_dedup,
    "op9_warc": op9_warc,
    "op10_bpe": op10_bpe,
    "op11_quality_rules": op11_quality_rules,
    "op12_vector_codes": op12_vector_codes,
    "op13_source_divergence": op13_source_divergence,
}


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """SQL for op12: each round's codebooks from those of the round before. Parts of the vectors are lists."""
    square = "list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    assign = "{name} AS MATERIALIZED (SELECT id, part, x, min((far, entry)) AS best FROM (SELECT id, pieces.part, x, entry, " + square + " AS far FROM pieces JOIN {books} USING (part)) GROUP BY id, part, x)"
    steps = [
        f"whole AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)::BIGINT) AS w FROM embeddings WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda v: v IS NOT NULL AND isfinite(v))))",
        "rows AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST) AS id FROM whole)",
        f"pieces AS MATERIALIZED (SELECT id, part, w[part * len(w) // {parts} + 1 : (part + 1) * len(w) // {parts}] AS x FROM rows, (SELECT unnest(range({parts})) AS part))",
        f"books0 AS MATERIALIZED (SELECT part, id - 1 AS entry, x AS e FROM pieces WHERE id <= {entries})",
    ]
    for k in range(rounds):
        steps += [
            assign.format(name=f"near{k}", books=f"books{k}"),
            f"sums{k} AS (SELECT part, best[2] AS entry, place, sum(v) AS s, count(*) AS c FROM (SELECT part, best, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM near{k}) GROUP BY ALL)",
            f"means{k} AS (SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY place)::BIGINT[] AS e FROM sums{k} GROUP BY part, entry)",
            f"books{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(means{k}.e, books{k}.e) AS e FROM books{k} LEFT JOIN means{k} USING (part, entry))",
        ]
    steps += [
        assign.format(name="last", books=f"books{rounds}"),
        "coded AS (SELECT id, string_agg(printf('%02x', best[2]), '' ORDER BY part) AS code, sum(best[1])::BIGINT AS error FROM last GROUP BY id)",
        f"told AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books{rounds})",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN rows USING (id), told"


ORACLES: dict[str, str] = {
    "op12_vector_codes": vector_codes_sql(),
    "op13_source_divergence": r"""
        WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents)
        , words AS (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs)
        , kept AS MATERIALIZED (SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10)
        , counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL)
        , langs AS (SELECT lang, count(*) AS v, sum(c) AS total FROM kept GROUP BY lang)
        , sizes AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source)
        , groups AS (SELECT DISTINCT lang, source FROM docs)
        , shares AS MATERIALIZED (
            SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (coalesce(s.total, 0) + 2 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.c + 2)) // (l.total + 2 * l.v) AS q
            FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
            LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term)
        , pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL)
        , found AS (
            SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
            FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 10
    """,
    "op1_embedding_dedup": """
        WITH RECURSIVE vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)
        , links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93)
        , reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        , lowest AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
        , counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM lowest LEFT JOIN counted USING (vec_id)
    """,
    "op3_substring_dedup": r"""
        WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)
        , each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split)
        , windows AS (
            SELECT doc_id, i, word, CASE WHEN count(*) OVER ahead = 13 THEN array_to_string(list(word) OVER ahead, ' ') END AS w
            FROM each WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING))
        , firsts AS (SELECT w, min(doc_id) AS first FROM windows WHERE w IS NOT NULL GROUP BY w)
        , covered AS (
            SELECT doc_id, i, word, coalesce(bool_or(first < doc_id) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone
            FROM windows LEFT JOIN firsts USING (w))
        , kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS text FROM covered GROUP BY doc_id)
        SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM split LEFT JOIN kept USING (doc_id)
    """,
    "op8_line_dedup": r"""
        WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
        , parsed AS (
            SELECT doc_id, pos, list_transform(list_filter(regexp_split_to_array(line, '[ \t\x0B\f\r]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9@]|://') THEN '<*>' ELSE x END) AS w
            FROM lines)
        , leaves AS (SELECT len(w) AS n, w[1:3] AS lead FROM parsed WHERE len(w) > 0 GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 8)
        , forms AS (SELECT doc_id, pos, w, n, lead FROM parsed JOIN leaves ON len(w) = n AND w[1:3] = lead)
        , places AS (SELECT n, lead, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM (SELECT DISTINCT n, lead, w FROM forms))
        , words AS (SELECT n, lead, k, word, count(*) AS c FROM places WHERE k > 3 GROUP BY n, lead, k, word)
        , several AS (
            SELECT n, lead, map(list(k), list(major)) AS open
            FROM (SELECT n, lead, k, CASE WHEN 2 * max(c) > sum(c) THEN arg_max(word, c) ELSE '' END AS major FROM words GROUP BY n, lead, k HAVING count(*) > 8) GROUP BY n, lead)
        , closed AS (
            SELECT doc_id, pos, n, lead, w, CASE WHEN open IS NULL THEN w ELSE list_transform(w, lambda x, i: CASE WHEN open[i] IS NOT NULL AND open[i] <> x THEN '<*>' ELSE x END) END AS c
            FROM forms LEFT JOIN several USING (n, lead))
        , counted AS (SELECT *, len(list_filter(c, lambda x: x <> '<*>')) AS fixed, len(list_filter(c[4:], lambda x: x <> '<*>')) AS after FROM closed)
        , told AS (SELECT *, 2 * fixed >= n AND (c = w OR 2 * after > n - 3) AS general FROM counted WHERE fixed > 0)
        , templates AS (SELECT doc_id, pos, n, lead, general, CASE WHEN general THEN c ELSE w END AS template FROM told)
        , recurring AS (SELECT n, lead, general, template, min(doc_id) AS first FROM templates GROUP BY ALL HAVING count(DISTINCT doc_id) >= 8)
        , long AS (SELECT doc_id, pos, list_filter(regexp_split_to_array(line, '[ \t\x0B\f\r]+'), lambda x: x <> '') AS w FROM lines)
        , copies AS (SELECT w, min(doc_id) AS first FROM long WHERE len(w) >= 20 GROUP BY w HAVING count(DISTINCT doc_id) >= 2)
        , gone AS (
            SELECT doc_id, pos FROM templates JOIN recurring USING (n, lead, general, template) WHERE doc_id <> first
            UNION SELECT doc_id, pos FROM long JOIN copies USING (w) WHERE doc_id <> first)
        , kept AS (
            SELECT doc_id, count(*) AS n_lines, count(gone.pos) AS n_dropped, string_agg(line, chr(10) ORDER BY lines.pos) FILTER (gone.pos IS NULL) AS text
            FROM lines LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
    """,
    "op9_warc": """
        WITH payloads AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages)
        , judged AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response FROM payloads)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> response THEN response END AS refers_to FROM judged
    """,
    "op7_url_filter": """
        WITH parts AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages)
        , judged AS (
            SELECT page_id, host, path,
                   CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
            FROM parts)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
    """,
}
