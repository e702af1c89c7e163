"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetables.llm import chat, classifier, decontaminate, linededup, middle, neardup, packing, pii, spelling, styletree, warc
from pagetables.llm.common import shared_dir, table
from pagetables.llm.repetition import quality_rules
from pagetables.llm.tokengroups import similar_sets


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("id").alias("doc_id"), "class_id")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = chat.format_chat(turns)
    back = formatted.select(
        "conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"),
        chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select(
        "row.doc_id", "row.text", F.col("n_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.col("removed").cast("array<struct<line:int,of_doc:long,of_line:int>>").alias("removed"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_matches(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]).select(
        "row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_warc(warc.with_revisits(table(spark, sf_dir, "pages")), shared_dir(spark, "warc"))
    records = warc.read_warc(archives, int(spark.conf.get("spark.sql.shuffle.partitions")), payloads=False)
    number = r"^<urn:page:(-?\d+)>$"
    return records.select(
        F.regexp_extract("record_id", number, 1).try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.regexp_extract("refers_to", number, 1).try_cast("long").alias("refers_to"), "error")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styletree.main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select(
        "row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.pagetables.surrogateKey", "a key for tests only").encode()
    return pii.replace_entities(table(spark, sf_dir, "documents"), key, keep=["doc_id"]).select(
        "row.doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "gram_chars", "dup_line_chars")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_warc": op6_warc,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_html_extraction": op8_html_extraction,
    "op9_pii": op9_pii,
    "op10_quality_rules": op10_quality_rules,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
}



def _crc_step() -> str:
    """SQL for the CRC-32 register c after byte b: the polynomial's remainder of each bit, put together."""
    def remainder(c: int) -> int:
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        return c
    step = "c >> 8"
    for bit in range(8):
        step = f"xor({step}, ((xor(c, b) >> {bit}) & 1) * {remainder(1 << bit)})"
    return step


ORACLES: dict[str, str] = {
    "op3_chat_formatting": r"""
        WITH turns AS (
            SELECT conv_id, turn, role, text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        filled AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM turns)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11)::BIGINT AS formatted_chars
        FROM filled GROUP BY conv_id""",
    "op6_warc": """
        WITH sized AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        firsts AS (
            SELECT payload_digest, min(page_id) AS first FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN first <> page_id THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error
        FROM sized LEFT JOIN firsts USING (payload_digest)""",
    # the frame of these pages is known: the main text is what stands in the article element
    "op8_html_extraction": r"""
        WITH article AS (
            SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '<[^<>]*$', '') AS inner_html
            FROM pages),
        pieces AS (
            SELECT page_id, url, list_transform(
                regexp_split_to_array(replace(inner_html, '<br>', ' '), '</?(?:p|h1)>'),
                lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', '', 'g'),
                    '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks
            FROM article),
        joined AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM pieces)
        SELECT page_id, url, text, length(text) AS n_chars FROM joined""",
    "op11_fill_in_middle": r"""
        WITH whole AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS digest,
                regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents),
        drawn AS (
            SELECT doc_id, text, units, len(units) AS n, ('0x' || digest[1:8])::BIGINT % (len(units) + 1) AS a,
                ('0x' || digest[9:16])::BIGINT % (len(units) + 1) AS b,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                    WHEN ('0x' || digest[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM whole),
        parts AS (
            SELECT doc_id, text, n, form, array_to_string(units[1:least(a, b)], '') AS p,
                array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m,
                array_to_string(units[greatest(a, b) + 1:], '') AS s FROM drawn)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
        FROM parts""",
    "op12_spelling_variants": rf"""
        WITH RECURSIVE runs AS (
            SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
        counted AS (SELECT id, run, count(*) AS times, hex(encode(id || ':' || run)) AS h FROM runs GROUP BY id, run),
        summed AS (
            SELECT run, times, xor(4294967295, list_reduce(
                list_transform(range(1, length(h), 2), lambda k: ('0x' || substr(h, k, 2))::BIGINT), lambda c, b: {_crc_step()}, 4294967295::BIGINT)) AS crc
            FROM counted),
        made AS (
            SELECT CASE WHEN crc % 199 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, times
            FROM summed),
        words AS MATERIALIZED (
            SELECT word, sum(times)::BIGINT AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
        shorter AS (
            SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS left_over
            FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
        near AS (
            SELECT a.word, b.word AS other FROM shorter a JOIN shorter b ON a.i = b.i AND a.left_over = b.left_over AND a.word <> b.word
            UNION SELECT shorter.word, words.word FROM shorter JOIN words ON left_over = words.word
            UNION SELECT words.word, shorter.word FROM shorter JOIN words ON left_over = words.word),
        ordered AS (
            SELECT near.word, other, a.n, b.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
                row_number() OVER (PARTITION BY near.word ORDER BY b.n DESC, other) AS place
            FROM near JOIN words a ON near.word = a.word JOIN words b ON other = b.word),
        best AS MATERIALIZED (
            SELECT word, n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
            FROM ordered WHERE place = 1),
        walk AS (
            SELECT word, form AS root FROM best WHERE form IS NOT NULL
            UNION ALL SELECT walk.word, form FROM walk JOIN best ON root = best.word WHERE form IS NOT NULL),
        roots AS (SELECT walk.word, root FROM walk LEFT JOIN best ON root = best.word WHERE form IS NULL)
        SELECT words.word, form, coalesce(root, words.word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
        FROM words LEFT JOIN best ON words.word = best.word LEFT JOIN roots ON words.word = roots.word""",
    "op13_ngram_jaccard_join": r"""
        WITH RECURSIVE split AS (
            SELECT doc_id, coalesce(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
        sets AS MATERIALIZED (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle FROM split),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        linked AS MATERIALIZED (
            SELECT a.doc_id AS x, b.doc_id AS y FROM sets a JOIN sets b USING (shingle)
            JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 85 * (m.n + n.n - count(*))),
        reach AS (SELECT x, y FROM linked UNION SELECT reach.x, linked.y FROM reach JOIN linked ON reach.y = linked.x),
        least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
        SELECT split.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, split.doc_id) AS component_id
        FROM split LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON split.doc_id = x""",
}
