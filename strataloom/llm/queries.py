"""The thin queries opN_<name> over whole tables, and SQL with the same results where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import chat_format, exact_dedup, html_extraction, language_id, line_dedup, merkle, minhash, packing, piece_tokens, quality_rules, secret_scan, spelling, suffix_dedup
from strataloom.llm.common import table


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files lie on this machine; every executor has them at the same place."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_tokens.encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lr_score")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(table(spark, sf_dir, "documents"), windows=True)
    return rows.select("doc_id", "text", "n_lines", "n_removed_lines")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_format(table(spark, sf_dir, "conversations"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_language_id": op2_language_id,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_piece_tokens": op4_piece_tokens,
    "op5_quality_rules": op5_quality_rules,
    "op6_minhash": op6_minhash,
    "op7_line_dedup": op7_line_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_secret_scan": op11_secret_scan,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_merkle_manifest": op13_merkle_manifest,
}

CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""


def crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a text with characters up to U+00FF; needs CRC_TABLE and its column t."""
    letters = f"list_transform(string_split({text}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 | (unicode(x) >> 6), 128 | (unicode(x) & 63)] END)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(flatten({letters}), lambda b: b::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


ORACLE_SQL = {
    "op9_chat_format": r"""
        WITH rows AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
        pos AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM rows),
        pre AS (SELECT conv_id, k, count(*) OVER (PARTITION BY conv_id) AS n,
                       list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY k) AS said FROM pos),
        full_ AS (SELECT n, said, min(conv_id) AS conv_id FROM pre WHERE k = n GROUP BY n, said),
        kept AS (SELECT conv_id FROM full_ f
                 WHERE NOT EXISTS (SELECT 1 FROM pre p WHERE p.k = f.n AND p.n > f.n AND p.said = f.said))
        SELECT conv_id, CAST((k - 1) // 512 AS INTEGER) AS part, count(*) AS n_turns,
               string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY k) AS text
        FROM pos JOIN kept USING (conv_id) GROUP BY conv_id, (k - 1) // 512""",
    "op8_exact_dedup": r"""
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(n) AS text_sha256
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
        WINDOW g AS (PARTITION BY n)""",
    "op12_spelling_variants": rf"""
        WITH {CRC_TABLE},
        runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{7,}}')) AS run FROM documents),
        often AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
        hashed AS (SELECT run, k, {crc32("concat(doc_id, ':', run)")} AS h FROM often, crc_table),
        words AS (SELECT CASE WHEN h % 31 = 0 THEN run[: CAST(h % length(run) AS INTEGER)] || run[CAST(h % length(run) AS INTEGER) + 2 :] ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n
                  FROM hashed GROUP BY 1 HAVING sum(k) >= 2 AND length(word) >= 7),
        cuts AS (SELECT word, n, k, word[: k - 1] || word[k + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
        near AS (SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
                 UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
                 UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
        best AS (SELECT word, count(*) AS n_near, arg_min(other, struct_pack(x := -m, y := hex(encode(other)))) AS other, max(m) AS m FROM near GROUP BY 1),
        rows AS (SELECT w.word, CASE WHEN m >= 10 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
        walk AS (WITH RECURSIVE w AS (SELECT word, word AS root, 0 AS k FROM rows
                                      UNION ALL SELECT w.word, r.form, k + 1 FROM w JOIN rows r ON r.word = w.root WHERE r.form IS NOT NULL)
                 SELECT word, arg_max(root, k) AS root FROM w GROUP BY 1)
        SELECT word, form, root, n, n_near, form_n FROM rows JOIN walk USING (word)""",
    "op13_merkle_manifest": rf"""
        WITH RECURSIVE {CRC_TABLE},
        given AS (SELECT row_number() OVER () AS r, coalesce('=' || source, '') AS grp, doc_id,
                         CASE WHEN doc_id IS NOT NULL AND ({crc32("coalesce(doc_id::VARCHAR, '')")}) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut, source, lang, n_chars, text FROM documents, crc_table),
        parts AS (SELECT r, grp, doc_id, list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda x: coalesce(strlen(x) || ':' || x, '-')) AS p,
                         coalesce(strlen(text) || ':' || text, '-') AS own, coalesce(strlen(cut) || ':' || cut, '-') AS other FROM given),
        leaves AS (SELECT *, sha256(array_to_string(p, '') || own) AS leaf, sha256(array_to_string(p, '') || other) AS tampered FROM parts),
        placed AS (SELECT r, doc_id, grp, leaf, tampered, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
        tree AS (SELECT 0 AS lvl, grp, idx, leaf AS h FROM placed
                 UNION ALL SELECT lvl + 1, grp, idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, max(idx) OVER (PARTITION BY grp) AS last FROM tree) WHERE last > 0 GROUP BY lvl, grp, idx // 3),
        subs AS (SELECT grp, h AS subroot FROM (SELECT *, max(lvl) OVER (PARTITION BY grp) AS top FROM tree) WHERE lvl = top),
        upper AS (SELECT 0 AS lvl, row_number() OVER (ORDER BY grp) - 1 AS idx, subroot AS h FROM subs
                  UNION ALL SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, max(idx) OVER () AS last FROM upper) WHERE last > 0 GROUP BY lvl, idx // 3),
        root AS (SELECT h AS root FROM upper ORDER BY lvl DESC LIMIT 1),
        tops AS (SELECT grp, max(lvl) AS depth FROM tree GROUP BY 1),
        places AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS place FROM subs),
        steps AS (SELECT p.r, t.lvl, string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx < p.idx // power) AS l, string_agg(t.h, '' ORDER BY t.idx) FILTER (t.idx > p.idx // power) AS g
                  FROM placed p JOIN tops USING (grp) JOIN (SELECT *, CAST(3 ** lvl AS BIGINT) AS power FROM tree) t ON t.grp = p.grp AND t.lvl < depth AND t.idx // 3 = p.idx // (3 * power) GROUP BY p.r, t.lvl
                  UNION ALL SELECT p.r, depth + u.lvl, string_agg(u.h, '' ORDER BY u.idx) FILTER (u.idx < place // power), string_agg(u.h, '' ORDER BY u.idx) FILTER (u.idx > place // power)
                  FROM placed p JOIN tops USING (grp) JOIN places USING (grp) JOIN (SELECT *, CAST(3 ** lvl AS BIGINT) AS power FROM upper) u
                       ON u.lvl < (SELECT max(lvl) FROM upper) AND u.idx // 3 = place // (3 * power) GROUP BY p.r, depth, u.lvl),
        paths AS (SELECT r, list(struct_pack(l := coalesce(l, ''), g := coalesce(g, '')) ORDER BY lvl) AS path, string_agg(coalesce(l, '') || coalesce(g, ''), '' ORDER BY lvl) AS proof FROM steps GROUP BY r),
        fold AS (SELECT r, tampered AS h, 1 AS k FROM placed
                 UNION ALL SELECT r, sha256(path[k].l || h || path[k].g), k + 1 FROM fold JOIN paths USING (r) WHERE k <= len(path)),
        ends AS (SELECT r, arg_max(h, k) AS folded_root FROM fold GROUP BY r)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM placed JOIN subs USING (grp) CROSS JOIN root LEFT JOIN paths USING (r) JOIN ends USING (r)""",
}
