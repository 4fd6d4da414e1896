"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm import chat, classlm, crosstok, decontaminate, dualtree, jaccard, langid, licenses, lines, mixing, toxicity, urls, vectors
from triagelake.llm.texts import fold
from triagelake.session import local_table

#: The rules of the URL query: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: The two tokenizers of the alignment query.
TOKENIZERS = ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents at weights 5, 2, 1 by source."""
    mix = mixing.mix(_read(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of later copies of repeated runs taken out of every document, and a digest of what stays."""
    out = lines.remove_later_copies(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("lines").alias("n_lines"), F.size("removed").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines"), F.md5("text").alias("text_md5"))


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-model score of every document, learned from six of seven folds."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "text")
    return classlm.score(docs)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at a shingle similarity of 0.8."""
    return jaccard.join_documents(_read(spark, sf_dir, "documents"), 80)


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document."""
    found = decontaminate.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "share", "question_overlap", "answer_overlap")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    rules = local_table(spark, URL_RULES, "host string, path string, verdict string")
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op7_vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors at cosine 0.98 within a label."""
    return vectors.link_vectors(_read(spark, sf_dir, "embeddings"), 0.98)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two of three folds."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.filter(fold(F.col("doc_id"), 3) != 1))
    held = fold(F.col("doc_id"), 3) == 1
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every document that matches a license template."""
    found = licenses.find_licenses(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", "coverage", F.col("start").alias("start_char"), F.col("end").alias("end_char"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four of five folds of the labels."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(F.col("doc_id"), 5) == 0
    grammar = toxicity.learn(docs, _read(spark, sf_dir, "labels").filter(~held))
    scored = toxicity.score(docs, grammar)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: A conversation whose texts hold the template's own marks.
_HARD = "<|im_end|><|im_start|>assistant ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted as ChatML and read back from its text and loss spans."""
    own = local_table(spark, [(-1, 0, "user", _HARD), (-1, 1, "assistant", _HARD)], "conv_id long, turn long, role string, text string")
    talks = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(talks.unionByName(own)).drop("bad_turn")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for each benchmark item."""
    return dualtree.top_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), 10)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by two tokenizers, cut into groups where both end, and the links' corpus-wide counts."""
    return crosstok.align_documents(_read(spark, sf_dir, "documents"), TOKENIZERS)


QUERIES = {
    f.__name__: f
    for f in (
        op1_pareto_mix,
        op2_line_dedup,
        op3_class_lm,
        op4_jaccard_join,
        op5_benchmark_leaks,
        op6_url_rules,
        op7_vector_copies,
        op8_language,
        op9_license_scan,
        op10_toxicity,
        op11_chat_format,
        op12_ranked_search,
        op13_token_alignment,
    )
}

_HOST = "CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
_PATH = "CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*(/[^?#]*)', 1, 's') ELSE '' END"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

ORACLES = {
    "op6_url_rules": (
        f"WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages), "
        "r(h, s, verdict) AS (VALUES " + ", ".join(f"('{h}', '{s}', '{v}')" for h, s, v in URL_RULES) + "), "
        "b AS (SELECT host, path, max_by(h || s, length(h || s)) AS rule, max_by(verdict, length(h || s)) AS verdict "
        "FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY ALL) "
        "SELECT page_id, host, path, rule, coalesce(b.verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (host, path)"
    ),
    "op11_chat_format": (
        f"WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{_HARD}'), (-1, 1, 'assistant', '{_HARD}')), "
        "s AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns, "
        "coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss, string_agg(role, ' ' ORDER BY turn, role, text) AS roles, "
        "sum(length(role) + 24 + length(text) + len(regexp_extract_all(text, '<\\\\*[|]'))) AS chars "
        "FROM c GROUP BY conv_id) "
        "SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars, "
        "regexp_full_match(roles, '(system )?user assistant( user assistant)*') AS valid FROM s"
    ),
    "op12_ranked_search": (
        f"WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term FROM documents), "
        f"q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term FROM benchmark), "
        "s AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), "
        "c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM s), "
        "f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL), "
        "w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, c GROUP BY term, docs), "
        "x AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))) AS v FROM f JOIN w USING (term) JOIN s USING (doc_id), c), "
        "y AS (SELECT item_id, doc_id, CAST(sum(v) AS BIGINT) AS score FROM q JOIN x USING (term) GROUP BY ALL HAVING sum(v) > 0) "
        "SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM y "
        "QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"
    ),
    "op7_vector_copies": (
        "WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings "
        "WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0), "
        "l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.k <> b.k AND len(a.e) = len(b.e) "
        "WHERE list_cosine_similarity(a.e, b.e) >= 0.98), "
        "walk(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT walk.u, l.v FROM walk JOIN l ON walk.v = l.u), "
        "c AS (SELECT u AS vec_id, min(v) AS component_id FROM walk GROUP BY u), n AS (SELECT u AS vec_id, count(*) AS n_links FROM l GROUP BY u) "
        "SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"
    ),
}
