"""The registered queries of the corpus operators, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.llm import decontam, lm, merkle, minhash, packing, pages, pieces, quality, search, secrets, toxicity, urls, vectors

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register the decorated ``(spark, folder) -> DataFrame`` under its name."""

    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql.strip()
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract_text(table(spark, folder, "pages").select("page_id", "url", "html"))


_DECONTAM_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query(f"""
    WITH d AS (SELECT doc_id, coalesce({_DECONTAM_WORDS}, []) AS w FROM documents),
    i AS (SELECT item_id, coalesce({_DECONTAM_WORDS}, []) AS w FROM benchmark),
    iw AS (SELECT item_id, least(len(w), 10) AS k, unnest(CASE WHEN len(w) < 10 THEN [w]
              ELSE list_transform(range(1, len(w) - 8), lambda p: w[p:p + 9]) END) AS g FROM i WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT k FROM iw),
    dw AS (SELECT doc_id, k, p, w[p:p + k - 1] AS g
           FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sizes) x),
    hits AS (SELECT doc_id, item_id, p, dw.k FROM dw JOIN iw USING (g)),
    n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) x GROUP BY doc_id),
    f AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id)""")
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("n_near", "text_hash", "matches")


@query()
def op2_proximity_matches(spark: SparkSession, folder: str) -> DataFrame:
    """What the SQL of ``op2_decontamination`` has no column for."""
    found = decontam.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "contaminated", "n_near", "matches")


#: The SentencePiece model that the queries use.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

# The rules that page URLs are judged by.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query("""
    WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
        ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
            FROM pages),
    parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    fits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
             FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
    SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict
    FROM parts LEFT JOIN fits USING (page_id)""")
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS r(host, path, verdict)")
    return urls.judge_urls(table(spark, folder, "pages"), rules)


def fold(doc_id: str, folds: int):
    """The crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


@query()
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.learn_sentences(docs, labels, fold("doc_id", 3) != 1)
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("offending").alias("n_offending"),
    )


@query()
def op4_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score_texts(table(spark, folder, "documents"), fold("doc_id", 5))


@query()
def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_texts(table(spark, folder, "documents").select("doc_id", "text"), PIECE_MODEL).drop("text")


_NEAR = r"""
    WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 2), lambda p: array_to_string(w[p:p + 3], ' ')) END) AS g FROM w),
    n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
    u AS (SELECT doc_id, unnest(g) AS g FROM s),
    c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM u x JOIN u y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
    r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT doc_id, n AS n_shingles, min(b) AS component_id, min(b) = doc_id AS kept
    FROM n JOIN r ON a = doc_id GROUP BY doc_id, n"""


@query(_NEAR)
def op6_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.link_near_duplicates(table(spark, folder, "documents"))


@query("""
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_sum(list_transform(e, lambda x: x * x)) > 0),
    e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98::DOUBLE),
    r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    n AS (SELECT a, count(*) AS n FROM e GROUP BY a),
    c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, c = vec_id AS kept
    FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""")
def op7_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.link_vectors(table(spark, folder, "embeddings"))


@query()
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality.score_quality(docs, labels, "source", "lang")


@query()
def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select(
        "doc_id", *[count(kind) for kind in secrets.BASE], F.sha2(listed(base), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )


@query()
def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.with_checksum(packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


@query(f"""
    WITH d AS (SELECT doc_id, unnest({_DECONTAM_WORDS}) AS t FROM documents),
    n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
    c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
    q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_DECONTAM_WORDS}) AS t FROM benchmark) x),
    p AS (SELECT doc_id, t, count(*) AS tf FROM d SEMI JOIN q USING (t) GROUP BY doc_id, t),
    w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t, docs),
    s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
          FROM q JOIN p USING (t) JOIN w USING (t) JOIN n USING (doc_id), c GROUP BY item_id, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""")
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# The CRC-32 of a decimal id, bit by bit, for SQL that has no function for it.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}::VARCHAR) + 1), lambda i: ascii(substr({0}::VARCHAR, i, 1))::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT)"""


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Levels of nodes up to the subroots (grp >= 0) and from there to the root (grp = -1), runs joined on the way.
_MERKLE = f"""
    WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf_sql('text')} AS leaf,
        CASE WHEN {_CRC32.format('doc_id')} % 5 = 0 THEN {_leaf_sql(_LOWER_SQL)} ELSE {_leaf_sql('text')} END AS now FROM documents),
    g AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS grp FROM (SELECT DISTINCT source FROM d)),
    l0 AS (SELECT doc_id, leaf, now, grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                  count(*) OVER (PARTITION BY grp) AS n FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
    low(lv, grp, pos, n, h) AS (SELECT 0, grp, pos, n, leaf FROM l0 UNION ALL
        SELECT lv + 1, grp, pos // 16, (max(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lv, grp, pos // 16),
    sub AS (SELECT grp, h FROM low WHERE n = 1),
    high(lv, pos, n, h) AS (SELECT 0, grp, (SELECT count(*) FROM g), h FROM sub UNION ALL
        SELECT lv + 1, pos // 16, (max(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lv, pos // 16),
    nodes AS (SELECT lv, grp, pos, n, h FROM low UNION ALL SELECT lv, -1, pos, n, h FROM high),
    sides AS (SELECT a.lv, a.grp, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l,
                     coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
              FROM nodes a JOIN nodes b ON a.lv = b.lv AND a.grp = b.grp AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL),
    walk(doc_id, leaf, k, g, lv, own, pos, cur, proof) AS (SELECT doc_id, leaf, pos, grp, 0, grp, pos, now, '' FROM l0 UNION ALL
        SELECT w.doc_id, w.leaf, w.k, w.g, CASE WHEN s.l IS NULL THEN 0 ELSE w.lv + 1 END, CASE WHEN s.l IS NULL THEN -1 ELSE w.own END,
               CASE WHEN s.l IS NULL THEN w.own ELSE w.pos // 16 END, CASE WHEN s.l IS NULL THEN w.cur ELSE sha256(s.l || w.cur || s.r) END,
               w.proof || coalesce(s.l || s.r, '')
        FROM walk w LEFT JOIN sides s ON s.lv = w.lv AND s.grp = w.own AND s.pos = w.pos WHERE s.l IS NOT NULL OR w.own >= 0),
    ends AS (SELECT DISTINCT ON (g, k) * FROM walk ORDER BY g, k, own ASC, lv DESC)
    SELECT doc_id, leaf, sub.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root.h AS verified
    FROM ends JOIN sub ON sub.grp = g CROSS JOIN (SELECT h FROM high WHERE n = 1) root"""


@query(_MERKLE)
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    made = merkle.merkle_manifest(table(spark, folder, "documents"), {"text": lower}, fold("doc_id", 5) == 0)
    return made.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified"
    )


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
