"""One thin query per operator over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, infill, lm, neardup, packing, personal, phrases, quality, secrets, substrings, tokens, toxicity, vectors
from .common import plain, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plain(table(spark, sf_dir, "documents"), "doc_id", "text")
    return secrets.scan(docs).drop("text")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.scan(plain(table(spark, sf_dir, "documents"), "doc_id", "text")).drop("text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plain(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(toxicity.held_out(docs, 5, 0), model).select("doc_id", "held_out", "score", "predicted", "n_hits")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plain(table(spark, sf_dir, "documents"), "doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(toxicity.held_out(docs, 4, 2), model).select("doc_id", "held_out", "score", "predicted")


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plain(table(spark, sf_dir, "documents"), "doc_id", "text")
    return tokens.encode(docs, with_ids=False).drop("text")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = infill.transform(plain(table(spark, sf_dir, "documents"), "doc_id", "text"))
    back = infill.restore(F.col("output"), F.col("form"))
    digests = [F.sha2(F.encode(c, "UTF-8"), 256).alias(a) for c, a in ((F.col("output"), "output_sha256"), (back, "restored_sha256"))]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_secret_scan": op2_secret_scan,
    "op3_personal_data": op3_personal_data,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_bpe": op8_bpe,
    "op9_language_model": op9_language_model,
    "op10_near_vectors": op10_near_vectors,
    "op11_collocations": op11_collocations,
    "op12_packing": op12_packing,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: Words of whole texts in DuckDB.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op6_repeated_passages": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
        windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM starts),
        firsts AS (SELECT k, min((doc_id, i)) AS f FROM windows GROUP BY k HAVING count(*) > 1),
        repeats AS (SELECT doc_id, i FROM windows JOIN firsts USING (k) WHERE (doc_id, i) > f),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM repeats),
        spots AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM spots ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op7_near_duplicates": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0),
        shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s FROM starts),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        arcs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, k.b FROM reach r JOIN arcs k ON r.b = k.a),
        roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM roots LEFT JOIN sizes USING (doc_id)
    """,
    "op11_collocations": f"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents
        ),
        lists AS (SELECT lang, w FROM (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces) WHERE len(w) > 0),
        sizes AS (SELECT unnest([1, 2, 3, 4]) AS m),
        spots AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM lists, sizes WHERE len(w) >= m),
        grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM spots GROUP BY ALL),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang),
        found AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE m >= 2 AND f >= 30),
        cuts AS (SELECT *, unnest(range(1, m)) AS k FROM found),
        scored AS (
            SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
            FROM cuts c
            JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
            JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')
        ),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inner_spots AS (SELECT lang, a, w, m, z, unnest(range(1, m - z + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS z FROM found WHERE m > 2)),
        held AS (SELECT lang, array_to_string(w[i:i + z - 1], ' ') AS phrase, max(a) AS longer FROM inner_spots GROUP BY ALL),
        kept AS (
            SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase
            WHERE h.longer IS NULL OR 100::HUGEINT * h.longer < 80::HUGEINT * b.a
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
    """,
    "op13_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        n AS (
            SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
                   ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
            FROM d
        ),
        f AS (
            SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                           WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
                   least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y
            FROM n
        ),
        p AS (SELECT *, substr(t, 1, x) AS prefix, substr(t, x + 1, y - x) AS middle, substr(t, y + 1) AS suffix FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN concat('<S>', suffix, '<P>', prefix, '<M>', middle)
                      ELSE concat('<P>', prefix, '<S>', suffix, '<M>', middle) END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p
    """,
    "op10_near_vectors": """
        WITH RECURSIVE links AS (
            SELECT a.vec_id AS a, b.vec_id AS b
            FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.98
        ),
        reach AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION
            SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ),
        roots AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT r.a AS vec_id, coalesce(c.n, 0)::BIGINT AS n_links, r.component_id, r.a = r.component_id AS kept
        FROM roots r LEFT JOIN counts c ON r.a = c.a
    """,
}
