"""Queries on corpus preparation, duplicates and vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import duplicates as D
from ..operators import lexical as L
from ..schemas import ANCHORS, FIVE, POSITIVE
from ..session import cut
from .base import ART, COMPONENTS, STRIPPED, WHITE, articles, near_sql, rounded

THRESHOLD = 100  # rows of a frequent class
SEED = "20260423"
FIELDS = ["link", "title", "text"]


def _rows(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    return articles(spark, folder, spread).withColumnRenamed("article_id", "id")


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Dated rows with text, without exact copies."""
    rows = _rows(spark, folder).filter("day is not null and text is not null")
    return C.without_copies(rows.withColumnRenamed("category", "y_original"))


def prepared(spark: SparkSession, folder: str) -> DataFrame:
    return C.prepared(articles(spark, folder)).select("id_raw", "article_id", "day", "link", "y_original")


def near(spark: SparkSession, folder: str) -> D.NearPairs:
    return D.near_pairs(_rows(spark, folder, spread=True))


def minhash(spark: SparkSession, folder: str) -> DataFrame:
    """The signature of every distinct squeezed text, at its least id."""
    sigs = D.signatures(_rows(spark, folder, spread=True).select("id", T.squeezed(F.col("text")).alias("text")))
    return sigs.groupBy("digest").agg(F.min("id").alias("id"), F.max("sig").alias("sig")).select("id", F.lower(F.hex("sig")).alias("assinatura"))


def near_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows, found = _rows(spark, folder), near(spark, folder)
    affected = D.near_affected(D.near_components(found))
    return rounded(D.dedup_summary(rows.select("text"), D.exact_affected(rows, FIELDS), affected, D.near_row_pairs(found)))


def names(spark: SparkSession, folder: str) -> DataFrame:
    return articles(spark, folder).select("article_id", F.col("category").alias("categoria"), "positive")


def _sample(spark: SparkSession, folder: str) -> DataFrame:
    return L.sample_by_category(_rows(spark, folder, spread=True), 2000, SEED)


def _tfidf(spark: SparkSession, folder: str) -> DataFrame:
    return L.tfidf_top(cut(_sample(spark, folder), "sample"))


def _quarters(spark: SparkSession, folder: str) -> DataFrame:
    rows = articles(spark, folder).filter("positive and day is not null and text is not null")
    return rows.select(T.quarter(F.col("day")).alias("trimestre"), "title", "text")


def overlap_all(spark: SparkSession, folder: str) -> DataFrame:
    rows = articles(spark, folder).select(F.col("category").alias("y_original"), "text")
    return rounded(L.overlap_with_all(L.overlap_with(_tfidf(spark, folder), POSITIVE), C.viable_classes(rows), POSITIVE))


def shingles(spark: SparkSession, folder: str) -> DataFrame:
    """Number of distinct character runs of each title."""
    runs = T.character_shingles(T.squeezed(F.col("title")))
    return articles(spark, folder).filter("title is not null").select("article_id", F.size(runs).cast("long").alias("n_shingles"), F.array_join(F.sort_array(runs), "|").alias("runs")).select("article_id", "n_shingles", F.md5("runs").alias("digest"))


def psi(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(L.psi_by(L.token_counts(_quarters(spark, folder), "trimestre", T.letter_tokens(F.col("text"))), "trimestre"))


def parsed_answers(spark: SparkSession, folder: str) -> DataFrame:
    return articles(spark, folder).select("article_id", T.first_class(F.col("title"), [*ANCHORS, "a", "o", "segundo", "entenda"]).alias("classe"))


QUERIES = {
    "normalizar_categoria": names,
    "corpus_preparado": prepared,
    "dedup_texto_exato": _corpus,
    "rollup_ancoras": lambda s, d: C.rollup_anchors(_corpus(s, d), THRESHOLD, ANCHORS),
    "rollup_threshold": lambda s, d: C.rollup_threshold(_corpus(s, d), THRESHOLD),
    "rollup_fixo": lambda s, d: C.rollup_fixed(_corpus(s, d), FIVE),
    "rollup_binario": lambda s, d: C.binary_labels(C.rollup_fixed(_corpus(s, d), FIVE), POSITIVE),
    "enumerar_classes": lambda s, d: C.class_table(_corpus(s, d), THRESHOLD, ("colunas", "ilustrada")).select("classe").orderBy("classe"),
    "tabular_classes": lambda s, d: rounded(C.class_table(_corpus(s, d), THRESHOLD, ("colunas", "ilustrada"))),
    "categorias_viaveis": lambda s, d: C.viable_classes(articles(s, d).select(F.col("category").alias("y_original"), "text")),
    "duplicatas_exatas": lambda s, d: D.exact_examples(_rows(s, d), "link").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ",")),
    "resumo_duplicatas": lambda s, d: rounded(D.exact_report(_rows(s, d), FIELDS)),
    "afetadas_exatas": lambda s, d: D.exact_affected(_rows(s, d), FIELDS),
    "shingles": shingles,
    "minhash_assinaturas": minhash,
    "pares_near_dup": lambda s, d: near(s, d).pairs,
    "classes_near_dup": lambda s, d: near(s, d).members,
    "pares_enriquecidos": lambda s, d: D.enriched(near(s, d).pairs, _rows(s, d)),
    "pares_distantes": lambda s, d: D.enriched(D.distant_pairs(near(s, d), _rows(s, d)), _rows(s, d)),
    "componentes_conexos": lambda s, d: D.near_components(near(s, d)),
    "afetadas_near": lambda s, d: D.near_affected(D.near_components(near(s, d))),
    "resumo_deduplicacao": near_summary,
    "tokens_top_k": lambda s, d: L.top_tokens(articles(s, d, spread=True).select("text"), 50),
    "tokens_top_k_por_grupo": lambda s, d: L.top_tokens_by(_quarters(s, d), "trimestre", 50),
    "amostra_estratificada": lambda s, d: _sample(s, d).select("id", "category"),
    "tfidf_top_k": _tfidf,
    "sobreposicao_tokens": lambda s, d: rounded(L.overlap_with(_tfidf(s, d), POSITIVE)),
    "sobreposicao_todas": overlap_all,
    "estatisticas_texto": lambda s, d: rounded(L.text_statistics(_quarters(s, d), "trimestre")),
    "jaccard_consecutivo": lambda s, d: rounded(L.consecutive_jaccard(L.top_tokens_by(_quarters(s, d), "trimestre", 50), "trimestre")),
    "psi_vs_baseline": psi,
    "juntar_titulo_texto": lambda s, d: articles(s, d).select("article_id", F.md5(T.title_and_text(F.col("title"), F.col("text"))).alias("entrada")),
    "truncar_palavras": lambda s, d: articles(s, d).select("article_id", F.md5(T.first_words(F.col("text"), 50)).alias("texto")),
    "parsear_resposta": parsed_answers,
}

_STOPS = "(" + ",".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
_TOK = r"list_filter(coalesce(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), []), lambda t: t NOT IN " + _STOPS + ")"
_LET = "list_filter(" + _TOK + ", lambda t: regexp_full_match(t, '[a-zá-ú]{{3,}}'))"
_ROWS = f"r AS (SELECT article_id AS id, title, text, link, day, category FROM {ART})"
_DEDUP = (
    "e AS (SELECT id, day, link, category AS y_original, sha256(text) AS g FROM r WHERE day IS NOT NULL AND text IS NOT NULL), "
    "corpus AS (SELECT id, day, link, y_original, count(*) OVER (PARTITION BY g) >= 2 AS eh_duplicata_text FROM e "
    "QUALIFY row_number() OVER (PARTITION BY g ORDER BY day, link, id) = 1)"
)
_CLASSES = f"k AS (SELECT y_original, count(*) AS n FROM corpus WHERE y_original IS NOT NULL GROUP BY 1 HAVING count(*) >= {THRESHOLD})"
_OUT = "id, day, link, eh_duplicata_text, y_original"
_IN = lambda names: "(" + ",".join(f"'{n}'" for n in names) + ")"
_KEY = f"('0x' || substr(md5('{SEED}' || id), 1, 15))::BIGINT"
_SAMPLE = f"s AS (SELECT id, category, text FROM r WHERE category IS NOT NULL AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category ORDER BY {_KEY}, id) <= 2000)"
_TFIDF = (
    f"t AS (SELECT id, category, unnest({_LET.format('text')}) AS token FROM s), tf AS (SELECT id, category, token, count(*) AS tf FROM t GROUP BY ALL), "
    "nn AS (SELECT count(*) AS total FROM s), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), "
    "idf AS (SELECT token, ln((1.0 + total) / (1 + df)) + 1 AS idf FROM df, nn WHERE df >= 2 AND df <= 0.95 * total), "
    "w AS (SELECT id, category, tf.token, tf * idf AS w FROM tf JOIN idf ON tf.token = idf.token), nm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1), "
    "sz AS (SELECT category, count(*) AS docs FROM s GROUP BY 1), "
    "m AS (SELECT w.category AS categoria, token, round(sum(w / norm) / any_value(docs), 10) AS tfidf_mean FROM w JOIN nm ON w.id = nm.id JOIN sz ON sz.category = w.category GROUP BY 1, 2), "
    "top AS (SELECT categoria, row_number() OVER (PARTITION BY categoria ORDER BY tfidf_mean DESC, token)::INTEGER AS rank, token, tfidf_mean FROM m QUALIFY rank <= 30)"
)
_OVER = (
    "st AS (SELECT categoria, list(token ORDER BY token) AS t FROM top GROUP BY 1), rf AS (SELECT t AS r FROM st WHERE categoria = 'mercado'), "
    "ov AS (SELECT categoria AS categoria_vs, round(len(list_intersect(t, r)) / len(list_distinct(list_concat(t, r)))::DOUBLE, 8) AS jaccard_top30, "
    "array_to_string(list_sort(list_intersect(r, t)), ';') AS tokens_compartilhados, array_to_string(list_sort(list_filter(r, lambda x: NOT list_contains(t, x))), ';') AS tokens_exclusivos_referencia FROM st, rf WHERE categoria <> 'mercado')"
)
_Q = f"q AS (SELECT year(day) || 'Q' || quarter(day) AS trimestre, title, text FROM {ART} WHERE positive AND day IS NOT NULL AND text IS NOT NULL)"
_QC = f"qt AS (SELECT trimestre, unnest({_LET.format('text')}) AS token FROM q), qc AS (SELECT trimestre, token, count(*) AS n FROM qt GROUP BY 1, 2)"
_QTOP = "qr AS (SELECT trimestre, row_number() OVER (PARTITION BY trimestre ORDER BY n DESC, token)::INTEGER AS rank, token, n AS freq FROM qc QUALIFY rank <= 50)"
_VIA = f"via AS (SELECT category AS classe, count(text) AS n_textos, count(text) >= 2 AS viavel FROM {ART} WHERE category IS NOT NULL GROUP BY 1)"
_SQ = f"trim(regexp_replace(lower(title), '[{WHITE}]+', ' ', 'g'))"

_NEAR = near_sql()
_ENDS = "en AS (SELECT rep, arg_min(mb.id, (day, mb.id)) AS lo, min(day) AS lod, arg_max(mb.id, (day, mb.id)) AS hi, max(day) AS hid FROM mb JOIN r USING (id) WHERE day IS NOT NULL GROUP BY 1)"
_FAR = (
    "fa AS (SELECT rep AS rep_a, rep AS rep_b, 1.0::DOUBLE AS jaccard_estimado, lo AS x, hi AS y, hid - lod AS d FROM en UNION ALL "
    "SELECT id_a, id_b, jaccard_estimado, CASE WHEN b.hid - a.lod >= a.hid - b.lod THEN a.lo ELSE b.lo END, CASE WHEN b.hid - a.lod >= a.hid - b.lod THEN b.hi ELSE a.hi END, "
    "greatest(b.hid - a.lod, a.hid - b.lod) FROM np JOIN en a ON a.rep = id_a JOIN en b ON b.rep = id_b)"
)
_SIDES = "a.title AS title_a, a.day AS day_a, a.category AS category_a, b.title AS title_b, b.day AS day_b, b.category AS category_b, abs(a.day - b.day)::INTEGER AS dias"
_AFFECTED = " UNION ".join(f"(SELECT id FROM r WHERE {c} IS NOT NULL QUALIFY id > min(id) OVER (PARTITION BY {c}))" for c in FIELDS)

ORACLE_SQL = {
    "minhash_assinaturas": f"WITH {_NEAR} SELECT id, array_to_string(list_transform(sig, lambda v: printf('%02x%02x%02x%02x', (v & 255)::INTEGER, ((v >> 8) & 255)::INTEGER, ((v >> 16) & 255)::INTEGER, ((v >> 24) & 255)::INTEGER)), '') AS assinatura FROM sg",
    "pares_near_dup": f"WITH {_NEAR} SELECT * FROM np",
    "classes_near_dup": f"WITH {_NEAR} SELECT * FROM mb",
    "pares_enriquecidos": f"WITH {_ROWS}, {_NEAR} SELECT np.*, {_SIDES} FROM np JOIN r a ON a.id = id_a JOIN r b ON b.id = id_b",
    "pares_distantes": f"WITH {_ROWS}, {_NEAR}, {_ENDS}, {_FAR} SELECT least(x, y) AS id_a, greatest(x, y) AS id_b, jaccard_estimado, rep_a, rep_b, {_SIDES} FROM fa JOIN r a ON a.id = least(x, y) JOIN r b ON b.id = greatest(x, y) WHERE d > 30",
    "componentes_conexos": f"WITH RECURSIVE {_NEAR}, {COMPONENTS} SELECT * FROM cp",
    "afetadas_near": f"WITH RECURSIVE {_NEAR}, {COMPONENTS} SELECT id FROM cp WHERE id <> componente",
    "resumo_deduplicacao": f"WITH RECURSIVE {_ROWS}, {_NEAR}, {COMPONENTS}, ex AS ({_AFFECTED}), ne AS (SELECT id FROM cp WHERE id <> componente), "
    "sz AS (SELECT rep, count(*) AS n FROM mb GROUP BY 1), pn AS (SELECT (SELECT sum(n * (n - 1) // 2) FROM sz) + (SELECT coalesce(sum(x.n * y.n), 0) FROM np JOIN sz x ON x.rep = id_a JOIN sz y ON y.rep = id_b) AS n), "
    "t AS (SELECT count(*) AS total, count(*) FILTER (text IS NULL) AS nulos FROM r), u AS (SELECT count(*) AS n FROM (SELECT id FROM ex UNION SELECT id FROM ne)) "
    "SELECT total AS total_corpus_bruto, nulos AS linhas_com_text_nulo, (SELECT count(*) FROM ex) AS afetadas_exatas, (SELECT count(*) FROM ne) AS afetadas_near, pn.n::BIGINT AS pares_near_encontrados, "
    "u.n AS afetadas_uniao, round(u.n / total::DOUBLE, 8) AS pct_corpus_afetado, u.n / total::DOUBLE > 0.01 AS parada_acionada FROM t, u, pn",
    "normalizar_categoria": f"SELECT article_id, category AS categoria, positive FROM {ART}",
    "corpus_preparado": f"WITH n AS (SELECT row_number() OVER (ORDER BY day NULLS LAST, link NULLS LAST, article_id) - 1 AS id_raw, * FROM {ART}) SELECT id_raw, article_id, day, link, category AS y_original FROM n WHERE day IS NOT NULL AND text IS NOT NULL",
    "dedup_texto_exato": f"WITH {_ROWS}, {_DEDUP} SELECT * FROM corpus",
    "rollup_ancoras": f"WITH {_ROWS}, {_DEDUP}, {_CLASSES} SELECT {_OUT}, CASE WHEN y_original IN {_IN(ANCHORS)} THEN y_original ELSE 'outros' END AS y_colapsado FROM corpus JOIN k USING (y_original)",
    "rollup_threshold": f"WITH {_ROWS}, {_DEDUP}, {_CLASSES} SELECT {_OUT}, y_original AS y_colapsado FROM corpus JOIN k USING (y_original) WHERE y_original NOT IN ('colunas', 'ilustrada')",
    "rollup_fixo": f"WITH {_ROWS}, {_DEDUP} SELECT {_OUT}, y_original AS y_colapsado FROM corpus WHERE y_original IN {_IN(FIVE)}",
    "rollup_binario": f"WITH {_ROWS}, {_DEDUP} SELECT {_OUT}, CASE WHEN y_original = 'mercado' THEN 'mercado' ELSE 'nao_mercado' END AS y_colapsado FROM corpus WHERE y_original IN {_IN(FIVE)}",
    "enumerar_classes": f"WITH {_ROWS}, {_DEDUP}, {_CLASSES} SELECT y_original AS classe FROM k WHERE y_original NOT IN ('colunas', 'ilustrada')",
    "tabular_classes": f"WITH {_ROWS}, {_DEDUP}, {_CLASSES}, f AS (SELECT * FROM k WHERE y_original NOT IN ('colunas', 'ilustrada')) SELECT y_original AS classe, n, round(n / (SELECT sum(n) FROM f)::DOUBLE, 8) AS frac FROM f",
    "categorias_viaveis": f"WITH {_VIA} SELECT * FROM via",
    "duplicatas_exatas": f"WITH {_ROWS}, g AS (SELECT link, count(*) AS n FROM r WHERE link IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, link LIMIT 5) SELECT CASE WHEN length(link) > 160 THEN substr(link, 1, 157) || '...' ELSE link END AS valor, any_value(n) AS n_ocorrencias, array_to_string(list(id ORDER BY id)[1:10], ',') AS ids FROM r JOIN g USING (link) GROUP BY link",
    "resumo_duplicatas": f"WITH {_ROWS}, "
    + ", ".join(f"g{c} AS (SELECT count(*) AS n FROM r WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)" for c in FIELDS)
    + " "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS tipo, coalesce(sum(n - 1), 0)::BIGINT AS linhas_duplicadas, count(*) AS grupos, round(coalesce(sum(n - 1), 0) / (SELECT count(*) FROM r)::DOUBLE, 8) AS pct_corpus FROM g{c}" for c in FIELDS
    ),
    "afetadas_exatas": f"WITH {_ROWS} " + " UNION ".join(f"(SELECT id FROM r WHERE {c} IS NOT NULL QUALIFY id > min(id) OVER (PARTITION BY {c}))" for c in FIELDS),
    "tokens_top_k": f"WITH t AS (SELECT unnest({_TOK.format('text')}) AS token FROM articles) SELECT token, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, token LIMIT 50",
    "tokens_top_k_por_grupo": f"WITH {_Q}, {_QC}, {_QTOP} SELECT * FROM qr",
    "amostra_estratificada": f"WITH {_ROWS}, {_SAMPLE} SELECT id, category FROM s",
    "tfidf_top_k": f"WITH {_ROWS}, {_SAMPLE}, {_TFIDF} SELECT * FROM top",
    "sobreposicao_tokens": f"WITH {_ROWS}, {_SAMPLE}, {_TFIDF}, {_OVER} SELECT * FROM ov",
    "sobreposicao_todas": f"WITH {_ROWS}, {_SAMPLE}, {_TFIDF}, {_OVER}, {_VIA} SELECT classe AS categoria_vs, n_textos, viavel, jaccard_top30 FROM via LEFT JOIN ov ON classe = categoria_vs WHERE classe <> 'mercado'",
    "estatisticas_texto": f"WITH {_Q} SELECT trimestre, count(*) AS n_documentos, round(avg(coalesce(length(title), 0)), 8) AS comprimento_medio_titulo_chars, round(avg(len({_LET.format('title')})), 8) AS comprimento_medio_titulo_tokens, round(avg(length(text)), 8) AS comprimento_medio_texto_chars, round(avg(len({_LET.format('text')})), 8) AS comprimento_medio_texto_tokens FROM q GROUP BY 1",
    "jaccard_consecutivo": f"WITH {_Q}, {_QC}, {_QTOP}, st AS (SELECT trimestre, list(DISTINCT token) AS t FROM qr GROUP BY 1), lg AS (SELECT trimestre, t, lag(trimestre) OVER (ORDER BY trimestre) AS b, lag(t) OVER (ORDER BY trimestre) AS bt FROM st) SELECT b AS trimestre_anterior, trimestre AS trimestre_atual, round(len(list_intersect(t, bt)) / len(list_distinct(list_concat(t, bt)))::DOUBLE, 8) AS jaccard_top50 FROM lg WHERE b IS NOT NULL",
    "psi_vs_baseline": f"WITH {_Q}, {_QC}, vo AS (SELECT token, sum(n) AS a FROM qc GROUP BY 1 ORDER BY a DESC, token LIMIT 200), gr AS (SELECT DISTINCT trimestre FROM qc), ce AS (SELECT gr.trimestre, vo.token, coalesce(n, 0) AS n FROM gr CROSS JOIN vo LEFT JOIN qc ON qc.trimestre = gr.trimestre AND qc.token = vo.token), sh AS (SELECT trimestre, token, greatest(coalesce(n / nullif(sum(n) OVER (PARTITION BY trimestre), 0)::DOUBLE, 0.0), 1e-6) AS o FROM ce), b AS (SELECT token, o AS e FROM sh WHERE trimestre = (SELECT min(trimestre) FROM sh)) SELECT trimestre, round(sum((o - e) * ln(o / e)), 8) AS psi_top200 FROM sh JOIN b USING (token) GROUP BY 1",
    "juntar_titulo_texto": f"SELECT article_id, md5(concat_ws(' ', {STRIPPED.format('title')}, {STRIPPED.format('text')})) AS entrada FROM articles",
    "truncar_palavras": f"WITH w AS (SELECT article_id, text, regexp_extract_all(text, '[^{WHITE}]+') AS w FROM articles) SELECT article_id, md5(CASE WHEN len(w) <= 50 THEN text ELSE array_to_string(w[1:50], ' ') END) AS texto FROM w",
    "parsear_resposta": "WITH t AS (SELECT article_id, strip_accents(lower(regexp_extract(title, '\\p{L}+(?:-\\p{L}+)*'))) AS t FROM articles) SELECT article_id, CASE WHEN t IN "
    + _IN([*ANCHORS, "a", "o", "segundo", "entenda"])
    + " THEN t END AS classe FROM t",
    "shingles": f"WITH s AS (SELECT article_id, {_SQ} AS s FROM articles WHERE title IS NOT NULL), r AS (SELECT article_id, CASE WHEN length(s) = 0 THEN [] WHEN length(s) < 5 THEN [s] ELSE list_distinct(list_transform(generate_series(1, length(s) - 4), lambda i: substr(s, i, 5))) END AS r FROM s) SELECT article_id, len(r) AS n_shingles, md5(array_to_string(list_sort(r), '|')) AS digest FROM r",
}
