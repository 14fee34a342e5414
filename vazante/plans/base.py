"""Inputs that the core queries share, as DataFrames and as DuckDB subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import minhash
from ..functions.text import category_name, valid_date
from ..schemas import POSITIVE
from ..session import table

LAST_MONTH = "2017-10-01"  # the first month that is not complete


def articles(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    """Articles with ``day`` (null unless valid), folded ``category`` and ``positive``."""
    return (
        table(spark, folder, "articles", spread)
        .withColumn("day", valid_date(F.col("date")))
        .withColumn("category", category_name(F.col("category")))
        .withColumn("positive", F.coalesce(F.col("category") == POSITIVE, F.lit(False)))
    )


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, so that sums in another order give equal rows."""
    return df.select(*(F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


DAY = "CASE WHEN regexp_full_match(date, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(date AS DATE) END"
NAME = r"strip_accents(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')))"
#: The same as articles(), for DuckDB.
ART = (
    "(SELECT * REPLACE (" + NAME.format("category") + " AS category), " + DAY + " AS day, "
    "coalesce(" + NAME.format("category") + " = 'mercado', false) AS positive FROM articles)"
)
#: White space as a DuckDB character class, and a text without it at its ends (null if nothing is left).
WHITE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STRIPPED = "nullif(regexp_replace({0}, '^[" + WHITE.replace("{", "{{").replace("}", "}}") + "]+|[" + WHITE.replace("{", "{{").replace("}", "}}") + "]+$', '', 'g'), '')"


def near_sql(rows: str = "articles", coordinates: int = 128, bands: int = 16, threshold: float = 0.85, width: int = 5) -> str:
    """DuckDB CTEs ``mb(id, rep)``, ``sg(id, sig)`` and ``np(id_a, id_b, jaccard_estimado)``: classes of equal squeezed
    texts of ``rows(article_id, text)``, their signatures, and the pairs that share a band and agree enough."""
    codes = f"cc AS (SELECT id, list_transform(string_split(t, ''), lambda c: unicode(c)) AS c FROM qz WHERE id = rep)"
    step = lambda h, c: f"(({h} * {minhash.BASE}::UBIGINT + {c}::UBIGINT + 1) & {minhash.MASK}::UBIGINT)"
    run = "0::UBIGINT"
    for k in range(width):
        run = step(run, f"c[i + {k}]")
    short = "list_reduce(list_prepend(0::UBIGINT, list_transform(c, lambda x: x::UBIGINT)), lambda h, x: " + step("h", "x") + ")"
    stirred = f"((xor(h, h >> 15) * {minhash.STIR}::UBIGINT) & {minhash.MASK}::UBIGINT)"
    least = ", ".join(f"min((xor(h, {x}::UBIGINT) * {a}::UBIGINT) & {minhash.MASK}::UBIGINT)" for x, a in map(minhash.permutation, range(coordinates)))
    size = coordinates // bands
    return (
        f"qz AS (SELECT id, t, min(id) OVER (PARTITION BY t) AS rep FROM (SELECT article_id AS id, trim(regexp_replace(lower(text), '[{WHITE}]+', ' ', 'g')) AS t FROM {rows}) WHERE t <> ''), "
        f"mb AS (SELECT id, rep FROM qz), {codes}, "
        f"rh AS (SELECT id, unnest(CASE WHEN len(c) < {width} THEN [{short}] ELSE list_transform(generate_series(1, len(c) - {width - 1}), lambda i: {run}) END) AS h FROM cc), "
        f"sg AS (SELECT id, [{least}] AS sig FROM (SELECT id, {stirred} AS h FROM rh) GROUP BY id), "
        f"bd AS (SELECT id, b, array_to_string(sig[b * {size} + 1 : b * {size} + {size}], ',') AS k FROM sg, range({bands}) r(b)), "
        "mt AS (SELECT DISTINCT x.id AS id_a, y.id AS id_b FROM bd x JOIN bd y ON x.b = y.b AND x.k = y.k AND x.id < y.id), "
        f"ag AS (SELECT id_a, id_b, len(list_filter(generate_series(1, {coordinates}), lambda i: x.sig[i] = y.sig[i])) / {coordinates}::DOUBLE AS jaccard_estimado FROM mt JOIN sg x ON x.id = id_a JOIN sg y ON y.id = id_b), "
        f"np AS (SELECT * FROM ag WHERE jaccard_estimado >= {threshold})"
    )


#: CTEs ``cp(id, componente)`` of every row in a component of several rows, after :func:`near_sql`; needs WITH RECURSIVE.
COMPONENTS = (
    "ed AS (SELECT id_a AS a, id_b AS b FROM np UNION SELECT id_b, id_a FROM np), "
    "rc AS (SELECT DISTINCT rep AS id, rep AS c FROM mb UNION SELECT ed.b, rc.c FROM rc JOIN ed ON ed.a = rc.id), "
    "cl AS (SELECT id AS rep, min(c) AS c FROM rc GROUP BY 1), "
    "ca AS (SELECT mb.id, c AS componente FROM mb JOIN cl USING (rep)), cp AS (SELECT * FROM ca QUALIFY count(*) OVER (PARTITION BY componente) > 1)"
)
Z = "1.959963984540054"


def wilson_sql(k: str = "positivos", n: str = "total") -> tuple[str, str, str]:
    p = f"({k}/{n}::DOUBLE)"
    mid, half, den = f"({p}+{Z}*{Z}/(2*{n}))", f"({Z}*sqrt({p}*(1-{p})/{n}+{Z}*{Z}/(4.0*{n}*{n})))", f"(1+{Z}*{Z}/{n})"
    return tuple(
        f"CASE WHEN {n} > 0 THEN round({x}, 8) END" for x in (p, f"greatest(0.0, ({mid}-{half})/{den})", f"least(1.0, ({mid}+{half})/{den})")
    )
