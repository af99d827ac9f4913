"""Stand-in inputs derived from the given tables (FIXTURES.md, section 2).

Every view is one SQL text that Spark and DuckDB both run, so operators and oracle start from the
same rows. ``{name}`` refers to a given table or to another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ecoframe import config

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings"]

_SITE = "concat('S', c_nationkey) AS SS, concat('S', c_nationkey, '_B', c_custkey % 4) AS SSB, concat('S', c_nationkey, '_B', c_custkey % 4, '_', c_custkey) AS SSBS"
_SITE_ID = "concat('S', c_nationkey, '_B', c_custkey % 4, '_', c_custkey)"


def _arithmetic(name: str, prime: int, mod: int, scale: float, shift: float = 0.0) -> str:
    value = f"(c_custkey * {prime} % {mod}) / {scale:e} - {shift:e}"
    return f"CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE {value} END AS {name}"


def _covariates() -> str:
    parts = []
    for i, name in enumerate([v for v in config.DENSITY_VARS if v.startswith("Road")]):
        parts.append(_arithmetic(name, 31 + 2 * i, 5000 + 7 * i, 10.0))
    for i, name in enumerate(config.BIOCLIMATIC_VARS):
        # Temperatures may be below -1, which makes their logarithm invalid.
        shift = 20.0 if "temp" in name.lower() else 0.0
        parts.append(_arithmetic(name, 37 + 2 * i, 400 + 3 * i, 2.0, shift))
    for i, name in enumerate(config.TOPOGRAPHIC_VARS):
        parts.append(_arithmetic(name, 73 + 2 * i, 3000 + 11 * i, 4.0))
    return ", ".join(parts)


def _population() -> str:
    parts = []
    for km in (1, 10, 50):
        for i, year in enumerate((2000, 2005, 2010, 2015, 2020)):
            value = f"(c_custkey * {17 + km} % {700 + km}) / 1e1 + {i} * (c_custkey % 5) + 1e0"
            if year == 2005:
                value = f"CASE WHEN c_custkey % 13 = 0 THEN 0e0 ELSE {value} END"
            if year == 2000:
                value = f"CASE WHEN c_custkey % 19 = 0 THEN 0e0 ELSE {value} END"
            parts.append(f"{value} AS pop_{km}km_{year}")
    return ", ".join(parts)


VIEWS: dict[str, str] = {
    "site_base": f"""
        SELECT {_SITE}, c_custkey, c_nationkey, n_name AS Country, r_name AS Biome,
            concat('R', c_nationkey % 3) AS Realm, r_name AS UN_region,
            concat('E', c_custkey % 7) AS Ecoregion, concat('B', c_custkey % 4) AS Block,
            CASE WHEN c_nationkey % 10 = 9 THEN 'Occurrence' ELSE 'Abundance' END AS Diversity_metric_type,
            CASE WHEN c_custkey % 29 = 0 THEN 'Cannot decide' WHEN c_custkey % 17 = 0 THEN 'Urban'
                WHEN c_mktsegment = 'BUILDING' THEN 'Primary vegetation'
                WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Young secondary vegetation'
                WHEN c_mktsegment = 'FURNITURE' THEN 'Plantation forest'
                WHEN c_mktsegment = 'MACHINERY' THEN 'Pasture' ELSE 'Cropland' END AS Predominant_land_use,
            CASE c_custkey % 3 WHEN 0 THEN 'Minimal use' WHEN 1 THEN 'Light use' ELSE 'Intense use' END AS Use_intensity,
            CASE WHEN c_nationkey % 8 = 7 AND c_custkey % 2 = 1 THEN 2e0 ELSE 1e0 END AS Sampling_effort,
            (c_custkey * 7919 % 359000) / 1e3 - 1.795e2 AS Longitude,
            (c_custkey * 104729 % 120000) / 1e3 - 6e1 AS Latitude,
            concat(1984 + c_custkey % 35, '-06-15') AS Sample_midpoint,
            1e2 + c_custkey % 50 AS Max_linear_extent_metres
        FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
    """,
    "site_obs": """
        SELECT b.*, concat('T', t) AS Taxon_name_entered,
            CASE WHEN t < 120 THEN 'Animalia' WHEN t < 180 THEN 'Plantae' WHEN t < 195 THEN 'Fungi' END AS Kingdom,
            CASE WHEN t < 60 THEN 'Arthropoda' WHEN t < 120 THEN 'Chordata' WHEN t < 160 THEN 'Tracheophyta' END AS Phylum,
            CASE WHEN t < 40 THEN 'Insecta' WHEN t < 60 THEN 'Arachnida' WHEN t < 80 THEN 'Aves' WHEN t < 100 THEN 'Mammalia'
                WHEN t < 110 THEN 'Amphibia' WHEN t < 120 THEN 'Actinopteri' WHEN t < 160 THEN 'Magnoliopsida' END AS Class,
            CASE WHEN t < 160 THEN concat('O', t % 20) END AS `Order`,
            concat('F', t % 40) AS Family, concat('G', t % 80) AS Genus, concat('Sp', t) AS Species,
            CASE WHEN (b.c_custkey + t) % 11 = 0 THEN 0e0 ELSE q END AS Measurement,
            CASE WHEN (b.c_custkey + t) % 11 = 0 THEN 0e0 ELSE q END / (1 + b.c_custkey % 3) AS Effort_corrected_measurement
        FROM (
            SELECT o_custkey, p_partkey % 200 AS t, sum(l_quantity) AS q
            FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
            GROUP BY o_custkey, p_partkey % 200
        ) x JOIN {site_base} b ON b.c_custkey = x.o_custkey
    """,
    "obs_groups": """
        SELECT s.*, CASE
            WHEN Phylum = 'Arthropoda' AND Class = 'Insecta' THEN 'Insecta'
            WHEN Phylum = 'Arthropoda' THEN 'Other Arthropoda'
            WHEN Phylum = 'Chordata' AND Class IN ('Aves', 'Mammalia') THEN Class
            WHEN Phylum = 'Chordata' AND Class IN ('Amphibia', 'Reptilia') THEN 'Amphibia_Reptilia'
            WHEN Phylum = 'Chordata' THEN 'Other Chordata'
            WHEN Phylum = 'Tracheophyta' THEN 'Tracheophyta'
            WHEN Kingdom = 'Fungi' THEN 'Fungi'
            ELSE 'Other ' || Kingdom END AS Custom_taxonomic_group
        FROM {site_obs} s WHERE Kingdom IS NOT NULL
    """,
    "site_cov": f"SELECT {_SITE_ID} AS SSBS, {_covariates()} FROM {{customer}}",
    "site_pop": f"SELECT {_SITE_ID} AS SSBS, {_population()} FROM {{customer}}",
    "inventory_a": "SELECT s.*, 'old' AS only_in_a FROM {site_obs} s WHERE c_nationkey % 2 = 0",
    "inventory_b": "SELECT s.*, 'new' AS only_in_b FROM {site_obs} s WHERE c_nationkey % 2 = 1",
    "pixels": """
        SELECT l_returnflag AS raster_id, CAST(l_partkey % 100 AS INT) AS ix, CAST(l_suppkey % 100 AS INT) AS iy,
            avg(l_extendedprice) / 7e0 AS value
        FROM {lineitem} GROUP BY l_returnflag, l_partkey % 100, l_suppkey % 100
    """,
    "squares": " UNION ALL ".join(
        f"SELECT {_SITE_ID} AS SSBS, {r} AS radius, (c_custkey * 37 % 970) / 1e1 + 1.5e0 AS x, "
        "(c_custkey * 53 % 970) / 1e1 + 1.5e0 AS y FROM {customer}"
        for r in ("0.75e0", "2.25e0")
    ),
    "road_segments": """
        SELECT o_orderkey AS segment_id, CAST(32601 + o_custkey % 4 AS INT) AS epsg_code,
            (o_orderkey * 6151 % 100000) * 1e0 AS x1, (o_orderkey * 3571 % 100000) * 1e0 AS y1,
            (o_orderkey * 6151 % 100000) + (o_orderkey * 17 % 800) * 1e0 - 4e2 AS x2,
            (o_orderkey * 3571 % 100000) + (o_orderkey * 29 % 800) * 1e0 - 4e2 AS y2
        FROM {orders}
    """,
    "road_sites": f"""
        SELECT {_SITE_ID} AS SSBS, CAST(32601 + c_custkey % 4 AS INT) AS epsg_code,
            (c_custkey * 4099 % 100000) * 1e0 AS easting, (c_custkey * 2053 % 100000) * 1e0 AS northing
        FROM {{customer}}
    """,
    "predictions": f"""
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
            concat('S', c_nationkey, '_B', c_custkey % 4, '_', c_custkey) AS SSBS,
            l_discount * 10 AS Observed, (l_tax * 10 + l_discount * 10) / 2 AS Predicted_FE,
            ((l_tax * 10 + l_discount * 10) / 2 + l_discount * 10) / 2 AS Predicted_RE,
            0.5e0 AS Reference_pred_FE, CAST(l_orderkey % 5 AS INT) AS fold,
            CASE l_returnflag WHEN 'A' THEN 'lmm' ELSE 'bhm' END AS model,
            CASE WHEN l_linestatus = 'O' THEN 'Standard CV' ELSE 'Training' END AS mode
        FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey
    """,
    "pred_site": """
        SELECT SSBS, avg(Observed) AS Observed, avg(Predicted_FE) AS Predicted,
            avg(Predicted_RE) AS Predicted_RE, avg(Reference_pred_FE) AS Reference_pred
        FROM {predictions} GROUP BY SSBS
    """,
    "pred_sited": """
        SELECT p.*, b.SS, b.SSB, b.Biome, b.Realm, b.Ecoregion, b.Country, b.Longitude, b.Latitude,
            b.Predominant_land_use, b.Use_intensity, b.c_custkey
        FROM {pred_site} p JOIN {site_base} b ON p.SSBS = b.SSBS
    """,
    # Posterior: 4 chains x 25 draws (taken from the order numbers) x levels.
    "draws": """
        SELECT d.chain, d.draw, g.level, g.grp AS `group`,
            (d.chain * 7 + d.draw * 13 + g.k * 5) % 31 / 3.1e1 - 5e-1 AS alpha,
            (d.chain * 3 + d.draw * 11 + g.k * 2) % 29 / 2.9e1 - 5e-1 AS b1,
            (d.chain * 5 + d.draw * 17 + g.k * 3) % 37 / 3.7e1 - 5e-1 AS b2,
            (d.chain * 2 + d.draw * 19 + g.k * 7) % 41 / 4.1e1 - 5e-1 AS b3,
            (d.chain * 11 + d.draw * 23 + g.k) % 43 / 4.3e1 - 5e-1 AS b4
        FROM (SELECT DISTINCT CAST(o_orderkey % 100 / 25 - o_orderkey % 25 / 2.5e1 + 1e-9 AS INT) AS chain, CAST(o_orderkey % 25 AS INT) AS draw FROM {orders}) d
        CROSS JOIN (
            SELECT 1 AS level, r_regionkey AS grp, r_regionkey AS k FROM {region}
            UNION ALL SELECT 0 AS level, 0 AS grp, 9 AS k FROM {region} WHERE r_regionkey = 0
        ) g
    """,
    "covariates": None,  # dialect-dependent array access, see below
    "country_lookup": """
        SELECT n_name AS country_std,
            CASE WHEN n_nationkey % 7 = 0 THEN '-99' ELSE upper(substring(n_name, 1, 3)) END AS iso_a3
        FROM {nation}
    """,
}

COVARIATE_NAMES = [f"v{i}" for i in range(1, 65)]


def _covariate_view(dialect: str) -> str:
    item = "embedding[{0}]" if dialect == "duckdb" else "element_at(embedding, {0})"
    cols = ", ".join(
        f"CAST({item.format(i)} AS DOUBLE) AS v{i}" for i in range(1, len(COVARIATE_NAMES) + 1)
    )
    return f"SELECT vec_id, label, CAST(vec_id % 5 AS INT) AS Fold_id, {cols} FROM {{embeddings}}"


def _text(name: str, dialect: str) -> str:
    sql = _covariate_view(dialect) if name == "covariates" else VIEWS[name]
    return sql.replace("`", '"') if dialect == "duckdb" else sql


_REF = re.compile(r"\{(\w+)\}")


_registered: set[tuple[str, str, str]] = set()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in view (or a given table) as a DataFrame.

    Files are looked up and SQL is analysed once per session and directory, as temporary views.
    """
    where = sf_dir.rstrip("/")
    suffix = re.sub(r"\W", "_", where)

    def register(n: str) -> str:
        alias, key = f"{n}_{suffix}", (spark.sparkContext.applicationId, where, n)
        if key not in _registered:
            if n in TABLES:
                df = spark.read.parquet(f"{where}/{n}.parquet")
            else:
                df = spark.sql(_REF.sub(lambda m: register(m.group(1)), _text(n, "spark")))
            df.createOrReplaceTempView(alias)
            _registered.add(key)
        return alias

    return spark.table(register(name))


def oracle(query: str, extra: dict[str, str] | None = None) -> str:
    """DuckDB text of ``query`` with the views it mentions as common table expressions."""
    extra = extra or {}
    order: list[str] = []

    def body(n: str) -> str:
        return extra[n] if n in extra else _text(n, "duckdb")

    def need(sql: str) -> None:
        for n in dict.fromkeys(_REF.findall(sql)):
            if n not in TABLES and n not in order:
                need(body(n))
                order.append(n)

    need(query)
    plain = lambda sql: _REF.sub(lambda m: m.group(1), sql)
    ctes = ", ".join(f"{n} AS ({plain(body(n))})" for n in order)
    return (f"WITH {ctes} " if ctes else "") + plain(query)
