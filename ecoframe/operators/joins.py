"""Joins and set operations.

No broadcast hints: the optimizer broadcasts a side when its measured size allows it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ecoframe import config
from ecoframe.functions.nulls import all_of, col
from ecoframe.operators import composition
from ecoframe.operators.ranking import attributes_per_key
from ecoframe.operators.skew import PAIR_BLOCK_ROWS, PAIRS_PER_TASK, attach, blocked_join
from ecoframe.operators.transforms import align_and_order, sample_year
from ecoframe.session import materialise


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` itself, failing at run time if a key occurs twice.

    Only keys are counted, by a hash aggregate that combines map-side, and joined to the table in
    the same plan, so there is no extra job and no sort of whole rows. Rows with a null in the key
    go, as no equi-join can match them.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    guard = F.when(
        F.col("__n") > 1, F.raise_error(F.lit(f"Join key {keys} is not unique on the right side"))
    )
    checked = counted.filter(F.coalesce(guard.cast("boolean"), F.lit(True))).select(*keys)
    return df.join(checked, keys).select(*[col(c) for c in df.columns])


def join_many_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left equi-join that fails when the right key is not unique."""
    return left.join(require_unique(right, on), on, "left")


def join_site_year(obs: DataFrame, population: DataFrame) -> DataFrame:
    """Attach the population of the sampling year; years outside the series give null.

    Both sides are shuffled: a population series is many times larger than the census table by whose
    size Spark would take it for small enough to broadcast.
    """
    right = population.withColumnRenamed("Year", "Sample_year").hint("merge")
    return obs.join(right, ["SSBS", "Sample_year"], "left")


def widen_by_site(tables: list[DataFrame], key: str = "SSBS") -> DataFrame:
    """Several one-row-per-site tables side by side; a site that a table lacks has nulls there."""
    return reduce(lambda a, b: a.join(b, key, "full"), tables)


def apply_scope_manifest(df: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(manifest, keys, "left_semi")


def missing_from_scope(scope: DataFrame, final: DataFrame, keys: list[str]) -> DataFrame:
    return scope.select(*keys).distinct().join(final, keys, "left_anti")


def combine_sources(
    obs: DataFrame,
    roads: DataFrame,
    climate: list[DataFrame],
    topography: list[DataFrame],
    populations: list[DataFrame],
) -> DataFrame:
    """The whole combine step.

    All sources meet on the distinct (site, sampling year) keys of the observations, a table with
    one row per site visit; the large observation table then takes part in a single join.
    """
    dated = sample_year(obs)
    visits = dated.select("SSBS", "Sample_year").distinct()
    table = visits.join(require_unique(roads, ["SSBS"]), "SSBS", "left")
    for group in (climate, topography):
        table = table.join(require_unique(widen_by_site(group), ["SSBS"]), "SSBS", "left")
    for population in populations:
        table = join_site_year(table, population)
    # Null-safe: a visit without a date still has its site's covariates.
    return attach(dated, table, ["SSBS", "Sample_year"])


def reference_condition():
    return (F.col("Predominant_land_use") == config.PRIMARY) & (
        F.col("Use_intensity") == config.MINIMAL
    )


def site_flags(obs: DataFrame) -> DataFrame:
    """One row per study and site, with the flag "is a reference site"."""
    return obs.groupBy("SS", "SSBS").agg(
        F.coalesce(F.bool_or(reference_condition()), F.lit(False)).alias("is_reference")
    )


def reference_sides(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference sites and all sites of every study, the two sides of its pairs."""
    sites = materialise(site_flags(obs), "sites")
    refs = sites.filter("is_reference").select("SS", F.col("SSBS").alias("Primary_minimal_site"))
    return refs, sites.select("SS", F.col("SSBS").alias("Other_site"), "is_reference")


def paired(refs: DataFrame, others: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Pairs of the two sides per study (or ``keys``) with the columns of both; two reference sites meet once.

    A study with very many sites is spread over cells, and no pair is shuffled.
    """
    pairs = blocked_join(
        refs, others, keys or ["SS"], ["Primary_minimal_site"], ["Other_site"], PAIR_BLOCK_ROWS, PAIRS_PER_TASK
    )
    once = (~F.col("is_reference")) | (F.col("Primary_minimal_site") < F.col("Other_site"))
    return pairs.filter((F.col("Primary_minimal_site") != F.col("Other_site")) & once).drop("is_reference")


def paired_sites(obs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the reference pairs of ``obs`` hold, without making them: their distinct (SS, Other_site), their
    distinct (SS, Primary_minimal_site) and per study the number of pairs (SS, n_pairs)."""
    sites = materialise(site_flags(obs).filter(F.col("SS").isNotNull() & F.col("SSBS").isNotNull()), "sites")
    studies = sites.groupBy("SS").agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum(F.col("is_reference").cast("long")).alias("__m"),
        F.min(F.when(F.col("is_reference"), F.col("SSBS"))).alias("__least"),
        F.max(F.when(F.col("is_reference"), F.col("SSBS"))).alias("__last"),
    )
    m, plain = F.col("__m"), F.col("__n") - F.col("__m")
    counts = studies.withColumn("n_pairs", m * plain + F.floor(m * (m - 1) / 2)).filter("n_pairs > 0")
    dealt = sites.join(counts, "SS")
    # The least reference site is no other site; the last one needs a site that is no reference.
    others = dealt.filter(~F.col("is_reference") | (F.col("SSBS") > F.col("__least")))
    refs = dealt.filter(F.col("is_reference") & ((F.col("__n") > m) | (F.col("SSBS") < F.col("__last"))))
    return (
        others.select("SS", F.col("SSBS").alias("Other_site")),
        refs.select("SS", F.col("SSBS").alias("Primary_minimal_site")),
        counts.select("SS", "n_pairs"),
    )


def reference_pair_counts(obs: DataFrame) -> DataFrame:
    """Studies, observations and distinct site pairs of the reference pairs of ``obs``, from counts of sites.

    Only sites of several studies can make a pair twice; those few are paired and their repeats taken off.
    """
    counts = paired_sites(obs)[2]
    twice = obs.select("SS", "SSBS").distinct().groupBy("SSBS").agg(F.count("SS").alias("__n")).filter("__n > 1").select("SSBS")
    again = site_pairs_with_reference(obs.join(twice, "SSBS", "left_semi"))
    repeats = again.groupBy("Primary_minimal_site", "Other_site").agg((F.count(F.lit(1)) - 1).alias("__more"))
    more = repeats.agg(F.coalesce(F.sum("__more"), F.lit(0)).alias("more"))
    total = counts.agg(F.count(F.lit(1)).alias("studies"), F.coalesce(F.sum("n_pairs"), F.lit(0)).cast("long").alias("observations"))
    return total.join(more).select("studies", "observations", (F.col("observations") - F.col("more")).cast("long").alias("site_pairs"))


def site_pairs_with_reference(obs: DataFrame) -> DataFrame:
    """(reference site, other site) of every study; two reference sites are paired once.

    The pair list is the result itself.
    """
    return paired(*reference_sides(obs)).select("SS", "Primary_minimal_site", "Other_site")


def site_taxa(obs: DataFrame, taxon_cols: list[str]) -> DataFrame:
    return (
        obs.filter(all_of([col(t).isNotNull() for t in taxon_cols]))
        .select("SS", "SSBS", *[col(t) for t in taxon_cols])
        .distinct()
    )


def shared_taxa(pairs: DataFrame, obs: DataFrame, taxon_cols: list[str]) -> DataFrame:
    """Taxon units present at both sites of a pair; pairs without any vanish. Bitsets per study meet, not taxa."""
    return composition.shared_units(pairs, site_taxa(obs, taxon_cols), taxon_cols)


def reference_shared_taxa(obs: DataFrame, listed: DataFrame, taxon_cols: list[str]) -> DataFrame:
    """:func:`shared_taxa` of all reference pairs of ``obs``, with the taxa of ``listed``; no pair is shuffled."""
    words, pages = composition.site_words(site_taxa(listed, taxon_cols), taxon_cols)
    refs, others = reference_sides(obs)
    unit = ["SS", "bucket", "word"]

    def sided(sites: DataFrame, site: str, bits: str) -> DataFrame:
        return sites.join(words.withColumnsRenamed({"SSBS": site, "bits": bits}), ["SS", site])

    first = materialise(sided(refs, "Primary_minimal_site", "__first").join(pages, unit), "references")
    second = materialise(sided(others, "Other_site", "__second"), "others")
    return composition.units_of(paired(first, second, unit), taxon_cols)


def attach_pair_features(pairs: DataFrame, sites: DataFrame, continuous: list[str]) -> DataFrame:
    """Features of the other site, and ``*_diff`` against the reference site.

    ``*_reference`` columns are kept for the distance operators and dropped afterwards.
    """
    other, ref = _pair_sides(sites, continuous)
    joined = pairs.join(other, "Other_site", "left").join(ref, "Primary_minimal_site", "inner")
    return joined.select("*", *_diffs(continuous))


def reference_pair_features(obs: DataFrame, sites: DataFrame, continuous: list[str]) -> DataFrame:
    """:func:`attach_pair_features` of all reference pairs of ``obs``.

    Features join the sites before these are paired, so tables of sites are shuffled and no pair is.
    """
    other, ref = _pair_sides(sites, continuous)
    refs, others = reference_sides(obs)
    refs = materialise(refs.join(ref, "Primary_minimal_site"), "references")
    others = materialise(others.join(other, "Other_site", "left"), "others")
    pairs = paired(refs, others)
    keys = ["SS", "Primary_minimal_site", "Other_site"]
    return pairs.select(*keys, *[col(c) for c in pairs.columns if c not in keys], *_diffs(continuous))


def _pair_sides(sites: DataFrame, continuous: list[str]) -> tuple[DataFrame, DataFrame]:
    """Features of the other site, and those of the reference site as ``*_reference``."""
    drop_keys = [c for c in ("SS",) if c in sites.columns]
    other = sites.drop(*drop_keys).withColumnRenamed("SSBS", "Other_site")
    ref_cols = list(dict.fromkeys(continuous + ["Latitude", "Longitude"]))
    ref = sites.select(
        F.col("SSBS").alias("Primary_minimal_site"),
        *[col(c).alias(f"{c}_reference") for c in ref_cols],
    )
    return other, ref


def pair_structs(sites: DataFrame, continuous: list[str]) -> tuple[DataFrame, DataFrame]:
    """Features of a site as a reference site, (SSBS, __reference), and as another one, (SSBS, __other)."""
    other, ref = _pair_sides(sites, continuous)

    def packed(df: DataFrame, site: str, name: str) -> DataFrame:
        return df.select(col(site).alias("SSBS"), F.struct(*[col(c) for c in df.columns if c != site]).alias(name))

    return packed(ref, "Primary_minimal_site", "__reference"), packed(other, "Other_site", "__other")


def unpacked_pairs(pairs: DataFrame, continuous: list[str]) -> DataFrame:
    """Pairs with the structs of :func:`pair_structs` as the columns of :func:`attach_pair_features`."""
    rest = [col(c) for c in pairs.columns if c not in ("__reference", "__other")]
    return pairs.select(*rest, "__other.*", "__reference.*").select("*", *_diffs(continuous))


def _diffs(continuous: list[str]) -> list[Column]:
    return [(col(c) - col(f"{c}_reference")).alias(f"{c}_diff") for c in continuous]


def join_predictions_site_info(pred: DataFrame, info: DataFrame, columns: list[str], order: list[str], how: str = "left") -> DataFrame:
    """Site information de-duplicated on SSBS, then joined to the predictions."""
    site = attributes_per_key(info, ["SSBS"], [c for c in dict.fromkeys(columns) if c != "SSBS"], order)
    return pred.join(site, "SSBS", how)


def harmonise_country(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """Standard country names and ISO codes from a lookup table (country_std, iso_a3)."""

    def translate(c, table: dict[str, str]):
        mapping = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return F.try_element_at(mapping, c)

    named = df.withColumn(
        "Country",
        F.coalesce(translate(F.col("Country"), config.COUNTRY_NAME_OVERRIDES), F.col("Country")),
    )
    joined = named.join(lookup, named["Country"] == lookup["country_std"], "left")
    known = F.col("iso_a3").isNotNull() & (F.col("iso_a3") != "-99")
    return joined.withColumn(
        "iso_a3",
        F.when(known, F.col("iso_a3")).otherwise(
            translate(F.col("Country"), config.COUNTRY_ISO_OVERRIDES)
        ),
    )


# --- set operations -------------------------------------------------------------------------


def concat_releases(df_a: DataFrame, df_b: DataFrame, order: list[str]) -> DataFrame:
    """Bag union of two inventory releases on their common columns."""
    a, b = align_and_order(df_a, df_b, order)
    return a.unionByName(b)


def union_folds(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def eligible_studies(df: DataFrame) -> DataFrame:
    """Studies with one sampling effort, a reference site and more than one taxon.

    Counting "one or more than one distinct value, null included" needs only minimum, maximum
    and the number of nulls, so all three conditions fit one map-side combined aggregate.
    """

    def nulls(c):
        return F.sum(F.when(c.isNull(), 1).otherwise(0))

    effort, taxon = F.col("Sampling_effort"), F.col("Taxon_name_entered")
    stats = df.groupBy("SS").agg(
        F.min(effort).alias("e_min"),
        F.max(effort).alias("e_max"),
        nulls(effort).alias("e_null"),
        F.min(taxon).alias("t_min"),
        F.max(taxon).alias("t_max"),
        nulls(taxon).alias("t_null"),
        F.coalesce(F.bool_or(reference_condition()), F.lit(False)).alias("has_reference"),
    )
    one_effort = F.col("e_min").isNull() | (
        (F.col("e_null") == 0) & (F.col("e_min") == F.col("e_max"))
    )
    many_taxa = (F.col("t_min") != F.col("t_max")) | (
        F.col("t_min").isNotNull() & (F.col("t_null") > 0)
    )
    return stats.filter(one_effort & many_taxa & F.col("has_reference")).select("SS")


def filter_studies(df: DataFrame) -> DataFrame:
    return df.join(eligible_studies(df), "SS", "left_semi")


def distinct_scope(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[col(k) for k in keys]).distinct()


def fold_coverage_gap(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that no fold contains."""
    return distinct_scope(expected, keys).join(observed, keys, "left_anti")


def sort_output(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.orderBy(*[col(k) for k in keys])
