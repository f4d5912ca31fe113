"""Catalogue keys (S, N, C): Spark builders and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamer.functions.numeric import boundary
from roamer.operators import catalog as cat
from roamer.plans.registry import register
from roamer.plans.sqlgen import clip, r6, strip
from roamer.sources import tables as tb

MONTHS = cat.MONTH_COLUMNS
FEATURES = cat.FEATURE_COLUMNS
RATINGS = cat.RATING_COLUMNS
DOUBLE_OUT = ["latitude", "longitude"] + FEATURES + MONTHS
FULL_COLUMNS = ["city", "country", "region"] + DOUBLE_OUT + ["source_dataset", "description", "ordinal"]


def round_out(df: DataFrame, doubles=None) -> DataFrame:
    doubles = set(doubles if doubles is not None else [c for c, t in df.dtypes if t == "double"])
    return df.select(*[boundary(c).alias(c) if c in doubles else F.col(c) for c in df.columns])


# ------------------------------------------------------------------ Spark side

def normalized_main(spark, sf):
    return cat.normalize_raw(tb.catalog_raw(spark, sf))


def cleaned_main(spark, sf):
    return cat.clean_catalog(normalized_main(spark, sf))


def curated_sources(spark, sf):
    cur = tb.curated(spark, sf)
    return [cur.where(F.col("item_id") % 80 == 0), cur.where(F.col("item_id") % 80 != 0)]


def built_catalog(spark, sf):
    """The processed catalogue: main table plus curated rows (one curated source)."""
    return cat.build_catalog(tb.catalog_raw(spark, sf), [tb.curated(spark, sf)])


# ------------------------------------------------------------------ DuckDB side

_RAW_RATING = {"beach": "beaches", "culture": "culture", "nature": "nature",
               "nightlife": "nightlife", "food": "cuisine", "adventure": "adventure",
               "relaxation": "wellness", "popularity": "urban"}


def _rescale_sql(target: str, src: str) -> str:
    x = f"CAST({src} AS DOUBLE)"
    scaled = f"CASE WHEN (SELECT max({src}) FROM catalog_raw) <= 5 THEN {x} * 2 ELSE {x} END"
    return f"{clip(scaled, 0, 10)} AS {target}"


def _month_sql(m: int) -> str:
    return (f"CASE WHEN json_valid(avg_temp_monthly) THEN CASE WHEN json_type(avg_temp_monthly) = 'OBJECT' "
            f"THEN TRY_CAST(coalesce(json_extract_string(avg_temp_monthly, '$.\"{m}\".avg'), "
            f"json_extract_string(avg_temp_monthly, '$.\"{m}\"')) AS DOUBLE) END END AS temp_month_{m}")


_ITEM_NUM = """lambda v: TRY_CAST(CASE WHEN json_type(v) = 'OBJECT' THEN json_extract_string(v, '$.avg')
                                 ELSE json_extract_string(v, '$') END AS DOUBLE)"""
_CLIMATE_MEAN = f"""CASE WHEN json_valid(avg_temp_monthly) THEN CASE json_type(avg_temp_monthly)
  WHEN 'OBJECT' THEN list_avg(list_filter(list_transform(json_extract(avg_temp_monthly, '$.*'), {_ITEM_NUM}),
                              lambda x: x IS NOT NULL))
  WHEN 'ARRAY' THEN list_avg(list_filter(list_transform(json_extract(avg_temp_monthly, '$[*]'), {_ITEM_NUM}),
                              lambda x: x IS NOT NULL)) END END"""

_BUDGET = """CAST(CASE lower(regexp_replace(budget_level, '^\\s+|\\s+$', '', 'g'))
  WHEN 'budget' THEN 70 WHEN 'mid-range' THEN 135 WHEN 'mid range' THEN 135
  WHEN 'midrange' THEN 135 WHEN 'luxury' THEN 240 END AS DOUBLE)"""

N_MAIN = f"""
  SELECT item_id AS ordinal, 1 AS source_rank, city_name AS city, country_name AS country,
         coalesce(continent, NULL) AS region, lat AS latitude, lng AS longitude,
         {_BUDGET} AS cost_per_day_usd,
         {_CLIMATE_MEAN} AS avg_temp_c,
         {", ".join(_month_sql(m) for m in range(1, 13))},
         {", ".join(_rescale_sql(t, s) for t, s in _RAW_RATING.items())},
         7.0::DOUBLE AS safety,
         'kaggle_worldwide_travel_cities' AS source_dataset, '' AS description
  FROM catalog_raw
"""

N_CUR = f"""
  SELECT item_id AS ordinal, 0 AS source_rank, city, country, region, latitude, longitude,
         cost_per_day_usd, avg_temp_c, {", ".join(f"NULL::DOUBLE AS {m}" for m in MONTHS)},
         beach, culture, nature, NULL::DOUBLE AS nightlife, NULL::DOUBLE AS food,
         NULL::DOUBLE AS adventure, NULL::DOUBLE AS relaxation, NULL::DOUBLE AS popularity,
         NULL::DOUBLE AS safety, NULL::VARCHAR AS source_dataset, NULL::VARCHAR AS description
  FROM curated
"""


def clean_ctes(name: str, src: str) -> dict[str, str]:
    """CTEs <name>_p (prepared), <name>_m (medians), <name> (clean, deduped)."""
    prep = f"""
  SELECT * REPLACE ({strip('city')} AS city, {strip('country')} AS country,
                    {strip("coalesce(region, 'Unknown')")} AS region)
  FROM {src}
  WHERE city IS NOT NULL AND country IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL
"""
    meds = "SELECT " + ", ".join(f"median({c}) AS med_{c}" for c in FEATURES[1:]) + f" FROM {name}_p"
    temp = "coalesce(p.avg_temp_c, m.med_avg_temp_c)"
    repl = [f"{clip('coalesce(p.cost_per_day_usd, 135.0)', 0)} AS cost_per_day_usd",
            f"{clip(temp, 0)} AS avg_temp_c"]
    repl += [f"coalesce(p.{mc}, {temp}) AS {mc}" for mc in MONTHS]
    repl += [f"{clip(f'coalesce(p.{c}, m.med_{c})', 0, 10)} AS {c}" for c in RATINGS]
    body = f"""
  SELECT p.* REPLACE ({", ".join(repl)})
  FROM {name}_p p CROSS JOIN ({meds}) m
  QUALIFY row_number() OVER (PARTITION BY p.city, p.country ORDER BY p.source_rank, p.ordinal) = 1
"""
    return {f"{name}_p": prep, name: body}


CTES = {"n_main": N_MAIN, "n_cur": N_CUR}
CTES.update(clean_ctes("c_main", "n_main"))
CTES.update(clean_ctes("c_cur", "n_cur"))
CTES["merged"] = "SELECT * FROM c_cur UNION ALL BY NAME SELECT * FROM c_main"
CTES.update(clean_ctes("built", "merged"))
CTES["cur_a"] = "SELECT * FROM n_cur WHERE ordinal % 80 = 0"
CTES["cur_b"] = "SELECT * REPLACE (1 AS source_rank) FROM n_cur WHERE ordinal % 80 <> 0"
CTES.update(clean_ctes("c_cur_a", "cur_a"))
CTES.update(clean_ctes("c_cur_b", "cur_b"))


def reg(key, oracle=None):
    return register(key, oracle, CTES)


def full_select(src: str) -> str:
    cols = ["city", "country", "region"] + [f"{r6(c)} AS {c}" for c in DOUBLE_OUT] + \
        ["source_dataset", "description", "ordinal"]
    return f"SELECT {', '.join(cols)} FROM {src}"


# ------------------------------------------------------------------ keys

@reg("resolve_aliases", """
SELECT item_id, city_name AS city, country_name AS country, continent AS region,
       lat AS latitude, lng AS longitude FROM catalog_raw""")
def q_resolve_aliases(spark, sf):
    raw = tb.catalog_raw(spark, sf)
    found = cat.resolve_aliases(raw.columns)
    return raw.select("item_id", *[F.col(found[t]).alias(t) for t in
                                   ("city", "country", "region", "latitude", "longitude")])


@reg("missing_tokens", f"""
SELECT item_id,
  CASE WHEN city_name IN ({", ".join(repr(t) for t in cat.MISSING_TOKENS)}) THEN NULL ELSE city_name END AS city_name,
  CASE WHEN continent IN ({", ".join(repr(t) for t in cat.MISSING_TOKENS)}) THEN NULL ELSE continent END AS continent,
  CASE WHEN budget_level IN ({", ".join(repr(t) for t in cat.MISSING_TOKENS)}) THEN NULL ELSE budget_level END AS budget_level
FROM catalog_raw""")
def q_missing_tokens(spark, sf):
    raw = tb.catalog_raw(spark, sf)
    return raw.select("item_id", *[cat.missing_to_null(F.col(c)).alias(c)
                                   for c in ("city_name", "continent", "budget_level")])


@reg("rating_rescale", f"""
SELECT item_id, {", ".join(_rescale_sql(t, s) for t, s in _RAW_RATING.items())} FROM catalog_raw""")
def q_rating_rescale(spark, sf):
    return round_out(normalized_main(spark, sf).select(
        F.col("ordinal").alias("item_id"), *_RAW_RATING.keys()))


@reg("budget_to_cost", f"SELECT item_id, budget_level, {_BUDGET} AS cost_per_day_usd FROM catalog_raw")
def q_budget_to_cost(spark, sf):
    raw = tb.catalog_raw(spark, sf)
    return raw.select("item_id", "budget_level",
                      cat.budget_to_cost(F.col("budget_level"), False).alias("cost_per_day_usd"))


@reg("climate_mean", f"SELECT item_id, {r6(_CLIMATE_MEAN)} AS avg_temp_c FROM catalog_raw")
def q_climate_mean(spark, sf):
    raw = tb.catalog_raw(spark, sf)
    df = cat.parse_climate(raw, "avg_temp_monthly", ["item_id"])
    return df.select("item_id", boundary("avg_temp_c").alias("avg_temp_c"))


@reg("climate_months", f"SELECT item_id, {', '.join(_month_sql(m) for m in range(1, 13))} FROM catalog_raw")
def q_climate_months(spark, sf):
    raw = tb.catalog_raw(spark, sf)
    return cat.parse_climate(raw, "avg_temp_monthly", ["item_id"]).drop("avg_temp_c")


# A raw table lacking region, popularity and safety headers gets the defaults.
@reg("default_columns", f"""
SELECT item_id, 'Unknown' AS region, 7.0::DOUBLE AS safety,
       {r6("(coalesce(culture,0) + coalesce(nature,0) + coalesce(food,0) + coalesce(nightlife,0)) / "
           "nullif((culture IS NOT NULL)::INT + (nature IS NOT NULL)::INT + (food IS NOT NULL)::INT + (nightlife IS NOT NULL)::INT, 0)")} AS popularity,
       '' AS description
FROM (SELECT item_id, {", ".join(_rescale_sql(t, s) for t, s in _RAW_RATING.items() if t != 'popularity')} FROM catalog_raw) r""")
def q_default_columns(spark, sf):
    raw = tb.catalog_raw(spark, sf).drop("urban", "continent")
    n = cat.normalize_raw(raw)
    return n.select(F.col("ordinal").alias("item_id"), "region", "safety",
                    boundary("popularity").alias("popularity"), "description")


@reg("tag_source", "SELECT city, country, source_dataset FROM built")
def q_tag_source(spark, sf):
    return built_catalog(spark, sf).select("city", "country", "source_dataset")


@reg("ensure_schema", f"""
SELECT item_id, city, country, region, latitude, longitude, cost_per_day_usd, avg_temp_c, beach, culture,
       nature, NULL::DOUBLE AS nightlife, NULL::DOUBLE AS food, NULL::DOUBLE AS adventure,
       NULL::DOUBLE AS relaxation, NULL::DOUBLE AS popularity, NULL::DOUBLE AS safety,
       {", ".join(f"NULL::DOUBLE AS {m}" for m in MONTHS)}
FROM curated""")
def q_ensure_schema(spark, sf):
    return cat.ensure_schema(tb.curated(spark, sf)).select("item_id", *cat.DESTINATION_COLUMNS)


@reg("trim_keys", "SELECT ordinal AS item_id, city, country, region FROM c_main_p")
def q_trim_keys(spark, sf):
    return cat.prepare(normalized_main(spark, sf)).select(
        F.col("ordinal").alias("item_id"), "city", "country", "region")


@reg("coerce_numeric", f"""SELECT ordinal AS item_id, {", ".join(r6(c) + " AS " + c for c in DOUBLE_OUT)}
FROM n_main""")
def q_coerce_numeric(spark, sf):
    from roamer.functions.numeric import to_double
    n = normalized_main(spark, sf)
    return round_out(n.select(F.col("ordinal").alias("item_id"), *[to_double(c).alias(c) for c in DOUBLE_OUT]))


@reg("drop_unlocatable", "SELECT ordinal AS item_id, city, country FROM c_main_p")
def q_drop_unlocatable(spark, sf):
    return cat.prepare(normalized_main(spark, sf)).select(F.col("ordinal").alias("item_id"), "city", "country")


@reg("fill_cost", "SELECT ordinal AS item_id, coalesce(cost_per_day_usd, 135.0) AS cost_per_day_usd FROM c_main_p")
def q_fill_cost(spark, sf):
    p = cat.prepare(normalized_main(spark, sf))
    return p.select(F.col("ordinal").alias("item_id"),
                    F.coalesce("cost_per_day_usd", F.lit(cat.DEFAULT_COST)).alias("cost_per_day_usd"))


@reg("fill_temp_median", f"""
SELECT ordinal AS item_id, {r6("coalesce(avg_temp_c, (SELECT median(avg_temp_c) FROM c_main_p))")} AS avg_temp_c
FROM c_main_p""")
def q_fill_temp_median(spark, sf):
    p = cat.prepare(normalized_main(spark, sf))
    med = F.lit(cat.exact_medians(p, ["avg_temp_c"])["avg_temp_c"])
    return p.select(F.col("ordinal").alias("item_id"), boundary(F.coalesce("avg_temp_c", med)).alias("avg_temp_c"))


@reg("fill_months", f"""
SELECT ordinal AS item_id, {", ".join(r6(f"coalesce({m}, avg_temp_c, (SELECT median(avg_temp_c) FROM c_main_p))") + f" AS {m}" for m in MONTHS)}
FROM c_main_p""")
def q_fill_months(spark, sf):
    p = cat.prepare(normalized_main(spark, sf))
    temp = F.coalesce("avg_temp_c", F.lit(cat.exact_medians(p, ["avg_temp_c"])["avg_temp_c"]))
    return p.select(F.col("ordinal").alias("item_id"), *[boundary(F.coalesce(m, temp)).alias(m) for m in MONTHS])


@reg("fill_features_median", f"""
SELECT ordinal AS item_id, {", ".join(r6(f"coalesce({c}, (SELECT median({c}) FROM c_main_p))") + f" AS {c}" for c in RATINGS)}
FROM c_main_p""")
def q_fill_features_median(spark, sf):
    p = cat.prepare(normalized_main(spark, sf))
    medians = cat.exact_medians(p, RATINGS)
    return p.select(F.col("ordinal").alias("item_id"), *[boundary(F.coalesce(c, F.lit(medians[c]))).alias(c) for c in RATINGS])


def _impute_undeduped(spark, sf):
    return cat.impute(cat.prepare(normalized_main(spark, sf)))


@reg("clip_features", f"""
SELECT ordinal AS item_id, {", ".join(r6(c) + " AS " + c for c in FEATURES)} FROM (
  SELECT p.* REPLACE ({clip('coalesce(p.cost_per_day_usd, 135.0)', 0)} AS cost_per_day_usd,
                      {clip('coalesce(p.avg_temp_c, m.t)', 0)} AS avg_temp_c,
                      {", ".join(clip(f'coalesce(p.{c}, m.{c})', 0, 10) + f' AS {c}' for c in RATINGS)})
  FROM c_main_p p CROSS JOIN (SELECT median(avg_temp_c) AS t, {", ".join(f"median({c}) AS {c}" for c in RATINGS)} FROM c_main_p) m) imputed""")
def q_clip_features(spark, sf):
    return round_out(_impute_undeduped(spark, sf).select(F.col("ordinal").alias("item_id"), *FEATURES))


@reg("dedup_keep_first", "SELECT city, country, ordinal FROM c_main")
def q_dedup_keep_first(spark, sf):
    return cleaned_main(spark, sf).select("city", "country", "ordinal")


@reg("clean_catalog", full_select("c_main"))
def q_clean_catalog(spark, sf):
    return round_out(cleaned_main(spark, sf).select(*FULL_COLUMNS), DOUBLE_OUT)


@reg("read_custom_dir", f"""
SELECT city, country, region, {", ".join(r6(c) + " AS " + c for c in DOUBLE_OUT)}, ordinal, source_rank
FROM (SELECT * FROM c_cur_a UNION ALL SELECT * FROM c_cur_b)""")
def q_read_custom_dir(spark, sf):
    df = cat.read_custom_sources(curated_sources(spark, sf))
    return round_out(df.select("city", "country", "region", *DOUBLE_OUT, "ordinal", "source_rank"), DOUBLE_OUT)


@reg("build_catalog", full_select("built"))
def q_build_catalog(spark, sf):
    return round_out(built_catalog(spark, sf).select(*FULL_COLUMNS), DOUBLE_OUT)
