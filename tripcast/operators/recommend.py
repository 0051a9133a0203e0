"""Content-based hotel recommender over whole request tables (REC, WIN, TOP2, JOIN5-6, EVA6).

Design
* The catalogue is one row per hotel (``hotel_base`` + a global price rank).
  Its attributes are column expressions; the price rank uses the bucketed
  ``global_row_number``, not an unpartitioned window.
* ``fit`` turns the catalogue into a model: per-item TF-IDF maps, scaled
  numeric columns, the vocabulary (at most ``max_features`` rows) and six
  min/max numbers.
* ``recommend`` scores every distinct request profile (destination, bounds and
  query text) once and joins the best hotels back to the requests. Profiles
  reach their hotels through equi-joins: destination to the locations that
  contain it, location to hotels. One plan serves every catalogue size; Spark
  picks the joins by the sizes it meets and splits a hot destination. The text
  score is a JVM-side dot product of two maps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import features as FE
from ..functions import text as TX
from ..session import ensure_checkpoint_dir, literal_frame
from ..session import materialize as write_once
from ..session import write_table
from . import text_index as TI
from .dashboard import hotel_base
from .ranking import global_row_number

# Fixed values of the source application.
CITY_CLIMATE = {
    "Florianopolis": "coastal", "Salvador": "tropical", "Natal": "tropical",
    "Aracaju": "tropical", "Recife": "tropical", "Sao Paulo": "temperate",
    "Campo Grande": "temperate", "Rio de Janeiro": "coastal", "Brasilia": "temperate",
}
DEFAULT_CLIMATE = "tropical"
LUXURY_TIER, BOUTIQUE_TIER, BUSINESS_TIER = 0.75, 0.5, 0.25
TOP_STARS, MIDDLE_STARS, BASE_STARS = 5, 4, 3
BASE_AMENITIES, TIER_AMENITIES = 3, 5
REVIEW_BASE, REVIEW_TIER, REVIEW_NOISE, REVIEW_LOW, REVIEW_HIGH = 7.2, 2.0, 0.3, 6.5, 9.8
MATCH_LOW, MATCH_SPAN, MATCH_EVEN = 60.0, 35.0, 75.0
AMENITY_POOL = ["pool", "spa", "wifi", "fine_dining", "gym", "bar",
                "beach_access", "business_center", "kids_club", "butler_service"]
COUNTRY = "Brazil"
TEXT_WEIGHT = 0.60
NUM_WEIGHT = 0.40
TOP_N = 5
DEFAULT_STARS = 4
DEFAULT_REVIEW = 8.0
EMPTY_QUERY = "hotel"
# Climate rule for the derived test cities ("NATION k"): by k mod 3.
FIXTURE_CLIMATES = ["coastal", "tropical", "temperate"]
TEXT_COLUMNS = ["amenities", "style", "climate", "travel_type"]
NUM_COLUMNS = ["avg_price_per_night", "star_rating", "review_score"]


@dataclass
class RecommenderConfig:
    text_weight: float = TEXT_WEIGHT
    num_weight: float = NUM_WEIGHT
    tfidf_max_features: int = TX.MAX_FEATURES


def climate_table(spark, nation: DataFrame | None = None) -> DataFrame:
    """(city, climate): the fixed city list plus the rule for the derived cities."""
    fixed = literal_frame(spark, list(CITY_CLIMATE.items()), ["city", "climate"])
    if nation is None:
        return fixed
    rule = F.element_at(F.array(*[F.lit(c) for c in FIXTURE_CLIMATES]), (F.col("n_nationkey") % 3 + 1).cast("int"))
    derived = nation.select(F.regexp_replace("n_name", "_", " ").alias("city"), rule.alias("climate"))
    return fixed.unionByName(derived)


# REC1-3 — catalogue derived from bookings
def build_catalogue(hotels: DataFrame, climates: DataFrame, materialize: bool = True) -> DataFrame:
    base = hotel_base(hotels)
    if materialize:
        # one row per hotel: written once to the shared checkpoint folder, so the
        # ranking below (sampling + shuffle) does not re-run the booking joins
        ensure_checkpoint_dir(hotels.sparkSession)
        base = write_once(base)
    ranked = global_row_number(base, ["avg_price_per_night", "name", "place"], "price_rank", total="n_hotels")
    tier = F.col("price_rank") / F.greatest(F.lit(1), F.col("n_hotels") - 1)
    # PRJ23 — climate lookup; the table has one row per known city.
    with_climate = (ranked.join(climates.dropDuplicates(["city"]), "city", "left")
                    .withColumn("climate", F.coalesce("climate", F.lit(DEFAULT_CLIMATE)))
                    .withColumn("tier", tier))
    t = F.col("tier")
    style = (F.when(t >= LUXURY_TIER, "luxury").when(t >= BOUTIQUE_TIER, "boutique")
             .when(t >= BUSINESS_TIER, "business").otherwise("budget / backpacker"))
    stars = F.when(t >= LUXURY_TIER, TOP_STARS).when(t >= BUSINESS_TIER, MIDDLE_STARS).otherwise(BASE_STARS)
    coastal = F.col("climate") == "coastal"
    # REC2 — amenities: the pool ordered by md5(name|amenity), first 3 + int(5 * tier)
    keyed = F.transform(F.array(*[F.lit(a) for a in AMENITY_POOL]),
                        lambda a: F.struct(F.md5(F.concat(F.col("name"), F.lit("|"), a)).alias("h"), a.alias("a")))
    chosen = F.slice(F.transform(F.array_sort(keyed), lambda s: s["a"]), F.lit(1),
                     (F.floor(t * TIER_AMENITIES) + BASE_AMENITIES).cast("int"))
    amenities = F.when(coastal & ~F.array_contains(chosen, "beach_access"),
                       F.array_append(chosen, F.lit("beach_access"))).otherwise(chosen)
    # REC3 — review score with a name-seeded offset in [-0.3, 0.3)
    frac = F.conv(F.substring(F.md5(F.concat(F.col("name"), F.lit("#review"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    review = F.bround(F.lit(REVIEW_BASE) + t * REVIEW_TIER + (frac * (2 * REVIEW_NOISE) - REVIEW_NOISE), 1)
    review = F.least(F.lit(REVIEW_HIGH), F.greatest(F.lit(REVIEW_LOW), review))
    travel = (F.when(style == "business", "business leisure")
              .when(coastal, "leisure family").otherwise("leisure"))
    return with_climate.select(
        F.col("price_rank").cast("int").alias("price_rank"),
        "name",
        F.col("city").alias("location"),
        F.lit(COUNTRY).alias("country"),
        style.alias("style"),
        "climate",
        stars.alias("star_rating"),
        F.bround("avg_price_per_night", 2).alias("avg_price_per_night"),
        review.alias("review_score"),
        F.array_join(amenities, " ").alias("amenities"),
        travel.alias("travel_type"),
        "bookings",
    )


@dataclass
class FittedRecommender:
    items: DataFrame          # catalogue + item_id + vec (map term->weight) + scaled numerics
    vocab: DataFrame          # (term, idf), at most max_features rows
    bounds: dict              # column -> (min, max)
    weights: DataFrame        # (doc_id, term, weight) long form
    config: RecommenderConfig


# REC4 — fit on any catalogue frame that has the expected columns
def fit(catalogue: DataFrame, config: RecommenderConfig | None = None, id_col: str = "price_rank",
        materialize: bool = True) -> FittedRecommender:
    """The catalogue is one row per hotel; it is checkpointed (to the shared
    checkpoint folder) so the booking joins behind it run once per fit."""
    config = config or RecommenderConfig()
    items = catalogue.withColumn("item_id", F.col(id_col)).withColumn("_text", TX.item_text(TEXT_COLUMNS))
    if materialize:
        ensure_checkpoint_dir(catalogue.sparkSession)
        items = write_once(items)
    weights, vocab = TX.tfidf(items, "item_id", "_text", config.tfidf_max_features)
    vocab = write_once(vocab)
    vecs = (weights.groupBy("doc_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("vec"))
            .withColumnRenamed("doc_id", "item_id"))
    bounds = FE.fit_minmax(items, NUM_COLUMNS)
    scaled = {f"{c}_s": FE.minmax(c, *bounds[c]) for c in NUM_COLUMNS}
    fitted_items = items.drop("_text").join(vecs, "item_id", "left").withColumns(scaled)
    if materialize:
        # the size check (rows and map entries) and the broadcast both read this table
        fitted_items = write_once(fitted_items)
    return FittedRecommender(fitted_items, vocab, bounds, weights, config)


# REC5 — query vectors from the request's text fields
def query_text() -> F.Column:
    raw = F.trim(F.concat_ws(" ",
                             F.coalesce(F.array_join("amenities", " "), F.lit("")),
                             F.coalesce(F.col("style"), F.lit("")),
                             F.coalesce(F.col("climate"), F.lit("")),
                             F.coalesce(F.col("travel_type"), F.lit(""))))
    return F.when(raw == "", F.lit(EMPTY_QUERY)).otherwise(raw)


def text_vectors(requests: DataFrame, vocab: DataFrame) -> DataFrame:
    """(qtext, qvec): L2-normalised tf*idf map of the in-vocabulary terms of each
    *distinct* query text. Many requests share a text, so the tokenizer runs
    once per text; the vocabulary (<= max_features rows) is the broadcast side
    and the norm window is bounded by the terms of one text."""
    return vectors_of(requests.select(query_text().alias("qtext")), vocab)


def vectors_of(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``text_vectors`` of the column ``qtext``."""
    texts = texts.select("qtext").distinct()
    toks = texts.select("qtext", F.explode(TX.tokens("qtext")).alias("term"))
    tf = (toks.join(F.broadcast(vocab.select("term", "idf")), "term").groupBy("qtext", "term", "idf")
          .agg(F.count(F.lit(1)).alias("tf")))
    w = tf.withColumn("w", F.col("tf") * F.col("idf"))
    w = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("qtext"))))
    return w.groupBy("qtext").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("qvec"))


def _blank(c: str) -> F.Column:
    return F.col(c).isNull() | (F.col(c) == 0)


# FLT3 / FLT4 — hard filters on the numbers of a profile and a hotel
def within_bounds() -> F.Column:
    return ((_blank("budget_max") | (F.col("avg_price_per_night") <= F.col("budget_max")))
            & (_blank("min_stars") | (F.col("star_rating") >= F.col("min_stars")))
            & (_blank("min_review") | (F.col("review_score") >= F.col("min_review"))))


def _dot(q: str, v: str) -> F.Column:
    """Sparse dot product of two term->weight maps; an absent vector scores 0."""
    return F.coalesce(F.aggregate(F.map_entries(F.col(q)), F.lit(0.0),
                                  lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(F.col(v), e["key"]), F.lit(0.0))),
                      F.lit(0.0))


def destination_map(profiles: DataFrame, items: DataFrame, regex: bool = False) -> DataFrame:
    """(_dest, _loc, _cty): the catalogue locations that each distinct destination selects.

    A destination selects a place whose location or country contains it (or, as a
    regular expression, matches in it). Both forms search a trigram index over the
    distinct names."""
    places = items.select("_loc", "_cty").distinct()
    index = TI.build_index(places.select(F.explode(F.array("_loc", "_cty")).alias("text")))
    hits = (TI.matching if regex else TI.containing)(index, profiles.select("_dest").distinct(), "_dest")
    hits = hits.toDF("_dest", "_name")
    named = places.withColumn("_name", F.explode(F.array_distinct(F.array("_loc", "_cty"))))
    return named.join(hits, "_name").select("_dest", "_loc", "_cty").distinct()


#: Cells of the scaled price and review axes that make up a block of hotels.
PRICE_CELLS, REVIEW_CELLS = 16, 8
#: Slack of the block bounds: scores are compared after rounding to 9 digits.
SCORE_EPS = 2e-9
_BLOCK = ["_loc", "_cty", "_sign", "_cell"]


def hotel_blocks(items: DataFrame) -> DataFrame:
    """``items`` with the columns of their block: place, text vector, stars, price and review cell."""
    cell = F.concat_ws("|", F.col("star_rating").cast("string"), F.floor(F.col("avg_price_per_night_s") * PRICE_CELLS).cast("string"),
                       F.floor(F.col("review_score_s") * REVIEW_CELLS).cast("string"))
    sign = F.md5(F.coalesce(F.to_json(F.array_sort(F.map_entries("vec"))), F.lit("")))
    return items.withColumns({"_sign": sign, "_cell": F.concat_ws("|", F.lit("c"), cell)})


def _ideal(mx: F.Column) -> dict[str, F.Column]:
    """What a profile would like best; ``mx`` is the highest price among its hotels."""
    return {
        "avg_price_per_night": F.least(F.coalesce(F.col("budget_max"), mx), mx),
        "star_rating": F.coalesce(F.col("min_stars").cast("double"), F.lit(float(DEFAULT_STARS))),
        "review_score": F.coalesce(F.col("min_review"), F.lit(DEFAULT_REVIEW)),
    }


def reachable(model: FittedRecommender, profiles: DataFrame, items: DataFrame, top_n: int) -> DataFrame:
    """(profile, block columns, _mx): the blocks that may hold one of a profile's ``top_n`` hotels, and the highest price among
    all of its hotels.

    ``profiles`` carry the places their destination selects. A block shares its text score and stars; its price and review
    intervals bound the numeric score from both sides. The blocks whose hotels all pass the filters guarantee ``top_n`` hotels
    of some lowest score; a block whose highest possible score lies below that is never opened."""
    cfg, b = model.config, model.bounds
    spans = {c: [f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max))] for c in
             ("avg_price_per_night", "review_score", "avg_price_per_night_s", "review_score_s")}
    blocks = items.groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("_n"), F.first("vec").alias("vec"), F.first("star_rating").alias("star_rating"),
                                        F.first("star_rating_s").alias("star_rating_s"), *[x for two in spans.values() for x in two])
    asked = profiles.join(blocks, ["_loc", "_cty"])
    stars = _blank("min_stars") | (F.col("star_rating") >= F.col("min_stars"))
    some = stars & (_blank("budget_max") | (F.col("lo_avg_price_per_night") <= F.col("budget_max"))) & (
        _blank("min_review") | (F.col("hi_review_score") >= F.col("min_review")))
    every = (_blank("budget_max") | (F.col("hi_avg_price_per_night") <= F.col("budget_max"))) & (
        _blank("min_review") | (F.col("lo_review_score") >= F.col("min_review")))
    asked = asked.where(some).withColumn("_all", F.coalesce(every, F.lit(False)))
    # the highest price: from blocks that pass as a whole, and from the hotels of those that may hold a higher one
    per_profile = Window.partitionBy("profile")
    asked = asked.withColumn("_sure", F.max(F.when(F.col("_all"), F.col("hi_avg_price_per_night"))).over(per_profile))
    higher = ~F.col("_all") & (F.col("_sure").isNull() | (F.col("hi_avg_price_per_night") > F.col("_sure")))
    wants = ["profile", "budget_max", "min_stars", "min_review"]
    opened = (asked.where(higher).select(*wants, *_BLOCK).join(items.select(*_BLOCK, *NUM_COLUMNS), _BLOCK).where(within_bounds())
              .groupBy("profile").agg(F.max("avg_price_per_night").alias("_seen")))
    asked = asked.join(opened, "profile", "left").withColumn("_mx", F.greatest("_sure", "_seen")).where("_mx is not null")
    near = far = F.lit(0.0)
    ideal = {c: FE.minmax(x, *b[c]) for c, x in _ideal(F.col("_mx")).items()}
    for c in NUM_COLUMNS:
        lo, hi = (F.col("star_rating_s"),) * 2 if c == "star_rating" else (F.col(f"lo_{c}_s"), F.col(f"hi_{c}_s"))
        low, high = F.greatest(lo - ideal[c], ideal[c] - hi, F.lit(0.0)), F.greatest(F.abs(lo - ideal[c]), F.abs(hi - ideal[c]))
        near, far = near + low * low, far + high * high
    text = F.lit(cfg.text_weight) * _dot("qvec", "vec")
    asked = asked.select("profile", *_BLOCK, "_mx", "_all", "_n", (text + F.lit(cfg.num_weight) / (F.sqrt(near) + 1.0)).alias("_most"),
                         (text + F.lit(cfg.num_weight) / (F.sqrt(far) + 1.0)).alias("_least"))
    falling = per_profile.orderBy(F.desc("_least"), *_BLOCK).rowsBetween(Window.unboundedPreceding, 0)
    sure = F.sum(F.when(F.col("_all"), F.col("_n")).otherwise(0)).over(falling)
    asked = asked.withColumn("_floor", F.max(F.when(F.col("_all") & (sure >= top_n), F.col("_least"))).over(per_profile))
    return asked.where(F.col("_floor").isNull() | (F.col("_most") >= F.col("_floor") - SCORE_EPS)).select("profile", *_BLOCK, "_mx")


# REC6-10, JOIN6, TOP2, WIN2, WIN3
def recommend(model: FittedRecommender, requests: DataFrame, top_n: int = TOP_N, regex: bool = False, bounded: bool = False) -> DataFrame:
    """The best hotels of every request. ``bounded`` scores blocks of hotels first and opens only those that may hold a result
    (large catalogues); the rows are the same."""
    cfg = model.config
    ensure_checkpoint_dir(requests.sparkSession)
    wants = ["_dest", "budget_max", "min_stars", "min_review", "qtext"]
    asked = requests.withColumns({"_dest": F.coalesce(F.lower(F.trim(F.col("destination"))), F.lit("")), "qtext": query_text()})
    # written once: the bookings behind the requests are read, and profiles hashed, in one scan instead of one for each use
    asked = write_table(asked.select("request_id", F.md5(F.to_json(F.struct(*wants))).alias("profile"), *wants))
    # requests that ask for the same thing are scored once
    profiles = write_table(asked.select("profile", *wants).distinct())
    profiles = profiles.join(write_once(vectors_of(profiles, model.vocab)), "qtext", "left")
    items = model.items.withColumns({"_loc": F.coalesce(F.lower("location"), F.lit("")), "_cty": F.coalesce(F.lower("country"), F.lit(""))})
    per_profile = Window.partitionBy("profile")
    placed = profiles.join(destination_map(profiles, items, regex), "_dest")
    if bounded:
        items = hotel_blocks(items)
        opened = write_once(reachable(model, placed, items, top_n))
        pairs = profiles.join(opened, "profile").join(items, _BLOCK).where(within_bounds())
        mx = F.col("_mx")
    else:
        pairs = placed.join(items, ["_loc", "_cty"]).where(within_bounds())
        mx = F.max("avg_price_per_night").over(per_profile)
    b = model.bounds
    ideal = _ideal(mx)
    sq = None
    for c in NUM_COLUMNS:
        d = F.col(f"{c}_s") - FE.minmax(ideal[c], *b[c])
        sq = d * d if sq is None else sq + d * d
    num = F.lit(1.0) / (F.sqrt(sq) + 1.0)
    scored = pairs.withColumn("_score", F.round(F.lit(cfg.text_weight) * _dot("qvec", "vec") + F.lit(cfg.num_weight) * num, 9))

    order = Window.partitionBy("profile").orderBy(F.desc("_score"), F.asc("price_rank"))
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    lo, hi = F.min("_score").over(per_profile), F.max("_score").over(per_profile)
    match = F.when(hi > lo, F.lit(MATCH_LOW) + F.lit(MATCH_SPAN) * (F.col("_score") - lo) / (hi - lo)).otherwise(F.lit(MATCH_EVEN))
    best = top.select(
        "profile", "rank", "name", "location", "country", "style", "climate", "star_rating",
        "avg_price_per_night", "review_score", "amenities", "travel_type", "bookings",
        F.bround(match, 1).alias("match_score"),
        C.to_inr("avg_price_per_night").alias("avg_price_per_night_inr"),
    )
    return asked.select("request_id", "profile").join(best, "profile").drop("profile")


# REC11 — requests whose destination is not a catalogue city
def unknown_destinations(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    known = catalogue.select(F.lower("location").alias("_loc")).distinct()
    dest = F.lower(F.trim(F.col("destination")))
    r = requests.where(F.col("destination").isNotNull() & (F.trim(F.col("destination")) != ""))
    return (r.join(known, dest == F.col("_loc"), "left_anti")
            .select("request_id", "destination",
                    F.concat(F.lit("'"), F.col("destination"),
                             F.lit("' is no catalogue city; all cities are searched")).alias("note")))


# PRJ19 + PRJ20 — display records
def display_records(recs: DataFrame, requests: DataFrame) -> DataFrame:
    r = recs.join(requests.select("request_id", "budget_max"), "request_id", "left")
    rating = F.when(F.col("review_score").isNotNull(), F.bround(F.col("review_score") / 2, 1)) \
        .otherwise(F.col("star_rating").cast("double"))
    match = F.when(F.col("match_score") > 1.0, F.col("match_score") / 100.0).otherwise(F.col("match_score"))
    use = C.budget_use("avg_price_per_night", "budget_max")
    return r.select(
        "request_id", "rank", F.col("name").alias("hotel_name"),
        F.col("avg_price_per_night").alias("price_per_night"),
        F.coalesce(F.col("avg_price_per_night_inr"), C.to_inr("avg_price_per_night")).alias("price_per_night_inr"),
        rating.alias("rating"), match.alias("match"),
        F.bround(use["budget_used_pct"], 6).alias("budget_used_pct"), use["budget_band"].alias("budget_band"),
    )


# EVA6 — do the scenarios differ?
def distinct_result_sets(recs: DataFrame) -> DataFrame:
    sets = recs.groupBy("request_id").agg(F.array_sort(F.collect_set("name")).alias("hotels"))
    return sets.agg(F.count(F.lit(1)).alias("scenarios"),
                    F.count_distinct("hotels").alias("distinct_sets")) \
        .withColumn("all_same", F.col("distinct_sets") <= 1)


# JOIN5 (re-aimed) — cosine of listed item pairs from the long weights; absent pair -> 0
def pair_similarity(weights: DataFrame, pairs: DataFrame) -> DataFrame:
    wa = weights.select(F.col("doc_id").alias("item_a"), "term", F.col("weight").alias("wa"))
    wb = weights.select(F.col("doc_id").alias("item_b"), "term", F.col("weight").alias("wb"))
    shared = (pairs.join(wa, "item_a").join(wb, ["item_b", "term"])
              .groupBy("item_a", "item_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("_s")))
    return (pairs.join(shared, ["item_a", "item_b"], "left")
            .select("item_a", "item_b", F.round(F.coalesce("_s", F.lit(0.0)), 9).alias("cosine")))


def neighbour_pairs(catalogue: DataFrame) -> DataFrame:
    """Each hotel with the next one up in price order."""
    ids = catalogue.select(F.col("price_rank").alias("item_a"))
    return ids.join(catalogue.select(F.col("price_rank").alias("item_b")), F.col("item_b") == F.col("item_a") + 1)


# SNK4 metrics as one row
def run_metrics(model: FittedRecommender) -> DataFrame:
    it = model.items.agg(F.count(F.lit(1)).alias("num_hotels"),
                         F.round(F.avg("avg_price_per_night"), 6).alias("avg_price_per_night"),
                         F.round(F.avg("review_score"), 6).alias("avg_review_score"))
    vs = model.vocab.agg(F.count(F.lit(1)).alias("vocab_size"))
    stacked = it.unionByName(vs, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in ["num_hotels", "vocab_size", "avg_price_per_night", "avg_review_score"]])


# SNK4 — the run log gets the configuration and the metrics
def run_params(model: FittedRecommender, num_hotels: int, data_source: str = "bookings") -> dict[str, str]:
    cfg = model.config
    return {"text_weight": str(cfg.text_weight), "num_weight": str(cfg.num_weight), "tfidf_features": str(cfg.tfidf_max_features),
            "num_hotels": str(num_hotels), "data_source": data_source}


# SNK7 — persist the fitted model as tables and reload it by path
def save(model: FittedRecommender, path: str) -> str:
    model.items.write.mode("overwrite").parquet(f"{path}/items")
    model.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    model.weights.write.mode("overwrite").parquet(f"{path}/weights")
    spark = model.items.sparkSession
    rows = [(c, float(lo), float(hi)) for c, (lo, hi) in model.bounds.items()]
    cfg = model.config
    spark.createDataFrame(rows, "column string, lo double, hi double").write.mode("overwrite").parquet(f"{path}/bounds")
    spark.createDataFrame([(cfg.text_weight, cfg.num_weight, cfg.tfidf_max_features)],
                          "text_weight double, num_weight double, tfidf_max_features int") \
        .write.mode("overwrite").parquet(f"{path}/config")
    return path


def load(spark, path: str) -> FittedRecommender:
    bounds = {r["column"]: (r["lo"], r["hi"]) for r in spark.read.parquet(f"{path}/bounds").collect()}
    c = spark.read.parquet(f"{path}/config").first()
    cfg = RecommenderConfig(c["text_weight"], c["num_weight"], c["tfidf_max_features"])
    model = FittedRecommender(spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/vocab"),
                              bounds, spark.read.parquet(f"{path}/weights"), cfg)
    return model
