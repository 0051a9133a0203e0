"""Query catalogue: operator id -> job over an sf directory.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` reading the driver tables
(through the derived travel views) and returning a lazy DataFrame. Column
names match the DuckDB text in ``plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import features as FE
from ..functions import text as TX
from ..operators import cube as CU
from ..operators import dashboard as D
from ..operators import evaluation as EV
from ..operators import linear_stats as LS
from ..operators import ml as ML
from ..operators import recommend as R
from ..operators.ranking import global_row_number
from ..operators import sampling as S
from ..operators import similarity as SIM
from ..operators import text_index as TI
from ..session import ensure_checkpoint_dir, literal_frame
from ..sources import colocated as CL
from ..sources import fixtures as FX
from ..sources import loaders as L
from ..sources.schemas import HOTEL_REQUEST
from ..sources.tables import table
from ..streaming import scoring as SC

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Dashboard parameters used by the registered filtered queries.
YEARS = (1996, 1998)
CLASSES = ("premium", "firstClass")


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _f(spark, d):
    return L.load_flights(spark, d)


def _h(spark, d):
    return L.load_hotels(spark, d)


def _u(spark, d):
    return L.load_users(spark, d)


# ---------------------------------------------------------------- sources
@query("SRC1_flights_raw")
def src1(spark, d):
    return L.load_flights_raw(spark, d)


@query("SRC2_users_raw")
def src2(spark, d):
    return L.load_users(spark, d)


@query("SRC3_flights_typed")
def src3(spark, d):
    return _f(spark, d)


@query("SRC4_hotels_typed")
def src4(spark, d):
    return _h(spark, d)


# ---------------------------------------------------------------- profiling
@query("PRF1_users_summary")
def prf1(spark, d):
    return D.table_summary(_u(spark, d), "users")


@query("PRF2_gender_distribution")
def prf2(spark, d):
    return D.target_distribution(_u(spark, d), "gender")


@query("PRF3_source_badges")
def prf3(spark, d):
    return D.source_badges({"flights.csv": L.load_flights_raw(spark, d),
                            "hotels.csv": L.load_hotels_raw(spark, d),
                            "users.csv": L.load_users(spark, d)})


@query("PRF4_home_stats")
def prf4(spark, d):
    return D.home_stats(L.load_flights_raw(spark, d), L.load_hotels_raw(spark, d), L.load_users(spark, d))


# ---------------------------------------------------------------- projections
@query("PRJ1_drop_ids")
def prj1(spark, d):
    return C.drop_ids(L.load_flights_raw(spark, d), C.FLIGHT_ID_COLUMNS + ["not_there"])


@query("PRJ2_lenient_dates")
def prj2(spark, d):
    f = L.load_flights_raw(spark, d)
    return f.select("travelCode", "date", C.parse_date_lenient("date").alias("parsed"))


@query("PRJ3_strict_calendar")
def prj3(spark, d):
    h = L.load_hotels_raw(spark, d)
    parsed = C.parse_date_strict("date")
    parts = C.calendar_parts(parsed)
    return h.select("travelCode", "days", "name", *[v.alias(k) for k, v in parts.items()])


@query("PRJ4_to_inr")
def prj4(spark, d):
    return L.load_hotels_raw(spark, d).select("travelCode", "days", "name", "price", "total",
                                              C.to_inr("price").alias("price_inr"),
                                              C.to_inr("total").alias("total_inr"))


@query("PRJ5_PRJ6_place_parts")
def prj5(spark, d):
    h = L.load_hotels_raw(spark, d).select("place").distinct()
    return h.select("place", C.city_of("place").alias("city"), C.state_of("place").alias("state_code"))


@query("PRJ7_name_features_training")
def prj7(spark, d):
    u = _u(spark, d)
    feats = C.name_features_training("name")
    return u.select("code", *[v.alias(k) for k, v in feats.items()])


@query("PRJ8_name_features_serving")
def prj8(spark, d):
    u = _u(spark, d)
    first = C.name_features_training("name")["first_name"]
    feats = C.name_features_serving(first)
    return u.select("code", *[v.alias(k) for k, v in feats.items()])


@query("PRJ9_name_codes")
def prj9(spark, d):
    u = _u(spark, d)
    return u.select("code", *[v.alias(k) for k, v in C.name_codes("name").items()])


@query("PRJ10_calendar_codes")
def prj10(spark, d):
    f = _f(spark, d)
    return f.select("travelCode", *[v.alias(k) for k, v in C.calendar_codes("date").items()])


@query("PRJ12_flight_type_labels")
def prj12(spark, d):
    f = L.load_flights_raw(spark, d).select("flightType").distinct()
    return f.select("flightType", C.flight_type_label("flightType").alias("label"),
                    C.flight_type_code(C.flight_type_label("flightType")).alias("round_trip"))


@query("PRJ13_fmt_inr")
def prj13(spark, d):
    return L.load_flights_raw(spark, d).select("travelCode", C.fmt_inr("price").alias("price_fmt"))


@query("PRJ17_price_band")
def prj17(spark, d):
    f = _f(spark, d)
    return f.select("travelCode", *[v.alias(k) for k, v in C.price_band("price_inr").items()])


@query("PRJ21_age_band")
def prj21(spark, d):
    return _u(spark, d).select("code", "age", C.age_band("age").alias("age_group"))


@query("PRJ22_month_start")
def prj22(spark, d):
    return _f(spark, d).select("travelCode", C.month_start("date").alias("month"))


# ---------------------------------------------------------------- filters
@query("FLT1_year_filter")
def flt1(spark, d):
    return D.filter_years(_f(spark, d), YEARS).select("travelCode", "date", "price_inr")


@query("FLT2_class_filter")
def flt2(spark, d):
    return D.filter_classes(D.filter_years(_f(spark, d), YEARS), CLASSES).select("travelCode", "flightType", "price_inr")


@query("FLT5_company_members")
def flt5(spark, d):
    u = _u(spark, d)
    known = u.select("company").where(F.col("company").isNotNull())  # the encoder's company list
    return D.members(u, known, "company").select("code", "company")


@query("FLT7_option_lists")
def flt7(spark, d):
    return D.option_lists(_f(spark, d), _u(spark, d))


# ---------------------------------------------------------------- joins
@query("JOIN1_flights_users")
def join1(spark, d):
    return D.flights_with_users(_f(spark, d), _u(spark, d))


@query("JOIN2_hotels_users")
def join2(spark, d):
    return D.hotels_with_users(_h(spark, d), _u(spark, d))


def _stored_with_users(spark, d, view):
    folder = _scratch(spark, "colocated")
    return CL.with_users(spark, CL.store(view(spark, d), _u(spark, d), folder, folder.rsplit("/", 1)[1].replace("-", "_")))


@query("JOIN1_colocated")
def join1_colocated(spark, d):
    return _stored_with_users(spark, d, _f)


@query("JOIN2_colocated")
def join2_colocated(spark, d):
    return _stored_with_users(spark, d, _h)


@query("JOIN4_route_lookup")
def join4(spark, d):
    f = _f(spark, d)
    # Return-trip estimate: look up (to, from) for every booking.
    req = f.select("travelCode", F.col("to").alias("from"), F.col("from").alias("to"))
    return D.route_lookup(req, D.route_means(f))


# ---------------------------------------------------------------- aggregates
@query("AGG1_kpi_row")
def agg1(spark, d):
    return D.kpi_row(_f(spark, d), _h(spark, d), YEARS)


@query("AGG2_monthly_price_by_class")
def agg2(spark, d):
    return D.monthly_price_by_class(_f(spark, d))


@query("AGG2F_monthly_price_filtered")
def agg2f(spark, d):
    return D.monthly_price_by_class(_f(spark, d), YEARS, CLASSES)


@query("AGG3_monthly_bookings")
def agg3(spark, d):
    return D.monthly_bookings(_f(spark, d), YEARS)


@query("AGG4_agency_share")
def agg4(spark, d):
    return D.agency_share(_f(spark, d), YEARS, CLASSES)


@query("AGG5_class_mean_price")
def agg5(spark, d):
    return D.class_mean_price(_f(spark, d), YEARS)


@query("AGG6_hotel_monthly_price")
def agg6(spark, d):
    return D.hotel_monthly_price(_h(spark, d), YEARS)


@query("AGG7_hotel_bookings")
def agg7(spark, d):
    return D.hotel_bookings(_h(spark, d))


@query("AGG8_city_mean_price")
def agg8(spark, d):
    return D.city_mean_price(_h(spark, d))


@query("AGG9_stay_lengths")
def agg9(spark, d):
    return D.stay_lengths(_h(spark, d))


@query("AGG10_JOIN3_destinations")
def agg10(spark, d):
    return D.destinations(_f(spark, d))


@query("AGG11_TOP1_top_routes")
def agg11(spark, d):
    return D.top_routes(_f(spark, d), 10)


def _cubes(spark, d):
    """Flight and hotel cubes, built once and read back."""
    path = _scratch(spark, "cube")
    CU.refresh(CU.flight_cube(_f(spark, d)), f"{path}/flights")
    CU.refresh(CU.hotel_cube(_h(spark, d)), f"{path}/hotels")
    return CU.load(spark, f"{path}/flights"), CU.load(spark, f"{path}/hotels")


@query("AGG1_kpi_from_cube")
def agg1_cube(spark, d):
    return CU.kpi_row(*_cubes(spark, d), YEARS)


@query("AGG2_AGG11_tabs_from_cube")
def agg_cube(spark, d):
    """Every tab but the KPI row as (tab, label, bookings, value), all from one pair of cubes."""
    f, h = _cubes(spark, d)
    tabs = {
        "AGG2": (CU.monthly_price_by_class(f), ["month", "flightType"], None, "avg_price_inr"),
        "AGG2F": (CU.monthly_price_by_class(f, YEARS, CLASSES), ["month", "flightType"], None, "avg_price_inr"),
        "AGG3": (CU.monthly_bookings(f, YEARS), ["month"], "bookings", None),
        "AGG4": (CU.agency_share(f, YEARS, CLASSES), ["agency"], "bookings", "share"),
        "AGG5": (CU.class_mean_price(f, YEARS), ["flightType"], None, "avg_price_inr"),
        "AGG6": (CU.hotel_monthly_price(h, YEARS), ["month"], None, "avg_price_inr"),
        "AGG7": (CU.hotel_bookings(h), ["name"], "bookings", None),
        "AGG8": (CU.city_mean_price(h), ["city"], None, "avg_price_inr"),
        "AGG9": (CU.stay_lengths(h), ["days"], "stays", None),
        "AGG10": (CU.destinations(f), ["to_city"], "bookings", "avg_price_inr"),
        "AGG11": (CU.top_routes(f, 10), ["route"], "bookings", None),
    }
    out = None
    for tab, (df, label, n, value) in tabs.items():
        rows = df.select(F.lit(tab).alias("tab"), F.concat_ws("|", *[F.col(c).cast("string") for c in label]).alias("label"),
                         (F.col(n) if n else F.lit(None)).cast("long").alias("bookings"), (F.col(value) if value else F.lit(None)).cast("double").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("AGG12_demographics")
def agg12(spark, d):
    return D.demographics(_u(spark, d))


@query("AGG13_gender_split")
def agg13(spark, d):
    return D.gender_split(_u(spark, d))


@query("AGG14_company_users")
def agg14(spark, d):
    return D.company_users(_u(spark, d))


@query("AGG15_age_histogram")
def agg15(spark, d):
    return D.age_histogram(_u(spark, d))


@query("AGG16_spend_by_gender")
def agg16(spark, d):
    return D.spend_by_gender(_f(spark, d), _u(spark, d))


@query("AGG17_hotel_base")
def agg17(spark, d):
    return D.hotel_base(_h(spark, d))


@query("AGG18_route_means")
def agg18(spark, d):
    return D.route_means(_f(spark, d))


# ---------------------------------------------------------------- top-k, sorts, sets
@query("TOP3_modal_destination")
def top3(spark, d):
    return D.top_value(_f(spark, d), "to_city", "top_destination", "top_destination_count")


@query("TOP4_preview")
def top4(spark, d):
    return D.preview(D.filter_years(_f(spark, d), YEARS), "travelCode", 200).select(
        "travelCode", "userCode", "from", "to", "flightType", "price", "agency", "date")


@query("SORT1_routes_by_distance")
def sort1(spark, d):
    return D.sort_by(D.route_means(_f(spark, d)), "avg_distance", ascending=False, tie="from")


@query("SET1_unique_cities")
def set1(spark, d):
    return D.unique_cities(_f(spark, d), _h(spark, d))


# ---------------------------------------------------------------- sampling and features


@query("SMP1_fixed_sample")
def smp1(spark, d):
    return S.fixed_sample(_f(spark, d), "travelCode", 3000).select("travelCode", "distance", "price_inr", "flightType")


@query("SMP2_training_cap")
def smp2(spark, d):
    return S.fixed_sample(_f(spark, d), "travelCode", 10000).select("travelCode")


@query("SMP3_hash_split")
def smp3(spark, d):
    f = _f(spark, d)
    return f.select("travelCode", F.when(S.hash_split_flag("travelCode"), "test").otherwise("train").alias("split"))


@query("SMP4_stratified_split")
def smp4(spark, d):
    u = _u(spark, d).where(F.col("gender").isNotNull())
    return S.stratified_flag(u, "code", "gender").select("code", "gender", "is_test")


@query("SMP4P_stratified_split_payload")
def smp4p(spark, d):
    """The stratified split of whole rows: name and age go with the flag."""
    u = _u(spark, d).where(F.col("gender").isNotNull())
    return S.stratified_flag(u, "code", "gender").select("code", "name", "age", "gender", "is_test")


@query("MDL7_class_weights")
def mdl7(spark, d):
    return S.class_weights(_u(spark, d), "gender")


@query("FEA1_median_impute")
def fea1(spark, d):
    u = _u(spark, d)
    med = FE.fit_medians(u, ["age"])
    return FE.impute(u.select("code", "age"), med, cast_double=True)


@query("FEA2_mode_impute")
def fea2(spark, d):
    u = _u(spark, d)
    x = u.select("code", C.name_features_training("name")["first_name"].alias("first_name"))
    return FE.impute(x, FE.fit_modes(x, ["first_name"]))


@query("FEA3_standard_scale")
def fea3(spark, d):
    u = _u(spark, d)
    (m, s), = FE.fit_standard(u, ["age"]).values()
    return u.select("code", F.round(FE.standardize("age", m, s), 6).alias("age_z"))


@query("FEA6_FEA7_label_codes")
def fea6(spark, d):
    f = _f(spark, d).select("travelCode", "to")
    m = FE.fit_label_encoder(f, "to")
    enc = FE.label_encode(f, "to", m, "to_enc")
    return FE.label_decode(enc, "to_enc", m, "to_decoded")


@query("FEA8_documents_tfidf")
def fea8(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    w, _ = TX.tfidf(docs, "doc_id", "text")
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def _catalogue(spark, d):
    climates = R.climate_table(spark, table(spark, d, "nation", "n_nationkey", "n_name"))
    return R.build_catalogue(_h(spark, d), climates)


@query("REC1_catalogue")
def rec1(spark, d):
    return _catalogue(spark, d)


@query("AGG19_budget_bound")
def agg19(spark, d):
    return D.budget_bound(_catalogue(spark, d))


@query("WIN1_price_rank")
def win1(spark, d):
    c = D.hotel_base(_h(spark, d))
    return global_row_number(c, ["avg_price_per_night", "name", "place"], "price_rank", total="n_hotels") \
        .select("name", "place", "price_rank", "n_hotels")


@query("REC4_FEA8_catalogue_tfidf")
def rec4(spark, d):
    m = R.fit(_catalogue(spark, d))
    return m.weights.select(F.col("doc_id").alias("item_id"), "term", F.round("weight", 6).alias("weight"))


@query("FEA9_catalogue_minmax")
def fea9(spark, d):
    m = R.fit(_catalogue(spark, d))
    return m.items.select("item_id", *[F.round(f"{c}_s", 9).alias(f"{c}_s") for c in R.NUM_COLUMNS])


def _recs(spark, d):
    cat = _catalogue(spark, d)
    reqs = FX.hotel_requests(_f(spark, d))
    return R.recommend(R.fit(cat), reqs), reqs, cat


@query("REC10_recommend")
def rec10(spark, d):
    return _recs(spark, d)[0]


@query("TOP2_bounded_top_k")
def top2_bounded(spark, d):
    """The REC10 rows, from blocks of hotels in order of their score bounds."""
    return R.recommend(R.fit(_catalogue(spark, d)), FX.hotel_requests(_f(spark, d)), bounded=True)


@query("REC11_unknown_destination")
def rec11(spark, d):
    return R.unknown_destinations(FX.hotel_requests(_f(spark, d)), _catalogue(spark, d))


@query("PRJ19_PRJ20_display_records")
def prj19(spark, d):
    recs, reqs, _ = _recs(spark, d)
    return R.display_records(recs, reqs)


@query("EVA6_distinct_result_sets")
def eva6(spark, d):
    return R.distinct_result_sets(_recs(spark, d)[0])


@query("JOIN5_neighbour_cosine")
def join5(spark, d):
    cat = _catalogue(spark, d)
    m = R.fit(cat)
    return R.pair_similarity(m.weights, R.neighbour_pairs(cat))


@query("JOIN5_cosine_pairs")
def join5_pairs(spark, d):
    """All pairs of different catalogue vectors with a cosine of 0.7 or more."""
    return SIM.similar_pairs(SIM.vector_classes(R.fit(_catalogue(spark, d)).weights), 0.7)


@query("JOIN5_top_neighbours")
def join5_top(spark, d):
    return SIM.top_neighbours(SIM.vector_classes(R.fit(_catalogue(spark, d)).weights), 5)


def _place_names(spark, d):
    """Lower-cased names of hotels, their places and cities."""
    return _h(spark, d).select(F.explode(F.array("name", "place", "city")).alias("text")).where("text is not null").select(F.lower("text").alias("text")).distinct()


@query("FLT4_trigram_search")
def flt4_search(spark, d):
    """Names that contain a booked destination, or its last four characters."""
    dest = F.lower(F.trim("destination"))
    terms = FX.hotel_requests(_f(spark, d)).where("destination is not null").select(F.explode(F.array(dest, F.right(dest, F.lit(4)))).alias("term")).distinct()
    hits = TI.containing(TI.build_index(_place_names(spark, d)), terms)
    return hits.groupBy("term").agg(F.count(F.lit(1)).alias("n_names"), F.min("text").alias("first_name"), F.max("text").alias("last_name"))


@query("FLT4_regex_search")
def flt4_regex(spark, d):
    """Names in which an expression made from a booked city finds a match."""
    dest = F.regexp_replace(F.lower(F.trim("destination")), r" ?\(.*$", "")
    forms = F.array(F.concat(F.lit("^"), dest, F.lit("$")), F.concat(dest, F.lit("[0-9]?( |$)")), F.concat(F.lit("(brand|nation).*"), F.right(dest, F.lit(2)), F.lit("+")),
                    F.concat(F.lit("x?zq|"), dest, F.lit(".")))
    patterns = FX.hotel_requests(_f(spark, d)).where("destination is not null").select(F.explode(forms).alias("pattern")).distinct()
    hits = TI.matching(TI.build_index(_place_names(spark, d)), patterns)
    return hits.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_names"), F.min("text").alias("first_name"), F.max("text").alias("last_name"))


@query("SNK4_recommender_metrics")
def snk4(spark, d):
    """Append the fit's parameters and metrics to the run log; return the logged run."""
    m = R.fit(_catalogue(spark, d))
    metrics = R.run_metrics(m).first().asDict()
    runs = f"{_scratch(spark, 'recommender-runs')}/runs"
    ML.log_run(spark, runs, "hotel_recommender", "content_based_tfidf_cosine", R.run_params(m, metrics["num_hotels"]), metrics)
    p, v = F.col("params"), F.col("metrics")
    return spark.read.parquet(runs).select(
        "experiment", "run_name", *[p[k].alias(k) for k in ("text_weight", "num_weight", "tfidf_features", "data_source")],
        p["num_hotels"].cast("long").alias("num_hotels"), v["vocab_size"].cast("long").alias("vocab_size"),
        *[F.round(v[k], 6).alias(k) for k in ("avg_price_per_night", "avg_review_score")])


# ---------------------------------------------------------------- evaluation (SQL form)


ROUTE_CLASS = ["from", "to", "flightType"]


def _flight_split(spark, d):
    return S.train_test_split(_f(spark, d), "travelCode")


@query("EVA1_regression_metrics")
def eva1(spark, d):
    tr, te = _flight_split(spark, d)
    means, overall = EV.group_mean_model(tr, ROUTE_CLASS, "price")
    preds = EV.apply_group_mean(te, means, overall, ROUTE_CLASS)
    return EV.rounded(EV.regression_metrics(preds, "price", "prediction"))


def _user_split(spark, d):
    u = _u(spark, d).withColumn("first_name", C.name_features_training("name")["first_name"])
    return S.stratified_split(u, "code", "gender")


@query("EVA2_classification_metrics")
def eva2(spark, d):
    tr, te = _user_split(spark, d)
    best, overall = EV.majority_model(tr, "first_name", "gender")
    preds = (te.join(best, "first_name", "left")
             .withColumn("prediction", F.coalesce("prediction", overall)))
    return EV.rounded(EV.classification_metrics(preds, "gender", "prediction"))


@query("EVA4_best_of_two")
def eva4(spark, d):
    tr, te = _flight_split(spark, d)
    runs = None
    for name, keys, base in [("route_mean", ["from", "to"], True), ("route_class_mean", ROUTE_CLASS, False)]:
        means, overall = EV.group_mean_model(tr, keys, "price")
        m = EV.regression_metrics(EV.apply_group_mean(te, means, overall, keys), "price", "prediction")
        row = m.select(F.lit(name).alias("model"), F.col("r2").alias("metric"), F.lit(base).alias("is_baseline"))
        runs = row if runs is None else runs.unionByName(row)
    return EV.select_best(runs, "metric", "model", "is_baseline")


# ---------------------------------------------------------------- Spark ML
# Fitted numbers differ between engines, so these jobs return keys, labels and what must hold for each row.
def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tripcast-{name}-{uuid.uuid4().hex[:8]}"


FLIGHT_COLS = ML.FLIGHT_CATEGORICAL + ML.FLIGHT_NUMERIC


def _flight_frames(spark, d):
    feats = ML.flight_features(_f(spark, d))
    flag = S.hash_split_flag("travelCode")
    return feats.where(~flag), feats.where(flag)


# A price is the class's base plus half the distance plus 0-99: a sound model stays within this of it.
PRICE_TOLERANCE = 120.0


def _price_rows(model, te):
    """Key, label, and whether the prediction is within the tolerance of the label."""
    close = F.abs(F.col("prediction") - F.col("label")) <= PRICE_TOLERANCE
    return model.transform(te).select("travelCode", "label", close.alias("within_tolerance"))


def _class_rows(scored, key, label, labels):
    """Key, label, and what must hold for a prediction: a known label, probabilities that sum to 1."""
    p = ML.vector_to_array("probability")
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return scored.select(key, label, F.col("prediction").isin(*[float(i) for i in range(len(labels))]).alias("known_label"),
                         (F.abs(total - 1.0) < 1e-6).alias("probabilities_sum_to_one"))


@query("MDL1_linear_regression")
def mdl1(spark, d):
    tr, te = _flight_frames(spark, d)
    return _price_rows(ML.fit_model(tr, FLIGHT_COLS, ML.linear_regression()), te)


@query("MDL1_merged_statistics")
def mdl1_merged(spark, d):
    """Statistics of twelve parts of the training rows are written, read back and added up; the fit must equal that of all rows at once."""
    tr, te = _flight_frames(spark, d)
    path = f"{_scratch(spark, 'linear')}/statistics"
    numeric, levels = ML.FLIGHT_NUMERIC, ML.FLIGHT_CATEGORICAL
    parts = LS.statistics(tr.withColumn("part", F.pmod(F.xxhash64("travelCode"), F.lit(12))), "part", numeric, levels)
    LS.refresh(parts, path)
    merged = LS.solve(LS.merge(spark.read.parquet(path)), numeric, levels)
    whole = LS.solve(LS.merge(LS.statistics(tr.withColumn("part", F.lit(0)), "part", numeric, levels)), numeric, levels)
    close = F.abs(F.col("prediction") - F.col("label")) <= PRICE_TOLERANCE
    return merged.predict(te).select("travelCode", "label", close.alias("within_tolerance"), F.lit(merged == whole).alias("merged_equals_full"))


@query("MDL2_forest_regressor")
def mdl2(spark, d):
    tr, te = _flight_frames(spark, d)
    return _price_rows(ML.fit_model(tr, FLIGHT_COLS, ML.forest_regressor(), order=ML.FLIGHT_ORDER), te)


def _user_frames(spark, d):
    feats = ML.user_features(_u(spark, d)).where(F.col("label").isNotNull())
    return S.stratified_split(feats, "code", "label")


# The data's rule (first names go with a gender) lets a balanced classifier reach a weighted F1 of about 0.8.
F1_BOUND = 0.6


def _classify(spark, d, estimator_fn):
    tr, te = _user_frames(spark, d)
    model, metrics = ML.train_classifier(tr, te, estimator_fn(tr), ML.USER_FEATURES)
    rows = _class_rows(model.transform(te.where(F.col("label").isNotNull())), "code", "label", model.stages[0].labels)
    return rows.withColumn("f1_above_bound", F.lit(bool(metrics["f1"] >= F1_BOUND)))


@query("MDL3_logistic_regression")
def mdl3(spark, d):
    return _classify(spark, d, lambda tr: ML.logistic_regression(tr.count()))


@query("MDL4_forest_classifier")
def mdl4(spark, d):
    return _classify(spark, d, lambda tr: ML.forest_classifier())


GBT_COLS = [c + "_enc" for c in ML.FLIGHT_CATEGORICAL] + ML.FLIGHT_NUMERIC


def _gbt_features(df, encoders):
    """MDL5 inputs: label-encoded categories (FEA6) + numeric calendar codes (PRJ10)."""
    for c, codes in encoders.items():
        df = FE.label_encode(df, c, codes, c + "_enc")
    return ML.VectorAssembler(inputCols=GBT_COLS, outputCol=ML.FEATURES_COL, handleInvalid="keep").transform(df)


def _fit_gbt(spark, d):
    """(model, encoders, test rows) of the gradient-boosted price model."""
    f = ML.flight_features(_f(spark, d))
    encoders = FE.fit_label_encoders(f, ML.FLIGHT_CATEGORICAL)
    f = _gbt_features(f, encoders)
    flag = S.hash_split_flag("travelCode")
    tr = f.where(~flag)
    ML.require_rows(tr, ML.MIN_ROWS_GBT, "the gradient-boosted price model")
    return ML.fit_dealt(tr, "travelCode", ML.gbt_regressor()), encoders, f.where(flag)


@query("MDL5_gbt_regressor")
def mdl5(spark, d):
    model, _, te = _fit_gbt(spark, d)
    return _price_rows(model, te)


@query("MDL8_feature_importances")
def mdl8(spark, d):
    """Importances, largest first. A price is the class's base plus half the distance plus noise (FIXTURES.md): a sound model
    gives most to the class, then the distance, next to nothing to the rest."""
    imp = ML.importances(_fit_gbt(spark, d)[0], GBT_COLS)
    whole = abs(sum(x for _, x in imp) - 1.0) < 1e-6
    rows = [(c, k + 1 if k < 2 else None, x > 0.5, x < 0.02, whole) for k, (c, x) in enumerate(imp)]
    return spark.createDataFrame(rows, "feature string, place int, above_half boolean, below_two_percent boolean, importances_sum_to_one boolean")


def _above_majority(scored, label, predicted, by):
    """One row: is the accuracy above the share of the most common label by at least ``by``?"""
    n, right = F.sum("n"), F.sum(F.when(F.col(label) == F.col(predicted), F.col("n")))
    pairs = scored.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))
    by_label = pairs.groupBy(label).agg(n.alias("n"), F.coalesce(right, F.lit(0)).alias("right"))
    return by_label.agg((F.sum("right") / n >= F.max("n") / n + by).alias("accuracy_above_majority"))


def _gender_code_frame(spark, d):
    """MDL6 inputs: age, company code, name codes (PRJ9), nulls -> 0; rows without gender or company are left out."""
    u = _u(spark, d).where(F.col("gender").isNotNull() & F.col("company").isNotNull())
    u = FE.label_encode(u, "company", FE.fit_label_encoder(u, "company"), "company_enc")
    u = u.select("code", "gender", F.coalesce("age", F.lit(0)).alias("age"), "company_enc",
                 *[v.alias(k) for k, v in C.name_codes("name").items()])
    return u, ["age", "company_enc", "name_length", "first_letter_enc", "last_letter_enc"]


def _gender_forest(spark, d):
    """(scored rows with label, confidence and probabilities, labels) of the name-code forest."""
    u, cols = _gender_code_frame(spark, d)
    ML.require_rows(u, ML.MIN_ROWS_NAME_FOREST, "the name-code gender forest")
    idx = ML.StringIndexer(inputCol="gender", outputCol="label_idx", stringOrderType="alphabetAsc")
    rf = ML.forest_classifier(weight=None, trees=150, depth=8, min_leaf=1)
    stages = [idx, ML.VectorAssembler(inputCols=cols, outputCol=ML.FEATURES_COL), rf]
    model = ML.fit_dealt(u, "code", rf, lambda rows: ML.Pipeline(stages=stages), cols)
    labels = model.stages[0].labels
    scored = ML.probability_columns(model.transform(u), labels)
    scored = ML.IndexToString(inputCol="prediction", outputCol="predicted_gender", labels=labels).transform(scored)
    return scored, labels


@query("MDL6_MDL9_gender_forest")
def mdl6(spark, d):
    scored, labels = _gender_forest(spark, d)
    top = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, x: F.greatest(a, x))
    total = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, x: a + x)
    sound = _above_majority(scored, "gender", "predicted_gender", 0.2)
    return scored.crossJoin(F.broadcast(sound)).select(  # one row
        "code", "gender", F.col("predicted_gender").isin(*labels).alias("known_label"), (F.col("confidence") == top).alias("confidence_is_top"),
        (F.element_at("probabilities", F.col("predicted_gender")) == F.col("confidence")).alias("confidence_is_the_label_s"),
        (F.abs(total - 1.0) < 1e-3).alias("probabilities_sum_to_one"), "accuracy_above_majority")


@query("EVA3_EVA5_SNK1_SNK3_train_save_evaluate")
def eva3(spark, d):
    """Train both regressors, log runs, keep the better, save, reload, evaluate on the full table."""
    tr, te = _flight_frames(spark, d)
    root = _scratch(spark, "runs")
    results = {}
    for name, est in [("LinearRegression", ML.linear_regression()), ("RandomForest", ML.forest_regressor())]:
        model, m = ML.train_regressor(tr, te, est, FLIGHT_COLS, ML.FLIGHT_ORDER)
        ML.log_run(spark, f"{root}/runs", "flight_price", name, ML.model_params(model), m)
        results[name] = model
    runs = spark.read.parquet(f"{root}/runs")
    best = ML.best_run(runs, "r2", "LinearRegression").first()
    path = ML.save_model(results[best["selected_model"]], f"{root}/model")
    full = ML.flight_features(_f(spark, d))
    m = EV.regression_metrics(ML.load_model(path).transform(full))
    rows = full.agg(F.count(F.lit(1))).scalar()
    return m.select(F.lit(best["selected_model"] in results).alias("selected_a_run"), rows.alias("evaluated_rows"),
                    (F.col("r2") > 0.99).alias("r2_above_bound"), (F.col("rmse") < 50.0).alias("rmse_below_bound"),
                    (F.col("mae") <= F.col("rmse")).alias("mae_within_rmse"), F.lit(runs.count()).cast("long").alias("logged_runs"))


# ---------------------------------------------------------------- scoring
def _flight_requests(spark, d):
    raw = L.load_flights_raw(spark, d)
    t = L.type_flights(raw.withColumn("raw_date", F.col("date")))
    cal = C.calendar_codes("date")
    return t.select("travelCode", *ML.FLIGHT_CATEGORICAL, "distance", "time", *[v.alias(k) for k, v in cal.items()],
                    F.col("date").isNotNull().alias("date_ok"), "raw_date")


def _request_bodies(spark, d):
    flights = SC.flight_request_text(_flight_requests(spark, d)).withColumn("source", F.lit("flights"))
    events = table(spark, d, "events", "event_id", "props").select(
        F.col("event_id").alias("request_id"), F.col("props").alias("body"), F.lit("events").alias("source"))
    return flights.unionByName(events)


@query("SCR4_FLT6_SRC7_request_routing")
def scr4(spark, d):
    routed = SC.route_requests(_request_bodies(spark, d))
    return routed.select("source", "request_id", "status", "message")


@query("SCR4_stream_once")
def scr4_once(spark, d):
    """The requests are delivered twice, in two files' worth and two runs of the stream; each is answered once."""
    path = _scratch(spark, "stream")
    bodies = _request_bodies(spark, d)
    for _ in range(2):
        bodies.write.mode("append").parquet(f"{path}/in")
        SC.run_stream(spark, lambda s: SC.route_requests(SC.once(s)).select("source", "request_id", "status", "message"),
                      bodies.schema, f"{path}/in", f"{path}/out", f"{path}/progress", fmt="parquet")
    return spark.read.parquet(f"{path}/out")


# What a price is made of in the data (FIXTURES.md): half the distance, the class's base and 0-99.
CLASS_BASE = {"firstClass": 1500.0, "premium": 700.0, "economic": 280.0}


def _price_ok(price, fields):
    """The price is near the middle of what its route and class cost; null without a price."""
    base = F.coalesce(*[F.when(fields["flightType"] == k, F.lit(v)) for k, v in CLASS_BASE.items()])
    return F.when(price.isNotNull(), F.abs(price - (fields["distance"] / 2 + base + 49.5)) <= PRICE_TOLERANCE)


def _echo(fields):
    return F.concat_ws("|", *[fields[c] for c in ML.FLIGHT_CATEGORICAL])


def _routed_flights(spark, d):
    return SC.route_requests(_request_bodies(spark, d)).select("source", "request_id", "status", "message", "req.*")


@query("SCR1_price_scoring")
def scr1(spark, d):
    """One answer per request: a price for valid ones, status and message for the others."""
    tr, _ = _flight_frames(spark, d)
    model = ML.fit_model(tr, FLIGHT_COLS, ML.linear_regression())
    got = SC.score_prices(model, _routed_flights(spark, d))
    echo = F.col("input_received")
    return got.select("source", "request_id", "status", "message", "currency", "model_version", _echo(echo).alias("input_received"),
                      _price_ok(F.col("predicted_price"), echo).alias("price_ok"))


@query("SCR2_class_scoring")
def scr2(spark, d):
    tr, _ = _user_frames(spark, d)
    weights = S.class_weights(tr, "label")
    tr = tr.join(weights.select("label", "class_weight"), "label")
    idx = ML.StringIndexer(inputCol="label", outputCol="label_idx", stringOrderType="alphabetAsc")
    model = ML.fit_model(tr, ML.USER_FEATURES, ML.logistic_regression(tr.count()), head=[idx], key="code")
    labels = model.stages[0].labels
    routed = SC.route_classify_requests(_classify_bodies(spark, d))
    got = SC.score_classes(model, routed.select("request_id", "status", "message", "req.*"), labels, ML.USER_FEATURES)
    total = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, x: a + x)
    truth = _u(spark, d).select(F.col("code").alias("request_id"), "gender")
    sound = _above_majority(got.join(truth, "request_id"), "gender", "predicted_gender", 0.2)
    return got.crossJoin(F.broadcast(sound)).select(  # one row
        "request_id", "status", "message", "model_version", F.col("predicted_gender").isin(*labels).alias("known_label"),
        (F.element_at("probabilities", F.col("predicted_gender")) == F.col("confidence")).alias("confidence_is_the_label_s"),
        (F.abs(total - 1.0) < 1e-3).alias("probabilities_sum_to_one"), "accuracy_above_majority", F.col("input_received.first_name").alias("input_first_name"))


def _hotel_bodies(spark, d):
    """Hotel request bodies: JSON, and every 97th malformed, every 89th empty."""
    reqs = FX.hotel_requests(_f(spark, d))
    key = F.col("request_id")
    body = F.to_json(F.struct(*[f.name for f in HOTEL_REQUEST.fields]))
    return reqs.select("request_id", F.when(key % 97 == 0, "not json").when(key % 89 == 0, "{}").otherwise(body).alias("body"))


@query("FLT6_hotel_request_routing")
def flt6_hotel(spark, d):
    return SC.route_hotel_requests(_hotel_bodies(spark, d)).select("request_id", "status", "message")


@query("SCR3_recommendation_responses")
def scr3(spark, d):
    model = R.fit(_catalogue(spark, d))
    got = SC.recommendation_responses(SC.route_hotel_requests(_hotel_bodies(spark, d)), lambda reqs: R.recommend(model, reqs))
    recs = F.col("recommendations")
    return got.select("request_id", "status", "message", "n_results", F.array_join(F.transform(recs, lambda r: r["name"]), "|").alias("hotels"),
                      F.get(recs, 0)["match_score"].alias("best_match"), "model_version", F.col("input_received.destination").alias("input_destination"))


@query("SCR5_fallback_scoring")
def scr5(spark, d):
    """The primary model answers all but one agency's requests (an outage); the gradient-boosted model answers the rest."""
    routed = _routed_flights(spark, d).where(F.col("source") == "flights").drop("source")
    tr, _ = _flight_frames(spark, d)
    primary = ML.fit_model(tr, FLIGHT_COLS, ML.linear_regression())
    model, encoders, _ = _fit_gbt(spark, d)
    first = SC.score_prices(primary, routed.withColumn("ok", F.col("status") == "valid"))
    fields = first.select("*", "input_received.*")
    second = model.transform(_gbt_features(fields, encoders))
    reached = F.when(F.col("agency") != "CloudFy", F.col("predicted_price"))
    got = second.select("request_id", "status", "message", F.struct("flightType", "distance").alias("f"),
                        *[v.alias(k) for k, v in SC.with_fallback(reached, F.round("prediction", 2), F.col("ok")).items()])
    return got.select("request_id", "status", "message", "source", "model_version", _price_ok(F.col("predicted_price"), F.col("f")).alias("price_ok"))


# ---------------------------------------------------------------- sinks
@query("SNK5_SNK6_SNK7_persist_and_reload")
def snk5(spark, d):
    """Write the catalogue (CSV), the neighbour similarities (parquet) and the model tables; read them back."""
    cat = _catalogue(spark, d)
    m = R.fit(cat)
    root = _scratch(spark, "recommender")
    cat.write.mode("overwrite").option("header", True).csv(f"{root}/fitted_hotels")
    R.pair_similarity(m.weights, R.neighbour_pairs(cat)).write.mode("overwrite").parquet(f"{root}/similarity")
    R.save(m, f"{root}/model")
    back = R.load(spark, f"{root}/model")
    best = R.recommend(back, FX.hotel_requests(_f(spark, d))).where("rank = 1").groupBy("name").agg(F.count(F.lit(1)).alias("n_first"))
    hotels = spark.read.option("header", True).schema(cat.schema).csv(f"{root}/fitted_hotels")
    similar = spark.read.parquet(f"{root}/similarity").select(F.col("item_a").alias("price_rank"), "item_b", "cosine")
    return (hotels.select("price_rank", "name", "location", "avg_price_per_night", "amenities").join(similar, "price_rank", "left")
            .join(best, "name", "left").withColumn("n_first", F.coalesce("n_first", F.lit(0))))


@query("SNK7_reloaded_recommender")
def snk7(spark, d):
    """A saved and reloaded recommender gives the rows of the fitted one."""
    root = _scratch(spark, "recommender")
    R.save(R.fit(_catalogue(spark, d)), f"{root}/model")
    return R.recommend(R.load(spark, f"{root}/model"), FX.hotel_requests(_f(spark, d)))


# ---------------------------------------------------------------- remaining projections and sources
@query("PRJ11_user_features_and_label")
def prj11(spark, d):
    u = C.drop_ids(_u(spark, d), C.USER_ID_COLUMNS)
    feats = C.name_features_training("name")
    return u.select("company", "age", *[v.alias(k) for k, v in feats.items()], F.col("gender").alias("label"))


@query("PRJ15_amenity_labels")
def prj15(spark, d):
    cat = _catalogue(spark, d)
    labels = C.amenity_labels(F.split("amenities", " "))
    return cat.select("price_rank", F.array_join(labels, ", ").alias("amenity_labels"),
                      F.array_join(C.amenity_tokens(labels), " ").alias("round_trip"))


@query("PRJ18_confidence_band")
def prj18(spark, d):
    """Majority-gender share per company as a confidence, banded."""
    counts = D.value_counts(_u(spark, d), ["company", "gender"], "n")
    per = counts.groupBy("company").agg((F.max("n") / F.sum("n")).alias("confidence"))
    return per.withColumn("band", C.confidence_band("confidence"))


@query("PRJ23_city_climate")
def prj23(spark, d):
    cities = _h(spark, d).select("city").where(F.col("city").isNotNull()).distinct()
    climates = R.climate_table(spark, table(spark, d, "nation", "n_nationkey", "n_name"))
    return (cities.join(climates.dropDuplicates(["city"]), "city", "left")
            .withColumn("climate", F.coalesce("climate", F.lit(R.DEFAULT_CLIMATE))))


@query("SRC5_optional_sources")
def src5(spark, d):
    """Driver tables through the optional loader; a missing file yields no frame and a demo badge."""
    from ..sources import schemas as SCH
    from ..sources.tables import DRIVER_TABLES
    found = {}
    for name in ["orders", "customer", "lineitem", "hotels_missing"]:
        path = f"{d.rstrip('/')}/{name}.parquet"
        schema = spark.read.parquet(path).schema if name in DRIVER_TABLES else SCH.HOTELS
        found[name] = L.load_optional(spark, path, schema, fmt="parquet")
    live = D.source_badges(found)
    missing = [n for n, df in found.items() if df is None]
    if not missing:
        return live
    demo = literal_frame(spark, [(n, 0, False) for n in missing], ["source", "rows", "is_live"])
    return live.unionByName(demo.withColumn("rows", F.col("rows").cast("long")))


def _classify_bodies(spark, d):
    """Classify request bodies built from users (serving name form)."""
    u = _u(spark, d)
    first = C.name_features_training("name")["first_name"]
    feats = C.name_features_serving(F.coalesce(first, F.lit("")))
    body = F.to_json(F.struct(feats["first_name"].alias("first_name"), F.col("company"),
                              feats["first_letter"].alias("first_letter"), feats["last_letter"].alias("last_letter"),
                              feats["name_length"].alias("name_length"), F.col("age")))
    return u.select(F.col("code").alias("request_id"), body.alias("body"))


@query("FLT6_classify_request_routing")
def flt6(spark, d):
    """Empty names are rejected; the job keeps going."""
    routed = SC.route_classify_requests(_classify_bodies(spark, d))
    return routed.select("request_id", "status", "message")


# ---------------------------------------------------------------- skewed labels (documents / labels)
def _labels(spark, d):
    return table(spark, d, "labels", "doc_id", "quality", "toxic")


@query("SMP4L_labels_stratified_split")
def smp4l(spark, d):
    """Stratified split on a skewed binary label (about one toxic document in eight)."""
    lab = _labels(spark, d).where(F.col("toxic").isNotNull())
    return S.stratified_flag(lab, "doc_id", "toxic").select("doc_id", "toxic", "is_test")


@query("MDL7L_labels_class_weights")
def mdl7l(spark, d):
    return S.class_weights(_labels(spark, d), "toxic")


@query("EVA2L_labels_quality_metrics")
def eva2l(spark, d):
    """Majority quality per document source (train split) scored on the stratified test split."""
    docs = table(spark, d, "documents", "doc_id", "source")
    lab = _labels(spark, d).join(docs, "doc_id", "left")
    tr, te = S.stratified_split(lab, "doc_id", "quality")
    best, overall = EV.majority_model(tr, "source", "quality")
    preds = te.join(best, "source", "left").withColumn("prediction", F.coalesce("prediction", overall))
    return EV.rounded(EV.classification_metrics(preds, "quality", "prediction"))
