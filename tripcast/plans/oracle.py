"""DuckDB oracle text for every SQL-expressible query of ``plans.catalog``.

Each value is a complete DuckDB statement over the pre-registered driver
views; it starts with the shared travel views of ``oracle_views``. Integer
sums are cast back to BIGINT so result types match Spark's.
"""

from __future__ import annotations

from .oracle_views import with_views

YEARS_SQL = "(1996, 1998)"
CLASSES_SQL = "('premium', 'firstClass')"
MONTH = "CAST(date_trunc('month', \"date\") AS DATE)"

SQL: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    SQL[name] = with_views(text)


# ---------------------------------------------------------------- sources
sql("SRC1_flights_raw", "SELECT * FROM flights")
sql("SRC2_users_raw", "SELECT * FROM users")
sql("SRC3_flights_typed", "SELECT * FROM tflights")
sql("SRC4_hotels_typed", "SELECT * FROM thotels")

# ---------------------------------------------------------------- profiling
_user_cols = {"code": "bigint", "company": "string", "name": "string", "gender": "string", "age": "int"}
sql("PRF1_users_summary", " UNION ALL ".join(
    f"SELECT 'users' AS table_name, count(*) AS row_count, '{c}' AS column_name, "
    f"'{t}' AS dtype, count(*) - count({c}) AS null_count FROM users" for c, t in _user_cols.items()))

sql("PRF2_gender_distribution", """
SELECT gender, n, CAST(n AS DOUBLE) * 100.0 / sum(n) OVER () AS pct
FROM (SELECT gender, count(*) AS n FROM users WHERE gender IS NOT NULL GROUP BY gender)
""")

sql("PRF3_source_badges", """
SELECT 'flights.csv' AS source, count(*) AS "rows", true AS is_live FROM flights
UNION ALL SELECT 'hotels.csv', count(*), true FROM hotels
UNION ALL SELECT 'users.csv', count(*), true FROM users
""")

sql("PRF4_home_stats", """
SELECT (SELECT count(DISTINCT name) FROM hotels) AS distinct_hotels,
       (SELECT count(*) FROM flights) + (SELECT count(*) FROM hotels) + (SELECT count(*) FROM users) AS total_records
""")

# ---------------------------------------------------------------- projections
sql("PRJ1_drop_ids", 'SELECT "from", "to", flightType, price, "time", distance, agency, "date" FROM flights')

sql("PRJ2_lenient_dates",
    "SELECT travelCode, \"date\", CAST(try_strptime(\"date\", '%m/%d/%Y') AS DATE) AS parsed FROM flights")

sql("PRJ3_strict_calendar", """
SELECT travelCode, days, name,
       CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day, dayname(d) AS weekday
FROM (SELECT *, CAST(strptime("date", '%m/%d/%Y') AS DATE) AS d FROM hotels)
""")

sql("PRJ4_to_inr", """
SELECT travelCode, days, name, price, total,
       round_even(price * 83.0, 0) AS price_inr, round_even(total * 83.0, 0) AS total_inr
FROM hotels
""")

sql("PRJ5_PRJ6_place_parts", """
SELECT DISTINCT place, city, state_code FROM thotels
""")

_FIRST = r"nullif(regexp_extract(name, '(\S+)', 1), '')"
sql("PRJ7_name_features_training", f"""
SELECT code, first_name, CAST(length(first_name) AS INTEGER) AS name_length,
       left(first_name, 1) AS first_letter, right(first_name, 1) AS last_letter
FROM (SELECT code, {_FIRST} AS first_name FROM users)
""")

sql("PRJ8_name_features_serving", f"""
SELECT code, c AS first_name, CAST(length(c) AS INTEGER) AS name_length,
       upper(left(c, 1)) AS first_letter, lower(right(c, 1)) AS last_letter
FROM (SELECT code, trim({_FIRST}) AS c FROM users)
""")

sql("PRJ9_name_codes", r"""
SELECT code,
       CASE WHEN n = '' THEN 0 ELSE CAST(length(t) AS INTEGER) END AS name_length,
       CASE WHEN n = '' THEN 0 ELSE ascii(upper(left(n, 1))) - 65 END AS first_letter_enc,
       CASE WHEN n = '' THEN 0 ELSE ascii(lower(right(t, 1))) - 97 END AS last_letter_enc
FROM (SELECT code, coalesce(name, '') AS n, regexp_extract(coalesce(name, ''), '(\S+)', 1) AS t FROM users)
""")

sql("PRJ10_calendar_codes", """
SELECT travelCode,
       CAST(coalesce(day("date"), 15) AS INTEGER) AS day,
       CAST(coalesce(month("date"), 6) AS INTEGER) AS month,
       CAST(coalesce(isodow("date") - 1, 2) AS INTEGER) AS weekday
FROM tflights
""")

sql("PRJ12_flight_type_labels", """
SELECT flightType, label,
       CASE label WHEN 'Economy' THEN 'economic' WHEN 'Premium' THEN 'premium' WHEN 'First Class' THEN 'firstClass' END AS round_trip
FROM (SELECT DISTINCT flightType,
             CASE flightType WHEN 'economic' THEN 'Economy' WHEN 'premium' THEN 'Premium'
                             WHEN 'firstClass' THEN 'First Class' END AS label FROM flights)
""")

sql("PRJ13_fmt_inr", """
SELECT travelCode, '₹' || format('{:,}', CAST(round_even(price * 83.0, 0) AS BIGINT)) AS price_fmt FROM flights
""")

sql("PRJ17_price_band", "SELECT travelCode, price_inr * 0.88 AS price_low, price_inr * 1.18 AS price_high FROM tflights")

_AGE_BAND = """CASE WHEN age >= 18 AND age < 25 THEN '18–24' WHEN age >= 25 AND age < 35 THEN '25–34'
     WHEN age >= 35 AND age < 45 THEN '35–44' WHEN age >= 45 AND age < 55 THEN '45–54'
     WHEN age >= 55 AND age < 65 THEN '55–64' WHEN age >= 65 AND age < 100 THEN '65+' END"""
sql("PRJ21_age_band", f"SELECT code, age, {_AGE_BAND} AS age_group FROM users")

sql("PRJ22_month_start", f"SELECT travelCode, {MONTH} AS month FROM tflights")

# ---------------------------------------------------------------- filters
sql("FLT1_year_filter", f'SELECT travelCode, "date", price_inr FROM tflights WHERE year("date") IN {YEARS_SQL}')
sql("FLT2_class_filter", f"""
SELECT travelCode, flightType, price_inr FROM tflights
WHERE year("date") IN {YEARS_SQL} AND flightType IN {CLASSES_SQL}
""")
sql("FLT5_company_members", """
SELECT code, company FROM users
WHERE company IN (SELECT company FROM users WHERE company IS NOT NULL)
""")
sql("FLT7_option_lists", """
SELECT DISTINCT option, value FROM (
  SELECT 'year' AS option, CAST(year("date") AS VARCHAR) AS value FROM tflights
  UNION ALL SELECT 'flightType', flightType FROM tflights
  UNION ALL SELECT 'from', "from" FROM tflights
  UNION ALL SELECT 'agency', agency FROM tflights
  UNION ALL SELECT 'company', company FROM users
) WHERE value IS NOT NULL
""")

# ---------------------------------------------------------------- joins
sql("JOIN1_flights_users", """
SELECT f.*, u.company, u.name AS name_user, u.gender, u.age
FROM tflights f LEFT JOIN users u ON f.userCode = u.code
""")
sql("JOIN2_hotels_users", """
SELECT h.*, u.company, u.name AS name_user, u.gender, u.age
FROM thotels h LEFT JOIN users u ON h.userCode = u.code
""")
SQL["JOIN1_colocated"] = SQL["JOIN1_flights_users"]
SQL["JOIN2_colocated"] = SQL["JOIN2_hotels_users"]
sql("JOIN4_route_lookup", """
, rm AS (SELECT "from", "to", avg(distance) AS avg_distance, avg("time") AS avg_time
         FROM tflights WHERE "from" IS NOT NULL AND "to" IS NOT NULL GROUP BY "from", "to")
SELECT r.travelCode, r."from", r."to",
       coalesce(rm.avg_distance, 500.0) AS distance, coalesce(rm.avg_time, 1.2) AS "time",
       rm.avg_distance IS NOT NULL AS route_known
FROM (SELECT travelCode, "to" AS "from", "from" AS "to" FROM tflights) r
LEFT JOIN rm ON r."from" = rm."from" AND r."to" = rm."to"
""")

# ---------------------------------------------------------------- aggregates
sql("AGG1_kpi_row", f"""
, f AS (SELECT * FROM tflights WHERE year("date") IN {YEARS_SQL}),
fa AS (SELECT count(*) AS n_flights, avg(price_inr) AS avg_flight_inr FROM f),
td AS (SELECT to_city AS top_destination, count(*) AS top_destination_count FROM f
       WHERE to_city IS NOT NULL GROUP BY to_city ORDER BY 2 DESC, 1 LIMIT 1),
ha AS (SELECT count(*) AS n_hotels, avg(price_inr) AS avg_hotel_inr, sum(total_inr) AS hotel_revenue_inr FROM thotels)
SELECT n_flights + n_hotels AS total_bookings, avg_flight_inr, top_destination, top_destination_count,
       avg_hotel_inr, hotel_revenue_inr, format('{{:,.2f}}', hotel_revenue_inr / 1e7) AS hotel_revenue_crore
FROM fa, td, ha
""")

_AGG2 = f"""
SELECT month, flightType, avg(price_inr) AS avg_price_inr
FROM (SELECT {MONTH} AS month, flightType, price_inr FROM tflights {{where}})
WHERE month IS NOT NULL AND flightType IS NOT NULL GROUP BY month, flightType
"""
sql("AGG2_monthly_price_by_class", _AGG2.format(where=""))
sql("AGG2F_monthly_price_filtered",
    _AGG2.format(where=f'WHERE year("date") IN {YEARS_SQL} AND flightType IN {CLASSES_SQL}'))

sql("AGG3_monthly_bookings", f"""
SELECT month, count(*) AS bookings
FROM (SELECT {MONTH} AS month FROM tflights WHERE year("date") IN {YEARS_SQL})
WHERE month IS NOT NULL GROUP BY month
""")

sql("AGG4_agency_share", f"""
SELECT agency, bookings, bookings / sum(bookings) OVER () AS share,
       CAST(sum(bookings) OVER () AS BIGINT) AS total
FROM (SELECT agency, count(*) AS bookings FROM tflights
      WHERE year("date") IN {YEARS_SQL} AND flightType IN {CLASSES_SQL} AND agency IS NOT NULL GROUP BY agency)
""")

sql("AGG5_class_mean_price", f"""
SELECT flightType, avg(price_inr) AS avg_price_inr FROM tflights
WHERE year("date") IN {YEARS_SQL} AND flightType IS NOT NULL GROUP BY flightType
""")

sql("AGG6_hotel_monthly_price", f"""
SELECT month, avg(price_inr) AS avg_price_inr
FROM (SELECT {MONTH} AS month, price_inr FROM thotels WHERE year("date") IN {YEARS_SQL})
WHERE month IS NOT NULL GROUP BY month
""")

sql("AGG7_hotel_bookings", "SELECT name, count(*) AS bookings FROM thotels WHERE name IS NOT NULL GROUP BY name")
sql("AGG8_city_mean_price", "SELECT city, avg(price_inr) AS avg_price_inr FROM thotels WHERE city IS NOT NULL GROUP BY city")
sql("AGG9_stay_lengths", "SELECT days, count(*) AS stays FROM thotels WHERE days IS NOT NULL GROUP BY days")
sql("AGG10_JOIN3_destinations", """
SELECT to_city, count(*) AS bookings, avg(price_inr) AS avg_price_inr
FROM tflights WHERE to_city IS NOT NULL GROUP BY to_city
""")
sql("AGG11_TOP1_top_routes", """
SELECT from_city, to_city, bookings, from_city || ' → ' || to_city AS route
FROM (SELECT from_city, to_city, count(*) AS bookings FROM tflights
      WHERE from_city IS NOT NULL AND to_city IS NOT NULL GROUP BY from_city, to_city)
ORDER BY bookings DESC, from_city, to_city LIMIT 10
""")
SQL["AGG1_kpi_from_cube"] = SQL["AGG1_kpi_row"]
SQL["AGG2_AGG11_tabs_from_cube"] = " UNION ALL ".join(
    f"SELECT '{tab}' AS tab, {label} AS label, CAST({n} AS BIGINT) AS bookings, CAST({value} AS DOUBLE) AS value FROM ({SQL[name]})"
    for tab, name, label, n, value in [
        ("AGG2", "AGG2_monthly_price_by_class", "concat_ws('|', CAST(month AS DATE), flightType)", "NULL", "avg_price_inr"),
        ("AGG2F", "AGG2F_monthly_price_filtered", "concat_ws('|', CAST(month AS DATE), flightType)", "NULL", "avg_price_inr"),
        ("AGG3", "AGG3_monthly_bookings", "CAST(CAST(month AS DATE) AS VARCHAR)", "bookings", "NULL"),
        ("AGG4", "AGG4_agency_share", "agency", "bookings", "share"),
        ("AGG5", "AGG5_class_mean_price", "flightType", "NULL", "avg_price_inr"),
        ("AGG6", "AGG6_hotel_monthly_price", "CAST(CAST(month AS DATE) AS VARCHAR)", "NULL", "avg_price_inr"),
        ("AGG7", "AGG7_hotel_bookings", "name", "bookings", "NULL"),
        ("AGG8", "AGG8_city_mean_price", "city", "NULL", "avg_price_inr"),
        ("AGG9", "AGG9_stay_lengths", "CAST(days AS VARCHAR)", "stays", "NULL"),
        ("AGG10", "AGG10_JOIN3_destinations", "to_city", "bookings", "avg_price_inr"),
        ("AGG11", "AGG11_TOP1_top_routes", "route", "bookings", "NULL")])
sql("AGG12_demographics", f"""
SELECT age_group, gender, count(*) AS users
FROM (SELECT {_AGE_BAND} AS age_group, gender FROM users)
WHERE age_group IS NOT NULL AND gender IS NOT NULL GROUP BY age_group, gender
""")
sql("AGG13_gender_split", """
SELECT gender, users, users / sum(users) OVER () AS share, CAST(sum(users) OVER () AS BIGINT) AS total
FROM (SELECT gender, count(*) AS users FROM users WHERE gender IS NOT NULL GROUP BY gender)
""")
sql("AGG14_company_users", "SELECT company, count(*) AS users FROM users WHERE company IS NOT NULL GROUP BY company")
sql("AGG15_age_histogram", """
, a AS (SELECT age FROM users WHERE age IS NOT NULL),
mm AS (SELECT min(age) AS lo, greatest(1, CAST(ceil((max(age) - min(age) + 1) / 20.0) AS INTEGER)) AS w FROM a)
SELECT bin, bin * w + lo AS bin_start, bin * w + lo + w AS bin_end, count(*) AS users
FROM (SELECT CAST(floor((age - lo) / w) AS INTEGER) AS bin, lo, w FROM a, mm)
GROUP BY bin, lo, w
""")
sql("AGG16_spend_by_gender", """
SELECT u.gender, avg(f.price_inr) AS avg_price_inr
FROM tflights f LEFT JOIN users u ON f.userCode = u.code
WHERE u.gender IS NOT NULL AND f.price_inr IS NOT NULL GROUP BY u.gender
""")
sql("AGG17_hotel_base", """
SELECT name, place, city, avg(price) AS avg_price_per_night, count(price) AS bookings
FROM thotels WHERE name IS NOT NULL AND place IS NOT NULL AND city IS NOT NULL GROUP BY name, place, city
""")
sql("AGG18_route_means", """
SELECT "from", "to", avg(distance) AS avg_distance, avg("time") AS avg_time
FROM tflights WHERE "from" IS NOT NULL AND "to" IS NOT NULL GROUP BY "from", "to"
""")

# ---------------------------------------------------------------- top-k, sorts, sets
sql("TOP3_modal_destination", """
SELECT to_city AS top_destination, count(*) AS top_destination_count FROM tflights
WHERE to_city IS NOT NULL GROUP BY to_city ORDER BY 2 DESC, 1 LIMIT 1
""")
sql("TOP4_preview", f"""
SELECT travelCode, userCode, "from", "to", flightType, price, agency, "date" FROM tflights
WHERE year("date") IN {YEARS_SQL} ORDER BY travelCode LIMIT 200
""")
sql("SORT1_routes_by_distance", """
SELECT "from", "to", avg(distance) AS avg_distance, avg("time") AS avg_time
FROM tflights WHERE "from" IS NOT NULL AND "to" IS NOT NULL GROUP BY "from", "to"
ORDER BY avg_distance DESC, "from"
""")
sql("SET1_unique_cities", """
SELECT DISTINCT city FROM (
  SELECT from_city AS city FROM tflights UNION ALL SELECT to_city FROM tflights UNION ALL SELECT city FROM thotels
) WHERE city IS NOT NULL ORDER BY city
""")

# ---------------------------------------------------------------- sampling
_H = "md5('42|' || CAST({k} AS VARCHAR))"
sql("SMP1_fixed_sample", f"""
SELECT travelCode, distance, price_inr, flightType FROM tflights
ORDER BY {_H.format(k='travelCode')}, travelCode LIMIT 3000
""")
sql("SMP2_training_cap", f"SELECT travelCode FROM tflights ORDER BY {_H.format(k='travelCode')}, travelCode LIMIT 10000")
sql("SMP3_hash_split", f"""
SELECT travelCode, CASE WHEN substr({_H.format(k='travelCode')}, 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS split
FROM tflights
""")
sql("SMP4_stratified_split", f"""
SELECT code, gender,
       row_number() OVER (PARTITION BY gender ORDER BY {_H.format(k='code')}, code) - 1
         < ceil(count(*) OVER (PARTITION BY gender) * 0.2) AS is_test
FROM users WHERE gender IS NOT NULL
""")
sql("SMP4P_stratified_split_payload", f"""
SELECT code, name, age, gender,
       row_number() OVER (PARTITION BY gender ORDER BY {_H.format(k='code')}, code) - 1
         < ceil(count(*) OVER (PARTITION BY gender) * 0.2) AS is_test
FROM users WHERE gender IS NOT NULL
""")
sql("MDL7_class_weights", """
SELECT gender, n_c, sum(n_c) OVER () / (count(*) OVER () * n_c) AS class_weight
FROM (SELECT gender, count(*) AS n_c FROM users WHERE gender IS NOT NULL GROUP BY gender)
""")

# ---------------------------------------------------------------- features
sql("FEA1_median_impute", """
SELECT code, coalesce(CAST(age AS DOUBLE), (SELECT median(age) FROM users)) AS age FROM users
""")
sql("FEA2_mode_impute", f"""
, x AS (SELECT code, {_FIRST} AS first_name FROM users),
m AS (SELECT first_name FROM x WHERE first_name IS NOT NULL GROUP BY first_name ORDER BY count(*) DESC, first_name LIMIT 1)
SELECT code, coalesce(x.first_name, (SELECT first_name FROM m)) AS first_name FROM x
""")
sql("FEA3_standard_scale", """
SELECT code, round((age - (SELECT avg(age) FROM users)) / (SELECT stddev_pop(age) FROM users), 6) AS age_z FROM users
""")
sql("FEA6_FEA7_label_codes", """
, m AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code
        FROM (SELECT DISTINCT "to" AS value FROM tflights WHERE "to" IS NOT NULL))
SELECT f."to", f.travelCode, coalesce(m.code, 0) AS to_enc, m2.value AS to_decoded
FROM tflights f LEFT JOIN m ON f."to" = m.value LEFT JOIN m m2 ON coalesce(m.code, 0) = m2.code
""")

_TOKEN = r"'[\p{L}\p{N}_]{2,}'"


def _tfidf(docs_cte: str) -> str:
    """CTEs tf, vocab, iw over a ``docs(doc_id, txt)`` CTE."""
    return f"""
, docs AS ({docs_cte}),
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(txt, '')), {_TOKEN})) AS term FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY doc_id, term),
vocab AS (SELECT term, ln(CAST(1 + (SELECT count(*) FROM docs) AS DOUBLE) / CAST(df + 1 AS DOUBLE)) + 1.0 AS idf
          FROM (SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT 500)),
iw AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight
       FROM (SELECT doc_id, term, tf * idf AS w FROM tf JOIN vocab USING (term)))
"""


sql("FEA8_documents_tfidf", _tfidf("SELECT doc_id, text AS txt FROM documents")
    + "SELECT doc_id, term, round(weight, 6) AS weight FROM iw")

# ---------------------------------------------------------------- recommender
_CAT = """
, base AS (SELECT name, place, city, avg(price) AS ap, count(price) AS bookings FROM thotels
           WHERE name IS NOT NULL AND place IS NOT NULL AND city IS NOT NULL GROUP BY name, place, city),
ranked AS (SELECT *, row_number() OVER (ORDER BY ap, name, place) - 1 AS price_rank, count(*) OVER () AS n_hotels FROM base),
clim AS (SELECT * FROM (VALUES ('Florianopolis', 'coastal'), ('Salvador', 'tropical'), ('Natal', 'tropical'),
                               ('Aracaju', 'tropical'), ('Recife', 'tropical'), ('Sao Paulo', 'temperate'),
                               ('Campo Grande', 'temperate'), ('Rio de Janeiro', 'coastal'), ('Brasilia', 'temperate')) t(city, climate)
         UNION ALL SELECT replace(n_name, '_', ' '), (['coastal', 'tropical', 'temperate'])[n_nationkey % 3 + 1] FROM nation),
t1 AS (SELECT r.*, coalesce(c.climate, 'tropical') AS climate, price_rank / greatest(1, n_hotels - 1) AS tier
       FROM ranked r LEFT JOIN clim c ON r.city = c.city),
t2 AS (SELECT *,
         CASE WHEN tier >= 0.75 THEN 'luxury' WHEN tier >= 0.5 THEN 'boutique' WHEN tier >= 0.25 THEN 'business'
              ELSE 'budget / backpacker' END AS style,
         CASE WHEN tier >= 0.75 THEN 5 WHEN tier >= 0.25 THEN 4 ELSE 3 END AS star_rating,
         list_slice(list_transform(list_sort(list_transform(
             ['pool', 'spa', 'wifi', 'fine_dining', 'gym', 'bar', 'beach_access', 'business_center', 'kids_club', 'butler_service'],
             lambda a: {'h': md5(name || '|' || a), 'a': a})), lambda s: s.a), 1, CAST(floor(tier * 5) + 3 AS INTEGER)) AS chosen,
         CAST(CAST(('0x' || substr(md5(name || '#review'), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0 AS frac
       FROM t1),
cat AS (SELECT CAST(price_rank AS INTEGER) AS price_rank, name, city AS location, 'Brazil' AS country, style, climate,
               star_rating, round_even(ap, 2) AS avg_price_per_night,
               least(9.8, greatest(6.5, round_even(7.2 + tier * 2.0 + (frac * 0.6 - 0.3), 1))) AS review_score,
               array_to_string(CASE WHEN climate = 'coastal' AND NOT list_contains(chosen, 'beach_access')
                                    THEN list_append(chosen, 'beach_access') ELSE chosen END, ' ') AS amenities,
               CASE WHEN style = 'business' THEN 'business leisure' WHEN climate = 'coastal' THEN 'leisure family'
                    ELSE 'leisure' END AS travel_type,
               bookings
        FROM t2)
"""

sql("REC1_catalogue", _CAT + "SELECT * FROM cat")
sql("AGG19_budget_bound", _CAT + "SELECT CAST(round_even(max(avg_price_per_night) * 83.0, 0) AS BIGINT) + 5000 AS max_budget_inr FROM cat")
sql("WIN1_price_rank", _CAT + "SELECT name, place, price_rank, n_hotels FROM ranked")

_ITEM_TFIDF = _CAT + _tfidf(
    "SELECT price_rank AS doc_id, concat_ws(' ', coalesce(amenities, ''), coalesce(style, ''), "
    "coalesce(climate, ''), coalesce(travel_type, '')) AS txt FROM cat")
sql("REC4_FEA8_catalogue_tfidf", _ITEM_TFIDF + "SELECT doc_id AS item_id, term, round(weight, 6) AS weight FROM iw")

_MM = """
, mm AS (SELECT min(coalesce(avg_price_per_night, 0.0)) AS p_lo, max(coalesce(avg_price_per_night, 0.0)) AS p_hi,
                min(coalesce(CAST(star_rating AS DOUBLE), 0.0)) AS s_lo, max(coalesce(CAST(star_rating AS DOUBLE), 0.0)) AS s_hi,
                min(coalesce(review_score, 0.0)) AS r_lo, max(coalesce(review_score, 0.0)) AS r_hi FROM cat),
items AS (SELECT c.*,
            (coalesce(avg_price_per_night, 0.0) - p_lo) / CASE WHEN p_hi - p_lo = 0 THEN 1.0 ELSE p_hi - p_lo END AS avg_price_per_night_s,
            (coalesce(CAST(star_rating AS DOUBLE), 0.0) - s_lo) / CASE WHEN s_hi - s_lo = 0 THEN 1.0 ELSE s_hi - s_lo END AS star_rating_s,
            (coalesce(review_score, 0.0) - r_lo) / CASE WHEN r_hi - r_lo = 0 THEN 1.0 ELSE r_hi - r_lo END AS review_score_s
          FROM cat c, mm)
"""
sql("FEA9_catalogue_minmax", _ITEM_TFIDF + _MM + """
SELECT price_rank AS item_id, round(avg_price_per_night_s, 9) AS avg_price_per_night_s,
       round(star_rating_s, 9) AS star_rating_s, round(review_score_s, 9) AS review_score_s FROM items
""")

_REQ = """
, req AS (
  SELECT travelCode AS request_id,
         CASE WHEN flightType = 'economic' THEN "to" ELSE to_city END AS destination,
         CASE WHEN flightType = 'firstClass' THEN 'luxury' WHEN flightType = 'premium' THEN 'business' ELSE 'budget' END AS style,
         CASE WHEN agency = 'CloudFy' THEN 'coastal' WHEN agency = 'Rainbow' THEN 'temperate' END AS climate,
         CASE WHEN agency = 'CloudFy' THEN 'leisure' WHEN agency = 'FlyingDrops' THEN 'business' END AS travel_type,
         CASE WHEN flightType = 'firstClass' THEN ['spa', 'fine_dining'] WHEN flightType = 'premium' THEN ['wifi', 'gym']
              ELSE ['wifi'] END AS amenities,
         CAST(floor(price / 4) AS DOUBLE) AS budget_max,
         CASE WHEN flightType = 'firstClass' THEN 4 WHEN flightType = 'premium' THEN 3 ELSE 0 END AS min_stars,
         CASE WHEN flightType = 'firstClass' THEN 7.5 ELSE 0.0 END AS min_review
  FROM tflights)
"""

_RECS = _ITEM_TFIDF + _MM + _REQ + f"""
, qtxt AS (SELECT request_id, CASE WHEN q = '' THEN 'hotel' ELSE q END AS q FROM (
             SELECT request_id, trim(concat_ws(' ', coalesce(array_to_string(amenities, ' '), ''), coalesce(style, ''),
                                                coalesce(climate, ''), coalesce(travel_type, ''))) AS q FROM req)),
qtf AS (SELECT request_id, term, count(*) AS tf
        FROM (SELECT request_id, unnest(regexp_extract_all(lower(q), {_TOKEN})) AS term FROM qtxt)
        WHERE term IN (SELECT term FROM vocab) GROUP BY request_id, term),
qw AS (SELECT request_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY request_id)) AS w
       FROM (SELECT request_id, term, tf * idf AS w FROM qtf JOIN vocab USING (term))),
ts AS (SELECT q.request_id, i.doc_id AS price_rank, sum(q.w * i.weight) AS text_score
       FROM qw q JOIN iw i ON q.term = i.term GROUP BY q.request_id, i.doc_id),
pairs AS (
  SELECT r.request_id, r.budget_max, r.min_stars, r.min_review, i.*,
         max(i.avg_price_per_night) OVER (PARTITION BY r.request_id) AS mx
  FROM req r JOIN items i ON
        (r.budget_max IS NULL OR r.budget_max = 0 OR i.avg_price_per_night <= r.budget_max)
    AND (r.min_stars IS NULL OR r.min_stars = 0 OR i.star_rating >= r.min_stars)
    AND (r.min_review IS NULL OR r.min_review = 0 OR i.review_score >= r.min_review)
    AND (r.destination IS NULL OR lower(trim(r.destination)) = ''
         OR contains(lower(i.location), lower(trim(r.destination))) OR contains(lower(i.country), lower(trim(r.destination))))),
scored AS (
  SELECT p.*, round(0.6 * coalesce(ts.text_score, 0.0) + 0.4 * (1.0 / (sqrt(
             (p.avg_price_per_night_s - (least(coalesce(p.budget_max, p.mx), p.mx) - mm.p_lo) / CASE WHEN mm.p_hi - mm.p_lo = 0 THEN 1.0 ELSE mm.p_hi - mm.p_lo END)
           * (p.avg_price_per_night_s - (least(coalesce(p.budget_max, p.mx), p.mx) - mm.p_lo) / CASE WHEN mm.p_hi - mm.p_lo = 0 THEN 1.0 ELSE mm.p_hi - mm.p_lo END)
           + (p.star_rating_s - (coalesce(CAST(p.min_stars AS DOUBLE), 4.0) - mm.s_lo) / CASE WHEN mm.s_hi - mm.s_lo = 0 THEN 1.0 ELSE mm.s_hi - mm.s_lo END)
           * (p.star_rating_s - (coalesce(CAST(p.min_stars AS DOUBLE), 4.0) - mm.s_lo) / CASE WHEN mm.s_hi - mm.s_lo = 0 THEN 1.0 ELSE mm.s_hi - mm.s_lo END)
           + (p.review_score_s - (coalesce(p.min_review, 8.0) - mm.r_lo) / CASE WHEN mm.r_hi - mm.r_lo = 0 THEN 1.0 ELSE mm.r_hi - mm.r_lo END)
           * (p.review_score_s - (coalesce(p.min_review, 8.0) - mm.r_lo) / CASE WHEN mm.r_hi - mm.r_lo = 0 THEN 1.0 ELSE mm.r_hi - mm.r_lo END)
         ) + 1.0)), 9) AS score
  FROM pairs p CROSS JOIN mm LEFT JOIN ts ON ts.request_id = p.request_id AND ts.price_rank = p.price_rank),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, price_rank) AS rank FROM scored)
        WHERE rank <= 5),
recs AS (
  SELECT request_id, CAST(rank AS INTEGER) AS rank, name, location, country, style, climate, star_rating,
         avg_price_per_night, review_score, amenities, travel_type, bookings,
         round_even(CASE WHEN hi > lo THEN 60.0 + 35.0 * (score - lo) / (hi - lo) ELSE 75.0 END, 1) AS match_score,
         round_even(avg_price_per_night * 83.0, 0) AS avg_price_per_night_inr
  FROM (SELECT *, min(score) OVER (PARTITION BY request_id) AS lo, max(score) OVER (PARTITION BY request_id) AS hi FROM top))
"""
sql("REC10_recommend", _RECS + "SELECT * FROM recs")
SQL["TOP2_bounded_top_k"] = SQL["REC10_recommend"]
sql("PRJ19_PRJ20_display_records", _RECS + """
SELECT r.request_id, r.rank, r.name AS hotel_name, r.avg_price_per_night AS price_per_night,
       coalesce(r.avg_price_per_night_inr, round_even(r.avg_price_per_night * 83.0, 0)) AS price_per_night_inr,
       CASE WHEN r.review_score IS NOT NULL THEN round_even(r.review_score / 2, 1) ELSE CAST(r.star_rating AS DOUBLE) END AS rating,
       CASE WHEN r.match_score > 1.0 THEN r.match_score / 100.0 ELSE r.match_score END AS match,
       round_even(r.avg_price_per_night / q.budget_max * 100, 6) AS budget_used_pct,
       CASE WHEN r.avg_price_per_night / q.budget_max * 100 <= 80 THEN 'within' ELSE 'close' END AS budget_band
FROM recs r LEFT JOIN req q ON r.request_id = q.request_id
""")
sql("EVA6_distinct_result_sets", _RECS + """
SELECT count(*) AS scenarios, count(DISTINCT hotels) AS distinct_sets, count(DISTINCT hotels) <= 1 AS all_same
FROM (SELECT request_id, list_sort(list_distinct(list(name))) AS hotels FROM recs GROUP BY request_id)
""")
sql("REC11_unknown_destination", _CAT + _REQ + """
SELECT request_id, destination,
       '''' || destination || ''' is no catalogue city; all cities are searched' AS note
FROM req WHERE destination IS NOT NULL AND trim(destination) <> ''
  AND lower(trim(destination)) NOT IN (SELECT lower(location) FROM cat)
""")
_REPS = _ITEM_TFIDF + """
, signs AS (SELECT doc_id, string_agg(term || ' ' || CAST(round(weight, 12) AS VARCHAR), '|' ORDER BY term) AS sign FROM iw GROUP BY doc_id),
reps AS (SELECT min(doc_id) AS rep, count(*) AS n_members FROM signs GROUP BY sign),
cosines AS (SELECT x.doc_id AS a, y.doc_id AS b, round(sum(x.weight * y.weight), 9) AS cosine
            FROM iw x JOIN iw y ON x.term = y.term AND x.doc_id <> y.doc_id
            WHERE x.doc_id IN (SELECT rep FROM reps) AND y.doc_id IN (SELECT rep FROM reps) GROUP BY x.doc_id, y.doc_id)
"""
sql("JOIN5_cosine_pairs", _REPS + """
SELECT a AS item_a, b AS item_b, cosine, m.n_members AS members_a, n.n_members AS members_b
FROM cosines JOIN reps m ON m.rep = a JOIN reps n ON n.rep = b WHERE a < b AND cosine >= 0.7
""")
sql("JOIN5_top_neighbours", _REPS + """
SELECT item, CAST(rank AS INTEGER) AS rank, neighbour, cosine FROM (
  SELECT a AS item, b AS neighbour, cosine, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank
  FROM cosines WHERE cosine > 0) WHERE rank <= 5
""")
_NAMES = """
, names AS (SELECT DISTINCT lower(t) AS text FROM (SELECT unnest([name, place, city]) AS t FROM thotels) WHERE t IS NOT NULL),
dests AS (SELECT DISTINCT lower(trim(destination)) AS dest FROM req WHERE destination IS NOT NULL)
"""
sql("FLT4_trigram_search", _REQ + _NAMES + """
SELECT term, count(*) AS n_names, min(text) AS first_name, max(text) AS last_name
FROM (SELECT DISTINCT unnest([dest, right(dest, 4)]) AS term FROM dests) t JOIN names ON contains(text, term) GROUP BY term
""")
sql("FLT4_regex_search", _REQ + _NAMES + """
, cities AS (SELECT DISTINCT regexp_replace(dest, ' ?\\(.*$', '') AS dest FROM dests)
SELECT pattern, count(*) AS n_names, min(text) AS first_name, max(text) AS last_name
FROM (SELECT DISTINCT unnest(['^' || dest || '$', dest || '[0-9]?( |$)', '(brand|nation).*' || right(dest, 2) || '+', 'x?zq|' || dest || '.']) AS pattern
      FROM cities) t JOIN names ON regexp_matches(text, pattern) GROUP BY pattern
""")
sql("JOIN5_neighbour_cosine", _ITEM_TFIDF + """
, pairs AS (SELECT a.price_rank AS item_a, b.price_rank AS item_b FROM cat a JOIN cat b ON b.price_rank = a.price_rank + 1),
s AS (SELECT p.item_a, p.item_b, sum(x.weight * y.weight) AS s
      FROM pairs p JOIN iw x ON x.doc_id = p.item_a JOIN iw y ON y.doc_id = p.item_b AND y.term = x.term
      GROUP BY p.item_a, p.item_b)
SELECT p.item_a, p.item_b, round(coalesce(s.s, 0.0), 9) AS cosine
FROM pairs p LEFT JOIN s ON p.item_a = s.item_a AND p.item_b = s.item_b
""")
sql("SNK4_recommender_metrics", _ITEM_TFIDF + """
SELECT 'hotel_recommender' AS experiment, 'content_based_tfidf_cosine' AS run_name, '0.6' AS text_weight, '0.4' AS num_weight,
       '500' AS tfidf_features, 'bookings' AS data_source,
       (SELECT count(*) FROM cat) AS num_hotels, (SELECT count(*) FROM vocab) AS vocab_size,
       (SELECT round(avg(avg_price_per_night), 6) FROM cat) AS avg_price_per_night,
       (SELECT round(avg(review_score), 6) FROM cat) AS avg_review_score
""")

# ---------------------------------------------------------------- evaluation
_FSPLIT = f"""
, sp AS (SELECT *, substr({_H.format(k='travelCode')}, 1, 8) < '33333333' AS is_test FROM tflights),
tr AS (SELECT * FROM sp WHERE NOT is_test),
te AS (SELECT * FROM sp WHERE is_test)
"""


def _gm_metrics(keys: str) -> str:
    on = " AND ".join(f'te."{k}" = m."{k}"' for k in keys.split(","))
    return f"""(SELECT sqrt(avg((label - prediction) * (label - prediction))) AS rmse,
        avg(abs(label - prediction)) AS mae,
        1.0 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(*)) AS r2
 FROM (SELECT te.price AS label, coalesce(m.prediction, (SELECT avg(price) FROM tr)) AS prediction
       FROM te LEFT JOIN (SELECT {', '.join(f'"{k}"' for k in keys.split(','))}, avg(price) AS prediction
                          FROM tr GROUP BY ALL) m ON {on}))"""


sql("EVA1_regression_metrics", _FSPLIT + f"""
SELECT round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2 FROM {_gm_metrics('from,to,flightType')}
""")
sql("EVA4_best_of_two", _FSPLIT + f"""
, runs AS (SELECT 'route_mean' AS model, r2 AS metric, true AS is_baseline FROM {_gm_metrics('from,to')}
           UNION ALL SELECT 'route_class_mean', r2, false FROM {_gm_metrics('from,to,flightType')})
SELECT arg_max(model, (round(metric, 9), is_baseline)) AS selected_model, max(round(metric, 9)) AS selected_metric FROM runs
""")
sql("EVA2_classification_metrics", f"""
, u AS (SELECT code, gender, {_FIRST} AS first_name FROM users WHERE gender IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY {_H.format(k='code')}, code) - 1
                  < ceil(count(*) OVER (PARTITION BY gender) * 0.2) AS is_test FROM u),
tr AS (SELECT * FROM s WHERE NOT is_test),
te AS (SELECT * FROM s WHERE is_test),
c AS (SELECT first_name, gender, count(*) AS n FROM tr GROUP BY first_name, gender),
best AS (SELECT first_name, gender AS prediction
         FROM (SELECT *, row_number() OVER (PARTITION BY first_name ORDER BY n DESC, gender) AS r FROM c) WHERE r = 1),
overall AS (SELECT gender FROM tr GROUP BY gender ORDER BY count(*) DESC, gender LIMIT 1),
p AS (SELECT te.gender AS y, coalesce(best.prediction, (SELECT gender FROM overall)) AS p
      FROM te LEFT JOIN best ON te.first_name = best.first_name),
conf AS (SELECT y, p, count(*) AS n FROM p GROUP BY y, p),
cls AS (SELECT cls, sum(support) AS support, sum(tp) AS tp, sum(predicted) AS predicted FROM (
          SELECT y AS cls, n AS support, CASE WHEN y = p THEN n ELSE 0 END AS tp, 0 AS predicted FROM conf
          UNION ALL SELECT p, 0, 0, n FROM conf) GROUP BY cls),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS prec,
                CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM cls),
m2 AS (SELECT *, CASE WHEN prec + rec > 0 THEN prec * rec * 2 / (prec + rec) ELSE 0.0 END AS f1 FROM m)
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(prec * support) / sum(support), 6) AS "precision",
       round(sum(rec * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1
FROM m2
""")

# ---------------------------------------------------------------- scoring
_ROUTED = """
, bodies AS (
  SELECT 'flights' AS source, travelCode AS request_id,
         CASE WHEN "date" IS NOT NULL THEN CAST(to_json({'flightType': flightType, 'agency': agency, 'from': "from", 'to': "to"}) AS VARCHAR)
              ELSE (SELECT f."date" FROM flights f WHERE f.travelCode = t.travelCode) END AS body
  FROM tflights t
  UNION ALL SELECT 'events', event_id, props FROM events),
j AS (SELECT source, request_id, body, json_valid(body) AS ok FROM bodies),
k AS (SELECT *, CASE WHEN ok THEN json_extract_string(body, '$.flightType') END AS ft,
                CASE WHEN ok THEN json_extract_string(body, '$.agency') END AS ag,
                CASE WHEN ok THEN json_extract_string(body, '$.from') END AS fr,
                CASE WHEN ok THEN json_extract_string(body, '$.to') END AS dst,
                CASE WHEN ok THEN len(json_keys(body)) END AS nkeys FROM j),
routed AS (
SELECT source, request_id, ft, ag, fr, dst,
       CASE WHEN NOT ok THEN 'error' WHEN nkeys = 0 THEN 'error'
            WHEN ft IS NULL OR ag IS NULL OR fr IS NULL OR dst IS NULL THEN 'error'
            WHEN fr = dst THEN 'rejected' ELSE 'valid' END AS status,
       CASE WHEN NOT ok THEN 'Invalid JSON payload' WHEN nkeys = 0 THEN 'No input data provided'
            WHEN ft IS NULL OR ag IS NULL OR fr IS NULL OR dst IS NULL THEN 'Missing required fields'
            WHEN fr = dst THEN 'Origin and destination must differ' END AS message
FROM k)
"""
sql("SCR4_FLT6_SRC7_request_routing", _ROUTED + "SELECT source, request_id, status, message FROM routed")
SQL["SCR4_stream_once"] = SQL["SCR4_FLT6_SRC7_request_routing"]
sql("SCR1_price_scoring", _ROUTED + """
SELECT source, request_id, CASE WHEN status = 'valid' THEN 'success' ELSE status END AS status, message,
       CASE WHEN status = 'valid' THEN 'USD' END AS currency, CASE WHEN status = 'valid' THEN 'tripcast_v1' END AS model_version,
       concat_ws('|', ft, ag, fr, dst) AS input_received, CASE WHEN status = 'valid' THEN true END AS price_ok
FROM routed
""")
sql("SCR5_fallback_scoring", _ROUTED + """
SELECT request_id, CASE WHEN status = 'valid' THEN 'success' ELSE status END AS status, message,
       CASE WHEN status = 'valid' THEN CASE WHEN ag <> 'CloudFy' THEN 'primary' ELSE 'fallback' END END AS source,
       CASE WHEN status = 'valid' THEN CASE WHEN ag <> 'CloudFy' THEN 'tripcast_v1' ELSE 'local_fallback_v1' END END AS model_version,
       CASE WHEN status = 'valid' THEN true END AS price_ok
FROM routed WHERE source = 'flights'
""")
_HOTEL_ROUTED = """
, hr AS (SELECT *, CASE WHEN request_id % 97 = 0 THEN 'error' WHEN request_id % 89 = 0 THEN 'error' ELSE 'valid' END AS status,
                   CASE WHEN request_id % 97 = 0 THEN 'Invalid JSON payload'
                        WHEN request_id % 89 = 0 THEN 'No input data provided' END AS message FROM req)
"""
sql("FLT6_hotel_request_routing", _REQ + _HOTEL_ROUTED + "SELECT request_id, status, message FROM hr")
sql("SCR3_recommendation_responses", _RECS + _HOTEL_ROUTED + """
SELECT q.request_id,
       CASE WHEN q.status <> 'valid' THEN q.status WHEN n.n IS NULL THEN 'no_match' ELSE 'success' END AS status, q.message,
       CASE WHEN q.status = 'valid' THEN coalesce(n.n, 0) ELSE 0 END AS n_results,
       CASE WHEN q.status = 'valid' THEN n.hotels END AS hotels, CASE WHEN q.status = 'valid' THEN b.match_score END AS best_match,
       CASE WHEN q.status = 'valid' THEN 'tripcast_v1' END AS model_version,
       CASE WHEN q.status = 'valid' THEN q.destination END AS input_destination
FROM hr q
LEFT JOIN (SELECT request_id, count(*) AS n, string_agg(name, '|' ORDER BY rank) AS hotels FROM recs GROUP BY request_id) n
  ON q.request_id = n.request_id
LEFT JOIN (SELECT request_id, match_score FROM recs WHERE rank = 1) b ON q.request_id = b.request_id
""")
sql("SCR2_class_scoring", f"""
SELECT code AS request_id, CASE WHEN fn = '' THEN 'rejected' ELSE 'success' END AS status,
       CASE WHEN fn = '' THEN 'The first name is blank' END AS message,
       CASE WHEN fn <> '' THEN 'tripcast_v1' END AS model_version, CASE WHEN fn <> '' THEN true END AS known_label,
       CASE WHEN fn <> '' THEN true END AS confidence_is_the_label_s, CASE WHEN fn <> '' THEN true END AS probabilities_sum_to_one,
       true AS accuracy_above_majority, fn AS input_first_name
FROM (SELECT code, trim(coalesce({_FIRST}, '')) AS fn FROM users)
""")

# ---------------------------------------------------------------- models: what must hold for every row
for _name in ("MDL1_linear_regression", "MDL2_forest_regressor", "MDL5_gbt_regressor"):
    sql(_name, _FSPLIT + "SELECT travelCode, price AS label, true AS within_tolerance FROM te")
sql("MDL1_merged_statistics", _FSPLIT + "SELECT travelCode, price AS label, true AS within_tolerance, true AS merged_equals_full FROM te")
for _name in ("MDL3_logistic_regression", "MDL4_forest_classifier"):
    sql(_name, f"""
SELECT code, gender AS label, true AS known_label, true AS probabilities_sum_to_one, true AS f1_above_bound
FROM (SELECT code, gender, row_number() OVER (PARTITION BY gender ORDER BY {_H.format(k='code')}, code) - 1
                             < ceil(count(*) OVER (PARTITION BY gender) * 0.2) AS is_test
      FROM users WHERE gender IS NOT NULL) WHERE is_test
""")
sql("MDL6_MDL9_gender_forest", """
SELECT code, gender, true AS known_label, true AS confidence_is_top, true AS confidence_is_the_label_s, true AS probabilities_sum_to_one,
       true AS accuracy_above_majority
FROM users WHERE gender IS NOT NULL AND company IS NOT NULL
""")
sql("MDL8_feature_importances", """
SELECT unnest(['flightType_enc', 'agency_enc', 'from_enc', 'to_enc', 'distance', 'time', 'day', 'month', 'weekday']) AS feature,
       unnest([1, NULL, NULL, NULL, 2, NULL, NULL, NULL, NULL]) AS place, unnest([true, false, false, false, false, false, false, false, false]) AS above_half,
       unnest([false, true, true, true, false, true, true, true, true]) AS below_two_percent, true AS importances_sum_to_one
""")
sql("EVA3_EVA5_SNK1_SNK3_train_save_evaluate", """
SELECT true AS selected_a_run, (SELECT count(*) FROM tflights) AS evaluated_rows, true AS r2_above_bound,
       true AS rmse_below_bound, true AS mae_within_rmse, 2 AS logged_runs
""")

# ---------------------------------------------------------------- remaining projections
sql("PRJ11_user_features_and_label", f"""
SELECT company, age, first_name, CAST(length(first_name) AS INTEGER) AS name_length,
       left(first_name, 1) AS first_letter, right(first_name, 1) AS last_letter, gender AS label
FROM (SELECT *, {_FIRST} AS first_name FROM users)
""")
_TITLE = "array_to_string(list_transform(string_split(replace(a, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
sql("PRJ15_amenity_labels", _CAT + f"""
SELECT price_rank, array_to_string(labels, ', ') AS amenity_labels,
       array_to_string(list_transform(labels, lambda l: lower(replace(l, ' ', '_'))), ' ') AS round_trip
FROM (SELECT price_rank, list_transform(string_split(amenities, ' '), lambda a: {_TITLE}) AS labels FROM cat)
""")
sql("PRJ18_confidence_band", """
SELECT company, confidence,
       CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'moderate' ELSE 'low' END AS band
FROM (SELECT company, max(n) / sum(n) AS confidence
      FROM (SELECT company, gender, count(*) AS n FROM users WHERE company IS NOT NULL AND gender IS NOT NULL
            GROUP BY company, gender) GROUP BY company)
""")
sql("PRJ23_city_climate", _CAT + """
SELECT DISTINCT h.city, coalesce(c.climate, 'tropical') AS climate
FROM thotels h LEFT JOIN clim c ON h.city = c.city WHERE h.city IS NOT NULL
""")
sql("FLT6_classify_request_routing", f"""
SELECT code AS request_id,
       CASE WHEN coalesce(trim(fn), '') = '' THEN 'rejected' ELSE 'valid' END AS status,
       CASE WHEN coalesce(trim(fn), '') = '' THEN 'The first name is blank' END AS message
FROM (SELECT code, trim(coalesce({_FIRST}, '')) AS fn FROM users)
""")

# ---------------------------------------------------------------- sinks and optional sources
# A saved and reloaded recommender must give exactly the REC10 rows.
SQL["SNK7_reloaded_recommender"] = SQL["REC10_recommend"]
sql("SNK5_SNK6_SNK7_persist_and_reload", _RECS + """
, nb AS (SELECT a.price_rank AS item_a, b.price_rank AS item_b FROM cat a JOIN cat b ON b.price_rank = a.price_rank + 1),
nbs AS (SELECT p.item_a, p.item_b, sum(x.weight * y.weight) AS s
        FROM nb p JOIN iw x ON x.doc_id = p.item_a JOIN iw y ON y.doc_id = p.item_b AND y.term = x.term GROUP BY p.item_a, p.item_b),
sim AS (SELECT nb.item_a, nb.item_b, round(coalesce(nbs.s, 0.0), 9) AS cosine
        FROM nb LEFT JOIN nbs ON nb.item_a = nbs.item_a AND nb.item_b = nbs.item_b)
SELECT c.price_rank, c.name, c.location, c.avg_price_per_night, c.amenities, s.item_b, s.cosine, coalesce(f.n, 0) AS n_first
FROM cat c LEFT JOIN sim s ON s.item_a = c.price_rank
LEFT JOIN (SELECT name, count(*) AS n FROM recs WHERE rank = 1 GROUP BY name) f ON f.name = c.name
""")
sql("SRC5_optional_sources", """
SELECT 'orders' AS source, count(*) AS "rows", true AS is_live FROM orders
UNION ALL SELECT 'customer', count(*), true FROM customer
UNION ALL SELECT 'lineitem', count(*), true FROM lineitem
UNION ALL SELECT 'hotels_missing', 0, false
""")

# ---------------------------------------------------------------- skewed labels
sql("SMP4L_labels_stratified_split", f"""
SELECT doc_id, toxic,
       row_number() OVER (PARTITION BY toxic ORDER BY {_H.format(k='doc_id')}, doc_id) - 1
         < ceil(count(*) OVER (PARTITION BY toxic) * 0.2) AS is_test
FROM labels WHERE toxic IS NOT NULL
""")
sql("MDL7L_labels_class_weights", """
SELECT toxic, n_c, sum(n_c) OVER () / (count(*) OVER () * n_c) AS class_weight
FROM (SELECT toxic, count(*) AS n_c FROM labels WHERE toxic IS NOT NULL GROUP BY toxic)
""")
sql("EVA2L_labels_quality_metrics", f"""
, lab AS (SELECT l.doc_id, l.quality, d.source FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id
          WHERE l.quality IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_H.format(k='doc_id')}, doc_id) - 1
                  < ceil(count(*) OVER (PARTITION BY quality) * 0.2) AS is_test FROM lab),
tr AS (SELECT * FROM s WHERE NOT is_test),
te AS (SELECT * FROM s WHERE is_test),
c AS (SELECT source, quality, count(*) AS n FROM tr GROUP BY source, quality),
best AS (SELECT source, quality AS prediction
         FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, quality) AS r FROM c) WHERE r = 1),
overall AS (SELECT quality FROM tr GROUP BY quality ORDER BY count(*) DESC, quality LIMIT 1),
p AS (SELECT te.quality AS y, coalesce(best.prediction, (SELECT quality FROM overall)) AS p
      FROM te LEFT JOIN best ON te.source = best.source),
conf AS (SELECT y, p, count(*) AS n FROM p GROUP BY y, p),
cls AS (SELECT cls, sum(support) AS support, sum(tp) AS tp, sum(predicted) AS predicted FROM (
          SELECT y AS cls, n AS support, CASE WHEN y = p THEN n ELSE 0 END AS tp, 0 AS predicted FROM conf
          UNION ALL SELECT p, 0, 0, n FROM conf) GROUP BY cls),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS prec,
                CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM cls),
m2 AS (SELECT *, CASE WHEN prec + rec > 0 THEN prec * rec * 2 / (prec + rec) ELSE 0.0 END AS f1 FROM m)
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(sum(prec * support) / sum(support), 6) AS "precision",
       round(sum(rec * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1
FROM m2
""")
