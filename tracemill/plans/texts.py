"""Registered queries: text kernels, geographic closed forms, lookups and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions import geo as G
from tracemill.functions import text as T
from tracemill.operators import ranking as R
from tracemill.plans.tables import query, table, tracks, TRACKS


def sql_replaced(x: str, pairs: dict[str, str]) -> str:
    for a, b in pairs.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query(rf"""select doc_id, lower(regexp_replace(translate({sql_replaced('text', T.EXPANDED)}, '{T.ACCENTED}', '{T.PLAIN}'), '[^\x00-\x7F]', '', 'g')) as norm from documents""")
def t01_street_norm(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.street_norm(F.col("text")).alias("norm"))


@query(rf"""select doc_id, trim(regexp_replace(lower(regexp_replace(translate({sql_replaced('text', T.UMLAUTS)}, '{T.ACCENTED}', '{T.PLAIN}'), '[^\x00-\x7F]', '', 'g')), '[^0-9a-z]+', ' ', 'g')) as norm from documents""")
def t02_gazetteer_norm(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.gazetteer_norm(F.col("text")).alias("norm"))


@query("select doc_id, trim(regexp_replace(text, '[^0-9A-Za-zÀ-ÿ]+', ' ', 'g')) as cleaned from documents")
def t03_clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query("""with l as (select doc_id, unnest(string_split(text, ' ')) as w from documents), f as (
  select doc_id, length(regexp_replace(w, '[^A-Za-zÀ-ÿ]', '', 'g')) as a, length(regexp_replace(w, '[^0-9A-Za-zÀ-ÿ]+', '', 'g')) as n from l
) select doc_id, count(*) as n_words, sum(cast(a >= 4 and a >= 0.5 * n as bigint))::bigint as n_geocodable from f group by doc_id""")
def f02_geocodable(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.sum(T.is_geocodable(F.col("w")).cast("long")).alias("n_geocodable"))


OVERLAYS = """overlays as (
  select c_custkey as id, c_custkey % 160 * 0.5 - 40.125 as lat, c_custkey % 340 * 0.75 - 120.375 as lon, c_custkey % 4 as form from customer
), strings as (
  select *, case form when 0 then format('{}: {:.4f} {}{:.4f}', case when lat < 0 then 'S' else 'N' end, abs(lat), case when lon < 0 then 'W' else 'E' end, abs(lon))
    when 1 then format('GPS {:.5f}, {:.5f} 40 km/h', lat, lon)
    when 2 then format('{}°{}''30.0"{} {}°{}''15.0"{}', cast(floor(abs(lat)) as int), 15, case when lat < 0 then 'S' else 'N' end, cast(floor(abs(lon)) as int), 45, case when lon < 0 then 'W' else 'E' end)
    else format('speed {} km/h', id) end as s from overlays
)"""


def _overlays(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), (k % 160 * 0.5 - 40.125).alias("lat"), (k % 340 * 0.75 - 120.375).alias("lon"), (k % 4).alias("form"))
    ns, ew = F.when(F.col("lat") < 0, "S").otherwise("N"), F.when(F.col("lon") < 0, "W").otherwise("E")
    s = (
        F.when(F.col("form") == 0, F.format_string("%s: %.4f %s%.4f", ns, F.abs("lat"), ew, F.abs("lon")))
        .when(F.col("form") == 1, F.format_string("GPS %.5f, %.5f 40 km/h", "lat", "lon"))
        .when(F.col("form") == 2, F.format_string("%d°15'30.0\"%s %d°45'15.0\"%s", F.floor(F.abs("lat")), ns, F.floor(F.abs("lon")), ew))
        .otherwise(F.format_string("speed %d km/h", "id"))
    )
    return rows.withColumn("s", s)


@query(f"""with {OVERLAYS} select id, round(case form when 2 then (floor(abs(lat)) + 15 / 60.0 + 30 / 3600.0) * sign(lat) when 3 then null else lat end, 7) as lat,
  round(case form when 2 then (floor(abs(lon)) + 45 / 60.0 + 15 / 3600.0) * sign(lon) when 3 then null else lon end, 7) as lon from strings""")
def t06_parse_latlon(spark, sf_dir):
    rows = _overlays(spark, sf_dir).withColumn("p", T.parse_latlon(F.col("s")))
    return rows.select("id", F.round("p.lat", 7).alias("lat"), F.round("p.lon", 7).alias("lon"))


@query(rf"""with recursive parts as (
  select doc_id, unnest(regexp_split_to_array(regexp_replace(text, 'https?://\S+', ' ', 'g'), '[,|/·—–>\n\t;:]+|→|➜|»|(?i:\bto\b|\bvia\b|\bthen\b)')) as part, generate_subscripts(regexp_split_to_array(regexp_replace(text, 'https?://\S+', ' ', 'g'), '[,|/·—–>\n\t;:]+|→|➜|»|(?i:\bto\b|\bvia\b|\bthen\b)'), 1) as n from documents
), found as (
  select doc_id, n, unnest(regexp_extract_all(part, $r${T.PHRASE}$r$)) as p, generate_subscripts(regexp_extract_all(part, $r${T.PHRASE}$r$), 1) as m from parts
), trimmed as (
  select doc_id, n, m, regexp_replace(p, $r$^[ \-–—.'’]+|[ \-–—.'’]+$$r$, '', 'g') as p from found
), good as (
  select * from trimmed where length(p) >= 3 and len(list_filter(string_split(p, ' '), lambda w: length(w) >= 3 and not list_contains(string_split('{' '.join(T.GENERIC_WORDS)}', ' '), regexp_replace(lower(w), $r$^[.'’-]+|[.'’-]+$$r$, '', 'g')))) > 0
), once as (
  select doc_id, p, row_number() over (partition by doc_id order by n, m) as k from good qualify row_number() over (partition by doc_id, lower(p) order by n, m) = 1
) select doc_id, list(p order by k) as phrases from (select *, row_number() over (partition by doc_id order by k) as j from once) where j <= 14 group by doc_id""")
def t07_place_phrases(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.place_phrases(F.col("text")).alias("phrases")).where("size(phrases) > 0")


@query("""with p as (select s_suppkey as id, case s_suppkey % 5 when 0 then 'UL-AB ' || s_suppkey % 1000 when 1 then 'BAB' || s_suppkey % 1000 when 2 then 'MAB' || s_suppkey % 100 when 3 then 'xx' || s_suppkey else 'ULAB12345678' end as plate, s_suppkey % 5 as f, s_suppkey from supplier)
select id, case f when 0 then ['UL'] when 1 then case when s_suppkey % 1000 between 0 and 9999 then ['B', 'BA'] end when 2 then ['M', 'MA'] else []::varchar[] end as codes from p""")
def t11_plate_codes(spark, sf_dir):
    k = F.col("s_suppkey")
    plate = F.when(k % 5 == 0, F.concat(F.lit("UL-AB "), k % 1000)).when(k % 5 == 1, F.concat(F.lit("BAB"), k % 1000)).when(k % 5 == 2, F.concat(F.lit("MAB"), k % 100)).when(k % 5 == 3, F.concat(F.lit("xx"), k)).otherwise("ULAB12345678")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), T.plate_codes(plate, ["B", "BA", "M", "MA", "UL"]).alias("codes"))


@query("""select o_orderkey as id, case o_orderkey % 3 when 0 then o_orderdate::date + interval 10 hour + interval 20 minute + interval 30 second
  when 1 then case when day(o_orderdate) > 12 or day(o_orderdate) = month(o_orderdate) then o_orderdate::date + interval 1 hour + interval 2 minute + interval 3 second end end as taken
from orders where year(o_orderdate) > 2005 or o_orderkey % 2 = 0 and year(o_orderdate) > 2005
union all select o_orderkey, null from orders where year(o_orderdate) <= 2005""")
def t13_clock_parse(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    s = F.when(k % 3 == 0, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" 10:20:30"))).when(k % 3 == 1, F.concat(F.date_format(d, "dd.MM.yyyy"), F.lit(" 01:02:03"))).otherwise("no clock")
    return table(spark, sf_dir, "orders").select(k.alias("id"), T.parse_clock(s).alias("taken"))


@query(r"""with c as (select p_partkey as id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as a, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') as b from part)
select id, trim(left(concat_ws('-', nullif(a, ''), nullif(b, '')), 80), '-') as slug from c""")
def t10_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.slug([F.col("p_name"), F.col("p_brand")], F.col("p_name")).alias("slug"))


@query("select page_id, rtrim(translate(base64(encode(url)), '+/', '-_'), '=') as token from pages")
def t15_cdn_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.url_safe_base64(F.col("url")).alias("token"))


@query("select page_id, left(md5(url), 8) as plate_hash, left(sha1(url), 10) as signature, left(sha256(url), 16) as cache_key from pages")
def t12_hashes(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.substring(F.md5(u), 1, 8).alias("plate_hash"), F.substring(F.sha1(u), 1, 10).alias("signature"), F.substring(F.sha2(u, 256), 1, 16).alias("cache_key"))


@query("""with r as (select conv_id, turn, 'STREET: **' || role || '**' || chr(10) || '- DISTRICT: ' || case when turn % 2 = 0 then 'unknown' else 'D' || conv_id % 7 end || '.' as reply from conversations)
select conv_id, turn, regexp_replace(trim(split_part(split_part(reply, chr(10), 1), 'STREET: ', 2)), '[*]', '', 'g') as street, case when turn % 2 = 1 then 'D' || conv_id % 7 end as district from r""")
def t14_reply_fields(spark, sf_dir):
    reply = F.concat(F.lit("STREET: **"), F.col("role"), F.lit("**\n- DISTRICT: "), F.when(F.col("turn") % 2 == 0, "unknown").otherwise(F.concat(F.lit("D"), F.col("conv_id") % 7)), F.lit("."))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.reply_field(reply, "STREET").alias("street"), T.reply_field(reply, "DISTRICT").alias("district"))


@query("""select p_partkey as id, cast(case p_partkey % 5 when 0 then p_size * 1.5 + 1 when 1 then p_size * 3.0 + 1 when 2 then 8.0 when 3 then 10.0 else 8.0 end as double) as height,
  case p_partkey % 3 when 0 then 'transit' when 1 then 'poi' else 'housename' end as kind from part""")
def x20_osm_height(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    tags = F.map_concat(
        F.when(k % 5 == 0, F.create_map(F.lit("height"), F.concat(s * 1.5 + 1, F.lit(" m")))).when(k % 5 == 1, F.create_map(F.lit("building:levels"), s.cast("string"))).when(k % 5 == 2, F.create_map(F.lit("height"), F.lit("9000"))).when(k % 5 == 3, F.create_map(F.lit("height"), F.lit("tall"), F.lit("levels"), F.lit("3"))).otherwise(F.create_map(F.lit("roof"), F.lit("flat"))),
        F.when(k % 3 == 0, F.create_map(F.lit("railway"), F.lit("stop"))).when(k % 3 == 1, F.create_map(F.lit("name"), F.lit("x"))).otherwise(F.create_map(F.lit("addr:housename"), F.lit("y"))),
    )
    rows = table(spark, sf_dir, "part").select(k.alias("id"), tags.alias("tags"))
    return rows.select("id", T.osm_height(F.col("tags")).alias("height"), T.feature_kind(F.col("tags")).alias("kind"))


PLACES = "places as (select c_custkey as id, c_nationkey as k, 48 + (c_custkey * 37 % 1000) / 10000.0 as lat, 9 + (c_custkey * 91 % 1000) / 10000.0 as lon from customer)"


def _places(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_nationkey").alias("k"), (48 + k * 37 % 1000 / 10000.0).alias("lat"), (9 + k * 91 % 1000 / 10000.0).alias("lon"))


def sql_haversine(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371000.0 * asin(least(1.0, sqrt(sin(radians(({c}) - ({a})) / 2) ** 2 + cos(radians({a})) * cos(radians({c})) * sin(radians(({d}) - ({b})) / 2) ** 2))))"


@query(f"with {PLACES} select id, round({sql_haversine('lat', 'lon', '48.4', '9.99')}, 4) as metres, round(sqrt(((48.4 - lat) * 111320.0) ** 2 + ((9.99 - lon) * 111320.0 * cos(radians(lat))) ** 2), 4) as flat from places")
def x18_haversine(spark, sf_dir):
    return _places(spark, sf_dir).select("id", F.round(G.haversine_m("lat", "lon", 48.4, 9.99), 4).alias("metres"), F.round(G.flat_m("lat", "lon", 48.4, 9.99), 4).alias("flat"))


@query("""select c_custkey as id, round(48.4 + (c_acctbal / 10) / (111132.954 - 559.822 * cos(2 * radians(48.4)) + 1.175 * cos(4 * radians(48.4))), 9) as lat,
  round(9.99 + (c_acctbal / 7) / (pi() / 180 * 6378137.0 * cos(radians(48.4)) / sqrt(1 - (1 / 298.257223563) * (2 - 1 / 298.257223563) * sin(radians(48.4)) ** 2)), 9) as lon from customer""")
def x18_enu_to_latlon(spark, sf_dir):
    lat, lon = G.enu_to_latlon(F.col("c_acctbal") / 7, F.col("c_acctbal") / 10, 48.4, 9.99)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"))


@query(f"with {PLACES} select id, round(lat, 7) as lat, round(lon, 7) as lon from places")
def x18_utm_roundtrip(spark, sf_dir):
    east, north = G.utm_forward("lat", "lon", 32)
    lat, lon = G.utm_inverse("e", "n", 32)
    return _places(spark, sf_dir).withColumns({"e": east, "n": north}).select("id", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query(f"with {PLACES} select id, round(lat, 8) as lat, round(lon, 8) as lon from places")
def x18_ecef_roundtrip(spark, sf_dir):
    x, y, z = G.latlon_to_ecef("lat", "lon", 100.0)
    rows = _places(spark, sf_dir).withColumns({"x": x, "y": y, "z": z})
    lat, lon = G.ecef_to_latlon("x", "y", "z")
    return rows.select("id", F.round(lat, 8).alias("lat"), F.round(lon, 8).alias("lon"))


@query(f"with {PLACES}, f as (select id % 997 as g, lat, lon from places), m as (select g, count(*) as n, avg(lat) as a, avg(lon) as b from f group by g), d as (select f.g, max({sql_haversine('a', 'b', 'lat', 'lon')}) as spread from f join m using (g) group by f.g) select g, n, case when spread <= 4000 then round(a, 8) end as lat, case when spread <= 4000 then round(b, 8) end as lon from m join d using (g)")
def a16_instance_resolution(spark, sf_dir):
    rows = _places(spark, sf_dir).withColumn("g", F.col("id") % 997)
    w = Window.partitionBy("g")
    spread = rows.withColumns({"a": F.avg("lat").over(w), "b": F.avg("lon").over(w)}).groupBy("g").agg(F.count("*").alias("n"), F.avg("lat").alias("a"), F.avg("lon").alias("b"), F.max(G.haversine_m("a", "b", "lat", "lon")).alias("d"))
    near = F.col("d") <= 4000
    return spread.select("g", "n", F.when(near, F.round("a", 8)).alias("lat"), F.when(near, F.round("b", 8)).alias("lon"))


@query(f"with {PLACES}, m as (select k, median(lat) as a, median(lon) as b from places group by k) select p.k, round(any_value(a), 8) as lat, round(any_value(b), 8) as lon, round(least(6000, greatest(800, max({sql_haversine('a', 'b', 'lat', 'lon')}) + 500)), 3) as radius from places p join m using (k) group by p.k")
def a12_coarse_prior(spark, sf_dir):
    rows = _places(spark, sf_dir)
    mid = rows.groupBy("k").agg(F.median("lat").alias("a"), F.median("lon").alias("b"))
    far = rows.join(mid, "k").groupBy("k").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.max(G.haversine_m("a", "b", "lat", "lon")).alias("d"))
    return far.select("k", F.round("a", 8).alias("lat"), F.round("b", 8).alias("lon"), F.round(F.least(F.lit(6000.0), F.greatest(F.lit(800.0), F.col("d") + 500)), 3).alias("radius"))


@query(f"with {PLACES}, b as (select k, (min(lat) + max(lat)) / 2 as a, (min(lon) + max(lon)) / 2 as b from places group by k) select p.k, round(any_value(a), 8) as lat, round(any_value(b), 8) as lon, round(max({sql_haversine('a', 'b', 'lat', 'lon')}) + 300, 3) as radius from places p join b using (k) group by p.k")
def a13_track_disc(spark, sf_dir):
    rows = _places(spark, sf_dir)
    mid = rows.groupBy("k").agg(((F.min("lat") + F.max("lat")) / 2).alias("a"), ((F.min("lon") + F.max("lon")) / 2).alias("b"))
    far = rows.join(mid, "k").groupBy("k").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.max(G.haversine_m("a", "b", "lat", "lon")).alias("d"))
    return far.select("k", F.round("a", 8).alias("lat"), F.round("b", 8).alias("lon"), F.round(F.col("d") + 300, 3).alias("radius"))


@query("""with d as (select n_nationkey as k, 565000.0 + n_nationkey * 311 as x, 5360000.0 + n_nationkey * 173 as y from nation), t as (
  select k, i * 1000 as tx, j * 1000 as ty, sqrt((i * 1000 + 500 - x) ** 2 + (j * 1000 + 500 - y) ** 2) as distance from d, range(560, 580) r(i), range(5355, 5370) s(j)
  where i between floor((x - 1500) / 1000) and floor((x + 1500) / 1000) and j between floor((y - 1500) / 1000) and floor((y + 1500) / 1000)
) select k, tx, ty, cast(row_number() over (partition by k order by distance, tx, ty) as int) as n from t""")
def x23_tiles_for_disc(spark, sf_dir):
    k = F.col("n_nationkey")
    d = table(spark, sf_dir, "nation").select(k.alias("k"), (565000.0 + k * 311).alias("x"), (5360000.0 + k * 173).alias("y"))
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - 1500) / 1000), F.floor((F.col(c) + 1500) / 1000)))
    t = d.withColumn("i", span("x")).withColumn("j", span("y"))
    t = t.select("k", (F.col("i") * 1000).alias("tx"), (F.col("j") * 1000).alias("ty"), F.hypot(F.col("i") * 1000 + 500 - F.col("x"), F.col("j") * 1000 + 500 - F.col("y")).alias("d"))
    return t.withColumn("n", R.rank_by("k", F.round("d", 6), "tx", "ty")).drop("d")


@query("""with e as (select p_partkey, p_name, row_number() over (partition by lower(p_name) order by p_partkey) as n from part)
select p_partkey from e where n = 1 and not exists (select 1 from supplier where s_suppkey = p_partkey)""")
def j26_anti_existing(spark, sf_dir):
    first = R.best_per(table(spark, sf_dir, "part").withColumn("key", F.lower("p_name")), "key", "p_partkey")
    return first.join(table(spark, sf_dir, "supplier"), F.col("p_partkey") == F.col("s_suppkey"), "left_anti").select("p_partkey")


@query("""with u as (select user_id as id, value, event_id as gen from events), s as (select *, row_number() over (partition by id order by gen desc) as n from u) select id, value, gen from s where n = 1""")
def u03_union_store(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "value", F.col("event_id").alias("gen"))
    return R.best_per(rows, "id", F.desc("gen"))


@query("select node, cast(min(ord) as bigint) as ord from (select c_nationkey as node, c_custkey as ord from customer union all select s_nationkey, s_suppkey + 1000000 from supplier) group by node")
def u01_union_first_seen(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("node"), F.col("c_custkey").alias("ord"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("node"), (F.col("s_suppkey") + 1000000).alias("ord"))
    return a.unionByName(b).groupBy("node").agg(F.min("ord").alias("ord"))


@query(f"""with {TRACKS} select user_id, round(30 * greatest(3, ceil(max(t_sec) / 60)), 6) as frames, cast(greatest(3, ceil(max(t_sec) * 30 / 4800)) as bigint) as stride, round(least(12000, greatest(500, max(t_sec) * 5.5)), 6) as length_m,
  cast(round_even(least(max(t_sec), 100) * 0.37, 0) as bigint) as pose from tracks group by user_id""")
def x44_run_parameters(spark, sf_dir):
    d = F.max("t_sec")
    return tracks(spark, sf_dir).groupBy("user_id").agg(
        F.round(30.0 * F.greatest(F.lit(3), F.ceil(d / 60)), 6).alias("frames"),
        F.greatest(F.lit(3), F.ceil(d * 30 / 4800)).alias("stride"),
        F.round(F.least(F.lit(12000.0), F.greatest(F.lit(500.0), d * 5.5)), 6).alias("length_m"),
        F.rint(F.least(d, F.lit(100.0)) * 0.37).cast("long").alias("pose"),
    )
