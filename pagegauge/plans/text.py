"""Text, name and id queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.operators import text as tx
from pagegauge.plans.detection import rounded
from pagegauge.plans.registry import Tables, query, view
from pagegauge.session import spread

# The same patterns in the twin's dialect (RE2: \s and \w are ASCII there, as in Java's default).
_UNION = " UNION ALL ".join(
    f"SELECT doc_id, line_no, line, '{name}' AS pattern, unnest(regexp_extract_all(line, '{p.replace(chr(39), chr(39) * 2)}')) AS hit FROM fx_lines"
    for name, p in tx.PATTERNS.items()
)
view(
    "fx_lines",
    """
    SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (
      SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE NOT contains(text, 'text-scan: allow-file'))
    """,
)
view(
    "fx_pii",
    f"""
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, pattern, hit FROM ({_UNION})
    WHERE NOT contains(line, 'text-scan: allow-line') AND NOT contains(line, '000.000.000-00') AND NOT contains(line, '00000000000')
      AND NOT (contains(hit, '@') AND regexp_matches(lower(string_split(hit, '@')[-1]), '^(example\\.(com|org|net)|localhost|test)$'))
      AND NOT (pattern = 'BR phone' AND NOT regexp_matches(hit, '[()\\-\\s]')) AND NOT (pattern = 'CNS (cartao SUS)' AND NOT regexp_matches(hit, '\\s'))
    """,
)


@query("pii_scan", "SELECT doc_id, line_no, pattern, hit FROM fx_pii")
def pii_scan(t: Tables) -> DataFrame:
    return tx.pii_hits(spread(t.documents.select("doc_id", "text")), "doc_id", "text")


@query(
    "pii_summary",
    """
    SELECT pattern, count(*) AS hits, count(DISTINCT doc_id) AS documents, true AS refused FROM fx_pii GROUP BY pattern
    UNION ALL SELECT NULL, count(*), count(DISTINCT doc_id), count(*) > 0 FROM fx_pii
    """,
)
def pii_summary(t: Tables) -> DataFrame:
    return tx.pii_verdict(tx.pii_hits(spread(t.documents.select("doc_id", "text")), "doc_id", "text"), "doc_id")


@query(
    "scan_text_corpus",
    """
    SELECT lang, source, count(*) AS texts, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, max(strlen(text)) AS max_bytes
    FROM documents WHERE NOT contains(text, 'text-scan: allow-file') GROUP BY lang, source
    """,
)
def scan_text_corpus(t: Tables) -> DataFrame:
    return tx.admitted(t.documents, "text").groupBy("lang", "source").agg(
        F.count("*").alias("texts"),
        F.sum(F.size(F.split("text", "\n", -1))).alias("lines"),
        F.max(F.octet_length("text")).cast("bigint").alias("max_bytes"),
    )


_KINDS = ["png", "ts", "pdf", "md", "mp4"]
view(
    "fx_files",
    f"""
    SELECT doc_id, source, lang || '/' || source || '/' || doc_id || '.' || {_KINDS}[doc_id % 5 + 1] AS path FROM documents
    """,
)
# Folders by what the labels say of their documents: languages hold media, toxic sources are closed.
view(
    "fx_folder_rules",
    """
    SELECT source AS folder, coalesce(sum(toxic), 0) * 4 > count(toxic) AS forbidden, false AS media
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
    UNION ALL SELECT lang, false, coalesce(avg(quality), 0) >= 0.5 FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
    """,
)


def files(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    doc = F.col("doc_id")
    kind = F.get(kinds, (doc % 5).cast("int"))
    return t.documents.select("doc_id", "lang", F.concat("lang", F.lit("/"), "source", F.lit("/"), doc.cast("string"), F.lit("."), kind).alias("path"))


def folder_rules(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")
    sources = rows.groupBy(F.col("source").alias("folder")).agg(
        (F.coalesce(F.sum("toxic"), F.lit(0)) * 4 > F.count("toxic")).alias("forbidden"), F.lit(False).alias("media")
    )
    langs = rows.groupBy(F.col("lang").alias("folder")).agg(
        F.lit(False).alias("forbidden"), (F.coalesce(F.avg("quality"), F.lit(0.0)) >= 0.5).alias("media")
    )
    return sources.unionByName(langs)


_MEDIA = "('png', 'pdf', 'mp4')"


@query(
    "forbidden_path_scan",
    f"""
    SELECT path, 'forbidden path' AS problem FROM fx_files JOIN fx_folder_rules r ON r.folder = source WHERE r.forbidden
    UNION ALL SELECT path, 'media outside its folders' FROM fx_files JOIN fx_folder_rules r ON r.folder = string_split(path, '/')[1]
      WHERE string_split(path, '.')[-1] IN {_MEDIA} AND NOT r.media
    """,
)
def forbidden_path_scan(t: Tables) -> DataFrame:
    return tx.path_problems(files(t), folder_rules(t))


@query(
    "fixture_provenance_anti",
    f"""
    SELECT path FROM fx_files WHERE path LIKE 'en/%' AND string_split(path, '.')[-1] IN {_MEDIA}
      AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = fx_files.doc_id AND l.quality = 1)
    """,
)
def fixture_provenance_anti(t: Tables) -> DataFrame:
    named = files(t).join(t.labels.where("quality = 1"), "doc_id", "left_semi")
    names = named.select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return tx.unproven_fixtures(files(t), names, "en/").select("path")


@query(
    "slugify",
    """
    SELECT doc_id, CASE WHEN s = '' THEN 'documento' ELSE s END AS slug FROM (
      SELECT doc_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(strip_accents(translate(lower(text), 'đ', 'd'))),
        '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 24), '-+$', '') AS s FROM documents)
    """,
)
def slugify(t: Tables) -> DataFrame:
    """A document's name from its text; only the name itself is short."""
    return t.documents.select("doc_id", tx.slug(F.col("text")).alias("slug"))


@query(
    "pdf_file_name",
    """
    SELECT o_orderkey, strftime(o_orderdate + INTERVAL (o_orderkey % 1440) MINUTE, '%Y%m%d-%H%M') || '_'
      || lower(regexp_replace(o_orderpriority, '[^a-zA-Z0-9]+', '-', 'g')) || '.pdf' AS name FROM orders
    """,
)
def pdf_file_name(t: Tables) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(
        F.lit(0), F.lit(0), (F.col("o_orderkey") % 1440).cast("int"), F.lit(0)
    )
    return t.orders.select("o_orderkey", tx.pdf_file_name(F.col("o_orderpriority"), at).alias("name"))


@query(
    "id_strings",
    """
    SELECT doc_id, replace(path, '/', chr(92)) AS given, path AS still_id, 'clip-' || doc_id % 7 || '@' || CAST(floor(doc_id * 1000 / 15.0 + 0.5) AS BIGINT) || 'ms' AS frame_id,
      nullif(trim(regexp_replace(string_split(path, '/')[-1], '\\.pdf$', '', 'i')), '') AS title FROM fx_files
    """,
)
def id_strings(t: Tables) -> DataFrame:
    """Path-derived ids: separators unified, frame ids with milliseconds, titles without ``.pdf``."""
    doc = F.col("doc_id")
    given = F.replace(F.col("path"), F.lit("/"), F.lit("\\"))
    rows = files(t).withColumn("given", given).withColumn("still_id", F.replace(F.col("given"), F.lit("\\"), F.lit("/")))
    ms = F.floor(doc * 1000 / 15.0 + 0.5).cast("string")
    frame = F.concat(F.lit("clip-"), (doc % 7).cast("string"), F.lit("@"), ms, F.lit("ms"))
    base = F.element_at(F.split("still_id", "/"), -1)
    title = F.nullif(F.trim(F.regexp_replace(base, r"(?i)\.pdf$", "")), F.lit(""))
    return rows.select("doc_id", "given", "still_id", frame.alias("frame_id"), title.alias("title"))


@query(
    "natural_page_order",
    """
    SELECT l_orderkey, name, row_number() OVER (PARTITION BY l_orderkey ORDER BY num, name) AS place FROM (
      SELECT DISTINCT l_orderkey, l_partkey AS num, 'IMG_' || l_partkey || '.jpg' AS name FROM lineitem)
    """,
)
def natural_page_order(t: Tables) -> DataFrame:
    """Files of a folder in numeric-aware name order."""
    from pagegauge.operators.ordered import ordered

    name = F.concat(F.lit("IMG_"), F.col("l_partkey").cast("string"), F.lit(".jpg"))
    rows = t.lineitem.select("l_orderkey", name.alias("name")).distinct()
    rows = rows.withColumn("sort_key", tx.natural_key(F.col("name")))
    # Names are sliced by the first digits of their number, so a folder is never one task.
    number = F.regexp_extract("name", r"(\d+)", 1).cast("bigint")
    placed = ordered(rows.withColumn("number", number), ["l_orderkey"], ["sort_key"], 100_000, axis="number")
    counted = placed.step(running={"place": F.lit(1).cast("bigint")}).result()
    return counted.select("l_orderkey", "name", "place")


@query(
    "date_functions",
    """
    SELECT event_id, epoch_us(ts) // 1000 AS at_ms, strftime(ts, '%Y%m%d-%H%M') AS stamp,
           epoch_us(ts) // 1000 - epoch_us(date_trunc('day', ts)::TIMESTAMP) // 1000 AS ms_of_day FROM events
    """,
)
def date_functions(t: Tables) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    day = F.unix_millis(F.date_trunc("day", at))
    return t.events.select(
        "event_id",
        F.unix_millis(at).alias("at_ms"),
        F.date_format(at, "yyyyMMdd-HHmm").alias("stamp"),
        (F.unix_millis(at) - day).alias("ms_of_day"),
    )


@query(
    "json_functions",
    "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, 'k' AS keys FROM events",
)
def json_functions(t: Tables) -> DataFrame:
    """A payload read through its schema, and its keys."""
    return t.events.select(
        "event_id",
        F.from_json("props", "k int")["k"].alias("k"),
        F.concat_ws(",", F.json_object_keys("props")).alias("keys"),
    )


@query(
    "map_functions",
    """
    SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id)::BIGINT AS total FROM events GROUP BY user_id, event_type
    """,
)
def map_functions(t: Tables) -> DataFrame:
    """Counter maps per session, merged and read back."""
    counted = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counted.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counts"))
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("bigint"), lambda s, n: s + n)
    return maps.select("user_id", F.explode("counts").alias("event_type", "n"), total.alias("total"))


@query(
    "math_functions",
    """
    SELECT event_id, round(1 / (1 + (1 / (2 * pi() * (1 + value))) / 0.1), 6) AS alpha, round(least(400, greatest(120, value * 3)), 6) AS clamped,
      round(CASE WHEN value <= 10 THEN 0.2 * value WHEN value <= 50 THEN 2 + (value - 10) * 0.1 WHEN value <= 200 THEN 6 + (value - 50) * 0.02 ELSE 9 END, 6) AS curve
    FROM events
    """,
)
def math_functions(t: Tables) -> DataFrame:
    """Smoothing share, clamp, and a piecewise-linear curve through fixed knots."""
    v = F.col("value")
    knots = [(0.0, 0.0), (10.0, 2.0), (50.0, 6.0), (200.0, 9.0)]
    curve = F.lit(knots[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:]))):
        curve = F.when(v <= x1, y0 + (v - x0) * ((y1 - y0) / (x1 - x0))).otherwise(curve)
    alpha = 1 / (1 + (1 / (2 * F.pi() * (1 + v))) / 0.1)
    clamped = F.least(F.lit(400.0), F.greatest(F.lit(120.0), v * 3))
    return rounded(t.events.select("event_id", alpha.alias("alpha"), clamped.alias("clamped"), curve.alias("curve")))


@query(
    "stable_hash",
    "SELECT doc_id, sha256(source || '/' || doc_id) AS key_hash FROM documents WHERE ('0x' || substr(sha256(source || '/' || doc_id), 1, 4))::INTEGER % 4 = 0",
)
def stable_hash(t: Tables) -> DataFrame:
    """A reproducible quarter of the documents, chosen by the hash of their key."""
    key = F.sha2(F.concat_ws("/", "source", F.col("doc_id").cast("string")), 256)
    slot = F.conv(F.substring(key, 1, 4), 16, 10).cast("int") % 4
    return t.documents.where(slot == 0).select("doc_id", key.alias("key_hash"))
