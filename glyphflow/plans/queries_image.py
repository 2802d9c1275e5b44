"""Queries of page images. A page's text is its bitmap: 64 pixels a row, the letters' codes as gray."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glyphflow.operators import image, page
from glyphflow.plans.catalog import query, read
from glyphflow.sources import png

WIDE = 64


def bitmap(spark, d):
    rows = read(spark, d, "pages").select(F.col("page_id").alias("page"), F.posexplode(F.split("html", "")).alias("i", "c")).where("c != ''")
    return rows.select("page", F.floor(F.col("i") / WIDE).cast("int").alias("y"), (F.col("i") % WIDE).alias("x"), F.least(F.ascii("c"), F.lit(255)).alias("v"))


BITMAP_SQL = f"""(SELECT page, ((i - 1) // {WIDE})::INTEGER AS y, ((i - 1) % {WIDE})::INTEGER AS x, least(unicode(c), 255) AS v
  FROM (SELECT page_id AS page, unnest(string_split(html, '')) AS c, generate_subscripts(string_split(html, ''), 1) AS i FROM pages) WHERE c <> '')"""
COLOURS_SQL = f"(SELECT page, y, x, v AS r, v * 7 % 256 AS g, v * 3 % 256 AS b FROM {BITMAP_SQL})"
INK_SQL = f"(SELECT page, y, x FROM {BITMAP_SQL} WHERE chr(v::INTEGER) IN ('a', 'e', 'i', 'o'))"


def coloured(spark, d):
    return bitmap(spark, d).select("page", "y", "x", F.col("v").alias("r"), (F.col("v") * 7 % 256).alias("g"), (F.col("v") * 3 % 256).alias("b"))


def bitmap_pieces(spark, d):
    """The bitmap as ``image.packed`` gives it, each text packed where it is read."""

    def run(batches):
        for batch in batches:
            of, rows = [], []
            for i, t in enumerate(batch.column("html").to_pylist()):
                v = np.minimum(np.frombuffer(t.encode("utf-32-le"), "<u4"), 255).astype(np.uint8)
                for band, s in enumerate(range(0, len(v), WIDE * image.BAND)):
                    level = v[s : s + WIDE * image.BAND]
                    place = np.arange(len(level))
                    of.append(i)
                    rows.append((band, len(level), *image.piece(place // WIDE, place % WIDE, level)))
            columns = [batch.column("page").take(pa.array(of, pa.int32())), *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))]]
            yield pa.RecordBatch.from_arrays(columns, names=["page", "band", "n", "size", "data"])

    rows = read(spark, d, "pages").select(F.col("page_id").alias("page"), "html").dropna()
    return rows.mapInArrow(run, f"page {rows.schema['page'].dataType.simpleString()}, {image.PIECES}")


def inked(spark, d):
    return bitmap(spark, d).where(F.chr("v").isin("a", "e", "i", "o")).select("page", "y", "x")


def inked_runs(spark, d):
    """The ink as ``image.packed_runs`` gives it, each text packed where it is read."""

    def run(batches):
        for batch in batches:
            of, bands, data = [], [], []
            for i, t in enumerate(batch.column("html").to_pylist()):
                at = np.flatnonzero(np.isin(np.frombuffer(t.encode("utf-32-le"), "<u4"), [ord(c) for c in "aeio"]))
                y, x = at // WIDE, at % WIDE
                for band in range(int(y[0]) // image.TALL, int(y[-1]) // image.TALL + 1) if len(at) else ():
                    s, e = np.searchsorted(y, [band * image.TALL, (band + 1) * image.TALL])
                    if e > s:
                        of.append(i)
                        bands.append(band)
                        data.append(np.stack([y[s:e] - band * image.TALL, x[s:e], np.zeros(e - s, np.int64)]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("page").take(pa.array(of, pa.int32())), pa.array(bands, pa.int64()), pa.array(data, pa.binary())], names=["page", "band", "data"])

    rows = read(spark, d, "pages").select(F.col("page_id").alias("page"), "html").dropna()
    return rows.mapInArrow(run, f"page {rows.schema['page'].dataType.simpleString()}, band long, data binary")


def summed(rows, value: str):
    """One row a page: the sum of the values, and of the values by place."""
    place = F.col("y") * WIDE + F.col("x") + 1
    return rows.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("long")).alias("total"), F.sum(F.col(value).cast("long") * place).alias("placed"))


def summed_ink(pieces):
    """``summed`` of packed ink."""

    def run(batches):
        for batch in batches:
            rows, out = {c: batch.column(c) for c in batch.schema.names}, []
            for i, n in enumerate(rows["n"].to_pylist()):
                total = placed = None
                if rows["ink"][i].is_valid:
                    y, x, _ = image.unpacked(rows, i, True)
                    place = (y * WIDE + x + 1)[image.inked(rows, i)]
                    total, placed = len(place), int(place.sum())
                out.append((n, total, placed))
            yield pa.RecordBatch.from_arrays([rows["page"], *[pa.array([o[k] for o in out], pa.int64()) for k in range(3)]], names=["page", "n", "total", "placed"])

    kind = pieces.schema["page"].dataType.simpleString()
    return pieces.mapInArrow(run, f"page {kind}, n long, total long, placed long").groupBy("page").agg(*[F.sum(c).alias(c) for c in ("n", "total", "placed")])


SUMMED_SQL = f"count(*) AS n, sum(v)::BIGINT AS total, sum(v * (y * {WIDE} + x + 1))::BIGINT AS placed"


@query("g02_luminance", f"""WITH l AS (SELECT page, y, x, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS v FROM {COLOURS_SQL}),
  e AS (SELECT page, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM l GROUP BY page),
  s AS (SELECT page, y, x, CASE WHEN hi - lo < 1 THEN 255 ELSE floor(least(greatest((v - lo) * (255.0::DOUBLE / (hi - lo)), 0), 255))::INTEGER END AS v FROM l JOIN e USING (page))
  SELECT page, {SUMMED_SQL} FROM s GROUP BY page""")
def g02_luminance(spark, d):
    lum = image.luminance(F.col("r"), F.col("g"), F.col("b"))
    return summed(image.stretched(coloured(spark, d).select("page", "y", "x", lum.alias("v"))), "v")


query("g02_to_gray")(lambda spark, d: summed(image.to_gray(coloured(spark, d)), "v"))


@query("g03_binarize", f"""WITH p AS (SELECT page, y, x, v FROM {BITMAP_SQL}),
  f AS (SELECT page, avg((v > 40 AND v < 215)::INTEGER) AS middle, greatest(5, ceil(least(max(y) + 1, max(x) + 1) / 75.0))::INTEGER AS cell FROM p GROUP BY page),
  r AS (SELECT p.*, middle, y // cell AS cy, x // cell AS cx FROM p JOIN f USING (page)), c AS (SELECT page, cy, cx, max(v) AS top FROM r GROUP BY ALL),
  m AS (SELECT a.page, a.cy, a.cx, max(b.top) AS most FROM c a JOIN c b ON a.page = b.page AND abs(a.cy - b.cy) <= 1 AND abs(a.cx - b.cx) <= 1 GROUP BY ALL),
  g AS (SELECT a.page, a.cy, a.cx, avg(b.most) AS ground FROM m a JOIN m b ON a.page = b.page AND abs(a.cy - b.cy) <= 1 AND abs(a.cx - b.cx) <= 1 GROUP BY ALL),
  l AS (SELECT r.*, floor(least(v / greatest(ground, 1.0::DOUBLE) * 255.0::DOUBLE, 255))::INTEGER AS norm FROM r JOIN g USING (page, cy, cx)),
  h AS (SELECT page, norm, count(*) AS n FROM l GROUP BY ALL), s AS (SELECT page, norm, sum(n) OVER w AS w0, sum(n * norm) OVER w AS s0, sum(n) OVER (PARTITION BY page) AS w, sum(n * norm) OVER (PARTITION BY page) AS s FROM h WINDOW w AS (PARTITION BY page ORDER BY norm)),
  b AS (SELECT page, norm, round(CASE WHEN w - w0 > 0 THEN pow((s0 * w - s * w0)::DOUBLE / w, 2) / (w0 * (w - w0)) ELSE 0 END, 4) AS b FROM s),
  t AS (SELECT page, arg_max(norm, {{'b': b, 't': -norm}}) AS threshold FROM b GROUP BY page),
  i AS (SELECT page, y, x, (CASE WHEN middle < 0.01 THEN l.v < 128 ELSE norm < threshold END)::INTEGER AS v FROM l JOIN t USING (page))
  SELECT page, {SUMMED_SQL} FROM i GROUP BY page""")
def g03(spark, d):
    return summed_ink(image.binarized(bitmap_pieces(spark, d)))


RUNS_SQL = f"(SELECT page, y, min(x) AS x0, max(x) AS x1 FROM (SELECT page, y, x, x - row_number() OVER (PARTITION BY page, y ORDER BY x) AS g FROM {INK_SQL}) GROUP BY page, y, g)"
LABEL_SQL = f"""r AS MATERIALIZED (SELECT page, y, x0, x1 FROM {RUNS_SQL}),
  e AS MATERIALIZED (SELECT a.page, a.y AS ya, a.x0 AS xa, b.y AS yb, b.x0 AS xb FROM r a JOIN r b ON a.page = b.page AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1),
  reach AS (SELECT page, y, x0, y AS ly, x0 AS lx FROM r UNION SELECT e.page, e.yb, e.xb, reach.ly, reach.lx FROM reach JOIN e ON e.page = reach.page AND e.ya = reach.y AND e.xa = reach.x0),
  named AS (SELECT page, y, x0, min(ly * {WIDE} + lx) AS label FROM reach GROUP BY ALL)"""


@query("g04_components", f"""WITH RECURSIVE {LABEL_SQL}
  SELECT page, label::BIGINT AS label, sum(x1 - x0 + 1)::BIGINT AS area, count(*) AS n_runs, min(y) AS y0, max(y) AS y1, min(x0) AS x0, max(x1) AS x1 FROM named JOIN r USING (page, y, x0) GROUP BY page, label""")
def g04(spark, d):
    found = image.components(image.labelled(image.pieces(inked(spark, d))))
    at = F.split("label", ":")
    return found.withColumn("label", F.get(at, F.lit(1)).cast("long") * WIDE + F.get(at, F.lit(2)).cast("long"))


@query("g04_strokes", f"""WITH RECURSIVE {LABEL_SQL}, z AS (SELECT page, label, x1 - x0 + 1 AS n FROM named JOIN r USING (page, y, x0)), p AS (SELECT page, label, sum(n) AS area FROM z GROUP BY ALL),
  l AS (SELECT page, quantile_cont(area, 0.9) AS large, count(*) AS k FROM p GROUP BY page), s AS (SELECT page, quantile_cont(n::DOUBLE, 0.5) AS s FROM z GROUP BY page),
  t AS (SELECT page, quantile_cont(n::DOUBLE, 0.5) AS t FROM z JOIN p USING (page, label) JOIN l USING (page) WHERE k > 1 AND area >= large GROUP BY page)
  SELECT page, CASE WHEN t >= 2 * s THEN t ELSE s END AS stroke FROM s LEFT JOIN t USING (page)""")
def g04_strokes(spark, d):
    marked = image.labelled(image.pieces(inked(spark, d)))
    return image.stroke_width(marked, image.components(marked))


def _best_sql(source: str) -> str:
    return f"""SELECT page, -(max({{'s': sharp, 't': -tenths}}).t) AS tenths FROM (SELECT page, tenths, sum(d * d) AS sharp FROM
      (SELECT page, tenths, place, sum(d) AS d FROM (SELECT page, tenths, place, n AS d FROM {source} UNION ALL SELECT page, tenths, place + 1, -n FROM {source}) GROUP BY ALL) GROUP BY ALL) GROUP BY page"""


def _bins_sql(source: str) -> str:
    return f"SELECT page, tenths, floor((x0 + x1) / 2 * cos(radians(tenths / 10)) + y * sin(radians(tenths / 10)) + 0.5)::BIGINT AS place, sum(x1 - x0 + 1) AS n FROM {source} GROUP BY ALL"


@query("g05_skew", f"""WITH r AS MATERIALIZED (SELECT * FROM {RUNS_SQL}), a AS ({_bins_sql('(SELECT r.*, unnest(range(-50, 51, 5)) AS tenths FROM r)')}), f AS ({_best_sql('a')}),
  b AS ({_bins_sql('(SELECT r.*, unnest(range(f.tenths - 5, f.tenths + 6)) AS tenths FROM r JOIN f USING (page))')}), g AS ({_best_sql('b')})
  SELECT page, tenths / 10 AS angle FROM g""")
def g05(spark, d):
    return image.skew(image.runs(inked(spark, d)))


query("m08_columns")(lambda spark, d: image.columned(inked_runs(spark, d)))


@query("io09_io16_png", f"SELECT page, {SUMMED_SQL} FROM {BITMAP_SQL} GROUP BY page")
def png_round(spark, d):
    files = png.images(bitmap(spark, d))
    size = bitmap(spark, d).groupBy("page").agg(F.count(F.lit(1)).alias("size"))  # the last row of a bitmap may be short
    sized = files.join(size.hint("merge"), "page").select(F.struct("page", "size").alias("page"), "content")
    back = png.pixels(sized, "page").where(F.col("y") * WIDE + F.col("x") < F.col("page.size"))
    return summed(back.select(F.col("page.page").alias("page"), "y", "x", F.col("r").alias("v")), "v")


def _said(way: int) -> str:
    return f"event_id * {way // 90 + 5} % 37 AS l, (event_id * 13 + {way % 1000 * 7}) % 100 / 100.0"


def _cascade_sql() -> str:
    now = "SELECT event_id, event_id % 10 / 100.0::DOUBLE AS gain, CASE WHEN event_id % 11 <> 0 THEN event_id * 5 % 37 END AS letters, CASE WHEN event_id % 11 <> 0 THEN event_id * 13 % 100 / 100.0::DOUBLE END AS confidence, CASE WHEN event_id % 11 <> 0 THEN 0 END AS way FROM events"
    bad = "(letters IS NULL OR letters < 10 OR confidence < 0.9::DOUBLE)"
    now = f"SELECT *, {bad} AS poor FROM ({now})"
    for way in (*page.TURNS, page.LOCAL):
        needs = bad if way == page.LOCAL else "(poor OR gain >= 0.05::DOUBLE)" if way == 180 else "poor"
        had, sure = "coalesce(letters * confidence, 0::DOUBLE)", "coalesce(confidence, 0::DOUBLE)"
        wins = f"{needs} AND c >= 0.85::DOUBLE AND l >= 10 AND (l * c > 1.5::DOUBLE * {had} OR (c >= {sure} + 0.03::DOUBLE AND l * c >= 0.9::DOUBLE * {had}))"
        now = f"SELECT event_id, gain, poor, CASE WHEN w THEN l ELSE letters END AS letters, CASE WHEN w THEN c ELSE confidence END AS confidence, CASE WHEN w THEN {way} ELSE way END AS way FROM (SELECT *, {wins} AS w FROM (SELECT *, {_said(way)}::DOUBLE AS c FROM ({now})))"
    return f"SELECT event_id AS page, way::INTEGER AS way, letters, confidence FROM ({now})"


@query("m09_cascade", _cascade_sql())
def m09(spark, d):
    """Readings made up from the page's number: some pages can't be read upright."""

    def reading(pages, way):
        rows = pages if way else pages.where(F.col("page") % 11 != 0)
        return rows.select("page", (F.col("page") * (way // 90 + 5) % 37).alias("letters"), ((F.col("page") * 13 + way % 1000 * 7) % 100 / 100.0).alias("confidence"))

    pages = read(spark, d, "events").select(F.col("event_id").alias("page"), (F.col("event_id") % 10 / 100.0).alias("flip_gain"))
    return page.cascade(pages, reading)
