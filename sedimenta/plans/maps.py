"""Queries on self-organising maps and images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import image as im
from sedimenta.operators import joins, linalg, som
from sedimenta.operators.density import watershed
from sedimenta.plans.vectors import embeddings, training
from sedimenta.session import cut, table

#: Columns of the map whose neurons are mean vectors of (label, vec_id mod COLUMNS); its rows are the labels.
COLUMNS = 8
MAP_ROWS, MAP_COLUMNS = 82, 137


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(neuron, row, col, w): a map made of the mean vectors of every (label, vec_id mod 8); a cell without any has its label's mean."""
    e = embeddings(spark, sf_dir).select(F.col("label").cast("long").alias("row"), (F.col("vec_id") % COLUMNS).alias("col"), F.posexplode("v").alias("d", "x"))
    own = e.groupBy("row", "col", "d").agg(F.avg("x").alias("x"))
    label = e.groupBy("row", "d").agg(F.avg("x").alias("mean")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(COLUMNS - 1)).cast("array<long>")))
    m = label.join(own, ["row", "col", "d"], "left").select("row", "col", "d", F.coalesce("x", "mean").alias("x"))
    w = m.groupBy("row", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("w"))
    return w.select((F.col("row") * COLUMNS + F.col("col")).alias("neuron"), "row", "col", "w")


def project(spark, sf_dir):
    """Best matching neuron of every vector, counted per neuron and label with the mean distance."""
    ids, w = joins.codebook(codebook(spark, sf_dir), "neuron", "w")
    best = joins.nearest_neuron(embeddings(spark, sf_dir), "v", ids, w, ["vec_id", "label"])
    return best.groupBy("neuron", "label").agg(F.count("*").alias("n"), F.round(F.avg(F.sqrt("distance2")), 6).alias("mean_distance"))


def classify(spark, sf_dir):
    """Class of every vector by its neuron, where a neuron's class is its row and rows 0 and 1 are masked out."""
    from sedimenta.operators.classify import by_neuron

    book = codebook(spark, sf_dir)
    ids, w = joins.codebook(book, "neuron", "w")
    best = joins.nearest_neuron(embeddings(spark, sf_dir), "v", ids, w, ["vec_id"])
    return by_neuron(best, book.where("row > 1").select("neuron", F.col("row").cast("int").alias("class"))).groupBy("class").agg(F.count("*").alias("n"))


def u_matrix(spark, sf_dir):
    """Mean distance of each neuron to its four neighbours on the toroid, scaled to 0 .. 1."""
    book = codebook(spark, sf_dir)
    rows = book.agg(F.max("row") + 1).first()[0]
    return som.u_matrix(book, rows, COLUMNS).select("neuron", F.round("height", 6).alias("height"))


def neighbour_counts(spark, sf_dir):
    """How many neurons of the large map have each number of neighbours within radius 3, in three metrics."""
    grid = som.cells(spark, MAP_ROWS, MAP_COLUMNS)
    out = None
    for kind in ("squared", "manhattan", "max"):
        n = som.neighbours(grid, MAP_ROWS, MAP_COLUMNS, som.offsets(MAP_ROWS, MAP_COLUMNS, 3, kind)).groupBy("neuron").agg(F.countDistinct("neighbour").alias("neighbours"))
        part = n.groupBy("neighbours").agg(F.count("*").alias("n")).withColumn("metric", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


def cooling(spark, sf_dir):
    """Radius and learning rate of 20 epochs from 51 to 1 and from 1.0 to 0.1, linear, and exponential rates."""
    rows = [(e, som.linear(51, 1, 20, e, True), round(som.linear(1.0, 0.1, 20, e), 6), round(som.exponential(1.0, 0.1, 20, e), 6)) for e in range(20)]
    return spark.createDataFrame(rows, "epoch long, radius int, rate double, exponential double")


def kernels(spark, sf_dir):
    """Kernel weights by squared distance for radius 4."""
    x = np.arange(17.0)
    rows = [(int(d), *[round(float(som.kernel(k, x, 16.0)[d]), 8) for k in ("gauss", "mexhat", "cone", "epanechnikov", "bubble")]) for d in range(17)]
    return spark.createDataFrame(rows, "x long, gauss double, mexhat double, cone double, epanechnikov double, bubble double")


def batch_epoch(spark, sf_dir):
    """One batch epoch with a Gaussian kernel of radius 2: every neuron moves half-way to the weighted mean of the vectors around it."""
    book = codebook(spark, sf_dir)
    ids, w = joins.codebook(book, "neuron", "w")
    after = som.batch_epoch(embeddings(spark, sf_dir), "v", w, len(w) // COLUMNS, COLUMNS, 2.0, 0.5, "gauss")
    rows = [(int(i), round(float(a.sum()), 5), round(float(np.abs(a).max()), 5)) for i, a in zip(ids, after)]
    return spark.createDataFrame(rows, "neuron long, total double, largest double")


def train(spark, sf_dir):
    """A map of 12 x 20 trained in batches on the training vectors from a principal-component start: quantisation error per epoch."""
    v = cut(training(spark, sf_dir).select("data_index", "v"))
    m = linalg.moments(v, "v")[""]
    rows, columns = 12, 20
    schedule = som.Schedule(epochs=8, radius=(8, 1), rate=(1.0, 0.6))
    _, errors = som.train_batch(v, "v", som.initial("pca", m, rows, columns), rows, columns, schedule, measure=True)
    out = [(epoch, *map(float, schedule.at(epoch)), errors[epoch + 1]) for epoch in range(schedule.epochs)]
    return spark.createDataFrame(out, "epoch int, radius double, rate double, error double")


def best_match_distance(spark, sf_dir):
    """Classes of points by the distance to their best match, at most 31."""
    from sedimenta.operators.classify import distance_bin

    b = table(spark, sf_dir, "bestmatches").where("distance IS NOT NULL").groupBy("data_index").agg(F.min("distance").alias("distance"))
    return b.groupBy(distance_bin(F.col("distance") * 10).alias("class")).agg(F.count("*").alias("n"))


def match_distances(spark, sf_dir):
    """Distance of every vector to its stored best match, by a join of matches, vectors and weights."""
    book, e = cut(codebook(spark, sf_dir)), embeddings(spark, sf_dir)
    ids, w = joins.codebook(book, "neuron", "w")
    best = joins.nearest_neuron(e, "v", ids, w, ["vec_id"])
    at = best.select(F.col("vec_id").alias("index"), F.floor(F.col("neuron") / COLUMNS).alias("row"), (F.col("neuron") % COLUMNS).alias("col"))
    return joins.match_distances(e, at, book, "vec_id", "v").select("index", "row", "col", F.round("distance", 6).alias("distance"))


def local_matches(spark, sf_dir):
    """Best matches among the neurons at most one row and column from the one that the vector's id names."""
    book = cut(codebook(spark, sf_dir))
    ids, w = joins.codebook(book, "neuron", "w")
    e = embeddings(spark, sf_dir).withColumn("was", F.col("vec_id") % len(ids))
    return joins.local_neuron(e, "v", "was", ids, w, COLUMNS, ["vec_id"], 1).select("vec_id", "neuron", F.round(F.sqrt("distance2"), 6).alias("distance"))


def render(spark, sf_dir):
    """The U-matrix zoomed twice and coloured with 16 colours, with the vectors' labels drawn over it: pixels per colour and class."""
    book = cut(codebook(spark, sf_dir))
    rows = book.agg(F.max("row") + 1).first()[0]
    ids, w = joins.codebook(book, "neuron", "w")
    picture = im.zoom(som.u_matrix(book, rows, COLUMNS).select("row", "col", F.col("height").alias("v")), rows, COLUMNS, 2)
    best = joins.nearest_neuron(embeddings(spark, sf_dir), "v", ids, w, ["label"])
    dots = im.overlay(best.select(F.floor(F.col("neuron") / COLUMNS).alias("row"), (F.col("neuron") % COLUMNS).alias("col"), F.col("label").alias("class")), 1, 2)
    pixels = picture.join(dots, ["row", "col"], "left").select(im.palette_index(F.round("v", 9), 16).alias("colour"), F.coalesce("class", F.lit(-1)).alias("class"))
    return pixels.groupBy("colour", "class").agg(F.count("*").alias("n"))


# images ------------------------------------------------------------------------------------------------------------
def picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, v): best matches per cell of the large map, scaled to 0 .. 1."""
    n = table(spark, sf_dir, "bestmatches").where("bm_row IS NOT NULL AND bm_col IS NOT NULL").groupBy(F.col("bm_row").cast("long").alias("row"), F.col("bm_col").cast("long").alias("col")).agg(F.count("*").alias("n"))
    top = n.agg(F.max("n").alias("top"))
    grid = som.cells(spark, MAP_ROWS, MAP_COLUMNS).select("row", "col")
    return grid.join(n, ["row", "col"], "left").crossJoin(F.broadcast(top)).select("row", "col", (F.coalesce("n", F.lit(0)) / F.col("top")).alias("v"))


def _image(f):
    return lambda spark, sf_dir: f(picture(spark, sf_dir)).select("row", "col", F.round("v", 6).alias("v"))


def histogram(spark, sf_dir):
    """Grey levels of the picture."""
    return im.histogram(picture(spark, sf_dir))


def otsu(spark, sf_dir):
    """Threshold between dark and light cells."""
    return im.otsu(im.histogram(picture(spark, sf_dir)))


def palette(spark, sf_dir):
    """Cells per colour of a palette of 64."""
    return picture(spark, sf_dir).groupBy(im.palette_index(F.col("v"), 64).alias("colour")).agg(F.count("*").alias("n"))


def overlay(spark, sf_dir):
    """Pixels of best matches drawn as squares of three on a map of cells of two."""
    b = table(spark, sf_dir, "bestmatches").where("bm_row IS NOT NULL AND bm_col IS NOT NULL").select(F.col("bm_row").cast("long").alias("row"), F.col("bm_col").cast("long").alias("col"), (F.col("data_index") % 5).alias("class"))
    return im.overlay(b, 3, 2)


def basins(spark, sf_dir):
    """Watershed of the map's U-matrix: cells per basin, and the merges above them."""
    heights = u_matrix(spark, sf_dir).orderBy("neuron").collect()
    labels, merges = watershed(np.array([r["height"] for r in heights]).reshape(-1, COLUMNS))
    rows = [("basin", int(b), 0, 0, int((labels == b).sum())) for b in np.unique(labels)] + [("merge", *map(int, m)) for m in merges]
    return spark.createDataFrame(rows, "kind string, label long, left_label long, right_label long, amount long")


def grown(spark, sf_dir):
    """The map widened by half: sums of the new neurons' weights."""
    ids, w = joins.codebook(codebook(spark, sf_dir), "neuron", "w")
    g = som.grow(w, len(w) // COLUMNS, COLUMNS, len(w) // COLUMNS * 3 // 2, COLUMNS * 3 // 2)
    return spark.createDataFrame([(k, float(x.sum())) for k, x in enumerate(g)], "neuron long, total double")


def queries():
    fs = (project, classify, u_matrix, neighbour_counts, cooling, kernels, batch_epoch, train, best_match_distance, match_distances, local_matches, render, basins, grown)
    images = {
        "gaussian": _image(lambda p: im.convolve(p, im.GAUSSIAN, MAP_ROWS, MAP_COLUMNS)), "gradient": _image(lambda p: im.gradient(p, MAP_ROWS, MAP_COLUMNS)), "edges": _image(lambda p: im.convolve(p, im.EDGES, MAP_ROWS, MAP_COLUMNS)),
        "zoom": _image(lambda p: im.zoom(p, MAP_ROWS, MAP_COLUMNS, 2)), "tile": _image(lambda p: im.tile(p, MAP_ROWS, MAP_COLUMNS)), "histogram": histogram, "otsu": otsu, "palette": palette, "overlay": overlay,
    }
    return {f"som_{f.__name__}": f for f in fs} | {f"image_{n}": f for n, f in images.items()}


_BOOK = f"e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT label::BIGINT AS row, vec_id % {COLUMNS} AS col, unnest(v) AS x, unnest(range(0, len(v))) AS d FROM e), om AS (SELECT row, col, d, avg(x) AS x FROM x GROUP BY ALL), lm AS (SELECT row, d, avg(x) AS x FROM x GROUP BY ALL), m AS (SELECT lm.row, c.col, lm.d, coalesce(om.x, lm.x) AS x FROM lm CROSS JOIN range(0, {COLUMNS}) c(col) LEFT JOIN om ON om.row = lm.row AND om.col = c.col AND om.d = lm.d), k AS (SELECT row * {COLUMNS} + col AS neuron, row, col, list(x ORDER BY d) AS w FROM m GROUP BY row, col)"
_BEST = f"{_BOOK}, best AS (SELECT vec_id, label, v, min(struct_pack(d := list_distance(v, w), n := neuron)) AS b FROM e CROSS JOIN k GROUP BY ALL)"
_PIC = f"n AS (SELECT bm_row AS r, bm_col AS c, count(*) AS n FROM bestmatches WHERE bm_row IS NOT NULL AND bm_col IS NOT NULL GROUP BY ALL), p AS (SELECT r.r::BIGINT AS row, c.c::BIGINT AS col, coalesce(n.n, 0) / (SELECT max(n) FROM n)::DOUBLE AS v FROM range(0, {MAP_ROWS}) r(r) CROSS JOIN range(0, {MAP_COLUMNS}) c(c) LEFT JOIN n ON n.r = r.r AND n.c = c.c)"


#: The filters' values once more, as rows of a table: step down, step right, weight.
_GAUSSIAN = """
    (-2,-2,1), (-2,-1,4), (-2,0,7), (-2,1,4), (-2,2,1), (-1,-2,4), (-1,-1,16), (-1,0,26), (-1,1,16), (-1,2,4), (0,-2,7), (0,-1,26), (0,0,41), (0,1,26), (0,2,7),
    (1,-2,4), (1,-1,14), (1,0,26), (1,1,16), (1,2,4), (2,-2,1), (2,-1,4), (2,0,7), (2,1,4), (2,2,1)"""
_ACROSS = """
    (-2,-2,2), (-2,-1,3), (-2,1,-3), (-2,2,-2), (-1,-2,3), (-1,-1,4), (-1,1,-4), (-1,2,-3), (0,-2,6), (0,-1,6), (0,1,-6), (0,2,-6),
    (1,-2,3), (1,-1,4), (1,1,-4), (1,2,-3), (2,-2,2), (2,-1,3), (2,1,-3), (2,2,-2)"""
_ALONG = """
    (-2,-2,2), (-2,-1,3), (-2,0,6), (-2,1,3), (-2,2,2), (-1,-2,3), (-1,-1,4), (-1,0,6), (-1,1,4), (-1,2,3),
    (1,-2,-3), (1,-1,-4), (1,0,-6), (1,1,-4), (1,2,-3), (2,-2,-2), (2,-1,-3), (2,0,-6), (2,1,-3), (2,2,-2)"""
_EDGES = "(-1,-1,0.5), (-1,0,1), (-1,1,0.5), (0,-1,1), (0,0,-6), (0,1,1), (1,-1,0.5), (1,0,1), (1,1,0.5)"


def _conv(taps, divisor=1):
    return f"SELECT p.row, p.col, sum(q.v * t.w / {divisor}::DOUBLE) AS v FROM p CROSS JOIN (VALUES {taps}) t(a, b, w) JOIN p q ON q.row = (p.row + t.a + {MAP_ROWS}) % {MAP_ROWS} AND q.col = (p.col + t.b + {MAP_COLUMNS}) % {MAP_COLUMNS} GROUP BY p.row, p.col"


def oracle_sql():
    metric = lambda name, d: f"SELECT '{name}' AS metric, (SELECT count(*) FROM range(-3, 4) a(a) CROSS JOIN range(-3, 4) b(b) WHERE {d} AND NOT (a = 0 AND b = 0)) AS neighbours, {MAP_ROWS * MAP_COLUMNS}::BIGINT AS n"
    shift = lambda a, b, n: f"(SELECT (row - {a} + {MAP_ROWS}) % {MAP_ROWS} AS row, (col - {b} + {MAP_COLUMNS}) % {MAP_COLUMNS} AS col, v AS {n} FROM p)"
    hist = f"WITH {_PIC} SELECT (floor(v * 255)::INT & 255) AS level, count(*) AS n FROM p GROUP BY 1"
    t = {
        "som_project": f"WITH {_BEST} SELECT b.n AS neuron, label, count(*) AS n, round(avg(b.d), 6) AS mean_distance FROM best GROUP BY ALL",
        "som_classify": f"WITH {_BEST} SELECT CASE WHEN b.n // {COLUMNS} > 1 THEN (b.n // {COLUMNS})::INT ELSE 0 END AS class, count(*) AS n FROM best GROUP BY 1",
        "som_u_matrix": f"""WITH {_BOOK}, s AS (SELECT max(row) + 1 AS rows FROM k), h AS (SELECT a.neuron, avg(list_distance(a.w, b.w)) AS h FROM k a CROSS JOIN s CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) t(dr, dc) JOIN k b ON b.row = (a.row + dr + rows) % rows AND b.col = (a.col + dc + {COLUMNS}) % {COLUMNS} GROUP BY a.neuron)
            SELECT neuron, round((h - min(h) OVER ()) / (max(h) OVER () - min(h) OVER ()), 6) AS height FROM h""",
        "som_neighbour_counts": " UNION ALL ".join((metric("squared", "a * a + b * b <= 9"), metric("manhattan", "abs(a) + abs(b) <= 3"), metric("max", "greatest(abs(a), abs(b)) <= 3"))),
        "som_cooling": "SELECT e AS epoch, (CASE WHEN e = 0 THEN 51 WHEN e >= 19 THEN 1 ELSE ceil(51 - e * 50 / 20.0::DOUBLE) END)::INT AS radius, round(CASE WHEN e = 0 THEN 1 WHEN e >= 19 THEN 0.1 ELSE 1 - e * 0.9::DOUBLE / 20 END, 6) AS rate, round(exp(e * ln(0.1) / 20), 6) AS exponential FROM range(0, 20) r(e)",
        "som_kernels": "SELECT x, round(exp(-(x * x)::DOUBLE / (17 * 17 / 2.0::DOUBLE)), 8) AS gauss, round((1 - pow(3 * x / 17::DOUBLE, 2)) * exp(-pow(3 * x / 17::DOUBLE, 2)), 8) AS mexhat, round((17 - x) / 17::DOUBLE, 8) AS cone, round(1 - x * x / 289::DOUBLE, 8) AS epanechnikov, 1.0::DOUBLE AS bubble FROM range(0, 17) r(x)",
        "som_batch_epoch": f"""WITH {_BEST}, u AS (SELECT b.n AS neuron, unnest(v) AS x, unnest(range(0, len(v))) AS d FROM best), a AS (SELECT neuron, d, sum(x) AS x, count(*) AS n FROM u GROUP BY ALL), o AS (SELECT neuron, row, col, unnest(w) AS w, unnest(range(0, len(w))) AS d FROM k),
            size AS (SELECT max(row) + 1 AS rows FROM k), step AS (SELECT k.neuron AS from_n, o.neuron AS to_n, pow(least(abs(k.row - o.row), rows - abs(k.row - o.row)), 2) + pow(least(abs(k.col - o.col), 8 - abs(k.col - o.col)), 2) AS d2 FROM k CROSS JOIN k o CROSS JOIN size),
            lead AS (SELECT to_n AS neuron, d, sum(x * exp(-d2 * d2 / (25 / 2.0::DOUBLE))) / sum(n * exp(-d2 * d2 / (25 / 2.0::DOUBLE))) AS x FROM step JOIN a ON a.neuron = from_n WHERE d2 <= 4 GROUP BY ALL),
            f AS (SELECT o.neuron, o.d, CASE WHEN lead.x IS NULL THEN w ELSE w + 0.5 * (lead.x - w) END AS w FROM o LEFT JOIN lead USING (neuron, d)) SELECT neuron, round(sum(w), 5) AS total, round(max(abs(w)), 5) AS largest FROM f GROUP BY neuron""",
        "som_best_match_distance": "SELECT least(31, floor(d * 10))::INT AS class, count(*) AS n FROM (SELECT min(distance) AS d FROM bestmatches WHERE distance IS NOT NULL GROUP BY data_index) GROUP BY 1",
        "som_match_distances": f"WITH {_BEST} SELECT vec_id AS index, b.n // {COLUMNS} AS row, b.n % {COLUMNS} AS col, round(b.d, 6) AS distance FROM best",
        "som_local_matches": f"""WITH {_BOOK}, s AS (SELECT max(row) + 1 AS rows FROM k), z AS (SELECT vec_id, v, (vec_id % (rows * {COLUMNS})) // {COLUMNS} AS r, vec_id % {COLUMNS} AS c, rows FROM e CROSS JOIN s),
            d AS (SELECT vec_id, list_distance(v, w) AS d, neuron FROM z JOIN k ON least(abs(k.row - r), rows - abs(k.row - r)) <= 1 AND least(abs(k.col - c), {COLUMNS} - abs(k.col - c)) <= 1) SELECT vec_id, arg_min(neuron, struct_pack(d := d, n := neuron)) AS neuron, round(min(d), 6) AS distance FROM d GROUP BY vec_id""",
        "som_render": f"""WITH {_BEST}, s AS (SELECT max(row) + 1 AS rows FROM k), h AS (SELECT a.row, a.col, avg(list_distance(a.w, b.w)) AS h FROM k a CROSS JOIN s CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) t(dr, dc) JOIN k b ON b.row = (a.row + dr + rows) % rows AND b.col = (a.col + dc + {COLUMNS}) % {COLUMNS} GROUP BY a.row, a.col),
            p AS (SELECT row, col, (h - min(h) OVER ()) / (max(h) OVER () - min(h) OVER ()) AS v, rows FROM h CROSS JOIN s), z AS (SELECT p.row * 2 + a AS row, p.col * 2 + b AS col, sum(q.v * CASE WHEN i = 0 THEN 1 - a / 2.0::DOUBLE ELSE a / 2.0::DOUBLE END * CASE WHEN j = 0 THEN 1 - b / 2.0::DOUBLE ELSE b / 2.0::DOUBLE END) AS v
              FROM p CROSS JOIN range(0, 2) s(a) CROSS JOIN range(0, 2) t(b) CROSS JOIN range(0, 2) x(i) CROSS JOIN range(0, 2) y(j) JOIN p q ON q.row = (p.row + i) % p.rows AND q.col = (p.col + j) % {COLUMNS} GROUP BY ALL),
            o AS (SELECT b.n // {COLUMNS} * 2 AS row, b.n % {COLUMNS} * 2 AS col, max(label) AS class FROM best GROUP BY ALL)
            SELECT least(15, floor(round(v, 9) * 16))::INT AS colour, coalesce(class, -1) AS class, count(*) AS n FROM z LEFT JOIN o USING (row, col) GROUP BY ALL""",
        "image_gaussian": f"WITH {_PIC} SELECT row, col, round(v, 6) AS v FROM ({_conv(_GAUSSIAN, 273)})",
        "image_edges": f"WITH {_PIC} SELECT row, col, round(v, 6) AS v FROM ({_conv(_EDGES)})",
        "image_gradient": f"WITH {_PIC} SELECT row, col, round(sqrt(x.v * x.v + y.v * y.v), 6) AS v FROM ({_conv(_ACROSS)}) x JOIN ({_conv(_ALONG)}) y USING (row, col)",
        "image_zoom": f"""WITH {_PIC} SELECT row * 2 + a AS row, col * 2 + b AS col, round(v00 * (1 - a / 2.0::DOUBLE) * (1 - b / 2.0::DOUBLE) + v01 * (1 - a / 2.0::DOUBLE) * b / 2.0::DOUBLE + v10 * a / 2.0::DOUBLE * (1 - b / 2.0::DOUBLE) + v11 * a / 2.0::DOUBLE * b / 2.0::DOUBLE, 6) AS v
            FROM {shift(0, 0, 'v00')} JOIN {shift(0, 1, 'v01')} USING (row, col) JOIN {shift(1, 0, 'v10')} USING (row, col) JOIN {shift(1, 1, 'v11')} USING (row, col) CROSS JOIN range(0, 2) s(a) CROSS JOIN range(0, 2) z(b)""",
        "image_tile": f"WITH {_PIC} SELECT row + a * {MAP_ROWS} AS row, col + b * {MAP_COLUMNS} AS col, round(v, 6) AS v FROM p CROSS JOIN range(0, 2) s(a) CROSS JOIN range(0, 2) z(b)",
        "image_histogram": hist,
        "image_otsu": f"""WITH h AS ({hist}), c AS (SELECT level, sum(n) OVER w AS below, sum(n) OVER () AS n, sum(level * n) OVER w AS low, sum(level * n) OVER () AS total FROM h WINDOW w AS (ORDER BY level)),
            b AS (SELECT level, CASE WHEN below = n THEN 0 ELSE round(below::DOUBLE * (n - below) * pow(low / below::DOUBLE - (total - low) / (n - below)::DOUBLE, 2), 3) END AS b FROM c) SELECT level AS threshold FROM b ORDER BY b DESC, level LIMIT 1""",
        "image_palette": f"WITH {_PIC} SELECT least(63, floor(v * 64))::INT AS colour, count(*) AS n FROM p GROUP BY 1",
        "image_overlay": "SELECT bm_row * 2 + a AS row, bm_col * 2 + b AS col, max(data_index % 5) AS class FROM bestmatches CROSS JOIN range(-1, 2) s(a) CROSS JOIN range(-1, 2) z(b) WHERE bm_row IS NOT NULL AND bm_col IS NOT NULL GROUP BY 1, 2",
    }
    return t
