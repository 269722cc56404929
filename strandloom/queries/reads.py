"""Queries on located elements: filters, read types, counters, serialisation, whole runs and calling statistics."""

import json
import uuid

import numpy as np
from pyspark.sql import functions as F

from strandloom import pipeline
from strandloom.functions import dna, tags
from strandloom.operators import calling, classify, correct, emit, locate
from strandloom.plans import calibrate
from strandloom.plans.layout import compile_layout, read_rows, write_compiled
from strandloom.session import shared_dir, small_side, table
from strandloom.sources import fastx
from strandloom.streaming import counts as streaming

QUERIES, SQL = {}, {}

#: The layout of most test reads.
LAYOUT = """Read Layout,,,,,
id,seq,expected_length,type,class,whitelist
forw_primer,ATTATCTGCATACGCATCGATA,,static,,
barcode,,16,variable,barcode,listed
umi,,12,variable,umi,
poly_t,,,static,poly_t,
read,,,variable,read,
rev_primer,GCCTCTCCCGGAGTACGCTGCCT,,static,,
"""


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def layout():
    mode, rows = read_rows(LAYOUT)
    return compile_layout(rows, mode)


def _elements(spark, d):
    return table(spark, d, "elements").drop("seen_at", "loaded_at").distinct()


def _nested(spark, d):
    kept = ["class_id", "global_class", "type", "ord", "direction", "edit_distance", "start", "stop", "element_pass", "seq", "original_seq"]
    return _elements(spark, d).groupBy("read_ord").agg(F.collect_list(F.struct(*kept)).alias("elements"))


_EL = """WITH e AS (SELECT DISTINCT elem_id, read_ord, run_id, class_id, global_class, type, ord, direction, edit_distance, "start", stop, element_pass, write, seq, qual, original_seq FROM elements)"""


@query(_EL + """ SELECT read_ord, bool_or(direction = 'forward' AND type = 'static' AND global_class NOT IN ('start', 'stop', 'poly_tail')) AS forward_static,
bool_or(direction = 'reverse' AND type = 'static' AND global_class NOT IN ('start', 'stop', 'poly_tail')) AS reverse_static FROM e GROUP BY 1""")
def flt_static(spark, d):
    e = F.col("elements")
    return _nested(spark, d).select("read_ord", classify.has_static(e, "forward").alias("forward_static"), classify.has_static(e, "reverse").alias("reverse_static"))


@query(_EL + ' SELECT elem_id, stop - "start" + 1 >= 85 AS long_enough FROM e WHERE global_class = \'read\'')
def flt_len(spark, d):
    """Reads at least as long as the structure of a strand."""
    reads = _elements(spark, d).where("global_class = 'read'")
    return reads.select("elem_id", classify.long_enough(F.col("stop") - F.col("start") + 1, layout().structural_length).alias("long_enough"))


@query(_EL + """, b AS (SELECT read_ord, direction, class_id FROM e WHERE global_class NOT IN ('start', 'stop', 'poly_tail') AND NOT coalesce("start" > 0 AND "start" < stop, true)
QUALIFY row_number() OVER (PARTITION BY read_ord, direction ORDER BY ord, class_id) = 1)
SELECT read_ord, max(class_id) FILTER (direction = 'forward') AS forward_bad, max(class_id) FILTER (direction = 'reverse') AS reverse_bad FROM b GROUP BY 1""")
def flt_pos(spark, d):
    e = F.col("elements")
    out = _nested(spark, d).select("read_ord", classify.invalid_element(e, "forward").alias("forward_bad"), classify.invalid_element(e, "reverse").alias("reverse_bad"))
    return out.where("forward_bad is not null or reverse_bad is not null")


@query(_EL + """, v AS (SELECT * FROM e WHERE type = 'variable'), o AS (SELECT a.read_ord, a.direction, a.class_id FROM v a JOIN v b ON a.read_ord = b.read_ord AND a.direction = b.direction AND b.ord > a.ord AND a.stop >= b."start" + 3
QUALIFY row_number() OVER (PARTITION BY a.read_ord, a.direction ORDER BY a.ord, a.class_id) = 1)
SELECT read_ord, max(class_id) FILTER (direction = 'forward') AS forward_over, max(class_id) FILTER (direction = 'reverse') AS reverse_over FROM o GROUP BY 1""")
def flt_over(spark, d):
    e = F.col("elements")
    out = _nested(spark, d).select("read_ord", classify.overlapping_element(e, "forward").alias("forward_over"), classify.overlapping_element(e, "reverse").alias("reverse_over"))
    return out.where("forward_over is not null or reverse_over is not null")


@query()
def flt_dir(spark, d):
    """First reason against each direction, and the read's type."""
    return classify.classify(_nested(spark, d), 0).select("read_ord", "forward_reason", "reverse_reason", "read_type")


@query(_EL + """ SELECT elem_id, CASE WHEN s IS NULL THEN NULL ELSE coalesce(len(list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, i::INT, 2)))), 0) < 4
OR length(s) >= m AND (upper(left(s, m)) = repeat(upper(left(s, 1)), m) OR upper(right(s, m)) = repeat(upper(right(s, 1)), m)) END AS poor FROM (SELECT elem_id, seq s, greatest(4, floor(length(seq) * 0.4)::INT) m FROM e WHERE global_class = 'barcode')""")
def flt_bc(spark, d):
    """Barcodes of hardly any variety or with a run of one base at an end; unknown for null ones."""
    b = _elements(spark, d).where("global_class = 'barcode'")
    return b.select("elem_id", F.when(F.col("seq").isNotNull(), correct.poor("seq")).alias("poor"))


_VALID = _EL + """, v AS (SELECT read_ord, count(*) FILTER (direction = 'forward' AND ok) AS forward_n, count(*) FILTER (direction = 'reverse' AND ok) AS reverse_n
FROM (SELECT *, type = 'variable' AND element_pass IS NOT NULL AND global_class IN ('read', 'barcode') ok FROM e) GROUP BY 1),
t AS (SELECT *, CASE WHEN forward_n > 0 AND forward_n = reverse_n THEN 'concatenate' WHEN forward_n > reverse_n THEN 'forward' WHEN reverse_n > 0 THEN 'reverse' ELSE 'filtered' END AS read_type FROM v)"""


def _typed(spark, d):
    e = F.col("elements")
    v = _nested(spark, d).withColumn("forward_n", classify.valid_count(e, "forward", True)).withColumn("reverse_n", classify.valid_count(e, "reverse", True))
    return v.withColumn("read_type", classify.read_type(F.col("forward_n"), F.col("reverse_n")))


@query(_VALID + " SELECT read_ord, forward_n, reverse_n FROM v")
def agg_valid(spark, d):
    return _typed(spark, d).select("read_ord", "forward_n", "reverse_n")


@query(_VALID + " SELECT read_ord, read_type FROM t")
def flt_type(spark, d):
    return _typed(spark, d).select("read_ord", "read_type")


@query(_VALID + " SELECT read_type, count(*) AS n FROM t WHERE read_type <> 'filtered' GROUP BY 1")
def flt_drop(spark, d):
    return _typed(spark, d).where("read_type <> 'filtered'").groupBy("read_type").agg(F.count(F.lit(1)).alias("n"))


def _barcodes(spark, d):
    types = _typed(spark, d).select("read_ord", "read_type")
    e = _elements(spark, d).where("global_class = 'barcode' and seq is not null").join(types, "read_ord")
    changed = F.col("original_seq").isNotNull() & (F.col("seq") != F.col("original_seq")) & (F.col("seq") != dna.revcomp("original_seq"))
    return e.select(dna.strip_rc("class_id").alias("class_id"), F.col("seq").alias("barcode"), "direction", "read_type", changed.alias("corrected"))


_COUNTERS = _VALID + """, b AS (SELECT regexp_replace(class_id, '^rc_', '') AS class_id, seq AS barcode, direction, read_type,
original_seq IS NOT NULL AND seq <> original_seq AND seq <> reverse(translate(original_seq, 'ACGT', 'TGCA')) AS c, read_type <> 'filtered' AND read_type IN (direction, 'concatenate') AS p
FROM e JOIN t USING (read_ord) WHERE global_class = 'barcode' AND seq IS NOT NULL),
k AS (SELECT class_id, barcode, count(*) FILTER (p AND NOT c) AS raw_count, count(*) FILTER (p) AS total_count, count(*) FILTER (p AND c) AS corrected_count,
count(*) FILTER (p AND read_type = 'forward') AS forw_count, count(*) FILTER (p AND read_type = 'reverse') AS rev_count,
count(*) FILTER (p AND read_type = 'concatenate' AND direction = 'forward') AS forw_concat_count, count(*) FILTER (p AND read_type = 'concatenate' AND direction = 'reverse') AS rev_concat_count,
count(*) FILTER (NOT p) AS filtered_count FROM b GROUP BY 1, 2)"""


@query(_COUNTERS + " SELECT * FROM k")
def agg_counters(spark, d):
    return classify.counters(_barcodes(spark, d))


@query(_COUNTERS + " SELECT * FROM k WHERE total_count > 0")
def snk_wl(spark, d):
    return classify.summary(classify.counters(_barcodes(spark, d)))


@query(_COUNTERS + " SELECT class_id, count(*) AS n_barcodes, sum(total_count)::BIGINT AS total, sum(corrected_count)::BIGINT AS corrected FROM k WHERE total_count > 0 GROUP BY 1")
def agg_summary(spark, d):
    s = classify.summary(classify.counters(_barcodes(spark, d)))
    return s.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_barcodes"), F.sum("total_count").alias("total"), F.sum("corrected_count").alias("corrected"))


@query(_EL + """, x AS (SELECT DISTINCT read_ord, seq AS s FROM reads), w AS (SELECT e.class_id, upper(substr(s, "start", stop - "start" + 1)) a FROM e JOIN x USING (read_ord) WHERE type = 'static' AND edit_distance BETWEEN 0 AND 3 AND class_id NOT LIKE 'poly%' AND "start" > 0)
SELECT class_id, i::INT AS pos, substr(a, i::INT, 1) AS base, count(*) AS n FROM w, range(1, 100) t(i) WHERE i <= length(a) GROUP BY ALL""")
def agg_cons(spark, d):
    """Bases by position of the adapters found."""
    reads = table(spark, d, "reads").select("read_ord", F.col("seq").alias("s")).distinct()
    e = _elements(spark, d).where("type = 'static' and edit_distance between 0 and 3 and class_id not like 'poly%' and start > 0")
    aligned = e.join(reads, "read_ord").select("class_id", F.upper(F.substring("s", F.col("start"), F.col("stop") - F.col("start") + 1)).alias("aligned"))
    return calibrate.consensus(aligned)


@query(_EL + """, r AS (SELECT DISTINCT read_ord, seq FROM reads), x AS (SELECT e.elem_id, e.read_ord, e.direction, r.seq AS s, e."start" a, e.stop z FROM e JOIN r USING (read_ord) WHERE e.global_class = 'read' AND e."start" > 0 AND e.stop > e."start"),
p AS (SELECT elem_id, read_ord, direction, s, unnest(range(a, least(z, length(s)) + 1)) AS i FROM x), o AS (SELECT DISTINCT read_ord, direction, "start" a, stop z FROM e WHERE global_class <> 'read' AND "start" > 0 AND stop > "start"),
k AS (SELECT elem_id, i, substr(s, i::INT, 1) c FROM p WHERE substr(s, i::INT, 1) <> 'N' AND NOT EXISTS (SELECT 1 FROM o WHERE o.read_ord = p.read_ord AND o.direction = p.direction AND p.i BETWEEN o.a AND o.z))
SELECT x.elem_id, coalesce(string_agg(c, '' ORDER BY i), '') AS cleaned FROM x LEFT JOIN k ON k.elem_id = x.elem_id GROUP BY 1""")
def ext_mask(spark, d):
    """Read windows without the bases that other elements of the strand cover and without N."""
    reads = table(spark, d, "reads").select("read_ord", F.col("seq").alias("s")).distinct()
    e = _elements(spark, d).where("start > 0 and stop > start")
    spans = e.where("global_class <> 'read'").groupBy("read_ord", "direction").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))  # a few per read
    own = e.where("global_class = 'read'").join(reads, "read_ord").join(spans, ["read_ord", "direction"], "left")
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return own.select("elem_id", classify.masked_read(F.col("s"), F.coalesce("spans", none), F.col("start"), F.col("stop")).alias("cleaned"))


@query(_VALID + """, m AS (SELECT read_ord, read_id, length(seq) n FROM reads GROUP BY ALL), p AS (SELECT e.*, read_type FROM e JOIN t USING (read_ord) WHERE NOT ("start" = -1 AND stop = -1)),
s AS (SELECT read_ord, read_type, string_agg(class_id || ':' || coalesce(edit_distance, 0) || ':' || "start" || ':' || stop, '|' ORDER BY "start", ord, class_id) x FROM p WHERE direction = 'forward' AND read_type <> 'reverse' GROUP BY 1, 2)
SELECT read_ord, x || '<' || n || ':' || read_id || ':F' || CASE read_type WHEN 'concatenate' THEN ':C' WHEN 'filtered' THEN ':filtered' ELSE '' END || '>' AS line FROM s JOIN m USING (read_ord)""")
def snk_sig(spark, d):
    """Forward elements of a read in one line."""
    reads = table(spark, d, "reads").select("read_ord", "read_id", F.length("seq").alias("n")).distinct()
    t = _typed(spark, d).join(reads, "read_ord")
    line = emit.sigstring(F.col("elements"), F.col("read_id"), F.col("n"), F.col("read_type"), F.lit(""), "forward")
    return t.select("read_ord", line.alias("line")).where("line is not null")


@query(_VALID + """, m AS (SELECT DISTINCT read_ord, read_id FROM reads), x AS (SELECT m.read_id AS id, regexp_replace(class_id, '^rc_', '') AS elem, CASE WHEN class_id LIKE 'rc\\_%' ESCAPE '\\' THEN 'reverse' ELSE 'forward' END side, read_type,
CASE WHEN class_id LIKE 'rc\\_%' ESCAPE '\\' THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq FROM e JOIN t USING (read_ord) JOIN m USING (read_ord) WHERE type = 'variable' AND seq <> '')
SELECT id, elem, side || CASE WHEN read_type = 'concatenate' THEN '_concatenate' ELSE '' END AS read_type, seq FROM x WHERE read_type NOT IN ('forward', 'reverse') OR read_type = side""")
def snk_csv(spark, d):
    reads = table(spark, d, "reads").select("read_ord", "read_id").distinct()
    return emit.element_rows(_elements(spark, d).join(_typed(spark, d).select("read_ord", "read_type"), "read_ord").join(reads, "read_ord"))


@query()
def snk_fastx(spark, d):
    """Records of the located test elements, with tags."""
    reads = table(spark, d, "reads").select("read_ord", "read_id", F.col("seq").alias("s"), F.col("qual").alias("q")).distinct()
    e = _elements(spark, d).drop("qual").join(_typed(spark, d).select("read_ord", "read_type"), "read_ord").join(reads, "read_ord")
    cut_ = lambda c: F.substring(c, F.col("start"), F.col("stop") - F.col("start") + 1)
    is_read = F.col("global_class") == "read"
    e = e.withColumn("seq", F.when(is_read, cut_("s")).otherwise(F.col("seq"))).withColumn("qual", F.when(is_read, cut_("q")))
    out = emit.demux_records(e)
    return out.withColumn("record", emit.record_text(out))


@query()
def lay_prep(spark, d):
    """The compiled layout as a table."""
    rows = [(e.class_id, e.type, e.order, e.direction, e.global_class, e.seq, e.length) for e in layout().elements]
    return spark.createDataFrame(rows, "class_id string, type string, ord int, direction string, global_class string, seq string, expected_length int")


@query()
def lay_posmap(spark, d):
    """Placement rules of the variable elements."""
    rows = [(k, *map(str, (p.start, p.stop, p.start2, p.stop2))) for k, p in layout().places.items()]
    return spark.createDataFrame(rows, "id string, primary_start string, primary_stop string, secondary_start string, secondary_stop string")


def _reads(spark, d):
    return table(spark, d, "reads", "read_ord", "read_id", "comment", "seq", "qual", "is_fastq").distinct()


@query()
def ext_locate(spark, d):
    """Elements located in all reads."""
    return locate.exploded(locate.locate(_reads(spark, d).select("read_ord", "seq"), layout()), "read_ord")


@query()
def lay_cal(spark, d):
    """Calibration figures of each adapter over all reads."""
    return calibrate.calibration_stats(calibrate.best_hits(_reads(spark, d), calibrate.adapters_of(layout())))


@query('WITH e AS (SELECT DISTINCT elem_id, class_id, "start", stop FROM elements WHERE type = \'static\' AND edit_distance = 0) SELECT class_id, count(*) AS n, round(avg("start"), 6) AS mean_start, round(coalesce(stddev_samp("start"), 0), 6) AS sd_start FROM e GROUP BY 1')
def lay_cal_stat(spark, d):
    e = _elements(spark, d).where("type = 'static' and edit_distance = 0").select("class_id", F.col("edit_distance").alias("distance"), F.col("start").alias("start_pct"), F.col("stop").alias("stop_pct"))
    s = calibrate.calibration_stats(e)
    return s.select("class_id", F.col("seen").alias("n"), F.round("start_mean", 6).alias("mean_start"), F.round("start_sd", 6).alias("sd_start"))


@query()
def lay_cal_apply(spark, d):
    """Elements of the layout calibrated on all reads."""
    done = calibrate.calibrate(_reads(spark, d), layout(), sample=None)
    rows = [(e.class_id, e.order, *(e.threshold or (None,) * 3), *(e.aligned or (None,) * 4)) for e in done.elements]
    return spark.createDataFrame(rows, "class_id string, ord int, least int, middle int, most int, start_mean double, start_sd double, stop_mean double, stop_sd double")


@query()
def lay_discover(spark, d):
    """Layout found from a list of parts in all reads."""
    parts = [(e.class_id, e.seq) for e in layout().of("forward") if e.type == "static" and e.seq and not e.tail]
    found = calibrate.discover(_reads(spark, d), [*parts, ("absent", "GATTACAGATTACAGATTACA")], sample=None)
    return spark.createDataFrame([(e.class_id, e.type, e.order, e.direction) for e in found.elements], "class_id string, type string, ord int, direction string")


@query()
def lay_mask(spark, d):
    """Adapters with N where the aligned reads have no clear base."""
    e = layout()
    hits = calibrate.best_hits(_reads(spark, d), calibrate.adapters_of(e))
    counts: dict = {}
    for r in calibrate.consensus(hits).collect():  # adapters x positions x bases
        counts.setdefault(r["class_id"], {}).setdefault(r["pos"], {})[r["base"]] = r["n"]
    rows = [(n, s, calibrate.masked_adapter(s, counts.get(n, {}), 3)) for n, s, _ in calibrate.adapters_of(e)]
    return spark.createDataFrame(rows, "class_id string, seq string, masked string")


@query()
def demux_e2e(spark, d):
    """All reads demultiplexed by the layout: the records."""
    return pipeline.records(pipeline.demultiplex_reads(_reads(spark, d), layout(), table(spark, d, "whitelist")), layout())


@query()
def auto_wl(spark, d):
    """Barcodes called from the reads behind the layout's adapter."""
    calls, _ = pipeline.auto_whitelist(_reads(spark, d), layout(), table(spark, d, "whitelist").where("class_id = 'barcode'"))
    return calls


_COUNTED = "c AS (SELECT barcode, sum(n)::BIGINT n FROM barcode_counts WHERE barcode IS NOT NULL AND n IS NOT NULL GROUP BY 1), s AS (SELECT barcode, n, ln(1 + n * 1e6 / sum(n) OVER ()) x FROM c)"


def _counts(spark, d):
    return table(spark, d, "barcode_counts").where("barcode is not null and n is not null").groupBy("barcode").agg(F.sum("n").alias("n"))


def _levels(spark, d):
    """Scores and multiplicities, ascending; as many as there are distinct counts."""
    h = sorted((int(r[0]), int(r[1])) for r in _counts(spark, d).groupBy("n").agg(F.count(F.lit(1))).collect())
    n, w = (np.array(v, np.int64) for v in zip(*h))
    return n, np.log1p(n / int((n * w).sum()) * 1e6), w


@query(f"WITH {_COUNTED}, r AS (SELECT x, row_number() OVER (ORDER BY x) - 1 k, count(*) OVER () m FROM s) SELECT round(0.9 * least(stddev_samp(x), (max(x) FILTER (k = 3 * m // 4) - max(x) FILTER (k = m // 4)) / 1.34) * pow(max(m), -0.2), 6) AS bandwidth FROM r")
def st_bw(spark, d):
    _, x, w = _levels(spark, d)
    return spark.createDataFrame([(round(calling.bandwidth(x, w), 6),)], "bandwidth double")


@query(f"""WITH {_COUNTED}, g AS (SELECT i, lo + i * (hi - lo) / 511 AS gx FROM (SELECT min(x) lo, max(x) hi FROM s), range(0, 512) t(i)), h AS (SELECT x, count(*) m FROM s GROUP BY 1)
SELECT i::INT AS i, round(gx, 5) AS x, round(sum(m * exp(-0.5 * pow((gx - x) / 0.25, 2))) / ((SELECT count(*) FROM s) * 0.25 * sqrt(2 * pi())), 5) AS density FROM g, h GROUP BY i, gx""")
def st_kde(spark, d):
    """Density of the scores on a grid of 512 points."""
    _, x, w = _levels(spark, d)
    grid = np.linspace(x[0], x[-1], 512)
    y = calling.density(x, w, 0.25, grid)
    return spark.createDataFrame([(i, round(float(a), 5), round(float(b), 5)) for i, (a, b) in enumerate(zip(grid, y))], "i int, x double, density double")


@query()
def st_peaks(spark, d):
    _, x, w = _levels(spark, d)
    grid = np.linspace(x[0], x[-1], 512)
    y = calling.density(x, w, calling.bandwidth(x, w), grid)
    return spark.createDataFrame([(float(grid[i]), float(y[i])) for i in calling.peaks(grid, y)], "x double, height double")


@query()
def st_saddle(spark, d):
    _, x, w = _levels(spark, d)
    s = calling.saddle_cut(x[x >= calling.FLOOR], w[x >= calling.FLOOR])
    return spark.createDataFrame([(s.ok, s.n_peaks, s.bw, float(s.cut), float(s.final_cut))], "ok boolean, n_peaks int, bandwidth double, cut double, final_cut double")


@query()
def st_hazard(spark, d):
    _, x, w = _levels(spark, d)
    h = calling.adjusted_hazard(x, w, calling.bandwidth(x, w), calling.FLOOR, calling.FLOOR)
    return spark.createDataFrame([(m.x, m.hazard, m.rank, m.prominence) for m in h.minima], "x double, hazard double, rank int, prominence double")


@query()
def st_floor(spark, d):
    _, x, w = _levels(spark, d)
    f = calling.adaptive_floor(x, w, calling.bandwidth(x, w))
    return spark.createDataFrame([(f.ready, f.decision, float(f.x), float(f.snapped))], "ready boolean, decision string, x double, snapped double")


@query(f"""WITH {_COUNTED}, u AS (SELECT count(DISTINCT barcode) universe FROM whitelist WHERE class_id = 'barcode'), l AS (SELECT DISTINCT barcode FROM whitelist WHERE class_id = 'barcode'),
k AS (SELECT x FROM s WHERE barcode IN (SELECT barcode FROM l)), v(f) AS (VALUES (9.0), (8.0), (7.0), (6.0), (5.0), (4.0)),
n AS (SELECT f, universe, (SELECT count(*) FROM k) seen, (SELECT count(*) FROM k WHERE x >= 9) few, (SELECT count(*) FROM k WHERE x >= f) more FROM v, u)
SELECT f AS score, universe, seen, more AS called, CASE WHEN more = few THEN 'not_an_expansion' WHEN (more - few) * universe <= (universe - seen) * (universe - few) THEN 'accepted' ELSE 'rejected' END AS decision FROM n""")
def st_guard(spark, d):
    """Whether widening the call of listed barcodes from a score of 9 down to lower ones is no more than chance allows."""
    listed = table(spark, d, "whitelist").where("class_id = 'barcode'").select("barcode").distinct()
    counts = _counts(spark, d)
    total = counts.agg(F.sum("n")).first()[0]
    scores = counts.join(small_side(listed), "barcode", "left_semi").select(F.log1p(F.col("n") * 1e6 / total).alias("x"))
    cuts = [9.0, 8.0, 7.0, 6.0, 5.0, 4.0]
    seen, *above = scores.agg(F.count(F.lit(1)), *(F.count_if(F.col("x") >= c) for c in cuts)).first()
    universe = listed.count()
    rows = [(c, universe, seen, n, calling.finite_guard(universe, seen, above[0], n)) for c, n in zip(cuts, above)]
    return spark.createDataFrame(rows, "score double, universe bigint, seen bigint, called bigint, decision string")


@query()
def st_call(spark, d):
    """The called barcodes with score, percentile, flags and annotation."""
    return calling.call_barcodes(_counts(spark, d))[0]


@query()
def flt_select(spark, d):
    return calling.selected(calling.call_barcodes(_counts(spark, d))[0], "above_floor")


@query("WITH c AS (SELECT barcode, sum(n)::BIGINT AS n FROM barcode_counts WHERE barcode IS NOT NULL AND n > 0 GROUP BY 1) SELECT barcode, n AS count, round(n * 1e6 / sum(n) OVER (), 4) AS ncpm FROM c")
def snk_calls(spark, d):
    """The call table's counts and scores."""
    return calling.call_barcodes(_counts(spark, d))[0].select("barcode", "count", F.round("ncpm", 4).alias("ncpm"))


@query()
def snk_logs(spark, d):
    """The call behind the table, as key and value."""
    call = calling.call_barcodes(_counts(spark, d))[1]
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in vars(call).items()], "key string, value string")


@query()
def snk_layout(spark, d):
    """The compiled layout and its rules as CSV text."""
    a, b = write_compiled(layout())
    return spark.createDataFrame([("layout", a), ("position_map", b)], "file string, text string")


@query("SELECT DISTINCT read_id, coalesce(comment, '') AS comment, seq, qual, is_fastq FROM (SELECT DISTINCT read_ord, read_id, regexp_replace(comment, '^\\s+|\\s+$', '', 'g') AS comment, seq, qual, qual IS NOT NULL AND qual <> '' AS is_fastq FROM reads WHERE seq <> '')")
def src_fastx(spark, d):
    """All reads written as records and read back by the file source."""
    at = f"{shared_dir(spark)}/fastx_{uuid.uuid4().hex}"
    text = _reads(spark, d).select(tags.record(F.col("read_id"), F.trim("comment"), F.col("seq"), F.col("qual")).alias("value"))
    text.write.mode("overwrite").text(at)
    return fastx.read_fastx(spark, at, "read_id,comment,seq,qual,is_fastq", spread=False, suffixes=(".txt",)).distinct()


@query("SELECT barcode, count(*) AS n FROM barcode_counts WHERE barcode IS NOT NULL GROUP BY 1")
def str_chunk(spark, d):
    """Running counts over a stream of the rows, taken in micro-batches until none are left."""
    src = table(spark, d, "barcode_counts")
    at = f"{shared_dir(spark)}/stream_{uuid.uuid4().hex}"
    src.write.mode("overwrite").parquet(f"{at}/in")
    rows = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/in").where("barcode is not null")
    return _drain(spark, streaming.running_counts(rows), ["barcode"], at)


@query(_EL + """, b AS (SELECT regexp_replace(class_id, '^rc_', '') AS class_id, seq AS barcode, original_seq IS NOT NULL AND original_seq <> seq c FROM e WHERE global_class = 'barcode' AND seq IS NOT NULL),
k AS (SELECT class_id, barcode, count(*) FILTER (NOT c) AS raw_count, count(*) FILTER (c) AS corrected_count FROM b GROUP BY 1, 2)
SELECT *, CASE WHEN raw_count >= 2 THEN raw_count + corrected_count < 10 OR (corrected_count + 1) / (raw_count + corrected_count + 1) <= 0.8 ELSE raw_count + corrected_count < 10 END AS stands FROM k""")
def str_state(spark, d):
    """Counters and verdict per barcode, kept as state of a stream."""
    e = _elements(spark, d).where("global_class = 'barcode' and seq is not null")
    b = e.select(dna.strip_rc("class_id").alias("class_id"), F.col("seq").alias("barcode"), (F.col("original_seq").isNotNull() & (F.col("original_seq") != F.col("seq"))).alias("corrected"))
    at = f"{shared_dir(spark)}/state_{uuid.uuid4().hex}"
    b.write.mode("overwrite").parquet(f"{at}/in")
    rows = spark.readStream.schema(b.schema).parquet(f"{at}/in")
    return _drain(spark, streaming.gated_counters(rows), ["class_id", "barcode"], at)


def _drain(spark, stream, keys, at):
    """Run a stream to its end; each batch is written to the shared folder, the latest row of a key stands."""
    def keep(df, batch):
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{at}/out/b={batch}")

    q = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{at}/state").foreachBatch(keep).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{at}/out/*")
    names = [c for c in rows.columns if c not in (*keys, "batch", "b")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("x"))
    return latest.select(*keys, "x.*")



#: Reads of known structure from orders and customers: bases by md5, parted so that no tail arises by chance.
_BASES = ("0123456789abcdef", "ACGTACGTACGTACGT")
#: Adapters at both ends of such a read, and the layout with two adjoining barcodes.
FRONT, BACK = "ATTATCTGCATACGCATCGATA", "GCCTCTCCCGGAGTACGCTGCCT"
JOINT_LAYOUT = f"""Read Layout,,,,,,
id,seq,expected_length,type,class,whitelist,flags
forw_primer,{FRONT},,static,,,
umi,,9,variable,umi,,
barcode_1,,15-16,variable,barcode,one,joint_barcode
barcode_2,,14-15,variable,barcode,two,joint_barcode
poly_t,,,static,poly_t,,
read,,,variable,read,,
rev_primer,{BACK},,static,,,
"""


def _dna(tag, key, n):
    return F.substring(F.translate(F.md5(F.concat(F.lit(tag), F.col(key).cast("string"))), *_BASES), 1, n)


def _parted(tag, key, cuts):
    """Bases by md5 with fixed ones between, so that they have variety and no long runs."""
    text, out, at = F.translate(F.md5(F.concat(F.lit(tag), F.col(key).cast("string"))), *_BASES), [], 1
    for n, between in cuts:
        out += [F.substring(text, at, n), F.lit(between)]
        at += n
    return F.concat(*out)


_BC = [(4, "CA"), (4, "GT"), (4, "")]
#: Before the tail stand four bases of another kind, over which it can't run.
_BC2, _UMI, _UMI_JOINT = [(4, "CA"), (4, "GGCGC")], [(5, "C"), (2, "GCGC")], [(2, "GT"), (2, "GT"), (1, "")]
_BODY = [(6, "GCCG")] * 5


def _made(spark, d, joint):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    body = F.concat(F.lit("GCAGCA"), *(_parted(f"r{i}", "o_orderkey", _BODY) for i in range(3)))
    ends = (("one", 16, "o_custkey"), ("two", 15, "part")) if joint else (("b", 16, "o_custkey"),)
    o = o.withColumn("part", F.col("o_orderkey") % 100)
    bcs = [_parted(t, k, _BC2 if n == 15 else _BC) for t, n, k in ends]
    umi = _parted("u", "o_orderkey", _UMI_JOINT if joint else _UMI)
    core = [F.lit(FRONT), umi, *bcs] if joint else [F.lit(FRONT), *bcs, umi]
    seq = F.concat(*core, F.lit("T" * 20), body, F.lit(BACK))
    seq = F.when(F.col("o_orderkey") % 2 == 1, dna.revcomp(seq)).otherwise(seq)
    reads = o.select(F.col("o_orderkey").alias("read_ord"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("read_id"), seq.alias("seq"), F.lit(None).cast("string").alias("qual"))
    rows = None
    for (t, n, k), c in zip(ends, ("barcode_1", "barcode_2") if joint else ("barcode",)):
        one = o.select(F.lit(c).alias("class_id"), F.lit("true").alias("role"), _parted(t, k, _BC2 if n == 15 else _BC).alias("barcode")).distinct()
        rows = one if rows is None else rows.unionByName(one)
    return reads, rows


def _sql_parted(tag, key, cuts):
    text, out, at = f"translate(md5('{tag}' || {key}::VARCHAR), '{_BASES[0]}', '{_BASES[1]}')", [], 1
    for n, between in cuts:
        out += [f"substr({text}, {at}, {n})", f"'{between}'"]
        at += n
    return " || ".join(out)


def _sql_known(joint):
    bcs = f"{_sql_parted('one', 'o_custkey', _BC)} || '-' || {_sql_parted('two', '(o_orderkey % 100)', _BC2)}" if joint else _sql_parted("b", "o_custkey", _BC)
    body = "'GCAGCA' || " + " || ".join(_sql_parted(f"r{i}", "o_orderkey", _BODY) for i in range(3))
    umi = _sql_parted("u", "o_orderkey", _UMI_JOINT if joint else _UMI)
    # a tail begins with the first window that holds 12 of its bases in 14: two bases before the run on the reverse strand
    return f"""WITH m AS (SELECT o_orderkey, {bcs} AS cb, {umi} AS ub, {body} AS body FROM orders)
SELECT o_orderkey AS read_ord, CASE WHEN o_orderkey % 2 = 1 THEN 'R' ELSE 'F' END AS strand, cb, ub,
CASE WHEN o_orderkey % 2 = 1 THEN reverse(translate(substr(body, 3), 'ACGT', 'TGCA')) ELSE body END AS seq FROM m"""


@query(_sql_known(False))
def demux_known(spark, d):
    """Reads of known structure demultiplexed: strand, barcode, molecule tag and the read itself."""
    reads, lists = _made(spark, d, False)
    return pipeline.records(pipeline.demultiplex_reads(reads, layout(), lists), layout()).select("read_ord", "strand", "cb", "ub", "seq")


@query(_sql_known(True))
def demux_joint(spark, d):
    """The same with two adjoining barcodes, looked for as a chain."""
    reads, lists = _made(spark, d, True)
    mode, rows = read_rows(JOINT_LAYOUT)
    lay = compile_layout(rows, mode)
    return pipeline.records(pipeline.demultiplex_reads(reads, lay, lists), lay).select("read_ord", "strand", "cb", "ub", "seq")
