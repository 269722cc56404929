"""Queries of the alignment kernels and of the functions registered for SQL."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from strandloom.functions import dna, register
from strandloom.operators import align, locate
from strandloom.queries.reads import layout
from strandloom.queries.relational import ADAPTER
from strandloom.session import small_side, table

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _reads(spark, d):
    return table(spark, d, "reads", "read_ord", "seq").distinct()


@query(f"""WITH r AS (SELECT DISTINCT read_ord, upper(seq) s FROM reads), m AS (SELECT read_ord, min(levenshtein('{ADAPTER}', substr(s, i::INT, k::INT))) dist FROM r, range(1, 2000) a(i), range(20, 25) b(k) WHERE i <= length(s) GROUP BY 1)
SELECT read_ord, dist::INT AS dist FROM m WHERE dist <= 2""")
def aln_infix(spark, d):
    """Reads that hold the adapter within two edits, and the least distance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["seq"].fillna("").tolist()
            matrix, sizes = align.as_matrix(texts)
            scores = align.infix_scores(ADAPTER, matrix)
            best = [int(scores[i, : sizes[i]].min(initial=len(ADAPTER))) for i in range(len(texts))]
            yield pd.DataFrame({"read_ord": pdf["read_ord"], "dist": best})

    return _reads(spark, d).mapInPandas(run, "read_ord bigint, dist int").where("dist <= 2")


@query()
def aln_sw(spark, d):
    """Best local alignment of the adapter in every read, with its measures."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["seq"].str.len() > 0].assign(size=pdf["seq"].str.len()).sort_values("size")
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                got = align.local_alignments(ADAPTER, part["seq"].tolist())
                rows = [
                    (i, x[0], x[1] + 1, x[2] + 1, x[3], align.longest_match(x[3]), align.longest_match_with_slip(x[3]), align.cigar_edits(x[3]))
                    for i, x in zip(part["read_ord"].tolist(), got) if x
                ]
                yield pd.DataFrame(rows, columns=["read_ord", "score", "start", "stop", "cigar", "run", "run_with_slip", "edits"])

    return _reads(spark, d).mapInPandas(run, "read_ord bigint, score int, start int, stop int, cigar string, run int, run_with_slip int, edits int")


@query()
def aln_static(spark, d):
    """Places of every adapter of the layout that pass the rules of acceptance."""
    found = locate.exploded(locate.locate(_reads(spark, d), layout()), "read_ord").where("type = 'static' and start > 0 and element_pass and global_class <> 'poly_tail'")
    return found.select("read_ord", "class_id", "start", "stop", F.col("edit_distance").alias("distance"))


@query()
def aln_poly(spark, d):
    """Tails of A and T in every read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, b, *t) for i, s in zip(pdf["read_ord"].tolist(), pdf["seq"].tolist()) for b in "AT" for t in (align.poly_tails(b, s) if s else ())]
            yield pd.DataFrame(rows, columns=["read_ord", "base", "start", "stop", "others"])

    return _reads(spark, d).mapInPandas(run, "read_ord bigint, base string, start int, stop int, others int")


@query("SELECT DISTINCT read_ord, length(seq) AS n, greatest(1, floor(length(seq) * 0.3)::INT) AS most FROM reads WHERE length(seq) > 0")
def scan_maxed(spark, d):
    """Edits that a 30 % share of a sequence's length allows."""
    n = F.length("seq")
    return _reads(spark, d).where(n > 0).select("read_ord", n.alias("n"), dna.max_edits(n, 0.3).alias("most"))


@query("SELECT DISTINCT barcode, reverse(translate(barcode, 'ACGT', 'TGCA')) AS rc, barcode AS again, (left(barcode, 4) = repeat(left(barcode, 1), 4) OR right(barcode, 4) = repeat(right(barcode, 1), 4)) AS run, (3 * length(barcode))::BIGINT AS n FROM whitelist")
def sql_functions(spark, d):
    """The registered functions called from SQL."""
    register.register(spark)
    table(spark, d, "whitelist").select("barcode").distinct().createOrReplaceTempView("strandloom_listed")
    return spark.sql(
        """SELECT barcode, revcomp(barcode) AS rc, decode_bases(encode_bases(barcode), length(barcode)) AS again, homopolymer_end(barcode, 4) AS run, n
        FROM strandloom_listed, LATERAL (SELECT count(*) AS n FROM (SELECT explode(sequence(1, 3 * length(barcode)))))"""
    )


@query("SELECT e.elem_id, e.loaded_at, w.barcode FROM elements e JOIN (SELECT DISTINCT class_id, barcode FROM whitelist) w ON regexp_replace(e.class_id, '^rc_', '') = w.class_id AND w.barcode = reverse(translate(e.seq, 'ACGT', 'TGCA')) WHERE e.global_class = 'barcode'")
def jn_reverse(spark, d):
    """Barcodes on their list only when turned."""
    e = table(spark, d, "elements").where("global_class = 'barcode'").select("elem_id", "loaded_at", dna.strip_rc("class_id").alias("class_id"), dna.revcomp("seq").alias("barcode"))
    return e.join(small_side(table(spark, d, "whitelist", "class_id", "barcode").distinct()), ["class_id", "barcode"]).select("elem_id", "loaded_at", "barcode")
