"""Registered queries of the matrix operators and the SQL that checks each of them.

OP is the matrix order x part of summed quantities, PO its transpose, SP supplier x part,
PS its transpose, CO customer x order. The layout queries run on PO x OP, those about rows
with several cuts on SP x PS.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import bits
from weftline.operators import blocks, layout, matrix, product, selection, splits
from weftline.sources import mtx, mtx_source, records, result, stored, synth, words
from weftline.sources.folders import cut_lineage, shared_folder

BLOCK = product.BLOCK


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.from_relation(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_quantity")


def po(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.transpose(op(spark, sf_dir))


def po_op(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(PO, OP) with all entries of an order in one task, so that lists by order need no further shuffle."""
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").repartition(F.col("l_orderkey").cast("long"))
    b = matrix.from_relation(items, "l_orderkey", "l_partkey", "l_quantity")
    return matrix.transpose(b), b


def sp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.from_relation(_table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", "l_quantity")


def ps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.transpose(sp(spark, sf_dir))


def sp_ps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(SP, PS) from one written matrix: what reads both several times doesn't sum the table anew each time."""
    b = cut_lineage(ps(spark, sf_dir))
    return matrix.transpose(b), b


def co(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.from_relation(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


def _scratch(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("i"))


_OP = "op AS (SELECT CAST(l_orderkey AS BIGINT) AS i, CAST(l_partkey AS BIGINT) AS j, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
_SP = "sp AS (SELECT CAST(l_suppkey AS BIGINT) AS i, CAST(l_partkey AS BIGINT) AS j, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
_CO = "co AS (SELECT CAST(o_custkey AS BIGINT) AS i, CAST(o_orderkey AS BIGINT) AS j, CAST(COUNT(*) AS DOUBLE) AS v FROM orders GROUP BY 1, 2)"
_PO_OP = f"{_OP}, a AS (SELECT j AS i, i AS j, v FROM op), b AS (SELECT * FROM op)"
_SP_PS = f"{_SP}, a AS (SELECT * FROM sp), b AS (SELECT j AS i, i AS j, v FROM sp)"
_CO_OP = f"{_CO}, {_OP}, a AS (SELECT * FROM co), b AS (SELECT * FROM op)"
_PAR = "par AS (SELECT a.i AS i, a.j AS k, b.j AS j, a.v * b.v AS x FROM a JOIN b ON a.j = b.i)"
_RS = "bl AS (SELECT i AS k, COUNT(*) AS n FROM b GROUP BY i), rs AS (SELECT a.i AS i, CAST(SUM(COALESCE(bl.n, 0)) AS BIGINT) AS row_size FROM a LEFT JOIN bl ON a.j = bl.k GROUP BY a.i)"
_SPAN = f"{_RS}, span AS (SELECT i, row_size, CAST(SUM(row_size) OVER (ORDER BY i) - row_size AS BIGINT) AS row_off, CAST(SUM(row_size) OVER (ORDER BY i) AS BIGINT) AS row_end FROM rs)"
#: every partial with its rank in its row and its place among all
_POS = f"{_PAR}, {_SPAN}, pos AS (SELECT r.i, r.k, r.j, r.x, r.rn, span.row_size, span.row_off + r.rn - 1 AS pos, (span.row_off + r.rn - 1) // {BLOCK} AS blk FROM (SELECT i, k, j, x, ROW_NUMBER() OVER (PARTITION BY i ORDER BY j, k) AS rn FROM par) r JOIN span ON r.i = span.i)"
_CUT = f"{_POS}, cut AS (SELECT CAST(blk AS BIGINT) AS blk, i, CAST(rn AS BIGINT) AS p, row_size FROM pos WHERE (pos + 1) % {BLOCK} = 0)"
_VEC = f"{_CUT}, vec AS (SELECT cut.blk, cut.i, a.j AS k, CAST(COALESCE(SUM(CASE WHEN pos.rn <= cut.p THEN 1 ELSE 0 END), 0) AS BIGINT) AS b FROM cut JOIN a ON cut.i = a.i LEFT JOIN pos ON pos.i = cut.i AND pos.k = a.j GROUP BY cut.blk, cut.i, a.j)"
_CARRY = f"car AS (SELECT b1.blk, CAST(MAX(CASE WHEN nxt.blk IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS carry FROM (SELECT DISTINCT blk, i, j FROM pos) b1 LEFT JOIN (SELECT DISTINCT blk, i, j FROM pos) nxt ON nxt.i = b1.i AND nxt.j = b1.j AND nxt.blk = b1.blk + 1 GROUP BY b1.blk)"
_M = "lc AS (SELECT i, COUNT(*) AS m FROM a GROUP BY i)"
_OPEN = f"{_M}, op1 AS (SELECT * FROM (SELECT CAST(0 AS BIGINT) AS blk, i, CAST(0 AS BIGINT) AS p, m FROM lc ORDER BY i LIMIT 1) UNION ALL SELECT cut.blk + 1, cut.i, cut.p, lc.m FROM cut JOIN lc ON cut.i = lc.i)"
_RUNS = "run AS (SELECT CAST(blk AS BIGINT) AS blk, i, j, SUM(x) AS s, MIN(pos) AS first, MAX(pos) AS last FROM pos GROUP BY blk, i, j)"
_CHUNKS = f"chk AS (SELECT CAST(blk AS BIGINT) AS blk, CAST((pos % {BLOCK}) // 16 AS BIGINT) AS chunk, i, j, SUM(x) AS s FROM pos GROUP BY 1, 2, 3, 4)"

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def _query(sql: str) -> Callable:
    """Register a function under its name with the SQL that checks it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


# matrices


@_query(f"WITH {_OP} SELECT i, j, v FROM op")
def coo_coalesce(spark, sf_dir):
    entries = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("i"), F.col("l_partkey").cast("long").alias("j"), F.col("l_quantity").alias("v"))
    return matrix.coalesce_entries(entries)


@_query(f"WITH {_OP} SELECT j AS i, i AS j, v FROM op")
def transpose(spark, sf_dir):
    return matrix.transpose(op(spark, sf_dir))


@_query(f"WITH {_SP}, low AS (SELECT * FROM sp WHERE j <= i) SELECT i, j, v FROM low UNION ALL SELECT j, i, v FROM low WHERE i <> j")
def symmetric_expand(spark, sf_dir):
    return matrix.symmetric_expand(sp(spark, sf_dir).where("j <= i"))


@_query(f"WITH {_OP} SELECT i, j, CAST(0.1234 AS DOUBLE) AS v FROM op")
def pattern_values(spark, sf_dir):
    return op(spark, sf_dir).select("i", "j", F.lit(mtx.PATTERN_VALUE).alias("v"))


@_query(f"WITH {_OP} SELECT i, COUNT(*) AS n FROM op GROUP BY i")
def csr_row_counts(spark, sf_dir):
    return matrix.row_counts(op(spark, sf_dir))


@_query(f"WITH {_SP}, c AS (SELECT CAST(p_partkey AS BIGINT) AS i, COALESCE(n, 0) AS n FROM (SELECT DISTINCT p_partkey FROM part) p LEFT JOIN (SELECT j, COUNT(*) AS n FROM sp GROUP BY j) s ON p.p_partkey = s.j) SELECT i, CAST(n AS BIGINT) AS n, CAST(SUM(n) OVER (ORDER BY i) - n AS BIGINT) AS ptr FROM c")
def csr_row_ptrs_full(spark, sf_dir):
    return matrix.row_pointers(ps(spark, sf_dir), _parts(spark, sf_dir))


@_query(f"WITH {_OP}, c AS (SELECT i, COUNT(*) AS n FROM op GROUP BY i) SELECT i, n, CAST(SUM(n) OVER (ORDER BY i) - n AS BIGINT) AS ptr FROM c")
def csr_row_ptrs_compact(spark, sf_dir):
    return matrix.row_pointers(op(spark, sf_dir))


@_query(f"WITH {_OP} SELECT i, j, CAST(ROW_NUMBER() OVER (PARTITION BY i ORDER BY j) - 1 AS BIGINT) AS pos FROM op")
def csr_sorted_entries(spark, sf_dir):
    return matrix.sorted_positions(op(spark, sf_dir)).drop("v")


# products


@_query(f"WITH {_PO_OP}, {_PAR} SELECT i, k, j, x FROM par")
def partial_products(spark, sf_dir):
    return product.partials(po(spark, sf_dir), op(spark, sf_dir))


@_query(f"WITH {_PO_OP}, {_PAR} SELECT i, j, SUM(x) AS v FROM par GROUP BY i, j")
def spgemm_copurchase(spark, sf_dir):
    return product.product(po(spark, sf_dir), op(spark, sf_dir))


@_query(f"WITH {_SP_PS}, {_PAR} SELECT i, j, SUM(x) AS v FROM par GROUP BY i, j")
def spgemm_supplier_gram(spark, sf_dir):
    return product.product(*sp_ps(spark, sf_dir))


@_query(f"WITH {_CO_OP}, {_PAR} SELECT i, j, SUM(x) AS v FROM par GROUP BY i, j")
def spgemm_customer_part(spark, sf_dir):
    return product.product(co(spark, sf_dir), op(spark, sf_dir))


def _line_numbers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """part x line number and line number x supplier: a few keys with most entries of either side."""
    lines = _table(spark, sf_dir, "lineitem")
    return matrix.from_relation(lines, "l_partkey", "l_linenumber", "l_quantity"), matrix.from_relation(lines, "l_linenumber", "l_suppkey", "l_quantity")


_PN_NS = (
    "a AS (SELECT CAST(l_partkey AS BIGINT) AS i, CAST(l_linenumber AS BIGINT) AS j, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2), "
    "b AS (SELECT CAST(l_linenumber AS BIGINT) AS i, CAST(l_suppkey AS BIGINT) AS j, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
)


@_query(f"WITH {_PN_NS}, {_PAR} SELECT i, j, SUM(x) AS v FROM par GROUP BY i, j")
def spgemm_heavy_keys(spark, sf_dir):
    """A product of seven heavy keys, each joined in tiles."""
    return product.product(*map(cut_lineage, _line_numbers(spark, sf_dir)), tile=1 << 16)


@_query("WITH a AS (SELECT CAST(l_linenumber AS BIGINT) AS i, CAST(l_partkey AS BIGINT) AS j FROM lineitem GROUP BY 1, 2), b AS (SELECT CAST(l_partkey AS BIGINT) AS i, CAST(l_suppkey AS BIGINT) AS j FROM lineitem GROUP BY 1, 2), par AS (SELECT a.i AS i, a.j AS k, b.j AS j FROM a JOIN b ON a.j = b.i) SELECT i, k, j, CAST(ROW_NUMBER() OVER (PARTITION BY i ORDER BY j, k) AS BIGINT) AS rn FROM par")
def merged_rank_hot_rows(spark, sf_dir):
    """Ranks in seven rows that have all partials; no task orders a row."""
    parts, _ = _line_numbers(spark, sf_dir)
    return splits.merged_rank(cut_lineage(matrix.transpose(parts)), cut_lineage(ps(spark, sf_dir)))


@_query(f"WITH {_PO_OP}, {_RS} SELECT i, row_size FROM rs")
def row_sizes(spark, sf_dir):
    return product.row_sizes(po(spark, sf_dir), op(spark, sf_dir))


@_query(f"WITH {_PO_OP}, {_SPAN} SELECT i, row_size, row_off, row_end FROM span")
def row_size_prefix(spark, sf_dir):
    return layout.row_spans(po(spark, sf_dir), op(spark, sf_dir))


@_query(f"WITH {_PO_OP}, {_PAR}, t AS (SELECT COUNT(*) AS total FROM par) SELECT total, CAST(total // {BLOCK} AS BIGINT) AS full_blocks, CAST(total % {BLOCK} AS BIGINT) AS tail FROM t")
def total_partials(spark, sf_dir):
    return product.total_partials(po(spark, sf_dir), op(spark, sf_dir))


@_query(f"WITH {_PO_OP}, {_PAR} SELECT i, COUNT(DISTINCT j) AS nnz FROM par GROUP BY i")
def symbolic_nnz(spark, sf_dir):
    return product.symbolic_nnz(po(spark, sf_dir), op(spark, sf_dir))


@_query(f"WITH {_PO_OP}, {_PAR}, e AS (SELECT COUNT(*) AS n FROM par GROUP BY i, j) SELECT CAST(SUM(n) AS BIGINT) AS partials, COUNT(*) AS nnz, ROUND(CAST(SUM(n) AS DOUBLE) / COUNT(*), 6) AS ratio FROM e")
def compression_ratio(spark, sf_dir):
    return product.compression_ratio(po(spark, sf_dir), op(spark, sf_dir))


@_query(f"WITH {_PO_OP}, {_RS}, lc AS (SELECT a.i AS i, COUNT(*) AS m, CAST(MAX(COALESCE(bl.n, 0)) AS BIGINT) AS n_max, CAST(SUM(COALESCE(bl.n, 0)) AS BIGINT) AS total FROM a LEFT JOIN bl ON a.j = bl.k GROUP BY a.i) SELECT i, m, n_max, total FROM lc")
def list_stats(spark, sf_dir):
    return layout.list_stats(po(spark, sf_dir), op(spark, sf_dir))


# layout


def _copurchase(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    a, b = po(spark, sf_dir), op(spark, sf_dir)
    return a, b, layout.block_cuts(layout.row_spans(a, b))


def _supplier(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    a, b = sp(spark, sf_dir), ps(spark, sf_dir)
    return a, b, layout.block_cuts(layout.row_spans(a, b))


def _written(m: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(a, b, spans, cuts) of the product of the transpose of ``m`` with ``m``; matrix, spans and cuts are written once for all that follows."""
    b = cut_lineage(m)
    a = matrix.transpose(b)
    spans = cut_lineage(layout.row_spans(a, b))
    return a, b, spans, cut_lineage(layout.block_cuts(spans))


_CUTS_OUT = "SELECT blk, i, p, CASE WHEN 2 * p > row_size THEN row_size - p ELSE p END AS f, CAST(CASE WHEN 2 * p > row_size THEN 1 ELSE 0 END AS INTEGER) AS reverse FROM cut"


@_query(f"WITH {_PO_OP}, {_CUT} {_CUTS_OUT}")
def block_cuts(spark, sf_dir):
    return _copurchase(spark, sf_dir)[2].drop("row_size")


@_query(f"WITH {_SP_PS}, {_CUT} {_CUTS_OUT}")
def block_cuts_supplier(spark, sf_dir):
    return _supplier(spark, sf_dir)[2].drop("row_size")


@_query(f"WITH {_PO_OP}, {_CUT} SELECT CAST(CASE WHEN 2 * p > row_size THEN 1 ELSE 0 END AS INTEGER) AS reverse, COUNT(*) AS n FROM cut GROUP BY 1")
def cut_direction_counts(spark, sf_dir):
    return layout.direction_counts(_copurchase(spark, sf_dir)[2])


@_query(f"WITH {_PO_OP}, {_POS} SELECT CAST(blk AS BIGINT) AS blk, i, COUNT(*) AS n FROM pos GROUP BY blk, i")
def block_assign(spark, sf_dir):
    return blocks.block_assign(layout.row_spans(po(spark, sf_dir), op(spark, sf_dir)))


@_query(f"WITH {_PO_OP}, {_POS} SELECT CAST(blk AS BIGINT) AS blk, MIN(i) AS start_row, MAX(i) AS end_row, COUNT(DISTINCT i) AS nrows FROM pos GROUP BY blk")
def block_row_span(spark, sf_dir):
    return layout.block_row_span(layout.row_spans(po(spark, sf_dir), op(spark, sf_dir)))


@_query(f"WITH {_PO_OP}, {_CUT}, {_OPEN}, e AS (SELECT blk, 3 + m AS words FROM op1) SELECT blk, CAST(SUM(words) OVER (ORDER BY blk) - words AS BIGINT) AS ptr FROM e")
def partition_offsets(spark, sf_dir):
    a, _, cuts = _copurchase(spark, sf_dir)
    return layout.record_offsets(layout.record_openings(a, cuts))


_STATS = (
    f"{_M}, e AS (SELECT cut.*, lc.m, i_of(cut) AS d FROM cut JOIN lc ON cut.i = lc.i)"
).replace("i_of(cut)", "cut.i - COALESCE(LAG(cut.i) OVER (ORDER BY cut.blk), 0)")
_STATS_OUT = (
    "SELECT COUNT(*) AS splits, CAST(COALESCE(SUM(CASE WHEN p <= m THEN 1 ELSE 0 END), 0) AS BIGINT) AS shorts, CAST(COALESCE(SUM(CASE WHEN 2 * p > row_size THEN 1 ELSE 0 END), 0) AS BIGINT) AS longs, "
    "CAST(COALESCE(SUM(CASE WHEN m > 128 THEN 1 ELSE 0 END), 0) AS BIGINT) AS long_rows, CAST(COALESCE(SUM(CASE WHEN m = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS singles, "
    f"CAST(COALESCE(SUM(CASE WHEN row_size > {BLOCK} THEN 1 ELSE 0 END), 0) AS BIGINT) AS multi_rows, CAST(COALESCE(MAX(m), 0) AS BIGINT) AS max_cut_size, CAST(COALESCE(MAX(d), 0) AS BIGINT) AS max_nrows FROM e"
)


@_query(f"WITH {_PO_OP}, {_CUT}, {_STATS} {_STATS_OUT}")
def partition_stats(spark, sf_dir):
    a, _, cuts = _copurchase(spark, sf_dir)
    return layout.partition_stats(a, cuts)


@_query(f"WITH {_SP_PS}, {_CUT}, {_STATS} {_STATS_OUT}")
def partition_stats_supplier(spark, sf_dir):
    a, _, cuts = _supplier(spark, sf_dir)
    return layout.partition_stats(a, cuts)


# splits


@_query(f"WITH {_PO_OP}, {_POS} SELECT i, k, j, rn FROM pos")
def merged_rank(spark, sf_dir):
    return splits.merged_rank(po(spark, sf_dir), op(spark, sf_dir))


@_query(f"WITH {_PO_OP}, {_VEC} SELECT blk, i, k, b FROM vec")
def split_forward(spark, sf_dir):
    a, b, _, cuts = _written(op(spark, sf_dir))
    return splits.split(a, b, cuts)


@_query(f"WITH {_SP_PS}, {_VEC} SELECT blk, i, k, b FROM vec")
def split_forward_supplier(spark, sf_dir):
    a, b, _, cuts = _written(ps(spark, sf_dir))
    return splits.split(a, b, cuts)


@_query(f"WITH {_PO_OP}, {_VEC} SELECT blk, i, k, b FROM vec")
def split_reverse(spark, sf_dir):
    a, b, _, cuts = _written(op(spark, sf_dir))
    return splits.split_from_right(a, b, cuts)


# materialised once: the cuts and both sides of each come from one look at the placed partials
_PLACED = f"{_PAR}, {_SPAN}, pos AS MATERIALIZED (SELECT r.i, r.j, r.rn, CAST((span.row_off + r.rn - 1) // {BLOCK} AS BIGINT) AS blk, (span.row_off + r.rn) % {BLOCK} = 0 AS ends FROM (SELECT i, j, ROW_NUMBER() OVER (PARTITION BY i ORDER BY j, k) AS rn FROM par) r JOIN span ON r.i = span.i), cut AS MATERIALIZED (SELECT blk, i, rn AS p FROM pos WHERE ends)"
_EDGES = "SELECT cut.blk, MAX(CASE WHEN pos.rn = cut.p THEN pos.j END) AS lmax, MAX(CASE WHEN pos.rn = cut.p + 1 THEN pos.j END) AS rmin FROM cut JOIN pos ON pos.i = cut.i AND pos.rn BETWEEN cut.p AND cut.p + 1 GROUP BY cut.blk"


@_query(f"WITH {_PO_OP}, {_PLACED}, e AS ({_EDGES}) SELECT blk, lmax, COALESCE(rmin, -1) AS rmin FROM e")
def split_lmax_rmin(spark, sf_dir):
    """A cut at a row's end has nothing to its right: -1."""
    a, b, _, cuts = _written(op(spark, sf_dir))
    return splits.split_edges(a, b, cuts).select("blk", "lmax", F.coalesce("rmin", F.lit(-1)).cast("long").alias("rmin"))


@_query(f"WITH {_PO_OP}, {_PLACED}, e AS ({_EDGES}) SELECT blk, CAST(CASE WHEN lmax = rmin THEN 1 ELSE 0 END AS INTEGER) AS carry FROM e")
def split_carry(spark, sf_dir):
    a, b, _, cuts = _written(op(spark, sf_dir))
    return splits.split_carry(splits.split_edges(a, b, cuts))


def _checked(m: DataFrame) -> DataFrame:
    a, b, _, cuts = _written(m)
    return splits.checked(a, b, cuts)


@_query(f"WITH {_PO_OP}, {_CUT} SELECT blk, CAST(1 AS INTEGER) AS ok, CAST(1 AS INTEGER) AS carry_ok FROM cut")
def split_check(spark, sf_dir):
    return _checked(op(spark, sf_dir))


@_query(f"WITH {_SP_PS}, {_CUT} SELECT blk, CAST(1 AS INTEGER) AS valid FROM cut")
def partition_valid(spark, sf_dir):
    """Fails on the first bad split."""
    return splits.assert_valid(_checked(ps(spark, sf_dir)))


_RECORDS_SQL = (
    f"WITH {_PO_OP}, {_VEC}, {_CARRY}, {_OPEN}, parts AS (SELECT blk + 1 AS blk, k, b FROM vec UNION ALL SELECT op1.blk, a.j, 0 FROM op1 JOIN a ON op1.i = a.i WHERE op1.blk = 0) "
    "SELECT blk, CAST(0 AS BIGINT) AS word, i AS value FROM op1 UNION ALL SELECT blk, 1, m FROM op1 UNION ALL SELECT op1.blk, 2, COALESCE(car.carry, 0) FROM op1 LEFT JOIN car ON op1.blk = car.blk "
    "UNION ALL SELECT blk, ROW_NUMBER() OVER (PARTITION BY blk ORDER BY k) + 2, b FROM parts"
)


@_query(_RECORDS_SQL)
def partition_records(spark, sf_dir):
    a, b, spans, cuts = _written(op(spark, sf_dir))
    carry = blocks.block_carries(spans, splits.split_carry(splits.split_edges(a, b, cuts)))
    return splits.partition_records(layout.record_openings(a, cuts), splits.split(a, b, cuts), a, carry)


@_query(_RECORDS_SQL)
def partition_records_read(spark, sf_dir):
    """The records written, a row a record, and read back."""
    path = _scratch(spark)
    records.write_records(partition_records(spark, sf_dir), path)
    return records.read_records(spark, path)


@_query(_RECORDS_SQL)
def partition_words_read(spark, sf_dir):
    """The records as packed words, written and read back."""
    path = _scratch(spark)
    records.export_words(partition_records(spark, sf_dir), partition_offsets(spark, sf_dir), path)
    return records.import_words(spark, path)


@_query(
    f"WITH {_PO_OP}, {_CUT}, {_OPEN}, e AS (SELECT blk, 3 + m AS words FROM op1), ptrs AS (SELECT blk, CAST(SUM(words) OVER (ORDER BY blk) - words AS BIGINT) AS ptr FROM e), c AS ({_CUTS_OUT}) "
    "SELECT c.i || ' ' || c.f || ' ' || ptrs.ptr || ' ' || c.reverse AS value FROM c JOIN ptrs ON ptrs.blk = c.blk + 1"
)
def split_text(spark, sf_dir):
    """Text lines of the cuts (row, count, word, direction), written and read back."""
    cuts, path = _copurchase(spark, sf_dir)[2], _scratch(spark)
    opened = partition_offsets(spark, sf_dir).select((F.col("blk") - 1).alias("blk"), F.col("ptr").alias("off"))
    records.split_lines(cuts, opened).write.text(path)
    return spark.read.text(path)


# blocks


@_query(f"WITH {_PO_OP}, {_POS}, {_RUNS} SELECT blk, i, j, s FROM run")
def block_runs(spark, sf_dir):
    return blocks.block_runs(*po_op(spark, sf_dir), dealt=True).select("blk", "i", "j", "s")


@_query(f"WITH {_SP_PS}, {_POS}, {_RUNS} SELECT blk, i, j, s FROM run")
def block_runs_supplier(spark, sf_dir):
    return blocks.block_runs(*sp_ps(spark, sf_dir)).select("blk", "i", "j", "s")


@_query(f"WITH {_PO_OP}, {_POS}, {_RUNS} SELECT blk, i, j, CAST(first - blk * {BLOCK} AS BIGINT) AS first_pos, CAST(last - blk * {BLOCK} AS BIGINT) AS last_pos FROM run")
def run_boundaries(spark, sf_dir):
    return blocks.run_boundaries(blocks.block_runs(*po_op(spark, sf_dir), dealt=True))


@_query(f"WITH {_PO_OP}, {_POS}, {_RUNS}, n AS (SELECT blk, COUNT(*) AS n_runs FROM run GROUP BY blk) SELECT blk, n_runs, CAST(SUM(n_runs) OVER (ORDER BY blk) - n_runs AS BIGINT) AS out_start FROM n")
def block_out_sizes(spark, sf_dir):
    return blocks.block_out_sizes(blocks.block_runs(*po_op(spark, sf_dir), dealt=True))


@_query(f"WITH {_PO_OP}, {_POS}, {_CARRY} SELECT CAST(blk AS BIGINT) AS blk, carry FROM car")
def block_carries(spark, sf_dir):
    a, b, spans, cuts = _written(op(spark, sf_dir))
    return blocks.block_carries(spans, splits.split_carry(splits.split_edges(a, b, cuts)))


@_query(f"WITH {_PO_OP}, {_PAR} SELECT i, j, SUM(x) AS v FROM par GROUP BY i, j")
def carry_apply(spark, sf_dir):
    return blocks.carry_apply(blocks.block_runs(*po_op(spark, sf_dir), dealt=True))


@_query(f"WITH {_PO_OP}, {_POS}, {_CHUNKS} SELECT blk, chunk, i, j, s FROM chk")
def chunk_runs(spark, sf_dir):
    return blocks.chunk_runs(*po_op(spark, sf_dir), dealt=True)


@_query(f"WITH {_PO_OP}, {_POS}, {_CHUNKS} SELECT blk, chunk, CAST(DENSE_RANK() OVER (PARTITION BY blk ORDER BY i, j) - 1 AS BIGINT) AS seg, SUM(s) OVER (PARTITION BY blk, i, j ORDER BY chunk) AS running FROM chk")
def segmented_scan(spark, sf_dir):
    return blocks.segmented_scan(blocks.chunk_runs(*po_op(spark, sf_dir), dealt=True))


@_query(f"WITH {_PO_OP}, {_POS}, l AS (SELECT blk, i, k, j, ROW_NUMBER() OVER (PARTITION BY blk ORDER BY i, k, j) - 1 AS r FROM pos) SELECT CAST(blk AS BIGINT) AS blk, CAST(r // 16 AS BIGINT) AS chunk, i, k, j FROM l WHERE r % 16 = 0")
def thread_splits(spark, sf_dir):
    return blocks.thread_splits(*po_op(spark, sf_dir), dealt=True)


# selection over lists: row i merges the parts of its orders; 5 moves of 2 elements each

_LISTS = "lists AS (SELECT CAST(o_custkey AS BIGINT) AS i, CAST(o_orderkey AS BIGINT) AS k, op.j AS j FROM orders JOIN op ON orders.o_orderkey = op.i), pl AS (SELECT i, k, j, ROW_NUMBER() OVER (PARTITION BY i, k ORDER BY j) - 1 AS pos, COUNT(*) OVER (PARTITION BY i, k) AS len FROM lists)"
MOVES, STRIDE = 5, 2


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("i"), F.col("o_orderkey").cast("long").alias("k"))
    return orders.join(op(spark, sf_dir).select(F.col("i").alias("k"), "j"), "k")


def _topk_sql(stops: str, order: str, start: str, sign: str) -> str:
    return (
        f"WITH {_OP}, {_LISTS}, t AS (SELECT i, k, ROW_NUMBER() OVER (PARTITION BY i ORDER BY {order}) AS r FROM pl WHERE {stops}), n AS (SELECT i, k, COUNT(*) AS taken FROM t WHERE r <= {MOVES} GROUP BY i, k) "
        f"SELECT pl.i, pl.k, CAST({start} {sign} {STRIDE} * COALESCE(n.taken, 0) AS BIGINT) AS b FROM pl LEFT JOIN n ON pl.i = n.i AND pl.k = n.k WHERE pl.pos = 0"
    )


@_query(_topk_sql(f"pos % {STRIDE} = {STRIDE - 1}", "j, k", "0", "+"))
def topk_advance(spark, sf_dir):
    return selection.topk_advance(_lists(spark, sf_dir), MOVES, STRIDE)


@_query(_topk_sql(f"pos % {STRIDE} = {STRIDE - 1} AND pos < len // {STRIDE} * {STRIDE}", "j DESC, k DESC", f"pl.len // {STRIDE} * {STRIDE}", "-"))
def topk_retreat(spark, sf_dir):
    return selection.topk_retreat(_lists(spark, sf_dir), MOVES, STRIDE)


@_query(_topk_sql(f"(len - pos) % {STRIDE} = 0", "j DESC, k DESC", "pl.len", "-"))
def topk_advance_rev(spark, sf_dir):
    return selection.topk_advance_from_right(_lists(spark, sf_dir), MOVES, STRIDE)


@_query(_topk_sql(f"pos >= len % {STRIDE} AND (pos - len % {STRIDE}) % {STRIDE} = 0", "j, k", f"pl.len % {STRIDE}", "+"))
def topk_retreat_rev(spark, sf_dir):
    return selection.topk_retreat_from_right(_lists(spark, sf_dir), MOVES, STRIDE)


_WRITES = "w AS (SELECT CAST(l_suppkey AS BIGINT) AS id, CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS seq, CAST(CASE WHEN l_linenumber > 5 THEN -1 ELSE l_quantity END AS BIGINT) AS val FROM lineitem), h AS (SELECT id, val FROM (SELECT id, val, ROW_NUMBER() OVER (PARTITION BY id ORDER BY seq DESC, val DESC) AS r FROM w) WHERE r = 1 AND val <> -1)"


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("l_linenumber") > 5, F.lit(-1)).otherwise(F.col("l_quantity")).cast("long")
    return _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("id"), (F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")).alias("seq"), value.alias("val"))


@_query(f"WITH {_WRITES} SELECT id, val FROM h")
def heap_update(spark, sf_dir):
    return selection.heap_update(_writes(spark, sf_dir))


@_query(f"WITH {_WRITES} SELECT id, val FROM h ORDER BY val, id LIMIT 1")
def heap_first(spark, sf_dir):
    return selection.heap_first(selection.heap_update(_writes(spark, sf_dir)))


# bits


@_query(f"WITH {_OP} SELECT DISTINCT j % 16384 AS id, i AS val, i * 16384 + j % 16384 AS code, j % 16384 AS id2, i AS val2 FROM op")
def element_encode(spark, sf_dir):
    coded = op(spark, sf_dir).select((F.col("j") % (1 << bits.ID_BITS)).alias("id"), F.col("i").alias("val")).distinct().withColumn("code", bits.encode_element(F.col("val"), F.col("id")))
    return coded.select("id", "val", "code", bits.element_number(F.col("code")).alias("id2"), bits.element_value(F.col("code")).alias("val2"))


@_query(
    f"WITH {_OP}, pw AS (SELECT g, CAST(POWER(2, g) AS BIGINT) AS w FROM (SELECT UNNEST(RANGE(1, 40)) AS g)), width AS (SELECT MIN(g) AS bits, MIN(w) AS w FROM pw WHERE w > (SELECT MAX(j) FROM op)) "
    "SELECT i, j, CAST(width.bits AS INTEGER) AS bits, i * width.w + j AS key, i AS i2, j AS j2 FROM op, width"
)
def key_pack_roundtrip(spark, sf_dir):
    m = op(spark, sf_dir)
    width = m.agg(F.greatest(F.lit(1), bits.bit_width(F.max("j"))).cast("int").alias("bits"))
    packed = m.select("i", "j").join(F.broadcast(width)).withColumn("key", bits.pack(F.col("i"), F.col("j"), F.col("bits")))  # one row
    return packed.select("i", "j", "bits", "key", bits.unpack_row(F.col("key"), F.col("bits")).alias("i2"), bits.unpack_column(F.col("key"), F.col("bits")).alias("j2"))


# sources

_DRAW = f"((({{i}} * {synth.MULTIPLIER} + t * {synth.STEP} + {synth.START}) % 2147483647) % {{n}})"


@_query(
    f"WITH n AS (SELECT COUNT(*) AS n FROM part), d AS (SELECT CAST(p_partkey AS BIGINT) AS i, t FROM part, (SELECT UNNEST(RANGE(0, 4)) AS t)) "
    f"SELECT i, {_DRAW.format(i='i', n='(n.n - 1)')} + 1 AS j, CAST(COUNT(*) AS DOUBLE) AS v FROM d, n GROUP BY 1, 2"
)
def synth_square(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    return synth.synth_square(parts, parts.count())


@_query(
    f"WITH n AS (SELECT COUNT(*) AS n FROM supplier), d AS (SELECT CAST(p_partkey AS BIGINT) AS i, t FROM part, (SELECT UNNEST(RANGE(0, 3)) AS t)), "
    f"e AS (SELECT i, t, {_DRAW.format(i='i', n='(n.n - 1)')} + 1 AS j, CAST({_DRAW.format(i='(i + 7)', n='2001')} - 1000 AS DOUBLE) AS v FROM d, n) "
    "SELECT i, j, v FROM (SELECT i, j, v, ROW_NUMBER() OVER (PARTITION BY i, j ORDER BY t DESC) AS r FROM e) WHERE r = 1"
)
def synth_rect(spark, sf_dir):
    return synth.synth_rect(_parts(spark, sf_dir), _table(spark, sf_dir, "supplier").count())


@_query(
    f"WITH {_SP}, low AS (SELECT i, j FROM sp WHERE j <= i), m AS (SELECT i, j FROM low UNION ALL SELECT j, i FROM low WHERE i <> j) SELECT i, j, CAST({mtx.PATTERN_VALUE} AS DOUBLE) AS v FROM m"
)
def mtx_symmetric_pattern(spark, sf_dir):
    """The triangle of a matrix as a symmetric file without values, read with its mirrored half."""
    m, path = sp(spark, sf_dir), _scratch(spark)
    size = m.agg(F.max(F.greatest("i", "j")).alias("n")).first()["n"] or 0
    mtx.write_mtx(m, path, size + 1, size + 1, "pattern", "symmetric", "suppliers and their parts")
    return mtx.read_mtx(spark, path)


@_query(f"WITH {_SP}, low AS (SELECT * FROM sp WHERE j <= i) SELECT i, j, v FROM low UNION ALL SELECT j, i, v FROM low WHERE i <> j")
def mtx_symmetric_integer(spark, sf_dir):
    """The same with whole values."""
    m, path = sp(spark, sf_dir), _scratch(spark)
    size = m.agg(F.max(F.greatest("i", "j")).alias("n")).first()["n"] or 0
    mtx.write_mtx(m, path, size + 1, size + 1, "integer", "symmetric")
    return mtx.read_mtx(spark, path)


_C = "c AS (SELECT i, j, SUM(x) AS v FROM par GROUP BY i, j)"


@_query(f"WITH {_PO_OP}, {_PAR}, {_C}, n AS (SELECT i, COUNT(*) AS n FROM c GROUP BY i) SELECT i, n, CAST(SUM(n) OVER (ORDER BY i) - n AS BIGINT) AS ptr FROM n")
def product_row_pointers(spark, sf_dir):
    """Where each row of the product begins among its entries."""
    return matrix.row_pointers(product.product(po(spark, sf_dir), op(spark, sf_dir)))


@_query(f"WITH {_PO_OP}, {_PAR}, {_C} SELECT i, j, v, CAST(ROW_NUMBER() OVER (ORDER BY i, j) - 1 AS BIGINT) AS pos FROM c")
def product_table(spark, sf_dir):
    """The product written as entries in order and row pointers, and read back with each entry's place."""
    path = _scratch(spark)
    result.write_csr(product.product(po(spark, sf_dir), op(spark, sf_dir)), path)
    return result.read_csr(spark, path)


@_query(f"WITH {_SP} SELECT i, j, v FROM sp")
def mtx_roundtrip(spark, sf_dir):
    m, path = sp(spark, sf_dir), _scratch(spark)
    shape = m.agg(F.max("i").alias("i"), F.max("j").alias("j")).first()
    mtx.write_mtx(m, path, (shape["i"] or 0) + 1, (shape["j"] or 0) + 1)
    return mtx.read_mtx(spark, path)


@_query(f"WITH {_PO_OP}, {_PAR}, {_C} SELECT CAST(DENSE_RANK() OVER (ORDER BY i) - 1 AS BIGINT) AS row, CAST(ROW_NUMBER() OVER (ORDER BY i, j) - 1 AS BIGINT) AS pos, j, v FROM c")
def product_files(spark, sf_dir):
    """The product as files of packed words (row pointers, columns, 32-bit values), written by tasks and read back."""
    path = _scratch(spark)
    result.write_files(product.product(po(spark, sf_dir), op(spark, sf_dir)), path)
    return result.read_files(spark, path)


@_query(_RECORDS_SQL)
def partition_word_files(spark, sf_dir):
    """The partition records and their offsets as files of packed words, written by tasks and read back."""
    path = _scratch(spark)
    words.write_records(partition_records(spark, sf_dir), partition_offsets(spark, sf_dir), path)
    return words.read_records(spark, path)


def _as_mtx(spark: SparkSession, m: DataFrame, symmetry: str) -> str:
    """The path of ``m`` written by the data source."""
    spark.dataSource.register(mtx_source.MtxSource)
    path, ends = _scratch(spark), m.agg(F.max("i").alias("i"), F.max("j").alias("j")).first()
    rows, columns = (ends["i"] or 0) + 1, (ends["j"] or 0) + 1
    if symmetry == "symmetric":
        rows = columns = max(rows, columns)
    m.write.format("mtx").options(rows=rows, columns=columns, symmetry=symmetry).mode("append").save(path)
    return path


@_query(f"WITH {_SP}, low AS (SELECT * FROM sp WHERE j <= i) SELECT i, j, v FROM low UNION ALL SELECT j, i, v FROM low WHERE i <> j")
def mtx_source_symmetric(spark, sf_dir):
    """A triangle written and read by the data source, in pieces of 64 KB."""
    path = _as_mtx(spark, sp(spark, sf_dir), "symmetric")
    return spark.read.format("mtx").option("split_bytes", 1 << 16).load(path).drop("at")


@_query(f"WITH {_SP} SELECT CAST(MAX(i) + 1 AS BIGINT) AS rows, CAST(MAX(j) + 1 AS BIGINT) AS columns, COUNT(*) AS entries, COUNT(*) AS found, TRUE AS fits FROM sp")
def mtx_counts(spark, sf_dir):
    """A file's size line against what it holds."""
    return mtx_source.counted(spark, _as_mtx(spark, sp(spark, sf_dir), "general"))


@_query(f"WITH {_PO_OP}, {_PAR} SELECT i, j, SUM(x) AS v FROM par GROUP BY i, j")
def spgemm_stored(spark, sf_dir):
    """The product of matrices kept in buckets, joined without a shuffle by key."""
    path, name = _scratch(spark), f"m{uuid.uuid4().hex}"
    a = stored.store(po(spark, sf_dir), f"{name}_a", "j", 16, f"{path}/a")
    b = stored.store(op(spark, sf_dir), f"{name}_b", "i", 16, f"{path}/b")
    return product.product(a, b)


@_query(f"WITH {_PO_OP}, {_PAR}, e AS (SELECT COUNT(*) AS n FROM par GROUP BY i, j) SELECT CAST(SUM(n) AS BIGINT) AS partials, COUNT(*) AS entries, MAX(n) AS most FROM e")
def product_counts(spark, sf_dir):
    """What a product's one writing pass counts on the way."""
    counts = result.write_counted(po(spark, sf_dir), op(spark, sf_dir), _scratch(spark))
    return spark.createDataFrame([(counts["partials"], counts["entries"], counts["most"])], "partials long, entries long, most long")


#: labels spread over 2^40 numbers
_SPREAD = 1099511627689


@_query(
    f"WITH {_OP}, a AS (SELECT (j * 48271 * 48271) % {_SPREAD} AS i, i AS j, v FROM op), b AS (SELECT * FROM op), {_RS}, span AS (SELECT i, row_size, CAST(SUM(row_size) OVER (ORDER BY i) AS BIGINT) AS row_end FROM rs) "
    "SELECT i, row_size, row_end - row_size AS row_off, row_end FROM span"
)
def row_size_prefix_hashed(spark, sf_dir):
    """Spans of rows whose labels lie far apart, as hashes do."""
    b = op(spark, sf_dir)
    a = matrix.transpose(b).withColumn("i", (F.col("i") * 48271 * 48271) % F.lit(_SPREAD))
    return layout.row_spans(a, b, label_bits=40)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items()}
