import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import blocks, layout, matrix, product, ranks, selection, splits

A3 = [(0, 0, 2), (0, 2, 1), (1, 1, 3), (3, 0, 4)]
B3 = [(0, 0, 1), (0, 1, 5), (1, 1, 6), (2, 0, -2)]


def seeded_lists(seed, sizes, top):
    rng = random.Random(seed)
    return [sorted(rng.randrange(top) for _ in range(n)) for n in sizes]


def left_parts(lists, p):
    """How much of each list is among the first p of all by (value, list), and whether the cut parts equal values."""
    merged = sorted((x, k) for k, values in enumerate(lists) for x in values)
    return [sum(k == n for _, k in merged[:p]) for n in range(len(lists))], int(p < len(merged) and merged[p - 1][0] == merged[p][0])


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def as_row(coo, lists):
    """One row of A that merges the given lists (values without repeats)."""
    a = coo([(0, k, 1) for k in range(len(lists))])
    b = coo([(k, j, 1) for k, values in enumerate(lists) for j in values])
    return a, b


def model(a, b, block):
    """Blocks, cuts and carries by expanding and sorting everything."""
    by_k = {}
    for k, j, v in b:
        by_k.setdefault(k, []).append((j, v))
    par = sorted((i, j, k, av * bv) for i, k, av in a for j, bv in by_k.get(k, []))
    runs, cuts, carry = {}, [], {}
    start = {}
    for n, (i, j, _, x) in enumerate(par):
        start.setdefault(i, n)
        runs[n // block, i, j] = runs.get((n // block, i, j), 0) + x
        if (n + 1) % block == 0:
            cuts.append((n // block, i, n + 1 - start[i]))
        if n + 1 == len(par) or (n + 1) % block == 0:
            carry[n // block] = int(n + 1 < len(par) and par[n + 1][:2] == (i, j))
    return par, runs, cuts, carry


def test_small_product_with_an_empty_row_and_a_cancelled_sum(coo):
    a, b = coo(A3), coo(B3)
    assert rows(product.product(a, b), "i", "j", "v") == [(0, 0, 0.0), (0, 1, 10.0), (1, 1, 18.0), (3, 0, 4.0), (3, 1, 20.0)]
    assert rows(product.row_sizes(a, b), "i", "row_size") == [(0, 3), (1, 1), (3, 2)]
    c = product.product(a, b)
    spine = a.sparkSession.range(4).withColumnRenamed("id", "i")
    assert [r[2] for r in rows(matrix.row_pointers(c, spine), "i", "n", "ptr")] == [0, 2, 3, 3]
    assert rows(matrix.row_pointers(c), "i", "ptr") == [(0, 0), (1, 2), (3, 3)]
    assert rows(splits.merged_rank(a, b), "i", "j", "k", "rn")[:3] == [(0, 0, 0, 1), (0, 0, 2, 2), (0, 1, 0, 3)]


@pytest.mark.parametrize("block,cuts,carried", [(1, [(0, 1), (0, 2), (0, 3), (1, 1), (3, 1), (3, 2)], {0}), (2, [(0, 2), (1, 1), (3, 2)], set()), (3, [(0, 3), (3, 2)], set()), (4, [(1, 1)], set())])
def test_cuts_and_carries_of_the_small_product(coo, block, cuts, carried):
    a, b = coo(A3), coo(B3)
    assert rows(layout.block_cuts(layout.row_spans(a, b), block), "blk", "i", "p") == [(n, *c) for n, c in enumerate(cuts)]
    assert {r.blk for r in blocks.carries(a, b, block).collect() if r.carry} == carried


@pytest.mark.parametrize("seed,p", [(1, 20), (1, 27), (2, 1), (2, 33), (3, 40), (3, 13)])
def test_splits_equal_a_stable_sort(coo, seed, p):
    lists = [sorted(set(x)) for x in seeded_lists(seed, [17, 9, 1, 25, 11], 40)]
    a, b = as_row(coo, lists)
    cuts = layout.block_cuts(layout.row_spans(a, b), p).where("blk = 0")
    expected, carry = left_parts(lists, p)
    assert [r[1] for r in rows(splits.split(a, b, cuts, p), "k", "b")] == expected
    assert [r[1] for r in rows(splits.split_from_right(a, b, cuts, p), "k", "b")] == expected
    edges = splits.split_edges(a, b, cuts, p)
    assert rows(splits.split_carry(edges), "carry") == [(carry,)]
    checked = splits.split_check(a, b, cuts, splits.split(a, b, cuts, p), splits.split_carry(edges))
    assert rows(checked, "ok", "carry_ok") == [(1, 1)]
    assert rows(splits.assert_valid(checked), "blk", "valid") == [(0, 1)]


def test_a_wrong_split_is_found(spark, coo):
    lists = [[1, 2, 6, 9, 12], [2, 8, 9, 21], [6, 7, 9, 12], [3, 8, 10, 13]]
    a, b = as_row(coo, lists)
    cuts = layout.block_cuts(layout.row_spans(a, b), 8).where("blk = 0")
    right, _ = left_parts(lists, 8)
    carry = splits.split_carry(splits.split_edges(a, b, cuts, 8))
    for step in ([1, -1, 0, 0], [0, 0, 1, 0]):
        wrong = spark.createDataFrame([(0, 0, k, n + step[k]) for k, n in enumerate(right)], "blk long, i long, k long, b long")
        checked = splits.split_check(a, b, cuts, wrong, carry)
        assert rows(checked, "ok") == [(0,)]
        with pytest.raises(Exception, match="bad split"):
            splits.assert_valid(checked).collect()


def test_an_entry_longer_than_blocks(coo):
    a, b = coo([(0, k, 1) for k in range(5000)]), coo([(k, 0, 1) for k in range(5000)])
    runs = blocks.block_runs(a, b, 2048)
    assert rows(runs, "blk", "s", "n") == [(0, 2048.0, 2048), (1, 2048.0, 2048), (2, 904.0, 904)]
    assert rows(blocks.carries(a, b, 2048), "blk", "carry") == [(0, 1), (1, 1), (2, 0)]
    assert rows(blocks.carry_apply(runs), "i", "j", "v") == [(0, 0, 5000.0)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("shape", [(12, 9, 7), (5, 30, 3)])
def test_random_rectangles_against_full_expansion(coo, seed, shape):
    rng = random.Random(seed)
    n, m, q = shape
    a_rows = [(i, k, rng.randint(-3, 3)) for i in range(n) for k in range(m) if rng.random() < 0.4]
    b_rows = [(k, j, rng.randint(-3, 3)) for k in range(m) for j in range(q) if rng.random() < 0.5]
    a, b = coo(a_rows), coo(b_rows)
    block = rng.choice([4, 7, 16])
    par, runs, cuts, carry = model(a_rows, b_rows, block)
    spans = layout.row_spans(a, b)
    made = layout.block_cuts(spans, block)
    assert rows(made, "blk", "i", "p") == cuts
    assert rows(blocks.block_runs(a, b, block), "blk", "i", "j", "s") == sorted((blk, i, j, s) for (blk, i, j), s in runs.items())
    assert {r.blk: r.carry for r in blocks.carries(a, b, block).collect()} == carry
    vectors = splits.split(a, b, made, block)
    assert rows(vectors, "blk", "i", "k", "b") == rows(splits.split_from_right(a, b, made, block), "blk", "i", "k", "b")
    assert sorted((r[0], r[1]) for r in vectors.groupBy("blk").sum("b").collect()) == [(blk, p) for blk, _, p in cuts]
    product_rows = {}
    for i, j, _, x in par:
        product_rows[i, j] = product_rows.get((i, j), 0) + x
    assert rows(blocks.carry_apply(blocks.block_runs(a, b, block)), "i", "j", "v") == sorted((i, j, float(x)) for (i, j), x in product_rows.items())
    assert rows(product.product(a, b), "i", "j", "v") == sorted((i, j, float(x)) for (i, j), x in product_rows.items())
    total = rows(product.total_partials(a, b, block), "total", "full_blocks", "tail")
    assert total == [(len(par), len(par) // block, len(par) % block)]
    loaded = rows(blocks.thread_splits(a, b, block, 2), "blk", "chunk", "i", "k", "j")
    by_block = {}
    for place, (i, j, k, _) in enumerate(par):
        by_block.setdefault(place // block, []).append((i, k, j))
    assert loaded == sorted((blk, n // 2, *x) for blk, xs in by_block.items() for n, x in enumerate(sorted(xs)) if n % 2 == 0)


def test_empty_matrices(coo):
    a, b = coo([]), coo(B3)
    assert product.product(a, b).count() == 0
    assert rows(product.total_partials(a, b), "total", "full_blocks", "tail") == [(0, 0, 0)]
    assert layout.block_cuts(layout.row_spans(a, b)).count() == 0
    assert blocks.carries(a, b).count() == 0


@pytest.mark.parametrize("chunk_bits", [0, 2, 16])
def test_prefix_sums_over_chunks(spark, chunk_bits):
    rng = random.Random(4)
    keys = sorted(rng.sample(range(-50, 1000), 60))
    values = [rng.randint(0, 9) for _ in keys]
    df = spark.createDataFrame(list(zip(keys, values, strict=True)), "key long, value long")
    got = dict(rows(matrix.prefix_sum(df, "key", "value", "before", chunk_bits=chunk_bits), "key", "before"))
    assert got == {k: sum(values[:n]) for n, k in enumerate(keys)}


def test_prefix_sums_over_keys_far_apart(spark):
    rng = random.Random(5)
    keys = sorted({rng.getrandbits(63) - 2**62 for _ in range(500)} | set(range(300)))
    df = spark.createDataFrame([(k, k % 7) for k in keys], "key long, value long")
    cuts = matrix.key_splits(df, "key", 50)
    assert 8 < len(cuts) < 20 and matrix.key_splits(df.limit(3), "key") == []
    for splits_ in (cuts, []):
        got = dict(rows(matrix.prefix_sum(df, "key", "value", "before", splits=splits_), "key", "before"))
        assert got == {k: sum(x % 7 for x in keys[:n]) for n, k in enumerate(keys)}


def tournament(lists, count, stride, kind):
    """The moves one by one."""
    n = [len(x) for x in lists]
    at = {"advance": [0] * len(n), "retreat": [x // stride * stride for x in n], "advance_right": list(n), "retreat_right": [x % stride for x in n]}[kind]
    for _ in range(count):
        if kind == "advance":
            able = [(lists[k][at[k] + stride - 1], k) for k in range(len(n)) if at[k] + stride <= n[k]]
        elif kind == "retreat":
            able = [(-lists[k][at[k] - 1], -k) for k in range(len(n)) if at[k] > 0]
        elif kind == "advance_right":
            able = [(-lists[k][at[k] - stride], -k) for k in range(len(n)) if at[k] - stride >= 0]
        else:
            able = [(lists[k][at[k]], k) for k in range(len(n)) if at[k] < n[k]]
        if not able:
            break
        k = abs(min(able)[1])
        at[k] += stride if kind in ("advance", "retreat_right") else -stride
    return at


@pytest.mark.parametrize("kind,operator", [("advance", selection.topk_advance), ("retreat", selection.topk_retreat), ("advance_right", selection.topk_advance_from_right), ("retreat_right", selection.topk_retreat_from_right)])
@pytest.mark.parametrize("stride,count", [(1, 9), (2, 4), (3, 2)])
def test_strided_selection_equals_the_tournament(spark, kind, operator, stride, count):
    rng = random.Random(stride)
    lists = [sorted(rng.sample(range(40), rng.randint(1, 12))) for _ in range(5)]
    df = spark.createDataFrame([(0, k, j) for k, x in enumerate(lists) for j in x], "i long, k long, j long")
    assert [r[1] for r in rows(operator(df, count, stride), "k", "b")] == tournament(lists, count, stride, kind)


def test_heap(spark):
    writes = spark.createDataFrame([(1, 1, 5), (2, 2, 3), (1, 3, -1), (3, 4, 3), (2, 5, 9)], "id long, seq long, val long")
    left = selection.heap_update(writes)
    assert rows(left, "id", "val") == [(2, 9), (3, 3)]
    assert rows(selection.heap_first(left), "id", "val") == [(3, 3)]
    assert selection.heap_first(left.limit(0)).count() == 0


def test_a_heavy_key_is_joined_in_tiles(spark):
    n, tile = 1500, 1 << 14
    a = spark.range(n).select(F.col("id").alias("i"), F.lit(7).cast("long").alias("j"), F.lit(1.0).alias("v")).unionByName(spark.createDataFrame([(1, 3, 2.0)], "i long, j long, v double"))
    b = spark.range(n).select(F.lit(7).cast("long").alias("i"), F.col("id").alias("j"), F.lit(2.0).alias("v")).unionByName(spark.createDataFrame([(3, 4, 5.0)], "i long, j long, v double"))
    got = product.tiled_partials(a, b, tile)
    assert got.exceptAll(product.partials(a, b)).isEmpty() and got.count() == n * n + 1
    left, right = product._tiles(a, b, product.heavy_keys(a, b, tile), tile)
    met = left.join(right, ["k", "down", "across"]).groupBy("k", "down", "across").count()
    assert met.agg(F.max("count")).first()[0] < 2 * tile
    assert left.count() + right.count() <= 2 * n * (n // 128 + 1)
    assert rows(product.product(a, b, tile), "i", "j", "v") == rows(product.product(a, b), "i", "j", "v")


def test_ranks_take_a_row_a_digit_and_list(spark):
    """Long lists aren't expanded: what a round joins is bounded by the lists and the digits."""
    lists, length = 20, 5000
    a = spark.range(lists).select(F.lit(0).cast("long").alias("i"), F.col("id").alias("j"))
    b = spark.range(lists * length).select((F.col("id") % lists).alias("i"), F.floor(F.col("id") / lists).cast("long").alias("j"))
    total = lists * length
    wanted = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (2, 0, total // 2 + 3), (3, 0, total)], "id long, i long, p long")
    got = {r.id: r.n for r in ranks.parts_at(a, b, wanted).groupBy("id").agg(F.sum("b").alias("n")).collect()}
    assert got == {0: 0, 1: 1, 2: total // 2 + 3, 3: total}
    assert {r.id: r.j for r in ranks.columns_at(a, b, wanted.where("p > 0")).collect()} == {1: 0, 2: (total // 2 + 2) // lists, 3: length - 1}
    counted = ranks._counted(b.withColumnRenamed("i", "k"), 1)
    assert counted.count() <= lists * (length // ranks.RADIX + 1)


def test_prefix_sums_of_keys_far_apart(spark):
    """Keys like hashes: chunks of chunks give the same sums, and several columns at once."""
    rng = random.Random(9)
    keys = sorted(rng.sample(range(1 << 20), 300))
    table = spark.createDataFrame([(g, k, n % 7, 1) for g in (0, 1) for n, k in enumerate(keys)], "g long, key long, n long, one long")
    got = matrix.prefix_sums(table, "key", {"upto": "n", "place": "one"}, within=("g",), chunk_bits=4, key_bits=20)
    want, total = [], 0
    for n, k in enumerate(keys):
        want.append((k, total, n))
        total += n % 7
    for g in (0, 1):
        assert rows(got.where(F.col("g") == g), "key", "upto", "place") == want
