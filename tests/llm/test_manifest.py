import hashlib
import zlib

import pytest

from weftline.llm import manifest, queries

COLUMNS = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, k):
    path = []
    for level in tree[:-1]:
        first = k // 8 * 8
        path.append(("".join(level[first:k]), "".join(level[k + 1 : first + 8])))
        k //= 8
    return path


def by_hand(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        head = "".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars)))
        leaf = given = h(head + field(r.text))
        if zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 3 == 0 and r.text is not None:
            given = h(head + field("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)))
        groups.setdefault(r.lang, []).append(((r.doc_id is not None, r.doc_id or 0, leaf), r.doc_id, leaf, given))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[0])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for n, g in enumerate(names):
        for k, (_, doc_id, leaf, folded) in enumerate(sorted(groups[g], key=lambda x: x[0])):
            path = siblings(trees[g], k) + siblings(top, n)
            for left, right in path:
                folded = h(left + folded + right)
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], h("".join(a + b for a, b in path)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def found(docs):
    return sorted((tuple(r) for r in manifest.verified(docs).select(*COLUMNS.split(", ")).collect()), key=str)


def test_odd_rows(odd_documents, no_documents):
    assert found(odd_documents) == by_hand(odd_documents.collect())
    assert found(no_documents) == []


@pytest.mark.parametrize(("rows", "groups"), [(1, 1), (9, 1), (600, 2), (700, 600)])
def test_sizes_around_runs_and_spans(spark, rows, groups):
    docs = spark.createDataFrame([(k * 7 % 2000, f"Text {k}", None if k % groups == 0 else f"l{k % groups}", "s", k) for k in range(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    assert found(docs) == by_hand(docs.collect())


def test_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 1)
    monkeypatch.setattr(manifest, "SPAN", 8)
    docs = spark.createDataFrame([(k, f"Text {k}", "hot" if k % 10 else "cold", None, k) for k in range(700)], "doc_id long, text string, lang string, source string, n_chars long")
    assert found(docs) == by_hand(docs.collect())


def test_repeated_rows_are_leaves_each(spark):
    docs = spark.createDataFrame([(5, "Same", "en", "s", 4)] * 20 + [(6, "Other", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert found(docs) == by_hand(docs.collect())


def test_leaves_are_shuffled_once_by_span(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 1)
    monkeypatch.setattr(manifest, "SPAN", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = manifest.verified(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(group") == 2  # the leaves, and what is above each span


def test_sql_gives_the_same(spark):
    import duckdb

    connection = duckdb.connect()
    connection.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    rows = connection.execute(f"SELECT {COLUMNS} FROM ({queries.MANIFEST_SQL})").fetchall()
    assert sorted(rows, key=str) == found(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
