import random
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfcheck.llm import merkle, sql

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """(root, witness of each leaf), by building whole levels."""
    witnesses, level, place = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(place):
            run = p // 8 * 8
            witnesses[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + 8])))
        level = [h(level[i : i + 8]) for i in range(0, len(level), 8)]
        place = [p // 8 for p in place]
    return level[0], witnesses


def plain(rows):
    """{(group, order, leaf): [(witness, subroot, root)]} of (group, order, leaf)."""
    groups = sorted({r[0] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in groups:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        trees[g] = (mine, *plain_tree([r[2] for r in mine]))
    root, tops = plain_tree([trees[g][1] for g in groups])
    out = {}
    for g, top in zip(groups, tops):
        for r, w in zip(trees[g][0], trees[g][2]):
            out.setdefault(r, []).append((w + top, trees[g][1], root))
    return out


def made(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "grp string, number long, digest string, witness string")
    out = {}
    for r in merkle.manifest(df, "grp", "number", "digest").collect():
        out.setdefault((r.grp, r.number, r.digest), []).append(([tuple(w) for w in r.witness], r.subroot, r.root))
    return out


@pytest.mark.parametrize("levels", [1, 4])
def test_equals_whole_levels(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    sizes = {None: 3, "": 1, "a": 8, "b": 9, "é": 64, "z": 65, "zz": 600} | {f"g{i}": 2 for i in range(10)}
    rows = [(g, i if i % 50 else None, h([str((g, i))])) for g, n in sizes.items() for i in range(n)]
    rows += [("zz", 5, "same")] * 20  # repeated rows
    random.Random(1).shuffle(rows)
    got, want = made(spark, rows), plain(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("rows", [[], [("a", 1, "x")], [(None, None, "x")], [("a", 1, "x"), ("b", 1, "y")]])
def test_few_rows(spark, rows):
    assert made(spark, rows) == plain(rows) if rows else made(spark, rows) == {}


def test_witness_grows_as_runs_close():
    block = merkle.Appender(2)
    for i in range(9):
        block.append(str(i))
    assert [len(w) for w in block.witnesses] == [1] * 8 + [0]
    assert block.witnesses[3] == [("012", "4567")]
    for i in range(9, 64):
        block.append(str(i))
    assert [len(w) for w in block.witnesses] == [2] * 64
    assert block.finish() == plain_tree([str(i) for i in range(64)])[0]


def test_query_equals_sql(spark, tmp_path):
    from shelfcheck.llm.queries import op12_merkle_manifest

    rng = random.Random(4)
    rows = [(i, rng.choice(["Ab É ", "x", None, "", "long text A " * 20_000]), rng.choice(["en", None, "de", "é"]), rng.choice(["s", None, ""]), rng.choice([3, None])) for i in range(90)]
    rows += [rows[5], rows[5], (7, "other", "en", "s", 1), (None, "No id", "en", "s", 1)]
    spark.createDataFrame(rows, KIND).withColumn("leaf", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    found = op12_merkle_manifest(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(found.columns)} from ({sql.MERKLE})").fetchall()
    key = lambda r: [(v is None, v) for v in r]
    got = [tuple(r) for r in found.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    broken = {r[0] for r in got if not r[-1]}
    assert broken and all(merkle.sha256 and r[0] in broken or r[5] == r[3] for r in got)


def test_forms_of_fields_differ(spark):
    rows = [(None, "a"), ("", "a"), ("-", "a"), ("a", ""), ("1:a", ""), ("", "1:a"), ("a", None)]
    got = spark.createDataFrame(rows, "a string, b string").select(merkle.leaf([F.col("a"), F.col("b")]).alias("leaf")).collect()
    assert len({r.leaf for r in got}) == len(rows)
    assert got[1].leaf == h(["0:", "1:a"])
