"""The Merkle manifest against one built in plain Python: nulls, repeated ids and rows, negative and sparse ids, several blocks."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(x):
    return sha256(x.encode()).hexdigest()


def sized(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return h("".join(map(sized, (r.doc_id, r.source, r.lang, r.n_chars, text))))


def climb(nodes):
    """Levels of one tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in rows:
        text = r.text.translate(low) if r.text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 else r.text
        groups.setdefault(r.lang, []).append((r.doc_id, leaf(r, r.text), leaf(r, text)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[1] for x in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for g in names}
    over = climb([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (doc_id, own, node) in enumerate(sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            siblings = ""
            for at, levels in ((i, trees[g]), (k, over)):
                for nodes in levels[:-1]:
                    first, mine = at - at % 8, at % 8
                    run = nodes[first:first + 8]
                    siblings += "".join(run[:mine] + run[mine + 1:])
                    node = h("".join([*run[:mine], node, *run[mine + 1:]]))
                    at //= 8
            out.append((doc_id, own, trees[g][-1][0], over[-1][0], h(siblings), node, node == over[-1][0]))
    return out


def check(df):
    got = [tuple(r) for r in merkle.verify(df).select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    want = brute(df.select("doc_id", "text", "lang", "source", "n_chars").collect())
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def rows(n, groups=("en", "de", None)):
    return [(i * 37 - 900, [f"Text {i}", None, "", "ünÏ\n☃ A"][i % 4], groups[i % len(groups)], [None, "s"][i % 2], i if i % 5 else None) for i in range(n)]


@pytest.mark.parametrize("case", ["mixed", "one", "one_group", "many_groups", "sparse"])
def test_manifest_equals_brute_force(spark, case):
    data = {"mixed": rows(300), "one": rows(1), "one_group": rows(65, ("en",)), "many_groups": rows(90, [f"g{i}" for i in range(70)] + [None]),
            "sparse": [((i - 8) * (1 << 59), "T", "en", "s", 1) for i in range(16)]}[case]
    df = spark.createDataFrame(data, SCHEMA)
    for name in ("id", "leaf", "tree", "word", "mask", "slot", "n", "shown", "digest"):
        df = df.withColumn(name, F.lit("z"))
    check(df.repartition(5))


def test_repeated_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PIECE", 4)
    data = rows(40) + rows(40)[:12] + [(None, f"N{i}", "en", None, i) for i in range(20)] + [(None, "same", None, None, None)] * 11 + [(74, f"own {i}", "de", "s", 3) for i in range(9)] + [(74, "X" * 50_000, "de", "s", 3)] * 3
    check(spark.createDataFrame(data, SCHEMA).repartition(3))


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    check(spark.createDataFrame(rows(700), SCHEMA))


def test_empty_table(spark):
    assert merkle.verify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tampering_is_seen(spark):
    df = spark.createDataFrame([(i, f"Upper {i}" if i % 2 else f"lower {i}", "en", "s", 7) for i in range(50)], SCHEMA)
    for r in merkle.verify(df).collect():
        assert r.verified == (zlib.crc32(str(r.id).encode()) % 3 != 0 or r.id % 2 == 0)
