"""The Merkle manifest against a plain tree in memory."""

import hashlib
import zlib

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from namesieve.llm import catalog, merkle_manifest

SF = "/root/testdata/sf0.001"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(leaves):
    """Rows (id, group, node, claim) to (id, leaf, subroot, root, proof_sha256, folded_root, verified, proof)."""

    def climb(nodes):
        paths, level = [[] for _ in nodes], nodes
        width = 1
        while len(level) > 1:
            for i in range(len(nodes)):
                at = i // width
                run = level[at // 16 * 16 : at // 16 * 16 + 16]
                paths[i].append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
            level = [h("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
            width *= 16
        return level[0], paths

    groups = {}
    for row in sorted(leaves, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {g: climb([r[2] for r in groups[g]]) for g in names}
    root, upper = climb([tops[g][0] for g in names]) if names else (None, [])
    out = []
    for g, above in zip(names, upper):
        for row, path in zip(groups[g], tops[g][1]):
            folded, proof = row[3], ""
            for left, right in path + above:
                folded, proof = h(left + folded + right), proof + left + right
            out.append((row[0], row[2], tops[g][0], root, h(proof), folded, folded == root, proof))
    return sorted(out, key=repr)


def verified(spark, leaves, **options):
    rows = spark.createDataFrame(leaves, "id long, group string, node string, claim string")
    return sorted((tuple(r) for r in merkle_manifest.verify(rows, **options).collect()), key=repr)


def test_superblocks_of_one_group_many_groups_nulls_and_repeats(spark):
    leaves = [(i, "large", h(f"{i}"), h(f"{i}")) for i in range(2 * merkle_manifest.SUPER + 3)]
    leaves += [(i, g, h(f"{g}{i}"), h(f"{g}{i}" if i % 3 else "else")) for g in (None, "", "é", "Z", "zz") for i in range(20)]
    leaves += [(7, f"one{k}", h("one"), h("one")) for k in range(40)]
    leaves += [(None, "ids", h("x"), h("x")), (None, "ids", h("w"), h("y")), (1, "ids", h("x"), h("x")), (1, "ids", h("x"), h("x"))]
    assert verified(spark, leaves, with_proof=True) == plain(leaves)


def test_lone_leaf_and_empty_table(spark):
    assert verified(spark, [(5, "a", h("a"), h("a"))], with_proof=True) == [(5, h("a"), h("a"), h("a"), h(""), h("a"), True, "")]
    assert verified(spark, []) == []


def test_fields_nulls_and_clashing_columns(spark):
    rows = [(1, None, "é", 2, "node"), (2, "", None, None, "claim")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, at int, node string")
    found = merkle_manifest.manifest(docs, ["doc_id", "source", "text"], "doc_id", "source", {"text": F.lit("t")})
    expected = {1: ("1:1-2:é", "1:1-1:t"), 2: ("1:20:-", "1:20:1:t")}
    assert {r.id: (r.node, r.claim) for r in found.collect()} == {k: (h(a), h(b)) for k, (a, b) in expected.items()}


def test_query_equals_plain_tree(spark):
    leaves = []
    for r in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        text = r["text"]
        struck = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if struck and text is not None else text

        def code(value):
            return "-" if value is None else f"{len(str(value).encode())}:{value}"

        node, claim = (h("".join(map(code, (r["doc_id"], r["source"], r["lang"], r["n_chars"], t)))) for t in (text, low))
        leaves.append((r["doc_id"], r["source"], node, claim))
    got = sorted((tuple(r) for r in catalog.op12_merkle_manifest(spark, SF).collect()), key=repr)
    assert got == sorted((r[:-1] for r in plain(leaves)), key=repr)
    assert 0 < sum(not r[-1] for r in got) < len(got)
