"""A Merkle manifest of a dataset: digests of rows, a tree for each language, one root, and a proof for each row.

The build goes bottom-up: nodes of a level are dealt out in runs of neighbours, each run is reduced to one node of a higher
level, and the runs are written. The proofs go top-down: each written level is joined with the proofs of the nodes that
its runs became, and every child puts its own siblings before the proof that it inherits. A run holds as many nodes as
STEP levels of pairs reduce to one, so a tree of n leaves takes log(n) / STEP rounds and its nodes are shuffled little more
than once. The position of a leaf comes from totals of range partitions; no language is gathered anywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestrata.llm.common import release, save, table

#: Levels of pairs in a run.
STEP = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A sibling: what stands left and right of the node when both are hashed; both are empty for a node without one.
SIBLING = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 bytes of the value, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered): the digest of each row, and of the row with 1 added to n_chars where 7 divides the
    crc32 of its id (null elsewhere)."""
    of = lambda n_chars: digest(*[field(n_chars if c == "n_chars" else F.col(c)) for c in FIELDS])
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        of(F.col("n_chars")).alias("leaf"),
        F.when(hit, of(F.col("n_chars").cast("decimal(20,0)") + 1)).alias("tampered"),
    )


def placed(rows: DataFrame, group: str | None, order: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """rows with `i` (place in its group, from 0) and `n` (rows of the group), and the steps written for it: totals of range
    partitions give the places.

    Rows that are alike in group and order stand in the order in which they are read, so any number of them can be split.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("_g", F.col(group) if group else F.lit(None).cast("string")).withColumn("_t", F.monotonically_increasing_id())
    order = [*order, "_t"]
    keys = ["_g", *order]
    dealt = save(keyed.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), "dealt")
    totals = dealt.groupBy("_g", "_part").agg(F.count("*").alias("_n"))  # partitions and groups, not rows
    mine = W.partitionBy("_g")
    totals = save(
        totals.select(
            "_g", "_part",
            F.coalesce(F.sum("_n").over(mine.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
            F.sum("_n").over(mine).alias("n"),
        ), "totals",
    )
    numbered = dealt.withColumn("_r", F.row_number().over(W.partitionBy("_part", "_g").orderBy(*order)))
    joined = numbered.alias("a").join(totals.alias("b"), (F.col("a._part") == F.col("b._part")) & F.col("a._g").eqNullSafe(F.col("b._g")))
    return joined.select(*[F.col(f"a.{c}") for c in rows.columns], (F.col("b._before") + F.col("a._r") - 1).alias("i"), F.col("b.n").alias("n")), [dealt, totals]


def _halved(nodes: Column) -> Column:
    """The level above an array of neighbours: the digest of each two, or of a last one alone."""
    return F.transform(F.sequence(F.lit(0), (F.size(nodes) - 1).bitwiseAND(-2), F.lit(2)), lambda k: digest(F.get(nodes, k), F.coalesce(F.get(nodes, k + 1), F.lit(""))))


def _levels(n: Column) -> Column:
    """Levels of pairs until n nodes are one."""
    return F.length(F.bin(n - 1)) * (n > 1).cast("int")


def build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """nodes: (tree, i, n, node, of): digests with their place in a tree of n, and what else is to be kept of them.

    Returns the written levels, the lowest first, each with a row (tree, i, n, kids, levels, l1, l2, ...) for a run of
    neighbours: kids are structs (node, of), levels how many levels of pairs the run takes, l1 and so on what these make of
    the kids; and the roots (tree, root).
    """
    written, width, top = [], 1 << STEP, F.get(f"l{STEP}", F.lit(0))
    level, nothing = nodes, F.lit(None).cast(nodes.schema["of"].dataType).alias("of")
    while True:
        runs = level.groupBy("tree", F.shiftright("i", STEP).alias("i"), "n").agg(F.sort_array(F.collect_list(F.struct("i", "node", "of"))).alias("kids"))
        runs = runs.select("tree", "i", "n", F.transform("kids", lambda k: F.struct(k["node"].alias("node"), k["of"].alias("of"))).alias("kids"), F.least(F.lit(STEP), _levels(F.col("n"))).alias("levels"))
        below = F.transform("kids", lambda k: k["node"])
        for k in range(1, STEP + 1):
            runs = runs.withColumn(f"l{k}", F.when(F.col("levels") >= k, _halved(below)).otherwise(below))
            below = F.col(f"l{k}")
        written.append(save(runs, "runs"))
        level = written[-1].where(F.col("n") > width).select("tree", "i", F.shiftright(F.col("n") + (width - 1), STEP).alias("n"), top.alias("node"), nothing)
        if level.isEmpty():
            break
    roots = [runs.where(F.col("n") <= width).select("tree", top.alias("root")) for runs in written]
    return written, save(reduce(DataFrame.unionByName, roots), "roots")


def push(written: list[DataFrame], proofs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, i, node, of, proof) of each lowest node, and the steps written for it. proofs: (tree, proof) of the roots.

    From the top level down, a run takes the proof of the node that it became, and each kid puts its siblings before it.
    """
    inherited, steps, whole = None, [], F.col("n") <= 1 << STEP
    for runs in reversed(written):
        heirs = runs.where(whole).join(proofs, "tree")
        if inherited is not None:
            heirs = heirs.unionByName(runs.where(~whole).join(inherited, ["tree", "i"]))
        kids = heirs.select("*", F.posexplode("kids").alias("at", "kid"))
        siblings = []
        for k in range(STEP):
            place, node = F.shiftright("at", k), lambda p, k=k: F.get(f"l{k}", p) if k else F.get("kids", p)["node"]
            left = F.when(place % 2 == 1, node(place - 1)).otherwise("")
            right = F.when(place % 2 == 0, F.coalesce(node(place + 1), F.lit(""))).otherwise("")
            siblings.append(F.struct(left.alias("left"), right.alias("right")))
        proof = F.concat(F.slice(F.array(*siblings).cast(SIBLING), F.lit(1), F.col("levels")), "proof")
        kids = kids.select("tree", (F.shiftleft("i", STEP) + F.col("at")).alias("i"), F.col("kid.node").alias("node"), F.col("kid.of").alias("of"), proof.alias("proof"))
        if runs is not written[0]:
            inherited = save(kids.select("tree", "i", "proof"), "proofs")
            steps.append(inherited)
    return kids, steps


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, tampered, folded_root, verified) of each row of docs (doc_id, source, lang, n_chars, text).

    proof: the siblings from the leaf to the root. Rows of one doc_id stand in the order of their digests, those without one
    first; rows that are alike in all fields are leaves each. Rows without a language have a tree of their own, the first.
    An empty table gives no rows. Other columns are ignored.
    """
    rows, dealt = placed(leaves(docs), "lang", ["doc_id", "leaf"])
    first, ordered = placed(rows.where("i = 0").select("lang"), None, ["lang"])
    trees = save(first.select("lang", F.col("i").alias("tree"), F.col("n").alias("trees")), "trees")
    named = rows.alias("r").join(trees.alias("t"), F.col("r.lang").eqNullSafe(F.col("t.lang")))
    of = F.struct("r.doc_id", "r.tampered").alias("of")
    low, subroots = build(named.select("t.tree", "r.i", "r.n", F.col("r.leaf").alias("node"), of))
    release(*dealt, *ordered)
    tops = subroots.join(trees, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.col("trees").alias("n"), F.col("root").alias("node"), F.lit(None).cast("string").alias("of"))
    high, roots = build(tops)
    root = roots.select(F.max("root")).first()[0]
    tops, steps = push(high, roots.select("tree", F.expr(f"cast(array() as {SIBLING})").alias("proof")))
    above = save(tops.select(F.col("i").alias("tree"), F.col("node").alias("subroot"), "proof"), "above")
    release(*steps, *high, subroots, roots, trees)
    below, _ = push(low, above.select("tree", "proof"))
    out = below.join(above.select("tree", "subroot"), "tree")
    out = out.select("of.doc_id", F.col("node").alias("leaf"), "subroot", F.lit(root).alias("root"), "proof", "of.tampered")
    out = out.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    proof = F.sha2(F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    return manifest(table(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")
