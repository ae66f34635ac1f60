"""A Merkle manifest of a dataset, kept as a log in postorder.

Rows are leaves; each group (language) is a tree over its leaves by ascending doc_id, and the groups' roots are the leaves
of one more tree. At every level runs of two nodes become one; a last run of one is hashed alone.

A builder takes an aligned run of up to 2^BITS neighbouring nodes and appends what it builds in the order in which nodes
are complete, which is postorder: a node stands after both its subtrees. Subtree sizes are known from the number of
leaves alone, so the place of any node is a closed form (`place`), and a sibling is read from the log without a search.
Builders of one tier work side by side; the roots of a tier are the nodes of the next, so 2^30 leaves take three tiers.
The largest group is split into builders like any other, and only digests are shuffled, never texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, join_hot, ordered

#: A builder takes up to 2^BITS nodes.
BITS = 10
#: The columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*fields: Column) -> Column:
    """H of the fields, each `-` if null, else its UTF-8 byte count, a colon and the value."""
    part = lambda x: F.coalesce(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[part(x) for x in fields]), 256)


def place(h: str, i: str, n: str) -> str:
    """SQL for the position, from 0, of node i of level h in the postorder log of a tree with n leaves.

    Before it stand all nodes of its levels and below up to its own last leaf, where the right edge may cut them short,
    and of each level above those that end before it: floor(i / 2) + floor(i / 4) + ... = i - bit_count(i).
    """
    i = f"({i})"
    whole = f"({i} + 1) * (shiftleft(2L, {h}) - 1)"
    edge = f"aggregate(sequence(0, {h}), 0L, (s, l) -> s + shiftright({n} + shiftleft(1L, l) - 1, l))"
    return f"(if(shiftleft({i} + 1, {h}) <= {n}, {whole}, {edge}) + {i} - bit_count({i}) - 1)"


_LEVELS = """aggregate(if(steps > 0, sequence(1, steps), cast(array() as array<int>)), array(nodes), (done, h) -> concat(done, array(
    transform(sequence(0, shiftright(size(element_at(done, -1)) - 1, 1)), k ->
      sha2(concat(get(element_at(done, -1), 2 * k), coalesce(get(element_at(done, -1), 2 * k + 1), '')), 256)))))"""
_LOG = f"transform(array_sort(flatten(transform(levels, (level, h) -> transform(level, (x, i) -> struct({place('h', 'cast(i as bigint)', 'c')} as p, x as x))))), s -> s.x)"
_SIBLING = f"get(log, cast({place('h', 'shiftright(k, h) ^ 1L', 'c')} as int))"
_PROOF = f"transform(if(steps > 0, sequence(0, steps - 1), cast(array() as array<int>)), h -> if(shiftleft(shiftright(k, h) ^ 1L, h) < c, {_SIBLING}, null))"
_NONE = "cast(array() as array<string>)"


def builders(nodes: DataFrame) -> DataFrame:
    """One tier: nodes (tree, i, node, n), n being the tree's nodes at this level, as a row for each builder.

    (tree, block, n, c, steps, log): c nodes taken, levels built above them, and what the builder appends, in postorder.
    """
    height = F.when(F.col("n") <= 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))
    taken = nodes.groupBy("tree", F.shiftright("i", BITS).alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "node"))).alias("nodes"))
    taken = taken.select("tree", "block", "n", F.size("nodes").cast("long").alias("c"), F.least(height, F.lit(BITS)).alias("steps"), F.col("nodes.node").alias("nodes"))
    return taken.withColumn("levels", F.expr(_LEVELS)).withColumn("log", F.expr(_LOG)).drop("nodes", "levels")


def tiers(leaves: DataFrame) -> list[DataFrame]:
    """The builders of every tier, bottom first; the last has one for each tree, whose log ends with the root."""
    done = [cut(builders(leaves))]
    while not done[-1].where(f"n > {1 << BITS}").isEmpty():
        last = done[-1]
        done.append(cut(builders(last.where(f"n > {1 << BITS}").select("tree", F.col("block").alias("i"), F.element_at("log", -1).alias("node"), F.expr(f"shiftright(n + {(1 << BITS) - 1}, {BITS})").alias("n")))))
    return done


def log(done: list[DataFrame]) -> DataFrame:
    """The whole log (tree, position, level, node) of trees whose tiers are done, each node once, at its place in postorder."""
    own = done[0].groupBy("tree").agg(F.max("n").alias("leaves"))
    parts = []
    for t, tier in enumerate(done):
        # The lowest nodes of a tier above the first are the roots that the tier below appended.
        rows = tier.join(own, "tree").withColumn("h", F.explode(F.expr("sequence(0, steps)"))).where(F.col("h") >= min(t, 1))
        rows = rows.withColumn("k", F.explode(F.expr("sequence(0L, shiftright(c + shiftleft(1L, h) - 1, h) - 1)")))
        rows = rows.select("tree", "leaves", (F.col("h") + t * BITS).alias("level"), F.expr(f"shiftleft(block, {BITS} - h) + k").alias("i"), F.expr(f"get(log, cast({place('h', 'k', 'c')} as int))").alias("node"))
        parts.append(rows.select("tree", F.expr(place("level", "i", "leaves")).alias("position"), "level", "node"))
    return reduce(DataFrame.union, parts)


def proofs(rows: DataFrame, done: list[DataFrame]) -> DataFrame:
    """rows (tree, i, ...) with `proof`, the siblings bottom up, null where a node is hashed alone, and `root`.

    Each row meets its builder's log and picks its siblings by position; what stands above a builder is found once for
    the builder. Only rows and logs are shuffled, not proofs.
    """
    above = None
    for t in reversed(range(len(done))):
        tier = done[t].select("tree", "block", "c", "steps", "log", F.element_at("log", -1).alias("own"))
        tier = tier.join(above, ["tree", "block"], "left") if above is not None else tier.withColumns({"above": F.expr(_NONE), "top": F.lit(None).cast("string")})
        takers = rows if t == 0 else done[t - 1].where(f"n > {1 << BITS}").select("tree", F.col("block").alias("i"))
        takers = takers.withColumns({"block": F.shiftright("i", BITS), "k": F.col("i").bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))})
        found = takers.join(tier, ["tree", "block"]).withColumns({"proof": F.concat(F.expr(_PROOF), F.coalesce("above", F.expr(_NONE))), "root": F.coalesce("top", "own")})
        above = found.select("tree", F.col("i").alias("block"), F.col("proof").alias("above"), F.col("root").alias("top"))
    return found.select(*rows.columns, "proof", "root")


def folded(node: str, at: str, proof: str) -> Column:
    """The root that follows from a node at place `at` among the leaves and its siblings, all names of columns."""
    pair = f"if(shiftright({at}, s.h) & 1 = 0, concat(y, s.x), concat(s.x, y))"
    steps = f"zip_with({proof}, sequence(0, size({proof})), (x, h) -> struct(h as h, x as x))"
    return F.expr(f"aggregate({steps}, {node}, (y, s) -> if(s.h >= size({proof}), y, sha2(if(s.x is null, y, {pair}), 256)))")


@dataclass
class Manifest:
    """leaves: (doc_id, tree, i, leaf, shown), one row for each of docs; trees, top: tiers of the groups and of their roots; groups: (tree, t, subroot)."""

    leaves: DataFrame
    trees: list[DataFrame]
    top: list[DataFrame]
    groups: DataFrame


def build(docs: DataFrame, group: str = "lang", shown: Column | None = None) -> Manifest:
    """The manifest of docs, one leaf for each row; a tree for each value of `group`, null being the first.

    Leaves ascend by doc_id, null first, then by digest, so repeated rows and ties have a defined order. shown: the digest
    that a row shows when it is verified (its own if not given); it is computed in the one pass that reads texts. Columns
    other than FIELDS and group aren't read, whatever their names. An empty table gives no trees.
    """
    doc_id = F.col("doc_id").cast("long")
    leaf = leaf_digest(*[doc_id if x == "doc_id" else F.col(x) for x in FIELDS])
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # null comes before any value
    digests = cut(docs.select(doc_id.alias("doc_id"), tree.alias("tree"), leaf.alias("leaf"), (leaf if shown is None else F.coalesce(shown, leaf)).alias("shown")))
    rows = ordered(digests, "at", "tree", "doc_id", "leaf")
    groups = cut(rows.groupBy("tree").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    number = groups.count()
    leaves = join_hot(rows, groups, "tree", F.xxhash64("doc_id", "leaf"), number).select("doc_id", "tree", (F.col("at") - F.col("first")).alias("i"), "leaf", "shown", "n")
    trees = tiers(leaves.select("tree", "i", F.col("leaf").alias("node"), "n"))
    roots = trees[0].where(f"n <= {1 << BITS}")
    for k, tier in enumerate(trees[1:], 1):
        roots = roots.union(tier.where(f"n <= {1 << BITS}"))
    roots = ordered(cut(roots.select("tree", F.element_at("log", -1).alias("subroot"))), "t", "tree")
    top = tiers(roots.select(F.lit("").alias("tree"), F.col("t").alias("i"), F.col("subroot").alias("node"), F.lit(number).cast("long").alias("n")))
    return Manifest(leaves.drop("n"), trees, top, roots)


def verify(manifest: Manifest) -> DataFrame:
    """Every leaf as (doc_id, leaf, subroot, root, proof array<string>, proof_sha256, folded_root, verified).

    The proof is read from the log by position; folded_root is what follows from the digest that the row shows.
    """
    above = proofs(manifest.groups.select(F.lit("").alias("tree"), F.col("t").alias("i"), F.col("tree").alias("group"), "subroot"), manifest.top)
    groups = cut(above.select(F.col("group").alias("tree"), F.col("i").alias("t"), F.col("proof").alias("above"), F.col("root").alias("whole")))
    rows = proofs(manifest.leaves, manifest.trees).withColumnsRenamed({"proof": "below", "root": "subroot"})
    rows = join_hot(rows, groups, "tree", F.col("i"), groups.count()).withColumnRenamed("whole", "root")
    rows = rows.withColumn("folded_root", folded("shown", "i", "below")).withColumn("folded_root", folded("folded_root", "t", "above"))
    proof = F.concat("below", "above")
    return rows.select("doc_id", "leaf", "subroot", "root", F.filter(proof, lambda x: x.isNotNull()).alias("proof"), F.sha2(F.array_join(proof, ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
