"""A Merkle manifest of a table, with a proof for each row.

Leaves are hashed where rows are read and numbered within their group by one range shuffle. Each level is an aggregate:
conditional aggregates spread the children of a parent into fanout columns (the slot pivot), the concatenated columns are
hashed to the parent's digest, and leaving out a child's own column gives its siblings. Levels are written, each an eighth of the one
below. Proofs come from the top down: a node's path is its parent's with its own siblings in front. Everything is a
column expression; no group, however large, meets in a task, as a key has at most eight rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeflow.llm.common import id_bucket, materialize, shuffle_partitions, table

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NO_PATH = "CAST(array() AS array<struct<before: string, after: string>>)"


def digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the concatenated texts."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, group, digest, tampered) of each row; `tampered` is the digest with A-Z of the text lower-cased where the
    condition holds, else null. The group is `-` for a null lang, else `=` and the lang, so it sorts null first, then bytewise."""
    of = {c: F.col(c) for c in FIELDS}
    changed = digest(*(framed(lower_ascii(of[c]) if c == "text" else of[c]) for c in FIELDS))
    lang = F.col("lang").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(lang.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), lang)).alias("group"),
        digest(*map(framed, of.values())).alias("digest"),
        F.when(F.lit(False) if tampered is None else tampered, changed).alias("tampered"),
    )


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with `idx`, their place in their group by `order`, and `size`, the group's rows. Ties are numbered as they were read.

    A range shuffle sorts all rows; within a partition the place is what the running id says, and counts of
    (partition, group), a row for each task and group in it, give what comes before.
    """
    rows = materialize(rows, "merkle-rows")  # the shuffle reads twice, to sample and to deal out
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), "group", *order, "tie").sortWithinPartitions("group", *order, "tie")
    dealt = materialize(dealt.drop("tie").withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    counts = dealt.groupBy("part", "group").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("group")
    before = F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("part", "group", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(group).alias("size"))
    counts = materialize(counts, "merkle-counts")  # of known size when it is joined
    placed = dealt.join(counts, ["part", "group"]).withColumn("idx", F.col("before") + F.col("at") - F.col("first"))
    return placed.drop("part", "at", "first", "before")


@dataclass
class Tree:
    """A tree for each group. `levels[k]` has the parents of level k's nodes: group, idx, size, digest, c0 to c7 (structs of
    a child's digest and, on the lowest level, its other columns); `roots` has group, level and digest."""

    nodes: DataFrame
    levels: list[DataFrame]
    roots: DataFrame
    carried: tuple[str, ...]


def build(nodes: DataFrame, *carried: str) -> Tree:
    """Trees over nodes (group, idx, size, digest, and columns that the lowest level carries), level by level:
    as many jobs as the largest group has levels."""
    nodes = materialize(nodes.select("group", "idx", "size", "digest", *carried), "merkle-nodes")
    most = nodes.agg(F.max("size")).first()[0] or 0
    levels: list[DataFrame] = []
    roots = nodes.filter("size = 1").select("group", F.lit(0).alias("level"), "digest")
    below = nodes
    while most > 1:
        child = F.struct("digest", *(() if levels else carried))
        slots = [F.max(F.when(F.col("idx") % FANOUT == k, child)).alias(f"c{k}") for k in range(FANOUT)]
        parent, parents = F.expr(f"idx DIV {FANOUT}").alias("parent"), F.expr(f"(size + {FANOUT - 1}) DIV {FANOUT}").alias("parents")
        pivot = below.filter("size > 1").groupBy("group", parent, parents).agg(*slots)
        pivot = pivot.select("group", F.col("parent").alias("idx"), F.col("parents").alias("size"), digest(*map(_of, range(FANOUT))).alias("digest"), *(f"c{k}" for k in range(FANOUT)))
        below = materialize(pivot, f"merkle-level-{len(levels) + 1}")
        levels.append(below)
        roots = roots.unionByName(below.filter("size = 1").select("group", F.lit(len(levels)).alias("level"), "digest"))
        most = -(-most // FANOUT)
    return Tree(nodes, levels, roots, carried)


def _of(k: int) -> Column:
    return F.coalesce(F.col(f"c{k}")["digest"], F.lit(""))


def descend(tree: Tree, tops: DataFrame) -> DataFrame:
    """The lowest nodes (group, idx, digest, carried columns) with `path`, (before, after) of each level from the node to the
    top, and the other columns of `tops`. `tops` has a group's root with its level and the path above it."""
    more = [c for c in tops.columns if c not in ("group", "level", "path")]
    at = None
    for level in range(len(tree.levels), 0, -1):
        here = tops.filter(F.col("level") == level).select("group", F.lit(0).cast("long").alias("idx"), "path", *more)
        here = here if at is None else at.unionByName(here)
        kept = ["digest", *(tree.carried if level == 1 else ())]
        children = []
        for k in range(FANOUT):
            before = F.concat(*(_of(j) for j in range(k))) if k else F.lit("")
            after = F.concat(*(_of(j) for j in range(k + 1, FANOUT))) if k < FANOUT - 1 else F.lit("")
            own = [F.col(f"c{k}")[c].alias(c) for c in kept]
            children.append(F.when(F.col(f"c{k}").isNotNull(), F.struct((F.col("idx") * FANOUT + k).alias("idx"), *own, F.struct(before.alias("before"), after.alias("after")).alias("siblings"))))
        pairs = here.join(tree.levels[level - 1].drop("digest", "size"), ["group", "idx"])
        out = pairs.select("group", "path", *more, F.inline(F.array_compact(F.array(*children))))
        path = F.concat(F.array("siblings"), F.col("path")).alias("path")
        at = out.select("group", "idx", *(kept if level == 1 else ()), path, *more)
    lone = tree.nodes.filter("size = 1").select("group", "idx", "digest", *tree.carried).join(tops.filter("level = 0").drop("level"), "group")
    return lone if at is None else at.unionByName(lone.select(*at.columns))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda acc, s: digest(s["before"], acc, s["after"]))


def prove(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, tampered, subroot, root, path) of each row of `docs` (doc_id, source, lang, n_chars, text).

    A subtree for each lang has its leaves by doc_id (null first), rows of equal ids by digest; the subroots, null lang
    first, then bytewise, make the upper tree in the same way. A lang with one row has its leaf as subroot, a table with one
    lang its subroot as root. Nulls are `-`, an empty value `0:`. Repeated rows are leaves of their own. Other columns are
    ignored. An empty table gives no rows.
    """
    lower = build(numbered(leaves(docs, tampered), "doc_id", "digest"), "doc_id", "tampered")
    roots = materialize(lower.roots, "merkle-subroots")
    subroots = roots.select(F.lit("").alias("group"), F.col("group").alias("lang"), F.col("level").alias("height"), "digest")
    upper = build(numbered(subroots, "lang"), "lang", "height")
    tops = upper.roots.select("group", "level", F.expr(_NO_PATH).alias("path"), F.col("digest").alias("root"))
    above = descend(upper, tops).select(F.col("lang").alias("group"), F.col("height").alias("level"), "path", "root", F.col("digest").alias("subroot"))
    found = descend(lower, materialize(above, "merkle-upper"))
    return found.select("doc_id", F.col("digest").alias("leaf"), "tampered", "subroot", "root", "path")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = prove(table(spark, sf_dir, "documents"), id_bucket(F.col("doc_id"), 3) == 0)
    siblings = F.transform("path", lambda s: F.concat(s["before"], s["after"]))
    proofs = proofs.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE = """
WITH RECURSIVE framed AS (
  SELECT doc_id, lang, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS grp, text,
         coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents),
leafs AS (
  SELECT doc_id, grp, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS lowered
  FROM framed),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leafs),
lower_tree AS (
  SELECT 0 AS lvl, grp, idx, leaf AS h FROM placed
  UNION ALL
  SELECT min(lvl) + 1, grp, idx // 8, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM lower_tree) WHERE n > 1 GROUP BY grp, idx // 8),
subroots AS (SELECT grp, arg_max(h, lvl) AS subroot, max(lvl) AS top, row_number() OVER (ORDER BY encode(grp)) - 1 AS idx FROM lower_tree GROUP BY grp),
upper_tree AS (
  SELECT 0 AS lvl, idx, subroot AS h FROM subroots
  UNION ALL
  SELECT min(lvl) + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER () AS n FROM upper_tree) WHERE n > 1 GROUP BY idx // 8),
whole AS (SELECT arg_max(h, lvl) AS root, max(lvl) AS top FROM upper_tree),
own AS (
  SELECT p.doc_id, p.idx AS leaf_idx, p.grp, p.leaf, p.lowered, s.subroot, w.root, l.lvl,
         CASE WHEN l.lvl < s.top THEN p.idx // CAST(pow(8, l.lvl) AS BIGINT) ELSE s.idx // CAST(pow(8, l.lvl - s.top) AS BIGINT) END AS node, l.lvl >= s.top AS high
  FROM placed p JOIN subroots s USING (grp) CROSS JOIN whole w CROSS JOIN range(0, 40) l(lvl) WHERE l.lvl < s.top + w.top),
crc32_of AS (
  SELECT DISTINCT doc_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
         lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS c
  FROM documents),
path AS (
  SELECT o.grp, o.leaf_idx, o.lvl, coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (WHERE n.idx < o.node), '') AS bef,
         coalesce(string_agg(n.h, '' ORDER BY n.idx) FILTER (WHERE n.idx > o.node), '') AS aft
  FROM own o JOIN subroots s USING (grp)
  JOIN (SELECT lvl, grp, idx, h, false AS high FROM lower_tree
        UNION ALL SELECT s.top + u.lvl, s.grp, u.idx, u.h, true FROM subroots s CROSS JOIN upper_tree u) n
    ON n.grp = o.grp AND n.lvl = o.lvl AND n.high = o.high AND n.idx // 8 = o.node // 8
  GROUP BY o.grp, o.leaf_idx, o.lvl),
ready AS (
  SELECT p.*, s.subroot, w.root, s.top + w.top AS levels, crc32_of.c % 3 = 0 AS changed
  FROM placed p JOIN subroots s USING (grp) CROSS JOIN whole w JOIN crc32_of USING (doc_id)),
folded AS (
  SELECT grp, idx, 0 AS lvl, levels, CASE WHEN changed THEN lowered ELSE leaf END AS acc FROM ready
  UNION ALL
  SELECT f.grp, f.idx, f.lvl + 1, f.levels, sha256(p.bef || f.acc || p.aft)
  FROM folded f JOIN path p ON p.grp = f.grp AND p.leaf_idx = f.idx AND p.lvl = f.lvl WHERE f.lvl < f.levels)
SELECT r.doc_id, r.leaf, r.subroot, r.root,
       sha256(coalesce((SELECT string_agg(p.bef || p.aft, '' ORDER BY p.lvl) FROM path p WHERE p.grp = r.grp AND p.leaf_idx = r.idx), '')) AS proof_sha256,
       f.acc AS folded_root, f.acc = r.root AS verified
FROM ready r JOIN folded f ON f.grp = r.grp AND f.idx = r.idx AND f.lvl = r.levels
"""
