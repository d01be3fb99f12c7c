"""Merkle manifest of a data set: every row a leaf, runs of three hashed to their parent, one
tree per source and one over the sources' roots, and for every row the proof to the root.

The nodes of a tree are numbered in order. Within a block of 3^DEPTH leaves, which is a whole
subtree, a node of level l sits on the row of its first leaf, so its siblings are found 3^l
and 2 * 3^l rows before or behind it: lag and lead at fixed offsets, masked by the node's slot
in its run and by the run's length. First-child rows hash the parent. One shuffle by block
serves DEPTH levels; the roots of the blocks are the leaves of the next round. A source that
holds most rows is many blocks, and no task holds more than its blocks.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cdclake.llm.common import checkpointed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
DEPTH = 6
SPAN = FAN ** DEPTH
# Offsets of a manifest's parts are broadcast up to this number of rows of about 100 bytes.
BROADCAST_ROWS = 100_000


def digest(*parts):
    """Lowercase hexadecimal SHA-256 of texts put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(column):
    """`-` for NULL, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(**replaced):
    return digest(*[field(replaced.get(name, F.col(name))) for name in FIELDS])


def leaves(docs):
    """doc_id, tree, leaf and tampered of every row: the tree is the source, NULL before all
    others; `tampered` is the hash without line feeds of a row whose id has an even crc32, or
    NULL where that changes nothing."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = leaf_hash(text=F.regexp_replace("text", "\n", ""))
    return docs.select(*FIELDS).select(
        "doc_id", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("tree"),
        leaf_hash().alias("leaf"),
        F.when(even & F.contains("text", F.lit("\n")), cut).alias("tampered"))


def numbered(rows, order):
    """`rows` with `idx`, their place from 0 in their tree, and `size`, that tree's rows.

    Range cuts over (tree, order) and a draw, so that neither a large tree nor rows that are
    equal in all columns meet in one task; within a cut the place is the row's number, and
    counts per tree and cut add what lies before.
    """
    cut = (rows.withColumn("_draw", F.rand(13))
           .repartitionByRange("tree", *[F.col(c).asc_nulls_first() for c in order], "_draw")
           .sortWithinPartitions("tree", *[F.col(c).asc_nulls_first() for c in order])
           .drop("_draw").withColumn("_at", F.monotonically_increasing_id()))
    placed = checkpointed(cut).withColumn("_cut", F.shiftright("_at", 33))
    before = Window.partitionBy("tree").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    parts = checkpointed(
        placed.groupBy("tree", "_cut").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
        .select("tree", "_cut", "_first",
                F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                F.sum("_n").over(Window.partitionBy("tree")).alias("size")))
    small = parts.count() <= BROADCAST_ROWS
    return (placed.join(F.broadcast(parts) if small else parts, ["tree", "_cut"])
            .withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first"))
            .drop("_cut", "_at", "_first", "_before"))


def climbed(nodes):
    """Nodes (tree, idx, size, hash) with `block`, `path`, the (left, right) siblings of the
    node and of its ancestors within the block, and on the first row of a block its `top`."""
    block = Window.partitionBy("tree", "block").orderBy("idx")
    so_far = block.rowsBetween(Window.unboundedPreceding, 0)
    df = nodes.withColumns({"block": F.expr(f"idx div {SPAN}"), "top": F.col("hash")})
    own, nothing = F.col("top"), F.lit("")
    for level in range(DEPTH):
        step = FAN ** level
        count = F.expr(f"(size + {step - 1}) div {step}")
        slot = F.expr(f"idx div {step} % {FAN}")
        run = F.least(F.lit(FAN), count - F.expr(f"idx div {step * FAN} * {FAN}"))
        here, live = F.col("idx") % step == 0, count > 1
        df = df.withColumns({"b2": F.lag(own, 2 * step).over(block),
                             "b1": F.lag(own, step).over(block),
                             "a1": F.lead(own, step).over(block),
                             "a2": F.lead(own, 2 * step).over(block)})
        left = F.concat(F.when(slot > 1, F.col("b2")).otherwise(nothing),
                        F.when(slot > 0, F.col("b1")).otherwise(nothing))
        right = F.concat(F.when(slot + 1 < run, F.col("a1")).otherwise(nothing),
                         F.when(slot + 2 < run, F.col("a2")).otherwise(nothing))
        siblings = F.when(here & live, F.struct(left.alias("left"), right.alias("right")))
        parent = F.when(here & (slot == 0), digest(own, right))
        df = df.withColumns({f"s{level}": siblings, "top": F.when(live, parent).otherwise(own)})
        if level:  # the leaves of a node have its siblings
            df = df.withColumn(f"s{level}", F.last(f"s{level}", True).over(so_far))
    steps = [f"s{level}" for level in range(DEPTH)]
    return df.withColumn("path", F.filter(F.array(*steps), lambda s: s.isNotNull())).drop(
        "b2", "b1", "a1", "a2", *steps)


def rounds(nodes):
    """Node tables from the given one up to the roots, one per round; each is the roots of the
    blocks of the one before. The last has one row per tree."""
    tables = [nodes]
    while True:
        above = checkpointed(climbed(tables[-1]).where(F.col("idx") % SPAN == 0).select(
            "tree", F.expr(f"idx div {SPAN}").alias("idx"),
            F.expr(f"(size + {SPAN - 1}) div {SPAN}").alias("size"), F.col("top").alias("hash")))
        tables.append(above)
        if (above.agg(F.max("size")).head()[0] or 1) == 1:
            return tables


def with_trail(nodes, trail):
    """Climbed nodes joined with what lies above their block; both paths in one."""
    above = trail.select("tree", F.col("idx").alias("block"), F.col("path").alias("_above"),
                         "subroot")
    return (climbed(nodes).join(above, ["tree", "block"])
            .withColumn("path", F.concat("path", "_above")).drop("_above"))


def manifest(docs):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Leaves ascend by doc_id in their source, a NULL id first; rows of one id by their leaf, and
    rows equal in everything are leaves of their own with the same hash. A NULL source is a
    tree of its own, before all others; every other NULL is `-` in its leaf, an empty text is
    `0:`. A source of one row has its leaf as subroot, a table of one source has that subroot
    as root; a row alone has the SHA-256 of nothing as proof. Other columns play no part, and
    an empty table gives no rows. `folded_root` starts from the tampered leaf, where there is
    one, and never from the root. Every interim table is a checkpoint.
    """
    placed = numbered(checkpointed(leaves(docs)), ["doc_id", "leaf"])
    trees = rounds(placed.select("tree", "idx", "size", F.col("leaf").alias("hash")))
    roots = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
    forest = numbered(roots, ["name"])
    tables = rounds(forest.select("tree", "idx", "size", "hash"))
    root = (tables[-1].head() or {"hash": ""})["hash"]

    nothing = F.array().cast("array<struct<left: string, right: string>>")
    trail = tables[-1].select("tree", "idx", nothing.alias("path"), F.lit("").alias("subroot"))
    for nodes in reversed(tables[1:-1]):
        trail = checkpointed(with_trail(nodes, trail).select("tree", "idx", "path", "subroot"))
    trail = checkpointed(with_trail(forest, trail).select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("idx"), "path",
        F.col("hash").alias("subroot")))
    for nodes in reversed(trees[1:-1]):
        trail = checkpointed(with_trail(nodes, trail).select("tree", "idx", "path", "subroot"))
    leaf = placed.withColumn("hash", F.col("leaf"))
    proof = F.array_join(F.flatten(F.transform(
        "path", lambda s: F.array(s["left"], s["right"]))), "")
    folded = F.aggregate("path", F.coalesce("tampered", "leaf"),
                         lambda node, s: digest(s["left"], node, s["right"]))
    return (with_trail(leaf, trail)
            .select("doc_id", "leaf", "subroot", F.lit(root).alias("root"),
                    F.sha2(proof.cast("binary"), 256).alias("proof_sha256"),
                    folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def _field(name):
    value = f"CAST({name} AS VARCHAR)"
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(text):
    return f"sha256({' || '.join([_field(c) for c in FIELDS[:-1]])} || {_field(text)})"


def _siblings(table, keys):
    run = f"PARTITION BY {keys}lvl, idx // 3 ORDER BY idx"
    return f"""
    SELECT {keys}lvl, idx, coalesce(lag(h, 2) OVER ({run}), '')
             || coalesce(lag(h) OVER ({run}), '') AS l,
           coalesce(lead(h) OVER ({run}), '') || coalesce(lead(h, 2) OVER ({run}), '') AS r
    FROM {table} WHERE n > 1"""


def sql():
    return f"""
    WITH RECURSIVE bits(b, k, c) AS (
      SELECT i, 0, CAST(i AS UBIGINT) FROM range(256) t(i)
      UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
      FROM bits WHERE k < 8),
    walk(id, rest, c) AS (
      SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), CAST(4294967295 AS UBIGINT)
      FROM documents WHERE doc_id IS NOT NULL
      UNION ALL SELECT id, substr(rest, 2), xor(walk.c >> 8, bits.c)
      FROM walk JOIN bits ON k = 8 AND b = xor(walk.c, ord(rest)) & 255 WHERE rest <> ''),
    hashed AS (
      SELECT doc_id, coalesce('s' || source, '') AS tree, {_leaf('text')} AS leaf,
             CASE WHEN xor(c, 4294967295) % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")}
                  ELSE {_leaf('text')} END AS start
      FROM documents LEFT JOIN walk ON id = doc_id AND rest = ''),
    leaves AS (
      SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
             count(*) OVER (PARTITION BY tree) AS n FROM hashed),
    tree_nodes(tree, lvl, idx, n, h) AS (
      SELECT tree, 0, idx, n, leaf FROM leaves
      UNION ALL SELECT tree, lvl + 1, idx // 3, any_value((n + 2) // 3),
                       sha256(string_agg(h, '' ORDER BY idx))
      FROM tree_nodes WHERE n > 1 GROUP BY tree, lvl, idx // 3),
    subroots AS (
      SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx,
             count(*) OVER () AS n FROM tree_nodes WHERE n = 1),
    top_nodes(lvl, idx, n, h) AS (
      SELECT 0, idx, n, subroot FROM subroots
      UNION ALL SELECT lvl + 1, idx // 3, any_value((n + 2) // 3),
                       sha256(string_agg(h, '' ORDER BY idx))
      FROM top_nodes WHERE n > 1 GROUP BY lvl, idx // 3),
    tree_siblings AS ({_siblings('tree_nodes', 'tree, ')}),
    top_siblings AS ({_siblings('top_nodes', '')}),
    in_tree(doc_id, leaf, tree, lvl, idx, n, h, proof) AS (
      SELECT doc_id, leaf, tree, 0, idx, n, start, '' FROM leaves
      UNION ALL SELECT doc_id, leaf, tree, lvl + 1, idx // 3, (n + 2) // 3, sha256(l || h || r),
                       proof || l || r
      FROM in_tree JOIN tree_siblings USING (tree, lvl, idx)),
    at_top(doc_id, leaf, subroot, lvl, idx, n, h, proof) AS (
      SELECT doc_id, leaf, subroot, 0, s.idx, s.n, h, proof
      FROM in_tree i JOIN subroots s USING (tree) WHERE i.n = 1
      UNION ALL SELECT doc_id, leaf, subroot, lvl + 1, idx // 3, (n + 2) // 3,
                       sha256(l || h || r), proof || l || r
      FROM at_top JOIN top_siblings USING (lvl, idx))
    SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, a.h AS folded_root,
           a.h = t.h AS verified
    FROM at_top a CROSS JOIN (SELECT h FROM top_nodes WHERE n = 1) t WHERE a.n = 1"""
