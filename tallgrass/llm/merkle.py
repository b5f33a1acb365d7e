"""Merkle manifest of a dataset: a leaf for each row, a tree for each source, and a tree over the sources' roots.

H is the lowercase hex sha256 of its inputs put together, digests as hex text. A leaf is H of the row's fields, each `-` if
null, else its UTF-8 byte count, `:` and its value. Within a source leaves stand in order of doc_id (null last, equal ones by
leaf); runs of `FAN` become their H, level by level, until one node is left, the source's root. The sources' roots (null first,
then bytewise) make the dataset's root in the same way. A row's proof is, for each level, what stands left and right of its node
in its run; folding a leaf with it must give the root.

Leaves are made in the scan and written once, narrow. Ranges of (source, doc_id) are dealt to tasks and numbered, so that a
source may hold any share of the rows. Blocks of FAN ** LEVELS consecutive leaves of a source are then reduced, each in one
row of a grouping: one shuffle of digests for LEVELS levels. Where at most `TOP_NODES` block roots are left, the driver builds
the tree above them and the paths from each of them to the root are broadcast: at most TOP_NODES x levels x FAN digests. While
more are left, their blocks are reduced in the same distributed way, and paths meet them in a join; thus the driver
holds no more however many rows or sources there are. Proofs are put together and folded in the executors, row by row.

Null and empty fields are told apart by their encoding; a very long text is hashed where it is read and goes no further. Rows
that repeat are leaves of their own, one after the other. An empty table has no rows and no root. Further columns are not part
of a leaf; those that are to be kept are named in `keep`, and own columns step aside where a name clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.common import LOWER, UPPER, ascii_lower, bounded, documents, fresh, materialise
from tallgrass.llm.mixing import numbered

FAN = 16
LEVELS = 3
#: Nodes that the driver takes and paths that are broadcast.
TOP_NODES = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def leaf(*fields: Column) -> Column:
    """H of a row's fields."""
    coded = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*coded), 256)


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its path give."""
    return F.aggregate(path, node, lambda a, s: F.sha2(F.concat(s["left"], a, s["right"]), 256))


def siblings(path: Column) -> Column:
    """H of a path's siblings, from the lowest level up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _blocks(nodes: DataFrame, fan: int, levels: int, *keep: str) -> DataFrame:
    """Nodes (tree, pos, digest, size, keep) as one row for each block of consecutive ones; written."""
    members = F.array_sort(F.collect_list(F.struct("pos", "digest", *keep)))  # at most fan ** levels
    block = nodes.groupBy("tree", F.expr(f"pos div {fan**levels}").alias("block"))
    return materialise(block.agg(members.alias("m"), F.first("size").alias("size")), "blocks")


def _reduced(blocks: DataFrame, fan: int, levels: int) -> DataFrame:
    """blocks with their levels' runs r0, r1, ..., how many of these levels there are, and the root above them."""
    runs = lambda nodes: F.expr(f"transform(sequence(0, cast((size({nodes}) - 1) div {fan} as int)), k -> slice({nodes}, k * {fan} + 1, {fan}))")
    out = blocks.withColumn("n0", F.col("m.digest"))
    for k in range(levels):
        out = out.withColumn(f"r{k}", runs(f"n{k}")).withColumn(f"n{k + 1}", F.transform(f"r{k}", lambda x: F.sha2(F.array_join(x, ""), 256)))
    steps = F.lit(levels)
    for k in reversed(range(levels)):
        steps = F.when(F.col("size") <= fan**k, k).otherwise(steps)
    root = F.element_at(F.array(*[F.col(f"n{k}")[0] for k in range(levels + 1)]), F.col("steps") + 1)
    return out.withColumn("steps", steps).withColumn("root", root)


def _parents(blocks: DataFrame, fan: int, levels: int) -> DataFrame:
    size = F.expr(f"(size + {fan**levels - 1}) div {fan**levels}")
    return materialise(_reduced(blocks, fan, levels).select("tree", F.col("block").alias("pos"), F.col("root").alias("digest"), size.alias("size")), "parents")


def _members(blocks: DataFrame, above: DataFrame, fan: int, levels: int, *keep: str) -> DataFrame:
    """The blocks' nodes (tree, pos, digest, keep) with the path to the root, their tree's root and the root."""
    up = above.select(F.col("tree").alias("up_tree"), F.col("pos").alias("up_pos"), "suffix", "subroot", "top")
    out = _reduced(blocks, fan, levels).join(up, F.col("tree").eqNullSafe(F.col("up_tree")) & (F.col("block") == F.col("up_pos")))
    none = f"cast(array() as {PATH})"

    def level(k: int) -> str:
        run, at = f"r{k}[cast(i div {fan ** (k + 1)} as int)]", f"cast(i div {fan**k} as int) % {fan}"
        return f"if(steps > {k}, array(named_struct('left', array_join(slice({run}, 1, {at}), ''), 'right', array_join(slice({run}, {at} + 2, {fan}), ''))), {none})"

    path = f"concat({', '.join(map(level, range(levels)))}, suffix)"
    each = F.expr(f"transform(m, (x, i) -> named_struct('x', x, 'path', {path}))")
    return out.select("tree", "subroot", "top", F.explode(each).alias("e")).select("tree", "e.x.pos", "e.x.digest", *[f"e.x.{c}" for c in keep], F.col("e.path").alias("path"), "subroot", "top")


def _tree(nodes: list[str], fan: int) -> tuple[list[list[tuple[str, str]]], str]:
    """Each node's path to the root of a tree over them, and the root."""
    from hashlib import sha256

    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            first = at[k] // fan * fan
            path.append(("".join(nodes[first : at[k]]), "".join(nodes[at[k] + 1 : first + fan])))
        nodes = [sha256("".join(nodes[k : k + fan]).encode()).hexdigest() for k in range(0, len(nodes), fan)]
        at = [k // fan for k in at]
    return paths, nodes[0]


def _above(nodes: DataFrame, fan: int, levels: int, top: int, whole: bool = False) -> DataFrame:
    """tree, pos, suffix (the path to the root), subroot (the tree's) and top (the root) of written nodes; whole: all are of one tree, the last."""
    spark, schema = nodes.sparkSession, f"tree string, pos long, suffix {PATH}, subroot string, top string"
    seen = nodes.agg(F.count("*").alias("n"), F.max("size").alias("most")).first()
    if seen["n"] <= top:
        trees: dict = {}
        for r in sorted(nodes.collect(), key=lambda r: ((r.tree is not None), (r.tree or "").encode(), r.pos)):
            trees.setdefault(r.tree, []).append(r)
        own = {t: _tree([r.digest for r in rows], fan) for t, rows in trees.items()}
        over, root = _tree([r for _, r in own.values()], fan) if own else ([], None)
        rows = [(t, r.pos, path + up, own[t][1], root) for t, up in zip(own, over, strict=True) for r, path in zip(trees[t], own[t][0], strict=True)]
        return F.broadcast(spark.createDataFrame(rows, schema))
    if seen["most"] == 1 and not whole:  # every tree is one node: these make the last tree
        ranked = materialise(numbered(nodes, F.col("tree").isNotNull(), F.col("tree"), name="rank"), "subroots")
        last = ranked.select(F.lit(None).cast("string").alias("tree"), F.col("rank").alias("pos"), "digest", F.lit(seen["n"]).alias("size"))
        up = _above(materialise(last, "subroots"), fan, levels, top, True).select(F.col("pos").alias("rank"), "suffix", "top")
        return ranked.join(up, "rank").select("tree", "pos", "suffix", F.col("digest").alias("subroot"), "top")
    blocks = _blocks(nodes, fan, levels)
    up = _above(_parents(blocks, fan, levels), fan, levels, top, whole)
    return materialise(_members(blocks, up, fan, levels).select("tree", "pos", F.col("path").alias("suffix"), "subroot", "top"), "paths")


def proofs(docs: DataFrame, *keep: str, fields: tuple[str, ...] = FIELDS, fan: int = FAN, levels: int = LEVELS, top: int = TOP_NODES, names: tuple[str, ...] = ("leaf", "path", "subroot", "root")) -> DataFrame:
    """keep, and leaf, path (from leaf to root), subroot and root of each row."""
    digest, path, subroot, root = (fresh(docs.select(*keep), n) for n in names)
    held = [f"keep_{k}" for k in range(len(keep))]
    made = docs.select(F.col("source").alias("tree"), F.col("doc_id").alias("id"), leaf(*map(F.col, fields)).alias("digest"), *[F.col(c).alias(h) for c, h in zip(keep, held, strict=True)])
    made = materialise(made, "leaves")
    order = (F.col("tree").isNotNull(), F.col("tree"), F.col("id").isNull(), F.col("id"), F.col("digest"))
    placed = numbered(made, *order)
    sizes = materialise(placed.groupBy("tree").agg(F.min("number").alias("first"), F.count("*").alias("size")), "sizes")
    small = bounded(sizes.select(F.col("tree").alias("s_tree"), "first", "size"), sizes)
    nodes = placed.join(small, F.col("tree").eqNullSafe(F.col("s_tree"))).select("tree", (F.col("number") - F.col("first")).alias("pos"), "digest", "size", *held)
    blocks = _blocks(nodes, fan, levels, *held)
    up = _above(_parents(blocks, fan, levels), fan, levels, top)
    out = _members(blocks, up, fan, levels, *held)
    return out.select(*[F.col(h).alias(c) for c, h in zip(keep, held, strict=True)], F.col("digest").alias(digest), F.col("path").alias(path), F.col("subroot").alias(subroot), F.col("top").alias(root))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proofs of all rows, and what folding gives where a fifth of the texts was tampered with."""
    docs = documents(spark, sf_dir, *FIELDS)
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    fields = [ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]
    docs = docs.withColumn("tampered", F.when(changed, leaf(*fields)))
    out = proofs(docs, "doc_id", "tampered")
    out = out.select("doc_id", "leaf", "subroot", "root", siblings(F.col("path")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels that the SQL goes up for each source, and over the sources' roots: enough for 16 ** 6 rows of a source and 16 ** 4 sources.
SQL_LEVELS = (6, 4)


def _sql() -> str:
    coded = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    made = lambda text: f"sha256({' || '.join(coded(text if c == 'text' else c) for c in FIELDS)})"
    crc = "list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: list_reduce([xor(a, b)] || [CAST(0 AS BIGINT) FOR i IN range(8)], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"
    ctes = [
        f"d AS (SELECT doc_id, source, {made('text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {made(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered FROM documents)",
        "a0 AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS LAST, leaf) AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST, leaf) - 1 AS p, leaf AS node, coalesce(tampered, leaf) AS fold, '' AS proof FROM d)",
    ]
    levels = [("source", f"a{k}", f"a{k + 1}") for k in range(SQL_LEVELS[0])]
    levels += [("r * 0", f"b{k}", f"b{k + 1}") for k in range(SQL_LEVELS[1])]
    for tree, was, now in levels:
        if was == "b0":
            ctes.append(f"b0 AS (SELECT * REPLACE (dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS p), node AS subroot FROM a{SQL_LEVELS[0]})")
        ctes.append(f"{was}n AS (SELECT {tree} AS t, p // 16 AS q, p AS i, any_value(node) AS node, count(*) OVER (PARTITION BY {tree}) AS n FROM {was} GROUP BY {tree}, p)")
        ctes.append(f"{was}r AS (SELECT t, q, any_value(n) AS n, list(node ORDER BY i) AS run FROM {was}n GROUP BY t, q)")
        left, right = "array_to_string(run[:p % 16], '')", "array_to_string(run[p % 16 + 2:], '')"
        ctes.append(
            f"{now} AS (SELECT {was}.* REPLACE (CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE node END AS node, CASE WHEN n > 1 THEN sha256({left} || fold || {right}) ELSE fold END AS fold, CASE WHEN n > 1 THEN proof || {left} || {right} ELSE proof END AS proof, p // 16 AS p) FROM {was} JOIN {was}r ON {tree} IS NOT DISTINCT FROM t AND p // 16 = q)"
        )
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = node AS verified FROM b{SQL_LEVELS[1]}"


SQL = _sql()
