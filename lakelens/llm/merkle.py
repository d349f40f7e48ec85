"""Merkle manifest of a table: one hash tree for each language, built and proved by slot pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.llm.base import query
from lakelens.plans.session import cut, lookup
from lakelens.sources.io import table

FANOUT = 2
SLOTS = 16  # slots of one pivot at most; a pivot covers as many levels as fit
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """SHA-256 in lower-case hex of the parts in a row; null parts are nothing."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value, so that no two rows read the same."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def tree_key(value: Column) -> Column:
    """A non-null key in the order of ``value``, null first and bytewise."""
    return F.coalesce(F.concat(F.lit("="), value), F.lit("-"))


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``i``, their number from 0 in the order of ``by``.

    Rows are cut into sorted ranges and written with their place in the range; the sizes of the ranges, one number for
    each, are summed in a window over ranges. Rows that agree in ``by`` spread over ranges by their place in the input.
    """
    rows = cut(rows.withColumn("salt", F.monotonically_increasing_id()))
    rows = rows.repartitionByRange(*by, "salt").sortWithinPartitions(*by, "salt").drop("salt")
    rows = cut(rows.withColumn("place", F.monotonically_increasing_id())).withColumn("range", F.shiftright("place", 33))
    sizes = rows.groupBy("range").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("range")) - F.col("size")  # one row by range
    first = F.broadcast(sizes.select("range", before.alias("before")))
    return rows.join(first, "range").withColumn("i", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("range", "place", "before")


def levels_of(fanout: int) -> int:
    """Levels that one pivot covers."""
    n = 1
    while fanout ** (n + 1) <= SLOTS:
        n += 1
    return n


def live(level: int, fanout: int) -> Column:
    """Whether a tree of ``n`` leaves still has several nodes at ``level``."""
    return F.col("n") > F.lit(fanout**level)


def pivoted(nodes: DataFrame, level: int, fanout: int) -> DataFrame:
    """One row for each run of fanout ** levels nodes (tree, pos, n, node): its nodes as columns, and those above them.

    A conditional aggregate for each slot spreads the run over columns x0_0, x0_1, ...; nodes are stored in order, so
    most runs are put together before the shuffle. The digest of fanout neighbouring columns is the column above
    them, until ``top``. A tree that is down to one node keeps it.
    """
    per = levels_of(fanout)
    width = fanout**per
    slot = F.pmod(F.col("pos"), F.lit(width))
    group = ["tree", "n", F.floor(F.col("pos") / width).cast("long").alias("g")]
    rows = nodes.groupBy(*group).agg(*[F.max(F.when(slot == k, F.col("node"))).alias(f"x0_{k}") for k in range(width)])
    for i in range(per):
        new = {}
        for j in range(width // fanout ** (i + 1)):
            children = [_hash(i, j * fanout + c) for c in range(fanout)]
            alone = children[0] if j == 0 else F.lit(None).cast("string")
            new[f"x{i + 1}_{j}"] = F.when(live(level + i, fanout), F.when(children[0].isNotNull(), digest(*children))).otherwise(alone)
        rows = rows.withColumns(new)
    return rows.withColumnRenamed(f"x{per}_0", "top")


def _hash(i: int, j: int) -> Column:
    return F.col(f"x{i}_{j}.hash") if i == 0 else F.col(f"x{i}_{j}")


def build(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """The pivots of all trees, from the leaves up; the last one has one row by tree. Each is written once."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    steps, level = [], 0
    while not steps or fanout**level < most:
        steps.append(cut(pivoted(nodes, level, fanout)))
        level += levels_of(fanout)
        nodes = steps[-1].select("tree", F.col("g").alias("pos"), "n", F.struct(F.col("top").alias("hash")).alias("node"))
    return steps


PATH = "array<struct<before: string, after: string>>"


def paths(step: DataFrame, level: int, above: DataFrame, fanout: int) -> DataFrame:
    """(tree, pos, node, path) of the nodes of ``step``: their siblings level by level, then those of the run's own node.

    ``above`` has (tree, pos, path) of the runs. The siblings of a node are the columns of its parent but its own:
    ``before`` it and ``after`` it. Levels at which a tree has one node give no entry.
    """
    per = levels_of(fanout)
    joined = step.join(above.select("tree", F.col("pos").alias("g"), "path"), ["tree", "g"])
    entries = []
    for k in range(fanout**per):
        own = []
        for i in range(per):
            j = k // fanout**i
            first = j - j % fanout
            before, after = [_hash(i, c) for c in range(first, j)], [_hash(i, c) for c in range(j + 1, first + fanout)]
            own.append(F.when(live(level + i, fanout), F.struct(F.concat_ws("", *before).alias("before"), F.concat_ws("", *after).alias("after"))))
        path = F.concat(F.array_compact(F.array(*own)).cast(PATH), F.col("path"))
        entries.append(F.when(F.col(f"x0_{k}").isNotNull(), F.struct(F.lit(k).alias("slot"), F.col(f"x0_{k}").alias("node"), path.alias("path"))))
    rows = joined.select("tree", "g", F.explode(F.array_compact(F.array(*entries))).alias("e"))
    return rows.select("tree", (F.col("g") * fanout**per + F.col("e.slot")).alias("pos"), "e.node", "e.path")


def prove(steps: list[DataFrame], roots: DataFrame, fanout: int) -> DataFrame:
    """(tree, pos, node, path) of all leaves; ``roots`` has the path of each tree's own root."""
    above = roots.select("tree", F.lit(0).cast("long").alias("pos"), "path")
    for k in range(len(steps) - 1, -1, -1):
        above = paths(steps[k], k * levels_of(fanout), above, fanout)
        if k:
            above = cut(above)
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["before"], h, s["after"]))


def siblings(path: Column) -> Column:
    """SHA-256 of all siblings from left to right, level by level."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(tree, lang, doc_id, hash, bad): the digest of each row, and that of the row with n_chars + 1 where ``tampered`` holds (else null)."""
    whole = digest(*[field(F.col(c)) for c in FIELDS])
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("decimal(38,0)")
    other = digest(*[field(more if c == "n_chars" else F.col(c)) for c in FIELDS])
    bad = F.when(F.coalesce(tampered, F.lit(False)), other) if tampered is not None else F.lit(None).cast("string")
    return docs.select(tree_key(F.col("lang")).alias("tree"), "lang", "doc_id", whole.alias("hash"), bad.alias("bad"))


def manifest(docs: DataFrame, fanout: int = FANOUT, tampered: Column | None = None) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, path, bad) for every row of ``docs``; ``path`` leads from the leaf to the root.

    Leaves of a language ascend by doc_id, null first; rows that repeat an id ascend by digest, and equal rows are leaves of
    their own. Null values have a text of their own (``field``), so null and empty differ; a null language is a tree of its
    own and comes first. Texts of any length are hashed whole; other columns are ignored. An empty table has no rows.
    A language of one row has its leaf as subroot. The trees are cut into runs of 16 nodes (by slot), each a group of
    its own, so a language with most of the rows, and equal rows, spread over all tasks; only slim rows of digests are
    shuffled, the texts never. Languages are joined by size-checked lookups; the tree of subroots is built in the same way.
    """
    named = numbered(leaves(docs, tampered), ["tree", "doc_id", "hash"])
    trees = cut(named.groupBy("tree").agg(F.min("i").alias("start"), F.count("*").alias("n")))
    rows = lookup(named, trees.withColumn("weight", F.col("n")), "tree", "weight")
    node = F.struct("hash", "doc_id", "lang", "bad").alias("node")
    steps = build(rows.select("tree", (F.col("i") - F.col("start")).alias("pos"), "n", node), fanout)
    subroots = cut(numbered(steps[-1].select(F.col("tree").alias("own"), "top"), ["own"]))
    # the tree over the subroots
    n = subroots.count()
    upper = subroots.select(F.lit("").alias("tree"), F.col("i").alias("pos"), F.lit(n).cast("long").alias("n"), F.struct(F.col("top").alias("hash"), "own").alias("node"))
    upper_steps = build(upper, fanout)
    tops = upper_steps[-1].select("tree", "top", F.array().cast(PATH).alias("path"))
    root = tops.first()
    over = prove(upper_steps, tops, fanout).select(F.col("node.own").alias("tree"), F.col("node.hash").alias("subroot"), "path")
    over = cut(over)
    out = prove(steps, over.select("tree", "path"), fanout)
    out = lookup(out, over.select("tree", "subroot").join(trees.select("tree", F.col("n").alias("weight")), "tree"), "tree", "weight")
    return out.select("node.doc_id", "node.lang", F.col("node.hash").alias("leaf"), "subroot", F.lit(root["top"] if root else None).cast("string").alias("root"), "path", "node.bad")


@query(
    "op11_merkle_manifest",
    """
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree,
    coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    n_chars, coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
    -- CRC-32 of the decimal id: eight steps for each byte
    xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda s: [ascii(s)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)), 4294967295::UBIGINT) % 7 = 0 AS tampered
  FROM documents),
hashed AS (
  SELECT *, sha256(head || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(octet_length(encode((n_chars + 1)::VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS other FROM docs),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
low(tree, level, pos, n, h) AS (
  SELECT tree, 0, pos, n, leaf FROM leaves
  UNION ALL SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY tree, level, pos // 2, n),
subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM subroots
  UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (
  SELECT l.doc_id, l.leaf, l.pos AS leaf_pos, l.tree, t.level AS place, (l.pos >> t.level) % 2 AS side, s.h FROM leaves l JOIN low t ON t.tree = l.tree AND t.pos = l.pos >> t.level AND t.n > 1
    LEFT JOIN low s ON s.tree = t.tree AND s.level = t.level AND s.pos = xor(t.pos, 1)
  UNION ALL
  SELECT l.doc_id, l.leaf, l.pos, l.tree, 100 + t.level, (r.pos >> t.level) % 2, s.h FROM leaves l JOIN subroots r ON r.tree = l.tree JOIN high t ON t.pos = r.pos >> t.level AND t.n > 1
    LEFT JOIN high s ON s.level = t.level AND s.pos = xor(t.pos, 1)),
ways AS (SELECT tree, leaf_pos, list({'side': side, 'h': coalesce(h, '')} ORDER BY place) AS way FROM steps GROUP BY tree, leaf_pos),
fold(tree, leaf_pos, k, way, acc) AS (
  SELECT l.tree, l.pos, 0, coalesce(w.way, []), CASE WHEN l.tampered THEN l.other ELSE l.leaf END FROM leaves l LEFT JOIN ways w ON w.tree = l.tree AND w.leaf_pos = l.pos
  UNION ALL SELECT tree, leaf_pos, k + 1, way, sha256(CASE WHEN way[k + 1].side = 1 THEN way[k + 1].h || acc ELSE acc || way[k + 1].h END) FROM fold WHERE k < len(way))
SELECT l.doc_id, l.leaf, r.subroot, (SELECT h FROM high WHERE n = 1) AS root,
  sha256(array_to_string(list_transform(f.way, lambda x: x.h), '')) AS proof_sha256, f.acc AS folded_root, f.acc = (SELECT h FROM high WHERE n = 1) AS verified
FROM leaves l JOIN subroots r ON r.tree = l.tree JOIN fold f ON f.tree = l.tree AND f.leaf_pos = l.pos AND f.k = len(f.way)
""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = manifest(docs, FANOUT, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0)
    rows = rows.withColumn("folded_root", folded(F.coalesce("bad", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", siblings(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
