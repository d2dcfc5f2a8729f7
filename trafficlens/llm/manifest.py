"""Merkle manifest of a table, rolled up as nested structs.

A leaf is the digest of a row's fields. Leaves of a language stand in ascending order of id; every eight consecutive
nodes become their parent until one is left, the language's subroot. The subroots, by language, likewise give the root.

A leaf's rank is written in octal. Its last ``DIGITS`` digits name its place in a block of 8^DIGITS leaves, and are
grouped away one after the other: grouping by all but the last digit nests eight leaves into a struct that holds their
parent's digest, grouping by one digit less nests eight of those, until a row is a block. The rows of blocks are the
leaves of the next table, 8^DIGITS times smaller, and so on up to the subroots, whose ranks among the languages are
rolled up in the same way. On the way down each row of nested structs is transformed into the paths of its leaves
(what stands left and right of a node at each level) and exploded; no leaf is joined to its siblings. What a
block needs from above is one path, which meets the block's row by its number.

Ranks need no window over a language: rows are dealt out by ranges of (language, id, digest) and numbered where they
lie, and the rows of a language in earlier ranges are summed from one count per range and language. Rows that agree in
all of these are spread by their place in the stored table, so repeated rows do not meet in one task. Every narrow table is
written to the shared folder once, so numbers stay as they are when a task is repeated.

Defined results: a null field counts as ``-``; null languages form a group of their own, the first; null ids come first;
repeated ids are ordered by their leaf; equal rows are separate leaves; a null id is never tampered; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
FAN = 8
DIGITS = 3  # octal digits that one block groups away: 512 nodes a row
STEPS = "array<struct<l:string,r:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A field as it enters a leaf: ``-`` or byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank`` (from 0, by ``order`` within ``grp``) and ``height`` of the group's tree to stored ``rows``."""
    keys = ["grp", *order, "_tie"]
    spread = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
    dealt = materialise(spread.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    part = F.shiftright("_at", 33)  # the number of the task; the lower bits count its rows
    counts = dealt.groupBy("grp", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    of_group = Window.partitionBy("grp")  # a row for each range that the group lies in
    before = F.sum("_rows").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("grp", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
                           _height(F.sum("_rows").over(of_group)).alias("height"))
    return (dealt.withColumn("_part", part).join(counts, ["grp", "_part"])
            .withColumn("rank", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift"))


def _height(n: Column) -> Column:
    """Levels above ``n`` leaves: the octal digits of the last rank, none for a lone leaf."""
    return F.when(n <= 1, 0).otherwise(F.length(F.conv((n - 1).cast("string"), 10, FAN)))


def _joined(nodes: Column) -> Column:
    return F.concat_ws("", F.transform(nodes, lambda n: n["digest"]))


def blocks(nodes: DataFrame, below: int) -> DataFrame:
    """Nest ``nodes(grp, rank, height, digest, payload)`` into one row a block: ``grp, rank, height, digest, kids``.

    ``below`` levels lie under these nodes already. The rank of a block is its number in its group. In a tree that ends
    below a level, the nodes of that level are their only children.
    """
    place = lambda k: F.shiftright("rank", 3 * k).bitwiseAND(F.lit(FAN - 1)).cast("int").alias(f"d{k}")
    now = nodes.select("grp", F.shiftright("rank", 3 * DIGITS).alias("block"), "height", *map(place, range(DIGITS)),
                       F.struct(place(0), "digest", "payload").alias("kid")).repartition("grp", "block")
    for k in range(DIGITS):
        keep = ["grp", "block", "height", *[f"d{j}" for j in range(DIGITS - 1, k, -1)]]
        now = now.groupBy(*keep).agg(F.array_sort(F.collect_list("kid")).alias("kids"))  # at most eight, by their digit
        parent = F.when(F.col("height") > below + k, digest(_joined(F.col("kids")))).otherwise(F.col("kids")[0]["digest"])
        now = now.withColumn("digest", parent)
        if k + 1 < DIGITS:
            now = now.select(*keep, F.struct(f"d{k + 1}", "digest", "kids").alias("kid"))
    return now.select("grp", F.col("block").alias("rank"), "height", "digest", "kids")


def paths(nested: DataFrame, below: int) -> DataFrame:
    """``digest, payload, steps`` of each node that ``nested(height, kids, above)`` holds; other columns are kept.

    ``steps`` says for each level, upwards, what stands left and right of the way to the root.
    """
    def down(kids: Column, k: int, above: Column) -> Column:
        def one(kid: Column, at: Column) -> Column:
            step = F.array(F.struct(_joined(F.slice(kids, F.lit(1), at)).alias("l"),
                                    _joined(F.slice(kids, at + 2, F.lit(FAN))).alias("r")))
            steps = F.concat(F.when(F.col("height") > below + k, step).otherwise(F.array().cast(STEPS)), above)
            if k:
                return down(kid["kids"], k - 1, steps)
            return F.struct(kid["digest"].alias("digest"), kid["payload"].alias("payload"), steps.alias("steps"))
        made = F.transform(kids, one)
        return F.flatten(made) if k else made
    kept = [c for c in nested.columns if c not in ("rank", "height", "digest", "kids", "above")]
    return nested.select(*kept, F.inline(down(F.col("kids"), DIGITS - 1, F.col("above"))))


def rolled_up(nodes: DataFrame) -> list[DataFrame]:
    """Tables of blocks, from the leaves upwards; the last holds one block, and so one root, for each group."""
    stored = [materialise(blocks(nodes, 0))]
    tallest = stored[0].agg(F.max("height")).first()[0] or 0
    while len(stored) * DIGITS < tallest:
        nodes = stored[-1].select("grp", "rank", "height", "digest", F.col("rank").alias("payload"))
        stored.append(materialise(blocks(nodes, len(stored) * DIGITS)))
    return stored


def led_down(stored: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``paths`` of all leaves, given ``tops(grp, above, …)``: the path from each group's root onwards."""
    here = stored[-1].join(tops, "grp")
    for k in range(len(stored) - 1, 0, -1):
        ways = paths(here, k * DIGITS).drop("digest").withColumnsRenamed({"payload": "rank", "steps": "above"})
        here = stored[k - 1].join(ways, ["grp", "rank"])  # one way for each block
    return paths(here, 0)


def folded(start: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(steps, start, lambda acc, s: digest(F.concat(s["l"], acc, s["r"])))


def proofs(leaves: DataFrame) -> DataFrame:
    """``grp, digest, payload, steps, subroot, root`` of stored ``leaves(grp, id, digest, payload)``.

    Leaves ascend by (id, digest) in their group, the groups by name; ``steps`` leads from the leaf to the root.
    """
    stored = rolled_up(numbered(leaves, ["id", "digest"]))
    subroots = stored[-1].select(F.lit("").alias("grp"), F.col("grp").alias("payload"), "digest")
    tree = rolled_up(numbered(materialise(subroots), ["payload"]))
    crown = tree[-1].select("grp", F.array().cast(STEPS).alias("above"), F.col("digest").alias("root"))
    tops = led_down(tree, crown).select(F.col("payload").alias("grp"), F.col("steps").alias("above"),
                                        F.col("digest").alias("subroot"), "root")
    return led_down(stored, tops)


def manifest(docs: DataFrame, tampered: Column, fields: list[str] = FIELDS, id_col: str = "doc_id", text_col: str = "text",
             group_col: str = "lang") -> DataFrame:
    """Proof of each row, checked against rows whose ``text_col`` is ``tampered``.

    ``<id>, leaf, subroot, root, proof_sha256, folded_root, verified``; the first five are those of the untampered
    rows, ``folded_root`` follows from the tampered row and its proof. ``tampered`` is an expression over ``docs``.
    """
    values = [docs[f"`{c}`"] for c in fields]
    changed = [tampered if c == text_col else docs[f"`{c}`"] for c in fields]
    # A name that is never null and sorts null groups first.
    group = F.coalesce(F.concat(F.lit("="), docs[f"`{group_col}`"].cast("string")), F.lit(""))
    seen, true = leaf(changed), leaf(values)
    leaves = docs.select(group.alias("grp"), docs[f"`{id_col}`"].alias("id"), true.alias("digest"),
                         F.struct(docs[f"`{id_col}`"].alias("id"), seen.alias("seen")).alias("payload"))
    found = proofs(materialise(leaves))
    root = folded(F.col("payload.seen"), F.col("steps"))
    siblings = F.concat_ws("", F.transform("steps", lambda s: F.concat(s["l"], s["r"])))
    return (found.select(F.col("payload.id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root",
                         digest(siblings).alias("proof_sha256"), root.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest(docs, F.when(hit, lowered).otherwise(F.col("text")))


def _sql_leaf(text: str) -> str:
    parts = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
             for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


#: One bit of crc32 after the other; the tree level by level. Languages are numbered, null first.
OP12_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, lang, n_chars, text, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
    list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
        lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i::INT, 1))::BIGINT)),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS crc
  FROM documents),
tampered AS (
  SELECT *, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS seen_text FROM rows),
hashed AS (SELECT doc_id, g, {_sql_leaf('text')} AS leaf, {_sql_leaf('seen_text')} AS seen FROM tampered),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY g) AS n, row_number() OVER () AS id FROM hashed),
up(g, level, pos, d, n) AS (
  SELECT g, 0, pos, leaf, n FROM leaves
  UNION ALL
  SELECT g, level + 1, pos // {FAN}, sha256(string_agg(d, '' ORDER BY pos)), (n + {FAN - 1}) // {FAN}
  FROM up WHERE n > 1 GROUP BY g, level, pos // {FAN}, n),
subroots AS (SELECT g, d AS subroot FROM up WHERE n = 1),
over(level, pos, d, n) AS (
  SELECT 0, g, subroot, (SELECT count(*) FROM subroots) FROM subroots
  UNION ALL
  SELECT level + 1, pos // {FAN}, sha256(string_agg(d, '' ORDER BY pos)), (n + {FAN - 1}) // {FAN}
  FROM over WHERE n > 1 GROUP BY level, pos // {FAN}, n),
path(id, g, level, pos, acc, proof) AS (
  SELECT id, g, 0, pos, seen, '' FROM leaves
  UNION ALL
  SELECT f.id, f.g, f.level + 1, f.pos // {FAN},
    sha256(string_agg(CASE WHEN u.pos = f.pos THEN f.acc ELSE u.d END, '' ORDER BY u.pos)),
    f.proof || coalesce(string_agg(u.d, '' ORDER BY u.pos) FILTER (WHERE u.pos <> f.pos), '')
  FROM path f JOIN up u ON u.g = f.g AND u.level = f.level AND u.pos // {FAN} = f.pos // {FAN} AND u.n > 1
  GROUP BY f.id, f.g, f.level, f.pos, f.acc, f.proof),
ended AS (SELECT id, g, arg_max(acc, level) AS acc, arg_max(proof, level) AS proof FROM path GROUP BY id, g),
onward(id, level, pos, acc, proof) AS (
  SELECT id, 0, g, acc, proof FROM ended
  UNION ALL
  SELECT f.id, f.level + 1, f.pos // {FAN},
    sha256(string_agg(CASE WHEN u.pos = f.pos THEN f.acc ELSE u.d END, '' ORDER BY u.pos)),
    f.proof || coalesce(string_agg(u.d, '' ORDER BY u.pos) FILTER (WHERE u.pos <> f.pos), '')
  FROM onward f JOIN over u ON u.level = f.level AND u.pos // {FAN} = f.pos // {FAN} AND u.n > 1
  GROUP BY f.id, f.level, f.pos, f.acc, f.proof),
done AS (SELECT id, arg_max(acc, level) AS acc, arg_max(proof, level) AS proof FROM onward GROUP BY id),
top AS (SELECT d AS root FROM over WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM leaves JOIN done USING (id) JOIN subroots USING (g), top"""
