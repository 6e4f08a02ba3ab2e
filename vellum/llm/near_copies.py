"""Near-copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts with the same set are one node.  A node has the SimHash fingerprint of its shingles, and nodes whose
fingerprints differ in at most two bits are candidates, found as in :mod:`vellum.llm.simhash`.  Most pairs at
0.8 differ in more bits, for which fingerprints have no cheap blocks, so min-hash keys find the rest: each node writes ``BANDS`` keys of ``ROWS`` min-hashes; a pair
at 0.8 shares no key with probability (1 - 0.8^4)^32, 5 in 10^8, and less above.  Nodes that share a
key are candidates, and the similarity of every candidate pair is counted exactly on shingle hashes,
so nothing below 0.8 links.  Keys of up to ``CROWD`` nodes give all their pairs.

A crowded key gives stars first: from its node whose keys are the most crowded (of a text in thousands
of variants the one nearest to all, as a rule the original), its least and its greatest node to all
others.  Then, ``rounds`` times, what is left outside the largest component met in the key goes on: up to
``CROWD`` such nodes meet each other, and two more of them, the one whose keys are the most crowded and
the least, meet all nodes of the key.  What is then still outside the largest component of a key meets
the nodes of other components by shingles: each text's are put in order, the rarest in the crowds
first, and two texts at 0.8 share one among the first fifth or so of each.  So no pair of a key is left
out, and only pairs with a rare shingle in common make rows; ``exact`` leaves the stars' rounds out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.components import components
from vellum.llm.shared import as_table, drop_table, work_folder
from vellum.llm.simhash import BLOCK_CHARS, CROWD, SEED, close_pairs, first_rows, majority, row_blocks, with_component

WORDS = 5
#: Least similarity as a fraction, so that 0.8 itself is met exactly.
LEAST = (4, 5)
BANDS, ROWS = 32, 4
#: Times that what a crowd's centres left apart gets centres of its own.
ROUNDS = 2
_SPREAD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Ascending hashes of the distinct word shingles of one text; a shorter text is one shingle."""
    found = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(found[i: i + words]), SEED)
                               for i in range(max(len(found) - words + 1, min(len(found), 1)))], np.uint64))


def marks(text: str, words: int = WORDS) -> np.ndarray:
    """Digest and size of a text's set of shingles, then its keys and its fingerprint (an empty set has none)."""
    own = shingles(text, words)
    head = np.array([xxhash.xxh64_intdigest(own.tobytes(), SEED), len(own)], np.uint64)
    if not len(own):
        return head.view(np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(own), 1024):
        np.minimum(least, (own[i: i + 1024, None] * _SPREAD[0]).min(0), out=least)
    keys = ((least ^ least >> np.uint64(32)) * _SPREAD[1]).reshape(BANDS, ROWS).sum(1, dtype=np.uint64)
    return np.concatenate([head, keys, np.array([majority(own)], np.uint64)]).view(np.int64)


def _sets(words: int, text_at: int):
    """Cogroup of a block with places: the shingles of the texts at those places."""

    def run(blocks: pa.Table, places: pa.Table) -> pa.Table:
        found = []
        if places.num_rows:
            texts = pa.ipc.open_stream(blocks["body"][0].as_buffer()).read_all().column(text_at)
            found = [shingles(texts[i].as_py() or "", words).view(np.int64) for i in places["place"].to_pylist()]
        return pa.table({"fp": places["fp"], "shingles": pa.array(found, pa.list_(pa.int64()))})

    return run


def _candidates(a: DataFrame, b: DataFrame, also) -> DataFrame:
    """Pairs (a, b) of nodes of a key whose sizes allow the similarity; ``also`` narrows them."""
    up, down = LEAST
    pairs = a.alias("x").join(b.alias("y"), F.col("x.key") == F.col("y.key")).where(also).where(
        F.least("x.size", "y.size") * down >= F.greatest("x.size", "y.size") * up)
    return pairs.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()


def close_prints(nodes: DataFrame, folder: str) -> DataFrame:
    """Candidates (a, b) among ``nodes`` (fp, size, print) by fingerprint: every node with the least node of its own
    fingerprint and of those that :func:`close_pairs` links to it."""
    least = as_table(nodes.groupBy("print").agg(F.min(F.struct("fp", "size")).alias("of")).select("print", "of.*"), f"{folder}/prints")
    near = close_pairs(least.select(F.col("print").alias("fp")), f"{folder}/close")
    ways = near.union(near.select("b", "a")).union(least.select("print", "print")).toDF("print", "key")
    return _candidates(nodes.join(ways, "print"), least.withColumnRenamed("print", "key"), F.col("x.fp") != F.col("y.fp"))


def _centres(nodes: DataFrame, *ends) -> DataFrame:
    """(key, node) of each key's node of the highest score, and its least or greatest as ``ends`` asks."""
    found = nodes.groupBy("key").agg(F.max(F.struct("score", "node")).alias("top"), *(f("node").alias(f"end{i}") for i, f in enumerate(ends)))
    return found.select("key", F.explode(F.array_distinct(F.array("top.node", *(f"end{i}" for i in range(len(ends)))))).alias("node"))


def prefixes(sets: DataFrame) -> DataFrame:
    """(fp, n, token, pos): of each set (fp, shingles) those shingles, the rarest among ``sets`` first, of which it shares
    one with any set that is alike.  A shingle of one set only meets nothing and is left out."""
    long = sets.select("fp", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    often, (up, down) = long.groupBy("token").agg(F.count("*").alias("often")), LEAST
    placed = long.join(often, "token").withColumn(
        "pos", F.row_number().over(Window.partitionBy("fp").orderBy("often", "token")))
    return (placed.where((F.col("often") > 1) & (F.col("pos") <= F.col("n") - F.ceil(F.col("n") * up / down) + 1))
            .select("fp", "n", "token", "pos"))


def _met(apart: DataFrame, rooted: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pairs (a, b) of a node of ``apart`` and one of ``rooted`` (fp, root each) of another component that meet in a token
    and have room for the common shingles they need behind it."""
    up, down = LEAST
    x, y = tokens.join(apart, "fp").alias("x"), tokens.join(rooted, "fp").alias("y")
    room = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) + 1
    met = x.join(y, F.col("x.token") == F.col("y.token")).where(
        (F.col("x.root") != F.col("y.root")) & (room * (up + down) >= (F.col("x.n") + F.col("y.n")) * up))
    return met.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()


def similar_pairs(rows: DataFrame, blocks: DataFrame, text_at: int, words: int, folder: str, rounds: int = ROUNDS,
                  exact: bool = False) -> DataFrame:
    """Edges (a, b) of candidate pairs with the similarity asked for, all that connect what is alike.

    ``rows`` holds (fp, marks, block, place) of every text, ``blocks`` the texts themselves.
    """
    spark = rows.sparkSession
    nodes = as_table(rows.groupBy("fp").agg(F.min(F.struct("block", "place", "marks")).alias("at"))
                     .select("fp", "at.*"), f"{folder}/nodes", "none")
    keyed = nodes.select("fp", F.get("marks", F.lit(1)).alias("size"),
                         F.explode(F.slice("marks", 3, BANDS)).alias("key"))
    sizes = as_table(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), f"{folder}/keys")
    shared = keyed.join(sizes.where(F.col("n") <= CROWD).select("key"), "key")
    found = as_table(keyed.join(sizes.where(F.col("n") > CROWD), "key"), f"{folder}/found")
    crowd = as_table(found.join(found.groupBy("fp").agg(F.sum("n").alias("score")), "fp").select("key", "fp", "size", "score"),
                     f"{folder}/crowd")

    def shingled(some: DataFrame, step: int) -> DataFrame:
        places = nodes.join(some, "fp").select("block", "place", "fp")
        return as_table(blocks.select("block", "body").groupBy("block").cogroup(places.groupBy("block"))
                        .applyInArrow(_sets(words, text_at), "fp long, shingles array<long>"), f"{folder}/sets{step}", "none")

    def alike(pairs: DataFrame, step: int, sets: DataFrame | None = None) -> DataFrame:
        pairs = as_table(pairs, f"{folder}/pairs{step}")
        sets = sets or shingled(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), step)
        both = (pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("s")), "a")
                .join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("t")), "b"))
        common, (up, down) = F.size(F.array_intersect("s", "t")), LEAST
        edges = as_table(both.where(common * down >= (F.size("s") + F.size("t") - common) * up).select("a", "b"),
                         f"{folder}/edges{step}")
        for used in ("pairs", "sets"):
            drop_table(spark, f"{folder}/{used}{step}")
        return edges

    x, y = F.col("x.fp"), F.col("y.fp")
    centres = _centres(crowd.withColumn("node", F.struct("fp", "size")), F.min, F.max).select("key", "node.*")
    printed = nodes.select("fp", F.get("marks", F.lit(1)).alias("size"), F.get("marks", F.lit(2 + BANDS)).alias("print"))
    edges = alike(close_prints(printed.where("print IS NOT NULL"), folder).union(_candidates(shared, shared, x < y))
                  .union(_candidates(centres, crowd, x != y)).distinct(), 0)
    if crowd.isEmpty():
        return edges
    rounds = 0 if exact else rounds
    for step in range(1, 2 + rounds):
        roots = components(edges).withColumnRenamed("node", "fp")
        rooted = as_table(crowd.join(roots, "fp", "left").select("key", "fp", "size", "score", F.coalesce("root", "fp").alias("root")),
                          f"{folder}/rooted{step}")
        largest = rooted.groupBy("key", "root").count().groupBy("key").agg(
            F.max(F.struct("count", "root")).alias("top"), F.sum("count").alias("n")).where("n > top.count")
        apart = as_table(rooted.join(largest, "key").where("root <> top.root")
                         .select("key", "fp", "size", "score", "root", (F.col("n") - F.col("top.count")).alias("left")), f"{folder}/apart{step}")
        if apart.isEmpty():
            break
        if step > rounds:
            left, open_keys = apart.select("fp", "root").distinct(), apart.select("key").distinct()
            near = as_table(rooted.join(open_keys, "key").select("fp", "root").distinct(), f"{folder}/near")
            sets = shingled(near.select("fp"), step)
            edges = edges.union(alike(_met(left, near, as_table(prefixes(sets), f"{folder}/tokens")), step, sets))
            drop_table(spark, f"{folder}/tokens")
            break
        between = F.col("x.root") != F.col("y.root")
        few = apart.where(F.col("left") <= CROWD)
        centres = _centres(apart.withColumn("node", F.struct("fp", "size", "root")), F.min).select("key", "node.*")
        wanted = _candidates(few, few, between & (x < y)).union(_candidates(centres, rooted, between)).distinct()
        edges = edges.union(alike(wanted, step))
    return edges


def keep_one(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text",
             block_chars: int = BLOCK_CHARS, rounds: int = ROUNDS, exact: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, without near-copies: of each component the document with the
    least id stays, once if its row is repeated.  Rows without an id all stay, since no id names
    them.  Null and empty texts are copies of each other.
    """
    folder, text_at = work_folder(docs.sparkSession), docs.columns.index(text_col)
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct("*").alias("row"))
    blocks = as_table(whole.mapInArrow(
        row_blocks(text_at, lambda texts: [marks(t, words) for t in texts], pa.list_(pa.int64()), block_chars),
        "block long, ids array<long>, prints array<array<long>>, body binary"), f"{folder}/blocks", "none")
    rows = as_table(blocks.select("block", F.posexplode(F.arrays_zip("ids", "prints")).alias("place", "row"))
                    .select(F.col("row.ids").alias("doc_id"), F.get("row.prints", F.lit(0)).alias("fp"),
                            F.col("row.prints").alias("marks"), "block", "place"), f"{folder}/rows", "none")
    named = with_component(rows.select("doc_id", "fp", "block", "place"), folder,
                           lambda prints, at: similar_pairs(rows, blocks, text_at, words, at, rounds, exact))
    return first_rows(blocks, rows, named, docs.schema)
