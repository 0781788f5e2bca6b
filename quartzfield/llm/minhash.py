"""MinHash near-dedup with tensored banding: table keys combine pairs from two small collections of hashes.

With m collections on each side, m * m tables come from 2 * m collections, so the MinHashes computed are the square root
of those that as many separate tables take. Candidates are confirmed on their full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, slices, text_of
from .components import connected_components
from .segments import WordHashes, mix

_U = np.uint64
_WORDS = 16  # of 64 bits, in a bit map


def bit_map(shingles: np.ndarray) -> np.ndarray:
    """Which hash values modulo 1024 a set has."""
    seen = np.zeros(64 * _WORDS, np.uint8)
    seen[(shingles & _U(64 * _WORDS - 1)).astype(np.int64)] = 1
    return np.packbits(seen).view(np.int64)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles, of fewer words that of the whole sequence. Words are two numbers each, both count."""
    n = len(words)
    if not n:
        return np.zeros(0, _U)
    size = min(size, n)
    out = np.full(n - size + 1, _U(size))
    for i in range(size):
        for half in (0, 1):
            out = mix(out * _U(0x9E3779B97F4A7C15) + words[i : n - size + 1 + i, half])
    return np.unique(out)


class Signatures:
    """MinHash collections: ``sides`` x ``collections`` groups of ``rows`` MinHashes, each group as one 64-bit number."""

    def __init__(self, collections: int, rows: int):
        random = np.random.Generator(np.random.PCG64(9176))
        self.shape = (2 * collections, rows)
        self.factor = random.integers(0, 1 << 63, (2 * collections * rows, 1), dtype=_U) * _U(2) + _U(1)
        self.shift = random.integers(0, 1 << 64, (2 * collections * rows, 1), dtype=_U)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factor), _U(0xFFFFFFFFFFFFFFFF))
        for k in range(0, len(shingles), 4096):
            least = np.minimum(least, (shingles[None, k : k + 4096] * self.factor + self.shift).min(axis=1))
        out = np.zeros(self.shape[0], _U)
        for column in least.reshape(self.shape).T:
            out = mix(out * _U(0x9E3779B97F4A7C15) + column)
        return out


_HASHES = WordHashes()


def sets_of(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """Shingle sets of texts; A-Z count as a-z, words are runs of bytes other than ASCII white space."""
    for t in texts:
        yield shingle_set(np.frombuffer(_HASHES.of((t or "").encode().lower()), _U).reshape(-1, 2), size)


def sketches(df: DataFrame, id_col: str, text_col: str, shingle: int, collections: int, rows: int) -> DataFrame:
    """``doc, n, f1, f2, bands``: set size, 128-bit fingerprint of the set and the MinHash collections of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Signatures(collections, rows)
        for batch in slices(batches, "text", 2 << 20):
            n, prints, bands = [], [], []
            for s in sets_of(batch.column("text").to_pylist(), shingle):
                n.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(maker.of(s).view(np.int64) if len(s) else [])
            two = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(bands, pa.list_(pa.int64()))], names=["doc", "n", "f1", "f2", "bands"])

    source = df.select(F.col(id_col).cast("bigint").alias("doc"), text_of(text_col).alias("text"))
    return source.mapInArrow(run, "doc bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>")


def shingle_arrays(df: DataFrame, id_col: str, text_col: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """``node, n, shingles, bits`` of the documents whose id is in ``wanted`` (node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            sets = list(sets_of(batch.column("text").to_pylist(), shingle))
            arrays = [pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([bit_map(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), *arrays], names=["node", "n", "shingles", "bits"])

    source = df.select(F.col(id_col).cast("bigint").alias("node"), text_of(text_col).alias("text"))
    return source.join(wanted, "node").mapInArrow(run, "node bigint, n bigint, shingles array<bigint>, bits array<bigint>").dropDuplicates(["node"])


def near_links(nodes: DataFrame, sets_for, percent: int, collections: int, rounds: int) -> DataFrame:
    """``node, component`` of the nodes (``node, n, bands``) that are linked to another.

    A collection's value that no other node has cannot make a table key, so only values seen twice are combined to
    keys. In each table group all members are compared with one leader, another one in each round; linked nodes become one
    component, and groups whose members all belong to one component are done. What is then left are members of different components
    in one group: all of these pairs whose bit maps allow a link are compared in the last round, so no link of a shared
    key is lost. A bit map has a bit for each of 1024 hash values; two maps differ in no more bits than the sets in shingles.
    """
    values = nodes.select("node", "n", F.posexplode("bands").alias("band", "value"))
    twice = values.groupBy("band", "value").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("band", "value")
    alive = values.join(twice, ["band", "value"]).groupBy("node", "n").agg(F.collect_list(F.struct("band", "value")).alias("alive"))
    keys = F.flatten(
        F.transform(
            F.filter("alive", lambda x: x.band < collections),
            lambda x: F.transform(F.filter("alive", lambda y: y.band >= collections), lambda y: F.xxhash64(x.band, y.band, x.value, y.value)),
        )
    )
    table = alive.select("node", "n", F.explode(keys).alias("key"))
    groups = table.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    members = materialise(table.join(groups, "key"))
    sets = materialise(sets_for(members.select("node").distinct()))
    parts = materialise(members.select("node", F.col("node").alias("component")).distinct())
    tested: DataFrame | None = None
    rounds_done: list[DataFrame] = []
    for turn in range(rounds + 1):
        now = members.select("key", "node", "n").join(parts, "node")
        spread = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by(F.struct("node", "n", "component"), F.col("node") if not turn else F.xxhash64("node", F.lit(turn))).alias("lead"))
        spread = spread.where("low < high")
        mine = now.join(spread.select("key", "lead"), "key")
        if turn:  # components only grow, so what is settled now stays so
            mine = materialise(mine)
            discard(members)
            members = mine
            if mine.isEmpty():
                break
        if turn < rounds:
            other = mine.select("node", "n", "component", F.col("lead.node").alias("other"), F.col("lead.n").alias("m"), F.col("lead.component").alias("its"))
            near = (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & (F.col("component") != F.col("its"))
            pairs = other.where(near).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        else:
            pairs = _across(mine.select("node", "n", "component").distinct().join(sets.select("node", "bits"), "node").join(nodes.select("node", "bands"), "node"), percent, collections)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        checked = materialise(confirmed(pairs, sets, percent))
        if checked.isEmpty():
            continue
        links = checked.where("linked")
        known = parts.select(F.col("node").alias("a"), F.col("component").alias("x"))
        ends = links.join(known, "a").join(known.select(F.col("a").alias("b"), F.col("x").alias("y")), "b").select("x", "y")
        merged = connected_components(ends, "x", "y").select(F.col("node").alias("component"), F.col("component").alias("to"))
        old, parts = parts, materialise(parts.join(merged, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        discard(old)
        rounds_done.append(checked)
        tested = reduce(DataFrame.unionByName, [c.select("a", "b") for c in rounds_done])
    discard(members, sets, *rounds_done)
    return parts


def _across(open_nodes: DataFrame, percent: int, collections: int) -> DataFrame:
    """Pairs ``a, b`` of different components (``node, n, component, bits, bands``) that share a table key and may be linked.

    They meet on the values of the first side; a pair comes from its first common value only, and needs a common value of the
    second side. What costs least is looked at first, all inside the join, so that only pairs to confirm leave it.
    """
    words = [F.col("bits")[i].alias(f"b{i}") for i in range(_WORDS)]
    left = open_nodes.select("node", "n", "component", "bands", *words, F.posexplode(F.slice("bands", 1, collections)).alias("band", "value"))
    right = left.select("band", "value", *(F.col(c).alias(f"o_{c}") for c in ("node", "n", "component", "bands", *(f"b{i}" for i in range(_WORDS)))))
    gaps = [F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"o_b{i}"))) for i in range(_WORDS)]
    # bits that differ are at most the shingles that only one of the two has
    close = sum(gaps[1:], gaps[0]) * (100 + percent) <= (F.col("n") + F.col("o_n")) * (100 - percent)
    sizes = F.least("n", "o_n") * 100 >= F.greatest("n", "o_n") * percent
    same = F.zip_with("bands", "o_bands", lambda x, y: x == y)
    here = (F.array_position(same, True) == F.col("band") + 1) & F.array_contains(F.slice(same, collections + 1, collections), True)
    cheap = (F.col("node") < F.col("o_node")) & (F.col("component") != F.col("o_component")) & sizes & close
    return left.join(right, ["band", "value"]).where(F.when(cheap, here).otherwise(False)).select(F.col("node").alias("a"), F.col("o_node").alias("b"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked``: pairs compared on their full sets."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", (both * 100 >= (F.col("n_a") + F.col("n_b") - both) * percent).alias("linked"))


def near_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, collections: int = 12, rows: int = 3, rounds: int = 3
) -> DataFrame:
    """One row per input row: ``id_col, n_shingles, component_id, kept``.

    Documents are linked where 100 * intersection >= ``percent`` * union of their sets of distinct ``shingle``-word shingles, counted
    on the full sets; ``component_id`` is the smallest id reachable over links, ``kept`` says that it is the row's own.
    Words are runs of bytes other than ASCII white space, with A-Z as a-z; a text of fewer words has its whole sequence as
    its one shingle. Null and empty texts and those without words have no shingles and are linked with nothing.
    Rows with a null id are linked with nothing, have a null component and stay. Rows that share an id
    share its component. An empty table gives an empty result; other columns are not read.

    Two documents of similarity s share a table key with probability (1 - (1 - s**rows)**collections)**2: 0.9996 at 0.8 and more
    above, with 12 collections of 3 MinHashes on each side. Equal sets are one node, so copies make no pairs.
    """
    made = materialise(sketches(df, id_col, text_col, shingle, collections, rows))
    counted = made.where("doc IS NOT NULL AND n > 0")
    nodes = counted.groupBy("f1", "f2").agg(F.min("doc").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    parts = near_links(nodes.select("node", "n", "bands"), lambda wanted: shingle_arrays(df, id_col, text_col, shingle, wanted), percent, collections, rounds)
    where = counted.groupBy("f1", "f2").agg(F.min("doc").alias("node")).join(parts, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("component"))
    linked = made.select("doc", "n", "f1", "f2").join(where, ["f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc")).otherwise(F.col("doc"))
    component = F.when(F.col("doc").isNotNull(), component)
    return linked.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))
