"""Near duplicates by circulant MinHash, confirmed on full shingle sets.

One permutation places every shingle of a document on a circle, a second one gives each place a
value; coordinate k of the signature is the least value k places on from the document's shingles. So
all coordinates of a shingle are one contiguous slice of the second permutation.

Documents with equal sets form a class, and classes take the place of documents. Signatures are cut
into bands; classes that agree in a band meet at the least class there, the hub. A hub's group holds
each class once, whatever the number of bands, and holds every two classes that share a band. In a
group, pairs whose signatures agree well enough are compared on full sets; a pair already connected
need not be. Large groups are cut into tiles, one for every two parts, so that no pair is lost and no
task holds more than two parts. Links found are a spanning forest; components follow from them.

``ROWS`` equal coordinates in one of ``BANDS`` bands: a pair at the threshold is missed with a chance
of about 1e-6, one at 0.8 with less than 1e-8.

A document without words, or a null text, has an empty set and is linked with nothing. Fewer than five
words make one shingle. A null id counts as larger than all ids; its rows have a null component unless
they are linked with a row that has an id. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, blocks, checkpoint, flat, frugal, held, map_arrow
from .components import components
from .shingles import mix, shingle_rows, words

ROWS = 5
BANDS = 50
COORDINATES = ROWS * BANDS
CIRCLE = 1 << 20
#: Similarity in percent.
LEAST = 75
#: Equal coordinates, of all, that a pair at the threshold has but for a chance of about 1e-7.
AGREE = 150
#: Classes, and shingles, of one hub in one part; a tile holds two parts.
TILE = 2048
TILE_SHINGLES = 2 << 20
_LAST_ID = (1 << 63) - 1


def _circle() -> np.ndarray:
    return held("circle", _new_circle)


def _new_circle() -> np.ndarray:
    values = np.random.default_rng(20).permutation(CIRCLE).astype(np.uint32)
    around = np.concatenate([values, values[:COORDINATES]])
    return np.lib.stride_tricks.sliding_window_view(around, COORDINATES)


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates of one set."""
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    place = (mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(CIRCLE)).astype(np.int64)
    for at in range(0, len(place), 256):
        np.minimum(out, _circle()[place[at : at + 256]].min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each signature (rows); band j has coordinates j, j + BANDS, ..."""
    cells = signatures.reshape(len(signatures), ROWS, BANDS).astype(np.uint64)
    weights = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    sums = (cells * weights[None, :, None]).sum(axis=1, dtype=np.uint64)
    return mix(sums * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64))


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    a = shingles.sum(dtype=np.uint64) + np.uint64(len(shingles))
    b = mix(shingles).sum(dtype=np.uint64)
    return np.array([a, b], np.uint64).tobytes()


def _sets(texts: pa.Array):
    data, offsets = flat(texts)
    for a, b in blocks(offsets):
        found, upto = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield a, b, shingle_rows(found, upto)


def set_keys(df: DataFrame, keep: list[str], text_col: str = "text", bands: bool = False) -> DataFrame:
    """Columns ``keep`` and __n (distinct shingles), __set (null if none), with ``bands`` also __bands."""
    chosen = df.select(*keep, F.col(text_col).alias("__text"))
    types = {f.name: f.dataType.simpleString() for f in chosen.schema.fields}
    n_kept = len(keep)

    def run(batch: pa.RecordBatch):
        sizes, keys, rows = [], [], []
        for _, _, sets in _sets(batch.column(n_kept)):
            sizes += [len(s) for s in sets]
            keys += [set_key(s) if len(s) else None for s in sets]
            if bands:
                rows.append(np.stack([signature(s) for s in sets]))
        columns = [*batch.columns[:n_kept], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())]
        if bands:
            found = band_keys(np.concatenate(rows)).view(np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), BANDS)
            columns.append(lists.cast(pa.list_(pa.int64())))
        names = [*batch.schema.names[:n_kept], "__n", "__set"] + ["__bands"] * bands
        yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "".join(f"`{c}` {types[c]}, " for c in keep) + "__n long, __set binary"
    return map_arrow(chosen, run, schema + (", __bands array<long>" if bands else ""))


def _classes(df: DataFrame) -> DataFrame:
    """(node, __id, __n, __set, __bands): the distinct non-empty sets with their least id."""
    rows = set_keys(df, ["__id"], "__text", bands=True).where("__n > 0")
    found = rows.groupBy("__set").agg(
        F.min("__id").alias("__id"), F.first("__n").alias("__n"), F.first("__bands").alias("__bands")
    )
    return checkpoint(found.withColumn("node", F.monotonically_increasing_id()))


def _groups(classes: DataFrame) -> DataFrame:
    """(node, hubs): the hubs a class meets, at most one a band, each with its number of parts."""
    banded = classes.select("node", F.explode("__bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = checkpoint(banded.join(hubs, "key").select("hub", "node").distinct())
    sized = members.join(classes.select("node", "__n"), "node")
    share = F.greatest(F.count("*") / TILE, F.sum("__n") / TILE_SHINGLES)
    # Written, so that the join with it is between two plain exchanges, which Spark can split at a large hub.
    parts = checkpoint(sized.groupBy("hub").agg(F.ceil(share).cast("int").alias("parts")))
    return (
        members.join(parts, "hub")
        .groupBy("node")
        .agg(F.collect_list(F.struct("hub", "parts")).alias("hubs"))
    )


def _dealt_sets(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """(hub, i, j, part, node, shingles): each wanted class's set, for each tile of each of its hubs."""
    rows = df.join(wanted, "__id").select("__text", "__set", "node", "hubs")

    def run(batch: pa.RecordBatch):
        expected = batch.column(1).to_pylist()
        nodes, hubs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for a, _, sets in _sets(batch.column(0)):
            out = {c: [] for c in ("hub", "i", "j", "part", "node", "row")}
            kept = []
            for k, shingles in enumerate(sets, a):
                if not len(shingles) or set_key(shingles) != expected[k]:
                    continue  # another text under a repeated id
                for hub in hubs[k]:
                    part = int(mix(np.array([nodes[k]], np.uint64))[0] % np.uint64(hub["parts"]))
                    for other in range(hub["parts"]):
                        out["hub"].append(hub["hub"])
                        out["i"].append(min(part, other))
                        out["j"].append(max(part, other))
                        out["part"].append(part)
                        out["node"].append(nodes[k])
                        kept.append(shingles)
            if kept:
                flat_sets = np.concatenate(kept)
                ends = np.concatenate([[0], np.cumsum([8 * len(s) for s in kept])])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out["hub"], pa.int64()),
                        *(pa.array(out[c], pa.int32()) for c in ("i", "j", "part")),
                        pa.array(out["node"], pa.int64()),
                        binary(flat_sets, ends),
                    ],
                    names=["hub", "i", "j", "part", "node", "shingles"],
                )

    return map_arrow(rows, run, "hub long, i int, j int, part int, node long, shingles binary")


def similar(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> bool:
    """Whether two ascending sets reach the similarity."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= least * (len(both) - common)


def _links(table: pa.Table) -> pa.Table:
    """A spanning forest of the links of one tile."""
    frugal()
    column = table.column("node").to_numpy()
    node, first = np.unique(column, return_index=True)
    part = table.column("part").to_numpy()[first]
    raw = table.column("shingles")
    sets = [np.frombuffer(raw[int(k)].as_py(), np.uint64) for k in first]
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    node, part, size = node[order], part[order], size[order]
    sets = [sets[k] for k in order]
    tags = np.stack([signature(s) for s in sets]).astype(np.uint8)
    crossing = table.column("i")[0].as_py() != table.column("j")[0].as_py()
    root = np.arange(len(node))
    edges: list[tuple[int, int]] = []
    for k in range(len(node)):
        # Ascending sizes: only larger sets up to the bound can be similar.
        end = int(np.searchsorted(size, size[k] * 100 // LEAST, side="right"))
        later = np.arange(k + 1, end)
        later = later[root[later] != root[k]]
        if crossing:
            later = later[part[later] != part[k]]
        if not len(later):
            continue
        agree = (tags[later] == tags[k]).sum(axis=1)
        hopeful = later[agree >= AGREE]
        for m in hopeful[np.argsort(-agree[agree >= AGREE], kind="stable")].tolist():
            if root[m] != root[k] and similar(sets[k], sets[m]):
                edges.append((int(node[k]), int(node[m])))
                root[root == root[m]] = root[k]
    return pa.table(
        {
            "a": pa.array([a for a, _ in edges], pa.int64()),
            "b": pa.array([b for _, b in edges], pa.int64()),
        }
    )


def _judged(df: DataFrame, columns: list[str], id_col: str, text_col: str) -> DataFrame:
    """Columns and __id, __n, __set, __component of every row."""
    docs = df.select(
        *columns,
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)).alias("__id"),
        F.col(text_col).alias("__text"),
    )
    classes = _classes(docs)
    wanted = _groups(classes).join(classes.select("node", "__id", "__set"), "node")
    tiles = _dealt_sets(docs, wanted).groupBy("hub", "i", "j")
    found = components(tiles.applyInArrow(_links, "a long, b long"))
    named = found.join(classes.select(F.col("node").alias("vertex"), "__id"), "vertex")
    least = named.groupBy("root").agg(F.min("__id").alias("__least"))
    linked = found.join(least, "root").select(F.col("vertex").alias("node"), "__least")
    of_set = classes.join(linked, "node", "left").select(
        "__set", F.coalesce("__least", "__id").alias("__least")
    )
    rows = set_keys(docs, [*columns, "__id"], "__text").join(of_set, "__set", "left")
    component = F.when(F.col("__n") == 0, F.col("__id")).otherwise(F.col("__least"))
    return rows.withColumn("__component", component).drop("__least")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (least id reachable) and kept (it is the row's own)."""
    rows = _judged(df, [], id_col, text_col)

    def shown(c):
        return F.when(F.col(c) < _LAST_ID, F.col(c))

    return rows.select(
        shown("__id").alias(id_col),
        F.col("__n").alias("n_shingles"),
        shown("__component").alias("component_id"),
        (F.col("__id") == F.col("__component")).alias("kept"),
    )


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, unchanged, of one document of each group: the one with the least id.

    Of repeated rows of that document one stays. Rows without words all stay.
    """
    rows = _judged(df, df.columns, id_col, text_col).where("__id = __component")
    one = rows.where("__n > 0").dropDuplicates(["__set", "__id"])
    return one.select(df.columns).unionByName(rows.where("__n = 0").select(df.columns))
