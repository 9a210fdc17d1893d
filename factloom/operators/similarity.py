"""Set similarity over features(doc, feature): document frequencies, weights, joins by inverted index, best match and margin.

Nothing here compares all pairs: candidates share a feature, and features that very many documents have can be left out by
their document frequency, which is also what keeps a hot feature from skewing the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from factloom.session import written

#: Pairs that a feature may make one by one; beyond, SPAN documents of a side meet as many of the other at once, all features together.
HOT_PAIRS, SPAN = 1 << 14, 512
#: Blocks of a side, if it has documents for them: more only where a block would hold more than HELD features of documents. Rare pairs at a time.
EDGE, HELD, RARE = 8, 1 << 22, 1 << 21


def document_frequency(features: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """(feature, df): insertions, as the features come; give distinct rows to count documents."""
    return features.groupBy(*by).agg(F.count(F.lit(1)).alias("df"))


def idf(df: DataFrame, total: Column, clamped: bool = True) -> DataFrame:
    weight = F.log(total / F.col("df"))
    return df.withColumn("weight", F.greatest(weight, F.lit(0.0)) if clamped else weight)


def rare_only(features: DataFrame, df: DataFrame, most: int) -> DataFrame:
    return features.join(df.filter(F.col("df") <= most).select("feature"), "feature", "left_semi")


def set_similarity(left: DataFrame, right: DataFrame, weight: str | None = None) -> DataFrame:
    """(left, right, shared, left_size, right_size, jaccard, overlap, containment) of pairs with a common feature.

    left and right have (doc, feature) rows, each once; with `weight`, a column of both, sizes and what is shared are sums of it.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    sizes = lambda df, name: df.groupBy("doc").agg(F.sum(w).alias(f"{name}_size")).withColumnRenamed("doc", name)
    l_rows = left.select(F.col("doc").alias("left"), "feature", w.alias("_w"))
    shared = l_rows.join(right.select(F.col("doc").alias("right"), "feature"), "feature").groupBy("left", "right").agg(F.sum("_w").alias("shared"))
    out = shared.join(sizes(left, "left"), "left").join(sizes(right, "right"), "right")
    union = F.col("left_size") + F.col("right_size") - F.col("shared")
    ratio = lambda a, b: F.when(b <= 0, 0.0).otherwise(a / b)
    return out.select("*", ratio(F.col("shared"), union).alias("jaccard"), ratio(F.col("shared"), F.least("left_size", "right_size")).alias("overlap"), ratio(F.col("shared"), F.col("left_size")).alias("containment"))


def best_two(scored: DataFrame, key: str, candidate: str, score: str) -> DataFrame:
    """(key, best, score, runner_up, margin, tied): the best candidate of each key, on ties the least; margin is clamped to 0..1."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(candidate))
    rows = scored.withColumn("_n", F.row_number().over(w)).withColumn("runner_up", F.lead(score).over(w))
    margin = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score) - F.coalesce("runner_up", F.lit(0.0))))
    return rows.filter("_n = 1").select(key, F.col(candidate).alias("best"), score, "runner_up", margin.alias("margin"), F.coalesce(F.col(score) == F.col("runner_up"), F.lit(False)).alias("tied"))


def verdict(score: Column, margin: Column, candidates: Column | None = None, floor: float = 0.0) -> Column:
    """accepted, caveat or ambiguous by margin (0.3 and 0.1); a single candidate is accepted; below the floor there is no match."""
    out = F.when(score < floor, "no_match")
    if candidates is not None:
        out = out.when(candidates == 1, "accepted")
    return out.when(margin >= 0.3, "accepted").when(margin >= 0.1, "caveat").otherwise("ambiguous")


def top_k(scored: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def reciprocal_best(scored: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Pairs that are each other's best, ties going to the least partner."""
    by_left = F.row_number().over(Window.partitionBy(left).orderBy(F.col(score).desc(), F.col(right)))
    by_right = F.row_number().over(Window.partitionBy(right).orderBy(F.col(score).desc(), F.col(left)))
    return scored.withColumn("_l", by_left).withColumn("_r", by_right).filter("_l = 1 and _r = 1").drop("_l", "_r")


def anchor_pins(left: DataFrame, right: DataFrame, most: int = 4) -> DataFrame:
    """(left, right, shared): by rare features alone, those that at most `most` documents on the right hold; the pair with most of them wins."""
    rare = rare_only(right, document_frequency(right), most)
    shared = left.select(F.col("doc").alias("left"), "feature").join(rare.select(F.col("doc").alias("right"), "feature"), "feature").groupBy("left", "right").agg(F.count(F.lit(1)).alias("shared"))
    return top_k(shared, "left", [F.col("shared").desc(), F.col("right")], 1).drop("rank")


def idf_anchor_join(left: DataFrame, right: DataFrame, total: Column, max_df: int = 24, least_shared: int = 2, least_weight: float = 4.0, least_margin: float = 2.0) -> DataFrame:
    """(left, right, shared, weight, margin) where common anchors are rare, several, heavy, and clearly more than the runner-up's."""
    df = document_frequency(right).filter(F.col("df") <= max_df)
    weighted = right.join(idf(df, total), "feature").select(F.col("doc").alias("right"), "feature", "weight")
    met = left.select(F.col("doc").alias("left"), "feature").join(weighted, "feature").groupBy("left", "right").agg(F.count(F.lit(1)).alias("shared"), F.sum("weight").alias("weight"))
    w = Window.partitionBy("left").orderBy(F.col("weight").desc(), F.col("right"))
    rows = met.withColumn("_n", F.row_number().over(w)).withColumn("margin", F.col("weight") - F.coalesce(F.lead("weight").over(w), F.lit(0.0)))
    return rows.filter((F.col("_n") == 1) & (F.col("shared") >= least_shared) & (F.col("weight") >= least_weight) & (F.col("margin") >= least_margin)).drop("_n")


def cosine_join(left: DataFrame, right: DataFrame, candidates: DataFrame) -> DataFrame:
    """(left, right, cosine) of candidate pairs; left and right hold sparse vectors as (doc, feature, n)."""
    norm = lambda df, name: df.groupBy("doc").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias(f"{name}_norm")).withColumnRenamed("doc", name)
    dots = (
        candidates.select("left", "right").distinct()
        .join(left.select(F.col("doc").alias("left"), "feature", F.col("n").alias("ln")), "left")
        .join(right.select(F.col("doc").alias("right"), "feature", F.col("n").alias("rn")), ["right", "feature"])
        .groupBy("left", "right").agg(F.sum(F.col("ln") * F.col("rn")).alias("dot"))
    )
    out = dots.join(norm(left, "left"), "left").join(norm(right, "right"), "right")
    return out.select("left", "right", F.when(F.col("left_norm") * F.col("right_norm") == 0, 0.0).otherwise(F.col("dot") / (F.col("left_norm") * F.col("right_norm"))).alias("cosine"))


def multi_axis(left: DataFrame, right: DataFrame, total: Column, measure: str = "jaccard", combine: str = "mean", sizes: DataFrame | None = None) -> DataFrame:
    """(left, right, score): IDF-weighted similarity on each axis of (doc, axis, feature), combined by max, mean or agreement (the share of axes at 0.5 or more)."""
    df = right.groupBy("axis", "feature").agg(F.count(F.lit(1)).alias("df"))
    weights = idf(df, total).select("axis", "feature", "weight")
    l, r = (x.join(weights, ["axis", "feature"], "left").withColumn("weight", F.coalesce("weight", F.log(total))) for x in (left, right))
    mass = lambda x, name: x.groupBy("doc", "axis").agg(F.sum("weight").alias(f"{name}_mass")).withColumnRenamed("doc", name)
    shared = l.select(F.col("doc").alias("left"), "axis", "feature", "weight").join(r.select(F.col("doc").alias("right"), "axis", "feature"), ["axis", "feature"]).groupBy("left", "right", "axis").agg(F.sum("weight").alias("shared"))
    each = shared.join(mass(l, "left"), ["left", "axis"]).join(mass(r, "right"), ["right", "axis"])
    below = F.col("left_mass") + F.col("right_mass") - F.col("shared") if measure == "jaccard" else F.least("left_mass", "right_mass")
    each = each.withColumn("sim", F.when(below <= 0, 0.0).otherwise(F.col("shared") / below))
    axes = l.select(F.col("doc").alias("left"), "axis").distinct().groupBy("left").agg(F.count(F.lit(1)).alias("axes"))
    total_by = {"max": F.max("sim"), "mean": F.sum("sim") / F.first("axes"), "agreement": F.sum((F.col("sim") >= 0.5).cast("double")) / F.first("axes")}[combine]
    out = each.join(axes, "left").groupBy("left", "right").agg(total_by.alias("score"))
    if sizes is not None:
        from factloom.functions.text import size_prior

        named = lambda name: sizes.select(F.col("doc").alias(name), F.col("size").alias(f"_{name}"))
        out = out.join(named("left"), "left").join(named("right"), "right").select("left", "right", (F.col("score") * size_prior(F.col("_left"), F.col("_right"))).alias("score"))
    return out


def source_evidence(left: DataFrame, right: DataFrame, hashes: DataFrame, total: Column, hot: int = HOT_PAIRS) -> DataFrame:
    """(left, right, same_source, score) from whole-text hashes (side, doc, hash) and the families of (doc, family, feature): overlap, Jaccard and containment of each, and IDF mass over the geometric mean of both.

    Rows may repeat. No pair is shuffled: documents of both sides fall into blocks, each block of the left meets each of the right in a cell, whose
    features travel packed. Features that make more than `hot` pairs are counted there by matrix products, the others pair by pair.
    """
    kinds = {"left": left.schema["doc"].dataType, "right": right.schema["doc"].dataType}
    rows = left.select("family", "feature", F.col("doc").alias("left"), F.lit(None).cast(kinds["right"]).alias("right"), F.lit(0).alias("_r"))
    rows = rows.unionByName(right.select("family", "feature", F.lit(None).cast(kinds["left"]).alias("left"), F.col("doc").alias("right"), F.lit(1).alias("_r")))
    void = F.max(((F.col("_r") == 1) & F.col("right").isNull()).cast("long"))  # a document without id counts, but has no pairs
    features = rows.groupBy("family", "feature").agg(F.collect_set("left").alias("left"), F.collect_set("right").alias("right"), void.alias("_void"))
    df = F.when(F.col("feature").isNotNull() & F.col("family").isNotNull(), F.size("right") + F.col("_void"))
    weight = F.when(df > 0, F.greatest(F.log(total / df), F.lit(0.0))).otherwise(F.log(total))
    features = written(features.select("family", df.isNotNull().alias("known"), (weight * weight).alias("square"), "left", "right"))

    def documents(side: str) -> DataFrame:
        each = features.select("family", "square", F.explode(side).alias("doc")).groupBy("doc", "family").agg(F.count(F.lit(1)).alias("n"), F.sum("square").alias("mass"))
        each = each.groupBy("doc").agg(F.collect_list(F.struct("family", "n", "mass")).alias("sizes"))
        known = hashes.filter(F.col("side") == side).groupBy("doc").agg(F.collect_list(F.struct("hash")).alias("hashes"))
        return written(each.join(known, "doc", "left"))

    docs = {side: documents(side) for side in kinds}
    held = features.filter("known and size(left) > 0 and size(right) > 0")
    counts = held.agg(*[F.coalesce(F.sum(F.size(side).cast("long")), F.lit(0)).alias(side) for side in kinds]).first()
    blocks = {side: max(min(EDGE, 1 + docs[side].count() // SPAN), -(-counts[side] // HELD)) for side in kinds}
    block = lambda side: lambda doc: F.pmod(F.xxhash64(doc), F.lit(blocks[side])).cast("int")
    cells = StructType([
        StructField("cell", IntegerType()), StructField("left", ArrayType(kinds["left"])), StructField("right", ArrayType(kinds["right"])),
        StructField("families", ArrayType(features.schema["family"].dataType)), StructField("squares", ArrayType(DoubleType())), StructField("often", ArrayType(BooleanType())),
        StructField("n", LongType()), *[StructField(c, BinaryType()) for c in PACKED],
        StructField("hashes", ArrayType(hashes.schema["hash"].dataType)), StructField("sizes", ArrayType(LongType())),
    ])
    often = F.size("left").cast("long") * F.size("right") > hot
    packed = held.select("family", "square", often.alias("often"), "left", "right", *[F.transform(side, block(side)).alias(f"{side}_block") for side in kinds])
    shape, packed_schema = (blocks["left"], blocks["right"]), to_arrow_schema(cells)
    packed = packed.mapInArrow(lambda batches: _pack(batches, shape, packed_schema), cells)

    def placed(side: str) -> DataFrame:
        """Each document of a side, with its sizes, in all cells of its block."""
        here, other, wide = block(side)("doc"), "right" if side == "left" else "left", F.lit(blocks["right"])
        met = F.explode(F.sequence(F.lit(0), F.lit(blocks[other] - 1)))
        out = docs[side].select("*", met.alias("_b")).withColumn("cell", here * wide + F.col("_b") if side == "left" else F.col("_b") * wide + here)
        own = {"cell": F.col("cell"), side: F.array("doc"), "families": F.col("sizes.family"), "squares": F.col("sizes.mass"), "sizes": F.col("sizes.n"), "hashes": F.col("hashes.hash")}
        return out.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in cells])

    every = packed.unionByName(placed("left")).unionByName(placed("right")).repartitionById(blocks["left"] * blocks["right"], "cell")
    pairs = StructType([StructField("left", kinds["left"]), StructField("right", kinds["right"]), StructField("same_source", BooleanType()), StructField("score", DoubleType())])
    span, pairs_schema = SPAN, to_arrow_schema(pairs)
    return every.mapInArrow(lambda batches: _evidence(batches, span, pairs_schema), pairs)


#: Columns of a packed part of a cell: how many documents of a side have each feature, which ones, and each feature's kind.
PACKED = ("left_counts", "left_codes", "right_counts", "right_codes", "features")


def _small(x: np.ndarray) -> bytes:
    return pa.Codec("zstd").compress(x.astype(np.uint32).tobytes(), asbytes=True)


def _unpacked(column: pa.ChunkedArray, n: list[int]) -> list[np.ndarray]:
    return [np.frombuffer(pa.Codec("zstd").decompress(x.as_py(), 4 * k, asbytes=True), np.uint32) for x, k in zip(column, n)]


def _pack(batches: Iterator[pa.RecordBatch], blocks: tuple[int, int], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """For each cell of blocks, the features that both its sides have, packed."""
    kept, size = [], 0
    for batch in batches:
        kept.append(batch)
        size += sum(pc.sum(pc.list_value_length(batch[c])).as_py() or 0 for c in ("left", "right"))
        if size >= HELD // 4:
            yield from _packed(pa.Table.from_batches(kept), blocks, schema)
            kept, size = [], 0
    if size:
        yield from _packed(pa.Table.from_batches(kept), blocks, schema)


def _packed(table: pa.Table, blocks: tuple[int, int], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    table = table.combine_chunks()
    family = table["family"].combine_chunks().dictionary_encode()
    square, of_square = np.unique(table["square"].to_numpy(), return_inverse=True)
    kind = (family.indices.to_numpy() * len(square) + of_square) * 2 + table["often"].to_numpy()
    kind, of_kind = np.unique(kind, return_inverse=True)
    of = {}
    for side, n in zip(("left", "right"), blocks):
        lists = table[side].combine_chunks()
        feature = np.repeat(np.arange(len(table), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        at, codes = table[f"{side}_block"].combine_chunks().flatten().to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        for b in range(n):
            mine = np.flatnonzero(at == b)
            of[side, b] = feature[mine], codes[mine], np.bincount(feature[mine], minlength=len(table)), coded.dictionary
    for i in range(blocks[0]):
        for j in range(blocks[1]):
            met = (of["left", i][2] > 0) & (of["right", j][2] > 0)
            if not met.any():
                continue
            row = dict.fromkeys(schema.names) | {"cell": i * blocks[1] + j, "n": int(met.sum()), "features": _small(of_kind[met])}
            row |= {"families": family.dictionary.take(pa.array(kind // 2 // len(square))), "squares": square[kind // 2 % len(square)], "often": kind % 2 > 0}
            for side, b in (("left", i), ("right", j)):
                feature, codes, counts, docs = of[side, b]
                codes = codes[met[feature]]
                here = np.zeros(len(docs), bool)
                here[codes] = True
                row |= {side: docs.take(pa.array(np.flatnonzero(here))), f"{side}_counts": _small(counts[met]), f"{side}_codes": _small((np.cumsum(here) - 1)[codes])}
            yield pa.record_batch([_one(row[f.name], f.type) for f in schema], schema=schema)


def _one(x: object, kind: pa.DataType) -> pa.Array:
    """A column of one row, of lists where its type is."""
    if x is None or not pa.types.is_list(kind):
        return pa.array([x], kind)
    x = x if isinstance(x, pa.Array) else pa.array(x)
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(kind.value_type)).cast(kind)


def _evidence(batches: Iterator[pa.RecordBatch], span: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The scores of all pairs of each cell that share a feature."""
    kept = list(batches)
    if kept:
        table = pa.Table.from_batches(kept)
        kept.clear()
        for cell in pc.unique(table["cell"]).to_pylist():
            yield from _cell(table.filter(pc.equal(table["cell"], cell)), span, schema)


def _cell(table: pa.Table, span: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    parts, docs = table.filter(table["n"].is_valid()), table.filter(table["n"].is_null())
    sides = {side: docs.filter(docs[side].is_valid()) for side in ("left", "right")}
    if not len(parts):
        return
    names = sorted({x for side in [parts, *sides.values()] for x in pc.unique(side["families"].combine_chunks().flatten()).to_pylist() if x is not None})
    place = lambda lists: pc.index_in(lists, pa.array(names, lists.type)).fill_null(-1).to_numpy(zero_copy_only=False)
    value, count, mass, entry, told = {}, {}, {}, {}, {}
    for side, x in sides.items():
        value[side] = x[side].combine_chunks().flatten()
        count[side], mass[side] = np.zeros((len(names), len(x))), np.zeros((len(names), len(x)))
        lists = x["families"].combine_chunks()
        at, doc = place(lists.flatten()), np.repeat(np.arange(len(x)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        count[side][at[at >= 0], doc[at >= 0]] = x["sizes"].combine_chunks().flatten().to_numpy(zero_copy_only=False)[at >= 0]
        mass[side][at[at >= 0], doc[at >= 0]] = x["squares"].combine_chunks().flatten().to_numpy(zero_copy_only=False)[at >= 0]
        # A document may have several hashes, and then has as many rows; one without has one.
        many = pc.list_value_length(x["hashes"].combine_chunks()).fill_null(0).to_numpy(zero_copy_only=False)
        entry[side] = np.repeat(np.arange(len(x)), np.maximum(many, 1))
        told[side] = np.repeat(many > 0, np.maximum(many, 1)), x["hashes"].combine_chunks().flatten()
    both = pa.chunked_array([told["left"][1], told["right"][1].cast(told["left"][1].type)]).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    source = {}
    for side, codes in (("left", both[: len(told["left"][1])]), ("right", both[len(told["left"][1]) :])):
        source[side] = np.full(len(entry[side]), -1)
        source[side][told[side][0]] = codes
    n = parts["n"].to_pylist()
    held = {side: _unpacked(parts[f"{side}_counts"], n) for side in sides}
    family, square, often = [], [], []
    for k, x in enumerate(_unpacked(parts["features"], n)):
        family.append(place(parts["families"][k].values)[x].astype(np.int16))
        square.append(parts["squares"][k].values.to_numpy()[x])
        often.append(parts["often"][k].values.to_numpy(zero_copy_only=False)[x])
    family, square, often = map(np.concatenate, (family, square, often))
    feature, doc, counts = {}, {}, {}
    for side in sides:
        codes = _unpacked(parts[f"{side}_codes"], [int(x.sum()) for x in held[side]])
        doc[side] = np.concatenate([pc.index_in(parts[side][k].values, value[side]).to_numpy()[x].astype(np.int32) for k, x in enumerate(codes)])
        counts[side] = np.concatenate(held[side]).astype(np.int64)
        feature[side] = np.repeat(np.arange(len(family), dtype=np.int32), counts[side])
    del held, codes, table, parts, docs, sides
    pa.default_memory_pool().release_unused()

    # Often: places among the often features of their family, by document. Rare: documents on the right by feature, on the left by document.
    families = range(len(names))
    width, spot = [0] * len(names), np.zeros(len(family), np.int32)
    for f in families:
        mine = np.flatnonzero(often & (family == f))
        width[f], spot[mine] = len(mine), np.arange(len(mine))
    weights = [square[often & (family == f)] for f in families]
    dense = {}
    for side in feature:
        for f in families:
            mine = np.flatnonzero(often[feature[side]] & (family[feature[side]] == f))
            mine = mine[np.argsort(doc[side][mine], kind="stable")]
            dense[side, f] = doc[side][mine], spot[feature[side][mine]]
    from_right, partners = np.cumsum(counts["right"]) - counts["right"], doc["right"]
    mine = np.flatnonzero(~often[feature["left"]])
    mine = mine[np.argsort(doc["left"][mine], kind="stable")]
    rare_doc, rare = doc["left"][mine], feature["left"][mine]
    del mine, feature, doc
    lefts, rights = len(value["left"]), len(value["right"])
    # Groups of documents on the left that make no more than so many rare pairs.
    made = np.concatenate([[0], np.cumsum(np.bincount(rare_doc, counts["right"][rare], lefts))])
    i0 = 0
    while i0 < lefts:
        i1 = int(min(i0 + span, lefts, max(i0 + 1, np.searchsorted(made, made[i0] + RARE, "right") - 1)))
        ni = i1 - i0
        lo, hi = np.searchsorted(rare_doc, [i0, i1])
        met = {}
        for f in families:
            mine = lo + np.flatnonzero(family[rare[lo:hi]] == f)
            many = counts["right"][rare[mine]]
            at = np.repeat(from_right[rare[mine]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            j, i, w = partners[at], np.repeat((rare_doc[mine] - i0).astype(np.int32), many), np.repeat(square[rare[mine]], many)
            order = np.argsort((j // span).astype(np.uint16) if rights < span << 16 else j // span, kind="stable")
            met[f] = i[order], j[order], w[order]
        bounds = {f: np.searchsorted(met[f][1] // span, np.arange(rights // span + 2)) for f in families}
        spread = {}
        for f in families:
            if width[f]:
                d, s = dense["left", f]
                a, b = np.searchsorted(d, [i0, i1])
                spread[f] = d[a:b] - i0, s[a:b]
        for tile, j0 in enumerate(range(0, rights, span)):
            j1 = min(j0 + span, rights)
            nj = j1 - j0
            score, seen = np.zeros(ni * nj), np.zeros(ni * nj, bool)
            for f in families:
                a, b = bounds[f][tile], bounds[f][tile + 1]
                i, j, w = (x[a:b] for x in met[f])
                if not width[f] and not len(i):
                    continue
                at = i.astype(np.int64) * nj + (j - j0)
                common, both = np.bincount(at, minlength=ni * nj), np.bincount(at, w, ni * nj)
                if width[f]:
                    more, heavier = _products(spread[f], dense["right", f], (j0, j1), (ni, nj), weights[f])
                    common, both = (common + more).reshape(ni, nj), both if heavier is None else both + heavier
                    x, y = count["left"][f, i0:i1, None], count["right"][f, None, j0:j1]
                    middle = np.sqrt(mass["left"][f, i0:i1, None] * mass["right"][f, None, j0:j1])
                    score += _measures(common, both.reshape(ni, nj), x, y, middle).ravel()
                    seen |= common.ravel() > 0
                else:
                    at = np.flatnonzero(common)
                    i, j = i0 + at // nj, j0 + at % nj
                    score[at] += _measures(common[at], both[at], count["left"][f, i], count["right"][f, j], np.sqrt(mass["left"][f, i] * mass["right"][f, j]))
                    seen[at] = True
            score, seen = score.reshape(ni, nj), seen.reshape(ni, nj)
            (la, lb), (ra, rb) = (np.searchsorted(entry[side], x) for side, x in (("left", [i0, i1]), ("right", [j0, j1])))
            if lb - la != ni or rb - ra != nj:
                grid = np.ix_(entry["left"][la:lb] - i0, entry["right"][ra:rb] - j0)
                score, seen = score[grid], seen[grid]
            x, y = source["left"][la:lb, None], source["right"][None, ra:rb]
            same = (x == y) & (x >= 0)
            if seen.all():
                i, j = np.repeat(entry["left"][la:lb], rb - ra), np.tile(entry["right"][ra:rb], lb - la)
                score, same = score.ravel(), same.ravel()
            else:
                i, j = np.nonzero(seen)
                score, same = score[i, j], same[i, j]
                i, j = entry["left"][la + i], entry["right"][ra + j]
            if len(i):
                yield pa.record_batch([value["left"].take(pa.array(i)), value["right"].take(pa.array(j)), pa.array(same), pa.array(score)], schema=schema)
        i0 = i1


def _products(left: tuple, right: tuple, js: tuple[int, int], shape: tuple[int, int], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """How many often features each pair of two groups of documents shares, and the sum of their weights, if any has one."""
    (ld, ls), (rd, rs) = left, right
    a, b = np.searchsorted(rd, js)
    rd, rs = rd[a:b] - js[0], rs[a:b]
    common, both = np.zeros(shape, np.float32), None
    for start in range(0, len(weights), 4096):
        stop = min(start + 4096, len(weights))
        x, y = np.zeros((shape[0], stop - start), np.float32), np.zeros((shape[1], stop - start), np.float32)
        here, there = (ls >= start) & (ls < stop), (rs >= start) & (rs < stop)
        x[ld[here], ls[here] - start] = 1
        y[rd[there], rs[there] - start] = 1
        common += x @ y.T
        heavy = weights[start:stop] > 0
        if heavy.any():
            each = (x[:, heavy] * weights[start:stop][heavy]) @ y[:, heavy].T.astype(np.float64)
            both = each if both is None else both + each
    return common.ravel(), None if both is None else both.ravel()


def _measures(common: np.ndarray, both: np.ndarray, a: np.ndarray, b: np.ndarray, middle: np.ndarray) -> np.ndarray:
    common = common.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        each = (common / np.minimum(a, b) + common / (a + b - common) + common / a + np.where(middle > 0, both / middle, 0.0)) / 4
    return np.where(common > 0, each, 0.0)


def sequence_windows(tokens: Column, width: int) -> Column:
    """Windows of `width` tokens joined by spaces; none for shorter sequences."""
    n = F.size(tokens)
    return F.when(n < width, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, width), " ")))
