"""Search, injection, listings and ranked slots over memories. Every function is lazy and takes its time as an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import active, truncate, truncate_lines
from ..functions.vectors import composite_score, cosine
from ..sources.stages import staged


def _vector(query: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in query))


def scored(memories: DataFrame, query: list[float], as_of: Column, min_importance: int = 0, tier: str | None = None, context: str | None = None) -> DataFrame:
    """Active memories with similarity and score. Filters come first, so that only their rows are scored."""
    rows = memories.where(active(as_of) & (F.col("importance") >= min_importance) & F.col("embedding").isNotNull())
    if tier:
        rows = rows.where(F.col("tier") == tier)
    if context:
        rows = rows.where(F.col("context") == context)
    return rows.withColumn("similarity", cosine(F.col("embedding"), _vector(query))).withColumn("score", composite_score(F.col("similarity"), as_of))


def search(memories: DataFrame, query: list[float], as_of: Column, limit: int = 10, min_similarity: float = 0.3, **filters) -> DataFrame:
    """The best by score; the similarity cut comes after the limit, so fewer than `limit` may remain."""
    best = scored(memories, query, as_of, **filters).orderBy(F.desc("score"), F.desc("similarity"), "id").limit(limit)
    return best.where(F.col("similarity") >= min_similarity)


def inject(memories: DataFrame, query: list[float], as_of: Column, limit: int = 10, min_similarity: float = 0.15, min_score: float = 0.25, min_importance: int = 0) -> DataFrame:
    """Hot results before warm ones, each id once, cut to the limit and only then to the least score. pos is the order."""
    parts = [search(memories, query, as_of, limit, min_similarity, tier=t, min_importance=min_importance).withColumn("part", F.lit(i)) for i, t in enumerate(("hot", "warm"))]
    both = parts[0].unionByName(parts[1])
    first = both.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("part"))).where("n = 1").drop("n")
    order = Window.partitionBy(F.lit(0)).orderBy("part", F.desc("score"), F.desc("similarity"), "id")  # at most 2 * limit rows
    return first.withColumn("pos", F.row_number().over(order)).where((F.col("pos") <= limit) & (F.col("score") >= min_score)).drop("part")


def prompt_blocks(rows: DataFrame, per_item: int = 2000, lines: int = 80, total: int = 12000) -> DataFrame:
    """pos and block of what fits a prompt, in the order of pos: a running total cuts the first block that does not fit, and
    ends there. rows are bounded by the limit of the search that made them."""
    two = lambda c: F.format_string("%.2f", F.coalesce(F.col(c), F.lit(0.0)))
    meta = F.concat(
        F.lit("[sim:"), two("similarity"), F.lit(" score:"), two("score"), F.lit(" imp:"), F.col("importance").cast("string"), F.lit(" tier:"), F.col("tier"),
        F.lit(" type:"), F.col("type"), F.lit(" agent:"), F.coalesce("agent", F.lit("")), F.lit(" ctx:"), F.coalesce("context", F.lit("")), F.lit("]"),
    )
    body = truncate(truncate_lines(F.trim("content"), lines), per_item)
    order = Window.partitionBy(F.lit(0)).orderBy("pos")
    made = rows.select("pos", F.concat(meta, F.lit("\n"), body).alias("block"))
    made = made.withColumn("sep", F.when(F.row_number().over(order) > 1, F.lit("\n\n---\n\n")).otherwise(F.lit("")))
    size = F.length("sep") + F.length("block")
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(total) - F.col("before") - F.length("sep")
    made = made.withColumn("before", before).where((F.col("before") < total) & (left > 0))
    return made.select("pos", F.concat("sep", truncate_to(F.col("block"), left)).alias("block"))


def truncate_to(text: Column, n: Column) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, n - 1), F.lit("…"))).otherwise(text)


def prompt(rows: DataFrame, **limits) -> DataFrame:
    """One row: the whole prompt."""
    blocks = F.sort_array(F.collect_list(F.struct("pos", "block")))
    return prompt_blocks(rows, **limits).agg(F.array_join(F.transform(blocks, lambda b: b.block), "").alias("prompt"))


def listing(memories: DataFrame, type_: str, order: list[Column], limit: int = 30, status: str | None = None) -> DataFrame:
    rows = memories.where(active() & (F.col("type") == type_))
    if status:
        rows = rows.where(F.col("status") == status)
    return rows.orderBy(*order, "id").limit(limit)


def promote_candidates(patterns: DataFrame, memories: DataFrame, as_of: Column, min_recurrence: int = 3, days: int = 30, limit: int = 50) -> DataFrame:
    """Recurrent recent patterns with their representative memory; patterns are filtered before the join."""
    fresh = patterns.where((F.col("recurrence_count") >= min_recurrence) & (F.col("last_seen") >= as_of - F.make_dt_interval(F.lit(days))) & F.coalesce("last_status", F.lit("pending")).isin("pending", "in_progress"))
    names = memories.select(F.col("id").alias("representative_memory_id"), F.col("content").alias("representative_content"))
    return fresh.join(names, "representative_memory_id", "left").orderBy(F.desc("recurrence_count"), F.desc("impact_score"), F.desc("last_seen"), "pattern_key").limit(limit)


def neighbours(memories: DataFrame, threshold: float, k: int = 10, block: int = 2048) -> DataFrame:
    """id, other, similarity, rank: each active memory's k nearest above the threshold; ties go to the smaller id. Rows are
    packed into blocks, and pairs of blocks are multiplied as matrices; of a pair of blocks each memory yields k rows at most."""
    rows = memories.where(active() & F.col("embedding").isNotNull()).select("id", "embedding")
    return _ranked(_block_pairs(rows, threshold, block, k), k)


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """id (of the query), other, similarity, rank: the k nearest rows of each query (both: id, embedding), in blocks. Vectors of
    different lengths are unlike (0). ivf.nearest gives the same, approximately, from an index of rows."""
    return _ranked(_block_pairs(queries, -2.0, block, k, rows), k)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))).where(F.col("rank") <= k)


PACKED = "ids array<string>, m binary, sizes binary"


def packed(rows: DataFrame, block: int, by: str | None = None, kind: str = "int") -> DataFrame:
    """Rows (id, embedding) as blocks of at most `block`, one row each; with by (of that kind), rows of one block share it."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from ..functions.vectors import filled

    def pack(batches):
        for whole in batches:
            for g in pc.unique(whole.column(2)) if by is not None else [None]:
                rest = whole.filter(pc.equal(whole.column(2), g)) if by is not None else whole
                for at in range(0, len(rest), block):
                    b = rest.slice(at, block)
                    m, sizes = filled(b.column(1))
                    cols = {"ids": pa.array([b.column(0).to_pylist()], pa.list_(pa.string())), "m": pa.array([m.tobytes()], pa.binary()), "sizes": pa.array([sizes.tobytes()], pa.binary())}
                    yield pa.RecordBatch.from_pydict(cols | ({by: pa.array([g.as_py()], whole.column(2).type)} if by is not None else {}))

    return rows.select("id", "embedding", *([F.col(by).cast(kind).alias(by)] if by else [])).mapInArrow(pack, PACKED + (f", {by} {kind}" if by else ""))


STRIP = 256  # rows of a block that are multiplied at a time


def _sides(r: dict):
    """Of one row of met blocks: vectors, numbers of components, norms and ids of both sides."""
    import numpy as np

    out = []
    for side in "xy":
        sizes = np.frombuffer(r[f"{side}_sizes"], np.int64)
        m = np.frombuffer(r[f"{side}_m"]).reshape(len(sizes), -1)
        out.append((m, sizes, np.linalg.norm(m, axis=1), np.array(r[f"{side}_ids"], object)))
    return out


def _product(x, x_sizes, nx, y, y_sizes, ny):
    """Similarities of two blocks' vectors. Vectors of different lengths, and zero vectors, are unlike (0)."""
    import numpy as np

    width = min(x.shape[1], y.shape[1])  # longer vectors of either side have no partner of their length
    sim = (x[:, :width] @ y[:, :width].T) / np.maximum(np.outer(nx, ny), 1e-300)
    sim[x_sizes[:, None] != y_sizes[None, :]] = 0.0
    return sim


def _short(x, x_sizes, nx, y, y_sizes, ny):
    """Both sides' unit vectors as 32-bit numbers, and how far their products may be from similarities; None where vectors
    differ in length or norms are out of the range in which that holds. Zero vectors stay zero."""
    import numpy as np

    if not len(x_sizes) or not len(y_sizes) or (x_sizes != y_sizes[0]).any() or (y_sizes != y_sizes[0]).any():
        return None
    n = np.concatenate([nx, ny])
    if not ((n == 0) | ((n > 1e-100) & (n < 1e100))).all():
        return None
    a, b = ((m / np.where(norm > 0, norm, 1.0)[:, None]).astype(np.float32) for m, norm in ((x, nx), (y, ny)))
    return a, b, np.float32(1.2e-7 * (x.shape[1] + 8))


def _exact(i, j, x, x_sizes, nx, y, y_sizes, ny):
    """Similarities of the rows i of x with the rows j of y, which have one length."""
    import numpy as np

    out = np.empty(len(i))
    for at in range(0, len(i), 8192):
        a, b = i[at : at + 8192], j[at : at + 8192]
        out[at : at + 8192] = np.einsum("ij,ij->i", x[a], y[b]) / np.maximum(nx[a] * ny[b], 1e-300)
    return out


def _within(x, y, least: float, most: int):
    """Places and similarities of all pairs of two blocks that reach `least`, and perhaps of some that fall short of it; None
    where there are more than `most`, or where short products do not tell. These rule out nearly all pairs; the others are
    computed anew."""
    import numpy as np

    if least <= 1e-3 or (short := _short(*x, *y)) is None:
        return None
    (a, b, reach), found, total = short, [], 0
    for at in range(0, len(a), STRIP):
        i, j = np.nonzero(a[at : at + STRIP] @ b.T >= np.float32(least) - reach)
        found.append((i + at, j))
        if (total := total + len(i)) > most:
            return None
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    return i, j, _exact(i, j, *x, *y)


def _near(x, y, threshold: float):
    """Which pairs of two blocks are as like as the threshold, to 9 digits: a matrix."""
    import numpy as np

    if threshold <= 1e-3 or (short := _short(*x, *y)) is None:
        return np.round(_product(*x, *y), 9) >= threshold
    a, b, reach = short
    sim = a @ b.T
    near = sim >= np.float32(threshold) + reach
    i, j = np.nonzero((sim >= np.float32(threshold) - reach) & ~near)  # too close to tell
    near[i, j] = np.round(_exact(i, j, *x, *y), 9) >= threshold
    return near


def _met(met: DataFrame, *more: str) -> DataFrame:
    return met.select(*(f"{s}_{c}" for s in "xy" for c in ("ids", "m", "sizes", *more)))


def multiplied(met: DataFrame, threshold: float, k: int | None, own: bool, inclusive: bool = False, ties: bool = False, mirrored: bool = False) -> DataFrame:
    """id, other, similarity (to 9 digits) of the pairs in pairs of blocks (x_ids, x_m, x_sizes, y_ids, ...) that pass the
    threshold, k for each id of a pair of blocks at most (ties: and those as like as the last of them); own: a row is no partner
    of itself. mirrored: a pair of different blocks (x_block, y_block) is there once and counts for the rows of both."""
    import numpy as np
    import pyarrow as pa

    def passing(i, j, v, x_codes, y_codes):
        """Of places and unrounded similarities those that pass, k for each i at most."""
        v = np.round(v, 9)
        passed = v >= threshold if inclusive else v > threshold
        if own:
            passed &= x_codes[i] != y_codes[j]
        i, j, v = i[passed], j[passed], v[passed]
        if k is not None and len(i):
            order = np.lexsort((y_codes[j], -v, i))
            i, j, v = i[order], j[order], v[order]
            start = np.searchsorted(i, i)
            best = np.arange(len(i)) - start < k
            if ties:
                best = v >= v[np.minimum(start + k - 1, np.searchsorted(i, i, "right") - 1)]
            i, j, v = i[best], j[best], v[best]
        return i, j, v

    def strip(x, y, x_codes, y_codes):
        """Places and similarities of a strip's pairs. Only those within reach of the threshold and, where there are many, of
        a row's k-th are rounded and sorted: rounding to 9 digits turns no order round."""
        sim = _product(*x, *y)
        sim[np.isnan(sim)] = -np.inf
        if own:
            sim[x_codes[:, None] == y_codes[None, :]] = -np.inf
        least = np.full((len(sim), 1), threshold - 2e-9)
        passed = sim >= least
        if k is not None and k < sim.shape[1] and passed.sum() > 4 * k * len(sim):
            passed = sim >= np.maximum(np.partition(sim, -k, axis=1)[:, [-k]] - 2e-9, least)
        i, j = np.nonzero(passed)
        return passing(i, j, sim[i, j], x_codes, y_codes)

    def short_strip(x, y, x_codes, y_codes, here, a, b, reach):
        """The same by short products: they rule out what is not within their reach of a row's k-th, the others are computed anew."""
        sim, codes = a[here] @ b.T, x_codes[here]
        if own and np.isin(codes, y_codes).any():
            sim[codes[:, None] == y_codes[None, :]] = -np.inf
        least = np.float32(threshold - 2e-9) - reach
        passed = sim >= np.maximum(np.partition(sim, -k, axis=1)[:, [-k]] - 2 * reach, least)
        i, j = np.nonzero(passed)
        return passing(i, j, _exact(i + here.start, j, *x, *y), codes, y_codes)

    def found(x, y, x_codes, y_codes, both):
        """Runs of pairs, and whether they are turned round: each has all that an i of it may keep."""
        most = 4 * k * max(len(x_codes), len(y_codes)) if k is not None else len(x_codes) * len(y_codes) // 16
        if (all_ := _within(x, y, threshold - 2e-9, most)) is not None:
            i, j, v = all_
            yield False, passing(i, j, v, x_codes, y_codes)
            if both:
                yield True, passing(j, i, v, y_codes, x_codes)
            return
        short = _short(*x, *y)
        for turned, (p, q, p_codes, q_codes) in enumerate([(x, y, x_codes, y_codes), (y, x, y_codes, x_codes)][: 1 + both]):
            for at in range(0, len(p_codes), STRIP):
                here = slice(at, at + STRIP)
                if short is None or k is None or k >= len(q_codes):
                    i, j, v = strip([c[here] for c in p], q, p_codes[here], q_codes)
                else:
                    i, j, v = short_strip(p, q, p_codes, q_codes, here, short[1 if turned else 0], short[0 if turned else 1], short[2])
                yield bool(turned), (i + at, j, v)

    def meet(batches):
        for batch in batches:
            for n in range(len(batch)):
                (r,) = batch.slice(n, 1).to_pylist()
                (*x, x_ids), (*y, y_ids) = _sides(r)
                code = {v: n for n, v in enumerate(sorted({*x_ids, *y_ids}, key=lambda v: (v is not None, v or "")))}
                x_codes, y_codes = (np.array([code[v] for v in ids], np.int64) for ids in (x_ids, y_ids))
                for turned, (i, j, v) in found(x, y, x_codes, y_codes, mirrored and r["x_block"] != r["y_block"]):
                    one, two = (y_ids, x_ids) if turned else (x_ids, y_ids)
                    yield pa.RecordBatch.from_pydict({"id": pa.array(one[i].tolist(), pa.string()), "other": pa.array(two[j].tolist(), pa.string()), "similarity": pa.array(v, pa.float64())})

    return _met(met, *["block"] * mirrored).mapInArrow(meet, "id string, other string, similarity double")


def forest(near):
    """Of a matrix that says which rows and columns are linked: as few of the links as connect all that are connected, at most
    one for each row and each column."""
    import numpy as np

    out_i, out_j = [], []
    rows_left, columns_left = near.any(1), near.any(0)
    while rows_left.any():
        rows = np.array([rows_left.argmax()])
        rows_left[rows] = False
        while len(rows):
            columns = np.flatnonzero(near[rows].any(0) & columns_left)
            columns_left[columns] = False
            out_i.append(rows[near[np.ix_(rows, columns)].argmax(0)])
            out_j.append(columns)
            rows = np.flatnonzero(near[:, columns].any(1) & rows_left) if len(columns) else columns
            rows_left[rows] = False
            if len(rows):
                out_i.append(rows)
                out_j.append(columns[near[np.ix_(rows, columns)].argmax(1)])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(out_i), cat(out_j)


def sided(blocks: DataFrame, side: str) -> DataFrame:
    return blocks.select(*(F.col(c).alias(f"{side}_{c}") for c in blocks.columns))


def _block_pairs(rows: DataFrame, threshold: float, block: int, k: int | None = None, others: DataFrame | None = None, inclusive: bool = False) -> DataFrame:
    """id, other, similarity of pairs above the threshold (inclusive: or at it), of rows with each other or with others; k: the
    best k of each id from each pair of blocks, which loses none of its best k of all."""
    own = others is None
    # blocks are staged: a cross join reads each side once for each partition of the other, which would pack it anew each time
    left = _dealt(staged(packed(rows, block).withColumn("block", F.monotonically_increasing_id()), "blocks"))
    right = left if own else _dealt(staged(packed(others, block), "blocks"))
    met = sided(left, "x").join(sided(right, "y"), F.col("x_block") <= F.col("y_block") if own else None, how="inner" if own else "cross")
    return multiplied(met, threshold, k, own, inclusive, mirrored=own)  # a row is a block


def _dealt(blocks: DataFrame, most: int = 16) -> DataFrame:
    """Staged blocks dealt evenly over a few partitions, however few files hold them, so that the pairs of blocks are many tasks'
    work."""
    return blocks.repartition(max(1, min(most, blocks.count())))  # counted in the files' footers


def scoped_met(left: DataFrame, right: DataFrame, block: int) -> DataFrame:
    """Pairs of blocks of rows of left and rows of right (both: id, scope, embedding) that have one scope. Rows are sorted by scope
    into blocks, so that a scope with a third of all rows becomes many; blocks of a scope meet by their numbers, dealt evenly."""

    def blocks(df: DataFrame, side: str) -> DataFrame:
        rows = df.select("id", "embedding", "scope").where("embedding is not null").repartitionByRange("scope", "id").sortWithinPartitions("scope", "id")
        return sided(staged(packed(rows, block, "scope", "string").withColumn("block", F.monotonically_increasing_id()), "blocks"), side)

    x, y = blocks(left, "x"), blocks(right, "y")
    numbers = x.select("x_scope", "x_block").join(y.select("y_scope", "y_block"), F.col("x_scope") == F.col("y_scope")).select("x_block", "y_block")
    return numbers.repartition("x_block", "y_block").join(x, "x_block").join(y, "y_block")


def scoped_links(left: DataFrame, right: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """a, b: links between rows of left and rows of right (both: id, scope, embedding) of one scope that are as like as the
    threshold. Not all of them, which in a dense group would be the square of it, but enough to connect all that are connected."""

    def meet(batches):
        import pyarrow as pa

        for batch in batches:
            for n in range(len(batch)):
                (r,) = batch.slice(n, 1).to_pylist()
                (*x, x_ids), (*y, y_ids) = _sides(r)
                i, j = forest(_near(x, y, threshold))
                yield pa.RecordBatch.from_pydict({"a": pa.array(x_ids[i].tolist(), pa.string()), "b": pa.array(y_ids[j].tolist(), pa.string())})

    return _met(scoped_met(left, right, block)).mapInArrow(meet, "a string, b string")


def recent_pairs(memories: DataFrame, n: int, threshold: float, limit: int, older_first: bool = False) -> DataFrame:
    """Near pairs among the n newest active memories: a fixed number of rows on either side."""
    newest = memories.where(active() & F.col("embedding").isNotNull()).orderBy(F.desc("created_at"), "id").limit(n).select("id", "embedding", "created_at")
    a, b = newest.alias("a"), newest.alias("b")
    on = F.col("a.id") < F.col("b.id")
    if older_first:
        on = (F.col("a.id") != F.col("b.id")) & (F.col("a.created_at") < F.col("b.created_at"))
    pairs = a.join(b, on).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), cosine(F.col("a.embedding"), F.col("b.embedding")).alias("similarity"))
    return pairs.where(F.col("similarity") > threshold).orderBy(F.desc("similarity"), "a_id", "b_id").limit(limit)


def ranked(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return df.orderBy(*order, "id").limit(limit)


def bootstrap_slots(memories: DataFrame, agent: str, as_of: Column, limit: int = 10, exclude: tuple = (), contexts: tuple = (), boosted: tuple = ()) -> DataFrame:
    """An agent's own slots and the cross-agent ones (30 % of the limit, 2 at least), by boosted importance. source says which."""
    cross = max(2, int(0.3 * limit))
    own_n = max(0, limit - cross)
    rows = memories.where(active(as_of) & F.col("tier").isin("hot", "warm") & ~F.col("type").isin(*exclude or ("",)))
    boost = F.col("importance") + F.when(F.col("context").isin(*contexts or ("",)), 2).otherwise(0) + F.when(F.col("type").isin(*boosted or ("",)), 1).otherwise(0)
    rows = rows.withColumn("boosted", boost)
    own = ranked(rows.where(F.col("agent") == agent), [F.desc("boosted"), F.desc_nulls_last("last_seen")], own_n).withColumn("source", F.lit("own"))
    tagged = F.when(F.array_contains("tags", "cross-agent"), 0).otherwise(1)
    other = ranked(rows.where(~F.col("agent").eqNullSafe(F.lit(agent)) & (F.col("importance") >= 7)), [tagged.asc(), F.desc("boosted"), F.desc_nulls_last("last_seen")], cross).withColumn("source", F.lit("cross"))
    return own.unionByName(other)


def per_type_top(memories: DataFrame, limits: dict[str, int], min_importance: int = 3) -> DataFrame:
    """The best of each type in one pass; the rank filter becomes a group limit before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("importance"), F.desc_nulls_last("last_seen"), "id"))
    rows = memories.where(active() & F.col("type").isin(*limits) & (F.col("importance") >= min_importance)).withColumn("rank", rank).where(F.col("rank") <= max(limits.values()))
    allowed = F.create_map(*(x for k, v in limits.items() for x in (F.lit(k), F.lit(v))))
    return rows.where(F.col("rank") <= allowed[F.col("type")])
