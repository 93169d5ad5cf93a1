"""Cropped and edited copies of images through local descriptors.

Each image is searched for corners at several scales. A corner has a main
direction, along which 256 comparisons of smoothed brightness are turned, so
that a descriptor survives rotation. Both places of a comparison lie equally far along that
direction, as brightness rises along it anyway and such a comparison would tell little.
Descriptors are split into equal parts, one Hamming table each: two descriptors that differ in fewer bits than there
are parts agree on a part, so an equi-join finds them. Matches
vote for the turn, scale and shift between two images, and pairs with enough agreeing
votes are copies.

Images with the same pixels are one node, and equal descriptors are one entry of the tables, whose members all
vote. A bucket with many entries is dealt into blocks of ``bucket_rows`` rows, and every pair of
blocks is compared, so no pair is missed however crowded a bucket is. Images are dealt into blocks as well; two blocks'
images vote in one group, from arrays of the corners that share a descriptor, so no pair of corners or images is a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.operators.components import connected_components
from rangeloom.operators.staging import release, shuffled, stage

SCALES = (1.0, 0.75, 0.5)
BITS, PARTS = 256, 8
RADIUS = 12
WORDS = BITS // 64
_CORNER = "print string, node long, corner int, x float, y float, scale float, turn float, " + ", ".join(f"w{i} long" for i in range(WORDS))
_RNG = np.random.Generator(np.random.PCG64(11))
_TESTS = np.clip(_RNG.normal(0, RADIUS / 1.7, (BITS, 4)), -RADIUS + 2, RADIUS - 2)
_TESTS[:, 2] = _TESTS[:, 0]
_GRID = np.arange(-RADIUS, RADIUS + 1)
_DISC = _GRID[:, None] ** 2 + _GRID[None, :] ** 2 <= RADIUS * RADIUS


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean of the square of radius ``r`` around each pixel, edges repeated."""
    p = np.pad(x, r + 1, mode="edge").cumsum(0).cumsum(1)
    n = 2 * r + 1
    total = p[n:, n:] - p[:-n, n:] - p[n:, :-n] + p[:-n, :-n]
    return total[: x.shape[0], : x.shape[1]] / (n * n)


def _resize(x: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1.0:
        return x
    h, w = (max(1, round(s * scale)) for s in x.shape)
    ys, xs = np.clip((np.arange(h) + 0.5) / scale - 0.5, 0, x.shape[0] - 1), np.clip((np.arange(w) + 0.5) / scale - 0.5, 0, x.shape[1] - 1)
    y0, x0 = np.minimum(ys.astype(int), max(0, x.shape[0] - 2)), np.minimum(xs.astype(int), max(0, x.shape[1] - 2))
    y1, x1 = np.minimum(y0 + 1, x.shape[0] - 1), np.minimum(x0 + 1, x.shape[1] - 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    return (x[y0][:, x0] * (1 - fx) + x[y0][:, x1] * fx) * (1 - fy) + (x[y1][:, x0] * (1 - fx) + x[y1][:, x1] * fx) * fy


def describe(pixels: np.ndarray) -> tuple[np.ndarray, ...]:
    """(x, y, scale, turn, bits) of every corner of a grey image, in its own coordinates."""
    found = []
    for scale in SCALES:
        img = _resize(pixels.astype(np.float64), scale)
        if min(img.shape) < 2 * RADIUS + 3:
            continue
        smooth = _box(img, 1)
        gy, gx = np.gradient(smooth)
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        answer = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        top = answer.max()
        if top <= 1e-6:
            continue
        rows = np.pad(answer, 2, constant_values=-np.inf)
        around = np.max([rows[i : i + answer.shape[0], j : j + answer.shape[1]] for i in range(5) for j in range(5)], axis=0)
        peak = (answer >= around) & (answer > 0.01 * top)
        peak[:RADIUS] = peak[-RADIUS:] = False
        peak[:, :RADIUS] = peak[:, -RADIUS:] = False
        y, x = np.nonzero(peak)
        if not len(y):
            continue
        patch = smooth[y[:, None, None] + _GRID[:, None], x[:, None, None] + _GRID] * _DISC
        turn = np.arctan2((patch * _GRID[:, None]).sum((1, 2)), (patch * _GRID).sum((1, 2)))
        c, s = np.cos(turn)[:, None], np.sin(turn)[:, None]

        def value(a: np.ndarray, b: np.ndarray, c=c, s=s, x=x, y=y, smooth=smooth) -> np.ndarray:
            u, v = np.rint(c * a - s * b).astype(int), np.rint(s * a + c * b).astype(int)
            return smooth[np.clip(y[:, None] + v, 0, smooth.shape[0] - 1), np.clip(x[:, None] + u, 0, smooth.shape[1] - 1)]

        bits = value(_TESTS[:, 0], _TESTS[:, 1]) < value(_TESTS[:, 2], _TESTS[:, 3])
        found.append(((x + 0.5) / scale, (y + 0.5) / scale, np.full(len(x), scale), turn, bits))
    if not found:
        return np.empty(0), np.empty(0), np.empty(0), np.empty(0), np.empty((0, BITS), bool)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _CORNER.split(", ")]
    for batch in batches:
        for same, node, width, pixels in zip(*batch.columns, strict=True):
            raw = np.frombuffer(pixels.as_buffer(), np.uint8)
            x, y, scale, turn, bits = describe(raw.reshape(-1, width.as_py()))
            n = len(x)
            words = np.packbits(bits, axis=1).reshape(n, WORDS, 8).view(">i8").reshape(n, WORDS).astype(np.int64)
            floats = [pa.array(v.astype(np.float32)) for v in (x, y, scale, turn)]
            yield pa.RecordBatch.from_arrays([pa.array([same.as_py()] * n, pa.string()), pa.array([node.as_py()] * n, pa.int64()), pa.array(np.arange(n), pa.int32()), *floats, *[pa.array(w) for w in words.T]], names)


def _parts(word: Callable[[int], Column] = lambda i: F.col(f"w{i}")) -> Column:
    """The descriptor's parts as an array, first bits first."""
    each = BITS // PARTS
    held = 64 // each
    return F.array(*[F.shiftrightunsigned(word(t // held), 64 - each * (t % held + 1)).bitwiseAND(F.lit((1 << each) - 1)) for t in range(PARTS)])


def _bits_apart(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.w{i}").bitwiseXOR(F.col(f"{b}.w{i}"))) for i in range(1, WORDS)), F.bit_count(F.col(f"{a}.w0").bitwiseXOR(F.col(f"{b}.w0"))))


def _tables(corners: DataFrame, bucket_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Different descriptors as entries, ``corners`` with their entry, and the rows (tab, part, n, own, entry, words) of every bucket with several entries, dealt into blocks of about ``bucket_rows``."""
    words = [f"w{i}" for i in range(WORDS)]
    described = stage(corners.groupBy(*words).agg(F.count("*").alias("n")).withColumn("entry", F.monotonically_increasing_id()), "descriptors")
    members = stage(corners.join(described.drop("n"), words).drop(*words), "members")
    tables = described.select("entry", *words, F.posexplode(_parts()).alias("tab", "part"))
    tables = tables.select(F.col("tab").cast("byte").alias("tab"), "part", "entry", *words)
    sizes = stage(tables.groupBy("tab", "part").agg(F.count("*").alias("n")).where("n > 1"), "entry-sizes")
    dealt = tables.join(sizes, ["tab", "part"]).withColumn("own", F.pmod(F.xxhash64("entry"), _split(bucket_rows)).cast("int"))
    dealt = stage(dealt.select("tab", "part", "n", "own", "entry", *words), "dealt")
    release(sizes)
    return described, members, dealt


def _split(bucket_rows: int) -> Column:
    """Blocks of a bucket of n entries."""
    return F.ceil(F.col("n") / bucket_rows).cast("int")


def _paired(dealt: DataFrame, bucket_rows: int, pairs: Column) -> DataFrame:
    """Rows of ``dealt`` once for each of the ``pairs`` (i, j) of blocks that they take part in. A bucket of one block is one pair, and its rows stay as they are."""
    kept = ("tab", "part", "entry", *[f"w{k}" for k in range(WORDS)])
    single = dealt.where(F.col("n") <= bucket_rows).select(*kept, F.lit(0).alias("i"), F.lit(0).alias("j"))
    return single.unionByName(dealt.where(F.col("n") > bucket_rows).select(*kept, F.explode(pairs).alias("_pair")).select(*kept, "_pair.i", "_pair.j"))


def _with_own(others: Column, first: bool) -> Column:
    """Pairs of a row's own block, as their ``first``, with other blocks."""
    own = F.col("own")
    return F.transform(others, lambda x: F.struct((own if first else x).alias("i"), (x if first else own).alias("j")))


def _meeting(max_bits: int) -> Column:
    """Rows a and b of one pair of a bucket's blocks are near, and this table is the first in which they meet."""
    same = reduce(Column.__and__, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("tab", "part", "i", "j")])
    apart = F.array(*[F.col(f"a.w{i}").bitwiseXOR(F.col(f"b.w{i}")) for i in range(WORDS)])
    first = F.array_position(_parts(lambda i: apart[i]), F.lit(0).cast("long")) == F.col("a.tab") + 1
    return same & (_bits_apart("a", "b") <= max_bits) & first


def _near_pairs(described: DataFrame, dealt: DataFrame, max_bits: int, bucket_rows: int) -> DataFrame:
    """(one, two): near entries of ``dealt``, once each, and each entry that several corners share with itself."""
    a = _paired(dealt, bucket_rows, _with_own(F.sequence(F.col("own"), _split(bucket_rows) - 1), True)).alias("a")
    b = _paired(dealt, bucket_rows, _with_own(F.sequence(F.lit(0), F.col("own")), False)).alias("b")
    once = (F.col("a.i") < F.col("a.j")) | (F.col("a.entry") < F.col("b.entry"))
    near = a.join(b, _meeting(max_bits) & once).select(F.col("a.entry").alias("one"), F.col("b.entry").alias("two"))
    equal = described.where("n > 1").select(F.col("entry").alias("one"), F.col("entry").alias("two"))
    return near.unionByName(equal)


def _near_some(dealt: DataFrame, max_bits: int, bucket_rows: int) -> DataFrame:
    """(tab, part, entry, words): entries of ``dealt`` that are near another one of their bucket, once a bucket."""
    words = [f"w{i}" for i in range(WORDS)]
    every = F.sequence(F.lit(0), _split(bucket_rows) - 1)
    a, b = (_paired(dealt, bucket_rows, _with_own(every, first)).alias(t) for t, first in (("a", True), ("b", False)))
    return a.join(b, _meeting(max_bits) & (F.col("a.entry") != F.col("b.entry")), "left_semi").select("tab", "part", "entry", *words).distinct()


def near_descriptors(corners: DataFrame, max_bits: int, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """(one, two): entries of different descriptors within ``max_bits`` bits, once each, and each entry that several corners share with itself; and ``corners`` with their entry.

    Equal descriptors are one entry of the tables. Every bucket is compared whole: its entries are dealt into
    blocks of about ``bucket_rows``, and each pair of blocks is joined by itself, so the result does not depend on
    ``bucket_rows``. A pair that meets in several tables counts in the first of them.
    """
    _check_bits(max_bits)
    described, members, dealt = _tables(corners, bucket_rows)
    pairs = stage(_near_pairs(described, dealt, max_bits, bucket_rows), "near-descriptors")
    release(dealt)
    return pairs, members


def _check_bits(max_bits: int) -> None:
    if not 0 <= max_bits < PARTS:
        raise ValueError(f"max_bits must be below {PARTS}")


def descriptor_matches(corners: DataFrame, max_bits: int, bucket_rows: int) -> DataFrame:
    """(a_node, a_corner, b_node, b_corner): corners of different images within ``max_bits`` bits, a's node before b's.

    Each pair of corners comes out, so the rows grow as the square of the different images that share one descriptor; ``image_links`` makes none.
    """
    pairs, members = near_descriptors(corners, max_bits, bucket_rows)
    for t in ("one", "two"):
        pairs = pairs.join(members.select(F.col("entry").alias(t), F.struct("node", "corner").alias(f"{t}_of")), t)
    first = F.col("one_of.node") < F.col("two_of.node")
    turned = (F.col("one") != F.col("two")) & (F.col("one_of.node") > F.col("two_of.node"))
    pairs = pairs.where(first | turned).select(F.when(first, F.col("one_of")).otherwise(F.col("two_of")).alias("a"), F.when(first, F.col("two_of")).otherwise(F.col("one_of")).alias("b"))
    return pairs.select(*[F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in "ab" for c in ("node", "corner")])


#: Images of a block, most blocks, pairs of corners that a task holds at a time, and most entries of a bucket whose near pairs are rows.
_IMAGES, _BLOCKS, _PAIRS, _FEW = 512, 1024, 1 << 18, 16
_MEMBER = ("node", "copies", "corner", "x", "y", "scale", "turn")
_LINK = "src long, dst long, linked long"


def _agreed(a: dict[str, np.ndarray], b: dict[str, np.ndarray], votes: int, cell: float) -> np.ndarray:
    """Places of one match of each pair of images whose matches agree; ``a`` and ``b`` hold the matching corners, a's node before b's."""
    turn = b["turn"] - a["turn"]
    ratio = a["scale"].astype(float) / b["scale"]
    cos, sin = np.cos(turn.astype(float)), np.sin(turn.astype(float))
    whole = lambda v: (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(np.int64)
    shift = lambda p, q, sign: np.floor((b[p] - ratio * (cos * a[p] + sign * sin * a[q])) / cell).astype(np.int64)
    key = np.unique(np.stack([a["node"], b["node"]]), axis=1, return_inverse=True)[1].ravel()
    for v in (whole(turn / float(np.pi / 6)) % 12, whole(2 * np.log2(ratio))):
        key = key * (np.ptp(v) + 1) + v - v.min()
    dx, dy = shift("x", "y", -1), shift("y", "x", 1)
    across = [(v - v.min(), int(np.ptp(v)) + 2) for v in (dx, dy)]
    near = np.stack([(key * across[0][1] + across[0][0] + i) * across[1][1] + across[1][0] + j for i in (0, 1) for j in (0, 1)], 1).ravel()
    cells = np.unique(near, return_inverse=True)[1].ravel()
    corner = np.unique(a["corner"], return_inverse=True)[1].ravel()
    single, at = np.unique(cells * (corner.max() + 1) + np.repeat(corner, 4), return_index=True)
    counts = np.bincount(single // (corner.max() + 1))
    found = at[counts[cells[at]] >= votes] // 4
    return found[np.unique(np.stack([a["node"][found], b["node"][found]]), axis=1, return_index=True)[1]]


def _block_links(max_bits: int, votes: int, cell: float):
    """For images of two blocks, whose matching entries are the rows of a group, ``sure`` where all of a row's corners match each other: each linked image, one that it is connected with, and the number of images that it is linked with there."""
    words = [f"w{i}" for i in range(WORDS)]

    def side(group: pa.Table, name: str) -> tuple[dict[str, np.ndarray], np.ndarray]:
        held = group.column(name).combine_chunks()
        held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
        values = held.flatten()
        return {c: values.field(c).to_numpy(zero_copy_only=False) for c in (*_MEMBER, *words)}, np.diff(held.offsets.to_numpy())

    def run(group: pa.Table) -> pa.Table:
        (left, n_left), (right, n_right) = side(group, "left"), side(group, "right")
        within = group.column("_i")[0].as_py() == group.column("_j")[0].as_py()
        sure = np.asarray(group.column("sure").to_pylist(), bool)
        row = np.repeat(np.arange(len(n_left)), n_left)
        order = np.argsort(left["node"], kind="stable")
        left, row = {c: v[order] for c, v in left.items()}, row[order]
        first, width = (np.cumsum(n_right) - n_right)[row], n_right[row]
        ends, last = np.cumsum(width), np.flatnonzero(np.append(np.diff(left["node"]) != 0, True)) + 1
        top: dict[int, int] = {}
        linked: dict[int, int] = {}

        def root(n: int) -> int:
            while top.setdefault(n, n) != n:
                top[n] = n = top[top[n]]
            return n

        lo = 0
        while lo < len(row):
            # Whole images only, as all votes of a pair count together.
            want = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _PAIRS, side="right"))
            fits = last[(last > lo) & (last <= want)]
            hi = int(fits[-1] if len(fits) else last[last > lo][0])
            of = np.repeat(np.arange(lo, hi), width[lo:hi])
            start = np.repeat(np.cumsum(width[lo:hi]) - width[lo:hi], width[lo:hi])
            to = first[of] + np.arange(len(of)) - start
            if within:
                kept = left["node"][of] < right["node"][to]
                of, to = of[kept], to[kept]
            apart = sum(np.bitwise_count((left[w][of] ^ right[w][to]).view(np.uint64)).astype(np.int64) for w in words)
            kept = sure[row[of]] | (apart <= max_bits)
            of, to = of[kept], to[kept]
            lo = hi
            if len(of) < votes:
                continue
            swap = left["node"][of] > right["node"][to]
            a, b = ({c: np.where(swap == turned, left[c][of], right[c][to]) for c in _MEMBER} for turned in (False, True))
            for i in _agreed(a, b, votes, cell).tolist():
                x, y = int(a["node"][i]), int(b["node"][i])
                linked[x], linked[y] = linked.get(x, 0) + int(b["copies"][i]), linked.get(y, 0) + int(a["copies"][i])
                x, y = sorted((root(x), root(y)))
                top[y] = x
        nodes = sorted(linked)
        return pa.table([pa.array(nodes, pa.int64()), pa.array([root(n) for n in nodes], pa.int64()), pa.array([linked[n] for n in nodes], pa.int64())], ["src", "dst", "linked"])

    return run


def image_links(corners: DataFrame, max_bits: int, bucket_rows: int, votes: int, cell: float, block_images: int = _IMAGES, *, few: int = _FEW) -> DataFrame:
    """(src, dst, linked): images whose corners agree with others', by part: ``linked`` adds up to the other images (``copies`` of each) that src is linked with, and dst is one that src is connected with, or src.

    Images are dealt into blocks by a hash. Entries hold an array of corners for each block, and each pair of blocks is one group, which has all
    votes of its pairs of images and compares a bounded number of corners at a time. Near pairs of entries are rows in buckets of ``few`` entries at most; of a larger
    bucket the entries that are near any other come as one array for each block, and two blocks compare theirs. The links are those of all pairs, whatever ``block_images`` and ``few`` are.
    """
    _check_bits(max_bits)
    words = [f"w{i}" for i in range(WORDS)]
    described, members, dealt = _tables(corners, bucket_rows)
    pairs = stage(_near_pairs(described, dealt.where(F.col("n") <= few), max_bits, bucket_rows), "near-descriptors")
    crowded = stage(_near_some(dealt.where(F.col("n") > few), max_bits, bucket_rows), "near-some")
    release(dealt)
    blocks = max(1, min(_BLOCKS, -(-members.agg(F.count_distinct("node")).first()[0] // block_images)))
    held = members.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")).groupBy("entry", "block").agg(F.collect_list(F.struct(*_MEMBER)).alias("held"))
    held = stage(held, "entry-blocks")
    worded = lambda each: F.transform("held", lambda m: F.struct(*[m[c].alias(c) for c in _MEMBER], *[w.alias(c) for c, w in zip(words, each, strict=True)])).alias("held")
    met, plain = pairs, held.select("entry", "block", worded([F.lit(0).cast("long")] * WORDS))
    for t in ("one", "two"):
        met = met.join(shuffled(plain.select(F.col("entry").alias(t), F.col("block").alias(f"{t}_block"), F.col("held").alias(f"{t}_held"))), t)
    same, before, level = F.col("one") == F.col("two"), F.col("one_block") < F.col("two_block"), F.col("one_block") == F.col("two_block")
    way = lambda a, b, sure=True: F.struct(F.col(f"{a}_block").alias("_i"), F.col(f"{b}_block").alias("_j"), F.col(f"{a}_held").alias("left"), F.col(f"{b}_held").alias("right"), F.lit(sure).alias("sure"))
    # Within a block images of both entries are left ones; an entry with itself meets each other block once.
    ways = F.when(before | (level & same), F.array(way("one", "two"))).when(level, F.array(way("one", "two"), way("two", "one"))).when(~same, F.array(way("two", "one")))
    met = met.where(~same | before | level).select(F.explode(ways).alias("_way")).select("_way.*")
    crowds = crowded.join(shuffled(held), "entry").select("tab", "part", "block", worded([F.col(w) for w in words]))
    crowds = stage(crowds.groupBy("tab", "part", "block").agg(F.flatten(F.collect_list("held")).alias("held")), "crowds")
    one, two = (crowds.select("tab", "part", F.col("block").alias(f"{t}_block"), F.col("held").alias(f"{t}_held")) for t in ("one", "two"))
    across = one.join(shuffled(two), ["tab", "part"]).where(before | level).select(way("one", "two", False).alias("_way")).select("_way.*")
    return met.unionByName(across).groupBy("_i", "_j").applyInArrow(_block_links(max_bits, votes, cell), _LINK)


def image_groups(
    images: DataFrame, id_col: str = "image_id", width_col: str = "width", pixels_col: str = "pixels", max_bits: int = 7, votes: int = 6, cell: float = 12.0, bucket_rows: int = 4096
) -> DataFrame:
    """One row per image: (image_id, n_copies, component_id).

    ``pixels`` are grey bytes row by row. ``n_copies`` counts other images linked directly: those with the
    same pixels, and those where ``votes`` corners agree on one turn (of 30 degrees), scale (of
    half an octave) and shift (of ``cell`` pixels). ``component_id`` is the smallest id reachable. Images that
    are null, empty, not a whole number of rows, or too small or flat for corners match only equal
    pixels of equal width, null ones nothing. Rows with a null id have a null component and match nothing; rows that
    repeat an id are images that share it. An empty table gives an empty result; other columns are ignored.
    """
    rows = images.select(F.col(f"`{id_col}`").cast("long").alias("image_id"), F.col(f"`{width_col}`").cast("int").alias("width"), F.col(f"`{pixels_col}`").cast("binary").alias("pixels"))
    sound = F.col("image_id").isNotNull() & F.col("width").isNotNull() & F.col("pixels").isNotNull()
    rows = rows.withColumn("print", F.when(sound, F.sha2(F.concat(F.col("width").cast("string").cast("binary"), F.lit(b"x"), F.col("pixels")), 256)))
    nodes = rows.where("print is not null").groupBy("print").agg(F.min("image_id").alias("node"), F.count("*").alias("copies"))
    # Pictures that share their least id are one node.
    nodes = stage(nodes.withColumn("shared", F.sum("copies").over(Window.partitionBy("node"))), "image-nodes")
    usable = (F.col("width") > 0) & (F.length("pixels") > 0) & (F.length("pixels") % F.greatest("width", F.lit(1)) == 0)
    # Corners move, not pixels; those of copies with other ids are dealt by their own id before they leave.
    every = rows.where(usable & F.col("print").isNotNull()).select("print", F.col("image_id").alias("node"), "width", "pixels").mapInArrow(_corners, _CORNER)
    every = every.join(nodes.select("print", "node", F.col("shared").alias("copies")), ["print", "node"]).dropDuplicates(["print", "node", "corner"])
    corners = stage(every.drop("print").withColumn("corner", F.monotonically_increasing_id()), "corners")
    links = stage(image_links(corners, max_bits, bucket_rows, votes, cell), "image-links")
    groups = connected_components(links.where("src <> dst").select("src", "dst"))
    degree = links.groupBy(F.col("src").alias("_src")).agg(F.sum("linked").alias("linked"))
    known = nodes.join(degree, F.col("node") == F.col("_src"), "left").join(groups.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    known = stage(known.select(F.col("print").alias("_print"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_copies"), F.coalesce("component", "node").alias("component")), "image-classes")
    out = rows.select("image_id", "print").join(known, F.col("print") == F.col("_print"), "left")
    return out.select("image_id", F.coalesce("n_copies", F.lit(0)).cast("long").alias("n_copies"), F.coalesce("component", "image_id").alias("component_id"))


def vector_images(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", side: int = 8, zoom: int = 8) -> DataFrame:
    """(image_id, width, pixels): each vector drawn as rows of ``side`` tiles, smoothly enlarged, brightness by value.

    All components are drawn; the last row is filled up with zeros, and there are ``side`` rows at least. Vectors that are null, empty, or hold null or non-finite components have null pixels.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.array(v if v is not None and None not in v else [], np.float64)
                if not len(x) or not np.isfinite(x).all():
                    out.append(None)
                    continue
                tiles = np.pad(x, (0, max(side, -(-len(x) // side)) * side - len(x))).reshape(-1, side) / (np.abs(x).max() or 1.0)
                out.append(np.rint(127.5 + 127.5 * _resize(tiles, zoom)).astype(np.uint8).tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([side * zoom] * n, pa.int32()), pa.array(out, pa.binary())], ["image_id", "width", "pixels"])

    picked = vectors.select(F.col(f"`{id_col}`").cast("long").alias("image_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return picked.mapInArrow(draw, "image_id long, width int, pixels binary")
