"""Building a labelled corpus: near duplicates, ground truth, weights, batches and balanced draws."""

from __future__ import annotations

import difflib
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipworks.functions.text import dedup_key, norm
from slipworks.functions.values import FIVE, hamming, parse_date, parse_time, parse_vnd, segment_keys
from slipworks.session import Workspace

#: Groups that a seeded choice on the driver may have.
MOST_GROUPS = 1_000_000

#: Strings of a block; blocks are compared in pairs.
BLOCK = 8192


def near_hashes(hashes: DataFrame, column: str, radius: int = 3) -> DataFrame:
    """(hash_a, hash_b, distance): distinct 64-bit hashes within ``radius`` (at most 3), the smaller first.

    Hashes within 3 bits agree in two of five segments, so these pairs of segments are joined. Copies of a hash are one hash
    here; the membership stays with the table.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two of five segments find hashes within 3 bits")
    keyed = hashes.select(F.col(column).alias("h")).where("h is not null").distinct().select("h", F.explode(F.array(*segment_keys(F.col("h"), "", FIVE, 2))).alias("key"))
    pairs = keyed.select("key", F.col("h").alias("hash_a")).join(keyed.select("key", F.col("h").alias("hash_b")), "key")
    return pairs.where("hash_a < hash_b").select("hash_a", "hash_b", hamming(F.col("hash_a"), F.col("hash_b")).alias("distance")).where(F.col("distance") <= radius).distinct()


def same_receipt_links(rows: DataFrame, keys: list[Column], record: str) -> DataFrame:
    """(record, first): every record with the least record that has the same keys, all of them given; itself left out."""
    named = rows.select(F.col(record).alias("record"), *[k.alias(f"k{i}") for i, k in enumerate(keys)])
    given = named.dropna(subset=[f"k{i}" for i in range(len(keys))])
    least = given.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.min("record").alias("first"))
    return given.join(least, [f"k{i}" for i in range(len(keys))]).where("record <> first").select("record", "first").distinct()


def _signatures(texts: list[str], piece: int, words: int) -> np.ndarray:
    """A set of 64 * ``words`` bits for each text, a bit for each window of ``piece`` letters and its number among the same ones."""
    bits = np.zeros((len(texts), words), dtype=np.uint64)
    for row, t in enumerate(texts):
        seen: dict[str, int] = {}
        for i in range(len(t) - piece + 1):
            g = t[i : i + piece]
            n = seen[g] = seen.get(g, 0) + 1
            h = zlib.crc32(f"{g}{n}".encode("utf-8", "surrogatepass")) % (64 * words)
            bits[row, h >> 6] |= np.uint64(1 << (h & 63))
    return bits


def _close_pairs(left: list[str], right: list[str], same: bool, threshold: float) -> Iterator[tuple[int, int]]:
    """Places of all pairs that may reach the threshold; of one block with itself, each pair once.

    ``missed`` letters of a pair are in no equal piece. Each is one in the difference of the letters counted with multiplicity
    and at most three in that of the windows of two letters; texts that share a bit can only make a difference smaller.
    """
    order = sorted(range(len(right)), key=lambda j: len(right[j]))
    lengths = np.array([len(right[j]) for j in order])
    at = np.array(order)
    ones, twos = _signatures([right[j] for j in order], 1, 2), _signatures([right[j] for j in order], 2, 4)
    mine = (_signatures(left, 1, 2), _signatures(left, 2, 4))
    for i, t in enumerate(left):
        n = len(t)
        low, high = np.searchsorted(lengths, n * threshold / (2 - threshold) - 1e-6, "left"), np.searchsorted(lengths, n * (2 - threshold) / threshold + 1e-6, "right")
        missed = (1 - threshold) * (lengths[low:high] + n) + 1e-6
        near = np.flatnonzero(np.bitwise_count(twos[low:high] ^ mine[1][i]).sum(1) <= 3 * missed)
        near = near[np.bitwise_count(ones[low:high][near] ^ mine[0][i]).sum(1) <= missed[near]]
        yield from ((i, int(j)) for j in at[low:high][near] if not same or i < j)


def fuzzy_pairs(keys: DataFrame, column: str, threshold: float, order: str | None = None) -> DataFrame:
    """(a, b, ratio) of distinct strings whose Ratcliff–Obershelp ratio is at least ``threshold``, the smaller first and the
    ratio that of (a, b). With ``order``, the string of the least value comes first and the ratio is that of (b, a), since the
    ratio depends on the order.

    All pairs of blocks of strings are compared by sets of bits, whose difference has a bound for every pair within the
    threshold, so none is lost; only what is left is verified. The work grows with the square of the number of strings, at a few
    nanoseconds a pair.
    """
    named = keys.select(F.col(column).alias("s"), (F.col(order) if order else F.col(column)).cast("string").alias("o")).where("s is not null and s <> ''")
    distinct = named.groupBy("s").agg(F.min("o").alias("o"))
    blocks = max(1, -(-distinct.count() // BLOCK))
    mine = F.pmod(F.xxhash64("s"), F.lit(blocks)).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least(k, F.col("k")).alias("i"), F.greatest(k, F.col("k")).alias("j")))).alias("p")
    spread = distinct.withColumn("k", mine).select("s", "o", "k", pairs).select("s", "o", "k", "p.i", "p.j")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        one, two = rows[rows["k"] == i], rows[rows["k"] == j]
        (left, first), (right, second) = ((r["s"].tolist(), r["o"].tolist()) for r in (one, two))
        out, m = [], difflib.SequenceMatcher()
        for x, y in _close_pairs(left, right, i == j, threshold):
            (_, a), (_, b) = sorted([(first[x], left[x]), (second[y], right[y])])
            m.set_seqs(*((b, a) if order else (a, b)))
            if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and (ratio := m.ratio()) >= threshold:
                out.append((a, b, ratio))
        return pd.DataFrame(out, columns=["a", "b", "ratio"])

    return spread.groupBy("i", "j").applyInPandas(compare, "a string, b string, ratio double")


#: A phrase of sellers that names nobody.
GENERIC_SELLER = ["tên đại lý"]


def seller_keys(rows: DataFrame) -> DataFrame:
    """(image_id, name, address, any_name) of a manifest: keys of the seller of at least 6 letters and of the address of at
    least 12, null where there is none, and the seller's of any length."""
    key = lambda c, least: F.nullif(dedup_key(F.col(f"gt.{c}"), least, GENERIC_SELLER), F.lit(""))
    return rows.where("image_id is not null").select("image_id", key("merchant_name", 6).alias("name"), key("merchant_address", 12).alias("address"), key("merchant_name", 1).alias("any_name"))


def ground_truth(regions: DataFrame) -> DataFrame:
    """One row for each page of labelled regions: names joined in order, and each value if all of its kind agree."""
    v = regions.where("role = 'value'")

    def texts(label: str) -> Column:
        kept = F.array_sort(F.collect_list(F.when(F.col("label") == label, F.struct("region_id", F.coalesce("text", F.lit("")).alias("t")))))
        return F.nullif(F.array_join(F.transform(kept, lambda s: s["t"]), " "), F.lit(""))

    def values(label: str, parse) -> Column:
        return F.collect_set(F.when(F.col("label") == label, parse(F.col("text"))))

    sets = v.groupBy("image_id").agg(texts("SELLER").alias("merchant_name"), texts("ADDRESS").alias("merchant_address"), values("TOTAL_COST", parse_vnd).alias("totals"), values("TIMESTAMP", parse_date).alias("dates"), values("TIMESTAMP", parse_time).alias("times"))
    one = lambda c: F.when(F.size(c) == 1, F.element_at(c, 1))
    return sets.select("image_id", "merchant_name", "merchant_address", one("dates").alias("transaction_date"), one("times").alias("transaction_time"), one("totals").alias("total"), (F.size("totals") > 1).alias("total_ambiguous"), (F.size("dates") > 1).alias("date_ambiguous"))


#: Labels whose order from top to bottom tells which way up a page is: upper, lower, weight.
LABEL_ORDER = [("SELLER", "ADDRESS", 1), ("SELLER", "TOTAL_COST", 2), ("ADDRESS", "TOTAL_COST", 2)]


def rotation_votes(regions: DataFrame, order: list[tuple[str, str, int]] = LABEL_ORDER) -> DataFrame:
    """(image_id, points, rotation): which way a page that lies on its side must be turned so that its labels come in order.

    Turned clockwise, a region's distance from the left becomes its distance from the top; turned the other way, it is
    reversed. Each pair of labels on the page votes with its weight; no pair or a tie gives a null rotation.
    """
    labels = sorted({label for a, b, _ in order for label in (a, b)})
    mean = {label: F.avg(F.when(F.col("label") == label, F.col("x") + F.col("w") / 2)) for label in labels}
    places = regions.groupBy("image_id").agg(*[m.alias(label) for label, m in mean.items()])
    points = F.lit(0)
    for a, b, weight in order:
        points = points + F.when(F.col(a) < F.col(b), weight).when(F.col(a) > F.col(b), -weight).otherwise(0)
    return places.select("image_id", points.alias("points")).withColumn("rotation", F.when(F.col("points") > 0, "cw").when(F.col("points") < 0, "ccw"))


def sample_weights(rows: DataFrame, group: str, most: float = 3.0) -> DataFrame:
    """Adds sample_weight: one over the root of the group's size, of mean 1 before it is limited to ``most``."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    mean = sizes.agg(F.sum(F.sqrt("_n")) / F.sum("_n")).scalar()
    joined = rows.join(sizes.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn("sample_weight", F.round(F.least(1 / F.sqrt("_n") / mean, F.lit(most)), 4)).drop("_n", "_g")


def with_flags(pages: DataFrame) -> DataFrame:
    """Adds low_quality (under 0.5), complete (a seller, a date and a total are known) and the split after copies are dropped: a copy
    outside train is ``dropped_dup``. A missing quality is not low."""
    split = F.lower(F.trim("split"))
    known = F.col("gt.merchant_name").isNotNull() & F.col("gt.transaction_date").isNotNull() & F.col("gt.total").isNotNull()
    dropped = F.when(F.col("dup_of").isNotNull() & split.isin("val", "test", "test_seen"), "dropped_dup").otherwise(split)
    return pages.withColumn("low_quality", F.coalesce(F.col("quality") < 0.5, F.lit(False))).withColumn("complete", F.coalesce(known, F.lit(False))).withColumn("split", dropped)


def with_reference(rows: DataFrame, reference: DataFrame, columns: list[str], key: str = "image_id") -> DataFrame:
    """The rows with ``columns`` as a reference set has them, so that two versions of a corpus are split alike. A row that the
    reference hasn't got is an error; a reference with several rows of a key that differ is one too."""
    of = reference.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns]).distinct()
    twice = of.groupBy("_k").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the reference says different things of {twice[0][0]}")
    plain = rows.drop(*columns)
    joined = plain.join(of, F.col(key) == F.col("_k"), "left")
    known = F.when(F.col("_k").isNull(), F.raise_error(F.concat(F.lit("not in the reference: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.col(key))
    return joined.select(known.alias(key), *[c for c in plain.columns if c != key], *[F.col(f"_{c}").alias(c) for c in columns])


def crop_rejections(crops: DataFrame, pages: DataFrame, least_side: int = 8, longest: int = 100, widest: float = 60.0, narrowest: float = 0.3) -> DataFrame:
    """Adds reason to crops (name, image_id, text, width, height): why a crop isn't used for training, null if it is: a repeated
    name (the first by text stays), a page that was dropped, a copy, a text or a shape that is out of bounds."""
    of = pages.select(F.col("image_id").alias("_i"), F.lower(F.trim("split")).alias("_split")).dropDuplicates(["_i"])
    rows = crops.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("text", "image_id"))).join(of, F.col("image_id") == F.col("_i"), "left")
    n, shape = F.length(norm(F.col("text"))), F.col("width") / F.greatest("height", F.lit(1))
    reason = F.when(F.col("_n") > 1, "duplicate_line").when(F.col("_i").isNull(), "image_dropped").when(F.col("_split") == "dropped_dup", "dup_image").when((n == 0) | (n > longest), "bad_text_len").when((F.least("width", "height") < least_side) | (shape > widest) | (shape < narrowest), "bad_crop_shape")
    return rows.withColumn("reason", reason).drop("_n", "_i", "_split")


def width_batches(rows: DataFrame, key: str, width: str, height: str, size: int, work: Workspace | None = None) -> DataFrame:
    """Adds batch: rows in order of width over height (then key), ``size`` to a batch, numbered from 0.

    Rows are put into ranges of shapes of about equal size and stored with the number of their range, so that counting and
    numbering see the same ranges; the place of a row is its place in its range and the rows of the ranges before. Keys must be
    distinct; a null shape comes first.
    """
    work = work or Workspace(rows.sparkSession, "batches")
    shaped = rows.withColumn("_shape", F.col(width) / F.col(height)).repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_shape", key)
    ranged, _ = work.write(shaped.withColumn("_range", F.spark_partition_id()), "ranged")
    ranked = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy("_shape", key)) - 1)
    before = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_range").alias("_s"), (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row for each range
    return ranked.join(before, F.col("_range") == F.col("_s")).withColumn("batch", F.floor((F.col("_before") + F.col("_at")) / size)).drop("_shape", "_range", "_at", "_s", "_before")


def top_of_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def balanced_pool(rows: DataFrame, group: str, text: str, key: str, repeats: int, alpha: float) -> DataFrame:
    """(key, group, p): at most ``repeats`` rows of one group and text (by a hash of the key), each with its chance in a draw
    with replacement in which a group counts as its size to the power ``alpha``."""
    kept = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group, text).orderBy(F.xxhash64(key), key))).where(F.col("_n") <= repeats)
    sizes = kept.groupBy(group).agg(F.count(F.lit(1)).alias("_k"))
    total = sizes.agg(F.sum(F.pow("_k", F.lit(alpha)))).scalar()
    joined = kept.join(sizes.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")))
    return joined.select(key, group, (F.pow("_k", F.lit(alpha)) / total / F.col("_k")).alias("p"))


def balanced_epoch(rows: DataFrame, group: str, text: str, key: str, repeats: int, alpha: float, size: int, seed: int) -> DataFrame:
    """(key, draws): one epoch of about ``size`` draws; each row's count is drawn for itself, its expected count rounded down and
    a Poisson number for the rest, so nothing is gathered. The sizes of epochs vary by less than the root of ``size``."""
    pool = balanced_pool(rows, group, text, key, repeats, alpha)
    u = (F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    rate = F.col("p") * size - F.floor(F.col("p") * size)
    start = F.struct(F.lit(0).alias("draws"), F.exp(-rate).alias("mass"), F.exp(-rate).alias("total"))

    def next_count(a: Column, k: Column) -> Column:
        mass = a["mass"] * rate / k
        return F.struct((a["draws"] + (u > a["total"]).cast("int")).alias("draws"), mass.alias("mass"), (a["total"] + mass).alias("total"))

    draws = F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, next_count, lambda a: a["draws"]) + F.floor(F.col("p") * size)
    return pool.select(key, draws.alias("draws")).where("draws > 0")


def orientation_votes(pairs: DataFrame, page: str, upright: str, turned: str, least: int = 3, margin: float = 0.05, fraction: float = 0.6, score: float = 0.5) -> DataFrame:
    """One row for each page: turned by 180 degrees if enough lines read clearly better so. Scores must lie in [0, 1]."""
    ok = F.col(upright).between(0, 1) & F.col(turned).between(0, 1) & ~F.isnan(upright) & ~F.isnan(turned)
    gain = F.col(turned) - F.col(upright)
    votes = pairs.where(ok).groupBy(page).agg(F.count(F.lit(1)).alias("valid_lines"), F.percentile(upright, F.lit(0.5)).alias("median_score_0"), F.percentile(turned, F.lit(0.5)).alias("median_score_180"), F.percentile(gain, F.lit(0.5)).alias("median_margin"), F.avg((gain > 0).cast("int")).alias("vote_fraction_180"))
    enough = F.col("valid_lines") >= least
    turn = enough & (F.col("median_margin") >= margin) & (F.col("vote_fraction_180") >= fraction) & (F.col("median_score_180") >= score)
    return votes.withColumn("degrees", F.when(turn, 180).otherwise(0)).withColumn("reason", F.when(~enough, "insufficient_evidence").when(turn, "rotated_confidence_vote").otherwise("keep_original"))


def _shuffled_split(seed: int, small: np.ndarray, n: np.ndarray, total: np.ndarray, shares: dict[str, float]) -> tuple[float, dict[str, np.ndarray]]:
    """(points, members of each split but train) of the shuffle of one seed; fewer points are better."""
    order = small.tolist()
    random.Random(seed).shuffle(order)
    order = np.array(order, dtype=int)
    filled, all_n = np.cumsum(n[order]), n.sum()
    overall = total.sum(0) / max(1.0, all_n)
    start, points, split = 0, 0.0, {}
    for name, share in shares.items():
        need, before = share * all_n, filled[start - 1] if start else 0.0
        end = min(len(order), int(np.searchsorted(filled, before + need, "left")) + 1) if need > 0 else start
        members, start = order[start:end], max(start, end)
        split[name] = members
        if not len(members):
            points += 9
            continue
        means = total[members].sum(0) / n[members].sum()
        points += float((abs(means - overall) / np.where(overall == 0, 1.0, overall)).sum()) + abs(n[members].sum() - need) / all_n * 10
    return points, split


def seeded_group_split(groups: DataFrame, group: str, size: str, shares: dict[str, float], features: list[str], big: int = 40, seeds: int = 500) -> pd.DataFrame:
    """(group, split): of ``seeds`` shuffles the one whose splits are most alike all rows in the means of ``features`` (sums by
    group in the table) and in size; ``attrs`` has its seed. Groups fill the splits of ``shares`` in turn; the rest, and groups
    of ``big`` rows or more, go to train, from which ``seen_draws`` takes. Works on a table of groups, whose size is checked,
    and tries the seeds in tasks; ``llm.splits`` does without one."""
    rows = groups.select(group, size, *features).orderBy(group).limit(MOST_GROUPS + 1).toPandas()
    if len(rows) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    n, total = rows[size].to_numpy(dtype=float), rows[features].to_numpy(dtype=float)
    small = np.flatnonzero(n < big)

    def attempt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"seed": batch["id"], "points": [_shuffled_split(int(s), small, n, total, shares)[0] for s in batch["id"]]})

    spark = groups.sparkSession
    tried = spark.range(0, seeds, 1, max(1, min(seeds, 2 * spark.sparkContext.defaultParallelism))).mapInPandas(attempt, "seed bigint, points double")
    best = tried.orderBy("points", "seed").first() if len(rows) else None
    names = np.full(len(rows), "train", dtype=object)
    if best is not None:
        for name, members in _shuffled_split(best["seed"], small, n, total, shares)[1].items():
            names[members] = name
    out = pd.DataFrame({group: rows[group], "split": names})
    out.attrs["seed"] = best["seed"] if best is not None else 0
    return out


def seen_draws(rows: DataFrame, group: str, record: str, spare: Column, seed: int, big: int = 40, share: float = 0.06) -> DataFrame:
    """(record): of every group of ``big`` rows or more, ``share`` of its rows, rounded up, drawn from those that are not
    ``spare`` (copies of others) by a hash of the record and the seed, so that no group is gathered; all of them if they are
    fewer."""
    named = rows.select(F.col(group).alias("g"), F.col(record).alias("record"), F.coalesce(spare, F.lit(False)).alias("spare"))
    sizes = named.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= big).select(F.col("g").alias("of"), F.ceil(F.col("n") * share - 1e-9).alias("take"))
    left = named.where("not spare").join(sizes, F.col("g") == F.col("of"))
    at = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("record", F.lit(seed)), "record"))
    return left.withColumn("at", at).where("at <= take").select("record")
