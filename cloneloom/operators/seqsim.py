"""Sequence similarity: bounded-distance pairs by blocking, head clusters, exact and approximate search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def padded_hamming(a: str | Column, b: str | Column) -> Column:
    """Mismatches at common places plus the difference of lengths (CL1)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    n = F.least(F.length(a), F.length(b))
    chars = lambda s: F.filter(F.split(F.substring(s, F.lit(1), n), ""), lambda c: c != "")
    unequal = F.filter(F.zip_with(chars(a), chars(b), lambda x, y: x != y), lambda x: x)
    return F.size(unequal) + F.abs(F.length(a) - F.length(b))


def with_ids(df: DataFrame, seq: str, least: int = 4) -> DataFrame:
    """Different sequences of at least ``least`` letters with ids 1.. in the order of their md5 (CL2).

    Ids count within 4096 buckets of the hash, each from the number of sequences in the buckets before it.
    """
    rows = df.select(F.col(seq).alias("seq")).where(F.length(seq) >= least).distinct().withColumn("_h", F.md5(F.col("seq").cast("binary")))
    rows = rows.withColumn("_b", F.substring("_h", 1, 3))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_start", before).drop("_n")
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", "seq"))
    return rows.join(F.broadcast(starts), "_b").select((place + F.col("_start")).cast("long").alias("id"), "seq")


def _pairs_by_key(keyed: DataFrame, check: Column, most: int = 1) -> DataFrame:
    a = keyed.select(F.col("id").alias("seq1id"), F.col("seq").alias("s1"), "key")
    b = keyed.select(F.col("id").alias("seq2id"), F.col("seq").alias("s2"), "key")
    return a.join(b, "key").where("seq1id < seq2id").select("seq1id", "seq2id", check.alias("dist")).where(F.col("dist") <= most).distinct()


def _pieces(n: Column, k: int) -> list[tuple[Column, Column]]:
    """Where k + 1 pieces of a string of n letters begin and how long they are."""
    cuts = [F.floor(n * i / (k + 1)).cast("int") for i in range(k + 2)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(k + 1)]


def _keys(seqs: DataFrame, k: int, lengths: range, shifts: range) -> DataFrame:
    """(id, seq, key): the pieces that a string of each length in reach would have at each shift in reach."""
    keys = []
    for d in lengths:
        n = F.length("seq") + d
        for i, (start, size) in enumerate(_pieces(n, k)):
            for s in shifts:
                ok = (n > 0) & (start + s >= 0) & (start + s + size <= F.length("seq"))
                keys.append(F.when(ok, F.concat_ws(":", n.cast("string"), F.lit(str(i)), F.substr("seq", start + s + 1, size))))
    every = F.array_distinct(F.filter(F.array(*keys), lambda x: x.isNotNull()))
    return seqs.where(F.length("seq") > 0).select("id", "seq", F.explode(every).alias("key"))


def padded_hamming_within(seqs: DataFrame, most: int) -> DataFrame:
    """Pairs of (id, seq) at padded Hamming distance ``most`` or less (CL1, SQ3).

    Of most + 1 pieces of the shorter string one is equal in both at its place; a string has the keys of its own
    length and, as the longer one, those of the up to ``most`` shorter lengths.
    """
    return _pairs_by_key(_keys(seqs, most, range(-most, 1), range(1)), padded_hamming("s1", "s2"), most)


def levenshtein_within(seqs: DataFrame, most: int) -> DataFrame:
    """Pairs of (id, seq) at Levenshtein distance ``most`` or less (CL7).

    Of most + 1 pieces of one string one is found in the other unchanged, moved by ``most`` letters at most.
    """
    a = _keys(seqs, most, range(1), range(1))
    b = _keys(seqs, most, range(-most, most + 1), range(-most, most + 1))
    left, right = a.select(F.col("id").alias("i"), F.col("seq").alias("s1"), "key"), b.select(F.col("id").alias("j"), F.col("seq").alias("s2"), "key")
    near = left.join(right, "key").where("i <> j").select(F.least("i", "j").alias("seq1id"), F.greatest("i", "j").alias("seq2id"), F.levenshtein("s1", "s2").alias("dist"))
    return near.where(F.col("dist") <= most).distinct()


def nearest_reads(seqs: DataFrame, most: int = 3) -> DataFrame:
    """(id, nearest, n_near): distance of each sequence to its nearest other one and how many are within ``most`` (SQ3); nearest is null beyond."""
    pairs = padded_hamming_within(seqs, most)
    both = pairs.select(F.col("seq1id").alias("id"), "dist").unionByName(pairs.select(F.col("seq2id").alias("id"), "dist"))
    near = both.groupBy("id").agg(F.min("dist").alias("nearest"), F.count("*").alias("n_near"))
    return seqs.select("id").join(near, "id", "left").na.fill({"n_near": 0})


def full_clusters(edges: DataFrame) -> DataFrame:
    """(head, member): every sequence with a neighbour heads a cluster of itself and all its neighbours, earlier ones too (CL8)."""
    both = edges.select(F.col("seq1id").alias("head"), F.col("seq2id").alias("member")).unionByName(edges.select(F.col("seq2id").alias("head"), F.col("seq1id").alias("member")))
    return both.unionByName(both.select("head", F.col("head").alias("member")).distinct())


def distinct_clusters(clusters: DataFrame) -> DataFrame:
    """Clusters of different members, of equal ones that with the smallest head (CL8)."""
    named = clusters.groupBy("head").agg(F.array_sort(F.collect_set("member")).alias("members"))
    kept = named.groupBy("members").agg(F.min("head").alias("head"))
    return clusters.join(kept, "head", "left_semi")


def padded_hamming_pairs(seqs: DataFrame) -> DataFrame:
    """Pairs of (id, seq) at padded Hamming distance 1 or less (CL1, J13).

    One mismatch leaves the two equal under a wildcard at its place; one letter more at the end leaves the longer
    without its last letter equal to the shorter.  So pairs meet under those keys and nowhere else.
    """
    places = F.sequence(F.lit(1), F.length("seq"))
    wild = F.transform(places, lambda i: F.concat(F.lit("*"), F.substr("seq", F.lit(1), i - 1), F.lit("?"), F.substr("seq", i + 1)))
    longer = F.array(F.concat(F.lit("="), F.col("seq")), F.concat(F.lit("="), F.substr("seq", F.lit(1), F.length("seq") - 1)))
    keyed = seqs.where(F.length("seq") > 0).select("id", "seq", F.explode(F.concat(wild, longer)).alias("key"))
    return _pairs_by_key(keyed, padded_hamming("s1", "s2"))


def levenshtein_pairs(seqs: DataFrame) -> DataFrame:
    """Pairs at Levenshtein distance 1 or less: both, or one, lose one letter to become equal (CL7)."""
    places = F.sequence(F.lit(1), F.length("seq"))
    without = F.transform(places, lambda i: F.concat(F.substr("seq", F.lit(1), i - 1), F.substr("seq", i + 1)))
    keyed = seqs.where(F.length("seq") > 0).select("id", "seq", F.explode(F.array_union(F.array("seq"), without)).alias("key"))
    return _pairs_by_key(keyed, F.levenshtein("s1", "s2"))


def head_clusters(edges: DataFrame) -> DataFrame:
    """(head, member): each sequence with later neighbours heads a cluster of itself and them (CL3)."""
    return edges.select(F.col("seq1id").alias("head"), F.col("seq2id").alias("member")).unionByName(
        edges.select(F.col("seq1id").alias("head"), F.col("seq1id").alias("member")).distinct()
    )


def drop_contained_clusters(clusters: DataFrame) -> DataFrame:
    """Without clusters all of whose members are in a strictly larger cluster that holds their head (CL4)."""
    sizes = clusters.groupBy("head").agg(F.count("*").alias("n"))
    sized = clusters.join(sizes, "head")
    own = sized.select(F.col("head").alias("h"), F.col("member").alias("m"), F.col("n").alias("k"))
    other = sized.select(F.col("head").alias("oh"), F.col("member").alias("m"), F.col("n").alias("ok"))
    holds = clusters.select(F.col("member").alias("h"), F.col("head").alias("oh")).where("h <> oh")
    inside = own.join(holds, "h").join(other, ["oh", "m"]).where("ok > k").groupBy("h", "oh", "k").agg(F.count("*").alias("c")).where("c = k")
    return clusters.join(inside.select(F.col("h").alias("head")).distinct(), "head", "left_anti")


def sample_by_cluster(cells: DataFrame, clusters: DataFrame, sample: str, member: str) -> DataFrame:
    """Members of each cluster in each sample, absent pairs left out (CL5)."""
    joined = cells.select(sample, F.col(member).alias("member")).distinct().join(clusters, "member")
    return joined.groupBy(sample, "head").agg(F.count("*").alias("n"))


def cluster_annotations(clusters: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per cluster its labels as 'label:count,...', commonest first (CL6); annotations: (member, label)."""
    counts = clusters.join(annotations, "member").groupBy("head", "label").agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "label", "n")))
    return counts.groupBy("head").agg(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["label"], x["n"].cast("string"))), ",").alias("summary"))


def kmers(df: DataFrame, key: str, text: str, k: int, step: int = 1) -> DataFrame:
    """(key, offset, kmer) with offsets from 0: the k-mer index (SQ1)."""
    return _windows(df, key, text, k, k, step).select(key, "offset", "kmer")


#: Bits of the place of a seed's first bytes in the table that texts are sieved with, and bytes of text that are sieved at a time.
SIEVE_BITS, SIEVE_BYTES = 20, 1 << 20


def _heads(data: np.ndarray, first: int, n: int, size: int) -> np.ndarray:
    """Places in the sieve of the up to 8 bytes (``size``) from each of n places on; after the data come zeros."""
    some = np.zeros(n + 8, np.uint8)
    own = data[first : first + n + 8]
    some[: len(own)] = own
    words = np.ndarray(n, "<u8", some, strides=(1,)) & np.uint64((1 << 8 * size) - 1)
    return (words * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SIEVE_BITS)).astype(np.int32)


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each string ends and the next begins, and the bytes of all; nulls are empty."""
    strings = pc.fill_null(strings, "")
    wide = np.int64 if pa.types.is_large_string(strings.type) else np.int32
    edges = np.frombuffer(strings.buffers()[1], wide)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return edges, np.frombuffer(strings.buffers()[2] or b"", np.uint8)


def _sieved(texts: DataFrame, key: str, text: str, seeds: DataFrame, k: int, width: int) -> DataFrame:
    """(key, offset, kmer, window) as of _windows, but only from offsets where the first bytes of a seed (kmer) may stand.

    Tasks look up the bytes at each place in a table of 2 ** SIEVE_BITS places, whatever the number of seeds; what it lets through is joined.
    """
    size = min(k, 8)

    def slots(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, data = _bytes_of(batch.column("kmer"))
            yield pa.RecordBatch.from_pydict({"slot": pa.array([_heads(data, e, 1, size)[0] for e in edges[:-1]], pa.int32())})

    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[[r.slot for r in seeds.select("kmer").mapInArrow(slots, "slot int").distinct().collect()]] = True  # as many as the table has
    sieve = texts.sparkSession.sparkContext.broadcast(sieve)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, data = _bytes_of(batch.column("_t"))
            last, at, letters = -1, 0, 0  # row, byte and letter of the last hit
            for first in range(int(edges[0]), int(edges[-1]), SIEVE_BYTES):
                hits = first + np.flatnonzero(sieve.value[_heads(data, first, min(SIEVE_BYTES, int(edges[-1]) - first), size)])
                row = np.searchsorted(edges, hits, "right") - 1
                ok = (hits + size <= edges[row + 1]) & (data[hits] & 0xC0 != 0x80)  # inside the text, at a letter's first byte
                found, offsets, windows = row[ok], [], []
                for i, p in zip(found.tolist(), hits[ok].tolist()):
                    if i != last:
                        last, at, letters = i, int(edges[i]), 0
                    letters += int(np.count_nonzero(data[at:p] & 0xC0 != 0x80))
                    at = p
                    offsets.append(letters)
                    windows.append(data[p : min(p + 4 * width, int(edges[i + 1]))].tobytes().decode("utf-8", "ignore")[:width])
                names = batch.column("_k").take(pa.array(found))
                yield pa.RecordBatch.from_pydict({key: names, "offset": pa.array(offsets, pa.int32()), "kmer": pa.array([w[:k] for w in windows], pa.string()), "window": pa.array(windows, pa.string())})

    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("offset", T.IntegerType()), T.StructField("kmer", T.StringType()), T.StructField("window", T.StringType())])
    return texts.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInArrow(run, schema)


def exact_matches(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, k: int) -> DataFrame:
    """All offsets of patterns of k letters or more: a seed join on the first k letters, then a comparison (SQ1).

    A seed travels with what follows it, as far as the longest pattern goes, so the texts are read once; only offsets where a seed may stand
    become rows.
    """
    seeds = patterns.where(F.length(pattern) >= k).select(pattern, F.substring(pattern, 1, k).alias("kmer"))
    longest = seeds.agg(F.max(F.length(pattern))).first()[0] or k
    found = _sieved(texts, key, text, seeds, k, longest).join(seeds, "kmer")
    return found.where(F.startswith("window", F.col(pattern))).select(key, pattern, "offset")


def _windows(texts: DataFrame, key: str, text: str, k: int, width: int, step: int = 1, chunk: int = 512) -> DataFrame:
    """(key, offset, kmer, window): the k letters and the up to ``width`` letters from every ``step``-th offset.

    Letters are found by counting from a string's start, so a text is first cut into chunks that overlap by a window.
    """
    size = chunk * step
    starts = F.explode(F.sequence(F.lit(0), F.length(text) - k, F.lit(size))).alias("_s")
    cut = texts.where(F.length(text) >= k).select(key, F.col(text).alias("_t"), starts).select(key, "_s", F.substr("_t", F.col("_s") + 1, F.lit(size + width - 1)).alias("_c"))
    inside = F.explode(F.sequence(F.lit(0), F.least(F.lit(size - step), F.length("_c") - k), F.lit(step))).alias("_o")
    rows = cut.select(key, "_s", "_c", inside)
    return rows.select(key, (F.col("_s") + F.col("_o")).alias("offset"), F.substr("_c", F.col("_o") + 1, F.lit(width)).alias("window")).withColumn("kmer", F.substring("window", 1, k))


def approximate_matches(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, length: int, mismatches: int) -> DataFrame:
    """Offsets where a pattern of ``length`` letters fits with at most ``mismatches`` (SQ2).

    Of mismatches + 1 pieces one fits exactly, which is the seed of the join; the window that brings it is then compared.
    """
    size = length // (mismatches + 1)
    return _seeded(texts, key, text, patterns, pattern, length, mismatches, [lambda c, i=i: F.substring(c, i * size + 1, size) for i in range(mismatches + 1)])


def _every(ival: int, first: int, k: int):
    """k letters of a column, ``ival`` apart, from place ``first`` on."""
    return lambda c: F.concat(*[F.substring(c, first + j * ival + 1, 1) for j in range(k)])


def spaced_kmers(df: DataFrame, key: str, text: str, k: int, ival: int) -> DataFrame:
    """(key, offset, kmer) of k letters that are ``ival`` apart, from every offset: the spaced index (SQ1)."""
    span = 1 + ival * (k - 1)
    return _windows(df, key, text, span, span).select(key, "offset", _every(ival, 0, k)("window").alias("kmer"))


def spaced_matches(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, length: int, mismatches: int, ival: int) -> DataFrame:
    """Offsets where a pattern of ``length`` letters fits with at most ``mismatches``, by every ``ival``-th letter as seeds (SQ1).

    The letters at each of the ``ival`` phases are one seed.  With fewer mismatches than phases one seed has none, so all places are
    found; with as many or more, those that leave a phase untouched, which can be far more than runs of letters would.
    """
    return _seeded(texts, key, text, patterns, pattern, length, mismatches, [_every(ival, r, (length - r - 1) // ival + 1) for r in range(ival)])


def _seeded(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, length: int, mismatches: int, seeds: Sequence[Callable[[str], Column]]) -> DataFrame:
    """(key, pattern, offset, n_mismatches): windows that have one of the seeds in common with a pattern, compared letter by letter.

    A window travels with its seeds, so no text is joined again.
    """
    cut = lambda c: F.inline(F.array(*[F.struct(F.lit(i).alias("_seed"), f(c).alias("_letters")) for i, f in enumerate(seeds)]))
    asked = patterns.where(F.length(pattern) == length).select(pattern).distinct().select(pattern, cut(pattern))
    found = _windows(texts, key, text, length, length).select(key, "offset", "window", cut("window")).join(asked, ["_seed", "_letters"])
    found = found.withColumn("n_mismatches", padded_hamming("window", pattern)).where(F.col("n_mismatches") <= mismatches)
    return found.select(key, pattern, "offset", "n_mismatches").distinct()


#: The genetic code: amino acids of the codons in the order TTT, TTC, TTA, TTG, TCT ... GGG (fixed values).
BASES, AMINO_ACIDS = "TCAG", "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translated(col: str) -> Column:
    """Amino acids of a sequence of A, C, G, T read in threes (F10); X for a codon with other letters, an incomplete one is left out."""
    codes = F.create_map(*[F.lit(x) for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES) for x in (a + b + c, AMINO_ACIDS[16 * i + 4 * j + k])])
    n = F.floor(F.length(col) / 3).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(starts, lambda i: F.coalesce(F.try_element_at(codes, F.substr(F.upper(col), i * 3 + 1, F.lit(3))), F.lit("X"))), "")


def phred_scores(col: str) -> Column:
    """Quality of each base: its character's code less 33."""
    return F.transform(F.filter(F.split(col, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def reverse_complement(col: str | Column) -> Column:
    """Reverse complement of A, C, G, T."""
    return F.reverse(F.translate(col, "ACGT", "TGCA"))
